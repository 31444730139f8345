"""The same queries as plain SQL over the given tables, written without the library.

``ORACLES`` maps a query name to SQL that another engine runs for comparison. The views
below state the telemetry model; messages are not parsed here, their outcome is stated
from the structured rows they were built from.
"""

from __future__ import annotations

VIEWS = {
    "asset_registry": """
SELECT c_custkey AS asset_key, concat('asset-',c_custkey) AS asset_id,
       concat('site-',lower(replace(r_name,' ','-'))) AS site_id,
       concat('area-',n_nationkey) AS area_id, c_name AS name, 'mqtt' AS protocol
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "signal_registry": """
SELECT DISTINCT concat('asset-',user_id) AS asset_id, event_type AS signal_id,
       CASE event_type WHEN 'error' THEN 'C' WHEN 'click' THEN 'A' ELSE 'bar' END AS unit,
       CASE event_type WHEN 'error' THEN '5s' ELSE '1s' END AS sampling_class
FROM events
UNION ALL SELECT 'asset-orphan', 'error', 'C', '5s'""",
    "arrivals": """
SELECT e.ts AS ts_source, e.ts + INTERVAL '1' SECOND AS ts_ingest,
       concat('evt-',e.event_id) AS event_id, r.site_id, r.asset_id, e.event_type AS signal_id, e.event_id AS seq,
       CASE WHEN e.event_id%20=3 THEN 'bad' WHEN e.event_id%7=0 THEN 'uncertain' ELSE 'good' END AS quality,
       CASE e.event_type WHEN 'error' THEN 'C' WHEN 'click' THEN 'A' ELSE 'bar' END AS unit,
       e.value AS value, e.props AS tags, concat('trace-',e.event_id) AS trace_id, e.event_id AS arrival
FROM events e JOIN asset_registry r ON r.asset_id=concat('asset-',e.user_id)
UNION ALL
SELECT e.ts, e.ts + INTERVAL '60' SECOND, concat('evt-r',e.event_id), r.site_id, r.asset_id,
       e.event_type, e.event_id, 'good',
       CASE e.event_type WHEN 'error' THEN 'C' WHEN 'click' THEN 'A' ELSE 'bar' END,
       e.value+1, e.props, concat('trace-r',e.event_id), e.event_id+100000000
FROM events e JOIN asset_registry r ON r.asset_id=concat('asset-',e.user_id)
WHERE e.event_id%10=0""",
    "measurements": """
SELECT ts_source, asset_id, signal_id, seq,
       min_by(event_id,arrival) AS event_id, min_by(site_id,arrival) AS site_id,
       max_by(ts_ingest,arrival) AS ts_ingest, max_by(quality,arrival) AS quality,
       max_by(unit,arrival) AS unit, max_by(value,arrival) AS value,
       max_by(tags,arrival) AS tags, max_by(trace_id,arrival) AS trace_id
FROM arrivals GROUP BY ts_source, asset_id, signal_id, seq""",
    "thresholds": """
SELECT 'error' AS signal_id, 120.0E0 AS limit_value UNION ALL SELECT 'purchase', 150.0E0
UNION ALL SELECT 'view', 150.0E0 UNION ALL SELECT 'click', 200.0E0""",
    "alarms": """
SELECT m.ts_source AS raised_at, concat('alm-',m.seq) AS alarm_id, m.site_id, m.asset_id,
       CASE WHEN m.value > 2*t.limit_value THEN 'critical' ELSE 'high' END AS severity,
       concat(m.signal_id,' threshold exceeded') AS message,
       CASE WHEN m.seq%3=0 THEN 'acknowledged' ELSE 'open' END AS state,
       CASE WHEN m.seq%3=0 THEN m.ts_source + INTERVAL '60' SECOND END AS acknowledged_at
FROM measurements m JOIN thresholds t ON m.signal_id=t.signal_id AND m.value > t.limit_value""",
    "site_health": """
SELECT max(ts_source) AS updated_at, site_id, upper(site_id) AS site_name,
       CASE WHEN count(*) FILTER (WHERE quality='bad') > 0 THEN 'degraded' ELSE 'connected' END AS status,
       count(*) FILTER (WHERE quality='bad') < 4 AS connected, TRUE AS mqtt_connected,
       CAST(count(*) FILTER (WHERE quality='bad') AS INTEGER) AS spool_depth,
       CAST(count(*) FILTER (WHERE quality='uncertain') AS INTEGER) AS kafka_lag
FROM measurements GROUP BY site_id, CAST(ts_source AS DATE)""",
    "command_arrivals": """
SELECT 'request' AS kind, o.o_orderkey AS n, o.o_orderdate AS issued_at, concat('cmd-',o.o_orderkey) AS command_id,
       r.site_id, r.asset_id, concat('setpoint-',o.o_orderkey%5) AS target_signal,
       CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS VARCHAR) AS requested_value,
       concat('operator-',o.o_custkey%10) AS requested_by,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
            WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS priority,
       o.o_orderstatus<>'P' AS approved,
       CASE WHEN o.o_orderstatus<>'P' THEN concat('ref-',o.o_orderkey) ELSE '' END AS approval_reference,
       o.o_orderdate + INTERVAL '90' SECOND AS expires_at,
       CASE WHEN o.o_orderstatus<>'P' THEN 'approved' ELSE 'pending-approval' END AS status,
       o.o_orderkey*10 AS arrival
FROM orders o JOIN asset_registry r ON r.asset_id=concat('asset-',o.o_custkey)
UNION ALL
SELECT 'ack', o.o_orderkey, o.o_orderdate, concat('cmd-',o.o_orderkey), r.site_id, r.asset_id, '', '', 'system', 'medium',
       TRUE, '', o.o_orderdate + INTERVAL '300' SECOND, 'completed',
       o.o_orderkey*10 + CASE WHEN o.o_orderkey%11=0 THEN -5 ELSE 5 END
FROM orders o JOIN asset_registry r ON r.asset_id=concat('asset-',o.o_custkey)
WHERE o.o_orderstatus='F'""",
    "command_log": """
SELECT issued_at, command_id, min_by(site_id,arrival) AS site_id, min_by(asset_id,arrival) AS asset_id,
       min_by(target_signal,arrival) AS target_signal,
       coalesce(max_by(requested_value,arrival) FILTER (WHERE kind='request'), '') AS requested_value,
       min_by(requested_by,arrival) AS requested_by, min_by(priority,arrival) AS priority,
       coalesce(max_by(approved,arrival) FILTER (WHERE kind='request'), TRUE) AS approved,
       coalesce(max_by(approval_reference,arrival) FILTER (WHERE kind='request'), '') AS approval_reference,
       min_by(expires_at,arrival) AS expires_at, max_by(status,arrival) AS status
FROM command_arrivals GROUP BY issued_at, command_id""",
    "spool": """
SELECT o.o_orderkey AS row_id, r.site_id, 'command.request' AS kafka_topic, concat('cmd-',o.o_orderkey) AS message_key,
       concat('{"order":',o.o_orderkey,'}') AS payload,
       CASE WHEN o.o_orderstatus='F' THEN 'sent' ELSE 'pending' END AS status,
       o.o_orderdate AS created_at,
       CASE WHEN o.o_orderstatus='F' THEN o.o_orderdate + INTERVAL '20' MINUTE END AS sent_at
FROM orders o JOIN asset_registry r ON r.asset_id=concat('asset-',o.o_custkey)""",
    # What becomes of each telemetry message: why it fails, or the fields it yields.
    "telemetry": """
SELECT a.arrival, CAST(seq%8 AS INTEGER) AS part, ts_source, ts_ingest, event_id, site_id, asset_id, signal_id, seq, quality,
       CASE WHEN seq%50=7 THEN '' ELSE unit END AS unit,
       CASE WHEN seq%50=5 THEN 1.0E0 ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS value,
       CASE WHEN seq%50=17 THEN '{}' ELSE replace(tags,' ','') END AS tags,
       CASE WHEN seq%50=18 THEN '' ELSE trace_id END AS trace_id,
       CASE seq%50 WHEN 0 THEN 'assetId is missing' WHEN 1 THEN 'quality has a value outside its list' WHEN 3 THEN 'seq is below zero'
            WHEN 4 THEN 'payload is not valid JSON' WHEN 9 THEN 'tags is not an object'
            WHEN 14 THEN 'payload is not an object' WHEN 15 THEN 'no full date and time: not-a-time'
            WHEN 16 THEN 'site_id may not be empty' END AS envelope_error,
       CASE seq%50 WHEN 2 THEN 'value does not read as a number: running' WHEN 8 THEN 'value is neither number nor text nor flag' END AS value_error,
       CASE WHEN seq%50 IN (9,14) THEN 'malformed' WHEN seq%50 IN (0,1,2,3,4,8,15,16) THEN 'rejected' END AS reason
FROM arrivals a""",
    "alarm_rows": """
SELECT a.arrival, a.ts_source AS raised_at, concat('alm-',a.seq) AS alarm_id, a.site_id, a.asset_id,
       CASE WHEN a.seq%5 IN (0,1) THEN 'medium' ELSE 'high' END AS severity,
       CASE a.seq%5 WHEN 0 THEN 'check it' WHEN 1 THEN concat(a.signal_id,' threshold exceeded') ELSE concat(a.signal_id,' over limit') END AS message,
       'open' AS state, CAST(NULL AS TIMESTAMP) AS acknowledged_at,
       concat('{"assetId":"',a.asset_id,'","eventId":"alm-',a.seq,'","quality":"bad","seq":',a.seq,',"signalId":"',a.signal_id,
              '","siteId":"',a.site_id,'",',
              CASE a.seq%5 WHEN 0 THEN '"tags":{"message":"check it"},' WHEN 1 THEN ''
                   ELSE concat('"tags":{"message":"',a.signal_id,' over limit","severity":"high"},') END,
              '"ts_ingest":"',strftime(a.ts_ingest,'%Y-%m-%dT%H:%M:%S.%f'),'Z","ts_source":"',strftime(a.ts_source,'%Y-%m-%dT%H:%M:%S.%f'),
              'Z","value":"over"}') AS payload
FROM arrivals a JOIN thresholds t ON a.signal_id=t.signal_id AND a.value > t.limit_value""",
    "event_rows": """
SELECT CASE WHEN event_id%6=3 THEN ts + INTERVAL '5' SECOND ELSE ts END AS ts_source,
       CASE WHEN event_id%6=5 THEN concat('evt-raw.events-',event_id%4,'-',event_id) ELSE concat('ev-',event_id) END AS event_id,
       'site-x' AS site_id, concat('asset-',user_id) AS asset_id,
       CASE WHEN event_id%6=3 THEN 'generic-event' ELSE event_type END AS event_type,
       concat('{"assetId":"asset-',user_id,'"',
              CASE WHEN event_id%6 IN (1,5) THEN '' ELSE concat(',"eventId":"ev-',event_id,'"') END,
              CASE WHEN event_id%6 IN (2,3) THEN '' ELSE concat(',"eventType":"',event_type,'"') END,
              CASE WHEN event_id%6=1 THEN concat(',"id":"ev-',event_id,'"') ELSE '' END,
              ',"payload":',replace(props,' ',''),',"siteId":"site-x"',
              CASE WHEN event_id%6 IN (1,2) THEN concat(',"timestamp":"',strftime(ts,'%Y-%m-%dT%H:%M:%S.%f'),'Z"') ELSE '' END,
              CASE WHEN event_id%6=1 THEN ',"ts_source":""' WHEN event_id%6 IN (2,3) THEN ''
                   ELSE concat(',"ts_source":"',strftime(ts,'%Y-%m-%dT%H:%M:%S.%f'),'Z"') END,
              CASE WHEN event_id%6=2 THEN concat(',"type":"',event_type,'"') ELSE '' END, '}') AS payload
FROM events WHERE event_id%6<>4""",
    "state_rows": """
SELECT CASE WHEN event_id%6=4 THEN ts + INTERVAL '5' SECOND ELSE ts END AS ts_source,
       'site-x' AS site_id, concat('asset-',user_id) AS asset_id,
       CASE event_id%6 WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'unknown' WHEN 3 THEN 'True' ELSE event_type END AS state,
       concat('{"assetId":"asset-',user_id,'","siteId":"site-x"',
              CASE event_id%6 WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN ',"state":true' ELSE concat(',"state":"',event_type,'"') END,
              CASE WHEN event_id%6=4 THEN '' ELSE concat(',"ts_source":"',strftime(ts,'%Y-%m-%dT%H:%M:%S.%f'),'Z"') END,
              CASE WHEN event_id%6=1 THEN concat(',"value":',event_id) ELSE '' END, '}') AS payload
FROM events WHERE event_id%6<>5""",
    "request_rows": """
SELECT 'request' AS kind, n, arrival, CASE WHEN n%40=4 THEN issued_at + INTERVAL '1' SECOND ELSE issued_at END AS issued_at, command_id,
       site_id, asset_id, target_signal,
       CASE WHEN n%40=5 THEN 'True' ELSE requested_value END AS requested_value, requested_by,
       CASE WHEN n%40=7 THEN 'medium' ELSE priority END AS priority,
       CASE WHEN n%40 IN (2,8) THEN FALSE ELSE approved END AS approved,
       approval_reference, expires_at,
       CASE WHEN n%40 IN (2,8) OR NOT approved THEN 'pending-approval' ELSE 'approved' END AS status,
       CASE WHEN n%40=0 THEN 'priority has a value outside its list' WHEN n%40=1 THEN 'requestedBy is missing'
            WHEN n%40=2 OR (n%40=8 AND approval_reference<>'') THEN 'approval_reference stands without an approval'
            WHEN n%40=3 THEN 'no full date and time: later' END AS error
FROM command_arrivals WHERE kind='request'""",
    "ack_rows": """
SELECT 'ack' AS kind, n, arrival, CASE WHEN n%7=5 THEN issued_at + INTERVAL '1' SECOND ELSE issued_at END AS issued_at, command_id,
       CASE WHEN n%7=2 THEN 'unknown-site' ELSE site_id END AS site_id,
       CASE WHEN n%7=2 THEN 'unknown-asset' ELSE asset_id END AS asset_id,
       '' AS target_signal, '' AS requested_value, 'system' AS requested_by, 'medium' AS priority, TRUE AS approved, '' AS approval_reference,
       CASE WHEN n%7=4 THEN issued_at + INTERVAL '1' SECOND ELSE expires_at END AS expires_at,
       CASE WHEN n%7=1 THEN 'acknowledged' ELSE status END AS status,
       CASE WHEN n%7=3 THEN 'commandId is missing' END AS error
FROM command_arrivals WHERE kind='ack'""",
    "score_rows": """
SELECT TIMESTAMP '2024-01-30 00:00:00' AS ts_source,
       CASE WHEN vec_id%6=2 THEN 'unknown-model' ELSE 'vec-model' END AS model_id, 'site-x' AS site_id,
       concat('asset-',label) AS asset_id, 'vibration' AS signal_id, vec_id,
       CASE WHEN vec_id%6=5 THEN 0.25E0 ELSE CAST(vec_id%100 AS DOUBLE) END AS score,
       CASE vec_id%6 WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE ELSE label>4 END AS anomalous,
       concat('{', CASE vec_id%6 WHEN 1 THEN '' WHEN 2 THEN '"anomalous":1,' WHEN 3 THEN '"anomalous":"",'
                        ELSE concat('"anomalous":',CASE WHEN label>4 THEN 'true' ELSE 'false' END,',') END,
              '"assetId":"asset-',label,'",', CASE WHEN vec_id%6=2 THEN '' ELSE '"modelId":"vec-model",' END,
              '"score":', CASE WHEN vec_id%6=5 THEN '"0.25"' ELSE CAST(vec_id%100 AS VARCHAR) END,
              ',"signalId":"vibration","siteId":"site-x","timestamp":"2024-01-30T00:00:00Z"}') AS payload
FROM embeddings WHERE vec_id%6<>4""",
    "device_topics": """
SELECT o.o_orderkey, r.asset_id, r.site_id, r.area_id, o.o_orderkey%7 AS turn,
       concat('site/',r.site_id,'/area/',r.area_id,'/asset/',r.asset_id) AS path
FROM orders o JOIN asset_registry r ON r.asset_key=o.o_custkey""",
    "centroids": """
SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS mean
FROM embeddings, (SELECT unnest(range(1,65)) AS i) p GROUP BY label, i""",
    "vector_scores": """
SELECT e.vec_id, e.label, avg((CAST(e.embedding[c.i] AS DOUBLE)-c.mean)*(CAST(e.embedding[c.i] AS DOUBLE)-c.mean)) AS score,
       CASE WHEN e.vec_id%3=0 THEN 0.01E0 ELSE 0.15E0 END AS threshold
FROM embeddings e JOIN centroids c ON e.label=c.label GROUP BY e.vec_id, e.label""",
}

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
RANGE = "BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-30 12:00:00'"
COMMANDS = "issued_at, command_id, site_id, asset_id, target_signal, requested_value, requested_by, priority, approved, approval_reference, expires_at, status"
TOPIC = """CASE turn WHEN 0 THEN concat(path,'/telemetry') WHEN 1 THEN concat(path,'/command/ack') WHEN 2 THEN concat(path,'/write')
     WHEN 3 THEN path WHEN 4 THEN concat('plant/',site_id,'/area/x/asset/y/event') WHEN 5 THEN concat(path,'/command/request/now')
     ELSE concat(path,'/command/request') END"""


def _rollup(width: str, rows: str = "measurements") -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', ts_source) AS bucket, site_id, asset_id, signal_id,
       round(avg(value),6) AS avg_value, min(value) AS min_value, max(value) AS max_value
FROM {rows} GROUP BY 1,2,3,4"""


def _latest_health(columns: str) -> str:
    return f"SELECT DISTINCT ON (site_id) site_id, {columns} FROM site_health ORDER BY site_id, updated_at DESC"


QUERIES = {
    "upsert_measurements": "SELECT * FROM measurements",
    "upsert_alarms": """SELECT raised_at, alarm_id, min_by(site_id,arrival) AS site_id, min_by(asset_id,arrival) AS asset_id,
       'open' AS state, CAST(NULL AS TIMESTAMP) AS acknowledged_at, max_by(severity,arrival) AS severity,
       max_by(message,arrival) AS message, max_by(payload,arrival) AS payload
FROM alarm_rows GROUP BY raised_at, alarm_id""",
    "upsert_events": """SELECT ts_source, event_id, min_by(site_id,again) AS site_id, min_by(asset_id,again) AS asset_id,
       max_by(payload,again) AS payload, max_by(event_type,again) AS event_type
FROM (SELECT ts_source, event_id, site_id, asset_id, event_type, payload, 0 AS again FROM event_rows
      UNION ALL SELECT ts_source, event_id, 'site-y', asset_id, 'fault',
             replace(replace(payload,'"site-x"','"site-y"'),'"eventType":"error"','"eventType":"fault"'), 1
      FROM event_rows WHERE payload LIKE '%"eventId"%' AND payload LIKE '%"eventType":"error"%')
GROUP BY ts_source, event_id""",
    "upsert_asset_state": """SELECT ts_source, asset_id, min_by(site_id,again) AS site_id, max_by(state,again) AS state, max_by(payload,again) AS payload
FROM (SELECT ts_source, asset_id, site_id, state, payload, 0 AS again FROM state_rows
      UNION ALL SELECT ts_source, asset_id, 'site-y', 'fault',
             replace(replace(payload,'"site-x"','"site-y"'),'"state":"error"','"state":"fault"'), 1
      FROM state_rows WHERE payload LIKE '%"state":"error"%')
GROUP BY ts_source, asset_id""",
    "upsert_model_scores": """SELECT ts_source, model_id, asset_id, signal_id, 'site-x' AS site_id, max_by(score,vec_id) AS score,
       max_by(anomalous,vec_id) AS anomalous, max_by(payload,vec_id) AS payload
FROM score_rows GROUP BY ts_source, model_id, asset_id, signal_id""",
    "command_requests": """SELECT issued_at, command_id, min_by(site_id,again) AS site_id, min_by(asset_id,again) AS asset_id,
       min_by(target_signal,again) AS target_signal, max_by(requested_value,again) AS requested_value,
       min_by(requested_by,again) AS requested_by, min_by(priority,again) AS priority, max_by(approved,again) AS approved,
       max_by(approval_reference,again) AS approval_reference, min_by(expires_at,again) AS expires_at, max_by(status,again) AS status
FROM (SELECT *, 0 AS again FROM command_arrivals WHERE kind='request'
      UNION ALL SELECT * REPLACE ('operator-late' AS requested_by, concat(requested_value,'0') AS requested_value, 'superseded' AS status), 1
      FROM command_arrivals WHERE kind='request' AND n%7=0)
GROUP BY issued_at, command_id""",
    "command_log": "SELECT * FROM command_log",
    "command_log_from_messages": """SELECT issued_at, command_id, min_by(site_id,arrival) AS site_id, min_by(asset_id,arrival) AS asset_id,
       min_by(target_signal,arrival) AS target_signal,
       coalesce(max_by(requested_value,arrival) FILTER (WHERE kind='request'), '') AS requested_value,
       min_by(requested_by,arrival) AS requested_by, min_by(priority,arrival) AS priority,
       coalesce(max_by(approved,arrival) FILTER (WHERE kind='request'), TRUE) AS approved,
       coalesce(max_by(approval_reference,arrival) FILTER (WHERE kind='request'), '') AS approval_reference,
       min_by(expires_at,arrival) AS expires_at, max_by(status,arrival) AS status
FROM (SELECT * FROM request_rows WHERE error IS NULL UNION ALL SELECT * FROM ack_rows WHERE error IS NULL) GROUP BY issued_at, command_id""",
    "command_latest": "SELECT DISTINCT ON (command_id) * FROM command_log ORDER BY command_id, issued_at DESC",
    "command_lookup": "SELECT * FROM command_log WHERE command_id='cmd-42' ORDER BY issued_at DESC LIMIT 1",
    "command_append": f"SELECT {COMMANDS} FROM command_arrivals WHERE kind='request'",
    "deployment_append": """SELECT p_partkey, p_brand AS model_id, concat('v',p_partkey) AS version, concat('sum-',p_size) AS checksum,
       'telemetry-envelope-v1' AS input_schema, CASE WHEN p_partkey%20=4 THEN 'draft' ELSE 'approved' END AS approval_state,
       'site-asia' AS target_scope,
       CASE p_partkey%20 WHEN 2 THEN '' WHEN 5 THEN '7' ELSE concat('v',p_partkey-1) END AS rollback_version,
       TIMESTAMP '2024-01-31 00:00:00' AS deployed_at, 'platform-admin' AS deployed_by
FROM part WHERE p_partkey%20 NOT IN (0,1,3)""",
    "rollup_1m": _rollup("1 minute"),
    "rollup_15m": _rollup("15 minutes"),
    "rollup_1h": _rollup("1 hour"),
    "rollup_1h_good_quality": _rollup("1 hour", "(SELECT * FROM measurements WHERE quality='good')"),
    "rollup_refresh": f"""SELECT * FROM ({_rollup("15 minutes", "(SELECT * FROM arrivals WHERE event_id NOT LIKE 'evt-r%')")})
WHERE bucket < TIMESTAMP '2024-01-17 00:00:00' OR bucket >= TIMESTAMP '2024-01-30 23:45:00'
UNION ALL
SELECT * FROM ({_rollup("15 minutes")})
WHERE bucket >= TIMESTAMP '2024-01-17 00:00:00' AND bucket < TIMESTAMP '2024-01-30 23:45:00'""",
    "backfill_summary": "SELECT site_id, asset_id, signal_id, round(avg(value),6) AS avg_value FROM measurements GROUP BY 1,2,3",
    "time_group_10s": f"""SELECT time_bucket(INTERVAL '10 seconds', ts_source) AS time, round(avg(value),6) AS value
FROM measurements WHERE asset_id='asset-7' AND signal_id='view' AND ts_source {RANGE} GROUP BY 1""",
    "retention_cut": "SELECT * FROM measurements WHERE ts_source >= TIMESTAMP '2024-01-15 00:00:00'",
    "layout_write": f"""SELECT CAST(CAST(ts_source AS DATE) AS VARCHAR) AS day, count(*) AS rows
FROM measurements WHERE ts_source {RANGE} GROUP BY 1""",
    "total_measurements": "SELECT count(*) AS measurements_total FROM measurements",
    "latest_telemetry": f"""SELECT DISTINCT ON (asset_id) asset_id, site_id, ts_source, quality FROM measurements
WHERE ts_source >= {AS_OF} - INTERVAL '24' HOUR ORDER BY asset_id, ts_source DESC""",
    "asset_health": f"""SELECT lt.ts_source AS time, lt.asset_id,
       CASE WHEN coalesce(oa.n,0)>0 THEN 'attention' WHEN lt.ts_source < {AS_OF} - INTERVAL '5' MINUTE THEN 'stale' ELSE 'healthy' END AS health,
       coalesce(oa.n,0) AS open_alarm_count, lt.quality
FROM (SELECT DISTINCT ON (asset_id) asset_id, ts_source, quality FROM measurements
      WHERE ts_source >= {AS_OF} - INTERVAL '24' HOUR ORDER BY asset_id, ts_source DESC) lt
LEFT JOIN (SELECT asset_id, count(*) FILTER (WHERE state='open') AS n FROM alarms
           WHERE raised_at >= {AS_OF} - INTERVAL '24' HOUR GROUP BY asset_id) oa USING (asset_id)""",
    "open_alarms_by_asset": f"""SELECT asset_id, count(*) FILTER (WHERE state='open') AS open_alarm_count FROM alarms
WHERE raised_at >= {AS_OF} - INTERVAL '24' HOUR GROUP BY asset_id""",
    "open_alarms_24h": f"""SELECT count(*) AS open_alarm_count FROM alarms
WHERE state='open' AND raised_at >= {AS_OF} - INTERVAL '24' HOUR""",
    "latest_site_health": _latest_health("connected, mqtt_connected, spool_depth, kafka_lag, updated_at"),
    "live_site_connectivity": _latest_health("connected, mqtt_connected, spool_depth, kafka_lag, updated_at"),
    "latest_sites": _latest_health("site_name AS name, status"),
    "ingest_status": f"""SELECT count(*) AS total_sites, count(*) FILTER (WHERE NOT connected OR spool_depth>0) AS degraded_sites,
       CAST(coalesce(sum(spool_depth),0) AS BIGINT) AS total_spool_depth, TRUE AS kafka_connected, {AS_OF} AS updated_at
FROM ({_latest_health("connected, spool_depth")})""",
    "latest_spool_depth": """SELECT coalesce((SELECT spool_depth FROM site_health ORDER BY updated_at DESC, site_id DESC LIMIT 1),0) AS spool_depth""",
    "telemetry_window": f"""SELECT asset_id, site_id, ts_source, signal_id, value, quality, unit, tags FROM measurements
WHERE asset_id='asset-7' AND ts_source {RANGE} ORDER BY ts_source DESC, seq DESC LIMIT 500""",
    "telemetry_window_all": f"""SELECT * FROM (SELECT asset_id, site_id,
       row_number() OVER (PARTITION BY asset_id ORDER BY ts_source DESC, seq DESC) AS rank, ts_source, signal_id, value, quality, unit, tags
FROM measurements WHERE ts_source {RANGE}) WHERE rank <= 500""",
    "telemetry_points": f"""SELECT asset_id, seq, ts_source, signal_id, CAST(value AS VARCHAR) AS value, quality, unit, tags FROM measurements
WHERE ts_source <= {AS_OF}""",
    "alarm_list": "SELECT * FROM alarms ORDER BY raised_at DESC, alarm_id DESC LIMIT 200",
    "alarm_list_filtered": """SELECT * FROM alarms WHERE site_id='site-asia' AND state='open' ORDER BY raised_at DESC, alarm_id DESC LIMIT 200""",
    "threshold_alarms": """SELECT ts_source, asset_id, signal_id, seq, value, limit_value FROM measurements
JOIN thresholds USING (signal_id) WHERE value > limit_value""",
    "device_threshold_alarms": """SELECT ts_source, m.asset_id, m.signal_id, seq, value, t.limit_value
FROM measurements m JOIN asset_registry r ON m.asset_id=r.asset_id
JOIN (SELECT 'error' AS signal_id, 120.5E0 AS limit_value UNION ALL SELECT 'view', 150.0E0) t ON m.signal_id=t.signal_id
WHERE value > t.limit_value AND r.asset_key%20 NOT IN (0,1,2,3,5,6,7,8)""",
    "alarm_envelopes": """SELECT concat('alm-',event_id) AS key, concat('alm-',event_id) AS event_id, site_id, asset_id, signal_id, 'bad' AS quality,
       ts_source, seq, unit, value, concat('{"message":"',signal_id,' threshold exceeded","severity":"high"}') AS tags, CAST(NULL AS VARCHAR) AS error
FROM measurements JOIN thresholds USING (signal_id) WHERE value > limit_value""",
    "asset_detail": """SELECT a.asset_id, a.site_id, a.area_id, a.name, CAST(0 AS INTEGER) AS page,
       coalesce(string_agg(concat(s.signal_id,'|',s.unit,'|',s.sampling_class), ';' ORDER BY s.signal_id) FILTER (WHERE s.signal_id IS NOT NULL), '') AS signals
FROM asset_registry a LEFT JOIN signal_registry s USING (asset_id) GROUP BY 1,2,3,4""",
    "asset_signals": "SELECT signal_id, unit, sampling_class FROM signal_registry WHERE asset_id='asset-7'",
    "site_tree": f"""SELECT h.site_id, h.name AS site_name, h.status AS site_status, a.asset_id, a.area_id, a.name AS asset_name, CAST(0 AS INTEGER) AS page,
       coalesce(string_agg(s.signal_id, ';' ORDER BY s.signal_id), '') AS signals
FROM ({_latest_health("site_name AS name, status")}) h JOIN asset_registry a ON a.site_id=h.site_id
LEFT JOIN signal_registry s USING (asset_id) GROUP BY 1,2,3,4,5,6""",
    "orphan_signals": "SELECT * FROM signal_registry s WHERE NOT EXISTS (SELECT 1 FROM asset_registry a WHERE a.asset_id=s.asset_id)",
    "owned_signals": "SELECT * FROM signal_registry s WHERE EXISTS (SELECT 1 FROM asset_registry a WHERE a.asset_id=s.asset_id)",
    "registry_seed": """SELECT concat('asset-',s_suppkey*40) AS asset_id, 'site-new' AS site_id, concat('area-',s_nationkey) AS area_id,
       s_name AS name, 'mqtt' AS protocol
FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey=s.s_suppkey*40)""",
    "model_versions": """SELECT TIMESTAMP '2024-01-31 00:00:00' - to_days(p_size) AS deployed_at, p_brand AS model_id, concat('v',p_partkey) AS version,
       concat('sum-',p_size) AS checksum, 'telemetry-envelope-v1' AS input_schema, 'approved' AS approval_state, 'site-asia' AS target_scope,
       '' AS rollback_version, 'platform-admin' AS deployed_by FROM part""",
    "contract_telemetry": """SELECT arrival AS "offset",
       CASE WHEN envelope_error IS NULL THEN event_id END AS event_id, CASE WHEN envelope_error IS NULL THEN site_id END AS site_id,
       CASE WHEN envelope_error IS NULL THEN asset_id END AS asset_id, CASE WHEN envelope_error IS NULL THEN signal_id END AS signal_id,
       CASE WHEN envelope_error IS NULL THEN quality END AS quality, CASE WHEN envelope_error IS NULL THEN ts_source END AS ts_source,
       CASE WHEN envelope_error IS NULL THEN ts_ingest END AS ts_ingest, CASE WHEN envelope_error IS NULL THEN CAST(seq AS VARCHAR) END AS seq,
       CASE WHEN envelope_error IS NULL THEN unit END AS unit, CASE WHEN envelope_error IS NULL THEN tags END AS tags,
       CASE WHEN envelope_error IS NULL THEN trace_id END AS trace_id,
       CASE WHEN envelope_error IS NOT NULL THEN reason END AS reason, envelope_error AS error FROM telemetry""",
    "contract_telemetry_strict": """SELECT arrival AS "offset", CASE WHEN seq%50=14 THEN 'malformed' WHEN seq%50 IN (0,1,3,4,7,8,9,12,13,15,16) THEN 'rejected' END AS reason,
       CASE seq%50 WHEN 7 THEN 'unit is missing' WHEN 12 THEN 'seq must be of type integer' WHEN 13 THEN 'seq must be of type integer'
            WHEN 8 THEN 'value must be of type scalar' WHEN 9 THEN 'tags must be of type object' ELSE envelope_error END AS error
FROM telemetry""",
    "contract_command": """SELECT command_id AS key,
       CASE WHEN error IS NULL THEN command_id END AS command_id, CASE WHEN error IS NULL THEN site_id END AS site_id,
       CASE WHEN error IS NULL THEN asset_id END AS asset_id, CASE WHEN error IS NULL THEN target_signal END AS target_signal,
       CASE WHEN error IS NULL THEN requested_value END AS requested_value, CASE WHEN error IS NULL THEN requested_by END AS requested_by,
       CASE WHEN error IS NULL THEN priority END AS priority, CASE WHEN error IS NULL THEN CAST(approved AS VARCHAR) END AS approved,
       CASE WHEN error IS NULL THEN approval_reference END AS approval_reference, CASE WHEN error IS NULL THEN expires_at END AS expires_at,
       CASE WHEN error IS NULL THEN status END AS status, CASE WHEN error IS NOT NULL THEN 'rejected' END AS reason, error FROM request_rows""",
    "contract_command_strict": """SELECT key, CASE WHEN error IS NOT NULL THEN 'rejected' END AS reason, error FROM (SELECT command_id AS key,
       CASE WHEN n%40=1 THEN 'requestedBy is missing' WHEN n%40=7 THEN 'priority is missing' WHEN n%10=9 THEN 'unknown key: issuedAt'
            WHEN n%40=8 THEN 'approved must be of type boolean' ELSE error END AS error
FROM request_rows)""",
    "contract_device": """SELECT asset_key, CASE WHEN e IS NULL THEN site_id END AS site_id, CASE WHEN e IS NULL THEN asset_id END AS asset_id,
       CASE WHEN e IS NULL THEN concat('dev-',asset_key) END AS device_id, CASE WHEN e IS NULL THEN 'mqtt' END AS protocol,
       CASE WHEN e IS NOT NULL THEN NULL WHEN asset_key%20=6 THEN 'error=7' ELSE 'error=ns=2;s=1;view=ns=2;s=2' END AS signal_map,
       CASE WHEN e IS NULL THEN 'error=C;view=bar' END AS units, CASE WHEN e IS NULL THEN '5s' END AS sampling_class,
       CAST(CASE WHEN e IS NOT NULL THEN -1 WHEN asset_key%20=3 THEN 0 WHEN asset_key%20=7 THEN 1 ELSE 2 END AS INTEGER) AS thresholds,
       CASE WHEN e IS NOT NULL THEN NULL WHEN asset_key%20=4 THEN 'shift=b;team=a' ELSE '' END AS ownership_tags,
       CASE WHEN e IS NOT NULL THEN 'rejected' END AS reason, e AS error
FROM (SELECT *, CASE asset_key%20 WHEN 0 THEN 'signal_map may not be empty' WHEN 1 THEN 'sampling_class has a value outside its list' WHEN 2 THEN 'units is missing'
             WHEN 5 THEN 'asset_id may not be empty' END AS e FROM asset_registry)""",
    "contract_device_strict": """SELECT asset_key, CASE WHEN asset_key%20 IN (0,1,2,5,6,7,8) THEN 'rejected' END AS reason,
       CASE asset_key%20 WHEN 0 THEN 'signal_map may not be empty' WHEN 1 THEN 'sampling_class has a value outside its list' WHEN 2 THEN 'units is missing'
            WHEN 5 THEN 'asset_id may not be empty' WHEN 6 THEN 'signalMap values must be of type string'
            WHEN 7 THEN 'thresholds values must be of type number' WHEN 8 THEN 'unknown key: colour' END AS error
FROM asset_registry""",
    "contract_model": """SELECT p_partkey, CASE WHEN e IS NULL THEN p_brand END AS model_id, CASE WHEN e IS NULL THEN concat('v',p_partkey) END AS version,
       CASE WHEN e IS NULL THEN concat('sum-',p_size) END AS checksum, CASE WHEN e IS NULL THEN 'telemetry-envelope-v1' END AS input_schema,
       CASE WHEN e IS NOT NULL THEN NULL WHEN p_partkey%20=4 THEN 'draft' ELSE 'approved' END AS approval_state,
       CASE WHEN e IS NULL THEN 'site-asia' END AS target_scope,
       CASE WHEN e IS NOT NULL THEN NULL WHEN p_partkey%20=2 THEN '' WHEN p_partkey%20=5 THEN '7' ELSE concat('v',p_partkey-1) END AS rollback_version,
       CASE WHEN e IS NOT NULL THEN 'rejected' END AS reason, e AS error
FROM (SELECT *, CASE p_partkey%20 WHEN 0 THEN 'approval_state has a value outside its list' WHEN 1 THEN 'version may not be empty'
             WHEN 3 THEN 'inputSchema is missing' END AS e FROM part)""",
    "contract_model_strict": """SELECT p_partkey, CASE WHEN p_partkey%20 IN (0,1,3,5,6) THEN 'rejected' END AS reason,
       CASE p_partkey%20 WHEN 0 THEN 'approval_state has a value outside its list' WHEN 1 THEN 'version may not be empty' WHEN 3 THEN 'inputSchema is missing'
            WHEN 5 THEN 'rollbackVersion must be of type string' WHEN 6 THEN 'unknown key: owner' END AS error
FROM part""",
    "numeric_coercion": """SELECT event_id, CASE event_id%12 WHEN 1 THEN CAST(event_id AS DOUBLE) WHEN 2 THEN 1.0E0 WHEN 3 THEN 0.0E0
       WHEN 5 THEN 7.0E0 WHEN 10 THEN 1000.0E0 WHEN 0 THEN value WHEN 4 THEN value END AS value FROM events""",
    "timestamp_normalise": """SELECT event_id,
       CASE event_id%10 WHEN 1 THEN strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')
            WHEN 2 THEN concat(strftime(ts + INTERVAL '2' HOUR,'%Y-%m-%dT%H:%M:%S.%f'),'+02:00') WHEN 3 THEN strftime(ts,'%Y-%m-%d')
            WHEN 4 THEN strftime(ts,'%Y-%m-%d %H:%M:%S') WHEN 5 THEN strftime(ts,'%Y-%m-%dT%H:%MZ') WHEN 6 THEN strftime(ts,'%Y')
            WHEN 7 THEN strftime(ts,'%Y%m%dT%H%M%S') WHEN 8 THEN '2024-W05-2' WHEN 9 THEN '2024-02-30T00:00:00Z'
            ELSE strftime(ts,'%Y-%m-%dT%H:%M:%S.%fZ') END AS text,
       CASE event_id%10 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts WHEN 3 THEN date_trunc('day',ts)
            WHEN 4 THEN date_trunc('second',ts) WHEN 5 THEN date_trunc('minute',ts) END AS instant
FROM events""",
    "canonical_json": """SELECT event_id, concat('{"a":"',event_type,'","b":{"x":[',user_id,',null],"y":true},"z":0}') AS canonical FROM events""",
    "dedupe_keys": """SELECT arrival, concat(site_id,':',signal_id,':',strftime(ts_source,'%Y-%m-%dT%H:%M:%SZ'),':',seq) AS dedupe_key FROM arrivals""",
    "message_keys": """SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN concat('ev-',o_orderkey)
       WHEN turn=0 AND o_orderkey%3=1 THEN concat('s:level:2024-01-01T00:00:00Z:',o_orderkey) WHEN turn=0 THEN NULL
       WHEN turn=6 THEN concat('cmd-',o_orderkey)
       WHEN o_orderkey%3=1 THEN concat(site_id,':',asset_id,':level:2024-01-01T00:00:00Z')
       ELSE concat(site_id,':',asset_id,':command/ack:t',o_orderkey) END AS message_key,
       CASE WHEN turn=0 AND o_orderkey%3=2 THEN 'telemetry lacks site, signal, source time or sequence' END AS key_error
FROM device_topics WHERE turn IN (0,1,6)""",
    "topic_build": """SELECT asset_id, CASE WHEN asset_key%8<6 THEN concat('site/',site_id,'/area/',area_id,'/asset/',asset_id,'/',
            CASE asset_key%8 WHEN 0 THEN 'telemetry' WHEN 1 THEN 'event' WHEN 2 THEN 'alarm' WHEN 3 THEN 'state'
                 WHEN 4 THEN 'command/request' ELSE 'command/ack' END) END AS topic,
       CASE asset_key%8 WHEN 6 THEN 'channel is not in use: write' WHEN 7 THEN 'site_id is empty or holds a slash' END AS error
FROM asset_registry""",
    "topic_parse": f"""SELECT o_orderkey, CASE WHEN turn IN (0,1,6) THEN site_id END AS site_id, CASE WHEN turn IN (0,1,6) THEN area_id END AS area_id,
       CASE WHEN turn IN (0,1,6) THEN asset_id END AS asset_id,
       CASE turn WHEN 0 THEN 'telemetry' WHEN 1 THEN 'command/ack' WHEN 6 THEN 'command/request' END AS channel,
       CASE turn WHEN 2 THEN 'channel is not in use: write' WHEN 5 THEN 'channel is not in use: command/request/now'
            WHEN 3 THEN concat('text is no device topic: ',{TOPIC}) WHEN 4 THEN concat('text is no device topic: ',{TOPIC}) END AS error,
       CASE turn WHEN 0 THEN 'raw.telemetry' WHEN 1 THEN 'command.ack' WHEN 6 THEN 'command.request' END AS log_topic
FROM device_topics""",
    "topic_filter": "SELECT o_orderkey, turn<>4 AS device, (turn=6 AND site_id='site-asia') AS requests FROM device_topics",
    "route_telemetry": """SELECT ts_source, ts_ingest, event_id, site_id, asset_id, signal_id, seq, quality, unit, value, tags, trace_id
FROM telemetry WHERE reason IS NULL""",
    "route_alarms": "SELECT raised_at, alarm_id, site_id, asset_id, severity, message, state, acknowledged_at, payload FROM alarm_rows",
    "route_events": "SELECT * FROM event_rows",
    "route_asset_state": "SELECT * FROM state_rows",
    "route_command_request": f"SELECT kind, {COMMANDS} FROM request_rows WHERE error IS NULL",
    "route_command_ack": f"SELECT kind, {COMMANDS} FROM ack_rows WHERE error IS NULL",
    "route_model_scores": "SELECT ts_source, model_id, site_id, asset_id, signal_id, score, anomalous, payload FROM score_rows",
    "quarantine": """SELECT 'raw.telemetry' AS topic, part AS "partition", arrival AS "offset", reason, coalesce(envelope_error,value_error) AS error
FROM telemetry WHERE reason IS NOT NULL
UNION ALL SELECT 'raw.events', CAST(event_id%4 AS INTEGER), event_id, 'rejected', 'no full date and time: soon' FROM events WHERE event_id%6=4
UNION ALL SELECT 'asset.state', CAST(event_id%4 AS INTEGER), event_id, 'rejected', 'assetId is missing' FROM events WHERE event_id%6=5
UNION ALL SELECT 'command.request', 0, arrival, 'rejected', error FROM request_rows WHERE error IS NOT NULL
UNION ALL SELECT 'command.ack', 0, arrival, 'rejected', error FROM ack_rows WHERE error IS NOT NULL
UNION ALL SELECT 'analytics.inference', 0, vec_id, 'rejected', 'message carries no score' FROM embeddings WHERE vec_id%6=4
UNION ALL SELECT 'platform.audit', 0, o_orderkey, 'rejected', 'no table takes messages of topic platform.audit' FROM orders""",
    "live_feed": f"""SELECT topic, concat('{{"topic":"',topic,'","receivedAt":"',
       strftime(TIMESTAMP '2024-01-31 00:00:00' + to_seconds(o_orderkey%1000),'%Y-%m-%dT%H:%M:%S'),'.000Z","payload":',
       CASE WHEN o_orderkey%2=0 THEN concat('{{"n":',o_orderkey,'}}') ELSE concat('"say \\"',o_orderkey,'\\""') END,'}}') AS value
FROM (SELECT *, {TOPIC} AS topic FROM device_topics WHERE turn<>4)""",
    "command_policy": """SELECT concat('cmd-',o.o_orderkey) AS command_id,
       concat('site/',r.site_id,'/area/',r.area_id,'/asset/',r.asset_id,'/command/request') AS topic
FROM orders o JOIN asset_registry r ON r.asset_key=o.o_custkey JOIN customer c ON c.c_custkey=o.o_custkey
WHERE c.c_mktsegment='MACHINERY' AND o.o_orderkey%9 NOT IN (0,1,2) AND o.o_orderstatus<>'P'""",
    "overdue_commands": """SELECT concat('cmd-',o_orderkey) AS command_id, o_orderdate AS issued_at,
       CASE WHEN o_orderstatus='F' THEN o_orderdate + INTERVAL '120' SECOND END AS acked_at
FROM orders JOIN asset_registry ON asset_key=o_custkey WHERE o_orderstatus<>'F' OR o_orderkey%2=1""",
    "command_reconciliation": """SELECT concat('cmd-',a.event_id) AS command_id, concat('asset-',a.user_id) AS asset_id, a.ts AS acked_at,
       'completed' AS status, s.ts AS state_at, s.event_type AS final_state
FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type<>'purchase') s ON a.user_id=s.user_id AND a.ts <= s.ts
WHERE a.event_type='purchase'""",
    "fifo_pending": "SELECT row_id, kafka_topic, message_key, payload FROM spool WHERE status='pending' ORDER BY row_id LIMIT 250",
    "backlog_depth": "SELECT site_id, count(*) FILTER (WHERE status='pending') AS depth FROM spool GROUP BY site_id",
    "delivery_log": """SELECT s.row_id, s.kafka_topic, s.message_key, CASE WHEN a.sent_at IS NULL THEN 'pending' ELSE 'sent' END AS status,
       coalesce(a.n,0) AS attempts, coalesce(a.last_error,'') AS last_error, a.sent_at
FROM spool s LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, max(l_shipdate + to_seconds(l_linenumber)) FILTER (WHERE l_returnflag='R') AS sent_at,
         left(max_by(concat('line ',l_linenumber,' part ',l_partkey,': ',repeat('timeout ',60)), 
                   struct_pack(t := l_shipdate + to_seconds(l_linenumber), e := concat('line ',l_linenumber,' part ',l_partkey,': ')))
              FILTER (WHERE l_returnflag<>'R'), 400) AS last_error
  FROM lineitem GROUP BY l_orderkey) a ON a.l_orderkey=s.row_id""",
    "replay_stalled": f"""SELECT site_id, count(*) FILTER (WHERE status='pending') AS depth, max(sent_at) AS last_sent_at FROM spool
GROUP BY site_id HAVING depth > 0 AND coalesce(last_sent_at < {AS_OF} - INTERVAL '15' MINUTE, TRUE)""",
    "backlog_trend": """SELECT *, CAST(backlog - coalesce(lag(backlog) OVER (PARTITION BY site_id ORDER BY slot),0) AS BIGINT) AS change FROM (
  SELECT site_id, slot, CAST(came AS BIGINT) AS came, CAST(went AS BIGINT) AS went,
         CAST(sum(came-went) OVER (PARTITION BY site_id ORDER BY slot) AS BIGINT) AS backlog FROM (
    SELECT site_id, time_bucket(INTERVAL '15 minutes', moment) AS slot, sum(came) AS came, sum(went) AS went FROM (
      SELECT site_id, created_at AS moment, 1 AS came, 0 AS went FROM spool
      UNION ALL SELECT site_id, sent_at, 0, 1 FROM spool WHERE sent_at IS NOT NULL) GROUP BY 1,2))""",
    "sliding_windows": """SELECT site_id, asset_id, ts_source, seq, array_to_string(w, ',') AS "window" FROM (
  SELECT site_id, asset_id, ts_source, seq, list(CAST(round(value*100) AS BIGINT)) OVER (
         PARTITION BY site_id, asset_id ORDER BY ts_source, seq ROWS 31 PRECEDING) AS w FROM measurements) WHERE len(w)=32""",
    "window_mse": """SELECT 'site-x' AS site_id, concat('asset-',label) AS asset_id, concat('vec-',vec_id) AS signal_id,
       'vibration-anomaly' AS model_id, threshold, round(score,6) AS score, score>threshold AS anomalous FROM vector_scores""",
    "published_scores": f"""SELECT {AS_OF} AS ts_source, 'vibration-anomaly' AS model_id, concat('asset-',label) AS asset_id,
       concat('vec-',vec_id) AS signal_id, 'site-x' AS site_id, round(score,6) AS score, score>threshold AS anomalous FROM vector_scores""",
    "stream_features_1m": """SELECT site_id, coalesce(asset_id,'-') AS asset_id, signal_id, b AS window_start, b + INTERVAL '1' MINUTE AS window_end,
       coalesce(round(avg(v),6),-1.0E0) AS avg_value
FROM (SELECT CASE WHEN seq%50=16 THEN '' ELSE site_id END AS site_id, CASE WHEN seq%50<>0 THEN asset_id END AS asset_id, signal_id,
             time_bucket(INTERVAL '1 minute', ts_source) AS b, CASE WHEN seq%50 NOT IN (2,8) THEN value END AS v, ts_source
      FROM telemetry WHERE seq%50 NOT IN (4,14,15))
WHERE b + INTERVAL '1' MINUTE <= (SELECT max(ts_source) FROM telemetry WHERE seq%50 NOT IN (4,14,15)) - INTERVAL '10' MINUTE
GROUP BY 1,2,3,4""",
    "stream_ingest": """SELECT ts_source, asset_id, signal_id, seq, min_by(event_id,arrival) AS event_id, min_by(site_id,arrival) AS site_id,
       max_by(ts_ingest,arrival) AS ts_ingest, max_by(quality,arrival) AS quality, max_by(unit,arrival) AS unit,
       max_by(value,arrival) AS value, max_by(tags,arrival) AS tags, max_by(trace_id,arrival) AS trace_id
FROM telemetry WHERE reason IS NULL GROUP BY 1,2,3,4""",
    "live_latest_telemetry": """SELECT asset_id, ts_source, signal_id, value, quality, unit, tags FROM (
  SELECT DISTINCT ON (asset_id) * FROM arrivals ORDER BY asset_id, ts_source DESC, arrival DESC)
WHERE ts_source BETWEEN TIMESTAMP '2024-01-30 11:58:00' AND TIMESTAMP '2024-01-30 23:58:00'""",
    "live_open_alarms": """SELECT DISTINCT ON (site_id) site_id, a.ts_source AS raised_at, concat('alm-',a.seq) AS alarm_id, a.asset_id,
       CASE WHEN a.value > 2*t.limit_value THEN 'critical' ELSE 'high' END AS severity, concat(a.signal_id,' threshold exceeded') AS message
FROM arrivals a JOIN thresholds t ON a.signal_id=t.signal_id AND a.value > t.limit_value
WHERE a.seq%3<>0 ORDER BY site_id, a.ts_source DESC, a.arrival DESC""",
    "live_command_status": "SELECT * FROM command_log",
    "stream_replay": """SELECT row_id, kafka_topic AS topic, message_key AS key, payload AS value FROM spool WHERE status='pending'""",
}


def _with_views(sql: str) -> str:
    """The query after the views it needs, in their order."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and f" {name}" in text.replace("\n", " ").replace("(", " "):
                needed.add(name)
                need(body)

    need(sql)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH {views}\n{sql}" if views else sql


_WINDOWS = """(SELECT site_id, asset_id, w FROM (SELECT site_id, asset_id, list(value) OVER (
    PARTITION BY site_id, asset_id ORDER BY ts_source, seq ROWS 31 PRECEDING) AS w FROM measurements) WHERE len(w)=32)"""
QUERIES["pca_scores"] = f"SELECT site_id, asset_id, count(*) AS windows, TRUE AS error_is_residual, TRUE AS orthonormal FROM {_WINDOWS} GROUP BY 1, 2"
QUERIES["window_moments"] = f"""SELECT CAST(k - 1 AS INTEGER) AS position, count(x) AS windows, round(avg(x),4) AS mean, round(var_pop(x),4) AS variance
FROM (SELECT unnest(w) AS x, unnest(range(1,33)) AS k FROM {_WINDOWS}) GROUP BY k"""

QUERIES["stream_live_feed"] = QUERIES["live_feed"]
QUERIES["forwarded"] = f"""SELECT o_orderkey, CASE WHEN error IS NULL THEN CASE turn WHEN 0 THEN 'raw.telemetry' WHEN 1 THEN 'command.ack'
       ELSE 'command.request' END END AS log_topic, CASE WHEN error IS NULL THEN message_key END AS message_key, error
FROM (SELECT o_orderkey, turn, message_key, CASE WHEN turn IN (3,4) THEN concat('text is no device topic: ',topic)
             WHEN turn=2 THEN 'channel is not in use: write' WHEN turn=5 THEN 'channel is not in use: command/request/now'
             WHEN o_orderkey%11=0 THEN 'payload is not valid JSON' ELSE key_error END AS error
      FROM (SELECT *, {TOPIC} AS topic FROM device_topics) LEFT JOIN ({QUERIES["message_keys"]}) USING (o_orderkey))"""

# Tables of the ingest, and the query that states the rows of each.
_STORED = {
    "measurements": QUERIES["stream_ingest"], "alarms": QUERIES["upsert_alarms"], "events": QUERIES["upsert_events"],
    "asset_state": QUERIES["upsert_asset_state"], "command_log": QUERIES["command_log_from_messages"], "model_scores": QUERIES["upsert_model_scores"],
}
_MEASURED = QUERIES["stream_ingest"]
QUERIES["stream_ingest"] = "\nUNION ALL BY NAME\n".join(f"SELECT '{name}' AS target, CAST(COLUMNS(*) AS VARCHAR) FROM ({sql})" for name, sql in _STORED.items())
QUERIES["stream_rollups"] = "\nUNION ALL\n".join(f"SELECT *, '{name}' AS rollup FROM ({_rollup(width, f'({_MEASURED})')})" for name, width in (("1m", "1 minute"), ("15m", "15 minutes"), ("1h", "1 hour")))
QUERIES["feature_fields"] = """SELECT event_id, CASE WHEN seq%50=16 THEN '' ELSE site_id END AS site_id, CASE WHEN seq%50<>0 THEN asset_id END AS asset_id, signal_id,
       CASE WHEN seq%50=1 THEN 'great' ELSE quality END AS quality, CASE WHEN seq%50<>15 THEN ts_source END AS ts_source, ts_ingest,
       CASE WHEN seq%50=3 THEN -1 ELSE seq END AS seq, unit, CASE WHEN seq%50 NOT IN (2,8) THEN round(value,6) END AS value,
       CASE WHEN seq%50=9 THEN 'null' ELSE tags END AS tags, trace_id
FROM telemetry WHERE seq%50 NOT IN (4,14)"""
_USABLE = "telemetry WHERE seq%50 NOT IN (4,14,15)"
QUERIES["stream_unique"] = f"SELECT event_id, signal_id, ts_source FROM {_USABLE}"
_PARTS = "[TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-24']"
QUERIES["delivery_counters"] = f"""SELECT min(ts_source) AS since, max(ts_source) AS until, count(*) AS seen,
       count(*) FILTER (WHERE copy=0) AS "unique", count(*) FILTER (WHERE copy>0) AS repeated, CAST(0 AS BIGINT) AS late
FROM (SELECT ts_source, copy, len(list_filter({_PARTS}, lambda e: e <= moment)) AS part FROM (
  SELECT ts_source, ts_ingest AS moment, 0 AS copy FROM {_USABLE}
  UNION ALL SELECT ts_source, ts_ingest, 1 FROM {_USABLE} AND seq%7=0
  UNION ALL SELECT ts_source, ts_ingest + INTERVAL '12' HOUR, 2 FROM {_USABLE} AND seq%11=0
            AND len(list_filter({_PARTS}, lambda e: ts_ingest >= e - INTERVAL '12' HOUR AND ts_ingest < e)) > 0))
GROUP BY part"""
QUERIES["stream_overdue_commands"] = f"SELECT command_id, issued_at FROM ({QUERIES['overdue_commands']})"
QUERIES["keyed_replay"] = """SELECT kafka_topic AS topic, concat('asset-',row_id%50) AS key,
       row_number() OVER (PARTITION BY kafka_topic, row_id%50 ORDER BY row_id) - 1 AS number, row_id, payload AS value
FROM spool WHERE status='pending'"""
_LINES = """(SELECT vec_id, concat('asset-',label) AS asset_id, concat('vec-',vec_id) AS signal_id, CASE WHEN vec_id%3=0 THEN 0.01E0 ELSE 0.15E0 END AS threshold,
       list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)*CAST(x AS DOUBLE)))/len(embedding[1:32]) AS score FROM embeddings)"""
QUERIES["scored_lines"] = f"""SELECT asset_id, signal_id, 'zero-model' AS model_id, threshold, round(score,6) AS score, score>threshold AS anomalous
FROM {_LINES} WHERE vec_id%7<>0 AND vec_id%9<>0"""
QUERIES["scoring_manifest"] = f"""SELECT vec_id%4 AS batch, 'zero-model' AS model_id, 'v1' AS version, count(*) FILTER (WHERE vec_id%7<>0 AND vec_id%9<>0) AS scored,
       count(*) FILTER (WHERE vec_id%7=0 OR vec_id%9=0) AS rejected, count(*) FILTER (WHERE vec_id%7<>0 AND vec_id%9<>0 AND score>threshold) AS anomalous
FROM {_LINES} GROUP BY 1"""

ORACLES = {name: _with_views(sql) for name, sql in QUERIES.items()}
