"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from . import (
    decontaminate, exact_dedup, language_id, lm_score, merkle, mixing, near_dedup, pii, quality, spelling, substring_dedup, token_counts, url_filter,
)
from .scratch import saved


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.copies(_table(spark, folder, "documents")).drop("n_chunks")


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(*mixing.mix(_table(spark, folder, "documents"))).drop("source")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    listed = F.concat_ws(",", "items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), "contaminated",
    )


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = lm_score.train_and_score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), token_counts.Vocabulary.load())


def list_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Dated list entries: events name hosts of ``pages`` in turn; errors list a host, purchases take it off again, views
    list a host with a first path segment, clicks take that off."""
    pages, events = _table(spark, folder, "pages"), _table(spark, folder, "events")
    names = pages.select(url_filter.host(F.col("url")).alias("host")).filter("host <> ''").distinct()
    names = saved(numbered(names, [], ["host"], "place"), "hosts")
    number = names.count()
    kinds = {"error": ("", True), "purchase": ("", False), "view": ("/en", True), "click": ("/en", False)}
    suffix = F.create_map(*[F.lit(x) for kind, (path, _) in kinds.items() for x in (kind, path)])
    listed = F.create_map(*[F.lit(x) for kind, (_, on) in kinds.items() for x in (kind, on)])
    events = events.filter(F.col("event_type").isin(*kinds)).withColumn("place", F.col("user_id") % max(number, 1))
    return events.join(names, "place").select(
        F.concat("host", suffix[F.col("event_type")]).alias("key"), F.col("ts").alias("at"), listed[F.col("event_type")].alias("listed")
    )


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    fetched = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("page_id") * 7919 % 43200).cast("int"))
    captures = _table(spark, folder, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    return url_filter.judged(captures, list_changes(spark, folder))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), percent=85)


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[pii.counted("base", kind).alias(f"n_{kind}") for kind, _, _ in pii.PATTERNS],
        F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"),
    )


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    scored = language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, folder, "documents")).drop("kept")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    tampered = [F.col("n_chars").cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proved = merkle.manifest(docs, carry={"tampered": F.when(hit, merkle.leaf(tampered))})
    proved = proved.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return quality.quality(docs, labels, ~held_out, carry={"held_out": held_out})


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, folder, "documents")))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_score": op2_lm_score,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_near_dedup": op5_near_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_language": op8_language,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality": op12_quality,
    "op13_spelling_variants": op13_spelling_variants,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_HOST = "regexp_replace(split_part(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '@', -1), ':[0-9]*$', '')"


def _crc32(codes: str) -> str:
    """Unsigned CRC-32 of an expression that gives a list of byte values, worked out bit by bit."""
    bit = "lambda v, _: xor(v >> 1, (v & 1) * 3988292384)"
    rounds = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {rounds}), 4294967295)"


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(n_chars: str = "n_chars") -> str:
    return f"sha256({' || '.join(_field(n_chars if c == 'n_chars' else c) for c in merkle.FIELDS)})"


_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH docs AS (SELECT doc_id, {_TERMS} AS w FROM documents),
        items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_TERMS} AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g
            FROM items),
        placed AS (
            SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: {{'k': k, 'g': array_to_string(w[k:k + n - 1], ' ')}})) AS x
            FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
        hits AS (SELECT doc_id, x.k AS k, p.n, item_id FROM placed p JOIN windows g ON p.n = g.n AND p.x.g = g.g),
        covered AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id""",
    "op5_near_dedup": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s
            FROM docs),
        elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
        roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id,
               least(doc_id, coalesce(root, doc_id)) = doc_id AS kept
        FROM sets LEFT JOIN roots ON doc_id = node""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, {_leaf()} AS leaf,
                   CASE WHEN {_crc32("list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))")} % 7 = 0
                        THEN {_leaf("n_chars + 1")} ELSE {_leaf()} END AS start
            FROM documents),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
            FROM leaves),
        nodes AS (
            SELECT 0 AS level, lang, idx, n, leaf AS h FROM placed
            UNION ALL
            SELECT level + 1, lang, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
            FROM nodes WHERE n > 1 GROUP BY level, lang, idx // 2, n),
        subroots AS (
            SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
            FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS level, idx, n, subroot AS h FROM subroots
            UNION ALL
            SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
            FROM tops WHERE n > 1 GROUP BY level, idx // 2, n),
        folds AS (
            SELECT p.doc_id, p.leaf, p.lang, p.idx, s.idx AS top, s.height, s.subroot, 0 AS step, p.start AS h, '' AS proof
            FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
            UNION ALL
            SELECT f.doc_id, f.leaf, f.lang, f.idx // 2, f.top, f.height, f.subroot, f.step + 1,
                   sha256(CASE WHEN f.idx % 2 = 0 THEN f.h || coalesce(o.h, '') ELSE o.h || f.h END), f.proof || coalesce(o.h, '')
            FROM folds f LEFT JOIN nodes o ON o.level = f.step AND o.lang IS NOT DISTINCT FROM f.lang AND o.idx = xor(f.idx, 1)
            WHERE f.step < f.height),
        ends AS (
            SELECT doc_id, leaf, subroot, top AS idx, 0 AS step, h, proof FROM folds WHERE step = height
            UNION ALL
            SELECT e.doc_id, e.leaf, e.subroot, e.idx // 2, e.step + 1,
                   sha256(CASE WHEN e.idx % 2 = 0 THEN e.h || coalesce(o.h, '') ELSE o.h || e.h END), e.proof || coalesce(o.h, '')
            FROM ends e LEFT JOIN tops o ON o.level = e.step AND o.idx = xor(e.idx, 1)
            WHERE e.step < (SELECT max(level) FROM tops))
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM ends, (SELECT h AS root FROM tops WHERE n = 1) WHERE step = (SELECT max(level) FROM tops)""",
    "op13_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
            FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
        spelt AS (
            SELECT doc_id, run, k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named FROM counted),
        hashed AS (
            SELECT run, k, {_crc32("""flatten(list_transform(range(1, length(named) + 1), lambda i: CASE WHEN unicode(named[i]) < 128
                   THEN [CAST(unicode(named[i]) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(named[i]) - 64] END))""")} AS h
            FROM spelt),
        words AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
            FROM hashed GROUP BY word HAVING length(word) >= 6 AND sum(k) >= 5),
        gaps AS (
            SELECT word, n, gap, left(word, gap - 1) || substr(word, gap + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS gap FROM words)),
        near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.gap = b.gap AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
        best AS (
            SELECT word, count(*) AS n_near, arg_max(other, other_n) FILTER (WHERE place = 1) AS other, max(other_n) AS other_n
            FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near) GROUP BY word),
        judged AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
                   CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word),
        chains AS (
            SELECT word, word AS here, form AS next FROM judged
            UNION ALL SELECT c.word, c.next, j.form FROM chains c JOIN judged j ON c.next = j.word)
        SELECT j.word, j.form, c.here AS root, j.n, j.n_near, j.form_n FROM judged j JOIN chains c ON j.word = c.word WHERE c.next IS NULL""",
    "op4_url_filter": f"""
        WITH captures AS (
            SELECT page_id, url, {_HOST} AS host,
                   regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment,
                   TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 7919 % 43200 AS INTEGER)) AS fetched_at
            FROM pages),
        names AS (
            SELECT host, row_number() OVER (ORDER BY host) - 1 AS place
            FROM (SELECT DISTINCT host FROM captures WHERE host <> '')),
        changes AS (
            SELECT host || CASE WHEN event_type IN ('view', 'click') THEN '/en' ELSE '' END AS key, CAST(ts AS TIMESTAMP) AS since,
                   bool_or(event_type IN ('error', 'view')) AS listed
            FROM events JOIN names ON user_id % (SELECT count(*) FROM names) = place
            WHERE event_type IN ('error', 'purchase', 'view', 'click')
            GROUP BY ALL),
        spans AS (
            SELECT key, since, until FROM (
                SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM changes)
            WHERE listed),
        parts AS (SELECT *, string_split(host, '.') AS labels FROM captures WHERE host <> ''),
        keys AS (
            SELECT page_id, fetched_at, host AS key FROM parts
            UNION SELECT page_id, fetched_at, array_to_string(labels[k:], '.')
                  FROM (SELECT *, unnest(range(2, len(labels))) AS k FROM parts)
            UNION SELECT page_id, fetched_at, host || '/' || segment FROM parts WHERE segment <> ''),
        hits AS (
            SELECT page_id, k.key, s.since, row_number() OVER (PARTITION BY page_id ORDER BY length(k.key) DESC, k.key DESC) AS place
            FROM keys k JOIN spans s ON k.key = s.key AND fetched_at >= since AND (until IS NULL OR fetched_at < until))
        SELECT c.page_id, url, fetched_at, key IS NOT NULL AS blocked, key AS matched_key, since AS listed_since
        FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND place = 1""",
    "op9_exact_dedup": f"""
        WITH lowered AS (SELECT doc_id, {_LOWER} AS t FROM documents),
        ranked AS (
            SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place
            FROM lowered)
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256,
               CAST(strlen(t) AS BIGINT) AS n_bytes
        FROM ranked""",
}
