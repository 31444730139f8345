"""Positions, top-n, pages and windows on skewed keys, against brute force."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import anomaly, commands, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """600 samples, a third of them of one key, unevenly spread over time."""
    start = datetime(2024, 1, 1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", start + timedelta(seconds=i * i % 90_000), i, float(i * 7919 % 101)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "k string, ts_source timestamp, seq bigint, value double")


def by_key(rows):
    out = {}
    for k, t, n, v in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(k, []).append((n, v))
    return out


def test_position(skewed):
    rows, df = skewed
    placed = ordering.with_position(df, ["k"], F.date_trunc("hour", "ts_source"), [F.col("ts_source"), F.col("seq")])
    got = {(r.k, r.position): r.seq for r in placed.collect()}
    assert got == {(k, i): n for k, xs in by_key(rows).items() for i, (n, _) in enumerate(xs)}


def test_top_n(skewed):
    rows, df = skewed
    best = ordering.top_n(df, ["k"], [F.desc("ts_source"), F.desc("seq")], 5, F.col("seq"), salts=4)
    got = {(r.k, r["rank"]): r.seq for r in best.collect()}
    assert got == {(k, i + 1): n for k, xs in by_key(rows).items() for i, (n, _) in enumerate(xs[::-1][:5])}


def test_pages(skewed):
    rows, df = skewed
    pages = ordering.nest_pages(df, ["k"], ["ts_source", "seq"], ["seq"], "items", page_size=16)
    got = {}
    for r in pages.orderBy("k", "page").collect():
        assert len(r["items"]) <= 16
        got.setdefault(r.k, []).extend(x.seq for x in r["items"])
    assert got == {k: [n for n, _ in xs] for k, xs in by_key(rows).items()}


@pytest.mark.parametrize("length,block", [(1, 8), (8, 8), (8, 11), (32, 64)])
def test_sliding_windows(skewed, length, block):
    rows, df = skewed
    got = {(r.k, r.seq): r.window for r in anomaly.sliding_windows(df, ["k"], length=length, block=block).collect()}
    wanted = {
        (k, xs[i][0]): [v for _, v in xs[i - length + 1 : i + 1]]
        for k, xs in by_key(rows).items() for i in range(length - 1, len(xs))
    }
    assert got == wanted


def test_reconstruction_is_the_principal_subspace(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 12)) + rng.normal(scale=0.05, size=(300, 12)) + 4.0
    df = spark.createDataFrame([(i, "s", "a", "g", [float(v) for v in row]) for i, row in enumerate(x)], "n int, site_id string, asset_id string, signal_id string, window array<double>")
    fitted = anomaly.fit(df, k=3)
    got = [r.score for r in anomaly.score(df, fitted.reconstruct(F.col("window"))).orderBy("n").collect()]
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    wanted = ((centred - centred @ vt[:3].T @ vt[:3]) ** 2).mean(axis=1)
    assert np.allclose(got, wanted, atol=1e-9)


def test_scores_take_defaults_and_own_thresholds(spark):
    df = spark.createDataFrame([([0.0, 0.0], None, "x"), ([0.0, 0.0], 0.9, None)], "window array<double>, threshold double, model_id string")
    rows = anomaly.score(df, F.array(F.lit(1.0), F.lit(0.0))).collect()
    assert [(r.score, r.threshold, r.anomalous, r.model_id) for r in rows] == [(0.5, 0.15, True, "x"), (0.5, 0.9, False, "vibration-anomaly")]


def test_manifest_passes_the_model_contract(spark):
    from plantpulse.operators.contracts import validate

    row = validate(anomaly.manifest(spark, "m", "1", "c", "site-a", datetime(2024, 1, 1)), "model").first()
    assert row.error is None and row.approval_state == "draft"


def test_reconcile_looks_over_day_borders(spark):
    acks = spark.createDataFrame([("a", "c1", datetime(2024, 1, 1, 23), "done"), ("b", "c2", datetime(2024, 1, 1), "done")], "asset_id string, command_id string, acked_at timestamp, status string")
    states = spark.createDataFrame(
        [("a", datetime(2024, 1, 1, 22), "old"), ("a", datetime(2024, 1, 5), "new"), ("a", datetime(2024, 1, 6), "newer"), ("b", datetime(2024, 1, 1), "same")],
        "asset_id string, ts_source timestamp, state string",
    )
    got = {r.command_id: r.final_state for r in commands.reconcile(acks, states).collect()}
    assert got == {"c1": "new", "c2": "same"}


def test_score_windows_from_json_lines(spark, tmp_path):
    from plantpulse.sources.files import read_windows, rejected_windows, write_messages

    path = tmp_path / "w.json"
    path.write_text('{"window": [1, 2.5], "assetId": "a", "signalId": "s", "threshold": "0.2"}\n\nbroken\n{"window": [1]}\n')
    df = read_windows(spark, str(path))
    assert [(r.window, r.asset_id, r.threshold, r.model_id) for r in df.collect()] == [([1.0, 2.5], "a", 0.2, None)]
    bad = {r.raw: r.error for r in rejected_windows(spark, str(path)).collect()}
    assert bad == {"": "line is not JSON", "broken": "line is not JSON", '{"window": [1]}': "line lacks a usable asset_id"}
    write_messages(df.select(F.to_json(F.struct("asset_id")).alias("value")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"asset_id":"a"}'
