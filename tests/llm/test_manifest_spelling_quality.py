"""Merkle manifest, spelling variants and quality scores against brute force and definitions."""

from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from cases import SMALL, frame
from compare import differences, oracle_frame
from plantpulse.llm import merkle, quality, spelling
from plantpulse.llm.queries import ORACLES, QUERIES

sys.path.append(str(Path(__file__).parent))


def multiset(rows):
    return Counter(map(repr, rows))


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_spelling_variants"])
def test_query_against_sql(spark, name):
    got, wanted = QUERIES[name](spark, SMALL).toPandas(), oracle_frame(ORACLES[name], SMALL)
    if "form_n" in got:
        got["form_n"] = got["form_n"].astype("Int64")
    assert len(got) > 0 and differences(got, wanted) is None


# --- manifest --------------------------------------------------------------------------


@pytest.mark.parametrize(("fanout", "n"), [(2, 1), (2, 2), (2, 17), (2, 300), (3, 28), (4, 65), (20, 21)])
def test_manifest(spark, fanout, n):
    rng = random.Random(n)
    langs = ["hot"] * 7 + [None, "", "a", "é", "Z"]
    rows = [{"doc_id": rng.choice([None, k, k, k, 3]), "lang": rng.choice(langs[: 1 + n]), "text": rng.choice([None, "", f"é{k}"]), "hash": "x", "tree": None, "idx": 7} for k in range(n)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id bigint, lang string, text string, hash string, tree string, idx int")
    found = merkle.manifest(docs, fields=("doc_id", "lang", "text"), fanout=fanout, carry={"path2": F.col("idx")})
    checked = found.withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("other", merkle.folded(F.lit("x"), F.col("path")))
    got = checked.withColumn("siblings", merkle.siblings(F.col("path"))).collect()
    assert multiset((r.doc_id, r.leaf, r.subroot, r.root, r.siblings) for r in got) == multiset(brute.merkle(rows, fanout, ("doc_id", "lang", "text")))
    assert all(r.again == r.root and r.other != r.root and r.path2 == 7 for r in got)


def test_manifest_of_hard_rows(docs, rows, empty):
    named = [dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in rows]
    fields = ("doc_id", "source", "lang", "text")
    got = merkle.manifest(docs, fields=fields).select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("s")).collect()
    assert multiset(map(tuple, got)) == multiset(brute.merkle(named, 2, fields))
    assert merkle.manifest(empty, fields=fields).count() == 0
    with pytest.raises(ValueError, match="fanout"):
        merkle.manifest(docs, fields=fields, fanout=1)


def test_one_changed_value_breaks_its_own_proof_only(spark):
    got = QUERIES["op11_merkle_manifest"](spark, SMALL).collect()
    hit = {r.doc_id for r in got if not r.verified}
    assert hit and hit == {r.doc_id for r in got if brute.zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert len({r.root for r in got}) == 1


# --- spelling --------------------------------------------------------------------------


def test_word_counts(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 50)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == brute.word_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs, slips=3).collect()} == brute.word_counts(rows, 3)
    assert spelling.variants(spelling.word_counts(empty)).count() == 0


@pytest.mark.parametrize("small", [spelling.SMALL, 1])
def test_variants_of_the_documents(docs, rows, small, monkeypatch):
    monkeypatch.setattr(spelling, "SMALL", small)
    got = spelling.variants(spelling.word_counts(docs, slips=11)).collect()
    want = brute.variants(brute.word_counts(rows, 11))
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want)
    assert any(r.form for r in got)


def test_variants_of_words_that_share_halves(spark):
    """Few letters and two common halves: crowded chunks at every step, long words, umlauts, chains of forms."""
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(900)}
    words |= {"common" + "".join(rng.choices("xyzß", k=rng.randint(4, 6))) for _ in range(500)} | {"ä" * 300, "ä" * 301, "ä" * 299 + "b"}
    words |= {"chain" + "k" * k for k in range(2, 8)}
    count = {w: rng.choice([5, 9, 40, 900]) for w in words} | {"chain" + "k" * k: 5 ** k for k in range(2, 8)}
    table = spark.createDataFrame(list(count.items()), "word string, n bigint")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(table).collect()}
    assert got == brute.variants(count)
    assert got["chainkk"][4] == "chain" + "k" * 7


def test_a_crowded_half_is_not_paired_out(spark):
    """4,000 words on one half: what is compared stays near the number of words, not their square."""
    table = spark.range(4_000).select(F.concat(F.lit("prefixprefix"), F.translate(F.format_string("%04d0707", F.col("id") * 7919 % 10_000), "0123456789", "abcdefghij")).alias("word"), F.lit(9).cast("bigint").alias("n"))
    rows = table.withColumn("shift", F.lit(0)).withColumn("low", F.lit(0)).withColumn("high", F.char_length("word"))
    compared = 0
    while not rows.isEmpty():
        met = spelling._meeting(spelling._opened(rows)).cache()
        groups = met.filter("not crowded").groupBy("chunk").count()
        compared += groups.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        rows = met.filter("crowded").drop("chunk", "crowded")
    assert 0 < compared < 4_000 * 64


# --- quality ---------------------------------------------------------------------------


def test_statistics_by_definition():
    texts = ["", "One two two.\n\nTHREE #x 12 é\nOne two two.", "a", "\n", "  x  "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = pd.DataFrame(quality.statistics(data, offsets), columns=quality.STATISTICS)
    assert np.isfinite(got.to_numpy()).all() and (got.iloc[0] == 0).all()
    row = got.iloc[1]
    assert row.log_words == pytest.approx(np.log1p(10)) and row.distinct_words == pytest.approx(0.7) and row.top_word == pytest.approx(0.2)
    assert row.same_as_before == 0 and row.upper_words == pytest.approx(0.1) and row.capital_words == pytest.approx(0.3)
    assert row.no_letter_words == pytest.approx(0.1) and row.distinct_lines == pytest.approx(2 / 3) and row.words_per_line == pytest.approx(np.log1p(10 / 3))
    assert row.share_beyond == pytest.approx(2 / len(texts[1].encode()))
    alone = quality.statistics(data[offsets[1] : offsets[2]], np.array([0, offsets[2] - offsets[1]]))
    assert (alone[0] == got.iloc[1].to_numpy()).all()


def test_pooling_is_the_isotonic_fit():
    rng = np.random.default_rng(4)
    share, weight = rng.random(60), rng.integers(1, 9, 60).astype(float)
    x, y = quality.pooled(np.arange(60.0), share, weight)
    # The isotonic fit at k is max over starts of min over ends of the weighted means.
    mean = lambda a, b: np.average(share[a:b], weights=weight[a:b])
    want = [max(min(mean(a, b) for b in range(k + 1, 61)) for a in range(k + 1)) for k in range(60)]
    assert np.unique(np.round(want, 9)).tolist() == np.round(y, 9).tolist() and (np.diff(x) > 0).all()


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(5)
    size = len(quality.STATISTICS)
    x = rng.normal(size=(40, size)) * 0.7
    projection = rng.normal(size=(size, 4096)) / (quality.WIDTH * np.sqrt(size))
    model = quality.Model(np.zeros(size), np.ones(size), projection, rng.uniform(0, 2 * np.pi, 4096), np.zeros(0), (np.zeros(0),) * 2)
    z = quality.fourier(model, x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * quality.WIDTH**2 * size))).max() < 0.1


def test_equations_and_left_out_values(spark):
    rng = np.random.default_rng(6)
    size = len(quality.STATISTICS)
    x, y = rng.normal(size=(90, size)).astype(np.float32), rng.integers(0, 2, 90).astype(float)
    table = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "doc_id int, statistics array<float>").repartition(5)
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)] + [(None, 1), (3, None)], "doc_id int, quality int")
    model = quality.fit(table, labels, features=12)
    z = quality.fourier(model, x.astype(float))
    penalty = np.diag([quality.RIDGE * 90] * 12 + [quality.RIDGE])
    assert model.mean == pytest.approx(x.mean(axis=0), abs=1e-5) and model.deviation == pytest.approx(x.std(axis=0), rel=1e-4)
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + penalty, z.T @ y), rel=1e-4, abs=1e-6)
    value = [z[k] @ np.linalg.solve(np.delete(z, k, 0).T @ np.delete(z, k, 0) + penalty, np.delete(z, k, 0).T @ np.delete(y, k)) for k in range(90)]
    low, high = model.curve[0][[0, -1]]
    assert min(value) - 1e-3 <= low and high <= max(value) + 1e-3
    assert (np.diff(model.curve[0]) > 0).all() and (np.diff(model.curve[1]) > 0).all()


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op12_quality"](spark, folder).toPandas()
    table = pd.read_parquet(f"{folder}/documents.parquet")
    assert sorted(got.doc_id) == sorted(table.doc_id) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    assert got.held_out.tolist() == [brute.zlib.crc32(str(x).encode()) % 3 == 1 for x in got.doc_id]
    judged = got[got.held_out].merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    assert len(judged) > 100 and (judged.predicted == judged.quality).mean() >= 0.97


def test_quality_of_hard_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], k % 2, "x") for k, r in enumerate(rows)] + [(None, None, "y")], "doc_id bigint, quality int, text string")
    got = quality.quality(docs, labels, F.lit(True)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id == 900_010}
    assert len(same) == 1
    for none in (labels.limit(0), labels.filter("quality is null")):
        assert {r.score for r in quality.quality(docs, none, F.lit(True)).collect()} == {0.5}
    ones = quality.quality(docs, labels.withColumn("quality", F.lit(1)), F.lit(True))
    assert ones.filter("score < 0.999").count() == 0
    assert quality.quality(empty, labels, F.lit(True)).count() == 0


def test_encoding():
    assert hashlib.sha256(b"2:10-").hexdigest() == brute.merkle([{"doc_id": 10, "lang": None}], 2, ("doc_id", "lang"))[0][1]


def test_extra_columns_do_not_matter(spark, rows):
    few = rows[:40]
    labels = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(few)], "doc_id bigint, quality int")
    plain = spark.createDataFrame(few, "doc_id bigint, text string, lang string, source string")
    wide = frame(spark, few)
    for make in (lambda d: quality.quality(d, labels, F.lit(True)).select("doc_id", F.round("score", 6)), lambda d: merkle.manifest(d, fields=("doc_id", "text")).drop("path"), spelling.word_counts):
        assert multiset(map(tuple, make(plain).collect())) == multiset(map(tuple, make(wide).collect()))
