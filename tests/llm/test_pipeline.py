"""The pipeline's stages against brute force, and the registered queries against their SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import brute
import corpus_pipeline
from cases import CLASHING, SMALL
from test_operators import items, multiset

sys.path.append(str(Path(__file__).parent.parent))
from compare import differences, oracle_frame  # noqa: E402


@pytest.mark.parametrize("name", ["op1_decontaminate", "op4_url_filter", "op5_near_dedup", "op9_exact_dedup"])
def test_query_and_sql(spark, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert differences(got, oracle_frame(entry.oracle_sql()[name], SMALL)) is None


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit()]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{k}" for k in range(1, 14)] and "pipeline" in entry.queries()


def test_native_operators_run_no_python(spark):
    for name in ("op4_url_filter", "op7_personal_data"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_language_stage_rejects_by_code_length(spark):
    import random

    rng = random.Random(2)
    prose = ["der", "fluss", "und", "die", "alte", "stadt", "liegen", "im", "tal", "viele", "boote", "fahren", "dort"]
    rows = [(k, " ".join(rng.choices(prose, k=40)), "de") for k in range(300)]
    junk = [(1000 + k, "".join(rng.choices("qxzjvwyk#~|0123456789", k=200)), None) for k in range(5)]
    clean = [(2000 + k, " ".join(rng.choices(prose, k=40)), None) for k in range(20)] + [(3000, "tal", None)]
    docs = spark.createDataFrame(rows + junk + clean, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows + clean}


def test_language_stage_sends_texts_once(spark, monkeypatch):
    """Columns of any name and order come through, and no column but the text holds it."""
    kept, saved = {}, corpus_pipeline.saved

    def keep(df, purpose):
        kept[purpose] = saved(df, purpose)
        return kept[purpose]

    monkeypatch.setattr(corpus_pipeline, "saved", keep)
    names = ["doc", "there", "c0", "score", "lang_pred", "a.b"]
    rows = [("Der Fluss im Tal", k, *"pqrstu", "de") for k in range(20)] + [("die Boote", None, *[None] * 6, None)]
    docs = spark.createDataFrame(rows, "text string, doc_id bigint, " + ", ".join(f"`{n}` string" for n in names) + ", lang string")
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns and multiset(tuple(r) for r in got.collect()) == multiset(rows)
    assert "text" not in kept["recognised"].select("doc.*").columns
    assert not any("Fluss" in str(r.doc) for r in kept["recognised"].collect())


def test_exact_stage_keeps_columns_of_any_name(spark):
    names = ["_key", "_place", "key", "place", "doc"]
    rows = [(1, "A b", *"pqrst"), (2, "a b", *"uvwxy"), (2, "a b", *"uvwxy")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    got = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [rows[1]]


def test_stages(spark, docs, rows, tmp_path):
    benchmark = spark.createDataFrame(items(), "item_id bigint, text string")
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    pick = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]

    found = stage["language"](spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert multiset(pick(found)) == multiset(want)

    unique = stage["exact_dedup"](spark, docs, str(tmp_path))
    assert unique.columns == docs.columns
    best = {}
    for r in rows:
        t = (r[1] or "").translate(brute.LOWER)
        best[t] = r if t not in best or best[t][0] is None or (r[0] is not None and r[0] > best[t][0]) else best[t]
    assert multiset(pick(unique)) == multiset(best.values())

    unique.write.parquet(str(tmp_path / "unique"))
    unique = spark.read.parquet(str(tmp_path / "unique"))
    left = list(best.values())
    near = stage["near_dedup"](spark, unique, str(tmp_path))
    groups = brute.near_groups(left, 80)
    want = [r for r, g in zip(left, groups, strict=True) if g[0] == g[2]]
    assert near.columns == docs.columns and multiset(pick(near)) == multiset(want)

    clean = stage["decontaminate"](spark, unique, str(tmp_path))
    marked = brute.contaminated(left, items())
    assert multiset(pick(clean)) == multiset(r for r, m in zip(left, marked, strict=True) if not m[4])

    mixed = stage["mix"](spark, unique, str(tmp_path))
    assert mixed.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and mixed.count() == len(left)
    assert set(CLASHING) <= set(near.columns)
