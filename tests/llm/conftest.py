from __future__ import annotations

import pandas as pd
import pytest
from cases import SMALL, edge_rows, frame


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """(doc_id, text, lang, source): the smallest documents table and the hard cases."""
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    return [*table[["doc_id", "text", "lang", "source"]].itertuples(index=False, name=None), *edge_rows()]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    frame(spark, rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
