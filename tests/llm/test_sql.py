"""Registered queries of this subpackage against their SQL, and their columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import same  # noqa: E402
from test_pipeline import keys  # noqa: E402

from tessera.llm import queries  # noqa: E402

COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op7_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert COLUMNS[name] <= set(found.columns) and found.count() > 0


def test_secret_scans_of_private_keys(spark, tmp_path):
    """The given tables hold no whole key, so the query and its SQL meet on planted ones."""
    import shutil

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "data")
    os.chmod(tmp_path / "data", 0o755)
    os.remove(tmp_path / "data/documents.parquet")
    texts = [t for t, _ in keys()] + [f"a {t} b\n{t}" for t, _ in keys() if len(t) < 5000]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    os.rename(next((tmp_path / "documents").glob("part-*.parquet")), tmp_path / "data/documents.parquet")
    same(spark, queries.QUERIES["op5_secret_scans"], queries.ORACLES["op5_secret_scans"], f"{tmp_path}/data")
