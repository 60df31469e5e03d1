"""Queries of this subpackage against DuckDB where SQL can say the same; all of them over the small tables."""

from __future__ import annotations

import pytest

from rankloom.llm import queries

from .. import compare

COLUMNS = {
    "p1_found": {"score_id", "pos", "name"}, "p2_found": {"rec_id", "work_id"}, "p3_found": {"rec_id", "col"}, "p4_found": {"vec_id_a", "vec_id_b"}, "p5_found": {"group_id", "col", "rec_id"}, "p6_ids": {"doc_id", "ids"},
    "p7_found": {"doc_id", "item_id"}, "p8_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    assert compare.differ(queries.queries()[name](spark, sf), queries.oracle_sql()[name], compare.connect(sf)) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert set(df.columns) == COLUMNS[name] and df.count() > 0


def test_neighbours_of_the_small_table(spark, sf):
    from .test_records import recall

    rows = [(r["vec_id"], r["model"], r["vec"]) for r in spark.read.parquet(f"{sf}/vecs.parquet").collect()]
    r, p = recall(spark, rows)
    assert r >= 0.9 and p >= 0.9
