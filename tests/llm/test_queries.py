"""The registered queries run, keep their columns, and equal their DuckDB equivalents."""

import os

import duckdb
import pytest

from lorekeep.llm import catalog

COLUMNS = {
    "p1_found": [("src", "string"), ("rec_no", "bigint")], "p2_found": [("src", "string"), ("rec_no", "bigint"), ("kind", "string"), ("start_at", "int")], "p3_found": [("rec_no", "bigint")],
    "p4_found": [("row_a", "bigint"), ("row_b", "bigint")], "p5_found": [("row_a", "bigint"), ("row_b", "bigint")], "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p8_found": [("doc_a", "bigint"), ("doc_b", "bigint")],
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    if name in catalog.oracle_sql():
        c = duckdb.connect()
        for f in os.listdir(sf):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
        rel = c.execute(catalog.oracle_sql()[name])
        cols = [d[0] for d in rel.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(repr([r[x] for x in sorted(cols)]) for r in rows) == sorted(repr([r[cols.index(x)] for x in sorted(cols)]) for r in rel.fetchall())
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
