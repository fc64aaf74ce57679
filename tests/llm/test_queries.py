"""Every training-data query runs over whole tables, and agrees with its SQL where it has one."""

import duckdb
import pytest

from kinmatch.llm import oracles, queries

COLUMNS = {
    "p1_found": ["left_posting_id", "right_posting_id"], "p2_found": ["first_posting_id", "posting_id"], "p3_found": ["left_posting_id", "right_posting_id"],
    "p4_found": ["first_label_group", "label_group"], "p5_found": ["first_row_number", "row_number"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    df = queries.queries()[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(got)) == len(got)
    if sql := oracles.oracle_sql().get(name):
        import os

        con = duckdb.connect()
        for f in os.listdir(small):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        order = [names.index(c) for c in df.columns]
        assert sorted(map(str, got)) == sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())
