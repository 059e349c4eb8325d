"""The registered queries over the smallest tables."""

from __future__ import annotations

import pytest

from docweave.llm import queries as Q

from ..conftest import SMALL

COLUMNS = {
    "p1_found": ["rec_kind", "id_a", "id_b"], "p2_found": ["group_no", "field_name", "from_no"], "p3_found": ["rec_kind", "id_a", "id_b"], "p4_found": ["chunk_id", "cut_kind"],
    "p5_found": ["rec_kind", "rec_id"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SMALL)
    got = sorted(map(tuple, df.collect()), key=str)
    assert len(set(got)) == len(got)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and got
    if name in Q.oracle_sql():
        sql = duck.sql(Q.oracle_sql()[name])
        assert got == sorted((tuple(r[sql.columns.index(c)] for c in df.columns) for r in sql.fetchall()), key=str)
