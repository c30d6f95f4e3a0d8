"""Every query of the subpackage runs over the smallest tables and has the promised columns."""

from pathlib import Path

import pytest

from lexloom.llm import entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
COLUMNS = {
    "p1_found": "table_name,row_id", "p2_found": "table_name,row_id,end_pos", "p3_found": "pair_id,group_id", "p4_found": "pair_id_a,pair_id_b",
    "p5_found": "mono_id,lang", "p6_found": "table_name,row_id", "p7_found": "pair_id,ing_line,rus_line", "p8_ids": "doc_id,ids", "p9_found": "doc_id,item_id", "p10_found": "doc_id,kind",
}
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split(",")
        assert len({tuple(map(str, r)) for r in rows}) == len(rows)


def test_all_problems():
    assert {n.split("_")[0] for n in QUERIES} == {f"p{k}" for k in range(1, 11)}
