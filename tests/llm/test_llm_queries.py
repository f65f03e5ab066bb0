import os

import pytest

from quillspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {"p3_found": {"seq", "analyte_key"}, "p5_found": {"evidence_id", "source_id"}, "p7_found": {"doc_id", "item_id"}, "p8_found": {"doc_id", "reading_level"}, "p6_assignment": {"doc_id", "part", "token_from", "token_to", "container", "slot_from"}}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert set(df.columns) == COLUMNS[name] and df.count() > 0 and df.distinct().count() == df.count()
    assert {t for _, t in df.dtypes} <= {"string", "bigint", "int"}
