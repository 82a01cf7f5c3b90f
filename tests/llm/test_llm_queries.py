import pytest

from lodestrata.llm.queries import QUERIES

COLUMNS = {"p1_found": ["tab", "record_id", "line_no"], "p2_found": ["section_id"], "p3_found": ["int_a", "int_b"], "p4_found": ["path"], "p5_found": ["path"], "p6_found": ["symbol_id"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "start_char", "end_char"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert rows or name == "p7_found"
    if name in COLUMNS:
        assert name == "p9_found" or len(rows) == len(set(rows))


def test_core_does_not_import_the_subpackage():
    import os

    import lodestrata

    root = os.path.dirname(lodestrata.__file__)
    for folder, _, names in os.walk(root):
        if "llm" in os.path.relpath(folder, root).split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "lodestrata.llm" not in open(os.path.join(folder, n)).read()
