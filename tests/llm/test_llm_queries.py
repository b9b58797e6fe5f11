import pytest

from palimpsest.llm.queries import QUERIES

COLUMNS = {
    "p2_found": ["memory_id", "pii_kind", "found_text"], "p3_found": ["mention_a", "mention_b"], "p4_found": ["memory_id_a", "memory_id_b"], "p5_found": ["memory_id_a", "memory_id_b"],
    "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "text_class"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name in ("p3_found", "p4_found", "p5_found"):
        assert all(r[0] < r[1] for r in rows) and len({tuple(r) for r in rows}) == len(rows)
