"""Queries of the subpackage and the SQL of those that SQL can express."""

from palimpsest.llm import name_variants, near_duplicates, packing, pii, quality, tokenize, vectors

QUERIES = {
    "p9_assignments": packing.p9_assignments,
    "p9_fill": packing.p9_fill,
    "p10_found": quality.p10_found,
    "p10_stats": quality.p10_stats,
    "p2_found": pii.p2_found,
    "p2_redacted": pii.p2_redacted,
    "p3_found": name_variants.p3_found,
    "p3_entities": name_variants.p3_entities,
    "p4_found": vectors.p4_found,
    "p4_neighbours": vectors.p4_neighbours,
    "p5_found": near_duplicates.p5_found,
    "p5_groups": near_duplicates.p5_groups,
    "p8_ids": tokenize.p8_ids,
}
SQL: dict[str, str] = {}
