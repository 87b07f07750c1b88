"""Queries with planted rows: no result column of theirs may hold one value only."""

import pytest

from tidemark import plans

QUERIES = (
    "injection_heuristics", "look_alike_copy", "block_pages", "country_codes", "boilerplate_pages", "content_status_bands", "redact_tokens", "invisible_unicode_flags", "white_space", "domain_surge",
    "detect_trends", "penalised_relevance", "hidden_text_ratio", "dictionary_spans", "dictionary_mentions", "entity_names", "event_grounding", "analysis_grounding", "sentence_rows", "citation_check",
    "dossier_changes", "deal_changes",
)


@pytest.mark.parametrize("name", QUERIES)
def test_every_column_has_two_values(spark, name):
    rows = plans.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    few = [c for c in rows[0].asDict() if len({str(r[c]) for r in rows}) < 2]
    assert not few
