"""Some queries with whole-stage code generation, as production runs them; the other tests run without."""

from __future__ import annotations

import pytest

from tests.test_catalogue import QUERIES, SQL, TABLES, same

SETTINGS = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}


@pytest.mark.skipif(not TABLES.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["text_tokens", "char_trigrams", "bm25_topk", "weighted_lexical_topk", "exact_match", "eav_pivot_latest", "form_validation", "field_texts", "title_classify", "session_expiry"])
def test_query_equals_sql_with_code_generation(spark, name):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        same(spark, name, QUERIES[name], SQL[name])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
