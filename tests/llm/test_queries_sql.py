"""The registered queries of the text operators against their SQL on the small tables."""

import os

import pytest

from tests.oracle import differences
from weirflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert differences(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF) is None


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_for_each_row(spark, name):
    pytest.importorskip("public_tokenizers")
    got = queries.queries()[name](spark, SF)
    key = "page_id" if "page_id" in got.columns else "doc_id"
    source = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    if name == "pipeline":
        assert got.select(key).distinct().join(source, key).count() == got.count() > 0
    else:
        assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in source.select(key).collect())
