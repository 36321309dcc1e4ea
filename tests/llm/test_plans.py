"""The plans of this subpackage's queries: nothing is paired with everything, and no whole group goes through pandas."""

import pytest

from spotloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_query_pairs_everything(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "FlatMapGroupsInPandas" not in text


def test_texts_are_read_but_for_their_columns(spark, sf):
    df = queries.p7_ids(spark, sf)
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "Exchange" not in text
