import duckdb
import pandas as pd
import pytest

from tidemark.llm import mixing

ROWS = [(1, "abc", "s", "x"), (1, "abc", "s", "x"), (2, None, "s", "y"), (None, "nul", "t", "z"), (4, "", None, "w"), (5, "long " * 500, None, "v"), (6, "a", "tiny", "u")]


@pytest.mark.parametrize("budget", [1.0, 60.0])
def test_equals_sql(spark, budget):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, copy string")
    got = mixing.mix_sources(docs, budget=budget).select("doc_id", "text", "source", "copy", "mix_key").toPandas()
    d = docs.drop("copy").toPandas()
    con = duckdb.connect()
    con.register("d", d)
    con.sql("create table docs as select doc_id::bigint as doc_id, text, source from d")
    want = con.sql(mixing.mixing_sql("docs", budget=str(budget))).df()
    plain = lambda df: list(tuple(None if pd.isna(x) else str(x).removesuffix(".0") for x in row) for row in df[got.columns].astype(object).itertuples(index=False))
    assert sorted(map(str, plain(got))) == sorted(map(str, plain(want)))


def test_mean_rate_and_weights(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'text' as text", "if(id % 4 = 0, 'a', 'b') as source")
    n = {x.source: x["count"] for x in mixing.mix_sources(docs, {"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(n["a"] - 3000) < 250 and abs(n["b"] - 1000) < 150
    assert mixing.mix_sources(docs, {"none": 1.0}).count() == 0
    assert mixing.mix_sources(docs.filter("doc_id < 0")).count() == 0


def test_many_sources_are_joined_by_a_shuffle(spark):
    """The same rows whether the rates go to the documents or meet them, one source with most rows."""
    docs = spark.range(3000).selectExpr("id as doc_id", "'text' as text", "if(id % 3 = 0, concat('s', id % 90), if(id % 7 = 1, null, 'hot')) as source")
    table = mixing.rates(docs, None, "source", "text", 0.5, 1.0)
    few, many = (mixing.with_rates(docs, table, "source", "doc_id", few=n).select("doc_id", "mx_source", "mx_parts", "mx_cdf").collect() for n in (100, 0))
    assert len(few) == 3000 and sorted(few) == sorted(many) if all(x.mx_source for x in few) else {(x.doc_id, x.mx_source, tuple(x.mx_cdf)) for x in few} == {(x.doc_id, x.mx_source, tuple(x.mx_cdf)) for x in many} and len(many) == 3000
