import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import sieve
from tidemark.llm.scratch import Scratch


def stages(spark):
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}


def test_texts_stay_where_they_are(spark, tmp_path, monkeypatch):
    """Only texts that have to be compared or that may go are shuffled, also where nothing is broadcast."""
    r = random.Random(2)
    rows = [(k, " ".join(f"{r.randrange(16**12):x}" for _ in range(1500)), "en", "a", 1) for k in range(150)]
    rows += [(200, rows[3][1] + " end", "en", "a", 1), (201, rows[4][1], "en", "a", 1), (None, "", "en", "a", 1), (None, rows[5][1], "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    before = max(stages(spark), default=-1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cp.keep_one_of_each(spark, spark.read.parquet(f"{tmp_path}/docs"), "").select("doc_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted([x[:2] for x in rows[:150]] + [(None, ""), (None, rows[5][1])], key=str)
    # The keys of the sets take about half of the texts' size.
    assert sum(v for k, v in stages(spark).items() if k > before) < sum(len(x[1]) for x in rows)


@pytest.mark.parametrize("keys,rows", [(0, 100), (1, 100), (500, 20_000)])
def test_a_sieve_parts_the_rows_and_loses_no_partner(spark, keys, rows):
    scratch = Scratch(spark, "test")
    has = spark.range(keys).select((F.col("id") * 7).alias("of"))
    df = spark.range(rows).withColumn("text", F.concat(F.lit("t"), "id"))
    sift = sieve.Sieve(scratch, "keys", has, F.xxhash64("of"))
    hit, rest = (sift(df, F.xxhash64("id"), marked) for marked in (True, False))
    assert hit.columns == df.columns and rest.schema == df.schema
    ids = [{x.id: x.text for x in part.collect()} for part in (hit, rest)]
    want = {7 * k for k in range(keys)} & set(range(rows))
    assert want <= ids[0].keys() and len(ids[0]) <= len(want) + 0.05 * rows
    assert not ids[0].keys() & ids[1].keys() and ids[0] | ids[1] == {k: f"t{k}" for k in range(rows)}


def test_a_full_bitmap_lets_more_pass_and_loses_none(spark, monkeypatch):
    scratch = Scratch(spark, "test")
    sift = sieve.Sieve(scratch, "full", spark.range(5000).withColumn("id", F.xxhash64("id")), F.col("id"))
    keys = np.array([x.key for x in spark.read.parquet(sift.path).collect()], np.int64)
    monkeypatch.setattr(sieve, "MOST", 1 << 10)
    marks = sieve._marks.__wrapped__(sift.path)
    assert len(marks) == 1 << 7 and sieve._marked(marks, keys).all()
