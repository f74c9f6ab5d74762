"""Turns beyond the bound of Spark's JSON reader: written in parts, or an error, never a null."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesserae.llm.chat import canonical, format_turns, read_turns, records_of


def test_a_long_turn_is_written_in_parts_and_read_back(spark):
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant")], "conv_id long, turn long, role string")
    rows = rows.withColumn("text", F.when(F.col("turn") == 0, F.repeat(F.lit("añ"), 10_500_000)).otherwise("ok"))
    got = read_turns(format_turns(canonical(records_of(rows), "id", "record")))
    r = got.select("layout", F.size("read").alias("n"), F.length(F.col("read")[0]["text"]).alias("chars"), F.sha2(F.col("read")[0]["text"], 256).alias("sha"), "loss_text").first()
    expected = spark.range(1).select(F.sha2(F.repeat(F.lit("añ"), 10_500_000), 256)).first()[0]
    assert (r.layout, r.n, r.chars, r.sha, r.loss_text) == ("messages of parts", 2, 21_000_000, expected, "ok")


def test_a_record_that_the_reader_refuses_is_an_error(spark):
    long = spark.range(1).select("id", F.concat(F.lit('{"prompt": "'), F.repeat(F.lit("a"), 21_000_000), F.lit('", "completion": ""}')).alias("record"))
    with pytest.raises(PySparkException, match="20,000,000 characters, in the record of id 0"):
        canonical(long, "id", "record").select("id", "layout").collect()
