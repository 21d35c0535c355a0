"""Messages of the long form: counted before they are texts, the same as after."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicebox.functions.jsontext import json_text
from sluicebox.queries import QUERIES
from sluicebox.queries.messages import FIELDS
from sluicebox.queries.registry import lineitem
from sluicebox.sources.dataset import long_form


def test_equal_rows_are_counted_and_signs_of_zero_and_nulls_kept(spark, tmp_path):
    line = F.col("l_linenumber")
    odd = F.when(line == 1, F.lit(-0.0)).when(line == 2, F.lit(0.0)).when(line == 3, F.lit(None)).otherwise(F.col("l_discount"))
    source = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_discount", odd.cast("double"))
    source.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = long_form(lineitem(spark, str(tmp_path)), FIELDS, ["l_returnflag"])
    want = rows.select(json_text(rows).alias("value")).groupBy("value").agg(F.count("*").alias("copies"))
    got = QUERIES["long_form_messages"](spark, str(tmp_path))
    assert got.schema["copies"].dataType == want.schema["copies"].dataType
    assert sorted(got.collect()) == sorted(want.collect())
