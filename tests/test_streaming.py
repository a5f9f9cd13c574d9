from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.operators.sites import structure_tensors
from facetry.streaming.sites import running_tensors


def test_streamed_tensors_equal_the_batch(spark, tmp_path):
    schema = "center int, x double, y double, z double"
    rows = [(1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (1, 1.0, 2.0, 2.0), (3, 0.5, 0.5, 0.0)]
    source = f"{tmp_path}/in"
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        running_tensors(stream, ["center"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    latest = W.partitionBy("center").orderBy(F.desc("batch"))
    got = spark.read.parquet(f"{tmp_path}/out").withColumn("r", F.row_number().over(latest)).where("r = 1")
    want = {r["center"]: r["tensor"] for r in structure_tensors(spark.createDataFrame(rows, schema), ["center"]).collect()}
    assert {r["center"]: r["tensor"] for r in got.collect()} == want
