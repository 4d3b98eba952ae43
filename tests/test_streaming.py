from pyspark.sql import functions as F

from climext import from_series
from climext.operators.index import fit_index_params, rolling_sum
from climext.streaming.monitor import rescore, watch


def test_streams(spark, tmp_path):
    df = from_series(spark, [float(i * 37 % 23) - 5 for i in range(120)], "1995-01-01")
    params = fit_index_params(df.withColumn("value", F.abs("value") + 1), "value", [1]).cache()
    df = df.withColumn("scaled", F.abs("value") + 1)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = rescore(stream, params).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").where("index is not null").count() == 120
    q = watch(stream, -1.0).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("watched")
    assert got.count() == 120 and got.where("is_event").count() == df.where("value < -1").count()
    assert rolling_sum(df, 2).count() == 120
