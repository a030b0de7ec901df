from pyspark.sql import functions as F

from graphmill.operators import supplement as U


def test_rows_without_symbol_or_parent_do_not_meet_in_one_task(spark, monkeypatch):
    keep, shares = U.stored, []

    def stored(df):
        parts = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
        shares.append(max(parts) / sum(parts))
        return keep(df)

    monkeypatch.setattr(U, "stored", stored)
    off = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    none = F.lit(None)
    k = spark.range(400)
    place = [F.lit(i).cast("int").alias(c) for i, c in zip((1, 0, 9, 0, 1, 0), U.PLACE)]
    indexed = k.select("id", F.col("id").alias("file_id"), F.lit("a").alias("name"), F.lit("class").alias("kind"), *place, none.cast("string").alias("signature"), none.cast("long").alias("parent_symbol_id"))
    served = k.select(F.col("id").alias("file_id"), F.lit(0).cast("long").alias("position"), none.cast("long").alias("parent_position"), F.lit(0).alias("depth"), F.lit("b").alias("name"), F.lit("class").alias("kind"), none.cast("string").alias("signature"), none.cast("string").alias("doc_comment"), *place)
    try:
        for key, value in off.items():
            spark.conf.set(key, value)
        got = U.change_set(indexed, served, k.select(F.col("id").alias("file_id")).where("id % 2 = 0")).groupBy("action").count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert [(r["action"], r["count"]) for r in got] == [("insert", 400)]
    assert max(shares) < 0.5
