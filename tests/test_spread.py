from lodestone.sources.spread import spread


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 100
    dealt = one.repartition(3)
    assert spread(dealt) is dealt
    many = spark.range(0, 100, 1, cores + 2)
    assert spread(many) is many
