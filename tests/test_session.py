from lectorium import session as S


def test_shared_folder_comes_from_the_session(spark):
    assert S.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")


def test_stored_and_checkpointed_keep_rows(spark):
    d = spark.range(10).toDF("a")
    t = S.stored(d)
    assert t.count() == 10 and "lectorium-" in t.inputFiles()[0] and t.inputFiles()[0].startswith("file:")
    assert S.checkpointed(d).count() == 10


def test_small_is_checked(spark):
    d = spark.range(10).toDF("a")
    assert "broadcast" in S.small(d, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in S.small(d, 9)._jdf.queryExecution().logical().toString().lower()


def test_spread_moves_only_narrow_scans(spark):
    d = spark.range(0, 100, 1, 16)
    assert S.spread(d) is d
    assert S.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() >= 4
