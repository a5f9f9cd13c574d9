from facetry.session import removed, written


def test_written_relations_can_be_removed(spark):
    df = written(spark.range(10), "numbers")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert df.count() == 10 and files.exists(path)
    removed(df)
    assert not files.exists(path)
