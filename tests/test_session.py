import os

from tapewatch.session import cut_lineage, intermediate_tables


def folder_of(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_intermediate_tables_go_when_their_scope_ends(spark):
    outside = cut_lineage(spark.range(5))
    with intermediate_tables(spark):
        inside = cut_lineage(spark.range(7))
        with intermediate_tables(spark):
            inner = cut_lineage(spark.range(9))
            assert inner.count() == 9
        assert not os.path.exists(folder_of(inner)) and inside.count() == 7
    assert not os.path.exists(folder_of(inside)) and outside.count() == 5


def test_written_tables_leave_no_shuffle_files(spark):
    import glob
    import os

    from pyspark.sql import functions as F

    from tapewatch.session import CLEANUP, cut_lineage

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffles():
        return {f for d in folders for f in glob.glob(f"{d.getPath()}/*/shuffle_*") if os.path.isfile(f)}

    before, setting = shuffles(), spark.conf.get(CLEANUP, None)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = cut_lineage(counted.join(counted.withColumnRenamed("count", "n"), "k"))
    assert not shuffles() - before and spark.conf.get(CLEANUP, None) == setting
    assert table.agg(F.sum("n")).first()[0] == 1000  # and a plain query keeps its files for a while
    assert shuffles() - before
