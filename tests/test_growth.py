"""What queries hold in one task, shuffle and write, as their input grows."""

from pyspark.sql import functions as F

from tests.oracle import compare
from tidemark import catalog
from tidemark.operators import bootstrap, ranges


def figures(spark, run):
    """(most execution memory of a stage's tasks together, bytes shuffled, spilled and written) while run() works."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = store.stageList(spark.sparkContext._jvm.java.util.ArrayList(), False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(i) for i in range(found.size()))}

    before = stages().keys()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = [s for k, s in stages().items() if k not in before]
    return max(s.peakExecutionMemory() for s in new), sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in new)


def series(spark, n):
    target = (F.col("id") % 7 == 0).cast("long")
    return spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"), target.alias("e"), target.alias("target"), (F.col("id") % 5).cast("double").alias("p"), F.lit(0.5).alias("q"))


def test_resampled_blocks_move_blocks_not_places(spark):
    """A draw of a block is one row: 100 replicates of 6,000 places are 50,000 draws, not 600,000."""
    s = series(spark, 6000)
    runs = [lambda: bootstrap.block_recall(s, "k", "t", F.col("p") >= 3, "e", 100).collect(), lambda: bootstrap.block_precision_gain(s, "k", "t", "q", "p", 100).collect()]
    for run in runs:
        assert figures(spark, run)[1] < 3_000_000


def test_resampled_blocks_of_short_series(spark):
    """Series shorter than a block, of a rest, and of whole blocks, against the places counted one by one."""
    for n in (1, 5, 12, 31):
        s = series(spark, n)
        at, m = bootstrap.block_multiplicities(s, "k", "t", 20)
        j = m.join(at, ["k", "at"]).groupBy("rep").agg(F.try_divide(F.sum(F.col("times") * F.col("e") * (F.col("p") >= 3).cast("double")), F.sum(F.col("times") * F.col("e"))).alias("v"))
        want = bootstrap.interval(j, [], "v").first()
        got = bootstrap.block_recall(s, "k", "t", F.col("p") >= 3, "e", 20).first()
        assert got["mean"] == want["mean"] and got["low"] == want["low"] and got["high"] == want["high"]


def test_resource_windows_move_lines_once(spark):
    """The four resources' places, thresholds and windows of 60,000 lines need the lines' one shuffle."""
    query = catalog.queries()["duration_mae"]
    assert figures(spark, lambda: query(spark, "/root/testdata/sf0.01").collect())[1] < 6_000_000


def test_large_suppliers_go_by_range_partitions(spark, monkeypatch):
    """With suppliers on either side of the limit, and with all beyond it, results are those of SQL."""
    for most in (590, 1):
        monkeypatch.setattr(ranges, "KEY_ROWS", most)
        for name in ("kish_concentration", "sketch_merge"):
            compare(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_delayed_searches_do_not_share_a_task(spark):
    """Six searches of 40 schedules: no stage holds the sorts and tables of all."""
    query = catalog.queries()["threshold_search_delayed"]
    print(most := figures(spark, lambda: query(spark, "/root/testdata/sf0.001").collect())[0])
    assert most < 600_000_000


def test_resource_forecast_moves_what_it_fits(spark):
    query = catalog.queries()["resource_forecast"]
    print(moved := figures(spark, lambda: query(spark, "/root/testdata/sf0.01").collect())[1])
    assert moved < 14_000_000
