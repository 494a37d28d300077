"""Shapes of the work: bounded groups, pruned scans, few shuffles, no cross joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsewarden import train
from pulsewarden.operators import metric_queries as mq, ordering as o, rolling
from pulsewarden.operators.alerts import match_rules, AlertRule
from pulsewarden.plans.catalog import points
from pulsewarden.schema import WIDE_METRICS
from pulsewarden.session import sized, spread
from pulsewarden.sinks import stores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=6000):
    """One series with most rows, one instant with a third of them."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 10 < 9, "hot").otherwise(F.concat(F.lit("s"), (i % 70).cast("string"))).alias("server_id"),
        F.lit("m").alias("name"),
        F.timestamp_seconds(F.when(i % 3 == 0, 1_000_000).otherwise(1_000_000 + i)).alias("timestamp"),
        F.sin(i).alias("value"), i.alias("seq"))


def test_chunks_bound_every_group(spark):
    rows = o.chunked(skewed(spark), before=11, after=3, chunk_rows=200)
    sizes = [r["count"] for r in rows.groupBy(*o.KEYS, o.CHUNK).count().collect()]
    assert max(sizes) <= 200 + 11 + 3
    assert rows.filter(o.HOME).count() == 6000
    assert rows.rdd.getNumPartitions() > 1


def test_copies_are_spread_over_partitions(spark):
    copies = spark.range(8000).select(F.lit("a").alias("server_id"), F.lit("m").alias("name"),
                                      F.timestamp_seconds(F.lit(1)).alias("timestamp"), F.lit(7).cast("bigint").alias("seq"))
    ranged = copies.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange(
        8, *o.KEYS, *o.ORDER, "_scan").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranged) < 4000
    places = [r[0] for r in o.ordered(copies).select(o.POS).collect()]
    assert sorted(places) == list(range(8000))


def test_hot_series_features_are_exact(spark):
    df = skewed(spark)
    got = rolling.rolling_features(df, (1,), ("mean", "max"), chunk_rows=100).filter("server_id = 'hot'").orderBy("timestamp", "seq").collect()
    values = np.array([r["value"] for r in got])
    for i in (4, 11, 12, 99, 100, 101, 2500, len(got) - 1):
        frame = values[max(0, i - 11): i + 1]
        assert got[i]["mean_1m"] == pytest.approx(frame.mean(), abs=1e-12) and got[i]["max_1m"] == frame.max()


def test_numbering_without_a_window_over_the_key(spark):
    got = o.numbered(skewed(spark)).groupBy("server_id").agg(F.max("rn").alias("m"), F.count("*").alias("n"), F.countDistinct("rn").alias("d")).collect()
    assert all(r["m"] == r["n"] == r["d"] for r in got)


def test_newest_prunes_before_the_shuffle(spark, events):
    df = o.newest(events, 500, ["server_id"], o.ORDER)
    text = plan(df)
    assert text.count("WindowGroupLimit") >= 2
    # the first limit runs below the first exchange
    assert text.rindex("WindowGroupLimit") > text.rindex("Exchange")


def test_rolling_features_shuffle_once_after_ordering(spark, events):
    text = plan(rolling.rolling_features(events))
    assert text.count("Exchange") - text.count("BroadcastExchange") == 1 and "SortMergeJoin" not in text


def test_scans_read_only_what_is_needed(spark, sf):
    text = plan(entry.queries()["ag1_latest_metrics"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    late = plan(entry.queries()["ag1_latest_of_server"](spark, sf))
    assert "PushedFilters: [IsNotNull(user_id)]" in late or "DataFilters" in late


@pytest.mark.parametrize("name", sorted(set(entry.queries())))
def test_no_cross_joins(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sized_tables(spark, sf):
    """Written tables are broadcast by their size in bytes, not their rows."""
    fact = spark.range(100)
    assert "BroadcastHashJoin" in plan(fact.join(sized(spark.range(10)), "id"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    assert "BroadcastHashJoin" not in plan(spark.read.parquet(f"{sf}/orders.parquet").join(sized(spark.range(10)), F.col("o_orderkey") == F.col("id")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_spread_moves_only_small_tables(spark, sf):
    assert spread(spark.read.parquet(f"{sf}/events.parquet")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rules_meet_rows_by_equal_names(spark, events):
    df = match_rules(events.withColumnRenamed("name", "metric_name"), [AlertRule("r", "c*")])
    assert "Join" not in plan(df) and df.select("metric_name").distinct().collect()[0][0] == "click"


def test_counter_rate_combines_before_the_shuffle(spark, events):
    assert "partial_sum" in plan(mq.counter_rate(events))


def test_training_job(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").limit(700).withColumn("n", F.monotonically_increasing_id())
    stamp = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("n") * 300)
    kinds = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows.select(stamp.alias("timestamp"), F.lit("s").alias("server_id"), *[
        F.col(kinds[i % 4]).alias(m) for i, m in enumerate(WIDE_METRICS)]).write.csv(str(tmp_path / "in"), header=True)
    train.main(["--path", str(tmp_path / "in"), "--model-dir", str(tmp_path / "m"), "--output", str(tmp_path / "r")])
    report = {(r["model"], r["metric"]): r["value"] for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert report[("isolation_forest", "n_samples")] == 700 and report[("holt_winters", "n_series")] == 8
    assert 0.02 < report[("isolation_forest", "anomaly_rate")] < 0.08
    assert stores.load_model(spark, str(tmp_path / "m"), "drift_reference").count() == 80
    with pytest.raises(SystemExit):
        train.main(["--model-dir", str(tmp_path / "m")])
