import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.operators import daily, reshape, rowframe
from meterloom.sources import artefacts, panels
from meterloom.session import scratch_path


def local(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("block_rows", [300, 577, None])
def test_blocked_frames_equal_one_global_window(twin, twin_pandas, block_rows):
    rows = rowframe.with_row_index(twin)
    got = rowframe.with_frames(rows, {
        "m": (F.avg("temperature"), -287, 0), "s": (F.sum("radiation"), -95, 0), "c": (F.avg("total"), -1, 1),
        "l": rowframe.lag_frame("total", 96), "ahead": (F.max("total"), 2, 2),
    }, block_rows=block_rows)
    got = local(got, "series_id", "ts")
    p = twin_pandas.sort_values(["series_id", "ts"]).reset_index(drop=True)
    g = p.groupby("series_id")
    want = {
        "m": g["temperature"].transform(lambda s: s.rolling(288, min_periods=1).mean()),
        "s": g["radiation"].transform(lambda s: s.rolling(96, min_periods=1).sum()),
        "c": g["total"].transform(lambda s: s.rolling(3, center=True, min_periods=1).mean()),
        "l": g["total"].shift(96), "ahead": g["total"].shift(-2),
    }
    assert len(got) == len(p)
    assert (got["rn"] == g.cumcount()).all()
    for name, w in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), w.to_numpy(float), atol=1e-7, err_msg=name)


def test_block_smaller_than_frame_is_refused(twin):
    with pytest.raises(ValueError):
        rowframe.with_frames(rowframe.with_row_index(twin), {"l": rowframe.lag_frame("total", 96)}, block_rows=10)


def test_hot_series_is_spread_over_tasks(spark):
    """One series with all the rows ends up in many window partitions, not one."""
    hot = spark.range(20000).select(F.lit("hot").alias("series_id"), F.col("id").alias("rn"), F.col("id").cast("double").alias("v"))
    out = rowframe.with_frames(hot, {"s": (F.sum("v"), -9, 0)}, block_rows=1000)
    assert out.count() == 20000
    want = sum(sum(range(max(0, i - 9), i + 1)) for i in range(20000))
    assert out.agg(F.sum("s")).first()[0] == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and "SinglePartition" not in plan


def test_carry_forward_equals_pandas(twin, twin_pandas):
    cut = pd.Timestamp("2021-01-20")
    holed = rowframe.with_ordinal(twin).withColumn("f", F.when((F.col("ts") < F.lit(cut)) & (F.col("ordinal") % 7 == 0), F.col("total")))
    got = local(rowframe.carry_forward(holed, "f", "p"), "series_id", "ts")
    p = twin_pandas.sort_values(["series_id", "ts"]).reset_index(drop=True)
    o = p.groupby(["series_id", p["ts"].dt.date]).cumcount()
    want = p["total"].where((p["ts"] < cut) & (o % 7 == 0)).groupby(p["series_id"]).ffill()
    np.testing.assert_allclose(got["p"].to_numpy(float), want.to_numpy(float))


def test_densified_day_has_zero_sum_and_null_mean(twin):
    days = daily.day_features(twin, scale=False)
    gone = days.filter("series_id = 'm2' AND date = DATE'2021-01-15'").first()
    assert gone["radiation_sum"] == 0.0 and gone["temperature"] is None and gone["load_max"] is None
    assert days.count() == 3 * 28


def test_repeated_slot_is_an_error(twin):
    doubled = twin.unionByName(twin.filter("series_id = 'm1'").limit(1))
    slots = reshape.day_slots(doubled, "total")
    assert reshape.duplicate_slots(slots).count() == 1
    with pytest.raises(Exception, match="two readings"):
        reshape.pivot_slots(slots).collect()
    assert reshape.pivot_slots(reshape.day_slots(twin, "total")).count() == 83


def test_csv_round_trip_turns_nan_into_null(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("2021-01-04 00:00:00+00:00", "NaN", "1.0", "2.0", "3.0")], "Date string, temperature string, radiation string, total string, total_filter string").write.option("header", True).csv(path)
    row = panels.read_series_csv(spark, path, series_id="meter").first()
    assert row["temperature"] is None and row["total"] == 2.0 and str(row["ts"]) == "2021-01-04 00:00:00" and row["series_id"] == "meter"


def test_label_files_may_name_their_index_differently(spark):
    for index in ("DateOnly", "day"):
        path = scratch_path(spark, "labels")
        spark.createDataFrame([("2021-01-04", "1"), ("bad", "0")], f"{index} string, cluster string").coalesce(1).write.option("header", True).csv(path)
        got = {(str(r["date"]), r["cluster"]) for r in artefacts.read_labels_csv(spark, path, ["cluster"]).collect()}
        assert got == {("2021-01-04", 1), ("None", 0)}


def test_keyed_write_replaces_only_the_settings_it_holds(spark):
    path = scratch_path(spark, "keyed")
    first = spark.createDataFrame([("a", 2, 1.0), ("a", 3, 2.0)], "series_id string, k int, v double")
    artefacts.write_keyed(first, path, ["k"])
    artefacts.write_keyed(first.filter("k = 3").withColumn("v", F.lit(9.0)), path, ["k"])
    assert {(r["k"], r["v"]) for r in artefacts.read_keyed(spark, path).collect()} == {(2, 1.0), (3, 9.0)}


def test_constant_column_scales_to_zero(spark):
    from meterloom.operators.scale import min_max, standardise

    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0)], "series_id string, x double, c double")
    assert {(r["x"], r["c"]) for r in standardise(df, ["x", "c"]).collect()} == {(-1.0, 0.0), (1.0, 0.0)}
    assert min_max(df, "c").filter("scaled IS NOT NULL").count() == 0
