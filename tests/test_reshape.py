"""Pivots of days with any number of readings."""

import pytest
from pyspark.sql import functions as F

from meterloom.operators import reshape
from meterloom.sources import artefacts
from meterloom.session import scratch_path


def _days(spark, sizes):
    rows = [("a", f"2021-01-0{d + 1} 00:00:00", i, float(100 * d + i)) for d, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, day string, i int, value double")
    return df.withColumn("ts", (F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("i").cast("decimal(18,6)"))).cast("timestamp_ntz"))


@pytest.mark.parametrize("longest", [4, 96, 100, 130])
def test_positions_come_from_the_data(spark, longest):
    slots = reshape.day_ordinals(_days(spark, [longest, 3]))
    wide = reshape.pivot_slots(slots, n_slots=None)
    assert wide.columns[2:] == [f"s{i}" for i in range(max(96, longest))]
    rows = wide.orderBy("date").collect()
    assert [rows[0][f"s{i}"] for i in range(longest)] == [float(i) for i in range(longest)]
    assert [rows[1][f"s{i}"] for i in range(4)] == [100.0, 101.0, 102.0, None]
    assert reshape.pivot_slots(slots.filter("false"), n_slots=None).count() == 0


def test_a_given_number_of_slots_loses_no_reading(spark):
    slots = reshape.day_ordinals(_days(spark, [100]))
    assert reshape.pivot_slots(slots, n_slots=100).count() == 1
    with pytest.raises(Exception, match="outside the 96 slots"):
        reshape.pivot_slots(slots).collect()


def test_label_files_with_any_index_name(spark):
    path = scratch_path(spark, "labels")
    spark.createDataFrame([("2021-01-04", "2.0", "a"), ("nonsense", "1", "b")], "day string, cluster string, meter string").coalesce(1).write.option("header", True).csv(path)
    rows = artefacts.read_labels_csv(spark, path, ["cluster"], ["meter"]).collect()
    assert sorted((str(r["date"]), r["cluster"], r["meter"]) for r in rows) == [("2021-01-04", 2, "a"), ("None", 1, "b")]
