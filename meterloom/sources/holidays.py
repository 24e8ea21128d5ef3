"""Holiday dimension for a span of years, with room for regional rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Month, day, name. National days of Spain, then the days of the Murcia region.
NATIONAL_DAYS = [
    (1, 1, "New Year"),
    (1, 6, "Epiphany"),
    (5, 1, "Labour Day"),
    (8, 15, "Assumption"),
    (10, 12, "National Day"),
    (11, 1, "All Saints"),
    (12, 6, "Constitution Day"),
    (12, 8, "Immaculate Conception"),
    (12, 25, "Christmas"),
]
REGION_DAYS = {"murcia": [(3, 19, "Saint Joseph"), (6, 9, "Region Day")]}
# Offsets in days from Easter Sunday.
EASTER_DAYS = [(-3, "Maundy Thursday"), (-2, "Good Friday")]


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous integer algorithm, as one expression over ``year``."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / F.lit(b)).cast("int")

    a = year % 19
    b = div(year, 100)
    c = year % 100
    d = div(b, 4)
    e = b % 4
    g = div(b * 8 + 13, 25)
    h = (a * 19 + b - d - g + 15) % 30
    i = div(c, 4)
    k = c % 4
    m = (F.lit(32) + e * 2 + i * 2 - h - k) % 7
    n = div(a + h * 11 + m * 22, 451)
    p = h + m - n * 7 + 114
    return F.make_date(year, div(p, 31), (p % 31) + 1)


def holiday_table(
    spark: SparkSession,
    first_year: int = 1950,
    last_year: int = 2100,
    region: str = "murcia",
    extra: DataFrame | None = None,
) -> DataFrame:
    """One row per holiday of the given years. ``extra`` may hold further (date, name) rows."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    fixed = F.array(
        *[
            F.struct(F.make_date(F.col("year"), F.lit(m), F.lit(d)).alias("date"), F.lit(n).alias("name"))
            for m, d, n in NATIONAL_DAYS + REGION_DAYS.get(region, [])
        ]
    )
    moving = F.array(
        *[
            F.struct(F.date_add(easter_sunday(F.col("year")), off).alias("date"), F.lit(n).alias("name"))
            for off, n in EASTER_DAYS
        ]
    )
    table = years.select(F.explode(F.concat(fixed, moving)).alias("h")).select("h.date", "h.name")
    return table if extra is None else table.unionByName(extra.select("date", "name"))


def is_holiday(date: Column, region: str = "murcia") -> Column:
    """Whether ``date`` is a holiday of its own year, whichever year that is."""
    year = F.year(date)
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d, _ in NATIONAL_DAYS + REGION_DAYS.get(region, [])]
    moving = [F.date_add(easter_sunday(year), off) for off, _ in EASTER_DAYS]
    return F.coalesce(F.array_contains(F.array(*fixed, *moving), date), F.lit(False))


def with_holiday_flag(days: DataFrame, holidays: DataFrame | None = None, date: str = "date") -> DataFrame:
    """0/1 holiday flag: computed from the date, or looked up in a table of the caller."""
    if holidays is None:
        return days.withColumn("is_holiday", is_holiday(F.col(date)).cast("int"))
    flags = holidays.select(F.col("date").alias(date)).distinct().withColumn("is_holiday", F.lit(1))
    return days.join(flags, date, "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))
