"""Cross-validation splits as columns, from row positions and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_day_index(days: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """0-based day position ``rn`` and day count ``series_rows``; one row per calendar day bounds the window."""
    w = Window.partitionBy(*keys)
    return days.withColumns({"rn": F.row_number().over(w.orderBy("date")) - 1, "series_rows": F.count(F.lit(1)).over(w)})


def contiguous_fold(splits: int, rn: str = "rn", n: str = "series_rows") -> Column:
    """Fold of a contiguous k-fold split; the first n mod k folds hold one row more."""
    base = F.floor(F.col(n) / splits)
    extra = F.col(n) % splits
    head = extra * (base + 1)
    return (
        F.when(F.col(rn) < head, F.floor(F.col(rn) / (base + 1)))
        .otherwise(extra + F.floor((F.col(rn) - head) / F.greatest(base, F.lit(1))))
        .cast("int")
    )


def expanding_roles(df: DataFrame, splits: int, rn: str = "rn", n: str = "series_rows") -> DataFrame:
    """Expanding split: the last ``splits`` blocks of n/(splits+1) rows are tests, all earlier rows train."""
    size = F.floor(F.col(n) / (splits + 1))
    roles = []
    for f in range(splits):
        start = F.col(n) - size * (splits - f)
        role = F.when(F.col(rn) < start, F.lit("train")).when(F.col(rn) < start + size, F.lit("test"))
        roles.append(F.struct(F.lit(f + 1).alias("fold"), role.alias("role")))
    out = df.withColumn("_f", F.explode(F.array(*roles))).withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")})
    return out.drop("_f").filter(F.col("role").isNotNull())


def complement_roles(df: DataFrame, splits: int, rn: str = "rn", n: str = "series_rows") -> DataFrame:
    """Same test blocks as the expanding split, but every other row trains, later ones included."""
    size = F.floor(F.col(n) / (splits + 1))
    roles = []
    for f in range(splits):
        start = F.col(n) - size * (splits - f)
        inside = (F.col(rn) >= start) & (F.col(rn) < start + size)
        roles.append(F.struct(F.lit(f + 1).alias("fold"), F.when(inside, "test").otherwise("train").alias("role")))
    out = df.withColumn("_f", F.explode(F.array(*roles))).withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")})
    return out.drop("_f")


def kfold_roles(df: DataFrame, splits: int, fold: Column) -> DataFrame:
    """Turn a fold number 0..splits-1 into train and test rows for each fold."""
    roles = F.transform(
        F.sequence(F.lit(0), F.lit(splits - 1)),
        lambda f: F.struct((f + 1).alias("fold"), F.when(f == F.col("_own"), "test").otherwise("train").alias("role")),
    )
    out = df.withColumn("_own", fold).withColumn("_f", F.explode(roles))
    return out.withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")}).drop("_f", "_own")


def stratified_fold(days: DataFrame, splits: int, label: str = "cluster", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Unshuffled stratified split: each class is cut into contiguous blocks over its own row order.

    Block sizes follow the usual balanced allocation: classes are laid out one after another in order of first
    appearance, and fold f receives the positions congruent to f.
    """
    indexed = days if "rn" in days.columns else with_day_index(days, keys)
    by_class = Window.partitionBy(*keys, label)
    ranked = indexed.withColumn("_rank", F.row_number().over(by_class.orderBy("rn")) - 1)
    sizes = ranked.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_size"), F.min("rn").alias("_first"))
    # One row per class.
    order = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    laid = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(order), F.lit(0))).drop("_first")
    out = ranked.join(laid, [*keys, label])

    def upto(position: Column, f: int) -> Column:
        """How many of the positions 0..position-1 are congruent to f."""
        return F.floor((position - 1 - f) / splits) + 1

    fold = F.lit(0)
    reached = F.lit(0)
    for f in range(splits - 1):
        reached = reached + upto(F.col("_start") + F.col("_size"), f) - upto(F.col("_start"), f)
        fold = fold + (F.col("_rank") >= reached).cast("int")
    return out.withColumn("fold", fold).drop("_rank", "_size", "_start")


def date_split(df: DataFrame, test_start, column: str = "date") -> DataFrame:
    """``role`` column: rows before ``test_start`` train, the others test."""
    return df.withColumn("role", F.when(F.col(column) < F.lit(test_start), "train").otherwise("test"))
