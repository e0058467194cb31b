"""Keep-one and top-k by key, and skew-safe lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldcast.session import shuffle_width


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
           rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows of each key in the given order.

    Written as ``row_number() <= k`` so Spark keeps at most ``k`` rows per key
    on the map side before it shuffles: a key with a third of all rows then
    sends ``k`` rows per task.
    """
    name = rank_col or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_by(df, keys, order, 1)


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str],
             order: Sequence[Column] = ()) -> DataFrame:
    """Rows of ``incoming`` whose key ``existing`` lacks, one per key.

    The anti-join comes first: it only drops rows, and what is already stored
    is usually most of a batch, so less reaches the deduplication. Without an
    ``order`` the row of the least hash stays. That is an aggregate over rows
    which the join has sorted by key: a task holds one of them, where a window
    would sort and hold all of its rows once more.
    """
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti")
    if order:
        return keep_first(fresh, keys, order)
    row = F.struct(*incoming.columns)
    return (fresh.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*incoming.columns)).alias("_row"))
            .select("_row.*"))


def salted_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str,
                spread: Column, hot: Column, salts: int | None = None) -> DataFrame:
    """Join a fact to a dimension whose key is unique, its hot keys over sub-keys.

    For keys known to be hot by construction, such as one pooled site that
    stands for half of all outings. ``hot`` tells them by the join columns;
    only their dimension rows are repeated. ``spread`` should vary within a key.
    There is a sub-key per shuffle partition unless ``salts`` says otherwise, so
    a hot key spreads as wide as its shuffle.
    """
    n = F.lit(salts or shuffle_width(fact.sparkSession))
    left = fact.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread), n)).otherwise(0).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), n - 1))
                                              .otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
