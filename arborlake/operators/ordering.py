"""Ordered computations that hold for a key with any share of the rows.

A window over one key puts that key into one task. Here rows are range-partitioned on
``(keys, order)`` instead, which splits a hot key; only per-partition counts are windowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.options import CHUNK_ENTRIES
from arborlake.session import materialise

_GROUP_LIMIT = 1000  # ranks up to which Spark reduces a window before its shuffle
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition below this


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def numbered(
    df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "rn"
) -> DataFrame:
    """Add ``name``: 1-based row number in ``order``, per ``keys`` when given.

    ``order`` must be total (end in a unique column). The ordered rows are written once, so the
    counts and the rows are sure to come from the same partitions.
    """
    sort_by = _columns([*keys, *order])
    ranged = (
        df.repartitionByRange(*sort_by)
        .sortWithinPartitions(*sort_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn(
            "_local",
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
        )
    )
    stored = materialise(ranged, "ordered")
    counts = stored.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first")
    )
    # at most one row per partition and key
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if not keys:
        # proven size: one row per partition of ``stored``, so the rows themselves stay in place
        offsets = F.broadcast(offsets)
    return (
        stored.join(offsets, ["_part", *keys])
        .withColumn(name, F.col("_local") - F.col("_first") + F.col("_before") + 1)
        .drop("_part", "_local", "_first", "_before")
        .select(*df.columns, name)
    )


def running_sums(
    df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column]
) -> DataFrame:
    """Add columns with the sum of an expression over all earlier rows in ``order``, the row itself left out.

    Rows are range-partitioned and written once, as in ``numbered``; what comes before a partition is
    a sum over one row a partition, and only rows of one partition are summed in one task.
    """
    sort_by = _columns(order)
    stored = materialise(
        df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        .withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id())
        .withColumns({f"_v_{name}": F.coalesce(value, F.lit(0)) for name, value in sums.items()}), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]).select(
        "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    rows = stored.withColumns({
        f"_s_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    return rows.join(F.broadcast(totals), "_part").select(  # one row a partition of ``stored``
        *df.columns, *[(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def chunk_index(
    df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (),
    chunk: int = CHUNK_ENTRIES,
) -> DataFrame:
    """Number chunks of ``chunk`` rows in order."""
    rows = numbered(df, order, keys, "_rn")
    return rows.withColumn("chunk", F.floor((F.col("_rn") - 1) / chunk).cast("long")).drop("_rn")


def last_n(
    df: DataFrame, key: str, newest_first: Sequence[Column], n: int, salts: int = 64
) -> DataFrame:
    """Newest ``n`` rows per key (a bounded buffer that drops its oldest rows).

    Two rounds: within (key, salt), then within the key over at most ``n * salts`` rows. The
    salt comes from the row itself, so a hot key spreads over tasks and the result is exact. Beyond
    the ranks that Spark cuts off before a shuffle, rows are numbered by range instead.
    """
    if n > _GROUP_LIMIT:
        return numbered(df, newest_first, [key], "_rank").filter(F.col("_rank") <= n).drop("_rank")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    near = Window.partitionBy(key, "_salt").orderBy(*newest_first)
    final = Window.partitionBy(key).orderBy(*newest_first)
    return (
        salted.withColumn("_rank", F.row_number().over(near))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_salt")
    )


def navigation(matches: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """``key, position, previous_key, next_key`` of each match, cyclic at both ends.

    Every row sends its key to its own place and to both neighbours; one grouping by place
    (at most three rows each) brings them together.
    """
    rows = numbered(matches.select(key, *[o for o in order if isinstance(o, str) and o != key]),
                    order, name="position")
    total = rows.agg(F.count(F.lit(1))).first()[0]
    place = F.col("position")
    sent = rows.select(
        F.explode(
            F.array(
                F.struct(place.alias("place"), F.lit("self").alias("role"), F.col(key).alias("k")),
                F.struct((place % total + 1).alias("place"), F.lit("previous").alias("role"),
                         F.col(key).alias("k")),
                F.struct(((place + total - 2) % total + 1).alias("place"),
                         F.lit("next").alias("role"), F.col(key).alias("k")),
            )
        ).alias("s")
    ).select("s.*")

    def of(role: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col("k")))

    return sent.groupBy(F.col("place").alias("position")).agg(
        of("self").alias(key), of("previous").alias(f"previous_{key}"), of("next").alias(f"next_{key}")
    )


_SKETCH = 10_000  # accuracy of the quantile sketch: ranks are off by one in so many rows at most


def newest_rows(df: DataFrame, n: int, by: str = "mtime_us", key: str = "path") -> DataFrame:
    """The ``n`` rows with the greatest ``(by, key)``, without sorting the table.

    A quantile sketch, merged over all tasks, gives a range of ``by`` that holds the cut. Counts on
    both sides of it are exact; only rows inside the range are ordered. Should the counts show that
    the sketch was off, the range is opened on that side. ``df`` is read three times.
    """
    total, null = df.agg(F.count(F.lit(1)), F.count_if(F.col(by).isNull())).first()
    if n >= total or n <= 0:
        return df if n >= total else df.limit(0)
    from_below = 1 - min(1.0, n / max(1, total - null))
    shares = [max(0.0, from_below - 2 / _SKETCH), min(1.0, from_below + 2 / _SKETCH)]
    low, high = df.agg(F.percentile_approx(by, shares, _SKETCH)).first()[0] or (None, None)
    if low is None:
        low = high = 0  # only nulls, which lie below everything
    value = F.col(by)
    above, reached = df.agg(F.count_if(value > high), F.count_if(value >= low)).first()
    over = F.lit(False) if above > n else F.coalesce(value > high, F.lit(False))
    under = F.lit(False) if reached < n else F.coalesce(value < low, F.lit(True))
    above = 0 if above > n else above
    inside = numbered(df.filter(~over & ~under), [F.desc_nulls_last(by), F.desc(key)], name="_newest")
    return df.filter(over).unionByName(inside.filter(F.col("_newest") <= n - above).drop("_newest"))


def oldest_rows(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` oldest rows by mtime for a report; ties go by path."""
    return df.orderBy("mtime_us", "path").limit(k)
