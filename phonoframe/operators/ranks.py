"""Order-dependent building blocks that stay parallel when one key is hot.

A plain ``sum().over(partitionBy(key).orderBy(...))`` sends every row of a key to
one task. Here rows are first put into coarse buckets that respect the order, the
buckets are pre-aggregated, offsets are accumulated over the (few) buckets, and
only the rows of one bucket are ordered together. Where most keys have few rows, only
the keys with many are treated so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.functions.scalar import col
from phonoframe.operators.storage import settle

FINE = 256
GROUPED = 4096
HOT_ROWS = 1 << 18
"""A key with more rows than this is ordered bucket by bucket."""


def value_bucket(x: Column | str, resolution: int = FINE) -> Column:
    """A bucket that never decreases as ``x`` grows: signed log2 in small steps."""
    v = col(x).cast("double")
    size = F.floor(F.log2(F.lit(1.0) + F.abs(v) * F.lit(1024.0)) * F.lit(float(resolution)))
    return F.when(v < 0, -size).otherwise(size)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys, keeping the left columns once."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    sums: dict[str, Column],
    bucket: Column,
    sparse: bool | DataFrame = False,
) -> DataFrame:
    """Add inclusive running sums per key in the given order.

    ``bucket`` must never decrease along ``order``. One bucket of one key is the
    unit of work, so a hot key is spread over its buckets. ``sparse`` says that most keys
    have few rows: keys are counted first, and those of up to ``HOT_ROWS`` rows take one
    window, which moves each row once. It may also be the ``hot_keys`` of rows that these were made
    of, so that they are not made once more for the count.
    """
    order = [col(o) for o in order]
    if sparse is not False:
        hot = hot_keys(df, keys) if sparse is True else sparse
        if hot.isEmpty():
            return _in_one_window(df, keys, order, sums)
        spread = running(join_keys(df, F.broadcast(hot), keys, "left_semi"), keys, order, sums, bucket)
        rest = join_keys(df, F.broadcast(hot), keys, "left_anti")
        return _in_one_window(rest, keys, order, sums).unionByName(spread)
    rows = df.withColumns({"_bucket": bucket, **{f"_v_{n}": c for n, c in sums.items()}})
    parts = rows.groupBy(*keys, "_bucket").agg(
        *[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums]
    )
    offsets = _offsets(parts, keys, list(sums))
    local = (
        W.partitionBy(*keys, "_bucket").orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    joined = join_keys(rows, offsets, [*keys, "_bucket"])
    return joined.withColumns(
        {n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(local) for n in sums}
    ).drop("_bucket", *[f"_{p}_{n}" for n in sums for p in "vo"])


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of more than ``HOT_ROWS`` rows, counted once."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return settle(counts.filter(F.col("_rows") > HOT_ROWS).select(*keys))


def _in_one_window(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})


def _offsets(parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """What comes before each bucket of a key.

    Whole-number buckets are summed in groups of ``GROUPED`` first, so that only the sums of groups
    are ordered in one task and not one row for every bucket.
    """
    def before(frame: DataFrame, within: list[str], order: str, source: str, out: str) -> DataFrame:
        w = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return frame.withColumns({
            f"{out}{n}": F.coalesce(F.sum(f"{source}{n}").over(w), F.lit(0)) for n in names})

    if not isinstance(parts.schema["_bucket"].dataType, T.IntegralType):
        return before(parts, keys, "_bucket", "_p_", "_o_").drop(*[f"_p_{n}" for n in names])
    grouped = parts.withColumn("_group", F.floor(F.col("_bucket") / GROUPED))
    inner = before(grouped, [*keys, "_group"], "_bucket", "_p_", "_i_")
    totals = grouped.groupBy(*keys, "_group").agg(*[F.sum(f"_p_{n}").alias(f"_t_{n}") for n in names])
    outer = before(totals, keys, "_group", "_t_", "_u_").drop(*[f"_t_{n}" for n in names])
    joined = join_keys(inner, outer, [*keys, "_group"])
    return joined.select(*keys, "_bucket", *[(F.col(f"_i_{n}") + F.col(f"_u_{n}")).alias(f"_o_{n}") for n in names])


def row_index(
    df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, name: str, sparse: bool = False
) -> DataFrame:
    """Add a 1-based row number per key."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, bucket, sparse)


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows per key. The rank filter lets Spark limit each group before the
    shuffle, so a hot key moves at most k rows per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def positions(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]
) -> DataFrame:
    """Exact order statistics per key without collecting a key in one task.

    ``ranks`` maps an output name to a 0-based (possibly fractional) position as an
    expression over ``n``; fractional positions interpolate linearly. Equal values
    are counted once, so heavy ties collapse before any ordering.
    """
    dist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cum = running(dist, keys, [value], {"_upto": F.col("_c")}, value_bucket(value))
    sizes = dist.groupBy(*keys).agg(F.sum("_c").alias("n"))
    rows = join_keys(cum, sizes, keys)
    aggs, outs = [], []
    for name, position in ranks.items():
        low, high = F.floor(position), F.ceil(position)
        for tag, idx in (("lo", low), ("hi", high)):
            hit = (F.col("_upto") - F.col("_c") <= idx) & (idx < F.col("_upto"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(position - low).cast("double").alias(f"_f_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * F.col(f"_f_{name}")).alias(name))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *aggs).select(*keys, "n", *outs)


def median_rank() -> Column:
    return (F.col("n") - 1) * F.lit(0.5)


def percentile_rank(p: float) -> Column:
    return (F.col("n") - 1) * F.lit(p / 100.0)


def chunked(
    df: DataFrame, position: Column | str, halo: Column | float, size: float = 4096
) -> DataFrame:
    """Copy rows near a chunk edge into every chunk that they can reach.

    Adds ``_chunk`` and ``_own``; windows over (key, _chunk) then see all rows within ``halo`` of
    ``position`` on both sides, and rows with ``_own`` carry the final values. ``position`` may be a
    frame number or a time; ``halo`` and ``size`` are in its unit.
    """
    p = col(position)
    h = halo if isinstance(halo, Column) else F.lit(halo)
    home = F.floor(p / size)
    spots = F.sequence(F.floor((p - h) / size), F.floor((p + h) / size))
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(spots)).withColumn(
        "_own", F.col("_chunk") == F.col("_home")
    ).drop("_home")


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_chunk", "_own")
