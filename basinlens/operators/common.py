"""Building blocks shared by the operators, written to hold under skewed keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basinlens.session import cut_lineage


def latest_by_key(df: DataFrame, keys: Sequence[str], version: Sequence[str], newest: bool = True) -> DataFrame:
    """One row per key, with the largest (or smallest) ``version``.

    An aggregation, not a window: each map task keeps one row per key, so a key
    holding a third of the input still shuffles one row per task.
    """
    payload = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in version])
    pick = (F.max_by if newest else F.min_by)(F.struct(*payload), order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def first_by_key(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    return latest_by_key(df, keys, position, newest=False)


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery (no join)."""
    packed = one_row.select(F.struct(*one_row.columns).alias("s"))
    return df.withColumn("_scalars", packed.scalar()).select(*df.columns, "_scalars.*")


BROADCAST_BYTES = 64 << 20  # that a broadcast side may take, by the widths of its values


def row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes: eight a number, the length of a text, eight an array item."""
    widths = [F.lit(16)]
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            widths.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 16)
        elif kind in ("array", "map"):
            inner = df.schema[f.name].dataType.simpleString().count(",") + 1
            widths.append(F.greatest(F.size(f.name), F.lit(0)) * 8 * inner + 24)
        else:
            widths.append(F.lit(8 * (f.dataType.simpleString().count(",") + 1)))
    return reduce(lambda a, b: a + b, widths)


def sized_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join a large ``left`` with a ``right`` made by explode or grouping.

    Size estimates do not see what an explode adds, so the planner might broadcast such a
    side at any size.  Here its bytes are added up first: up to ``limit`` it is broadcast
    and ``left`` is not shuffled, beyond it both sides are sorted and merged, where AQE
    splits skewed partitions.  Either way the rows are the same.
    """
    size = right.agg(F.coalesce(F.sum(row_bytes(right)), F.lit(0))).first()[0]
    return left.join(right.hint("broadcast" if size <= (BROADCAST_BYTES if limit is None else limit) else "merge"), list(on), how)


def global_row_number(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Dense 1-based position in a total order, without a single-partition window.

    The sorted rows are written once, which fixes which row lies in which
    partition; a row's number is its place inside the partition plus the sizes of
    the partitions before it.  Only those sizes (one row per partition) meet.
    """
    ordered = cut_lineage(df.orderBy(*order))
    # monotonically_increasing_id = partition number in the upper bits, row within it in the lower 33
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright("_mid", 33).alias("_part"),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    )
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per partition of `ordered`: bounded by the partition count, so safe to broadcast
    numbered = tagged.join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_at") + start).alias(name))


def forward_fill(
    df: DataFrame,
    value: str,
    order: str,
    partition: Sequence[str],
    chunk: Column | None = None,
    name: str | None = None,
) -> DataFrame:
    """Last non-null ``value`` at or before each row.

    With ``chunk`` (a coarser, order-preserving bucket of ``order``) a large
    partition is filled in pieces: each piece is filled on its own, and takes what
    it lacks from a table holding one carried value per piece.
    """
    name = name or value
    if chunk is None:
        w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    pieces = df.withColumn("_chunk", chunk)
    last_in_piece = pieces.groupBy(*partition, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last")
    )
    earlier = W.partitionBy(*partition).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = last_in_piece.select(
        *partition, "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    inside = W.partitionBy(*partition, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = pieces.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    joined = filled.join(carried, [*partition, "_chunk"], "left")
    out = joined.withColumn(name, F.coalesce("_inside", "_carried"))
    return out.select(*dict.fromkeys([*df.columns, name]))


def split_hot_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: str,
    counts: DataFrame | None = None,
    hot_share: float = 0.001,
    pieces: int = 64,
) -> DataFrame:
    """Inner join of ``left`` with ``right`` (unique on ``key``), hot keys of ``left`` cut into pieces.

    Keys holding more than ``hot_share`` of the rows number fewer than ``1 / hot_share``,
    which bounds the broadcast list.  Their rows are spread over ``pieces`` by the hash of
    ``spread`` and the matching right row is repeated once per piece; other keys are
    joined as they are.  ``counts`` (key, n) saves counting the left side.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    hot = attach_scalars(counts.select(key, "n"), total).where(F.col("n") > F.col("_total") * hot_share)
    hot = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    piece = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(pieces))).otherwise(F.lit(0)).cast("int")
    cut = left.join(hot, key, "left").select(*left.columns, piece.alias("_piece"))
    all_pieces = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, key, "left").select(*right.columns, F.explode(all_pieces).alias("_piece"))
    return cut.join(copied, [key, "_piece"]).drop("_piece")
