"""Range joins by equi-join: exploded flanks for narrow windows, coordinate bins for wide ones.

Defined cases. Null chromosomes, positions or bounds match nothing; a reversed interval matches
nothing. Both sides keep their repeated rows; interval_join tells apart the pairs that share several
bins, so a pair comes out once. Column names of the two sides must differ but for the chromosome.
cross_keys keeps repeated rows too, and a key that only one side has gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import parallelism

#: Widest flank for which each position around a query is enumerated.
EXPLODE_FLANK = 64

#: Most rows of a key that stand in one array while the pairs of two sides are shared out.
LOT = 512


def flank_join(queries: DataFrame, points: DataFrame, q_pos: str, pos: str, flank: int, chrom: str = "chrom") -> DataFrame:
    """Queries with the points within flank (inclusive) of their position.

    Only the query side is multiplied; the points are shuffled once on (chrom, pos) or (chrom, bin).
    """
    if flank <= EXPLODE_FLANK:
        near = queries.withColumn(pos, F.explode(F.sequence(F.col(q_pos) - flank, F.col(q_pos) + flank)))
        return near.join(points, [chrom, pos])
    width = 2 * flank + 1
    q = queries.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(q_pos) - flank) / width), F.floor((F.col(q_pos) + flank) / width))))
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    return q.join(p, [chrom, "_bin"]).filter(F.abs(F.col(pos) - F.col(q_pos)) <= flank).drop("_bin")


def range_join(queries: DataFrame, points: DataFrame, start: Column, end: Column, pos: str, width: int, chrom: str = "chrom") -> DataFrame:
    """Queries with the points in [start, end]."""
    q = queries.filter(start <= end).withColumn("_bin", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    return q.join(p, [chrom, "_bin"]).filter((F.col(pos) >= start) & (F.col(pos) <= end)).drop("_bin")


def interval_join(a: DataFrame, b: DataFrame, a_start: str, a_end: str, b_start: str, b_end: str, width: int, chrom: str = "chrom") -> DataFrame:
    """Pairs of closed intervals that overlap, each pair once: in the bin where the later of both begins."""
    bins = lambda df, s, e: df.filter(F.col(s) <= F.col(e)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    df = bins(a, a_start, a_end).join(bins(b, b_start, b_end), [chrom, "_bin"])
    df = df.filter((F.col(a_start) <= F.col(b_end)) & (F.col(b_start) <= F.col(a_end)))
    return df.filter(F.floor(F.greatest(a_start, b_start) / width) == F.col("_bin")).drop("_bin")


def lots(df: DataFrame, key: str, name: str, size: int = LOT) -> DataFrame:
    """The rows of each key, without the key, in arrays of at most size: key, name.

    Rows are cut by their place in ranges of the whole row, so no key, however much of the data it
    holds, is brought together in one task.
    """
    value = F.struct(*(c for c in df.columns if c != key))
    placed = df.select(key, value.alias("_row"))
    placed = placed.repartitionByRange(parallelism(df.sparkSession), key, "_row").sortWithinPartitions(key, "_row")
    cut = placed.withColumn("_lot", F.floor(F.monotonically_increasing_id() / size))
    return cut.groupBy(key, "_lot").agg(F.collect_list("_row").alias(name)).drop("_lot")


def cross_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each row of a with each row of b of the same key, without the key, where pairs are far more than rows.

    What is joined and shuffled are lots; pairs of lots are shared out evenly over the tasks, which
    write out the rows. Both sides should be written tables, as they are read twice.
    """
    pairs = lots(a, key, "_a").join(lots(b, key, "_b"), key).select("_a", "_b").repartition(parallelism(a.sparkSession))
    return pairs.select(F.inline("_a"), "_b").select(*(c for c in a.columns if c != key), F.inline("_b"))
