"""Per-key results though a few keys hold most records: exact offset chunking.

Records are dealt into buckets by a hash of their id, which no key can skew; that is the only time
whole records are shuffled, and where repeated deliveries meet and are dropped. Within a bucket the
records of each key are numbered. The prefix sum of a key's counts over the buckets is the offset of
a bucket's first record within its key, so every record gets its exact number in the key without
the key ever meeting in one task. Number // chunk_rows is its chunk: all chunks but a key's last
have chunk_rows records. Each chunk is reduced to a state: its first and last number, its count and
its sums, which are added up map-side, in fixed-width blocks of vector positions. The states of a
key join up in the order of their chunks, which is checked, and are merged.

Defined cases. A record with a null key column has no key and is left out. A record delivered
twice (same id) counts once. Null evidence counts 0; a null vector counts as no samples; a shorter
vector counts 0 for the samples it lacks; keys without any vector get an empty list. Empty tables
give an empty result. A record without an id counts once for all such records of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, parallelism

#: Records of a chunk.
CHUNK_ROWS = 50_000
#: Vector positions that are summed in one row.
BLOCK = 32
#: Buckets a shuffle partition.
BUCKETS = 4


def in_buckets(df: DataFrame, key: list[str], row_id: str, buckets: int | None = None) -> DataFrame:
    """Records with a key, once each, with their `bucket`; one shuffle, by the bucket."""
    for c in key:
        df = df.filter(F.col(c).isNotNull())
    n = buckets or BUCKETS * parallelism(df.sparkSession)
    df = df.withColumn("bucket", F.pmod(F.xxhash64(row_id, F.when(F.col(row_id).isNull(), F.xxhash64(*key))), F.lit(n)).cast("int")).repartition("bucket")
    again = Window.partitionBy("bucket", row_id, *key).orderBy(F.lit(0))
    return df.withColumn("_again", F.row_number().over(again)).filter("_again = 1").drop("_again")


def offsets(counts: DataFrame, key: list[str]) -> DataFrame:
    """The counts (key, bucket, n) with `first_no`, the number of the bucket's first record in the key: a prefix sum over buckets."""
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def number_in_key(df: DataFrame, key: list[str], row_id: str, buckets: int | None = None) -> DataFrame:
    """Records with a key, once each, with `n_in_key`: their number in the key, from 0, in (bucket, id) order."""
    within = Window.partitionBy("bucket", *key).orderBy(row_id)
    placed = durable(in_buckets(df, key, row_id, buckets).withColumn("_at", F.row_number().over(within) - 1))
    counts = placed.groupBy(*key, "bucket").agg((F.max("_at") + 1).cast("bigint").alias("n"))
    # the first bucket of a key starts at 0: only the others have an offset to fetch
    start = offsets(counts, key).filter("first_no > 0").select(*key, "bucket", "first_no")
    return placed.join(start, [*key, "bucket"], "left").withColumn("n_in_key", F.col("_at") + F.coalesce("first_no", F.lit(0))).drop("first_no", "bucket", "_at")


def merged(states: DataFrame, key: list[str]) -> DataFrame:
    """Chunk states (key, chunk, first, last) as n_records and n_chunks of each key; states that don't join up raise an error."""
    one = states.groupBy(*key).agg((F.max("last") + 1).alias("n_records"), F.countDistinct("chunk").alias("n_chunks"), F.sum("n").alias("_sum"))
    ok = F.col("_sum") == F.col("n_records")
    return one.select(*key, F.when(ok, F.col("n_records")).otherwise(F.raise_error(F.lit("chunks do not join up"))).alias("n_records"), "n_chunks")


def cohort_records(pnir: DataFrame, chunk_rows: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """One row per (signature, chrom_id): n_records, total_evidence, sample_evidence (sums per sample), n_chunks.

    Vectors are cut into blocks of BLOCK positions, so a row of any width is summed in fixed-width
    buffers before the shuffle; neither a chunk nor a key is ever collected.
    """
    key = ["signature", "chrom_id"]
    df = pnir.select("rec_id", *key, "total_evidence", "sample_evidence_arr")
    df = number_in_key(df, key, "rec_id", buckets).withColumn("chunk", F.floor(F.col("n_in_key") / chunk_rows))
    width = F.greatest(F.coalesce(F.size("sample_evidence_arr"), F.lit(0)), F.lit(0))
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(width / BLOCK).cast("int") - 1, F.lit(0)))
    df = df.select(*key, "chunk", "n_in_key", "total_evidence", "sample_evidence_arr", width.alias("width"), F.explode(blocks).alias("block"))
    cell = lambda i: F.coalesce(F.get("sample_evidence_arr", F.col("block") * BLOCK + i), F.lit(0))
    head = F.col("block") == 0
    sums = [F.sum(cell(i)).alias(f"v{i}") for i in range(BLOCK)]
    states = df.groupBy(*key, "chunk", "block").agg(
        F.count_if(head).alias("n"), F.max(F.when(head, F.col("n_in_key"))).alias("last"), F.sum(F.when(head, F.col("total_evidence"))).alias("total"), F.max("width").alias("width"), *sums
    )
    blocks_of = states.groupBy(*key, "block").agg(
        F.sum("n").alias("n"), F.max("last").alias("last"), F.count_if(F.col("n") > 0).alias("n_chunks"), F.sum("total").alias("total"), F.max("width").alias("width"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(BLOCK))
    )
    one = blocks_of.groupBy(*key).agg(
        F.sum("n").alias("n"), F.max("last").alias("last"), F.max("n_chunks").alias("n_chunks"), F.sum("total").alias("total"), F.max("width").alias("width"),
        F.array_sort(F.collect_list(F.struct("block", F.array(*(f"v{i}" for i in range(BLOCK))).alias("v")))).alias("blocks"),
    )
    n = F.when(F.col("n") == F.col("last") + 1, F.col("n")).otherwise(F.raise_error(F.lit("chunks do not join up")))
    vector = F.slice(F.flatten(F.transform("blocks", lambda b: b["v"])), F.lit(1), F.col("width"))
    return one.select(*key, n.alias("n_records"), F.coalesce("total", F.lit(0)).alias("total_evidence"), vector.alias("sample_evidence"), "n_chunks")


def key_counts(df: DataFrame, key: list[str], row_id: str, chunk_rows: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """Number of distinct records of each key, merged from the ordered states of its chunks.

    A bucket's records of a key are the numbers from its offset on, so they are cut into chunk
    states without numbering each; a chunk that spans buckets has a state in each of them.
    """
    counts = in_buckets(df.select(row_id, *key), key, row_id, buckets).groupBy("bucket", *key).agg(F.count("*").alias("n"))
    runs = offsets(counts, key).withColumn("last_no", F.col("first_no") + F.col("n") - 1)
    cuts = F.explode(F.sequence(F.floor(F.col("first_no") / chunk_rows), F.floor(F.col("last_no") / chunk_rows)))
    parts = runs.select(*key, "first_no", "last_no", cuts.alias("chunk"))
    first = F.greatest(F.col("first_no"), F.col("chunk") * chunk_rows)
    last = F.least(F.col("last_no"), (F.col("chunk") + 1) * chunk_rows - 1)
    states = parts.select(*key, "chunk", last.alias("last"), (last - first + 1).alias("n"))
    return merged(states.groupBy(*key, "chunk").agg(F.max("last").alias("last"), F.sum("n").alias("n")), key)


def hot_keys(pnir: DataFrame, percent: int = 1) -> DataFrame:
    """Keys that hold at least `percent` of the distinct records with a key.

    The counts are written once and used twice: for the total, one number, and for the filter.
    """
    counts = durable(key_counts(pnir, ["signature", "chrom_id"], "rec_id"))
    total = counts.agg(F.sum("n_records").alias("n")).first()["n"] or 0
    return counts.filter(F.col("n_records") * 100 >= percent * total).select("signature", "chrom_id")
