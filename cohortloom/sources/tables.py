"""Manifests, metadata, query files and result tables.

Defined cases. The first line of each manifest is its header; blank lines are skipped; a sample listed again
collapses into its first row (smallest line). Metadata are text; attributes that only one side of a
merge has are NA on the other. BED lines that are blank, start with # or lack fields are skipped.
Strings for positions must fit their form, else ValueError. A sample in two result tables is an
error. Missing cells of a wide table are written as the given text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.genome import bare_chrom, number, split_fields
from ..operators import stats
from ..session import bounded_broadcast, durable, from_nth, parallelism

NAME = r"[^:,\s]+"


def read_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sample_id (by file, then by line), name, path and attrs (a map) of manifests, each with its own header line."""
    at = F.monotonically_increasing_id()
    lines = durable(spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), at.alias("line"), "value").filter(F.trim("value") != ""))
    heads = lines.groupBy("file").agg(F.min_by("value", "line").alias("header"), F.min("line").alias("head_line"))
    n = heads.agg(F.count("*").alias("n"), F.min(F.size(split_fields(F.col("header")))).alias("least")).first()
    if n["n"] == 0:
        raise ValueError("empty manifest")
    if n["least"] < 2:
        raise ValueError("a manifest has at least two columns")
    df = lines.join(bounded_broadcast(heads), "file").filter("line <> head_line")
    df = df.withColumn("f", split_fields(F.col("value"))).withColumn("h", split_fields(F.col("header")))
    df = df.select("line", "h", F.when(F.size("f") == F.size("h"), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("line does not fit the header: "), "value"))).alias("f"))
    attrs = F.map_from_entries(F.arrays_zip(F.array_distinct(from_nth("h", 3)), F.filter(from_nth("f", 3), lambda _, i: F.array_position(from_nth("h", 3), F.get("h", i + 2)) == i + 1)))
    one = df.select("line", F.col("f")[0].alias("name"), F.col("f")[1].alias("path"), F.map_entries(attrs).alias("attrs"))
    one = one.groupBy("name").agg(F.min(F.struct("line", "path", "attrs")).alias("r")).select("name", "r.line", "r.path", F.map_from_entries("r.attrs").alias("attrs"))
    return number_rows(one, "line").select((F.col("row_no") - 1).alias("sample_id"), "name", "path", "attrs")


def duplicate_samples(meta: DataFrame, name: str = "name") -> DataFrame:
    """Names listed more than once: name, n."""
    return meta.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1")


def missing_paths(meta: DataFrame, path: str = "path") -> list[str]:
    """Paths of samples at which there is nothing; one look a sample."""
    spark = meta.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return [p for (p,) in meta.select(path).distinct().orderBy(path).collect() if p is None or not at(p).getFileSystem(conf).exists(at(p))]


def validate_meta(meta: DataFrame) -> DataFrame:
    """The metadata without the path; ValueError if a name is listed twice or a path leads nowhere."""
    if twice := [r["name"] for r in duplicate_samples(meta).orderBy("name").collect()]:
        raise ValueError(f"samples listed more than once: {twice}")
    if gone := missing_paths(meta):
        raise ValueError(f"paths that do not exist: {gone}")
    return meta.drop("path")


def write_meta(meta: DataFrame, path: str) -> None:
    """Metadata (name, path, attrs) as a tab-separated table with a header; attributes that a sample lacks are NA."""
    keys = sorted(r[0] for r in meta.select(F.explode(F.map_keys("attrs"))).distinct().collect())
    rows = meta.select("name", "path", *(F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit("NA")).alias(k) for k in keys))
    write_lines(rows, ["\t".join(["Sample", "Path", *keys])], F.concat_ws("\t", *(F.col(f"`{c}`") for c in rows.columns)), ["name"], path, "none")


def write_lines(df: DataFrame, head: list[str], line: Column, order: list[str], path: str, compression: str = "gzip") -> None:
    """Text in parts over ranges of the order, the head first; one after the other the parts are the file."""
    rows = df.select(F.struct(F.lit(1).alias("_row"), F.lit(0).alias("_line"), *order).alias("_at"), line.alias("value"))
    none = [F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in order]
    lines = df.sparkSession.createDataFrame(list(enumerate(head)), "_line int, value string").select(F.struct(F.lit(0).alias("_row"), "_line", *none).alias("_at"), "value")
    lines.unionByName(rows).repartitionByRange("_at").sortWithinPartitions("_at").select("value").write.mode("overwrite").text(path, compression=compression)


def merge_meta(a: DataFrame, b: DataFrame, fill: str = "NA") -> DataFrame:
    """Rows of both with the columns of both; what one side lacks is `fill`."""
    return a.unionByName(b, allowMissingColumns=True).fillna(fill)


def split_manifest(manifest: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with their shard (from 1), size rows each in the given order; nulls come last, equal keys in a fixed order.

    Row numbers come from range partitions and their offsets, not from one sorted task.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    return number_rows(manifest, order).withColumn("shard", (F.floor((F.col("row_no") - 1) / size) + 1).cast("bigint")).drop("row_no")


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """row_no from 1 in the order of a column of any type; nulls last, equal keys by a hash of the row.

    Rows are range-partitioned, sorted within their partition and written once with their place in
    it; the counts of earlier partitions are added. A key that holds much of the data is spread by
    the hash, and so are nulls.
    """
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    key = [F.col(order).asc_nulls_last(), F.xxhash64(*hashed).asc()]
    placed = df.repartitionByRange(parallelism(df.sparkSession), *key).sortWithinPartitions(*key)
    placed = durable(placed.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    numbered = placed.join(F.broadcast(before), "_part")
    return numbered.withColumn("row_no", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_off") + 1).drop("_part", "_at", "_off")


def bed_pairs(lines: DataFrame, value: str = "value", ordered: bool = True) -> DataFrame:
    """chr1, pos1, chr2, pos2, id, rest of BED lines; with ordered, the smaller position comes first."""
    f = F.split(value, "\t", -1)
    df = lines.filter((F.trim(value) != "") & ~F.col(value).startswith("#")).select(f.alias("f")).filter(F.size("f") >= 5)
    g = lambda i: F.col("f")[i]
    df = df.select(bare_chrom(g(0)).alias("c1"), g(1).try_cast("bigint").alias("p1"), bare_chrom(g(2)).alias("c2"), g(3).try_cast("bigint").alias("p2"), g(4).alias("id"), F.array_join(from_nth("f", 6), "\t").alias("rest"))
    df = df.filter("p1 is not null and p2 is not null")
    swap = (F.col("p1") > F.col("p2")) if ordered else F.lit(False)
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return df.select(pick("c1", "c2").alias("chr1"), pick("p1", "p2").alias("pos1"), pick("c2", "c1").alias("chr2"), pick("p2", "p1").alias("pos2"), "id", "rest")


def _match(form: str, text: str) -> tuple:
    m = re.fullmatch(form, text.replace(" ", ""))
    if not m:
        raise ValueError(f"not of the form asked for: {text}")
    return m.groups()


def _bare(c: str) -> str:
    return re.sub("^(CHR)+", "", c.upper())


def parse_junction(text: str) -> tuple[str, int, int]:
    """chr:pos,pos"""
    c, a, b = _match(rf"({NAME}):(\d+),(\d+)", text)
    return _bare(c), min(int(a), int(b)), max(int(a), int(b))


def parse_breakpoints(text: str) -> tuple[str, int, str, int]:
    """chr:pos,chr:pos"""
    c, a, d, b = _match(rf"({NAME}):(\d+),({NAME}):(\d+)", text)
    return _bare(c), int(a), _bare(d), int(b)


def parse_regions(text: str) -> tuple[str, int, int, str, int, int]:
    """chr:s-e,chr:s-e"""
    c, a, b, d, e, f = _match(rf"({NAME}):(\d+)-(\d+),({NAME}):(\d+)-(\d+)", text)
    if int(a) > int(b) or int(e) > int(f):
        raise ValueError(f"a region ends before it starts: {text}")
    return _bare(c), int(a), int(b), _bare(d), int(e), int(f)


def region_query(chr1: str, s1: int, e1: int, chr2: str, s2: int, e2: int) -> tuple[str, int, int, str, int, int]:
    """Centre and half width of both regions by integer division; an odd width loses a position, so lookups use the bounds."""
    return chr1, (s1 + e1) // 2, (e1 - s1) // 2, chr2, (s2 + e2) // 2, (e2 - s2) // 2


def is_single_bp(s1: int, e1: int, s2: int, e2: int) -> bool:
    """Both regions are one position."""
    return s1 == e1 and s2 == e2


def trim_prefix(text: str, prefix: str | None) -> str:
    """Text without the prefix, however often it is repeated."""
    while prefix and text.startswith(prefix):
        text = text[len(prefix) :]
    return text


def add_prefix(text: str, prefix: str | None) -> str:
    return (prefix or "") + text


def add_gz_suffix(path: str) -> str:
    """Path that ends with .gz; a final dot is not doubled."""
    return path if re.search(r"[^/]\.gz$", path) else path + ("gz" if re.search(r"[^/]\.$", path) else ".gz")


def wide(df: DataFrame, keys: list[str], sample: str, cell: str, samples: list[str], missing: str = "0:0:NULL") -> DataFrame:
    """Long results with one column a sample; the list of samples is given, so nothing is scanned to find it."""
    return df.groupBy(*keys).pivot(sample, samples).agg(F.first(cell)).fillna(missing, samples)


def long(df: DataFrame, keys: list[str], samples: list[str], cell: str = "cell") -> DataFrame:
    """Wide results as keys, sample, cell."""
    return df.unpivot(keys, samples, "sample", cell)


def write_result_table(df: DataFrame, keys: list[str], samples: list[str], totals: dict[str, int], fmt: str, path: str, meta: list[str] = (), order: str | None = None, labels: dict[str, str] | None = None) -> None:
    """A wide result as gzipped text: ##[SAMPLE] lines, ##[DBINFO], header with FORMAT, rows in the given order (else by the keys).

    Parts are written in parallel over ranges of the order; one after the other they are the file, as
    gzipped texts may follow each other.
    """
    head = [f"##[SAMPLE]{m}" for m in meta] + ["##[DBINFO]" + ",".join(f"{s}:{totals.get(s, 0)}" for s in samples), "#" + "\t".join([*((labels or {}).get(k, k) for k in keys), "FORMAT", *samples])]
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    write_lines(df, head, F.concat_ws("\t", *map(text, keys), F.lit(fmt), *map(text, samples)), [order] if order else keys, path)


def read_result_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int], list[str], list[str]]:
    """The rows in long form (keys, sample, cell), totals by sample, keys and samples of such a text."""
    text = spark.read.text(path)
    info = text.filter(F.col("value").startswith("#")).collect()
    head = next(r[0][1:].split("\t") for r in info if r[0].startswith("#") and not r[0].startswith("##"))
    at = head.index("FORMAT")
    keys, samples = head[:at], head[at + 1 :]
    totals = {k: int(v) for r in info if r[0].startswith("##[DBINFO]") for k, v in (p.rsplit(":", 1) for p in r[0][10:].split(",") if p)}
    f = F.split("value", "\t", -1)
    df = text.filter(~F.col("value").startswith("#")).select(f.alias("f"))
    cells = F.arrays_zip(F.array(*(F.lit(s) for s in samples)).alias("sample"), F.slice("f", at + 2, len(samples)).alias("cell"))
    df = df.select(*(F.col("f")[i].alias(k) for i, k in enumerate(keys)), F.explode(cells).alias("c"))
    return df.select(*keys, "c.sample", "c.cell"), totals, keys, samples


def merge_results(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Long results of two tables in one; a sample in both is an error that the job raises."""
    both = a.select(*keys, "sample", "cell", F.lit(1).alias("src")).unionByName(b.select(*keys, "sample", "cell", F.lit(2).alias("src")))
    one = both.groupBy(*keys, "sample").agg(F.first("cell").alias("cell"), F.countDistinct("src").alias("n"))
    return one.select(*keys, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("sample in both tables: "), "sample"))).otherwise(F.col("sample")).alias("sample"), "cell")


def merge_isoform(a: DataFrame, b: DataFrame, keys: list[str], totals_a: dict[str, int], totals_b: dict[str, int]) -> DataFrame:
    """Isoform results of two tables in one: keys, detected, positives, confidence, sample, cell.

    Each table is long with keys (the fixed fields), positives (a:b:c/n), sample and cell, and has every
    sample of its totals in each row; COUNT is part 1 of a cell. Positives are summed part by part,
    detected follows them, and confidence is computed anew over the samples of both. A sample in both,
    rows that do not align and cells without a count are errors.
    """
    if shared := sorted(set(totals_a) & set(totals_b)):
        raise ValueError(f"samples in both tables: {shared}")
    totals = totals_a | totals_b
    side = lambda df, n: df.select(F.struct(*keys).alias("_key"), "positives", "sample", "cell", F.lit(n).alias("_src"))
    both = side(a, 1).unionByName(side(b, 2))
    total = a.sparkSession.createDataFrame(list(totals.items()), "sample string, _total bigint")
    both = both.join(F.broadcast(total), "sample", "left")
    x = cell_part(F.col("cell"), 1)
    both = both.withColumn("_x", F.when(x.isNull() | F.col("_total").isNull(), F.raise_error(F.concat(F.lit("no count or no total: "), "sample"))).otherwise(x))
    of = lambda n: F.max(F.when(F.col("_src") == n, F.col("positives")))
    head = both.groupBy("_key").agg(F.countDistinct("_src", "sample").alias("_d"), F.count("*").alias("_n"), F.countDistinct("_src", "positives").alias("_p"), of(1).alias("_a"), of(2).alias("_b"))
    fits = (F.col("_d") == len(totals)) & (F.col("_n") == len(totals)) & (F.col("_p") == 2)
    counts = lambda c: F.transform(F.split(F.split_part(F.col(c), F.lit("/"), F.lit(1)), ":"), lambda v: v.cast("bigint"))
    head = head.withColumn("_sum", F.when(fits, F.zip_with(counts("_a"), counts("_b"), lambda v, w: v + w)).otherwise(F.raise_error(F.concat(F.lit("rows do not align: "), F.to_json("_key")))))
    detected = F.array_join(F.transform("_sum", lambda v: F.when(v > 0, "yes").otherwise("no")), ":")
    positives = F.concat(F.array_join("_sum", ":"), F.lit(f"/{len(totals)}"))
    head = head.select("_key", detected.alias("detected"), positives.alias("positives"))
    df = both.select("_key", "sample", "cell").join(head, "_key").join(stats.confidence(both, "_key", "_x", "_total", len(totals)), "_key")
    return df.select("_key.*", "detected", "positives", "confidence", "sample", "cell")


def cell_part(cell: Column, i: int) -> Column:
    """Part i (from 0) of a cell a:b:c as a number; null if it is none."""
    return number(F.get(F.split(cell, ":"), F.lit(i)))
