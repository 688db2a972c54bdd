"""Rows that fail to parse: strict load, anti-join against the raw offsets, diagnosis of the rest.

A raw line has an offset that identifies it (`line_id`). The strict load keeps only lines that
conform in full and gives them types. Subtracting its offsets from the raw ones leaves the failed
lines, and only those are diagnosed: nothing is lost and nothing counts twice. Only offsets are
shuffled for it; headers, one row a file, are broadcast where they are shown to be few.

Defined cases. Null and blank lines, comments and headers are no records: they are in neither
result. One final carriage return belongs to the line end. A line delivered twice (same offset)
counts once. A line without an offset cannot be told from others: it is not loaded and comes out as
failed, once for all such lines. Empty tables give empty results. Columns beyond those named here are not read, so
clashing names cannot arise. All patterns are possessive: a line of any length is scanned once,
without backtracking or recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genome import bare_chrom
from ..session import bounded_broadcast, durable

#: One field after its tab: quoted to the next quote that isn't doubled, or plain, or empty.
FIELD = r'\t("[^"]*+(?:""[^"]*+)*+"(?=\t|\z)|[^"\t][^\t]*+|)'
#: A whole line, with a tab put before it, whose quotes are in order.
WELL_QUOTED = r'\A(?:\t(?:"[^"]*+(?:""[^"]*+)*+"(?=\t|\z)|[^"\t][^\t]*+|(?=\t|\z)))*+\z'
PATH = r"\A[A-Za-z0-9_./-]*\.isoform\.gz\z"
BLANK = r"\A\s*+\z"


def line_body(raw: Column) -> Column:
    """The line without one final carriage return."""
    return F.regexp_replace(raw, r"\r\z", "")


def tab_fields(body: Column) -> Column:
    """Fields of a well quoted line, enclosing quotes taken off and doubled quotes made single."""
    found = F.regexp_extract_all(F.concat(F.lit("\t"), body), F.lit(FIELD), 1)
    return F.transform(
        found,
        lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x),
    )


def quoting_ok(body: Column) -> Column:
    return F.concat(F.lit("\t"), body).rlike(WELL_QUOTED)


def space_fields(body: Column) -> Column:
    return F.split(F.regexp_replace(body, r"\A\s+|\s+\z", ""), r"\s+", -1)


def spaces_off(c: Column) -> Column:
    return F.regexp_replace(c, r"\A +| +\z", "")


def fusion_lines(fusion_raw: DataFrame) -> DataFrame:
    """Raw fusion lines that are records, as delivered: offset and line body."""
    df = fusion_raw.select("line_id", line_body(F.col("raw_line")).alias("body"))
    return df.filter(F.col("body").isNotNull() & ~F.col("body").rlike(BLANK) & ~F.col("body").startswith("#"))


def manifest_headers(manifest_raw: DataFrame) -> DataFrame:
    """One row a file: series, file_no, column names (no byte-order mark, blanks or quotes) and their number."""
    df = manifest_raw.filter(F.col("line_no") == 1).select("series", "file_no", F.regexp_replace(line_body(F.col("raw_line")), "^﻿", "").alias("body"))
    tabbed = F.when(quoting_ok(F.col("body")), tab_fields(F.col("body"))).otherwise(F.split(F.col("body"), "\t", -1))
    fields = F.when(F.col("body").contains("\t"), tabbed).otherwise(space_fields(F.col("body")))
    names = F.transform(fields, lambda x: F.regexp_replace(F.regexp_replace(x, r"\A\s+|\s+\z", ""), r'\A"(.*)"\z', "$1"))
    df = df.select("series", "file_no", F.transform(names, lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")).alias("names"))
    return df.groupBy("series", "file_no").agg(F.min("names").alias("names")).withColumn("n_cols", F.size("names"))


def manifest_lines(manifest_raw: DataFrame) -> DataFrame:
    """Raw manifest lines that are records, as delivered: offset, file key and line body."""
    df = manifest_raw.filter(F.coalesce(F.col("line_no"), F.lit(0)) != 1)
    df = df.select("line_id", "series", "file_no", line_body(F.col("raw_line")).alias("body"))
    return df.filter(F.col("body").isNotNull() & ~F.col("body").rlike(BLANK))


def fusion_records(fusion_raw: DataFrame) -> DataFrame:
    """Raw fusion lines that are records, each offset once."""
    return fusion_lines(fusion_raw).dropDuplicates(["line_id"])


def manifest_records(manifest_raw: DataFrame) -> DataFrame:
    """Raw manifest lines that are records, each offset once."""
    return manifest_lines(manifest_raw).dropDuplicates(["line_id"])


def _position(c: Column) -> Column:
    """Digits as a bigint, null if there are none, others, or a number above every bigint, as lengths are bigints."""
    return F.when(c.rlike(r"\A[0-9]++\z"), c.try_cast("bigint"))


def conforming_fusion(fusion_raw: DataFrame, chrom_map: DataFrame) -> DataFrame:
    """The raw fusion lines that conform, typed; a line delivered twice is still there twice."""
    known = chrom_map.filter(F.col("chrom").isNotNull()).groupBy("chrom").agg(F.max("chrom_len").alias("chrom_len"))
    known = bounded_broadcast(known)
    df = fusion_lines(fusion_raw).filter(F.col("line_id").isNotNull() & quoting_ok(F.col("body"))).select("line_id", tab_fields(F.col("body")).alias("f"))
    df = df.filter(F.size("f").isin(5, 6))
    g = lambda i: spaces_off(F.get("f", F.lit(i)))
    df = df.select(
        "line_id", bare_chrom(g(0)).alias("left_chr"), _position(g(1)).alias("left_pos"), bare_chrom(g(2)).alias("right_chr"),
        _position(g(3)).alias("right_pos"), g(4).alias("idstring"), g(5).alias("note"),
    )
    df = df.filter((F.col("idstring") != "") & F.col("left_pos").isNotNull() & F.col("right_pos").isNotNull())
    left = known.select(F.col("chrom").alias("left_chr"), F.col("chrom_len").alias("left_len"))
    right = known.select(F.col("chrom").alias("right_chr"), F.col("chrom_len").alias("right_len"))
    df = df.join(left, "left_chr").join(right, "right_chr").filter("left_pos <= left_len and right_pos <= right_len")
    return df.select("line_id", "left_chr", "left_pos", "right_chr", "right_pos", "idstring", "note")


def conforming_manifest(manifest_raw: DataFrame, headers: DataFrame) -> DataFrame:
    """The raw manifest lines that conform, cut into values; a line delivered twice is still there twice."""
    b = F.col("body")
    df = manifest_lines(manifest_raw).filter(F.col("line_id").isNotNull()).withColumn("tabbed", b.contains("\t")).filter(~F.col("tabbed") | quoting_ok(b))
    df = df.withColumn("values", F.when(F.col("tabbed"), tab_fields(b)).otherwise(space_fields(b))).drop("body", "tabbed")
    df = df.join(headers, ["series", "file_no"]).filter(F.size("values") == F.col("n_cols"))
    df = df.withColumn("values", F.transform("values", spaces_off))
    df = df.withColumn("sample", F.get("values", F.lit(0))).withColumn("path", F.get("values", F.lit(1)))
    return df.filter((F.col("sample") != "") & F.col("path").rlike(PATH)).select("line_id", "series", "file_no", "names", "sample", "path", "values")


def load_fusion(fusion_raw: DataFrame, chrom_map: DataFrame) -> DataFrame:
    """Strict load of fusion lines: line_id, left_chr, left_pos, right_chr, right_pos, idstring, note.

    A line conforms if its quotes are in order, it has 5 or 6 fields, both chromosomes are in
    chrom_map, both positions are ASCII digits not above the chromosome's length, and the id is
    not empty.
    """
    return conforming_fusion(fusion_raw, chrom_map).dropDuplicates(["line_id"])


def load_manifest(manifest_raw: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Strict load of manifest lines: line_id, series, file_no, names, sample, path, values.

    A line conforms if its quotes are in order (lines with a tab only), it has as many fields as
    its file's header, the sample is not empty and the path is one of an .isoform.gz file. `values`
    holds all fields in the order of `names`.
    """
    headers = durable(manifest_headers(manifest_raw)) if headers is None else headers
    return conforming_manifest(manifest_raw, headers).dropDuplicates(["line_id"])


def remainder(records: DataFrame, loaded: DataFrame) -> DataFrame:
    """Records whose offset the strict load lacks, each offset once.

    Offsets are subtracted from offsets, so no line is shuffled for it. Those that are left are written
    and fetch their lines again; their table has a known size, so they are broadcast where it is small.
    """
    left = records.select("line_id").distinct().join(loaded.select("line_id").distinct(), "line_id", "left_anti")
    left = durable(left.select(F.col("line_id").alias("_left")))
    return records.join(left, F.col("line_id").eqNullSafe(F.col("_left")), "left_semi")


def failed_fusion(fusion_raw: DataFrame, chrom_map: DataFrame) -> DataFrame:
    """Fusion lines that the strict load left out: line_id and the first reason that holds."""
    rest = remainder(fusion_lines(fusion_raw), conforming_fusion(fusion_raw, chrom_map))
    ok = quoting_ok(F.col("body"))
    n = F.size(F.regexp_extract_all(F.concat(F.lit("\t"), F.col("body")), F.lit(FIELD), 1))
    reason = F.when(~ok, "quoting").when(~n.isin(5, 6), "column_count").otherwise("invalid_value")
    return rest.select("line_id", reason.alias("reason")).groupBy("line_id").agg(F.max("reason").alias("reason"))


def failed_manifest(manifest_raw: DataFrame) -> DataFrame:
    """Manifest lines that the strict load left out: line_id and the first reason that holds.

    A line of a file without a header has no column count to meet and fails by it.
    """
    headers = durable(manifest_headers(manifest_raw))
    rest = remainder(manifest_lines(manifest_raw), conforming_manifest(manifest_raw, headers))
    rest = rest.join(headers.select("series", "file_no", "n_cols"), ["series", "file_no"], "left")
    b = F.col("body")
    tabbed = b.contains("\t")
    n = F.when(tabbed, F.size(F.regexp_extract_all(F.concat(F.lit("\t"), b), F.lit(FIELD), 1))).otherwise(F.size(space_fields(b)))
    reason = F.when(tabbed & ~quoting_ok(b), "quoting").when(~F.coalesce(n == F.col("n_cols"), F.lit(False)), "column_count").otherwise("invalid_value")
    return rest.select("line_id", reason.alias("reason")).groupBy("line_id").agg(F.max("reason").alias("reason"))


def failed_lines(fusion_raw: DataFrame, manifest_raw: DataFrame, chrom_map: DataFrame) -> DataFrame:
    """All failed lines: src, line_id, reason."""
    a = failed_fusion(fusion_raw, chrom_map).select(F.lit("fusion_raw").alias("src"), "line_id", "reason")
    b = failed_manifest(manifest_raw).select(F.lit("manifest_raw").alias("src"), "line_id", "reason")
    return a.unionByName(b)
