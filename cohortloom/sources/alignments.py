"""Alignments: SAM text with built-in functions, BAM by a streaming decoder on the executors.

BAM files are opened where their task runs and decoded block by block, so a task holds one batch of
records whatever the file's size; the files of a list are spread over tasks. CRAM needs a
reference-based codec that no library here offers; convert it to BAM or SAM first.

Defined cases. Header lines are skipped. Unmapped, low-quality and (unless asked for) secondary
alignments are dropped; supplementary ones stay. Records without exons are dropped. Empty files
give no rows.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genome import bare_chrom
from ..operators.build import cigar_exons, keep_alignment, sa_segments

RECORD = "path string, name string, flag int, chrom string, pos bigint, mapq int, cigar string, sa string"
#: Fixed values of the BAM format: operation letters by code, and sizes of numeric tag types.
OPS = "MIDNSHP=X"
TAG_SIZE = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of SAM text files; positions become 0-based."""
    f = F.split("value", "\t", -1)
    df = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").filter(~F.col("value").startswith("@"))
    df = df.select("path", "value", f.alias("f")).filter(F.size("f") >= 11)
    g = lambda i: F.col("f")[i]
    sa = F.when(F.col("value").contains("\tSA:Z:"), F.regexp_extract("value", r"\tSA:Z:([^\t]*)", 1))
    return df.select("path", g(0).alias("name"), g(1).try_cast("int").alias("flag"), g(2).alias("chrom"), (g(3).try_cast("bigint") - 1).alias("pos"), g(4).try_cast("int").alias("mapq"), g(5).alias("cigar"), sa.alias("sa"))


def _tag(raw: bytes, want: bytes) -> str | None:
    i = 0
    while i + 3 <= len(raw):
        tag, kind = raw[i : i + 2], chr(raw[i + 2])
        i += 3
        if kind in "ZH":
            end = raw.index(b"\0", i)
            if tag == want:
                return raw[i:end].decode()
            i = end + 1
        elif kind == "B":
            i += 5 + TAG_SIZE[chr(raw[i])] * struct.unpack_from("<i", raw, i + 1)[0]
        else:
            i += TAG_SIZE[kind]
    return None


def decode_bam(stream) -> Iterator[tuple]:
    """Records of an open, already decompressed BAM stream."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        n = struct.unpack("<i", stream.read(4))[0]
        names.append(stream.read(n)[:-1].decode())
        stream.read(4)
    while head := stream.read(4):
        b = stream.read(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", b)
        at = 32
        name = b[at : at + l_name - 1].decode()
        at += l_name
        cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", b, at))
        at += 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        yield name, flag, names[ref] if ref >= 0 else None, pos, mapq, cigar or "*", _tag(b[at:], b"SA")


def read_bam(spark: SparkSession, paths: list[str], batch: int = 10_000) -> DataFrame:
    """Records of BAM files that every executor can open by path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in RECORD.split(", ")]
        for part in parts:
            for path in part["path"]:
                rows = []
                with gzip.open(path, "rb") as f:
                    for r in decode_bam(f):
                        rows.append((path, *r))
                        if len(rows) >= batch:
                            yield pd.DataFrame(rows, columns=cols)
                            rows = []
                yield pd.DataFrame(rows, columns=cols)

    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return df.mapInPandas(run, RECORD)


def profile_alignments(records: DataFrame, sample_id: int = 0, mapq: int = 5, use_secondary: bool = False, rname: bool = False) -> DataFrame:
    """Records as reads: sample_id, chrom, strand, exons, supp and info (the read's name as RN if asked for)."""
    df = records.filter(keep_alignment(F.col("flag"), F.col("mapq"), mapq, use_secondary) & F.col("chrom").isNotNull() & (F.col("cigar") != "*"))
    none = F.array().cast("array<struct<k:string,v:string>>")
    info = F.array(F.struct(F.lit("RN").alias("k"), F.col("name").alias("v"))) if rname else none
    df = df.select(F.lit(sample_id).alias("sample_id"), bare_chrom("chrom").alias("chrom"), F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-").alias("strand"), cigar_exons(F.col("pos"), F.col("cigar")).alias("exons"), sa_segments(F.col("sa")).alias("supp"), info.alias("info"))
    return df.filter(F.size("exons") > 0)
