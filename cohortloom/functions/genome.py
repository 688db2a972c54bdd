"""Scalar column functions on chromosome names, coordinates, counts and strands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters that may surround a name in a text field.
BLANKS = r"[\s\x{00A0}]"


def bare_chrom(c: Column | str) -> Column:
    """Chromosome name without surrounding blanks, in upper case, without leading CHRs; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+\z", "")
    return F.regexp_replace(F.upper(trimmed), r"^(?:CHR)++", "")


def pad_chrom(c: Column | str) -> Column:
    """Chromosome name with the prefix chr, unless it has it already."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def plain_chrom(c: Column | str) -> Column:
    """Name as genome browsers want it: no chr at the start, MT as M."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(c, r"^(?:chr)++", "")
    return F.when(bare == "MT", F.lit("M")).otherwise(bare)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed ranges share a point. NaN on either side gives false."""
    nan = F.isnan(a_start.cast("double")) | F.isnan(a_end.cast("double")) | F.isnan(b_start.cast("double")) | F.isnan(b_end.cast("double"))
    return ~nan & (a_start <= b_end) & (b_start <= a_end)


def clamped_diff(a: Column, b: Column) -> Column:
    """Signed difference a - b held within the range of 32-bit integers."""
    big = F.lit(2147483647).cast("bigint")
    return F.greatest(F.least(a - b, big), -big)


def saturating_sub(a: Column, b: Column | int) -> Column:
    """a - b, not below zero."""
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def cpm(x: Column, total: Column) -> Column:
    """Counts per million; 0 where either is 0 or null."""
    ok = (x > 0) & (total > 0)
    return F.when(ok, x.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)) * 1e6).otherwise(F.lit(0.0))


def split_fields(line: Column) -> Column:
    """Fields of a line: at tabs if it holds one, else at runs of white space."""
    return F.when(line.contains("\t"), F.split(line, "\t", -1)).otherwise(F.split(F.trim(line), r"\s+", -1))


def strand_symbol(c: Column) -> Column:
    """'+' and '-' from the spellings +, -, 1, -1, 0, plus and minus; others raise."""
    return (
        F.when(c.isin("+", "1", "0", "plus"), "+")
        .when(c.isin("-", "-1", "minus"), "-")
        .when(c.isNull(), F.lit(None).cast("string"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown strand: "), c)))
    )


def pack(hi: Column, lo: Column) -> Column:
    """Two 32-bit values in one bigint."""
    return F.shiftleft(hi.cast("bigint"), 32).bitwiseOR(lo.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_hi(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def unpack_lo(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def attr(attrs: Column, key: str) -> Column:
    """Value of key in a GTF attribute text such as gene_id "G1"; tag "x"; null if the key is missing."""
    found = F.regexp_extract(attrs, rf'(?:^|[;\s]){key}\s+"?([^";]*)"?', 1)
    return F.when(attrs.rlike(rf"(?:^|[;\s]){key}\s"), found)


def junction_text(sj: Column) -> Column:
    """Canonical text d-a|d-a of a junction array; the separator makes it unambiguous."""
    return F.array_join(F.transform(sj, lambda j: F.concat_ws("-", j["d"], j["a"])), "|")


def junctions_of(text: Column) -> Column:
    """The junction array of a canonical text."""
    part = lambda x, i: F.regexp_extract(x, r"^(-?[0-9]+)-(-?[0-9]+)$", i).cast("bigint")
    return F.transform(F.filter(F.split(text, r"\|"), lambda x: x != ""), lambda x: F.struct(part(x, 1).alias("d"), part(x, 2).alias("a")))


def junction_sites(sj: Column) -> Column:
    """Distinct donor and acceptor positions of a junction array."""
    return F.array_distinct(F.flatten(F.transform(sj, lambda j: F.array(j["d"], j["a"]))))


def exons_of(left: Column, right: Column, sj: Column) -> Column:
    """Exons of a read from its ends and junctions; a junction that is the read itself is a single exon."""
    one = (F.size(sj) == 1) & (sj[0]["d"] == left) & (sj[0]["a"] == right)
    starts = F.concat(F.array(left), F.transform(sj, lambda j: j["a"]))
    ends = F.concat(F.transform(sj, lambda j: j["d"]), F.array(right))
    whole = F.array(F.struct(left.alias("s"), right.alias("e")))
    return F.when(one, whole).otherwise(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))))


def span_text(spans: Column) -> Column:
    """s-e,s-e of an array of s and e."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["s"], x["e"])), ",")


def named_value(attrs: Column, key: str) -> Column:
    """Value of key in a text such as gene_id:G1;gene_name:N; the first one counts, '' if the key is missing."""
    fields = F.transform(F.split(attrs, ";"), lambda x: F.trim(x))
    return F.coalesce(F.get(F.transform(F.filter(fields, lambda x: x.startswith(f"{key}:")), lambda x: F.substring(x, F.lit(len(key) + 2), F.length(x))), F.lit(0)), F.lit(""))


def number(text: Column) -> Column:
    """A decimal number in plain or exponent form; null if the text is anything else."""
    return F.when(text.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), text.try_cast("double"))


def cpm_and_count(cell: Column) -> Column:
    """struct(cpm, count) of the first two parts of a cell; what is no number is 0, fractions of counts are cut."""
    part = lambda i: number(F.get(F.split(cell, ":"), F.lit(i)))
    some = F.coalesce(cell.contains(":"), F.lit(False))
    return F.struct(F.when(some, F.coalesce(part(0), F.lit(0.0))).otherwise(0.0).alias("cpm"), F.when(some, F.coalesce(part(1).try_cast("bigint"), F.lit(0))).otherwise(0).alias("count"))
