"""Several values packed in one field: delimiter skeletons.

A field is cut into tokens: each run of ordinary characters, each run of white space and each
separator or quote is one. Its skeleton is the string of token classes, so fields that differ in
ordinary characters only share one. How a skeleton splits is resolved once, as token positions of
each piece; the rules are broadcast if they are shown to be few, else joined by the skeleton with hot
skeletons apart, and pieces are taken out of the tokens by position.

Defined cases. Null, empty and blank fields have no pieces. An empty piece takes a number and is
not listed. A quote opens only at the start of a piece (or of an attribute's value) and only if its
partner is followed by a separator, white space or the end; other quotes are plain characters. A
record delivered twice (same id) counts once. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, BROADCAST_ROWS, durable

#: Separators and joiners of each kind of field; a blank among the separators stands for white space.
STYLES = {
    "gene": {"separators": ",;|- ", "joiners": ""},
    "sample_chip": {"separators": ":;, ", "joiners": ""},
    "transcript": {"separators": ";,|", "joiners": ":="},
}
RULE = "array<struct<n:int,a:int,b:int,q:string,va:int,vb:int,vq:string>>"
WHITE = r"\s"


def _single(separators: str, joiners: str) -> str:
    return "".join(f"\\{c}" for c in sorted(set((separators + joiners).replace(" ", "")))) + "\"'"


def token_pattern(separators: str, joiners: str) -> str:
    single = _single(separators, joiners)
    return rf"[^{single}{WHITE}]++|{WHITE}++|[{single}]"


def _quoted(sk: str, at: int, ends: set[str], stop: int) -> int:
    """Position of the quote that closes the one at `at`, or -1."""
    q, i = sk[at], at + 1
    while i < stop:
        if sk[i] == q:
            if i + 1 < stop and sk[i + 1] == q:
                i += 2
                continue
            return i if i + 1 == stop or sk[i + 1] in ends else -1
        i += 1
    return -1


def split_rule(sk: str, separators: str, joiners: str) -> list[tuple]:
    """Pieces of a skeleton: number, token span [a, b), its quote, and the span and quote of an attribute's value.

    For pieces without a value va is -1. Spans are without enclosing quotes.
    """
    seps = set(separators) - {" "}
    white = " " in separators
    quote_ends = set(separators) | {" "}
    i, stop = 0, len(sk)
    if i < stop and sk[i] == " ":
        i += 1
    if stop > i and sk[stop - 1] == " ":
        stop -= 1
    pieces: list[tuple] = []
    while i < stop:
        start, key_end, quote, va, vb, vq = i, -1, "", -1, -1, ""
        if sk[i] in "\"'" and (c := _quoted(sk, i, quote_ends, stop)) >= 0:
            start, b, quote, i = i + 1, c, sk[i], c + 1
        else:
            while i < stop and sk[i] not in seps:
                blank = sk[i] == " "
                if blank and (white or sk[i + 1] in seps):
                    break
                if key_end >= 0 or i == start or not joiners or not (blank or sk[i] in joiners):
                    i += 1
                    continue
                key_end = i
                i += 1
                if blank and sk[i] in joiners:
                    i += 1
                if i < stop and sk[i] == " " and sk[i - 1] in joiners:
                    i += 1
                va = i
                if i < stop and sk[i] in "\"'" and (c := _quoted(sk, i, quote_ends, stop)) >= 0:
                    va, vb, vq, i = i + 1, c, sk[i], c + 1
                    break
            b = i if key_end < 0 else key_end
            if key_end >= 0 and vb < 0:
                vb = i
        pieces.append((len(pieces) + 1, start, b, quote, va, vb, vq))
        if i < stop and sk[i] == " ":
            i += 1
        if i < stop and sk[i] in seps:
            i += 1
            if i < stop and sk[i] == " ":
                i += 1
    return pieces


def _rules(separators: str, joiners: str):
    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rules = [[{"n": n, "a": a, "b": b, "q": q, "va": va, "vb": vb, "vq": vq} for n, a, b, q, va, vb, vq in split_rule(s, separators, joiners)] for s in df["skeleton"]]
            yield pd.DataFrame({"skeleton": df["skeleton"], "often": df["often"], "rule": rules})

    return resolve


def _text(tokens, a, b, q):
    joined = F.array_join(F.slice(tokens, a + 1, F.greatest(b - a, F.lit(0))), "")
    return F.when(q == "", joined).otherwise(F.replace(joined, F.concat(q, q), q))


def skeleton(field: Column, separators: str, joiners: str) -> Column:
    """The string of token classes: a for ordinary characters, a blank for white space, each separator and quote itself."""
    return F.regexp_replace(F.regexp_replace(field, rf"[^{_single(separators, joiners)}{WHITE}]++", "a"), rf"{WHITE}++", " ")


def with_rules(df: DataFrame, rules: DataFrame, total: int) -> DataFrame:
    """Rows with the rule of their skeleton.

    Rules that are few and small are broadcast. Beyond that, the skeletons that hold at least a
    thousandth of the rows each, of which there can be no more than 1,000, are broadcast (long ones
    aside), and the rest are joined by shuffle, where none of them is hot.
    """
    size = rules.agg(F.count("*").alias("n"), F.sum(F.length("skeleton") + 48 * F.size("rule")).alias("b")).first()
    rules = rules.drop("n")
    if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(rules), "skeleton")
    return split_join(df, rules, total)


def split_join(df: DataFrame, rules: DataFrame, total: int) -> DataFrame:
    """with_rules beyond the bound; rules have `often`, the rows of the skeleton."""
    hot = (F.col("often") * 1000 >= total) & (F.length("skeleton") <= 1024)
    shown = F.broadcast(rules.filter(hot).select("skeleton", F.col("rule").alias("_hot")))
    df = df.join(shown, "skeleton", "left")
    found = df.filter(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "rule")
    rest = df.filter(F.col("_hot").isNull()).drop("_hot").join(rules.filter(~hot).select("skeleton", "rule"), "skeleton")
    return found.unionByName(rest)


def unpack(df: DataFrame, row_id: str, field: str, separators: str, joiners: str = "") -> DataFrame:
    """One row per value of `field`: the id, piece_no (from 1) and piece."""
    f = F.col(field)
    df = df.select(F.col(row_id).alias("_id"), f.alias("_f")).filter(f.isNotNull() & ~f.rlike(rf"\A{WHITE}*+\z"))
    df = df.withColumn("skeleton", skeleton(F.col("_f"), separators, joiners))
    counts = durable(df.groupBy("skeleton").agg(F.count("*").alias("often")))
    rules = durable(counts.mapInPandas(_rules(separators, joiners), f"skeleton string, often bigint, rule {RULE}"))
    total = rules.agg(F.sum("often").alias("n")).first()["n"] or 0
    df = with_rules(df.dropDuplicates(["_id"]), rules, total)
    df = df.withColumn("tokens", F.regexp_extract_all("_f", F.lit(token_pattern(separators, joiners)), 0)).select("_id", "tokens", F.explode("rule").alias("r"))
    piece = F.when(F.col("r.va") < 0, _text(F.col("tokens"), F.col("r.a"), F.col("r.b"), F.col("r.q"))).otherwise(
        F.concat(_text(F.col("tokens"), F.col("r.a"), F.col("r.b"), F.col("r.q")), F.lit(":"), _text(F.col("tokens"), F.col("r.va"), F.col("r.vb"), F.col("r.vq")))
    )
    return df.select(F.col("_id").alias(row_id), F.col("r.n").alias("piece_no"), piece.alias("piece")).filter(F.col("piece") != "")


def unpack_tables(gene: DataFrame, sample_chip: DataFrame, transcript: DataFrame) -> DataFrame:
    """Every value of gene.splice_sites, sample_chip.init_string and transcript.orig_attrs."""
    out = None
    for src, df, row_id, field in (("gene", gene, "gene_idx", "splice_sites"), ("sample_chip", sample_chip, "chip_id", "init_string"), ("transcript", transcript, "tx_idx", "orig_attrs")):
        got = unpack(df, row_id, field, **STYLES[src]).select(F.lit(src).alias("src"), F.col(row_id).alias("rec_id"), "piece_no", "piece")
        out = got if out is None else out.unionByName(got)
    return out
