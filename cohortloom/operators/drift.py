"""Schemas that drift between files: similarity flooding over consecutive files, then cast and union.

For every file and the one before it in its series a schema graph is built: the file, its columns
below it (nesting), and the name, the value type and the values of each column. The pairwise graph
of two files joins pairs of nodes that the same kind of edge leads to. Start scores are the spelling
of names, the kinship of types and the agreement of values over the samples that both files list;
they flow along the edges until they settle. A name that stays is a correspondence by itself and
feeds the flow; among the columns that are gone and come, the stable pairs by settled score are
kept, and a rename is reported unless a shared sample contradicts it.

Rows meet only per (file pair, sample), and only in columns that are gone or have come. What reaches
Python is one row a file pair, with lists as long as its columns; many file pairs are flooded at
once, as one sparse graph, in a set number of tasks.

For the union, a column is followed through its file runs: it lives while its name stays or is
renamed and ends where it is removed, so a name that comes again later is another column. Chains of
renames are resolved by pointer doubling. Each attribute is named by its newest name and cast to the
narrowest type that holds all its values.

Defined cases. Only lines valid under the strict load count, each once. Files without a header are
unknown. Empty, NA, NULL and . are missing; a column without values has no type and changes none.
Of a sample listed twice in a file all values count; only renames compare its smallest value that is
not missing. Of columns that share one name in a file the first counts. Ties between candidates go
to the smaller names. Empty tables give empty results, and a table without attributes.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, from_nth, parallelism
from .lines import load_manifest, manifest_headers

#: Spellings of a missing value.
MISSING = ["", "NA", "NULL", "."]
#: Most attributes of one table, as each is a column; more raise an error.
MAX_ATTRIBUTES = 10_000
#: Value types as bits: a column's type follows from the union of its values' bits.
INTEGER, DECIMAL, DATE, TEXT = 1, 2, 4, 8
RENAMES = "series string, file_no int, old_name string, new_name string, score double"


def value_bits(v: Column) -> Column:
    """The type of one value as a bit; 0 if it is missing."""
    return (
        F.when(v.isNull() | v.isin(*MISSING), 0)
        .when(v.rlike(r"\A[0-9]++\z"), INTEGER)
        .when(v.rlike(r"\A(?:[0-9]++\.[0-9]*+|\.[0-9]++)\z"), DECIMAL)
        .when(v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), DATE)
        .otherwise(TEXT)
    )


def type_of(bits: Column) -> Column:
    """integer, decimal, date or text of a column with these bits; null if all its values are missing."""
    return F.when(bits == 0, None).when(bits == INTEGER, "integer").when(bits.isin(DECIMAL, INTEGER | DECIMAL), "decimal").when(bits == DATE, "date").otherwise("text")


def attribute_rows(manifest_raw: DataFrame, headers: DataFrame) -> DataFrame:
    """line_id, series, file_no, sample, path and attrs (name, value) of each valid line; columns from the third on."""
    rows = load_manifest(manifest_raw, headers)
    names, values = from_nth("names", 3), from_nth("values", 3)
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    attrs = F.filter(pairs, lambda x, i: (x["name"] != "") & (F.array_position(names, x["name"]) == i + 1))
    return rows.select("line_id", "series", "file_no", "sample", "path", attrs.alias("attrs"))


def column_types(rows: DataFrame) -> DataFrame:
    """series, file_no, name, type of each column."""
    cells = rows.select("series", "file_no", F.explode("attrs").alias("x"))
    return cells.groupBy("series", "file_no", F.col("x.name").alias("name")).agg(type_of(F.bit_or(value_bits(F.col("x.value")))).alias("type"))


def file_pairs(headers: DataFrame) -> DataFrame:
    """Each file with the next lower file_no of its series (null for the first), its names and what is gone, come and kept."""
    attrs = headers.select("series", "file_no", F.array_distinct(F.filter(from_nth("names", 3), lambda x: x != "")).alias("names"))
    before = Window.partitionBy("series").orderBy("file_no")
    df = attrs.withColumn("prev_no", F.lag("file_no").over(before)).withColumn("old", F.lag("names").over(before))
    none = F.array().cast("array<string>")
    old = F.coalesce("old", none)
    return df.select("series", "file_no", "prev_no", "names", F.array_except(old, "names").alias("gone"), F.array_except("names", old).alias("come"), F.array_intersect(old, "names").alias("kept"))


def value_agreement(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """series, file_no, old_name, new_name, shared, equal: samples with a value in both columns, and those where it is the same."""
    side = lambda n, no, want: pairs.select("series", F.col(no).alias("file_no"), F.col("file_no").alias("at"), F.lit(n).alias("side"), F.col(want).alias("want"))
    cells = None
    for part in (side(0, "prev_no", "gone"), side(1, "file_no", "come")):
        df = rows.join(part, ["series", "file_no"])
        df = df.select("series", "at", "side", "sample", F.explode(F.filter("attrs", lambda x: F.array_contains("want", x["name"]) & ~x["value"].isin(*MISSING))).alias("x"))
        cells = df if cells is None else cells.unionByName(df)
    cells = cells.groupBy("series", "at", "sample", "side", F.col("x.name").alias("name")).agg(F.min("x.value").alias("value"))
    of = lambda n: F.collect_list(F.when(F.col("side") == n, F.struct("name", "value")))
    both = cells.groupBy("series", "at", "sample").agg(of(0).alias("old"), of(1).alias("new"))
    met = F.flatten(F.transform("old", lambda o: F.transform("new", lambda n: F.struct(o["name"].alias("old_name"), n["name"].alias("new_name"), (o["value"] == n["value"]).alias("same")))))
    met = both.select("series", F.col("at").alias("file_no"), F.explode(met).alias("m"))
    return met.groupBy("series", "file_no", "m.old_name", "m.new_name").agg(F.count("*").alias("shared"), F.count_if("m.same").alias("equal"))


class PairGraph:
    """The pairwise graphs of many file pairs, side by side: nodes with start scores, edges with weights."""

    def __init__(self) -> None:
        self.start: list[float] = []
        self.block: list[int] = []
        self.edges: list[tuple[int, int, float]] = []
        self.blocks = 0

    def node(self, score: float) -> int:
        self.start.append(score)
        return len(self.start) - 1

    def add(self, kept: list, gone: list, come: list, old_type: dict, new_type: dict, agree: dict) -> dict[tuple[str, str], int]:
        """The graph of one file pair; returns the nodes of the pairs that are open."""
        first = len(self.start)
        root = self.node(1.0)
        kinds: dict[tuple[str, str], list[int]] = {}
        open_pairs, columns = {}, []
        for a, b in [(k, k) for k in kept] + [(a, b) for a in gone for b in come]:
            likeness = 1.0 if a == b else difflib.SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio()
            col, name = self.node(0.0), self.node(likeness)
            columns.append(col)
            self.edges += [(col, name, 1.0), (name, col, 1.0), (col, root, 1.0)]
            kinds.setdefault((old_type.get(a) or "", new_type.get(b) or ""), []).append(col)
            if a != b:
                shared, equal = agree.get((a, b), (0, 0))
                values = self.node(equal / shared if shared else 0.0)
                self.edges += [(col, values, 1.0), (values, col, 1.0)]
                open_pairs[a, b] = col
        self.edges += [(root, col, 1.0 / len(columns)) for col in columns]
        for (t, u), cols in kinds.items():
            kind = self.node(1.0 if t == u else 0.5 if {t, u} == {"integer", "decimal"} else 0.0)
            self.edges += [e for col in cols for e in ((col, kind, 1.0), (kind, col, 1.0 / len(cols)))]
        self.block += [self.blocks] * (len(self.start) - first)
        self.blocks += 1
        return open_pairs

    def settle(self, rounds: int = 200, eps: float = 1e-6) -> np.ndarray:
        """Scores at the fixpoint; a file pair rests once it has settled, so none depends on the others."""
        start, block = np.array(self.start), np.array(self.block)
        src, dst = (np.array([e[i] for e in self.edges]) for i in (0, 1))
        weight = np.array([e[2] for e in self.edges])
        firsts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        scores, moving = start.copy(), np.ones(self.blocks, dtype=bool)
        for _ in range(rounds):
            x = start + scores
            new = x + np.bincount(dst, weights=weight * x[src], minlength=len(start))
            new /= np.maximum.reduceat(new, firsts)[block]
            moved = np.maximum.reduceat(np.abs(new - scores), firsts) >= eps
            scores = np.where(moving[block], new, scores)
            moving &= moved
            if not moving.any():
                break
        return scores


def _correspond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Renames of the file pairs of a batch: stable pairs by settled score that no shared sample contradicts."""
    for df in batches:
        graph, todo = PairGraph(), []
        for r in df.itertuples(index=False):
            agree = {(x["old_name"], x["new_name"]): (x["shared"], x["equal"]) for x in r.agree}
            types = [{x["name"]: x["type"] for x in t} for t in (r.old_types, r.new_types)]
            todo.append((r.series, r.file_no, agree, graph.add(sorted(r.kept), sorted(r.gone), sorted(r.come), *types, agree)))
        scores = graph.settle() if todo else []
        out = []
        for series, file_no, agree, nodes in todo:
            used_a, used_b = set(), set()
            for (a, b), at in sorted(nodes.items(), key=lambda p: (-round(scores[p[1]], 9), p[0])):
                shared, equal = agree.get((a, b), (0, 0))
                if a not in used_a and b not in used_b and shared and shared == equal:
                    used_a.add(a)
                    used_b.add(b)
                    out.append((series, file_no, a, b, float(scores[at])))
        yield pd.DataFrame(out, columns=["series", "file_no", "old_name", "new_name", "score"])


def renames(rows: DataFrame, types: DataFrame, pairs: DataFrame) -> DataFrame:
    """series, file_no, old_name, new_name and score of each renamed column."""
    todo = pairs.filter((F.size("gone") > 0) & (F.size("come") > 0))
    per_file = types.groupBy("series", "file_no").agg(F.collect_list(F.struct("name", "type")).alias("types"))
    agree = value_agreement(rows, todo).groupBy("series", "file_no").agg(F.collect_list(F.struct("old_name", "new_name", "shared", "equal")).alias("agree"))
    df = todo.join(per_file.select("series", F.col("file_no").alias("prev_no"), F.col("types").alias("old_types")), ["series", "prev_no"], "left")
    df = df.join(per_file.select("series", "file_no", F.col("types").alias("new_types")), ["series", "file_no"], "left").join(agree, ["series", "file_no"], "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    kinds = "array<struct<name:string,type:string>>"
    df = df.select("series", "file_no", "kept", "gone", "come", empty("old_types", kinds), empty("new_types", kinds), empty("agree", "array<struct<old_name:string,new_name:string,shared:bigint,equal:bigint>>"))
    return df.repartition(2 * parallelism(df.sparkSession), "series", "file_no").mapInPandas(_correspond, RENAMES)


def _read(manifest_raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, column types, file pairs and renames; each written once."""
    headers = durable(manifest_headers(manifest_raw))
    rows, pairs = durable(attribute_rows(manifest_raw, headers)), durable(file_pairs(headers))
    types = durable(column_types(rows))
    return rows, types, pairs, durable(renames(rows, types, pairs))


def schema_changes(manifest_raw: DataFrame) -> DataFrame:
    """Each change of a file against the one before: series, file_no, drift, old_name, new_name."""
    _, types, pairs, same = _read(manifest_raw)
    pairs = pairs.filter("prev_no is not null")
    gone = pairs.select("series", "file_no", F.explode("gone").alias("old_name")).join(same, ["series", "file_no", "old_name"], "left_anti")
    come = pairs.select("series", "file_no", F.explode("come").alias("new_name")).join(same, ["series", "file_no", "new_name"], "left_anti")
    kept = pairs.select("series", "file_no", "prev_no", F.explode("kept").alias("name"))
    kept = kept.join(types.withColumnRenamed("type", "new_type"), ["series", "file_no", "name"])
    kept = kept.join(types.select("series", F.col("file_no").alias("prev_no"), "name", F.col("type").alias("old_type")), ["series", "prev_no", "name"]).filter("old_type <> new_type")
    row = lambda df, drift, a, b: df.select("series", "file_no", F.lit(drift).alias("drift"), a.alias("old_name"), b.alias("new_name"))
    return (
        row(same, "renamed", F.col("old_name"), F.col("new_name"))
        .unionByName(row(gone, "removed", F.col("old_name"), F.lit("")))
        .unionByName(row(come, "added", F.lit(""), F.col("new_name")))
        .unionByName(row(kept, "retyped", F.col("name"), F.col("name")))
    )


def column_identity(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """series, file_no, name, attribute: what each column of each file is called in the union.

    A run is a column under one name through consecutive files. Runs are linked by renames, and each
    run points to the last one of its chain after a number of rounds that is logarithmic in the
    longest chain. Where two columns of one file would get the same newest name, the older one, which
    was removed, is called name@its last file.
    """
    cols = pairs.select("series", "file_no", "prev_no", "come", F.explode("names").alias("name"))
    begins = F.when(F.array_contains("come", F.col("name")), F.col("file_no"))
    cols = cols.withColumn("start_no", F.last(begins, True).over(Window.partitionBy("series", "name").orderBy("file_no"))).select("series", "file_no", "name", "start_no")
    runs = cols.groupBy("series", "name", "start_no").agg(F.max("file_no").alias("last_no"))
    link = same.join(pairs.select("series", "file_no", "prev_no"), ["series", "file_no"])
    link = link.select("series", F.col("old_name").alias("name"), F.col("prev_no").alias("last_no"), F.col("new_name").alias("to_name"), F.col("file_no").alias("to_no"))
    at = runs.join(link, ["series", "name", "last_no"], "left").withColumn("to_name", F.coalesce("to_name", "name")).withColumn("to_no", F.coalesce("to_no", "start_no"))
    at = durable(at.select("series", "name", "start_no", "last_no", "to_name", "to_no"))
    while True:
        further = at.select("series", F.col("name").alias("to_name"), F.col("start_no").alias("to_no"), F.col("to_name").alias("far_name"), F.col("to_no").alias("far_no"))
        new = at.join(further, ["series", "to_name", "to_no"])
        new = durable(new.select("series", "name", "start_no", "last_no", F.col("far_name").alias("to_name"), F.col("far_no").alias("to_no"), (F.col("far_no") != F.col("to_no")).alias("moved")))
        at = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    cols = cols.join(at.drop("last_no"), ["series", "name", "start_no"])
    ends = at.groupBy("series", "to_name", "to_no").agg(F.max("last_no").alias("last_no"))
    meet = cols.withColumn("newest", F.max("to_no").over(Window.partitionBy("series", "file_no", "to_name")))
    older = meet.filter("to_no < newest").select("series", "to_name", "to_no").distinct().join(ends, ["series", "to_name", "to_no"])
    df = cols.join(older, ["series", "to_name", "to_no"], "left")
    return df.select("series", "file_no", "name", F.when(F.col("last_no").isNotNull(), F.concat_ws("@", "to_name", "last_no")).otherwise(F.col("to_name")).alias("attribute"))


def union_rows(manifest_raw: DataFrame) -> DataFrame:
    """line_id, series, file_no, sample, path and attrs (attribute, value; missing is null) of all valid lines; written once."""
    rows, _, pairs, same = _read(manifest_raw)
    names = durable(column_identity(pairs, same).groupBy("series", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "attribute"))).alias("now")))
    value = lambda x: F.when(~x["value"].isin(*MISSING), x["value"])
    attrs = F.transform("attrs", lambda x: F.struct(F.try_element_at("now", x["name"]).alias("attribute"), value(x).alias("value")))
    return durable(rows.join(names, ["series", "file_no"]).select("line_id", "series", "file_no", "sample", "path", attrs.alias("attrs")))


def attribute_types(rows: DataFrame) -> DataFrame:
    """attribute, type and digits (the longest integer) over all files."""
    cells = rows.select(F.explode("attrs").alias("x")).select("x.attribute", "x.value").withColumn("bits", value_bits(F.col("value")))
    return cells.groupBy("attribute").agg(type_of(F.bit_or("bits")).alias("type"), F.max(F.when(F.col("bits") == INTEGER, F.length("value"))).alias("digits"))


def sql_type(kind: str | None, digits: int | None) -> str:
    """The type of a table column; integers too long for a number stay text."""
    if kind == "integer":
        return "bigint" if digits <= 18 else "decimal(38,0)" if digits <= 38 else "string"
    return {"decimal": "double", "date": "date"}.get(kind, "string")


def consistent_table(manifest_raw: DataFrame) -> DataFrame:
    """All manifest values in long form: series, file_no, sample, attribute and each distinct value, as text."""
    cells = union_rows(manifest_raw).select("series", "file_no", "sample", F.explode("attrs").alias("x"))
    return cells.select("series", "file_no", "sample", "x.attribute", "x.value").distinct()


def typed_table(manifest_raw: DataFrame) -> DataFrame:
    """All valid lines in one table: line_id, series, file_no, sample, path and a typed column for each attribute.

    Only the attributes' names and types reach the driver. A name that differs from another column's
    in case only, or is one of the fixed columns', gets a number at its end.
    """
    rows = union_rows(manifest_raw)
    found = attribute_types(rows).limit(MAX_ATTRIBUTES + 1).collect()
    if len(found) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    fixed = ["line_id", "series", "file_no", "sample", "path"]
    taken, columns = set(fixed), []
    for r in sorted(found, key=lambda r: r["attribute"]):
        label, n = r["attribute"], 1
        while label.lower() in taken:
            n += 1
            label = f"{r['attribute']}_{n}"
        taken.add(label.lower())
        columns.append((r["attribute"], label, sql_type(r["type"], r["digits"])))
    df = rows.select(*fixed, F.map_from_entries("attrs").alias("_attrs"))
    return df.select(*fixed, *(F.try_element_at("_attrs", F.lit(a)).try_cast(t).alias(label) for a, label, t in columns))
