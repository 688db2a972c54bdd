"""Column identity through series of files, and the typed union of them."""

import datetime
import random

import pytest

from cohortloom.operators import drift
from cohortloom.operators.lines import manifest_headers
from cohortloom.session import table
from tests import plain
from tests.conftest import rows
from tests.test_general_problems import recs


def manifest(spark, files, series="s"):
    raw = [(1000 * k + i, series, k, i, v) for k, text in files.items() for i, v in enumerate(text, 1)]
    return spark.createDataFrame(raw, "line_id bigint, series string, file_no int, line_no int, raw_line string")


def file(names, *samples):
    return ["\t".join(["n", "p", *names])] + ["\t".join([s, f"/{s}.isoform.gz", *v]) for s, *v in samples]


def test_a_name_that_comes_again_is_another_column(spark):
    df = manifest(spark, {
        1: file(["X", "K"], ("a", "old", "1"), ("b", "old", "2")),
        2: file(["K"], ("a", "1"), ("b", "2")),
        3: file(["X", "K"], ("a", "u", "1"), ("b", "v", "2")),
        4: file(["Y", "K"], ("a", "u", "1"), ("b", "v", "2")),
    })
    got = {(r["file_no"], r["sample"]): r for r in drift.typed_table(df).collect()}
    assert (got[1, "a"]["X"], got[1, "a"]["Y"]) == ("old", None)
    assert [got[k, "a"]["Y"] for k in (2, 3, 4)] == [None, "u", "u"] and got[3, "a"]["X"] is None
    assert [got[k, "b"]["K"] for k in (1, 2, 3, 4)] == [2] * 4
    assert rows(drift.schema_changes(df)) == [("s", 2, "removed", "X", ""), ("s", 3, "added", "", "X"), ("s", 4, "renamed", "X", "Y")]


def test_types_and_clashing_names(spark):
    df = manifest(spark, {
        1: file(["age", "day", "Path", "w"], ("a", "5", "2020-01-31", "x", "9" * 30), ("b", "NA", ".", "", "1")),
        2: file(["age", "day", "Path", "w", "PATH"], ("a", "5.5", "2020-02-01", "x", "2", "z")),
    })
    t = drift.typed_table(df)
    assert dict(t.dtypes) == {"line_id": "bigint", "series": "string", "file_no": "int", "sample": "string", "path": "string", "age": "double", "day": "date", "Path_2": "string", "w": "decimal(38,0)", "PATH_3": "string"} or {"Path_3", "PATH_2"} < set(t.columns)
    got = {(r["file_no"], r["sample"]): r for r in t.collect()}
    assert got[1, "a"]["day"] == datetime.date(2020, 1, 31) and got[2, "a"]["age"] == 5.5 and got[1, "b"]["age"] is None and int(got[1, "a"]["w"]) == int("9" * 30)


def test_two_columns_with_one_newest_name(spark):
    df = manifest(spark, {
        1: file(["X", "Z"], ("a", "1", "p")),
        2: file(["Z"], ("a", "p")),
        3: file(["X"], ("a", "p")),
    })
    got = {r["file_no"]: r for r in drift.typed_table(df).collect()}
    assert [got[k]["X"] for k in (1, 2, 3)] == ["p"] * 3 and got[1]["X@1"] == 1


def test_long_chains_of_renames(spark):
    names = [f"c{i}" for i in range(12)]
    df = manifest(spark, {i: file([n], ("a", "v"), ("b", "w")) for i, n in enumerate(names)})
    got = drift.typed_table(df).collect()
    assert len(got) == 24 and {r["c11"] for r in got} == {"v", "w"}


def test_flooding_decides_between_candidates_that_agree(spark):
    df = manifest(spark, {
        1: file(["tissue_type", "code", "k"], ("a", "1", "1", "x"), ("b", "2", "2", "y")),
        2: file(["code_id", "tissue", "k"], ("a", "1", "1", "x"), ("b", "2", "2", "y")),
    })
    assert rows(drift.schema_changes(df)) == [("s", 2, "renamed", "code", "code_id"), ("s", 2, "renamed", "tissue_type", "tissue")]


def test_scores_of_a_pair_do_not_depend_on_its_neighbours():
    def graph(n):
        g, at = drift.PairGraph(), []
        rng = random.Random(1)
        for _ in range(n):
            gone, come = [f"a{i}" for i in range(rng.randint(1, 3))], [f"b{i}" for i in range(rng.randint(1, 3))]
            at.append(g.add(["k"], gone, come, {"k": "text"}, {"k": "text"}, {(gone[0], come[0]): (3, 2)}))
        s = g.settle()
        return [{p: s[i] for p, i in x.items()} for x in at]

    few, many = graph(2), graph(40)
    assert few == many[:2]


def whole_table(manifest):
    """Plain version of the typed table: (line_id) -> {attribute: text}, by walking each series forward."""
    names, changes = plain.headers(manifest), plain.changes(manifest)
    files = {}
    for s, n in names:
        files.setdefault(s, []).append(n)
    now = {}
    for s, nos in files.items():
        nos.sort()
        cols = {}
        chains = []
        for i, n in enumerate(nos):
            renamed = {b: a for (t, m, kind, a, b) in changes if (t, m, kind) == (s, n, "renamed")}
            new = {}
            for c in dict.fromkeys(names[s, n][2:]):
                if c == "":
                    continue
                was = cols.get(c) if c in cols else cols.get(renamed.get(c))
                if was is None:
                    was = {"name": c, "last": n, "start": n}
                    chains.append(was)
                if was["name"] != c:
                    was["name"], was["start"] = c, n
                was["last"] = n
                new[c] = was
                now[s, n, c] = was
            cols = new
    out = {}
    for r in manifest:
        f, _ = plain.manifest_line(r, names)
        if not f:
            continue
        s, n = r["series"], r["file_no"]
        cells = {}
        for c, v in list(zip(names[s, n], f))[2:]:
            if c == "" or c in cells:
                continue
            cells[c] = (now[s, n, c], v)
        row = {}
        for c, (chain, v) in cells.items():
            rivals = [x for x in {id(y): y for (t, m, _), y in now.items() if t == s}.values() if x is not chain and x["name"] == chain["name"] and x["start"] > chain["start"]]
            met = any(x is y for x in rivals for (t, m, _), y in now.items() if t == s for (t2, m2, _), z in now.items() if (t2, m2) == (t, m) and z is chain)
            row[f"{chain['name']}@{chain['last']}" if met else chain["name"]] = None if v in ("", "NA", "NULL", ".") else v
        out[r["line_id"]] = row
    return out


def test_the_table_of_all_series(spark, sf):
    raw = table(spark, sf, "manifest_raw")
    want = whole_table(recs(spark, sf, "manifest_raw"))
    got = {r["line_id"]: {x["attribute"]: x["value"] for x in r["attrs"]} for r in drift.union_rows(raw).collect()}
    assert got == want and len(got) > 50
    typed = drift.typed_table(raw)
    assert typed.count() == len(want) and len(typed.columns) == 5 + len({a for r in want.values() for a in r})


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    df = manifest(spark, {1: ["n\tp"]}).limit(n)
    assert drift.typed_table(df).collect() == [] and manifest_headers(df).count() == 0
