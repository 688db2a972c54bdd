"""Expectation-maximisation over partial evidence, one call per group of overlapping transcripts.

What reaches a group is reduced first. Transcripts with the same junction chain that the same records
may support are interchangeable: they form one atom, solved once with its multiplicity. Records with
the same set of compatible atoms are summed per sample into classes before the shuffle into groups.
So a group's size is set by its distinct chains and sets, not by transcripts, reads or signatures.

Mono-exon transcripts have one merged class each, and take part in their group: a group iterates until
all its transcripts, of both kinds, have settled.

Defined cases. Transcripts without a class, and multi-exon transcripts whose junctions their classes
don't cover, get 0. Samples without coverage in a transcript's classes get 0. Order of rows plays no
part: arrays are sorted first. Arithmetic is in doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An atom is (cid, k): the transcripts of a chain that lie before its k-th claim.
CLASSES = "chrom string, group_id bigint, members array<struct<cid:string,k:int>>, sample_id bigint, cov double"
ATOMS = "cid string, atom int, sample_id bigint, em double"


@dataclass(frozen=True)
class Settings:
    max_iter: int = 100
    conv_min_diff: float = 0.01
    effective_len_coef: int = 2
    damping: float = 0.3
    start: float = 0.1


def solve(weight: np.ndarray, member: list[np.ndarray], cov: np.ndarray, opts: Settings = Settings(), times: np.ndarray | None = None) -> np.ndarray:
    """Abundances (transcript x sample) of one group.

    weight: per transcript, 0 for those that take no part; member: transcripts of each class;
    cov: class x sample; times: how many transcripts each one stands for.
    """
    n_tx, n_s = len(weight), cov.shape[1]
    flat = np.concatenate(member) if member else np.zeros(0, dtype=int)
    owner = np.repeat(np.arange(len(member)), [len(m) for m in member])
    use = weight[flat] > 0
    flat, owner = flat[use], owner[use]
    alive = np.zeros((n_tx, n_s), dtype=bool)
    np.logical_or.at(alive, flat, cov[owner] > 0)
    a = np.where(alive, opts.start, 0.0)
    w = weight[flat][:, None]
    m = (np.ones(n_tx) if times is None else times)[flat][:, None]
    for _ in range(opts.max_iter):
        part = a[flat] * w
        total = np.zeros((len(member), n_s))
        np.add.at(total, owner, part * m)
        gamma = np.divide(part, total[owner], out=np.zeros_like(part), where=total[owner] > 0)
        new = np.zeros_like(a)
        np.add.at(new, flat, cov[owner] * gamma)
        new = np.where(alive, opts.damping * new + (1 - opts.damping) * a, 0.0)
        diff = np.abs(new - a) / np.where(np.abs(a) < 1e-6, 1.0, np.abs(a))
        a = new
        if not (diff[alive] > opts.conv_min_diff).any():
            break
    return a


def transcript_order() -> Column:
    return F.struct("start", "end", "tx_idx")


def kept_runs(runs: DataFrame, fsm: DataFrame, tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that some transcript of the chain may keep, and the atoms of all multi-exon transcripts.

    A record is claimed by the first transcript of the group, in order, that it matches in full; that
    one and all later ones do without it. So a chain's claims cut its transcripts into atoms.

    runs: cid, pid and columns that stay; fsm: cid, pid; tx: tx_idx, cid, chrom, group_id, start, end.
    Returns runs with chrom, group_id and k, where atoms below k keep the record, and (tx_idx, cid, atom,
    chrom, group_id).
    """
    tx = tx.select("tx_idx", "cid", "chrom", "group_id", transcript_order().alias("ord"))
    chain = tx.groupBy("cid").agg(F.first("chrom").alias("chrom"), F.first("group_id").alias("group_id"), F.min("ord").alias("first_ord"))
    claim = fsm.join(chain, "cid").groupBy("chrom", "group_id", "pid").agg(F.min("first_ord").alias("claim"))
    df = runs.join(chain, "cid").join(claim, ["chrom", "group_id", "pid"], "left").filter(F.col("claim").isNull() | (F.col("claim") > F.col("first_ord")))
    cuts = df.groupBy("cid").agg(F.array_sort(F.collect_set("claim")).alias("cuts"))
    df = df.join(cuts, "cid").withColumn("k", F.when(F.col("claim").isNull(), F.size("cuts") + 1).otherwise(F.array_position("cuts", F.col("claim"))).cast("int"))
    atoms = tx.join(cuts, "cid").withColumn("atom", F.size(F.filter("cuts", lambda c: c <= F.col("ord"))))
    return df.select(*runs.columns, "chrom", "group_id", "k"), atoms.select("tx_idx", "cid", "atom", "chrom", "group_id")


def coverage(runs: DataFrame, n_sj: DataFrame) -> DataFrame:
    """cid, n_sj, covered: atoms below `covered` have all their junctions in the run of some record they keep."""
    at = runs.select("cid", "k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_sj") - 1)).alias("j"))
    most = at.groupBy("cid", "j").agg(F.max("k").alias("k")).groupBy("cid").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    return most.join(n_sj, "cid").select("cid", "n_sj", F.when(F.col("n") == F.col("n_sj"), F.col("k")).otherwise(0).alias("covered"))


def classes(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Classes of the groups: chrom, group_id, members (atoms), sample_id, cov."""
    of = runs.groupBy("chrom", "group_id", "pid").agg(F.array_sort(F.collect_set(F.struct("cid", "k"))).alias("members"))
    df = of.join(evidence.select("pid", "sample_id", "evidence"), "pid")
    return df.groupBy("chrom", "group_id", "members", "sample_id").agg(F.sum("evidence").cast("double").alias("cov"))


def solve_group(cls: pd.DataFrame, info: pd.DataFrame, opts: Settings) -> pd.DataFrame:
    """Abundances of the atoms of one group; rows of 0 are left out. info: cid, n_sj, covered, atom, times."""
    about: dict[str, list] = {}
    for r in info.itertuples():
        about.setdefault(r.cid, []).append((r.atom, r.times, 1.0 / (r.n_sj + opts.effective_len_coef) if r.atom < r.covered else 0.0))
    sets = cls["members"].map(lambda m: tuple((x["cid"], x["k"]) for x in m))
    keys, samples = sorted(set(sets)), sorted(set(cls["sample_id"]))
    atoms = sorted((c, a) for c in {c for k in keys for c, _ in k} for a, _, _ in about.get(c, ()))
    at, col, row = {t: i for i, t in enumerate(atoms)}, {s: i for i, s in enumerate(samples)}, {k: i for i, k in enumerate(keys)}
    cov = np.zeros((len(keys), len(samples)))
    for k, s, c in zip(sets, cls["sample_id"], cls["cov"]):
        cov[row[k], col[s]] += c
    shown = {(c, a): (n, w) for c, v in about.items() for a, n, w in v}
    times, weight = np.array([float(shown[t][0]) for t in atoms]), np.array([shown[t][1] for t in atoms])
    member = [np.array([at[c, a] for c, k in key for a, _, _ in about.get(c, ()) if a < k], dtype=int) for key in keys]
    got = solve(weight, member, cov, opts, times) if atoms else np.zeros((0, len(samples)))
    i, j = np.nonzero(got)
    out = pd.DataFrame({"cid": [atoms[x][0] for x in i], "atom": [atoms[x][1] for x in i], "sample_id": [samples[x] for x in j], "em": got[i, j]})
    # an empty frame must have the types too
    return out.astype({"cid": object, "atom": "int32", "sample_id": "int64", "em": "float64"})


def abundances(cls: DataFrame, info: DataFrame, opts: Settings = Settings()) -> DataFrame:
    """cid, atom, sample_id, em of all groups. cls as CLASSES; info: chrom, group_id, cid, n_sj, covered, atom, times."""
    left, right = cls.groupBy("chrom", "group_id"), info.groupBy("chrom", "group_id")
    return left.cogroup(right).applyInPandas(lambda a, b: solve_group(a, b, opts), ATOMS)
