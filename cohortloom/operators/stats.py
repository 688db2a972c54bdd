"""Totals, counts per million, confidence and the result rows of transcripts.

Defined cases. Division by zero gives 0. Transcripts without evidence get a row with zeros and no
sample. Order of rows plays no part in sums of integers; confidence sorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genome import cpm
from ..session import bounded_broadcast


def abundance_cells(fsm: DataFrame, em: DataFrame, least_em: float = 1e-4) -> DataFrame:
    """One row per transcript and sample with evidence: fsm, em (ungated), em_shown (0 below least_em).

    Cells without evidence aren't stored: they add nothing to totals, counts or confidence, and the
    wide writer fills them in.
    """
    both = fsm.select("tx_idx", "sample_id", "fsm", F.lit(0.0).alias("em")).unionByName(em.select("tx_idx", "sample_id", F.lit(0).cast("bigint").alias("fsm"), "em"))
    df = both.groupBy("tx_idx", "sample_id").agg(F.sum("fsm").alias("fsm"), F.sum("em").alias("em"))
    return df.withColumn("em_shown", F.when(F.col("em") >= least_em, F.col("em")).otherwise(0.0))


def query_totals(cells: DataFrame) -> DataFrame:
    """Per sample: sums of fsm, em and both."""
    return cells.groupBy("sample_id").agg(F.sum("fsm").alias("fsm_total"), F.sum("em").alias("em_total"), F.sum(F.col("fsm") + F.col("em")).alias("all_total"))


def with_cpm(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """Cells with counts per million; all three are over the query's own ungated totals of fsm and em together.

    Totals are one row a sample; they are broadcast where they are shown to be few.
    """
    df = cells.join(bounded_broadcast(totals), "sample_id")
    df = df.withColumn("fsm_cpm", cpm(F.col("fsm"), F.col("all_total"))).withColumn("em_cpm", cpm(F.col("em_shown"), F.col("all_total")))
    return df.withColumn("all_cpm", cpm(F.col("fsm") + F.col("em_shown"), F.col("all_total")))


def confidence(cells: DataFrame, key: str, x: str, total: str, n_samples: int) -> DataFrame:
    """key, confidence = (k/n) * geometric mean of positive CPM * (1 - g).

    g = 2 * sum(i * x_i) / (n * sum(x)) - (n + 1) / n with x in descending order and i from 1.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(x).desc()))
    df = cells.withColumn("_i", rank).withColumn("_cpm", cpm(F.col(x), F.col(total)))
    one = df.groupBy(key).agg(F.sum(x).alias("_sum"), F.sum(F.col("_i") * F.col(x)).alias("_wsum"), F.count_if(F.col(x) > 0).alias("_k"), F.avg(F.when(F.col("_cpm") > 0, F.ln(F.col("_cpm")))).alias("_ln"))
    n = float(n_samples)
    g = 2 * F.col("_wsum") / (n * F.nullif(F.col("_sum").cast("double"), F.lit(0.0))) - (n + 1) / n
    value = F.col("_k") / n * F.exp("_ln") * (1 - g)
    return one.select(key, F.when(F.col("_k") > 0, F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias("confidence"))


def positives(cells: DataFrame, min_read: int = 1) -> DataFrame:
    """Per transcript: samples with at least min_read in all, by fsm and by em (ungated)."""
    at = lambda c: F.count_if(c >= min_read).cast("bigint")
    return cells.groupBy("tx_idx").agg(at(F.col("fsm") + F.col("em")).alias("n_all"), at(F.col("fsm")).alias("n_fsm"), at(F.col("em")).alias("n_em"))


def sample_summary(cells: DataFrame, n_tx: int, min_read: int = 1) -> DataFrame:
    """Per sample: transcripts found by fsm, by em and by either, and their percentage of all."""
    f, e = F.col("fsm") >= min_read, F.col("em") >= min_read
    df = cells.groupBy("sample_id").agg(F.count_if(f).alias("n_fsm"), F.count_if(e).alias("n_em"), F.count_if(f | e).alias("n_any"))
    return df.withColumn("pct_any", F.round(F.col("n_any") * 100.0 / max(n_tx, 1), 4))


FORMAT = "CPM:COUNT:FSM_CPM:FSM_COUNT:EM_CPM:EM_COUNT:INFO"


def isoform_rows(tx: DataFrame, cells: DataFrame, n_samples: int, min_read: int = 1, info: DataFrame | None = None) -> DataFrame:
    """The isoform result in long form: one row per transcript and sample with evidence, with the transcript's own columns.

    Columns: tx_idx, chrom, start, end, length, exon_count, trans_id, gene_id, confidence, detected and
    n_pos_samples (total:fsm:em), min_read, attributes, sample_id, the numbers of the cell and the cell as
    FORMAT has it. A transcript without evidence has one row without a sample.
    """
    totals = query_totals(cells)
    full = with_cpm(cells, totals)
    full = full.withColumn("x", F.col("fsm") + F.col("em"))
    head = positives(cells, min_read).join(confidence(full, "tx_idx", "x", "all_total", n_samples), "tx_idx")
    yes = lambda c: F.when(F.col(c) > 0, "yes").otherwise("no")
    head = head.select("tx_idx", "confidence", F.concat_ws(":", yes("n_all"), yes("n_fsm"), yes("n_em")).alias("detected"), F.concat(F.concat_ws(":", "n_all", "n_fsm", "n_em"), F.lit(f"/{n_samples}")).alias("n_pos_samples"))
    if info is None:
        full = full.withColumn("info", F.lit(None).cast("string"))
    else:
        full = full.join(info, ["tx_idx", "sample_id"], "left")
    number = lambda c: F.round(c, 6)
    cell = F.concat_ws(":", number("all_cpm"), number(F.col("fsm") + F.col("em_shown")), number("fsm_cpm"), "fsm", number("em_cpm"), number("em_shown"), F.coalesce("info", F.lit("")))
    length = F.aggregate("exons", F.lit(0).cast("bigint"), lambda s, x: s + x["e"] - x["s"])
    attributes = F.col("attrs") if "attrs" in tx.columns else F.lit("")
    rows = tx.select("tx_idx", "chrom", "start", "end", length.alias("length"), F.size("exons").alias("exon_count"), F.col("tx_id").alias("trans_id"), "gene_id", F.lit(min_read).alias("min_read"), attributes.alias("attributes"))
    rows = rows.join(head, "tx_idx", "left").fillna(0.0, ["confidence"]).fillna({"detected": "no:no:no", "n_pos_samples": f"0:0:0/{n_samples}"})
    return rows.join(full.select("tx_idx", "sample_id", "fsm", "em_shown", "all_cpm", "fsm_cpm", "em_cpm", "info", cell.alias("cell")), "tx_idx", "left")
