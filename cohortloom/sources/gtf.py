"""GTF annotation: transcripts and genes, assembled by id rather than by the order of lines.

Defined cases. Comments, blank lines and lines with fewer than nine fields are skipped. Coordinates
become 0-based half-open. A transcript without exons, id or strand is dropped; its exons may come
before it, in any order, and repeated. Genes without exons keep an empty list of sites. An empty
file gives empty tables. Gzip is told by the file name's ending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genome import attr, bare_chrom
from ..operators.build import junctions


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, feature, s, e, strand, attrs of each feature line."""
    f = F.split("value", "\t", -1)
    df = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(f) >= 9)).select(f.alias("f"))
    g = lambda i: F.col("f")[i]
    return df.select(bare_chrom(g(0)).alias("chrom"), g(2).alias("feature"), (g(3).try_cast("bigint") - 1).alias("s"), g(4).try_cast("bigint").alias("e"), g(6).alias("strand"), g(8).alias("attrs"))


def write_gtf(tx: DataFrame, genes: DataFrame, path: str) -> None:
    """Genes, transcripts and their exons as GTF text, in parts by chromosome and place."""
    line = lambda feature, s, e, strand, attrs: F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.lit("."), F.lit(feature), s + 1, e, F.lit("."), strand, F.lit("."), attrs)
    of = lambda *pairs: F.concat(*(x for k, v in pairs for x in (F.lit(f'{k} "'), F.col(v), F.lit('"; '))))
    ids = of(("gene_id", "gene_id"), ("transcript_id", "tx_id"))
    at = lambda n, s, text: [F.struct("chrom", s.alias("s"), F.lit(n).alias("n")).alias("_at"), text.alias("value")]
    g = genes.select(*at(0, F.col("start"), line("gene", F.col("start"), F.col("end"), F.lit("+"), of(("gene_id", "gene_id"), ("gene_name", "gene_name"), ("gene_type", "gene_type")))))
    t = tx.select(*at(1, F.col("start"), line("transcript", F.col("start"), F.col("end"), F.col("strand"), ids)))
    x = tx.select("chrom", "strand", "gene_id", "tx_id", F.explode("exons").alias("x")).select(*at(2, F.col("x.s"), line("exon", F.col("x.s"), F.col("x.e"), F.col("strand"), ids)))
    g.unionByName(t).unionByName(x).repartitionByRange("_at").sortWithinPartitions("_at").select("value").write.mode("overwrite").text(path)


def transcripts(gtf: DataFrame) -> DataFrame:
    """tx_id, gene_id, chrom, start, end, strand, exons, sj, is_mono, attrs; one shuffle, on the transcript's id."""
    df = gtf.filter(F.col("feature").isin("transcript", "exon")).withColumn("tx_id", attr(F.col("attrs"), "transcript_id"))
    is_tx = F.col("feature") == "transcript"
    one = df.groupBy("tx_id", "chrom").agg(
        F.max(F.when(is_tx, F.struct("s", "e", "strand", "attrs"))).alias("t"),
        F.array_sort(F.collect_set(F.when(~is_tx & (F.col("e") > F.col("s")), F.struct("s", "e")))).alias("exons"),
    )
    one = one.filter(F.col("tx_id").isNotNull() & F.col("t").isNotNull() & (F.size("exons") > 0) & F.col("t.strand").isin("+", "-"))
    return one.select("tx_id", attr(F.col("t.attrs"), "gene_id").alias("gene_id"), "chrom", F.col("t.s").alias("start"), F.col("t.e").alias("end"), "t.strand", "exons", junctions(F.col("exons")).alias("sj"), (F.size("exons") == 1).alias("is_mono"), "t.attrs")


def genes(gtf: DataFrame) -> DataFrame:
    """gene_id, gene_name, gene_type, chrom, start, end, sites (distinct exon edges in order)."""
    df = gtf.filter(F.col("feature").isin("gene", "exon")).withColumn("gene_id", attr(F.col("attrs"), "gene_id")).filter("gene_id is not null")
    is_gene = F.col("feature") == "gene"
    kind = F.coalesce(attr(F.col("attrs"), "gene_type"), F.lit("unknown"))
    edges = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~is_gene, F.array("s", "e"))))))
    one = df.groupBy("gene_id", "chrom").agg(F.max(F.when(is_gene, F.struct("s", "e", attr(F.col("attrs"), "gene_name").alias("name"), kind.alias("kind")))).alias("g"), edges.alias("sites"))
    return one.filter("g is not null").select("gene_id", F.col("g.name").alias("gene_name"), F.col("g.kind").alias("gene_type"), "chrom", F.col("g.s").alias("start"), F.col("g.e").alias("end"), "sites")


def transcripts_as_reads(tx: DataFrame, sample_id: int, tid: bool = True, gid: bool = True) -> DataFrame:
    """Transcripts in the form of reads, with their ids as info pairs TID and GID."""
    pairs = ([F.struct(F.lit("TID").alias("k"), F.col("tx_id").alias("v"))] if tid else []) + ([F.struct(F.lit("GID").alias("k"), F.col("gene_id").alias("v"))] if gid else [])
    none = F.array().cast("array<struct<k:string,v:string>>")
    supp = F.array().cast("array<struct<chrom:string,s:bigint,e:bigint,strand:string>>")
    return tx.select(F.lit(sample_id).alias("sample_id"), "chrom", "strand", "exons", supp.alias("supp"), (F.array(*pairs) if pairs else none).alias("info"))
