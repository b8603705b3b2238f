"""Cleaning, de-duplication, splitting and summaries of labelled sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def valid(seqs: DataFrame) -> DataFrame:
    return seqs.where("valid")


def dedup_first(seqs: DataFrame, keys: tuple[str, ...] = ("gene", "label"), order: str = "ord") -> DataFrame:
    """The first row (by ``order``) of each sequence within ``keys``.

    A minimum by group, pre-aggregated before the shuffle, so a sequence that is repeated without end costs a
    row a task; sequences travel as 256-bit digests.
    """
    digest = F.sha2("sequence", 256)
    rest = [c for c in seqs.columns if c not in keys]
    return seqs.groupBy(*keys, digest.alias("__d")).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def stratified_split(seqs: DataFrame, test_fraction: float = 0.2, seed: int = 42, strata: tuple[str, ...] = ("gene", "label"), id_col: str = "sequence_id") -> DataFrame:
    """Adds split: of each stratum the round(fraction * n) rows (half to even, at least 1, at most n - 1) that come
    first in the order of md5(seed, id) are test.

    The order is cut by rank without bringing a stratum together: ids are counted by the first digits of their
    digest, and only the bucket that holds the border is ranked.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between 0 and 1")
    keyed = seqs.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col))))
    bucket = F.substring("__h", 1, 4)
    sizes = keyed.groupBy(*strata, bucket.alias("__b")).agg(F.count("*").alias("__c"))
    w = W.partitionBy(*strata)
    n = F.sum("__c").over(w)
    want = F.least(F.greatest(F.bround(n * test_fraction), F.lit(1)), n - 1)
    before = F.coalesce(F.sum("__c").over(w.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = sizes.select(*strata, "__b", (want - before).alias("__left"), "__c")  # 65536 rows a stratum at most
    named = keyed.withColumn("__b", bucket).join(plan, [*strata, "__b"])
    whole = named.where("__left >= __c or __left <= 0").withColumn("split", F.when(F.col("__left") > 0, "test").otherwise("train"))
    rank = F.row_number().over(W.partitionBy(*strata, "__b").orderBy("__h", id_col))
    border = named.where("__left < __c and __left > 0").withColumn("split", F.when(rank <= F.col("__left"), "test").otherwise("train"))
    return whole.unionByName(border).drop("__h", "__b", "__left", "__c")


def in_order(split: DataFrame, keys: tuple[str, ...] = ("gene", "label", "split"), order: str = "ord") -> DataFrame:
    """Adds place: the row's place (from 1) in input order within ``keys``, as an output file lists it."""
    return split.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(order)))


def preprocess_summary(raw: DataFrame) -> DataFrame:
    """By gene and label: records, invalid ones, duplicates skipped, rows kept.  ``raw``: gene, label, sequence, valid."""
    per = raw.groupBy("gene", "label", F.when(F.col("valid"), F.sha2("sequence", 256)).alias("d")).agg(F.count("*").alias("n"), F.first("valid").alias("valid"))
    return per.groupBy("gene", "label").agg(
        F.sum("n").alias("records"), F.coalesce(F.sum(F.when(~F.col("valid"), F.col("n"))), F.lit(0)).alias("invalid_skipped"),
        F.coalesce(F.sum(F.when(F.col("valid"), F.col("n") - 1)), F.lit(0)).alias("duplicates_skipped"), F.count_if(F.col("valid")).alias("kept"))


def split_counts(split: DataFrame) -> DataFrame:
    """By gene and label: rows, train, test."""
    return split.groupBy("gene", "label").agg(F.count("*").alias("total"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


def split_rollup(split: DataFrame) -> DataFrame:
    """By gene, with an Overall row: rows, train, test and each label's share of them."""
    parts = {f"{lab.lower()}_{s}": F.count_if((F.col("label") == lab) & (F.col("split") == s)) for lab in ("HEALTHY", "UNHEALTHY") for s in ("train", "test")}
    return split.rollup("gene").agg(F.count("*").alias("total"), *(v.alias(k) for k, v in parts.items()), F.grouping("gene").alias("g")).select(F.when(F.col("g") == 1, "Overall").otherwise(F.col("gene")).alias("gene"), "total", *parts)


def check_one_reference(seqs: DataFrame) -> DataFrame:
    """Genes without exactly one reference: gene, references."""
    return seqs.groupBy("gene").agg(F.count_if(F.col("is_reference")).alias("references")).where("references <> 1")


def check_splittable(seqs: DataFrame) -> DataFrame:
    """Strata of fewer than two sequences: gene, label, total."""
    return seqs.groupBy("gene", "label").agg(F.count("*").alias("total")).where("total < 2")


def check_known_gene(queries: DataFrame, graphs: DataFrame) -> DataFrame:
    """Queries whose gene has no graph."""
    return queries.join(graphs.select("gene").distinct(), "gene", "left_anti")


def check_samples(seqs: DataFrame, graphs: DataFrame) -> DataFrame:
    """Graphs (gene, graph_class) without a sample to build them from; a combined graph takes either label."""
    have = seqs.where("not is_reference").select("gene", F.lower("label").alias("graph_class")).distinct()
    have = have.unionByName(have.select("gene", F.lit("combined").alias("graph_class")).distinct())
    return graphs.select("gene", "graph_class").join(have, ["gene", "graph_class"], "left_anti")


def graph_samples(seqs: DataFrame) -> DataFrame:
    """(gene, graph_class, sequence ...): each labelled row for its class graph and, after it, for the combined one."""
    own = seqs.where("not is_reference").withColumn("graph_class", F.lower("label"))
    return own.unionByName(own.withColumn("graph_class", F.lit("combined")))


def sequence_lookup(ids: DataFrame, seqs: DataFrame) -> DataFrame:
    """Sequences of the wanted ids."""
    return ids.join(seqs, "sequence_id")
