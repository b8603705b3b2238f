"""Writers: layouts of few files by partition values rather than a file a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.alignment import alignment_score, coverage, identity, traversed_nodes
from strandloom.functions.sequence import wrapped


def fasta_lines(seqs: DataFrame, width: int = 80) -> DataFrame:
    """value: a FASTA record of each row of ``seqs`` (sequence_id, sequence)."""
    return seqs.select(F.concat(F.lit(">"), F.col("sequence_id"), F.lit("\n"), wrapped(F.col("sequence"), width)).alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int = 80, partition_by: tuple[str, ...] = ()) -> None:
    """Text files of records; ``partition_by`` columns become folders (such as split, label, gene)."""
    record = F.concat(F.lit(">"), F.col("sequence_id"), F.lit("\n"), wrapped(F.col("sequence"), width)).alias("value")
    out = seqs.select(*partition_by, record)
    (out.repartition(*partition_by).write.partitionBy(*partition_by) if partition_by else out.write).text(path)


def combined_order(seqs: DataFrame) -> DataFrame:
    """Reference first, then healthy, then unhealthy, each in input order, within a gene."""
    rank = F.when(F.col("is_reference"), 0).when(F.col("label") == "HEALTHY", 1).otherwise(2)
    return seqs.repartition("gene").sortWithinPartitions("gene", rank, "ord")


def write_json(df: DataFrame, path: str) -> None:
    """Files of one object a line, compressed: names of fields in each line are most of the text."""
    df.write.option("compression", "gzip").json(path)


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.partitionBy(*partition_by).option("header", True).csv(path)


def gaf_export(gaf: DataFrame) -> DataFrame:
    """Alignment rows with coverage, identity, alignment_score and traversed_nodes for a JSON export."""
    return gaf.withColumns({
        "coverage": coverage(F.col("alignment_block_length"), F.col("query_length")),
        "identity": identity(F.col("residue_matches"), F.col("alignment_block_length")),
        "alignment_score": alignment_score(F.col("tags"), F.col("residue_matches")),
        "traversed_nodes": traversed_nodes(F.col("path")),
    })


def to_manifest(seqs: DataFrame) -> DataFrame:
    """gene, reference, healthy, unhealthy: rows (gene, label, sequence_id, path, ord) nested by gene.

    A manifest lists a gene's files, so its rows are as wide as the gene has samples.
    """
    entry = F.struct("ord", "sequence_id", "path")
    listed = lambda label: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, entry))), lambda e: F.struct(e["sequence_id"].alias("sequence_id"), e["path"].alias("path")))
    return seqs.groupBy("gene").agg(F.min(F.when(F.col("label") == "REFERENCE", F.col("path"))).alias("reference"), listed("HEALTHY").alias("healthy"), listed("UNHEALTHY").alias("unhealthy"))
