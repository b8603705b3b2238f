"""Readers.  Each parses lines with column functions, so files split and columns prune as Spark likes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.alignment import tag_triples, tags_of
from strandloom.functions.sequence import is_valid_dna, normalize_sequence, parse_header

GAF_FIELDS = {
    "query_name": "string", "query_length": "bigint", "query_start": "bigint", "query_end": "bigint", "strand": "string", "path": "string",
    "path_length": "bigint", "path_start": "bigint", "path_end": "bigint", "residue_matches": "bigint", "alignment_block_length": "bigint", "mapping_quality": "int",
}

MANIFEST = "map<string, struct<reference: string, healthy: array<struct<sequence_id: string, path: string>>, unhealthy: array<struct<sequence_id: string, path: string>>>>"

FEATURES = "sequence_id string, split string, gene string, label_name string, label int, alignment_score double, mapq double, alignment_length double, query_coverage double, matched_graph_nodes double, traversed_graph_paths double, healthy_overlap_score double, unhealthy_overlap_score double, healthy_unhealthy_score_ratio double, mismatches double, graph_branches_traversed double, graph_path_complexity double, identity_percentage double, path_traversal_frequency double, node_revisit_count double"


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sequence_id, header, sequence (as written, without line ends), source_file, ord; ``paths`` may be globs.

    A record is what stands between line starts with '>', so large files split inside.  ``ord`` orders records
    within a file and is fixed by file offsets alone.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return parse_fasta(raw.where(F.trim("value") != "")).withColumn("ord", F.struct("block", "at")).drop("block", "at")


def parse_fasta(records: DataFrame) -> DataFrame:
    """Adds sequence_id, header and sequence to ``records`` (value: a record with or without its '>')."""
    text = F.regexp_replace("value", r"^\s*>", "")
    header = F.trim(F.regexp_extract(text, r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"[\r\n]", "")
    return records.select("*", F.split(header, r"\s+")[0].alias("sequence_id"), header.alias("header"), body.alias("sequence")).drop("value")


def labelled_sequences(fasta: DataFrame, failfast: bool = True) -> DataFrame:
    """Adds gene, label, is_reference, and the normalized sequence with its length and validity."""
    s = normalize_sequence(F.col("sequence"))
    h = parse_header(F.col("sequence_id"), failfast)
    return fasta.withColumn("sequence", s).withColumn("__h", h).select("*", "__h.gene", "__h.label", "__h.is_reference", F.length("sequence").alias("length"), is_valid_dna(F.col("sequence")).alias("valid")).drop("__h")


def query_from_string(spark: SparkSession, sequence: str, name: str = "query") -> DataFrame:
    """A one-row sequence table; an error if the sequence is no DNA."""
    s = normalize_sequence(F.lit(sequence))
    return spark.range(1).select(F.lit(name).alias("sequence_id"), F.when(is_valid_dna(s), s).otherwise(F.raise_error(F.lit("the query sequence must be A, C, G, T or N"))).alias("sequence"))


def read_gfa(spark: SparkSession, paths: str | list[str], graph_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, links) of GFA files; graph_id is the file's name without its end unless given."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.gfa)?$", 1) if graph_id is None else graph_id
    lines = spark.read.text(paths).select("value", name.alias("graph_id"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"))
    return parse_gfa(lines)


def parse_gfa(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, links) of ``lines`` (graph_id, line_no, value); other records and blank lines are skipped."""
    f = F.split(F.regexp_replace("value", r"\s+$", ""), "\t")
    cut = lines.select("graph_id", "line_no", f.alias("f"))
    tag = lambda key: F.regexp_extract(F.concat_ws("\t", F.slice("f", 4, 100)), rf"(?:^|\t){key}:[A-Za-z]:([^\t]*)", 1)
    segments = cut.where((F.col("f")[0] == "S") & (F.size("f") >= 3)).select(
        "graph_id", F.col("f")[1].alias("node"), F.col("f")[2].alias("sequence"), F.length(F.col("f")[2]).alias("length"),
        F.nullif(tag("SN"), F.lit("")).alias("sn"), tag("SO").try_cast("bigint").alias("so"), tag("SR").try_cast("int").alias("sr"))
    links = cut.where((F.col("f")[0] == "L") & (F.size("f") >= 5)).select(
        "graph_id", F.col("f")[1].alias("src"), F.col("f")[3].alias("dst"), F.col("f")[2].alias("src_orient"), F.col("f")[4].alias("dst_orient"), F.lit(False).alias("synthetic"), "line_no")
    return segments, links


def read_gaf(spark: SparkSession, paths: str | list[str], mode: str = "failfast") -> DataFrame:
    """Alignment rows of GAF files, with source_file and line_no (file, offset, place)."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"))
    return parse_gaf(lines, mode)


def parse_gaf(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """Alignment rows of ``lines`` (value and other columns, which stay); blank lines are skipped.

    A line of fewer than 12 fields is an error; with mode "permissive" its fields are null and the line is kept
    in _corrupt_record.
    """
    f = F.split(F.rtrim("value", F.lit(" \t\n\x0b\f\r")), "\t")
    # a generator of one row: filters on what follows stop above it, so a line is made and split once
    cut = lines.select("*", F.explode(F.array(f)).alias("__f")).where((F.size("__f") > 1) | (F.col("__f")[0] != ""))
    cut = cut.withColumn("__t", tag_triples(F.slice("__f", len(GAF_FIELDS) + 1, F.greatest(F.size("__f"), F.lit(1)))))
    short = F.size("__f") < len(GAF_FIELDS)
    bad = F.raise_error(F.concat(F.lit("a GAF line needs 12 fields: "), F.col("value"))) if mode == "failfast" else F.lit(None)
    cols = []
    for i, (name, kind) in enumerate(GAF_FIELDS.items()):
        x = F.col("__f")[i] if mode == "failfast" else F.get("__f", F.lit(i))
        cols.append(F.when(short, bad.cast(kind)).otherwise(x.cast(kind) if mode == "failfast" else x.try_cast(kind)).alias(name))
    tags = F.when(~short, tags_of(F.col("__t"))).alias("tags")
    extra = [] if mode == "failfast" else [F.when(short, F.col("value")).alias("_corrupt_record")]
    keep = [c for c in lines.columns if c != "value"]
    return cut.select(*keep, *cols, tags, *extra)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """gene, bucket (reference, healthy, unhealthy), sequence_id, path of a manifest file (gene to buckets)."""
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", MANIFEST)).alias("gene", "b"))
    part = lambda bucket: one.select("gene", F.lit(bucket).alias("bucket"), F.explode(f"b.{bucket}").alias("s")).select("gene", "bucket", "s.*")
    reference = one.where("b.reference is not null").select("gene", F.lit("reference").alias("bucket"), F.lit(None).cast("string").alias("sequence_id"), F.col("b.reference").alias("path"))
    return reference.unionByName(part("healthy")).unionByName(part("unhealthy"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).csv(path, header=True)
