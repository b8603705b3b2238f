"""Registered queries that write the given tables in the engine's file formats and read them back, and queries of the
smaller sequence, graph and anchor operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators import chaining, graphs, ml, sequences
from strandloom.operators.loops import new_folder, table_of
from strandloom.plans import views
from strandloom.plans.queries import classified, features, judged, registered, rounded, walks
from strandloom.sources import readers, writers


def bases(name: Column) -> Column:
    """Bases made from a name."""
    return F.translate(F.md5(name), "0123456789abcdef", "ACGTACGTACGTACGT")


# ---- files


@registered
def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA in folders by label and gene, found by a glob, read and labelled again."""
    path = new_folder(spark, "fasta")
    writers.write_fasta(sequences.valid(views.sequences(spark, sf_dir)), path, partition_by=("label", "gene"))
    back = readers.labelled_sequences(readers.read_fasta(spark, f"{path}/*/*/*.txt").select("sequence_id", "sequence"))
    return back.select("sequence_id", "gene", "label", "length", F.md5("sequence").alias("digest"), "valid")


@registered
def combined_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gene's sequences in one file, healthy before unhealthy, and their places when read again."""
    path = new_folder(spark, "combined")
    ordered = writers.combined_order(sequences.valid(views.sequences(spark, sf_dir)))
    writers.fasta_lines(ordered).write.text(path)
    back = readers.labelled_sequences(readers.read_fasta(spark, path))
    place = F.row_number().over(W.partitionBy("gene").orderBy("source_file", "ord"))
    return back.select("gene", "sequence_id", place.alias("place"))


@registered
def gfa_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = readers.read_gfa(spark, gfa_file(spark, sf_dir), F.lit("all"))
    return segments.select("graph_id", "node", "length", F.md5("sequence").alias("digest"), "sn", "so", "sr")


@registered
def gfa_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = readers.read_gfa(spark, gfa_file(spark, sf_dir), F.lit("all"))
    return links.groupBy("graph_id", "src", "dst", "src_orient", "dst_orient").agg(F.count("*").alias("n"))


def gfa_file(spark: SparkSession, sf_dir: str) -> str:
    """Parts as segments (two of three with stable coordinates) and lineitem rows as links, in one folder."""
    path, n = new_folder(spark, "gfa"), (10 + F.col("p_partkey") % 20).cast("int")
    node = F.concat(F.lit("p"), F.col("p_partkey"))
    tags = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("\tSN:Z:chr"), F.col("p_partkey") % 4, F.lit("\tSO:i:"), F.col("p_partkey") * 40, F.lit("\tSR:i:0"))).otherwise("")
    s = views.table(spark, sf_dir, "part").select(F.concat(F.lit("S\t"), node, F.lit("\t"), F.substring(bases(node), F.lit(1), n), F.lit("\tLN:i:"), n, tags).alias("value"))
    orient = F.when(F.col("l_returnflag") == "A", "-").otherwise("+")
    li = views.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("L\tp"), F.col("l_partkey"), F.lit("\t+\ts"), F.col("l_suppkey"), F.lit("\t"), orient, F.lit("\t0M")).alias("value"))
    s.unionByName(li).write.text(path)
    return path


@registered
def gaf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAF files in a folder a class graph, some lines cut short, read in permissive mode."""
    path = new_folder(spark, "gaf")
    lines = views.gaf_lines(spark, sf_dir)
    cut = F.when(F.col("value").contains("NM:i:3\t") | F.col("value").endswith("NM:i:3"), F.substring_index("value", "\t", 5)).otherwise(F.col("value"))
    lines.select("graph_class", cut.alias("value")).write.partitionBy("graph_class").text(path)
    back = readers.read_gaf(spark, f"{path}/*/*.txt", mode="permissive")
    source = F.regexp_extract("source_file", "graph_class=([a-z]+)", 1)
    return back.select(source.alias("source"), "query_name", "path", "residue_matches", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@registered
def gaf_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment rows exported with their measures as JSON, and read again."""
    path = new_folder(spark, "gaf-json")
    out = writers.gaf_export(readers.parse_gaf(views.gaf_lines(spark, sf_dir).select("value")))
    writers.write_json(out, path)
    back = spark.read.schema(out.schema).json(path)
    return rounded(back.select("query_name", "coverage", "identity", "alignment_score", F.array_join("traversed_nodes", ",").alias("traversed_nodes")), "coverage", "identity")


@registered
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of each gene's distinct sequences, written as one JSON object and read again."""
    path = new_folder(spark, "manifest")
    s = sequences.dedup_first(sequences.valid(views.sequences(spark, sf_dir)))
    rows = s.select("gene", "label", "sequence_id", F.concat(F.lit("seq/"), F.col("sequence_id"), F.lit(".fa")).alias("path"), "ord")
    refs = s.select("gene").distinct().select("gene", F.lit("REFERENCE").alias("label"), F.lit(None).cast("string").alias("sequence_id"), F.concat(F.lit("ref/"), F.col("gene"), F.lit(".fa")).alias("path"), F.lit(None).cast(s.schema["ord"].dataType).alias("ord"))
    m = writers.to_manifest(rows.unionByName(refs))
    # a manifest is one object: a gene a key
    body = F.to_json(F.map_from_entries(F.collect_list(F.struct("gene", F.struct("reference", "healthy", "unhealthy")))))
    m.agg(body.alias("value")).write.text(path)
    return readers.read_manifest(spark, path)


@registered
def feature_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table written as CSV in a folder a split, and read again."""
    path, ratio = new_folder(spark, "features"), "healthy_unhealthy_score_ratio"
    # written once, as each split reads it
    rows = table_of(rounded(rounded(features(spark, sf_dir), *(c for c in ml.NUMERIC if c != ratio)), ratio, digits=3), "features")
    for part in ("train", "test"):
        writers.write_csv(ml.split_of(rows, part), f"{path}/{part}")
    return readers.read_features(spark, f"{path}/*")


# ---- sequences


@registered
def unknown_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of genes without a graph; graphs are those of unhealthy documents divisible by seven."""
    s = views.sequences(spark, sf_dir)
    return sequences.check_known_gene(s.select("sequence_id", "gene"), s.where((F.col("label") == "UNHEALTHY") & (F.col("ord") % 7 == 0)))


@registered
def missing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sequences(spark, sf_dir)
    wanted = s.select("gene").distinct().select("gene", F.explode(F.array(*map(F.lit, ("healthy", "unhealthy", "combined", "other")))).alias("graph_class"))
    return sequences.check_samples(sequences.valid(s), wanted)


@registered
def graph_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.graph_samples(sequences.dedup_first(sequences.valid(views.sequences(spark, sf_dir)))).select("gene", "graph_class", "sequence_id")


@registered
def sequence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of the rated documents, by id."""
    s = views.sequences(spark, sf_dir)
    ids = s.join(views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord")).distinct(), "ord").select("sequence_id")
    return sequences.sequence_lookup(ids, s.select("sequence_id", F.md5("sequence").alias("digest")))


@registered
def split_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split with each row's place in input order."""
    s = sequences.stratified_split(sequences.dedup_first(sequences.valid(views.sequences(spark, sf_dir))))
    return sequences.in_order(s).select("gene", "label", "sequence_id", "split", "place")


@registered
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("query_name", "explanation")


# ---- graphs and anchors


@registered
def branching_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.branching_nodes(graphs.degrees(views.edges(spark, sf_dir))).select("graph_id", "node")


@registered
def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared nodes (all but one name) and those that links name."""
    return graphs.all_nodes(views.segments(spark, sf_dir).where("node <> 'n0'"), views.links(spark, sf_dir))


@registered
def cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the path cover holds every node once."""
    nodes = views.segments(spark, sf_dir)
    found = graphs.covers(graphs.path_cover(views.dag_edges(spark, sf_dir), nodes), nodes)
    return spark.range(1).select(F.lit(found).alias("covers"))


@registered
def walk_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = views.segments(spark, sf_dir).withColumn("sequence", bases(F.col("node")))
    return graphs.walk_sequence(graphs.sample_walk(views.edges(spark, sf_dir)), segments)


@registered
def context_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graphs.context_snapshot(views.edges(spark, sf_dir), 4, 2)
    return out.withColumn("node_list", F.array_join("node_list", ","))


@registered
def anchors_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = walks(spark, sf_dir)
    nodes = w.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("node"))
    return chaining.anchors_per_node(nodes, w.withColumnRenamed("node", "vertex"))


@registered
def anchor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.ordered(views.anchors(spark, sf_dir)).select("query_id", "anchor_id", "ord")


# ---- models


@registered
def prediction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with the label and probability that each of two linear models gives."""
    f = table_of(features(spark, sf_dir), "features")
    models = {k: ml.train(ml.split_of(f, "train"), k) for k in ("logistic_regression", "svm")}
    return ml.prediction_records(models, ml.split_of(f, "test"))


@registered
def rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows as the rules judge them, in the form of a model's predictions."""
    return judged(spark, sf_dir).where("split = 'test'").select(F.col("query_name").alias("sequence_id"), "gene", F.col("truth").alias("label_name"), F.col("label").alias("predicted"), F.col("score").alias("probability"))
