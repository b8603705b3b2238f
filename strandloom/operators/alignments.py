"""Best alignments, rollups, rule-based classification, gene detection, path features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import alignment as al
from strandloom.functions.sequence import label_to_int

CLASSES = ("healthy", "unhealthy", "combined")


def measured(gaf: DataFrame) -> DataFrame:
    """Alignment rows with identity, coverage, path_span, score, normalized_score, nodes and mismatches."""
    c = F.col
    scored = gaf.withColumns({
        "identity": al.identity(c("residue_matches"), c("alignment_block_length")), "coverage": al.coverage(c("alignment_block_length"), c("query_length")),
        "path_span": al.path_span(c("path_start"), c("path_end")), "alignment_score": al.alignment_score(c("tags"), c("residue_matches")),
        "nodes": al.traversed_nodes(c("path")), "mismatches": al.mismatches(c("tags"))})
    return scored.withColumn("normalized_score", al.ratio(c("alignment_score"), c("query_length")))


#: What the best row of a group carries; nodes follow from the path.
CARRIED = ("line_no", "path", "graph_class", "gene", "graph_id", "path_span", "identity", "coverage", "mapping_quality", "alignment_score", "normalized_score", "mismatches", "alignment_block_length")


def best_alignment(rows: DataFrame, by: tuple[str, ...] = ("query_name",), carry: tuple[str, ...] = CARRIED) -> DataFrame:
    """The best measured row of each group: normalized score, identity, coverage, mapping quality, then the first line.

    An aggregate and not a window: one row a group and task reaches the shuffle, whatever a query's rows.  Only the
    columns of ``carry`` that ``rows`` has go through it, and ``nodes`` if asked for is split from the winner's path.
    """
    rest = [c for c in carry if c in rows.columns and c not in by and c != "nodes"]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), order_of_rows()).alias("__b")).select(*by, "__b.*", *([al.traversed_nodes(F.col("__b.path")).alias("nodes")] if "path" in rest else []))


def order_of_rows() -> Column:
    """Measured rows, the best first."""
    return F.struct((-F.col("normalized_score")).alias("a"), (-F.col("identity")).alias("b"), (-F.col("coverage")).alias("c"), (-F.col("mapping_quality")).alias("d"), F.col("line_no").alias("e"))


def alignment_rollup(records: DataFrame, by: str = "gene") -> DataFrame:
    """By ``by``, with an ALL row: queries, aligned, alignment_rate, and means over the aligned.

    ``records``: one row a query with found, identity, coverage, mapping_quality, alignment_score.
    """
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("found"), F.col(c))), F.lit(0.0))
    out = records.rollup(by).agg(
        F.count("*").alias("queries"), F.count_if(F.col("found")).alias("aligned"), mean("identity").alias("mean_identity"), mean("coverage").alias("mean_coverage"),
        mean("mapping_quality").alias("mean_mapq"), mean("alignment_score").alias("mean_score"), F.grouping(by).alias("g"))
    rate = F.col("aligned") / F.greatest(F.col("queries"), F.lit(1))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(by)).alias(by), "queries", "aligned", rate.alias("alignment_rate"), "mean_identity", "mean_coverage", "mean_mapq", "mean_score")


def evaluate_alignments(gaf: DataFrame, queries: DataFrame) -> DataFrame:
    """The rollup of queries (query_name, gene) with their best alignments; queries without any count as not aligned.

    ``gaf``: measured rows, or rows as read, which are measured here."""
    best = best_alignment(gaf if "normalized_score" in gaf.columns else measured(gaf), carry=("identity", "coverage", "mapping_quality", "alignment_score"))
    return alignment_rollup(queries.join(best, "query_name", "left").withColumn("found", F.col("identity").isNotNull()))


def summary(best: Column) -> Column:
    """struct of a best row's measures with an ``available`` flag, null without a row; missing measures count 0."""
    zero = lambda c: F.coalesce(best[c].cast("double"), F.lit(0.0)).alias(c)
    return F.when(best.isNotNull(), F.struct(
        best["identity"].isNotNull().alias("available"), zero("identity"), zero("coverage"), zero("mapping_quality"), zero("alignment_score"), zero("normalized_score"),
        F.coalesce(al.traversed_nodes(best["path"]), F.array().cast("array<string>")).alias("nodes"), F.coalesce(best["mismatches"], F.lit(0)).alias("mismatches"), zero("alignment_block_length")))


def by_class(rows: DataFrame, keys: tuple[str, ...] = ("query_name",)) -> DataFrame:
    """One row a query: a summary struct of its best row in each class graph (null where it has none); one shuffle."""
    carried = F.struct("path", "identity", "coverage", "mapping_quality", "alignment_score", "normalized_score", "mismatches", "alignment_block_length")
    best = rows.groupBy(*keys).agg(*(F.min_by(carried, F.when(F.col("graph_class") == k, order_of_rows())).alias(k) for k in CLASSES))
    return best.select(*keys, *(summary(F.col(k)).alias(k) for k in CLASSES))


def part(k: str, name: str) -> Column:
    return F.coalesce(F.col(k)[name], F.lit(0.0))


def evidence(k: str) -> Column:
    return al.composite_score(part(k, "identity"), part(k, "coverage"), part(k, "mapping_quality"), part(k, "normalized_score"))


def classify(classes: DataFrame) -> DataFrame:
    """Adds healthy_score, unhealthy_score, label, confidence, tie_like, unhealthy_probability, explanation, any_available."""
    scored = classes.withColumns({"healthy_score": evidence("healthy"), "unhealthy_score": evidence("unhealthy")})
    h, u = F.col("healthy_score"), F.col("unhealthy_score")
    any_row = F.greatest(*(F.coalesce(F.col(k)["available"], F.lit(False)) for k in CLASSES))
    out = scored.withColumn("__v", al.verdict(h, u)).select("*", "__v.*").drop("__v")
    return out.withColumns({"unhealthy_probability": al.unhealthy_probability(h, u), "explanation": al.explanation(h, u, F.col("label"), F.col("tie_like")), "any_available": any_row})


def detect_gene(rows: DataFrame, top: int = 3, order: str = "gene") -> DataFrame:
    """query_name, rank, gene, normalized_score: genes by the best row against their combined graphs (rows of other
    graphs are passed over); the first is detected."""
    best = best_alignment(rows.where("graph_class = 'combined'"), ("query_name", "gene"), carry=("normalized_score", "identity", "coverage", "mapping_quality"))
    w = W.partitionBy("query_name").orderBy(F.desc("normalized_score"), F.desc("identity"), F.desc("coverage"), F.desc("mapping_quality"), order)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_name", "rank", "gene", "normalized_score")


def analyze_queries(rows: DataFrame, gene: str | None = None) -> DataFrame:
    """Classification of each query by the class graphs of its gene: the one given, or the one detected.

    ``rows``: measured rows with gene and graph_class.
    """
    chosen = rows.select("query_name").distinct().withColumn("gene", F.lit(gene)) if gene else detect_gene(rows, 1).select("query_name", "gene")
    out = classify(by_class(rows.join(chosen, ["query_name", "gene"]), ("query_name", "gene")))
    note = F.when(F.col("any_available"), "aligned").otherwise("no alignment was found")
    return out.withColumn("note", note)


def path_features(best: DataFrame, degrees: DataFrame) -> DataFrame:
    """By query: unique, total, branching nodes, mean degree, frequency, revisits of a path.

    ``best``: query_name, graph_id, nodes.  ``degrees``: graph_id, node, in_degree, out_degree.  Nodes that the
    graph lacks count in the divisor with degree 0.
    """
    n = best.select("query_name", "graph_id", F.explode(F.array_distinct("nodes")).alias("node"))
    met = n.join(degrees, ["graph_id", "node"], "left").groupBy("query_name").agg(
        F.count_if((F.col("in_degree") > 1) | (F.col("out_degree") > 1)).alias("branching_nodes"), F.sum(F.coalesce(F.col("in_degree") + F.col("out_degree"), F.lit(0))).alias("degrees"))
    size, unique = F.size("nodes"), F.size(F.array_distinct("nodes"))
    some = F.col("unique_nodes") > 0
    base = best.select("query_name", unique.alias("unique_nodes"), size.alias("total_nodes"), F.when(size > 0, al.traversal_frequency(F.col("nodes"))).otherwise(0.0).alias("frequency"), al.revisits(F.col("nodes")).alias("revisits"))
    return base.join(met, "query_name", "left").select(
        "query_name", "unique_nodes", "total_nodes", F.coalesce("branching_nodes", F.lit(0)).alias("branching_nodes"),
        F.when(some, F.col("degrees") / F.greatest(F.col("unique_nodes"), F.lit(1))).otherwise(0.0).alias("mean_degree"), "frequency", "revisits")


def extract_features(classes: DataFrame, labels: DataFrame, degrees: DataFrame) -> DataFrame:
    """The 20-column feature table.

    ``classes``: query_name, graph_id (of the combined graph) and a summary struct a class; ``labels``:
    query_name, split, gene, label_name.
    """
    no_nodes = F.array().cast("array<string>")
    paths = path_features(classes.select("query_name", "graph_id", F.coalesce(F.col("combined")["nodes"], no_nodes).alias("nodes")), degrees)
    rows = labels.join(classes, "query_name", "left").join(paths, "query_name", "left")
    h, u = part("healthy", "normalized_score"), part("unhealthy", "normalized_score")
    num = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return rows.select(
        F.col("query_name").alias("sequence_id"), "split", "gene", "label_name", label_to_int(F.col("label_name")).alias("label"),
        part("combined", "alignment_score").alias("alignment_score"), part("combined", "mapping_quality").alias("mapq"), part("combined", "alignment_block_length").alias("alignment_length"),
        part("combined", "coverage").alias("query_coverage"), num("unique_nodes").alias("matched_graph_nodes"), num("total_nodes").alias("traversed_graph_paths"),
        h.alias("healthy_overlap_score"), u.alias("unhealthy_overlap_score"), al.score_ratio(h, u).alias("healthy_unhealthy_score_ratio"),
        F.coalesce(F.col("combined")["mismatches"], F.lit(0)).cast("double").alias("mismatches"), num("branching_nodes").alias("graph_branches_traversed"), num("mean_degree").alias("graph_path_complexity"),
        (part("combined", "identity") * 100).alias("identity_percentage"), num("frequency").alias("path_traversal_frequency"), num("revisits").alias("node_revisit_count"))


def feature_summary(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("total"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


def overlay(gaf: DataFrame, segments: DataFrame, by: tuple[str, ...] = ("query_name",)) -> DataFrame:
    """(graph_id, node, highlighted): nodes touched by the first row (not the best) of a file or query."""
    first = gaf.groupBy("graph_id", *by).agg(F.min_by("path", "line_no").alias("path"))
    touched = first.select("graph_id", F.explode(al.traversed_nodes(F.col("path"))).alias("node")).distinct().withColumn("highlighted", F.lit(True))
    return segments.select("graph_id", "node").join(touched, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("highlighted", F.lit(False)).alias("highlighted"))


def resolve_stable_path(intervals: DataFrame, segments: DataFrame, width: int = 4096) -> DataFrame:
    """Segments under path intervals: the columns of ``intervals`` (sn, start, end, ...), node, and the overlap's bounds.

    An interval meets a segment in the bins of ``width`` bases that both touch, and the pair counts in the first
    of them, so the join is by (sn, bin) and finds each pair once.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    i = intervals.where("end > start").withColumn("bin", bins("start", "end"))
    s = segments.where("length > 0").select("sn", "node", F.col("so").alias("seg_start"), (F.col("so") + F.col("length")).alias("seg_end")).withColumn("bin", bins("seg_start", "seg_end"))
    low, high = F.greatest("start", "seg_start"), F.least("end", "seg_end")
    return i.join(s, ["sn", "bin"]).where((low < high) & (F.floor(low / width) == F.col("bin"))).select(*intervals.columns, "node", low.alias("from"), high.alias("to"))
