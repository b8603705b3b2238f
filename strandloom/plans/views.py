"""The given star-schema tables seen as the engine's data model; whole tables, nothing left out.

* sequences: documents, their text reduced to A, C, G and T, gene by language, label by rating;
* alignments: lineitem rows written as GAF lines and parsed back by the GAF reader;
* graphs: one small graph an order, its nodes five, its links from each line to the next;
* anchors: lineitem rows on a fixed graph of twelve nodes, one query an order;
* segments and intervals: parts and lineitem rows on four coordinate axes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.alignment import nearest
from strandloom.operators import alignments
from strandloom.sources.readers import labelled_sequences, parse_gaf

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence_id, gene, label, is_reference, sequence, length, valid, ord of every document."""
    rated = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(rated, "doc_id", "left")
    letter = F.when(F.coalesce("quality", F.lit(1)) == 1, "H").otherwise("U")
    header = F.concat(F.upper("lang"), F.lit("_"), letter, F.lit("_"), F.col("doc_id"))
    raw = docs.select(F.col("doc_id").alias("ord"), header.alias("sequence_id"), F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("sequence"))
    return labelled_sequences(raw)


def gaf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value (a GAF line), graph_class, gene, line_no of every lineitem row."""
    n = lambda c: nearest(c, 0).cast("bigint").cast("string")
    block, nm = 90 * F.col("l_quantity"), nearest(100 * F.col("l_discount"), 0)
    path = F.concat(F.lit(">p"), F.col("l_partkey"), F.lit("<p"), F.col("l_suppkey"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(">p"), F.col("l_partkey"))).otherwise(""))
    fields = [F.concat(F.lit("q"), F.col("l_orderkey")), n(100 * F.col("l_quantity")), F.lit("0"), n(block), F.lit("+"), path, F.lit("1000"), F.lit("0"), n(block), n(block - nm), n(block), n(F.least(F.lit(60), 10 * nearest(100 * F.col("l_tax"), 0))), F.lit("tp:A:P"), F.concat(F.lit("NM:i:"), n(nm)), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("AS:i:"), n(block - nm + 1)))]
    rows = table(spark, sf_dir, "lineitem")
    of_class = F.element_at(F.array(*map(F.lit, alignments.CLASSES)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return rows.select(F.concat_ws("\t", *fields).alias("value"), of_class.alias("graph_class"), F.concat(F.lit("g"), F.col("l_partkey") % 3).alias("gene"), F.struct(*LINE_ORDER).alias("line_no"))


def gaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.measured(parse_gaf(gaf_lines(spark, sf_dir)))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_name, gene, truth, split of every order."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("q"), F.col("o_orderkey")).alias("query_name"), F.concat(F.lit("g"), F.col("o_custkey") % 3).alias("gene"), F.when(F.col("o_orderpriority").startswith("1"), "UNHEALTHY").otherwise("HEALTHY").alias("truth"), F.when(F.col("o_custkey") % 5 == 0, "test").otherwise("train").alias("split"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, src, dst, orientations, line_no: from each line of an order to its next ones."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("node"), F.when(F.col("l_returnflag") == "A", "-").otherwise("+").alias("orient"))
    a = rows.select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("n"), F.col("node")).alias("src"), F.col("orient").alias("src_orient"))
    b = rows.select(F.col("l_orderkey").alias("graph_id"), (F.col("l_linenumber") - 1).alias("line_no"), F.concat(F.lit("n"), F.col("node")).alias("dst"), F.col("orient").alias("dst_orient"))
    return a.join(b, ["graph_id", "line_no"]).withColumn("line_no", F.struct("line_no", "src_orient", "dst_orient"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, node: the nodes that an order's lines name."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.concat(F.lit("n"), F.col("l_partkey") % 5).alias("node")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select("graph_id", "src", "dst").distinct()


def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where("src < dst")


def mini_graph(spark: SparkSession) -> DataFrame:
    """Edges (graph_id 0) of the fixed graph of twelve nodes: i to i + 1 and i + 3, and 7 back to 4."""
    pairs = [(i, i + s) for s in (1, 3) for i in range(1, 13 - s)] + [(7, 4)]
    return spark.createDataFrame([(0, a, b) for a, b in pairs], "graph_id int, src int, dst int")


def anchors(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """query_id, anchor_id, vertex, x, y, c, d, weight of every lineitem row; ids are numbers in the query's order, or if
    that is not asked for any distinct ones, which costs no shuffle of whole lines."""
    from pyspark.sql import Window as W

    span = (1 + F.col("l_quantity").cast("bigint") % 8)
    c = 8 * F.col("l_linenumber") + F.col("l_partkey") % 2
    x = 1 + F.col("l_suppkey") % 4
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) if numbered else F.monotonically_increasing_id()
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), number.alias("anchor_id"), (F.col("l_partkey") % 12 + 1).cast("int").alias("vertex"), x.alias("x"), (x + span - 1).alias("y"), c.alias("c"), (c + span - 1).alias("d"), (2 * span).alias("weight"))


def stable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sn, node, so, length of every part: axis by part key, fifty bases apart, sizes twice the part's."""
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 4).alias("sn"), F.col("p_partkey").alias("node"), (F.floor(F.col("p_partkey") / 4) * 50).alias("so"), (2 * F.col("p_size")).cast("bigint").alias("length"))


def stable_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sn, start, end, interval_id of every order."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_custkey") * 3
    return o.select(F.col("o_orderkey").alias("interval_id"), (F.col("o_orderkey") % 4).alias("sn"), start.alias("start"), (start + 20 + F.col("o_orderkey") % 100).alias("end"))
