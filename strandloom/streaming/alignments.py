"""Alignment files as a stream: the batch parser and measures, and best rows kept as streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.alignments import measured
from strandloom.sources.readers import parse_gaf


def stream_gaf(spark: SparkSession, folder: str) -> DataFrame:
    """Measured alignment rows of GAF files as they arrive in ``folder``."""
    lines = spark.readStream.format("text").load(folder).select("value", F.input_file_name().alias("source_file"))
    return measured(parse_gaf(lines, "permissive"))


def running_best(rows: DataFrame) -> DataFrame:
    """query_name and its best row so far (update or complete mode)."""
    key = F.struct("normalized_score", "identity", "coverage", "mapping_quality")
    return rows.groupBy("query_name").agg(F.max_by(F.struct("path", "identity", "coverage", "mapping_quality", "alignment_score", "normalized_score"), key).alias("b"), F.count("*").alias("rows")).select("query_name", "b.*", "rows")
