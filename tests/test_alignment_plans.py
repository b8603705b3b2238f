"""Steps that the alignment queries share are done once: read off plans, and small results beside."""

from pyspark.sql import functions as F

from strandloom.operators import alignments
from strandloom.plans import files, queries
from strandloom.sources.readers import parse_gaf


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_made_once_below_a_join(spark, sf_dir):
    plan = optimized(queries.judged(spark, sf_dir))
    assert plan.count("concat_ws(") == 1


def test_features_take_alignments_apart_once_for_edges(spark, sf_dir):
    plan = optimized(queries.features(spark, sf_dir))
    assert plan.count("concat_ws(") == 1


def test_edges_of_paths_are_compiled(spark, sf_dir):
    plan = optimized(queries.features(spark, sf_dir))
    assert "arrays_zip(" in plan and "struct(src" not in plan


def test_feature_files_make_features_once(spark, sf_dir, monkeypatch):
    made, made_of = [], files.features
    monkeypatch.setattr(files, "features", lambda *a: made_of(*a).withColumn("mapq", F.col("mapq") + F.lit(0.0)))
    monkeypatch.setattr(files.writers, "write_csv", lambda df, path: made.append(optimized(df)))
    monkeypatch.setattr(files.readers, "read_features", lambda spark, path: None)
    files.feature_files(spark, sf_dir)
    assert len(made) == 2 and all("Join" not in p and "Aggregate" not in p for p in made)


def test_blank_and_padded_lines(spark):
    line = "\t".join(["q", "100", "0", "90", "+", ">a<b", "1000", "0", "90", "80", "90", "60", "NM:i:3", "NM:i:4"])
    rows = parse_gaf(spark.createDataFrame([(line + " \t\r\n",), ("",), (" \t ",), ("\n",), (None,)], "value string")).collect()
    assert [(r["query_name"], r["residue_matches"], r["tags"]) for r in rows] == [("q", 80, {"NM": "4"})]


def test_best_row_of_each_class(spark):
    kinds = "query_name string, graph_class string, path string, identity double, coverage double, mapping_quality int, alignment_score double, normalized_score double, mismatches int, alignment_block_length bigint, line_no int"
    rows = [("a", "healthy", ">x", 0.5, 0.5, 1, 5.0, 0.5, 1, 10, 2), ("a", "healthy", ">y<z", 0.5, 0.5, 1, 5.0, 0.5, 2, 10, 1), ("a", "other", ">o", 1.0, 1.0, 9, 9.0, 1.0, 0, 10, 0), ("b", None, ">o", 1.0, 1.0, 9, 9.0, 1.0, 0, 10, 0)]
    out = {r["query_name"]: r for r in alignments.by_class(spark.createDataFrame(rows, kinds)).collect()}
    assert set(out) == {"a", "b"} and out["b"]["healthy"] is None and out["a"]["combined"] is None
    assert out["a"]["healthy"]["nodes"] == ["y", "z"] and out["a"]["healthy"]["mismatches"] == 2 and out["a"]["healthy"]["available"]


def test_judged_rows_by_stored_classes(spark, sf_dir):
    """Best rows that a query has written serve its judgement as well: the lines are not parsed once more."""
    stored = queries.judged(spark, sf_dir, queries.stored_classes(spark, sf_dir))
    plain = queries.judged(spark, sf_dir)
    assert stored.count() == plain.count() > 0 and stored.exceptAll(plain).isEmpty()
    assert "lineitem" not in "".join(stored.inputFiles()) and "lineitem" in "".join(plain.inputFiles())
