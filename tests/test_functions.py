import duckdb
import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignment as al
from strandloom.functions.sequence import is_valid_dna, normalize_sequence, parse_header, wrapped
from strandloom.operators import alignments
from strandloom.sources.readers import parse_gaf


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(
    ("header", "gene", "label"),
    [("PSEN1_H_35", "PSEN1", "HEALTHY"), (" app_U_1 ", "APP", "UNHEALTHY"), ("ref|NC_000014.9|:1-2", "PSEN1", "REFERENCE"), ("ref|XX|:1-2", "UNKNOWN", "REFERENCE")],
)
def test_header(spark, header, gene, label):
    r = one(spark.range(1).select(parse_header(F.lit(header))))
    assert (r["gene"], r["label"], r["is_reference"]) == (gene, label, label == "REFERENCE")


def test_bad_header(spark):
    assert one(spark.range(1).select(parse_header(F.lit("PSEN1_X_1")))) is None
    with pytest.raises(Exception, match="not a sequence header"):
        spark.range(1).select(parse_header(F.lit("PSEN1_X_1"), failfast=True)).collect()


def test_sequences(spark):
    assert one(spark.range(1).select(normalize_sequence(F.lit(" ac\tg\nn ")))) == "ACGN"
    assert [one(spark.range(1).select(is_valid_dna(F.lit(s)))) for s in ("ACGTN", "", "ACX", "ACG\n", None)] == [True, False, False, False, False]
    assert one(spark.range(1).select(wrapped(F.lit("A" * 170)))) == "\n".join(["A" * 80, "A" * 80, "A" * 10])
    assert one(spark.range(1).select(wrapped(F.lit("A" * 160)))) == "\n".join(["A" * 80, "A" * 80])


LINES = [
    "q1\t100\t0\t90\t+\t>a<b>a\t120\t5\t95\t80\t90\t30\tNM:i:10",
    "q1\t100\t0\t90\t+\t>a\t120\t5\t95\t80\t90\t60\tAS:i:85",
    "q2\t0\t0\t0\t+\tref|x|:1-2\t9\t5\t3\t0\t0\t0\tAS:i:zz\tbad\tz:Z:a:b\tAS:i:zz",
    "   ",
]


def gaf(spark):
    return parse_gaf(spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "line_no int, value string"))


def test_gaf(spark):
    rows = alignments.measured(gaf(spark)).orderBy("line_no").collect()
    a, b, c = rows
    assert a["identity"] == 80 / 90 and a["coverage"] == 0.9 and a["alignment_score"] == 80 and a["normalized_score"] == 0.8
    assert a["nodes"] == ["a", "b", "a"] and a["mismatches"] == 10
    assert b["alignment_score"] == 85 and b["normalized_score"] == 0.85 and b["mismatches"] == 0
    assert c["identity"] == c["coverage"] == c["normalized_score"] == 0 and c["path_span"] == 0 and c["nodes"] == ["ref|x|:1-2"] and c["tags"] == {"AS": "zz", "z": "a:b"}
    best = {r["query_name"]: r["line_no"] for r in alignments.best_alignment(alignments.measured(gaf(spark))).collect()}
    assert best == {"q1": 1, "q2": 2}
    total = one(alignments.best_alignment(alignments.measured(gaf(spark))).where("query_name = 'q1'").select(al.composite_score(F.col("identity"), F.col("coverage"), F.col("mapping_quality"), F.col("normalized_score"))))
    assert total == pytest.approx(0.9075)


def test_short_gaf_line(spark):
    short = spark.createDataFrame([("\t".join("x" * 11),)], "value string")
    with pytest.raises(Exception, match="12 fields"):
        parse_gaf(short).collect()
    assert parse_gaf(short, "permissive").first()["_corrupt_record"]


def test_frequency_and_revisits(spark):
    nodes = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    r = spark.range(1).select(al.revisits(nodes), al.traversal_frequency(nodes), al.effective_node_length(F.lit(40)), al.effective_node_length(F.lit(None).cast("int"))).first()
    assert tuple(r) == (1, 1.5, 12, 1)


def test_verdict(spark):
    v = lambda h, u: one(spark.range(1).select(al.verdict(F.lit(h), F.lit(u))))
    assert v(0.5, 0.5)["label"] == "HEALTHY" and v(0.5, 0.5)["tie_like"] and v(0.2, 0.6)["label"] == "UNHEALTHY"
    assert v(0.2, 0.6)["confidence"] == pytest.approx(0.5)


def test_doubles_round_as_in_sql(spark):
    # u / (h + u) of evidence at halves of the ninth decimal, where decimal rounding differs
    x = [0.797, 0.8086388888888889, 0.8091923076923078], [0.9096666666666666, 0.8075227272727272, 0.8318333333333333]
    values = [u / (h + u) for h, u in zip(*x, strict=True)] + [0.0, 0.5, 1.0, -0.25, 0.0009765625, 1 / 5120, 2 / 3, 1e-10, 123.4567890125, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = [duckdb.sql(f"select round('{v!r}'::double, 9)").fetchall()[0][0] for v in values]
    rows = df.select(al.nearest(F.col("v"), 9), F.round("v", 9)).collect()
    assert [r[0] for r in rows] == want
    assert any(r[1] != w for r, w in zip(rows, want, strict=True))
