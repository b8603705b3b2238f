import json

from pyspark.sql import functions as F

from strandloom.operators import kmers, sequences
from strandloom.sources import readers, writers
from strandloom.streaming.alignments import running_best, stream_gaf


def test_fasta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("APP_H_1", "ACGT" * 50), ("APP_U_2", "TTTT")], "sequence_id string, sequence string")
    writers.write_fasta(rows, str(tmp_path / "f"))
    back = readers.read_fasta(spark, str(tmp_path / "f"))
    assert {r["sequence_id"]: r["sequence"] for r in back.collect()} == {"APP_H_1": "ACGT" * 50, "APP_U_2": "TTTT"}
    named = readers.labelled_sequences(back)
    assert {(r["gene"], r["label"], r["valid"]) for r in named.collect()} == {("APP", "HEALTHY", True), ("APP", "UNHEALTHY", True)}


def test_gfa(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("H\tVN:Z:1\nS\ts1\tACG\tLN:i:3\tSN:Z:ref\tSO:i:7\tSR:i:0\n\nS\ts2\tT\nL\ts1\t+\ts2\t-\t0M\n")
    segments, links = readers.read_gfa(spark, str(tmp_path / "g.gfa"))
    s = {r["node"]: r for r in segments.collect()}
    assert s["s1"]["graph_id"] == "g" and (s["s1"]["length"], s["s1"]["sn"], s["s1"]["so"]) == (3, "ref", 7) and s["s2"]["sn"] is None
    assert [(r["src"], r["dst"], r["src_orient"], r["dst_orient"]) for r in links.collect()] == [("s1", "s2", "+", "-")]


def test_manifest(spark, tmp_path):
    body = {"APP": {"reference": "r.fa", "healthy": [{"sequence_id": "APP_H_1", "path": "h.fa"}], "unhealthy": []}}
    (tmp_path / "m.json").write_text(json.dumps(body, indent=1))
    rows = {(r["gene"], r["bucket"], r["sequence_id"], r["path"]) for r in readers.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert rows == {("APP", "reference", None, "r.fa"), ("APP", "healthy", "APP_H_1", "h.fa")}


def test_gaf_stream(spark, tmp_path):
    line = "q1\t100\t0\t90\t+\t>a\t120\t5\t95\t{}\t90\t60"
    for i, m in enumerate((80, 85, 70)):
        (tmp_path / f"{i}.gaf").write_text(line.format(m) + "\n")
    q = running_best(stream_gaf(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("best_rows").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("best_rows").first()
    assert (r["rows"], r["alignment_score"]) == (3, 85.0)


def test_split_sizes(spark):
    for n, want in ((2, 1), (3, 1), (9, 2), (23, 5), (78, 16)):
        rows = spark.range(n).select(F.lit("G").alias("gene"), F.lit("HEALTHY").alias("label"), F.col("id").cast("string").alias("sequence_id"))
        got = sequences.stratified_split(rows).groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in got} == {"test": want, "train": n - want}
    one = spark.range(1).select(F.lit("G").alias("gene"), F.lit("H").alias("label"))
    assert sequences.check_splittable(one).count() == 1


def test_dedup_and_summary(spark):
    rows = spark.createDataFrame([("G", "HEALTHY", "ACG", True, 2, "b"), ("G", "HEALTHY", "ACG", True, 1, "a"), ("G", "UNHEALTHY", "ACG", True, 3, "c"), ("G", "HEALTHY", "X", False, 4, "d")], "gene string, label string, sequence string, valid boolean, ord int, sequence_id string")
    assert sorted(r["sequence_id"] for r in sequences.dedup_first(sequences.valid(rows)).collect()) == ["a", "c"]
    r = sequences.preprocess_summary(rows).where("label = 'HEALTHY'").first()
    assert (r["records"], r["invalid_skipped"], r["duplicates_skipped"], r["kept"]) == (3, 1, 1, 1)


def test_sequence_graph_spells_its_input(spark):
    text = {"a": "ACGTTGCAACGGTATC", "b": "ACGTTGCATCGGTATC", "c": "ACACACACACA"}
    seqs = spark.createDataFrame([("G", "combined", k, v) for k, v in text.items()], "gene string, graph_class string, sequence_id string, sequence string")
    segments, links = kmers.build_sequence_graph(seqs, 4)
    segs = {r["node"]: r["sequence"] for r in segments.collect()}
    want = {v[i : i + 4] for v in text.values() for i in range(len(v) - 3)}
    got = [s[i : i + 4] for s in segs.values() for i in range(len(s) - 3)]
    assert sorted(got) == sorted(want)
    for r in links.collect():
        assert segs[r["src"]][-3:] == segs[r["dst"]][:3]


def test_align_to_graph(spark):
    import random

    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    other = base[:150] + ("A" if base[150] != "A" else "C") + base[151:]
    seqs = spark.createDataFrame([("G", "combined", "r", base), ("G", "combined", "s", other)], "gene string, graph_class string, sequence_id string, sequence string")
    segments, links = kmers.build_sequence_graph(seqs, 15)
    rows = kmers.align_to_graph(spark.createDataFrame([("q", base)], "sequence_id string, sequence string"), segments, links, 15).collect()
    # segments overlap by k - 1, so the chain passes over the branch at the one differing base
    assert len(rows) == 1 and rows[0]["residue_matches"] == 299 and (rows[0]["query_start"], rows[0]["query_end"]) == (0, 300)


def test_json_is_compressed_and_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"name{i}", [str(i)]) for i in range(50)], "n int, name string, parts array<string>")
    writers.write_json(rows, f"{tmp_path}/out")
    files = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert sorted(spark.read.schema(rows.schema).json(f"{tmp_path}/out").collect()) == sorted(rows.collect())
