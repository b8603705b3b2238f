import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import ann, near_dedup, queries, sharding
from strandloom.llm.common import Scratch, table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def words_of(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k=2):
    sets, n = [shingles(t, k) for t in texts], len(texts)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(i, len(sets[i]), top(i)) for i in range(n)]


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 2:
            continue
        out.append(rng.choice(["new", "odd", "the", str(rng.random())]) if x < rate else w)
    return " ".join(out)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(block)
    texts = [None, "", " \n", "one", "One", "two words", "x\x0by", "x y"]
    for group in (90, 30, 5):
        home = [f"w{rng.randrange(400)}" for _ in range(60)]
        texts += [edited(rng, home, rng.choice([0, 0.02, 0.06, 0.1, 0.15, 0.25])) for _ in range(group)]
    texts += [" ".join(f"v{rng.randrange(4000)}" for _ in range(40)) for _ in range(40)]
    texts += [" ".join(f"u{i}" for i in range(6000))] * 3
    docs = frame(spark, texts).withColumn("digest", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 2).collect())
    assert got == brute(texts)


def test_members_that_only_sketches_put_near(spark, monkeypatch):
    """Documents of shared passages in one bucket: sketches put them near its hub, full sets say less than 2t - 1."""
    one = lambda *a, f=near_dedup.signatures: f(*a).withColumn("bands", F.when(F.col("bands").isNotNull(), F.array(F.lit(1).cast("bigint"))))
    monkeypatch.setattr(near_dedup, "signatures", one)
    rng = random.Random(5)
    passages = [" ".join(f"p{k}w{i}" for i in range(8)) for k in range(60)]
    texts = [" ".join(rng.sample(passages, 40)) for _ in range(60)]
    for i in range(0, 60, 4):
        words = texts[i].split()
        at = rng.randrange(len(words) - 25)
        texts.append(" ".join(words[:at] + [f"new{i}x{k}" for k in range(25)] + words[at + 25 :]))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, texts), 2).collect())
    assert got == brute(texts)


def test_an_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    rows = [(1, a), (1, b), (2, b + " t"), (3, a + " i"), (2, "alone here"), (4, "alone here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 2).collect())
    assert got == [(1, 9, 1), (1, 9, 1), (2, 1, 2), (2, 10, 1), (3, 10, 1), (4, 1, 2)]
    one = near_dedup.one_of_each(df.withColumn("row", F.lit(1)).withColumn("body", F.lit(2)), 2)
    assert sorted(r["text"] for r in one.collect()) == sorted([a, b, "alone here"])


def test_left_over_members_meet_on_full_sets(spark, monkeypatch):
    """Members far from both hubs of a bucket, with near copies among them, in blocks of few rows."""
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PEELS", 1)
    rng = random.Random(7)
    texts = []
    for family in range(12):
        words = [f"c{i}" for i in range(24)] + [f"f{family}x{i}" for i in range(26)]
        rng.shuffle(words)
        texts += [" ".join(edited(rng, words, 0.05)) for _ in range(5)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, texts), 2).collect())
    assert got == brute(texts)


@pytest.mark.parametrize("n, odd", [(1000, 3), (1000, 40), (40, 40), (12, 2), (17, 1), (500, 0)])
def test_blocks_meet_only_whom_they_must(spark, n, odd):
    rows = spark.range(n).select(F.lit(7).alias("h"), F.col("id").alias("x"), (F.col("id") < odd).alias("far"))
    work = Scratch(spark)
    met = near_dedup.dealt(rows, "h", "x", F.col("far"), work, 16).select("x", "far", "first", "second", "left", "cross").collect()
    work.keep()
    times, sides = {}, {}
    for r in met:
        sides.setdefault((r["first"], r["second"], r["cross"]), ([], []))[not r["left"]].append((r["x"], r["far"]))
    for (_, _, cross), (left, right) in sides.items():
        for i in left:
            for j in right if cross else left:
                if i < j or cross and i != j:
                    pair = tuple(sorted((i[0], j[0])))
                    times[pair] = times.get(pair, 0) + 1
    wanted = {(i, j) for i in range(odd) for j in range(i + 1, n)}
    assert wanted <= times.keys() and all(v == 1 for v in times.values())
    if n > 16:
        assert len(met) <= (n - odd) * -(-odd // 16) + odd * (-(-odd // 16) + -(-(n - odd) // 16))
        assert all(min(p) < odd for p in times)
    else:
        assert len(met) == n


def test_near_duplicates_odd_input(spark):
    assert near_dedup.near_duplicates(frame(spark, []), 2).count() == 0
    rows = spark.createDataFrame([(7, "a b c"), (7, "a b c"), (3, "a b c"), (None, "a b c"), (9, None)], "doc_id bigint, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(rows, 2).collect()]
    assert sorted(got, key=str) == sorted([(7, 3, False), (7, 3, False), (3, 3, True), (None, 3, True), (9, 9, True)], key=str)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(4)
    for share in (0.6, 0.8, 0.95):
        n = 2000
        common = rng.integers(0, 1 << 62, int(2 * n * share / (1 + share)), dtype=np.uint64)
        rest = lambda: rng.integers(0, 1 << 62, n - len(common), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rest()])) for _ in range(2))
        x, y = (np.frombuffer(near_dedup.odd_sketch(near_dedup.minhash(s)).tobytes(), np.uint64) for s in (a, b))
        bits = int(np.bitwise_count(x ^ y).sum())
        assert near_dedup.similarity_of(bits) == pytest.approx(share, abs=0.13)
        assert bits <= near_dedup.cut_off(share)


def check_shards(rows, texts, n=16):
    counts = [0] * n
    for r in rows:
        counts[r["shard"]] += 1
    assert max(counts) - min(counts) <= 1
    for k in range(n):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows" and r["grown_shard"] is None


def test_sharding(spark):
    rng = random.Random(1)
    shared = "a line of words that many documents hold in common"
    texts = [None, "", "é", *["same text again"] * 60, *[f"{shared} {g}\nown {rng.random()}" for g in range(10) for _ in range(8)], *[f"single {i}" for i in range(40)], "x " * 50000]
    docs = frame(spark, texts).withColumn("label", F.lit("clash"))
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(texts)
    check_shards(rows, texts)
    groups = [{r["shard"] for r in rows if (texts[r["doc_id"]] or "").startswith(f"{shared} {g}\n")} for g in range(10)]
    assert sum(len(g) for g in groups) <= 24  # spread at random, ten groups of eight would meet 64 shards
    assert sharding.shard(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "t"), (1, "t"), (None, None)], "doc_id bigint, text string")
    assert sorted(r["shard"] for r in sharding.shard(twice).collect()) == [0, 1, 2]


def test_propagation_cuts_less(spark, sf_dir):
    work = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select("text")
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.size(F.split(x, " ")) >= 6), lambda x: F.xxhash64(x)))
    nodes = docs.groupBy(F.xxhash64("text").alias("node")).agg(F.count("*").alias("weight"), F.first(lines).alias("lines"))
    links = sharding.line_links(nodes, work)
    before = nodes.select("node", sharding.start_label(16).alias("shard"))
    after = sharding.propagate(nodes, links, 16, 4, work).select("node", F.col("label").alias("shard"))
    cut = lambda df: sharding.cut_weight(df, links).first()["cut"]
    assert cut(after) < 0.7 * cut(before)


def exact(vectors, k=5):
    ok = {i: v for i, v in vectors.items() if v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in ok.items():
        if q % 50 == 0:
            score = [(-(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in ok.items() if i != q]
            out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in score)[:k]]
    return out


def test_nearest(spark, sf_dir):
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in table(spark, sf_dir, "embeddings").collect()}
    got = {}
    for r in queries.op8_nearest(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact(vectors)
    assert sum(len(set(got[q]) & set(v)) for q, v in want.items()) / sum(map(len, want.values())) >= 0.9


def test_nearest_within_a_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    rows = [base + rng.normal(size=32) * scale for scale in (0.001, 0.03) for _ in range(600)] + [rng.normal(size=32) for _ in range(1200)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("id") % 50 == 0, books=8, query_group=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact({i: [float(x) for x in v] for i, v in enumerate(rows)})
    assert sum(len(set(got[q]) & set(v)) for q, v in want.items()) / sum(map(len, want.values())) >= 0.95


def test_nearest_odd_input(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(1, 200)]
    rows += [(0, rows[6][1], 0), (300, None, 0), (350, [0.0] * 8, 0), (400, [float("nan")] * 8, 0), (450, [1.0], 0), (500, [None] + [1.0] * 7, 0), (550, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (600, [1e200] * 8, 0)]
    rows += [(1000 + i, [1.0] * 8, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100, 150, 600, *range(1000, 1300, 50)}
    assert got[0][0][1] == 7 and [x[1] for x in got[1050]] == [600, 1000, 1001, 1002, 1003] or [x[1] for x in got[1050]][1:] == [1000, 1001, 1002, 1003] or [x[1] for x in got[1050]][0] == 1000
    assert [x[0] for x in got[0]] == [1, 2, 3, 4, 5]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(few, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()] == [(0, 3), (0, 50), (50, 3), (50, 0)]


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir).persist()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= before.count()
        else:
            assert docs.count() == before.count()
    benchmark = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {r["doc_id"] for r in docs.collect()}
    for r in table(spark, sf_dir, "documents").collect():
        if r["doc_id"] in kept:
            assert not any(b in r["text"] for b in benchmark)


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, "a b c d e f g h", "en", "s", 15), (2, "a b c d e f g h", "en", "s", 15), (2, "a b c d e f g h", "en", "s", 15), (None, "a b c d e f g h", None, None, None), (4, None, None, None, None), (5, "", "en", "s", 0), (6, "mail me at x.y@z.org now", "en", "s", 24)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).withColumn("gone", F.lit(2))
    one = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
    assert one.columns == docs.columns and sorted((r["doc_id"] for r in one.collect()), key=str) == sorted([1, None, 4, 5, 6], key=str)
    red = {r["doc_id"]: r for r in corpus_pipeline.redacted(spark, one, sf_dir).collect()}
    assert red[6]["text"] == "mail me at [EMAIL] now" and red[6]["n_chars"] == len(red[6]["text"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
