import base64
import hashlib
import random
import re
import tracemalloc
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, language_id, licenses, pii, quality, queries, token_counts
from strandloom.llm.common import REMEMBERED, table, texts_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " ", "\n\n", "a", "naïve café ", "日本語のテキスト", "it's 12,345.6  \t x", "<|endoftext|>", "🙂🙃" * 3, "a" * 5000, " ".join(["word"] * 20000)]
VOCABULARY = P.path("byte_bpe_50k.json")


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_as_tiktoken(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(frame(spark, ODD).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    enc = tiktoken_encoding()
    for r in bpe.encode_digests(docs, VOCABULARY, P.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_round_trip_and_split_characters(spark):
    docs = frame(spark, ODD)
    coded = bpe.encode_documents(docs, VOCABULARY, P.PATTERN)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded, VOCABULARY, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    part = coded.where("doc_id = 9").select("doc_id", F.slice("ids", 1, 1).alias("ids"))
    assert bpe.decode_documents(part, VOCABULARY, P.PATTERN).first()["decoded"] == "🙂".encode()[: len(bpe.decode_documents(part, VOCABULARY, P.PATTERN).first()["decoded"])]
    assert bpe.encode_digests(docs.limit(0), VOCABULARY, P.PATTERN).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    texts = [*ODD, "one line\nand two\n\nthree", "x\n\n\ny  \n z"]
    got = defaultdict(list)
    for r in token_counts.count_tokens(frame(spark, texts), VOCABULARY, P.PATTERN, rule=rule).orderBy("section_no").collect():
        got[r["doc_id"]].append(r)
    c = bpe.codec(VOCABULARY, P.PATTERN)
    for i, t in enumerate(texts):
        t = t or ""
        rows = got[i]
        assert [r["char_start"] for r in rows] == [0, *(r["char_end"] for r in rows[:-1])] and rows[-1]["char_end"] == len(t)
        (ids,) = c.encode([t])
        assert sum(r["n_tokens"] for r in rows) == pytest.approx(len(ids)) and rows[0]["doc_tokens"] == len(ids)
        spans = list(zip(*(x.tolist() for x in c.character_spans(t, ids))))
        want = [0.0] * len(rows)
        for s, e in spans:
            share = [max(0, min(e, r["char_end"]) - max(s, r["char_start"])) for r in rows]
            held = [k for k, x in enumerate(share) if x]
            if rule == "split":
                for k in held:
                    want[k] += share[k] / sum(share)
            else:
                want[{"first": held[0], "last": held[-1], "most": share.index(max(share))}[rule]] += 1
        assert [r["n_tokens"] for r in rows] == pytest.approx(want)
    assert token_counts.count_tokens(frame(spark, []), VOCABULARY, P.PATTERN).count() == 0


def plain_bits(train: list[bytes], text: bytes) -> float:
    """Code length by counting contexts one by one."""
    succ = [defaultdict(lambda: defaultdict(int)) for _ in range(4)]
    for t in train:
        p = b"\0\0\0" + t
        for i in range(3, len(p)):
            for k in range(4):
                succ[k][p[i - k : i]][p[i]] += 1
    out, p = 0.0, b"\0\0\0" + text
    for i in range(3, len(p)):
        for k in (3, 2, 1, 0):
            s = succ[k].get(p[i - k : i])
            if s is None:
                continue
            n, kinds = sum(s.values()), len(s)
            if p[i] in s:
                out -= np.log2(s[p[i]] / (n + kinds))
                break
            out -= np.log2(kinds / (n + kinds))
        else:
            out += 8
    return out


def test_language_code_lengths(spark):
    texts = [("en", "the cat sat on the mat"), ("en", "that hat"), ("de", "die katze saß auf der matte"), ("de", "über"), (None, "x")]
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, (lang, t) in enumerate(texts)], DOCS)
    trees = language_id.train(docs)
    assert trees.languages == ["de", "en"]
    probes = [b"", b"the mat", "süß über".encode(), b"zzz\xff\x00", b"q" * 50]
    for chunk in (1 << 20, 7):
        got = trees.bits(probes, chunk)
        for k, lang in enumerate(trees.languages):
            want = [plain_bits([t.encode() for g, t in texts if g == lang], p) for p in probes]
            assert got[:, k] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_language_query(spark, sf_dir):
    got = queries.op4_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] >= 0.95 and 0 <= r["lo"] <= r["hi"] <= 1
    odd = language_id.identify(frame(spark, [None, "", "123 !", "abc", "abc"]).withColumn("lang_pred", F.lit("x")), F.lit(True)).orderBy("doc_id").collect()
    assert [x["lang_pred"] for x in odd] == ["und", "und", "und", "en", "en"]
    assert language_id.identify(frame(spark, []), F.lit(True)).count() == 0
    assert language_id.identify(frame(spark, ["abc"]), F.lit(False)).first()["lang_pred"] == "und"


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    model = quality.train(docs, labels.where(odd))
    assert list(model.thresholds) == sorted(model.thresholds)
    rated = quality.rate(docs, model).join(quality.graded(labels.where(~odd)), "doc_id")
    by = {r["grade"]: r for r in rated.groupBy("grade").agg(F.avg(F.col("selected").cast("double")).alias("kept"), F.avg("expected_grade").alias("mean")).collect()}
    assert by[2]["kept"] > 0.97 and by[0]["kept"] < 0.4 and by[0]["mean"] < by[1]["mean"] < by[2]["mean"]


def test_quality_rejects_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    rated = quality.rate(docs, quality.train(docs, labels.where(odd)), keep=("doc_id", "text")).join(labels.where(~odd), "doc_id").where("quality = 1")
    # ratings hold noise: a toxic text is one that has a word which no clean one has
    toxic = F.lower("text").rlike("idiot|pathetic|disgusting|worthless|moron|scum")
    by = {r["toxic"]: r["kept"] for r in rated.groupBy(toxic.alias("toxic")).agg(F.avg(F.col("selected").cast("double")).alias("kept")).collect()}
    assert by[True] < 0.4 and by[False] > 0.95


def test_quality_odd_input(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([(1, None, None)], "doc_id bigint, quality int, toxic int")
    assert quality.train(docs, none) is None
    assert {r["selected"] for r in quality.rate(docs, None).collect()} == {True}
    some = spark.createDataFrame([(4, 1, 0), (4, 0, None), (5, 1, 1), (6, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs.withColumn("features", F.lit(1)), some)
    assert quality.rate(docs, model).count() == len(ODD)
    assert quality.select(docs.withColumn("selected", F.lit("x")), model).columns == [*docs.columns, "selected"]
    assert quality.rate(docs.limit(0), model).count() == 0


def test_ordinal_slopes():
    rng = np.random.default_rng(1)
    s, y, th = rng.normal(size=50), rng.integers(0, 3, 50), np.array([-0.5, 0.7])
    loss, by_score, by_threshold = quality.loss_and_slopes(s, y, th)
    e = 1e-6
    for i in range(50):
        d = np.zeros(50)
        d[i] = e
        assert (quality.loss_and_slopes(s + d, y, th)[0] - loss) / e == pytest.approx(by_score[i], abs=1e-3)
    for k in range(2):
        d = np.zeros(2)
        d[k] = e
        assert (quality.loss_and_slopes(s, y, th + d)[0] - loss) / e == pytest.approx(by_threshold[k], abs=1e-3)


BENCH = [(1, "If Alice buys 12 apples and Bob buys 7 apples, how many apples do Alice and Bob have together after 12 days?"), (2, "short item here"), (3, None), (4, "")]


def leaks(spark, texts):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(frame(spark, texts), bench).collect()}


def test_decontamination(spark):
    item = BENCH[0][1]
    other = item.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "31").replace("7", "5")
    broken = item.replace("12 apples", "31 apples").replace("Alice and Bob have", "Bob and Zed have")
    texts = [None, "", "before " + item + " after", "x " + other, "x " + item.upper(), "quite unrelated words " * 30, "a short item here b", item + " " + item, broken]
    got = leaks(spark, texts)
    assert {k for k in got if k[1] == 1} >= {(2, 1), (3, 1), (4, 1), (7, 1)} and (6, 2) in got
    assert not {k for k in got if k[0] in (0, 1, 5)}
    assert got[2, 1]["exact"] and got[2, 1]["coverage"] == 1.0 and not got[3, 1]["exact"]
    assert not got[8, 1]["exact"]  # the words after its slots are a copy


def test_decontamination_of_number_heavy_items(spark):
    train, sums, names, row = "A train travels 60 km in 2 hours and then 90 km in 3 hours", "What is 12 + 7 * 3?", "Sea of Japan and Gulf of Siam", "4 8 15 16 23 42 108 815"
    bench = spark.createDataFrame([(1, train), (2, sums), (3, names), (4, row), (5, "Yes"), (6, "Alice has 3 apples and Bob has 5")], "item_id bigint, text string")
    texts = [train, train.replace("60", "45").replace("90", "75").replace("2", "8").replace("3", "6"), sums, "Well, what is 31 + 5 * 9?", names, "Bay of Bengal, and Strait of Hormuz", f"x {row} y", "1 2 3 4 5 6 7 9 10 11",
             "Yes. It took 45 km in 8 hours and nothing more was said of it", "so Carol has 9 apples and Dan has 4", train.replace("90", "60").replace("2 hours", "3 hours").replace("A train travels 60", "A train travels 70").replace("in 3 hours and", "in 70 hours and")]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert got == {(0, 1): True, (1, 1): False, (2, 2): True, (3, 2): False, (4, 3): True, (6, 4): True, (9, 6): False}


def test_decontamination_of_runs(spark):
    item = "Alice has 3 apples and Bob has 5"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    found = ["Alice has 3 apples and Mary Ann has 5", "Alice has three hundred apples and Bob has 5", "Mary-Jane Watson has 3 million apples and John Paul Jones has twenty-one", f"Here is one. {item}. Think.", "Carol has 12 apples and Dan has 7"]
    not_found = ["Alice has 3 pears, Bob has none", "Carol has 4 apples and Carol has 9", "Mary Ann has three hundred apples and Sally Ann has 5", "Alice has 3. Apples and Bob"]
    got = {r["doc_id"]: (r["matched_tokens"], r["item_tokens"], r["exact"]) for r in decontaminate.leaks(frame(spark, found + not_found), bench).collect()}
    assert got == {0: (8, 8, False), 1: (8, 8, False), 2: (8, 8, False), 3: (8, 8, True), 4: (8, 8, False)}
    bench = spark.createDataFrame([(1, "Mary Ann Smith has three hundred apples and Bob has 5")], "item_id bigint, text string")
    got = {r["doc_id"]: (r["matched_tokens"], r["item_tokens"], r["exact"]) for r in decontaminate.leaks(frame(spark, found), bench).collect()}
    assert got == {i: (11, 11, False) for i in range(5)}


def test_decontamination_of_short_items(spark):
    bench = spark.createDataFrame([(1, "Define osmosis"), (2, "Why?"), (3, "?!"), (4, "Define osmosis")], "item_id bigint, text string")
    texts = ["Define osmosis", "Part one\ndefine  OSMOSIS.\nPart two", "It rained. Define osmosis. It rained.", "we define osmosis as a flow", "why", "Why? Because.", "x\nWhy?\ny", None, "", "?!"]
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert got == {**{(d, i): 1.0 for d in (0, 1, 2) for i in (1, 4)}, (4, 2): 1.0, (6, 2): 1.0}


def test_decontamination_of_odd_rows(spark):
    item = BENCH[0][1]
    docs = spark.createDataFrame([(None, item, 1, "x"), (None, item, 1, "x"), (None, "word " * 200_000 + item, 2, "y")], "doc_id bigint, text string, window int, item string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(1, item, "z")], "item_id bigint, text string, form string")).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"], r["exact"]) for r in got] == [(None, 1, 1.0, True)] * 2


def test_memory_of_a_batch_of_long_texts(monkeypatch):
    """Strings and tokens of some rows at a time, whatever a batch holds; what workers remember of tokens is bounded."""
    texts = pa.array([f"{i} some words of a text " * 200 for i in range(4000)])  # 20 MB
    tracemalloc.start()
    places = [i for where, _ in decontaminate.chunks(texts_of(texts)) for i in where]
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert places == list(range(4000)) and most < 12_000_000
    monkeypatch.setattr(decontaminate, "_LEXICON", decontaminate.Lexicon())
    for i in range(REMEMBERED + 1):
        decontaminate._LEXICON[f"w{i}"] = i
    assert not decontaminate.lexicon_of_worker() and REMEMBERED <= 200_000


def test_decontamination_of_rows(spark):
    item = BENCH[0][1]
    docs = spark.createDataFrame([(None, item, "a"), (1, item, "b"), (1, "clean", "c"), (2, None, "d"), (2, None, "d")], "doc_id bigint, text string, row string")
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == ["c", "d", "d"]
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == 5 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_decontamination_query_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    items = {r["item_id"]: r["text"] for r in table(spark, sf_dir, "benchmark").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontaminate(spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= max(1, len(want) // 5)


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return True


def base(text):
    spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def test_pii_base_against_brute_force(spark, sf_dir):
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab@.1234 -+()_é🙂") for _ in range(60)) for _ in range(400)]
    odd += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0100", "x" * 20000, "1" * 20000, "300.1.1.1 007.1.1.255", "é 10.0.0.1", "a" * 3000 + "@b.cd"]
    docs = frame(spark, odd)
    got = {r["doc_id"]: r for r in pii.digests(pii.find(docs)).collect()}
    for i, t in enumerate(odd):
        assert got[i]["base_sha256"] == hashlib.sha256(base(t).encode()).hexdigest(), (t, got[i]["spans"])
    q = {r["doc_id"]: r for r in queries.op7_pii(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        assert q[r["doc_id"]]["base_sha256"] == hashlib.sha256(base(r["text"]).encode()).hexdigest()
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_bootstrap_finds_what_patterns_miss(spark):
    seeds = [f"please call mobile: +1 (415) 555-01{i:02d} today" for i in range(12)]
    texts = [*seeds, "please call mobile: 4155550199 today", "the year 1999 and 12345678 items", "again 4155550199 here"]
    got = {r["doc_id"]: r for r in pii.digests(pii.find(frame(spark, texts))).collect()}
    assert got[12]["spans"] == "phone:20:30" and got[14]["spans"] == "phone:6:16" and got[13]["spans"] == ""
    clean = pii.redact(frame(spark, [*texts, None]).withColumn("spans", F.lit("x")))
    out = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert out[0] == "please call mobile: [PHONE] today" and out[12] == "please call mobile: [PHONE] today" and out[13] == texts[13] and out[15] is None
    assert clean.columns == [*frame(spark, []).columns, "spans"]


def test_pii_contexts(spark):
    """Contexts at any distance; words before all kinds are no patterns; what fails the check counts against one."""
    rng = random.Random(2)
    seeds = [f"please call mobile: +1 (415) 555-01{i:02d} today" for i in range(12)]
    far = "please call mobile:" + " " * 70 + "4155550188 now"
    any_kind = [f"see the {x} here" for i in range(8) for x in (f"+1 415 555 02{i:02d}", f"a{i}@b.org", f"10.0.0.{i}")]
    cards = [f"pay by number {x} please" for x in ("4111111111111111", "4012888888881881", "5555555555554444", "5105105105105100", "378282246310005", "6011111111111117")]
    failed = [f"pay by number {rng.randrange(10**15, 10**16)} please" for _ in range(20)]
    texts = [*seeds, far, *any_kind, "see the 4155550177 here", *cards, *failed, "pay by number 411111111111 please"]
    got = {r["doc_id"]: r for r in pii.digests(pii.find(frame(spark, texts))).collect()}
    assert got[texts.index(far)]["n_added"] == 1
    assert got[texts.index("see the 4155550177 here")]["n_added"] == 0
    assert got[len(texts) - 1]["n_added"] == 0


def test_pii_held_out_discovery(spark):
    """Numbers whose plus sign is taken away are unseen identifiers: most come back by context, and no other number."""
    rng = random.Random(3)
    before = ["mobile:", "phone", "call", "tel.", "fax:"]
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    seen = [f"word {rng.choice(before)} +1-{number()} end" for _ in range(60)]
    hidden = [f"other {rng.choice(before)} {number()} stop" for _ in range(30)]
    others = [f"order {number()} of part {rng.randrange(10**7, 10**9)}" for _ in range(30)]
    got = {r["doc_id"]: r["n_added"] for r in pii.digests(pii.find(frame(spark, [*seen, *hidden, *others]))).collect()}
    assert sum(got[i] for i in range(60, 90)) >= 27 and sum(got[i] for i in (*range(60), *range(90, 120))) == 0


def test_long_text_of_many_matches(spark):
    text = " ".join(f"a{i}@b.org 10.0.{i % 256}.7" for i in range(3000))
    r = pii.digests(pii.find(frame(spark, [text]))).first()
    assert (r["n_email"], r["n_ip"]) == (3000, 3000)
    out = pii.redact(frame(spark, [text])).first()["text"]
    assert out == " ".join(["[EMAIL] [IP]"] * 3000)


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    words = mit.split()
    texts = [None, "", "Released under the MIT License.", "x\nReleased under the MIT License. y Released under the MIT license", " ".join(words[:10] + ["extra", "words"] + words[10:]), "under the general sun", "Licensed under CC BY-SA 4.0", "word " * 20000 + "This work is licensed under the GNU General Public License, version 3."]
    got = defaultdict(list)
    for r in licenses.scan(frame(spark, texts)).orderBy("char_start").collect():
        got[r["doc_id"]].append(r)
    names = {i: [r["license_id"] for r in rows] for i, rows in got.items()}
    assert names == {2: ["MIT"], 3: ["MIT", "MIT"], 4: ["MIT-text"], 6: ["CC-BY-SA-4.0"], 7: ["GPL-3.0"]}
    r = got[2][0]
    assert (texts[2][r["char_start"] : r["char_end"]], r["coverage"]) == ("Released under the MIT License", 1.0)
    assert licenses.scan(frame(spark, [])).count() == 0


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def words_of(text):
    return [m[0] for m in licenses.WORD.finditer(text.lower())]


def letters_of(words):
    return "".join("" if w in licenses.FILLERS else re.sub(r"^v(?=\d+$)", "", w) for w in words)


def phrases_in(phrase, words):
    """Places (start, end) where a name stands: its letters in those of all words, from a word's start to a word's end."""
    want, begins, ends, whole = letters_of(words_of(phrase)), {}, {}, ""
    for p, w in enumerate(words):
        if letters_of([w]):
            begins[len(whole)] = p
            whole += letters_of([w])
            ends[len(whole)] = p + 1
    found = (m.start() for m in re.finditer(f"(?={want})", whole))
    return [(begins[k], ends[k + len(want)]) for k in found if k in begins and k + len(want) in ends]


def common_in_name(own, part):
    """A name stands whole, however its words are divided; only its fillers may be missing."""
    return max(common(own, part), sum(1 for w in own if letters_of([w])))


def most_matched(words, name):
    """The largest number of a template's words that are found in a text by common subsequences over all its windows."""
    template, best = words_of(licenses.TEMPLATES[name]), 0
    n, room = len(template), max(licenses.INSERTED, len(template) // 2)
    if name not in licenses.NAMES:
        inside = [w in set(template) for w in words]
        for a in range(len(words)):
            part = words[a : a + n + room]
            if inside[a] and sum(inside[a : a + n + room]) >= 0.8 * n:
                best = max(best, common(template, part))
        return best
    phrases = licenses.NAMES[name]
    for p, q in phrases_in(phrases[0], words):
        own, i = words_of(phrases[0]), 0
        while template[i : i + len(own)] != own:
            i += 1
        total, at, done = common(template[:i], words[max(0, p - i - room) : p]) + common_in_name(own, words[p:q]), i + len(own), q
        for phrase in phrases[1:]:
            own, i = words_of(phrase), at
            while template[i : i + len(own)] != own:
                i += 1
            later = [x for x in phrases_in(phrase, words) if done <= x[0] <= done + i - at + room]
            if not later:
                total = -n
                break
            total += common(template[at:i], words[done : later[0][0]]) + common_in_name(own, words[slice(*later[0])])
            at, done = i + len(own), later[0][1]
        best = max(best, total + common(template[at:], words[done : done + n - at + room]))
    return best


@lru_cache(maxsize=None)
def best_license(text):
    """(coverage, words, license id) of a text that holds one notice at most."""
    words = words_of(text)
    found = []
    for name, template in licenses.TEMPLATES.items():
        n, matched = len(words_of(template)), most_matched(words, name)
        if matched >= 0.8 * n:
            found.append((-matched / n, -matched, name))
    return min(found, default=None)


def test_license_query_against_brute_force(spark, sf_dir):
    want = {}
    for r in table(spark, sf_dir, "documents").collect():
        best = best_license(r["text"] or "")
        if best:
            want[r["doc_id"]] = best[2], -best[0]
    got = defaultdict(list)
    for r in queries.op1_licenses(spark, sf_dir).collect():
        got[r["doc_id"]].append((r["license_id"], r["coverage"]))
    assert want and {d: max(found, key=lambda x: x[1]) for d, found in got.items()} == want


def test_license_variants_against_brute_force():
    rng = random.Random(5)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, licenses.NAMES)
    for template in licenses.TEMPLATES.values():
        assert best_license(template)[0] == -1
        for _ in range(3):
            words = template.split()
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], ["xyzzy"], [words[i], "xyzzy"], [words[i], "lesser"]])
                words = words or ["xyzzy"]
            text = "Alpha beta. " + " ".join(words) + " gamma delta."
            best, got = best_license(text), scanner.scan(text)
            assert [m.license_id for m in got] == ([best[2]] if best else []), text
            assert not best or got[0].coverage == -best[0], text


def test_sister_licenses():
    def ids(text):
        return [x for x, _ in licenses_of(text)]

    for name, template in licenses.TEMPLATES.items():
        assert ids(f"Some words. {template} More words.") == [name]
    assert ids("Released under the BSD License.") == ["BSD"]
    assert ids("Released under the Apache License.") == ids("Licensed under the Apache License, Version 1.0.") == []
    assert ids("GNU General Public License, version 2.") == []  # a mention, no grant
    assert ids("Licensed under CC BY 4.0.") == ["CC-BY-4.0-code"]
    assert ids("Licensed under CC BY-SA 3.0.") == []
    assert ids("This work is licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License.") == ["CC-BY-NC-4.0-notice"]
    assert ids("This work is licensed under the GNU General Public License v3.") == ["GPL-3.0"]
    assert ids("All human beings are equal in dignity and rights, and seats are reserved.") == []
    assert ids("Released under the MIT Press label.") == []
    assert ids(licenses.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 4")) == []
    assert ids("Released by the many people of the society who have worked on it for some thirty years under the MIT License.") == ["MIT"]
    assert ids("The GNU project. " + licenses.TEMPLATES["GPL-3.0"]) == ["GPL-3.0"]


def test_license_rows_repeated_null_ids_and_clashing_names(spark):
    rows = [(None, "Released under the MIT License.", "a", 1.0), (None, "Released under the MIT License.", "a", 1.0), (7, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license_id string, coverage double")
    assert [(r["doc_id"], r["license_id"]) for r in licenses.scan(docs).collect()] == [(None, "MIT")] * 2


def test_key_words_before_a_template():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, licenses.NAMES)
    for name, text in licenses.TEMPLATES.items():
        for word in {w for w, places in scanner.keys.items() if any(k == name for k, _ in places)}:
            assert name in [m.license_id for m in scanner.scan(f"{word}\n{text}")] or any(m.words > len(text.split()) // 2 for m in scanner.scan(f"{word}\n{text}"))


def licenses_of(text):
    return [(m.license_id, text[m.start : m.end]) for m in licenses.Scanner(licenses.TEMPLATES, 0.8, licenses.NAMES).scan(text)]


def test_rights_reserved():
    assert licenses_of("Some words.\nAll rights reserved.\nMore words.") == [("Proprietary-notice", "All rights reserved")]
    for holder in ("Foo", "2024 Foo Corporation", "(c) 2010-2024 The Regents of the University of Example"):
        text = f"Copyright {holder}. All rights reserved."
        assert licenses_of(text) == [("Proprietary", text[:-1])]
        assert licenses_of(f"{text} {text}") == [("Proprietary", text[:-1])] * 2
    assert licenses_of("Released, as of the third day of May 2024, under the MIT License.") == [("MIT", "Released, as of the third day of May 2024, under the MIT License")]
    assert licenses_of("all rights " + "word " * 30 + "reserved") == []


def test_rights_reserved_in_given_documents(spark, sf_dir):
    docs = {r["doc_id"] for r in table(spark, sf_dir, "documents").where("text like '%All rights reserved.%'").collect()}
    got = {r["doc_id"] for r in queries.op1_licenses(spark, sf_dir).where("license_id like 'Proprietary%'").collect()}
    assert docs and got == docs


def test_license_below_a_heading():
    for heading in ("License: ", "License\n\n", "Licensed software, released\n"):
        assert licenses_of(f"{heading}Released under the MIT License.") == [("MIT", "Released under the MIT License")]
    assert [x for x, _ in licenses_of("License\nThis work is licensed under the GNU General Public License, version 3.")] == ["GPL-3.0"]


def test_patience():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert len(licenses.patience(list("abcd"), list("abcd"))) == 4
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
