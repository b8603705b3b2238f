"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from strandloom.llm import queries, spelling
from strandloom.llm.common import Scratch


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_pairs(words):
    """Near pairs by deletions: near words share a form with one letter, or none, taken out."""
    by = {}
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(x, []).append(w)
    return {(a, b) for ws in by.values() for a in ws for b in ws if near(a, b)}


def brute(counts, factor=10):
    others = {}
    for a, b in brute_pairs(counts):
        others.setdefault(a, []).append(b)
    form = {}
    for w, n in counts.items():
        best = min(others.get(w, []), key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(others.get(w, [])), counts[form[w]] if form[w] else None))
    return out


def rows(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def words_of(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = run.translate({c: c + 32 for c in range(65, 91)})
        h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
        if h % 31 == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= 7:
            yield run


def test_query_over_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    counts = Counter(w for d in docs for w in words_of(d["doc_id"], d["text"]))
    want = brute({w: n for w, n in counts.items() if n >= 2})
    got = rows(queries.QUERIES["op12_spelling"](spark, sf_dir))
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(1 for r in want if r[1]) >= 5


def made_up(many, letters, seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(7, 11))) for _ in range(many)]
    out = set(stems)
    for w in stems:
        i = rnd.randrange(len(w))
        out |= {w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :], w[::-1], "".join(sorted(w))}
    return sorted(out)


@pytest.mark.parametrize(("letters", "block"), [("ab", 50), ("etaéèÉê", 7), ("abcdefghijklmnopqrstuvwxyzü", 20_000)])
def test_pairs_equal_brute_force(spark, letters, block):
    words = made_up(150, letters, block)
    vocab = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = [(r["word"], r["other"]) for r in spelling.near_pairs(vocab, Scratch(spark), block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(words)


def test_a_subtree_over_many_batches(spark, monkeypatch):
    """Entries of one subtree stay while its queries come in several batches."""
    words = made_up(60, "ab", 9)
    own = spelling.keyed(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    table = []
    here = {(r["size"], r["k0"], r["k1"], r["k2"]) for r in own}
    for r in own:
        key = (r["size"], r["k0"], r["k1"], r["k2"])
        table.append((*key, 0, 0, r["word"].encode("latin-1"), 1))
        table += [(*to, 0, 1, r["word"].encode("latin-1"), 1) for m in spelling.moves() if (to := tuple(a + b for a, b in zip(key, m, strict=True))) in here]
    table.sort(key=lambda x: x[:6])
    names = ["size", "k0", "k1", "k2", "block", "asks", "word", "n"]
    monkeypatch.setattr(spelling, "BATCH", 40)
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in table[i : i + 17]]) for i in range(0, len(table), 17)]
    got = [(a.decode("latin-1"), b.decode("latin-1")) for out in spelling._search(iter(batches)) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    assert len(got) == len(set(got)) and {x for a, b in got for x in ((a, b), (b, a))} == brute_pairs(words)


def test_forms_of_forms_ties_and_long_words(spark):
    long = "lo" * 700
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "zzzzzzza": 30, "zzzzzzzb": 30, "zzzzzzz": 3, long: 2, long + "x": 40, "alonely": 5}
    words = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string")
    got = rows(spelling.variants(words))
    assert set(got) == brute(counts)
    assert {r[0]: r[2] for r in got}["abcdefg"] == "abcdefghi" and {r[0]: r[1] for r in got}["zzzzzzz"] == "zzzzzzza"


def test_odd_input(spark):
    docs = spark.createDataFrame([(1, None, "w"), (None, "Wordings wordings", None), (2, "", "x"), (3, "wordings Àrdings1Àrdings wördings_Wördings", "n")], "doc_id long, text string, word string")
    found = spelling.runs(docs)
    got = rows(spelling.variants(found.select(spelling.without_one(F_col("run"), F_col("doc_id")).alias("word"))))
    assert set(got) == {("wordings", None, "wordings", 3, 1, None), ("wördings", None, "wördings", 2, 1, None), ("Àrdings", None, "Àrdings", 2, 0, None)}
    assert rows(spelling.variants(docs.limit(0).select("word"))) == []


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
