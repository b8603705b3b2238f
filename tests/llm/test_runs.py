"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from strandloom.llm import queries, runs


def brute(words, least=12):
    """Every run by its definition: for each period, maximal stretches of words q apart that are equal."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(words[i : j + q - p] == words[i + p : j + q] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def cases(many=600):
    rnd = random.Random(13)
    for k in range(many):
        n, letters = rnd.randrange(60), rnd.choice((1, 2, 3, 6))
        s = [b"w%d" % rnd.randrange(letters) for _ in range(n)]
        if k % 3 == 0 and n:
            a, p = rnd.randrange(n), 1 + rnd.randrange(n)
            s = [s[i] if i < a else s[a + (i - a) % p] if a + (i - a) % p < n else b"x" for i in range(n)]
        yield s, rnd.choice((2, 5, 12))


def test_runs_equal_brute_force():
    for words, least in cases():
        assert [tuple(r) for r in runs.runs_of_words(words, least).tolist()] == brute(words, least)


def test_the_tree_without_the_cut():
    for words, least in cases(300):
        code = {w: i for i, w in enumerate(dict.fromkeys(words))}
        assert [tuple(r) for r in runs.all_runs(np.array([code[w] for w in words], np.int64), least).tolist()] == brute(words, least)


def test_extensions():
    rnd = random.Random(2)
    for _ in range(60):
        s = [rnd.randrange(2) for _ in range(rnd.randrange(2, 200))]
        e = runs.Extensions(s)
        pairs = [(a, b) for a in range(len(s) + 1) for b in range(len(s) + 1) if a != b]
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        want = []
        for x, y in pairs:
            k = 0
            while max(x, y) + k < len(s) and s[x + k] == s[y + k]:
                k += 1
            want.append(k)
        assert e.common(a, b).tolist() == want
        ahead, reverse = e.orders()
        assert sorted(range(len(s) + 1), key=lambda i: s[i:]) == np.argsort(ahead).tolist()
        assert sorted(range(len(s) + 1), key=lambda i: [-c for c in s[i:]]) == np.argsort(reverse).tolist()


def test_equal_lines_far_apart_leave_no_run():
    line = [b"l%d" % i for i in range(30)]
    words = line + [b"u%d" % i for i in range(40)] + line
    assert runs.stretches(np.array([hash(w) for w in words])) == []
    assert not len(runs.runs_of_words(words))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words) if n <= 900 else None
    return words, found


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r["doc_id"]: r for r in queries.QUERIES["op13_runs"](spark, sf_dir).collect()}


def test_query_over_the_given_documents(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(rows) == sorted(d["doc_id"] for d in docs)
    checked = 0
    for d in docs:
        words, found = expected(d["doc_id"], d["text"])
        if found is None:
            continue
        r = rows[d["doc_id"]]
        checked += 1
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert checked > 150 and sum(r["n_runs"] for r in rows.values()) > 5


def test_a_long_document_with_a_planted_run():
    rnd = random.Random(4)
    body = [b"w%d" % rnd.randrange(50) for _ in range(20_000)]
    period = [b"p%d" % rnd.randrange(9) for _ in range(700)]
    words = body[:9000] + period * 3 + period[:17] + body[9000:]
    found = [tuple(r) for r in runs.runs_of_words(words).tolist()]
    assert any(q == 700 and n >= 2117 for _, n, q in found)
    for a, n, q in found:
        assert words[a : a + n - q] == words[a + q : a + n]


def test_odd_input(spark):
    text = "a b c " * 8
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, text, 3), (2, text, None), (2, text, None), (3, "x " * 50_000, 4), (4, " \t\n", 5)], "doc_id long, text string, runs long")
    got = runs.find(docs).collect()
    assert sorted((r["doc_id"] or 0, len(r["runs"]), r["collapsed"]) for r in got) == [(0, 1, "a b c"), (1, 0, ""), (1, 0, ""), (2, 1, "a b c"), (2, 1, "a b c"), (3, 1, "x"), (4, 0, "")]
    empty = hashlib.sha256(b"").hexdigest()
    out = {(r["doc_id"], r["n_runs"]): r for r in runs.digests(docs).collect()}
    assert out[1, 0]["runs_sha256"] == out[1, 0]["collapsed_sha256"] == empty and out[1, 0]["start"] is None
    assert (out[None, 1]["start"], out[None, 1]["length"], out[None, 1]["period"], out[None, 1]["exponent_milli"]) == (0, 24, 3, 8000)
    assert runs.digests(docs.limit(0)).collect() == []


def test_ties_go_to_the_smallest_start():
    a, b = [b"a", b"b"] * 6, [b"c", b"d"] * 6
    assert [tuple(r) for r in runs.runs_of_words(a + b).tolist()] == [(0, 12, 2), (12, 12, 2)]
