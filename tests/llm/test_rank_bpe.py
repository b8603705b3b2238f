"""BPE by rank arrays against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandloom.llm import queries, rank_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = "ab \n\t'st<|endoftext|>éñ漢字🙂\u0085 \x1c123՘࢏\U00010940\U0001fae9"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts() -> list[str]:
    rnd = random.Random(11)
    out = ["", " ", "\n\n ", "it's", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "aaaa" * 300, "ab" * 5000, "=" * 70_000, "é" * 25, "x" * 48, "x" * 49]
    for k in range(600):
        s = "".join(rnd.choice(ODD) for _ in range(rnd.randrange(60)))
        out.append(s + "<|endoftext|>" + s[:5] if k % 5 == 0 else s)
    return out


def test_encoding_equals_the_library(library):
    c = rank_bpe.RankBPE(PATH, PATTERN)
    every = texts()
    for t, got in zip(every, c.encode(every), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want, t[:80]
        assert c.decode(want) == library.decode(want, skip_special_tokens=False) == t


def test_arrays_and_heap_agree():
    c = rank_bpe.RankBPE(PATH, PATTERN)
    rnd = random.Random(5)
    words = [bytes(rnd.choice(b"aeinrst \xc3\xa9") for _ in range(rnd.randrange(1, rank_bpe.SHORT + 1))) for _ in range(500)]
    assert c.merge_short(words) == [c.merge_long(w) for w in words]


def test_a_character_split_over_tokens(library):
    c = rank_bpe.RankBPE(PATH, PATTERN)
    ids = c.encode(["🫩"])[0].tolist()
    assert len(ids) > 1
    for n in range(len(ids) + 1):
        assert c.decode(ids[:n]) == library.decode(ids[:n], skip_special_tokens=False)


def test_memo_starts_anew(monkeypatch, library):
    monkeypatch.setattr(rank_bpe, "MEMO", 3)
    c = rank_bpe.RankBPE(PATH, PATTERN)
    for t in ("one two three four", "five <|endoftext|> six", "one seven"):
        assert c.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        rank_bpe.RankBPE(public_tokenizers.path("word_bpe_49k.json"), PATTERN)


def test_query_over_the_given_documents(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_rank_bpe"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_input(spark):
    rows = [(1, None, "x"), (None, "", None), (2, "ab ab", "y"), (2, "ab ab", "y"), (3, "z" * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = rank_bpe.encode_documents(docs, PATH, PATTERN).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]), len(r["decoded"])) for r in got)[:4] == [(0, 0, 0), (1, 0, 0), (2, 2, 5), (2, 2, 5)]
    assert next(r for r in got if r["doc_id"] == 3)["decoded"] == "z" * 300_000
    back = rank_bpe.decode_documents(rank_bpe.encode_documents(docs, PATH, PATTERN), PATH, PATTERN)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(r[0], r[1] or "") for r in rows}
    assert rank_bpe.encode_digests(docs.limit(0), PATH, PATTERN).collect() == []
