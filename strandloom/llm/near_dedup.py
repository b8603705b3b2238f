"""Near-duplicate components: banded MinHash candidates, odd-sketch verification, exact confirmation.

A document's set holds its distinct word shingles as 64-bit hashes.  Documents with equal sets form a class at
once, by an aggregation of set digests.  For each class:

* ``BANDS`` bands of ``ROWS`` MinHash samples give its buckets.  At similarity 0.8 a pair misses every bucket
  with probability (1 - 0.8**5)**32, about 3 in a million.
* The odd sketch folds the samples into a parity bitmap of ``BITS`` bits: sample i with value v flips bit
  hash(i, v).  The population count of two bitmaps' XOR estimates how many samples differ, sharply at high
  similarities, so a candidate needs 64 bytes a side.  The cut-off lies 6 deviations beyond the count expected
  at the wanted similarity, and what passes it is confirmed on the full sets.

All pairs of a bucket are never made.  Each bucket has a hub, the member with the most company over all bands (a
group's original rather than one of its edited copies), and every member is measured against it: exactly, if
the odd sketch puts the pair near enough to matter.  Of a pair (x, a) of members with hub h, similar enough
itself,

* both may reach the wanted similarity t with h: then h connects them;
* both may be measured with it, that is, have 2t - 1 at least: what each removes from h and adds to it gives their
  exact similarity, so these pairs are decided in blocks of members by counting common bits, and a block
  returns a spanning forest of its links;
* one may have less than 2t - 1: as 1 - similarity is a metric, the other is then not linked with h either, so
  the members that are not linked with the hub form a bucket of their own with a new hub.  What is left after
  ``PEELS`` hubs, and pairs with such a far member alone, is compared block against block on bitmaps, across
  components only, whatever the bucket's size.

In both kinds of blocks, members that need no test among themselves (linked with the hub, or measured with it) meet
only the others.

Bitmaps give no pairs either: they tell which members have a close one in their bucket, and these meet again in blocks
with their full sets, a block returning a spanning forest of its links.  Nothing is capped; what bands and the bitmaps' cut-offs may miss is
bounded by the probabilities above.

Classes have numbers of their own, so an id may stand for several texts: each is compared, and ids come in at the
end.  Joins whose keys may be hot (buckets, hubs, digests) have a stored table of one row a key on the other side,
so a hot partition can be split at run time.

Defined results: a null or empty text, or one of white space alone, has an empty set and is linked with
nothing; repeated rows (equal ids too) each get a row; of an id with several texts each row has its own text's
component; a row with a null id is compared like others, is kept, and names no component; ties go to the
smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import REMEMBERED, TEXTS, Scratch, small_join, texts_of
from strandloom.llm.components import components

BANDS, ROWS, BITS = 32, 5, 512
SAMPLES = BANDS * ROWS
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: The same where full sets are compared.
SET_BLOCK = 256
#: Hubs that a bucket gets, one after the other.
PEELS = 2

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 bits of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles: ASCII letters lower-cased, words between ASCII white space."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxh64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))))
    for k in range(min(size, len(h))):
        out = mix(out ^ h[k : k + n]) + np.uint64(k)
    return np.unique(out)


def minhash(s: np.ndarray) -> np.ndarray:
    """One sample a hash function: the least value of the set under it."""
    out = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(s), 4096):
        part = s[None, k : k + 4096] * _MUL[:, None]
        part += _ADD[:, None]
        part ^= part >> np.uint64(29)
        np.minimum(out, part.min(1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap, as bytes."""
    bit = mix(samples + np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=BITS).astype(np.uint8) & 1)


def cut_off(similarity: float, deviations: float = 4.0) -> int:
    """XOR bits that a pair of this similarity hardly ever exceeds: so many deviations of the samples, and two of
    the bitmap, beyond what is expected."""
    high = min(SAMPLES, SAMPLES * (1 - similarity) + deviations * np.sqrt(SAMPLES * similarity * (1 - similarity)))
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * high))
    return int(np.ceil(expected + 2 * np.sqrt(expected * (1 - expected / BITS))))


def similarity_of(xor_bits: int) -> float:
    """Estimated share of equal samples from the XOR's population count."""
    inside = max(1e-9, 1 - 2 * xor_bits / BITS)
    return max(0.0, 1 + BITS * np.log(inside) / (4 * SAMPLES))


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, body (a hash of the text), n_shingles, digest (of the set), bands array<bigint>, sketch binary; bands and
    sketch null for empty sets."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        known: dict[bytes, int] = {}
        for b in batches:
            n, digests, bands, sketches = [], [], [], []
            for text in texts_of(b.column(2)):
                if len(known) > REMEMBERED:
                    known = {}
                s = shingle_set(text, shingle, known)
                n.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()))
                if not len(s):
                    bands.append(None)
                    sketches.append(None)
                    continue
                m = minhash(s)
                h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
                for r in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ m[r::ROWS])
                bands.append(h.view(np.int64))
                sketches.append(odd_sketch(m).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "body", "n_shingles", "digest", "bands", "sketch"])

    text = F.col(text_col).cast("string")
    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))
    return kept.mapInArrow(fn, "id bigint, body bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch binary")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles array<bigint>) of the wanted classes; ``wanted``: id (the class), first (a row's id and body)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for part in (b.slice(at, TEXTS) for b in batches for at in range(0, len(b), TEXTS)):
            if len(known) > REMEMBERED:
                known = {}
            got = [shingle_set(text, shingle, known).view(np.int64) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int64()))], ["id", "shingles"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))
    rows = rows.join(wanted.select("id", F.col("first.id").alias("doc"), F.col("first.body").alias("body")), ["doc", "body"])
    return rows.groupBy("doc", "body").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text").mapInArrow(fn, "id bigint, shingles array<bigint>")


def xor_bits(a: str, b: str):
    """Population count of two bitmaps' XOR, as a column."""
    word = lambda c, k: F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("bigint")
    out = F.bit_count(word(a, 0).bitwiseXOR(word(b, 0)))
    for k in range(1, BITS // 64):
        out = out + F.bit_count(word(a, k).bitwiseXOR(word(b, k)))
    return out


def hubs_of(members: DataFrame, work: Scratch) -> DataFrame:
    """(bucket, id, hub) of the buckets of several members; ``members``: bucket, id."""
    several = work.put(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "several")
    sized = work.put(members.select("bucket", "id").join(several, "bucket"), "sized")
    company = sized.groupBy("id").agg(F.sum("n").alias("company"))
    hubs = work.put(sized.join(company, "id").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("i"))).alias("h")).select("bucket", (-F.col("h.i")).alias("hub")), "hubs")
    found = work.put(sized.select("bucket", "id").join(hubs, "bucket"), "members")
    work.drop(several, sized, hubs)
    return found


def sketched(members: DataFrame, sketch: DataFrame, limit: int) -> DataFrame:
    """(x, h, bits) of members and their hubs whose bitmaps differ in at most ``limit`` bits."""
    pairs = members.where("id <> hub").select(F.col("id").alias("x"), F.col("hub").alias("h")).distinct()
    both = pairs.join(sketch.select(F.col("id").alias("x"), F.col("sketch").alias("a")), "x").join(sketch.select(F.col("id").alias("h"), F.col("sketch").alias("b")), "h")
    return both.select("x", "h", xor_bits("a", "b").alias("bits")).where(F.col("bits") <= limit)


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, h, nh, gone, news, linked): what x removes from and adds to h, for pairs near enough to matter."""
    a = sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx"))
    b = sets.select(F.col("id").alias("h"), F.col("shingles").alias("sh"))
    rows = pairs.select("x", "h").join(a, "x").join(b, "h").select("x", "h", F.size("sh").alias("nh"), F.array_except("sh", "sx").alias("gone"), F.array_except("sx", "sh").alias("news"))
    inter, union = F.col("nh") - F.size("gone"), F.col("nh") + F.size("news")
    rows = rows.withColumns({"linked": 100 * inter >= percent * union, "near": 100 * inter >= (2 * percent - 100) * union})
    return rows.where("near").drop("near")


def dealt(members: DataFrame, key: str, id_col: str, meets: Column, work: Scratch, block: int | None = None) -> DataFrame:
    """``members`` dealt into blocks by a hash of their id, once for each meeting (first, second) of two blocks of
    one key; left: whether the row is on the first side; cross: whether the sides are two blocks.

    Where ``meets`` holds, a row meets all rows of its key; other rows meet only those, in blocks of their own, so
    their number counts once and not squared.  A key that fits into one block is one meeting.
    """
    size = block or BLOCK
    counts = members.groupBy(key).agg(F.count("*").alias("n"), F.count_if(meets).alias("n_meets")).where("n_meets > 0")
    number = lambda n: F.ceil(n / size).cast("int")
    one = F.col("n") <= size
    sized = work.put(counts.select(key, F.when(one, 1).otherwise(number(F.col("n_meets"))).alias("hosts"), F.when(one, 0).otherwise(number(F.col("n") - F.col("n_meets"))).alias("guests")), "sized")
    host, hosts, guests = meets | (F.col("guests") == 0), F.col("hosts"), F.col("guests")
    own = F.pmod(F.xxhash64(id_col), F.when(host, hosts).otherwise(guests)) + F.when(host, 0).otherwise(hosts)
    rows = members.join(sized, key).withColumns({"block": own.cast("int"), "last": F.when(host, hosts + guests).otherwise(hosts) - 1})
    met = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    first, second = F.least("block", "other"), F.greatest("block", "other")
    return met.withColumns({"first": first, "second": second, "left": F.col("block") == first, "cross": first != second}).drop("hosts", "guests", "block", "last", "other")


def arrays_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists as views of its values, which never become Python numbers."""
    out = []
    for c in column.chunks:
        at, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        out += [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def bit_rows(lists: list[np.ndarray], least: int) -> np.ndarray:
    """One row of bits a list, a bit for each value that ``least`` lists hold at least, in words of 64."""
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists) if sizes.sum() else np.zeros(0, np.int64)
    values, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(n >= least) - 1
    keep = (n >= least)[at]
    out = np.zeros((len(lists), -(-max(1, int((n >= least).sum())) // 64)), np.uint64)
    row, bit = np.repeat(np.arange(len(lists)), sizes)[keep], number[at][keep]
    np.bitwise_or.at(out, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def forest(pairs: list[tuple[int, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (i, each of js)."""
    root, out = list(range(n)), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, js in pairs:
        for j in js.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[a] = b
                out.append((i, j))
    return out


def beside_hub(near: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """(u, v): links of members measured with one hub, one of them at least not linked with it; a spanning forest
    of those of each meeting of blocks."""

    def fn(t: pa.Table) -> pa.Table:
        ids, left, linked = (t[c].to_numpy(zero_copy_only=False) for c in ("x", "left", "linked"))
        lists = {c: arrays_of(t[c]) for c in ("gone", "news")}
        gone, news = bit_rows(lists["gone"], 2), bit_rows(lists["news"], 2)
        r, n = (np.array([len(x) for x in lists[c]]) for c in ("gone", "news"))
        nh = t["nh"][0].as_py()
        size = nh - r + n
        a, b = np.flatnonzero(left), np.arange(len(ids)) if not t["cross"][0].as_py() else np.flatnonzero(~left)
        found = []
        for i in a.tolist():
            j = b[~linked[b]] if linked[i] else b
            inter = nh - r[i] - r[j] + np.bitwise_count(gone[j] & gone[i]).sum(1, dtype=np.int64) + np.bitwise_count(news[j] & news[i]).sum(1, dtype=np.int64)
            hit = j[100 * inter >= percent * (size[i] + size[j] - inter)]
            found.append((i, hit[hit != i]))
        kept = forest(found, len(ids))
        u, v = (np.array([ids[p[k]] for p in kept], np.int64) for k in (0, 1))
        return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    rows = dealt(near, "h", "x", ~F.col("linked"), work)
    return rows.groupBy("h", "first", "second").applyInArrow(fn, "u bigint, v bigint")


def close(bits: np.ndarray, comp: np.ndarray, far: np.ndarray, left: np.ndarray, cross: bool, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js) over the two sides of a meeting: what of another component, one of them at least far, differs from i in
    at most ``limit`` bits."""
    a, b = np.flatnonzero(left), np.arange(len(bits)) if not cross else np.flatnonzero(~left)
    for i in a.tolist():
        near = np.bitwise_count(bits[b] ^ bits[i]).sum(1) <= limit
        js = b[near & (comp[b] != comp[i]) & (far[b] | far[i])]
        if len(js):
            yield i, js


def with_company(members: DataFrame, limit: int, work: Scratch) -> DataFrame:
    """(bucket, id) of the members of a bucket that have a ``close`` one in it: a row each, and not one a pair.
    ``members``: bucket, id, far, comp, sketch."""

    def fn(t: pa.Table) -> pa.Table:
        ids, comp, left, far = (t[c].to_numpy(zero_copy_only=False) for c in ("id", "comp", "left", "far"))
        bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
        seen = np.zeros(len(ids), bool)
        for i, js in close(bits, comp, far, left, t["cross"][0].as_py(), limit):
            seen[i] = True
            seen[js] = True
        kept = np.unique(ids[seen])
        return pa.table({"bucket": pa.array(np.full(len(kept), t["bucket"][0].as_py(), np.int64)), "id": pa.array(kept)})

    return dealt(members, "bucket", "id", F.col("far"), work).groupBy("bucket", "first", "second").applyInArrow(fn, "bucket bigint, id bigint").distinct()


def company_links(members: DataFrame, limit: int, percent: int, work: Scratch) -> DataFrame:
    """(u, v): links between ``close`` members of a bucket, decided on full sets in blocks; a spanning forest of those
    of each meeting.  ``members``: bucket, id, far, comp, sketch, shingles."""

    def fn(t: pa.Table) -> pa.Table:
        ids, comp, left, far = (t[c].to_numpy(zero_copy_only=False) for c in ("id", "comp", "left", "far"))
        bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
        lists = arrays_of(t["shingles"])
        size = np.array([len(x) for x in lists])
        common = bit_rows(lists, 2)
        found = []
        for i, js in close(bits, comp, far, left, t["cross"][0].as_py(), limit):
            inter = np.bitwise_count(common[js] & common[i]).sum(1, dtype=np.int64)
            found.append((i, js[100 * inter >= percent * (size[i] + size[js] - inter)]))
        kept = forest(found, len(ids))
        u, v = (np.array([ids[p[k]] for p in kept], np.int64) for k in (0, 1))
        return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    return dealt(members, "bucket", "id", F.col("far"), work, min(BLOCK, SET_BLOCK)).groupBy("bucket", "first", "second").applyInArrow(fn, "u bigint, v bigint").distinct()


def decide(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of ``docs``: id, body (a hash of the text), n_shingles, component_id, class_id, stands
    (whether the row's id and text are the component's first, by id, then by body); a stored table."""
    work = Scratch(docs.sparkSession)
    signed = work.put(signatures(docs, shingle, id_col, text_col), "signatures")
    # bands and sketch follow from the set alone, so any of a class's rows has them
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "body")))
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(first.alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = work.put(classes.where("first is not null").withColumn("id", F.monotonically_increasing_id()), "classes")

    sketch, firsts = classes.select("id", "sketch"), classes.select("id", "first")
    members = classes.select("id", F.posexplode("bands").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("bucket"))
    sets = near = None
    for _ in range(PEELS):
        members = hubs_of(members, work)
        star = work.put(sketched(members, sketch, cut_off(2 * percent / 100 - 1)), "near-hub")
        if near is not None:
            star = work.put(star.join(near.select("x", "h"), ["x", "h"], "left_anti"), "star")
        ids = star.select(F.explode(F.array("x", "h")).alias("id")).distinct()
        if sets is not None:
            ids = ids.join(sets.select("id"), "id", "left_anti")
        new = work.put(sets_of(docs, ids.join(firsts, "id"), shingle, id_col, text_col), "sets")
        sets = new if sets is None else sets.unionByName(new)
        new = work.put(measured(star, sets, percent), "measured")
        near = new if near is None else near.unionByName(new)
        # far is decided by full sets, as what is measured with the hub is; a bitmap alone lets through what neither sees
        seen = near.select(F.col("x").alias("id"), F.col("h").alias("hub"), "linked")
        rest = work.put(members.where("id <> hub").join(seen, ["id", "hub"], "left").where("linked is null or not linked").select("bucket", "id", F.col("linked").isNull().alias("far")), "rest")
        some = work.put(rest.where("far").select("bucket").distinct(), "open-buckets")
        left = work.put(rest.join(some, "bucket"), "left")
        work.drop(members, star, rest, some)
        members = left
    direct = near.where("linked").select(F.least("x", "h").alias("u"), F.greatest("x", "h").alias("v"))
    links = work.put(direct.unionByName(beside_hub(near, percent, work)), "links")
    comp = components(links, work)

    named = work.put(members.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("bucket", "id", "far", F.coalesce("component", "id").alias("comp")), "named")
    mixed = work.put(named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket"), "mixed")
    blocks = work.put(named.join(mixed, "bucket").join(sketch, "id"), "blocks")
    late = work.put(with_company(blocks, cut_off(percent / 100), work), "late")
    if not late.isEmpty():
        more = late.select("id").distinct().join(sets.select("id"), "id", "left_anti").join(firsts, "id")
        sets = sets.unionByName(work.put(sets_of(docs, more, shingle, id_col, text_col), "sets"))
        whole = work.put(blocks.join(late, ["bucket", "id"]).join(sets, "id"), "whole")
        found = work.put(company_links(whole, cut_off(percent / 100), percent, work), "links")
        if not found.isEmpty():
            comp = components(links.unionByName(found), work)
    work.keep(signed, classes, comp)

    member = work.put(comp.select(F.col("node").alias("id"), "component").join(firsts, "id"), "linked-classes")
    leads = work.put(member.groupBy("component").agg(F.min("first").alias("lead")), "leads")
    lead_of = work.put(member.join(leads, "component").select("id", "lead"), "lead-of")
    class_of = work.put(classes.select("id", "digest", "first").join(lead_of, "id", "left").select("digest", F.col("first.id").alias("class_id"), F.coalesce("lead", "first").alias("lead")), "class-of")
    out = signed.select("id", "body", "n_shingles", "digest").join(class_of, "digest", "left")
    stands = F.coalesce((F.col("id") == F.col("lead.id")) & (F.col("body") == F.col("lead.body")), F.lit(True))
    table = work.put(out.select("id", "body", "n_shingles", F.coalesce("lead.id", "id").alias("component_id"), "class_id", (stands | F.col("id").isNull()).alias("stands")), "decided")
    work.keep(table)
    return table


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept, class_id.

    Documents are linked if 100 * intersection >= percent * union of their sets; component_id is the smallest
    id reachable over links, class_id the smallest id with an equal set.
    """
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull())
    return decide(docs, shingle, percent, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"), "class_id")


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component.

    Of rows with the same id and text, the first in order of the row's JSON stays; rows without words all stay, and
    so do rows with a null id.  Only ids and hashes of dropped rows travel, unless they are too many to broadcast.
    """
    work = Scratch(docs.sparkSession)
    found = decide(docs, shingle, percent, id_col, text_col)
    key = [F.col(f"row.{id_col}").cast("bigint").alias("id"), F.xxhash64(F.col(f"row.{text_col}").cast("string")).alias("body")]
    gone = work.put(found.where("not stands").select("id", "body").distinct(), "gone")
    twice = work.put(found.where("stands and n_shingles > 0 and id is not null").groupBy("id", "body").agg(F.count("*").alias("n")).where("n > 1").select("id", "body"), "twice")
    rows = docs.select(F.struct("*").alias("row")).select("row", *key)
    left = small_join(rows, gone, ["id", "body"], "left_anti")
    if twice.isEmpty():
        return left.select("row.*")
    once = small_join(left, twice, ["id", "body"], "left_semi").groupBy("id", "body").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return small_join(left, twice, ["id", "body"], "left_anti").select("row.*").unionByName(once.select("row.*"))
