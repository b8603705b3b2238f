"""Personal data by base patterns and bootstrapped contextual extraction; DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers by regular expression, leftmost and not
overlapping within a kind, then checked (parts of an address, digit counts, Luhn).

Bootstrapping: base matches are the seed instances.  The word before an instance, the word after it, and both are
its lexical patterns.  Other tokens with a digit or an @ are candidate instances of the kinds that their
characters allow.  Spark scores the bipartite graph of patterns and instances in rounds of two joins: a pattern's
confidence for a kind is the share of that kind among the instances it holds of which something is known (with one
more that counts against it), its support the score of its distinct instances of the kind.  Known against a kind
are the seeds of other kinds, and what failed the kind's check; a candidate that no pattern has lifted yet says
nothing.  So a word that stands before anything is no pattern, and a word that stands before one kind is.
Patterns with enough of both give their confidence to the instances they surround.  Instances that reach
``accept`` are added as spans wherever they occur; base spans stay.

Defined results: a null text counts as empty; an empty text has no spans; ids may be null or repeated (rows are
told apart by a number of their own); offsets are code points, ends exclusive; a candidate that patterns lift for
several kinds gets a span of each; neither texts nor context words are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, small_join, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# Each is the plain pattern with possessive loops, and starts only where a run of its first characters does (or
# where the last match ended), which finds the same matches without trying every place in a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Matches that one part of the folds below takes.
PART = 64
FOUND = "struct<start:int,end:int,value:string,before:string,after:string>"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(d, n - i + 1, F.lit(1)).try_cast("int"))
    doubled = F.transform(values, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("bigint") <= 255, F.lit(False)))
    n = F.length(digits(s))
    return n.between(10, 15) if kind == "phone" else n.between(14, 19) & luhn(digits(s))


def placed(items: Column) -> Column:
    """array<struct<start, end, value, before, after>> of matches with the gaps before and after them; ``items`` is an
    array column of struct<m match, g gap before, h gap after, p match before, q match after>.

    Places are summed up in two steps, within parts of ``PART`` matches and over parts, so that the work grows in
    proportion to the matches.
    """
    length = lambda x: F.length(x["g"]) + F.length(x["m"])
    parts = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int")), lambda c: F.slice(items, c * PART + 1, F.lit(PART)))).otherwise(F.slice(F.array(items), 1, 0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    totals = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + length(x)))
    offsets = F.aggregate(totals, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    none = F.array().cast(f"array<{FOUND}>")

    def step(s: Column, x: Column) -> Column:
        first = s["at"] + F.length(x["g"])
        end = first + F.length(x["m"])
        left, right = F.element_at(F.split(F.rtrim(F.regexp_replace(x["g"], r"\s", " ")), " "), -1), F.element_at(F.split(F.ltrim(F.regexp_replace(x["h"], r"\s", " ")), " "), 1)
        # a gap of white space alone has no word: the word is then the match on its other side
        before = F.when(left == "", x["p"]).otherwise(left)
        after = F.when(right == "", x["q"]).otherwise(right)
        one = F.struct(first.alias("start"), end.alias("end"), x["m"].alias("value"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.flatten(F.zip_with(parts, offsets, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])))


def with_matches(df: DataFrame, patterns: dict[str, str], needs: dict[str, Column]) -> DataFrame:
    """``df`` (with text) and, by name, ``placed`` matches of each pattern in the texts that may hold one.  Each step
    is a projection of its own, as what a lambda refers to must be a column already."""
    text = F.col("text")
    df = df.withColumns({f"__m_{k}": F.when(needs[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in patterns.items()})
    df = df.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(text, p, -1)).otherwise(F.array().cast("array<string>")) for k, p in patterns.items()})

    def items(k: str) -> Column:
        m, g = F.col(f"__m_{k}"), F.col(f"__g_{k}")
        n, rest = F.size(m), F.greatest(F.size(m) - 1, F.lit(0))
        none = F.array(F.lit(""))
        return F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), n).alias("g"), F.slice(g, F.lit(2), n).alias("h"), F.slice(F.concat(none, m), F.lit(1), n).alias("p"), F.concat(F.slice(m, F.lit(2), rest), F.slice(none, F.lit(1), F.least(n, F.lit(1)))).alias("q"))

    df = df.withColumns({f"__i_{k}": items(k) for k in patterns})
    df = df.withColumns({k: placed(F.col(f"__i_{k}")) for k in patterns})
    return df.drop(*(f"__{x}_{k}" for x in "mgi" for k in patterns))


def scanned(df: DataFrame, tokens: bool) -> DataFrame:
    """``df`` (with text) and base, array<struct<start, k, end, value, before, after>> in order of start, then kind;
    with ``tokens`` also failed (matches that do not pass their kind's check) and token."""
    text = F.col("text")
    needs = {kind: text.contains(NEEDS[kind]) & text.rlike("[0-9]") if kind != "email" else text.contains("@") for kind in KINDS}
    df = with_matches(df, PATTERNS | ({"token": TOKEN} if tokens else {}), needs | {"token": text.rlike("[0-9@]")})

    def of(k: int, kind: str, good: bool) -> Column:
        some = F.filter(kind, lambda m: valid(kind, m["value"]) if good else ~valid(kind, m["value"]))
        return F.transform(some, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))

    def spans(good: bool) -> Column:
        return F.array_sort(F.concat(*(of(k, kind, good) for k, kind in enumerate(KINDS))))

    return df.withColumns({"base": spans(True)} | ({"failed": spans(False)} if tokens else {})).drop(*KINDS)


def candidate_tokens() -> Column:
    """Trimmed tokens with a digit or an @ that no base span touches; over the columns token and base."""
    trimmed = F.transform("token", lambda m: F.struct((m["start"] + F.length(F.regexp_extract(m["value"], r"^[^A-Za-z0-9+]*", 0))).alias("start"), F.regexp_replace(m["value"], r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "").alias("value"), m["before"].alias("before"), m["after"].alias("after")))
    spans = F.transform(trimmed, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))
    return F.filter(spans, lambda m: (F.length(m["value"]) > 0) & ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))


def allowed(k: int, value: Column) -> Column:
    """Whether the characters of a candidate allow the kind."""
    n = F.length(digits(value))
    plain = ~value.rlike("[A-Za-z@]")
    return (value.rlike("^[^@]+@[^@]+$"), value.rlike(r"^[0-9]+([.:_-][0-9]+){3}$"), plain & n.between(12, 19), plain & n.between(7, 15))[k]


def contexts(df: DataFrame) -> DataFrame:
    """One row a pattern of an occurrence: k, pattern, instance, seed, against.  ``df``: k, value, before, after, seed,
    against."""
    left, right = F.lower("before"), F.lower("after")
    pats = F.array(F.when(left != "", F.concat(F.lit("l "), left)), F.when(right != "", F.concat(F.lit("r "), right)), F.when((left != "") & (right != ""), F.concat(F.lit("lr "), left, F.lit(" "), right)))
    return df.select("k", F.explode(F.filter(pats, lambda p: p.isNotNull())).alias("pattern"), F.lower("value").alias("instance"), "seed", "against")


def bootstrap(occurrences: DataFrame, work: Scratch, rounds: int, min_support: float, min_confidence: float) -> DataFrame:
    """(k, instance, score) of candidate instances that a good pattern surrounds; a table of ``work``."""
    edges = work.put(contexts(occurrences).groupBy("k", "pattern", "instance").agg(F.max("seed").alias("seed"), F.max("against").alias("against")), "patterns")
    # what each pattern holds of other kinds' seeds, and of failed matches of its own kind
    seeds_of = edges.where("seed").groupBy("pattern", "k").agg(F.count("*").alias("n"))
    by_kind = seeds_of.groupBy("pattern").agg(*(F.sum(F.when(F.col("k") != k, F.col("n")).otherwise(0)).alias(f"o{k}") for k in range(len(KINDS))))
    others = by_kind.select("pattern", F.posexplode(F.array(*(f"o{k}" for k in range(len(KINDS))))).alias("k", "others"))
    failed = edges.where("against and not seed").groupBy("k", "pattern").agg(F.count("*").alias("failed"))
    counts = work.put(others.join(failed, ["k", "pattern"], "left").select("k", "pattern", (F.col("others") + F.coalesce("failed", F.lit(0))).alias("against")), "counts")
    seeds = work.put(edges.where("seed").select("k", "instance", F.lit(1.0).alias("score")).distinct(), "seeds")
    free = edges.where("not seed and not against").select("k", "pattern", "instance")
    scores, lifted, good = seeds, None, None
    for _ in range(rounds):
        scored = edges.select("k", "pattern", "instance").join(scores, ["k", "instance"])
        support = scored.groupBy("k", "pattern").agg(F.sum("score").alias("support")).where(F.col("support") >= min_support)
        confidence = F.col("support") / (F.col("support") + F.coalesce("against", F.lit(0)) + 1)
        new_good = work.put(support.join(counts, ["k", "pattern"], "left").select("k", "pattern", confidence.alias("confidence")).where(F.col("confidence") >= min_confidence), "good-patterns")
        new = work.put(free.join(new_good, ["k", "pattern"]).groupBy("k", "instance").agg(F.max("confidence").alias("score")).join(seeds.select("k", "instance"), ["k", "instance"], "left_anti"), "lifted")
        work.drop(*(t for t in (lifted, good) if t is not None))
        lifted, good, scores = new, new_good, seeds.unionByName(new)
    work.drop(edges, counts, seeds, *([good] if good is not None else []))
    return lifted


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_support: float = 5.0, min_confidence: float = 0.8, accept: float = 0.8) -> DataFrame:
    """One row for each row of ``docs``: id, row (its number), base and spans, each array<struct<start, k, end>>."""
    work = Scratch(docs.sparkSession)
    read = scanned(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), tokens=True).withColumn("other", candidate_tokens())

    def known(spans: str, seed: bool) -> Column:
        return F.transform(spans, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["k"].alias("k"), F.lit(seed).alias("seed"), F.lit(not seed).alias("against"), b["value"].alias("value"), b["before"].alias("before"), b["after"].alias("after")))

    def candidates(k: int) -> Column:
        fit = F.filter("other", lambda m: allowed(k, m["value"]))
        return F.transform(fit, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(k).alias("k"), F.lit(False).alias("seed"), F.lit(False).alias("against"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))

    rest = [candidates(k) for k in range(len(KINDS))]
    spans_only = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["k"].alias("k"), b["end"].alias("end")))
    scan = work.put(read.select("id", F.monotonically_increasing_id().alias("row"), spans_only.alias("base"), F.concat(known("base", True), known("failed", False), *rest).alias("found")), "found")
    occurrences = scan.select("row", F.inline("found"))
    lifted = bootstrap(occurrences, work, rounds, min_support, min_confidence)
    chosen = work.put(lifted.where(F.col("score") >= accept).select("k", "instance"), "instances")
    free = occurrences.where("not seed and not against").withColumn("instance", F.lower("value"))
    added = free.join(chosen, ["k", "instance"]).groupBy("row").agg(F.array_distinct(F.collect_list(F.struct("start", "k", "end"))).alias("added"))
    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,k:int,end:int>>"))))
    added = work.put(added, "added")
    work.keep(scan, added)
    return scan.select("id", "row", "base").join(added, "row", "left").select(F.col("id").alias(id_col), "row", "base", both.alias("spans"))


def as_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, base counts by kind, base_sha256, spans and n_added of what ``find`` returns."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"), (F.size("spans") - F.size("base")).alias("n_added"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span (in order; one that begins inside an earlier one is joined to it) replaced by its kind
    in brackets.  ``spans`` is a column; parts of ``PART`` spans work on their own piece of the text."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(spans) - 1, F.lit(0)) / PART).cast("int")), lambda c: F.slice(spans, c * PART + 1, F.lit(PART)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def part(s: Column, c: Column) -> Column:
        end = F.greatest(s["at"], F.array_max(F.transform(c, lambda p: p["end"])))
        piece = F.substring(text, s["at"] + 1, end - s["at"])
        inner = F.struct(piece.alias("piece"), s["at"].alias("base"), s["at"].alias("at"), F.array().cast("array<string>").alias("out"))

        def step(t: Column, p: Column) -> Column:
            fresh = p["start"] >= t["at"]
            added = F.array(F.substring(t["piece"], t["at"] - t["base"] + 1, p["start"] - t["at"]), names[p["k"]])
            return F.struct(t["piece"].alias("piece"), t["base"].alias("base"), F.greatest(t["at"], p["end"]).alias("at"), F.when(fresh, F.concat(t["out"], added)).otherwise(t["out"]).alias("out"))

        done = F.aggregate(c, inner, step, lambda t: F.array_join(t["out"], ""))
        return F.struct(F.coalesce(end, s["at"]).alias("at"), F.concat(s["out"], F.array(F.coalesce(done, F.lit("")))).alias("out"))

    return F.aggregate(parts, start, part, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs``, all rows and columns, personal data in the text replaced by [EMAIL], [IP], [CARD] or [PHONE].

    Base spans are a function of the row's own text and are found in it again; whether others are added depends on
    the text alone, so these travel back by the text's digest: one row a distinct text that has some.  Null texts
    stay null.
    """
    work = Scratch(docs.sparkSession)
    key = F.sha2(F.col(text_col), 256)
    found = find(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", **how)
    more = F.array_except("spans", "base")
    added = work.put(found.where(F.size(more) > 0).groupBy("key").agg(F.first(more).alias("added")), "redactions")
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    packed = docs.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("text"), key.alias("key"))
    rows = scanned(packed, tokens=False).withColumn("base", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["k"].alias("k"), b["end"].alias("end"))))
    rows = small_join(rows, added, ["key"], "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", none))))
    text = F.col(f"row.{text_col}")
    cols = [F.when(F.size("spans") == 0, text).when(text.isNotNull(), masked(F.col("text"), F.col("spans"))).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*cols)
