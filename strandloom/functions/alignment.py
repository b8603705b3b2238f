"""Columns over alignment rows (query_length, residue_matches, alignment_block_length, tags, path, ...)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def nearest(x: Column, digits: int) -> Column:
    """``x`` (double) to ``digits`` decimals as SQL rounds doubles: the product with the power of ten is rounded, halves away
    from zero.  (``F.round`` rounds the shortest decimal that names the double, which differs where the product is at a half.)"""
    y = x * (10.0**digits)
    whole = F.rint(y)
    return F.when(F.abs(y - whole) == 0.5, y + F.signum(y) * 0.5).otherwise(whole) / (10.0**digits)


def tag_triples(fields: Column) -> Column:
    """array of [K, T, V] of the K:T:V fields (V may hold colons); other fields are dropped."""
    return F.filter(F.transform(fields, lambda f: F.split(f, ":", 3)), lambda t: F.size(t) == 3)


def tags_of(triples: Column) -> Column:
    """map of K to V; the later of equal keys counts.  ``triples`` should be a column and no expression, as it is
    used several times."""
    keys = F.transform(triples, lambda t: t[0])
    last = F.filter(F.transform(triples, lambda t, i: F.struct(t[0].alias("k"), t[2].alias("v"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.greatest(F.size(keys), F.lit(1))), e["k"]))
    slow = F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))
    return F.when(F.size(F.array_distinct(keys)) == F.size(triples), F.map_from_arrays(keys, F.transform(triples, lambda t: t[2]))).otherwise(slow)


def coverage(block: Column, query_length: Column) -> Column:
    return ratio(block, query_length)


def identity(matches: Column, block: Column) -> Column:
    return ratio(matches, block)


def path_span(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), end - start)


def alignment_score(tags: Column, matches: Column) -> Column:
    """The AS tag (0 if it is no number), or the matches where there is none."""
    return F.when(F.map_contains_key(tags, "AS"), F.coalesce(tags["AS"].try_cast("double"), F.lit(0.0))).otherwise(matches.cast("double"))


def mismatches(tags: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit("NM")).try_cast("int"), F.lit(0))


def traversed_nodes(path: Column) -> Column:
    """Names between < and > markers in order; a path without markers is one name."""
    return F.filter(F.split(path, "[<>]"), lambda n: n != "")


def revisits(nodes: Column) -> Column:
    return F.greatest(F.size(nodes) - F.size(F.array_distinct(nodes)), F.lit(0))


def traversal_frequency(nodes: Column) -> Column:
    return F.size(nodes) / F.greatest(F.size(F.array_distinct(nodes)), F.lit(1))


# The weights of a composite score's parts.
WEIGHTS = {"identity": 0.45, "coverage": 0.35, "mapq": 0.15, "score": 0.05}


def score_breakdown(ident: Column, cov: Column, mapq: Column, normalized: Column) -> Column:
    """struct of the four weighted parts and their total; missing measures count 0."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    parts = [
        (WEIGHTS["identity"] * zero(ident)).alias("identity_part"),
        (WEIGHTS["coverage"] * zero(cov)).alias("coverage_part"),
        (WEIGHTS["mapq"] * F.least(zero(mapq) / 60.0, F.lit(1.0))).alias("mapq_part"),
        (WEIGHTS["score"] * F.least(zero(normalized), F.lit(1.0))).alias("score_part"),
    ]
    return F.struct(*parts, (parts[0] + parts[1] + parts[2] + parts[3]).alias("total"))


def composite_score(ident: Column, cov: Column, mapq: Column, normalized: Column) -> Column:
    return score_breakdown(ident, cov, mapq, normalized)["total"]


def verdict(h: Column, u: Column) -> Column:
    """struct(label, confidence, tie_like) from healthy and unhealthy evidence; HEALTHY wins ties."""
    gap = F.abs(h - u)
    return F.struct(
        F.when(h >= u, "HEALTHY").otherwise("UNHEALTHY").alias("label"),
        F.least(F.lit(1.0), gap / (h + u + 1e-9)).alias("confidence"),
        (gap < 1e-6).alias("tie_like"),
    )


def score_ratio(h: Column, u: Column) -> Column:
    return h / F.greatest(u, F.lit(1e-9))


def unhealthy_probability(h: Column, u: Column) -> Column:
    return u / F.greatest(h + u, F.lit(1e-9))


def explanation(h: Column, u: Column, label: Column, tie: Column) -> Column:
    """One sentence on the two scores."""
    both = lambda text: F.format_string(text, h, u)
    return F.when(tie, both("Evidence is balanced: healthy %.4f, unhealthy %.4f.")).otherwise(F.concat(label, both(" is better supported: healthy %.4f, unhealthy %.4f.")))


def effective_node_length(length: Column) -> Column:
    """Length within 1 to 12, 1 where unknown."""
    return F.least(F.lit(12), F.greatest(F.lit(1), F.coalesce(length, F.lit(1))))
