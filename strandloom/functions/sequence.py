"""Columns over sequences and their headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEALTHY, UNHEALTHY, REFERENCE = "HEALTHY", "UNHEALTHY", "REFERENCE"

# Reference accessions and their genes, the first that a header holds counts.
ACCESSIONS = {"NC_000021": "APP", "NC_000014": "PSEN1", "NC_000001": "PSEN2"}

HEADER = r"^([A-Za-z0-9]+)_([HU])_([0-9]+)$"


def normalize_sequence(s: Column) -> Column:
    """Upper case, without white space."""
    return F.regexp_replace(F.upper(s), r"\s", "")


def is_valid_dna(s: Column) -> Column:
    """Whether ``s`` is one or more of A, C, G, T and N, and nothing else."""
    return F.coalesce(s.rlike(r"^[ACGTN]+\z"), F.lit(False))


def gene_from_reference(header: Column, accessions: dict[str, str] = ACCESSIONS) -> Column:
    out = F.lit("UNKNOWN")
    for accession, gene in reversed(accessions.items()):
        out = F.when(header.contains(accession), gene).otherwise(out)
    return out


def parse_header(header: Column, failfast: bool = False) -> Column:
    """struct(sequence_id, gene, label, is_reference) of a header; null (or an error) if it has no known form."""
    h = F.trim(header)
    sample = h.rlike(HEADER)
    gene = F.upper(F.regexp_extract(h, HEADER, 1))
    label = F.when(F.regexp_extract(h, HEADER, 2) == "H", HEALTHY).otherwise(UNHEALTHY)
    row = lambda g, lab, ref: F.struct(h.alias("sequence_id"), g.alias("gene"), lab.alias("label"), F.lit(ref).alias("is_reference"))
    bad = F.raise_error(F.concat(F.lit("not a sequence header: "), h)) if failfast else F.lit(None)
    return F.when(h.startswith("ref|"), row(gene_from_reference(h), F.lit(REFERENCE), True)).when(sample, row(gene, label, False)).otherwise(bad)


def wrapped(s: Column, width: int = 80) -> Column:
    """``s`` in lines of ``width``."""
    return F.regexp_replace(s, f"(.{{{width}}})(?!$)", "$1\n")


def label_to_int(label: Column) -> Column:
    """1 for UNHEALTHY in any case, else 0."""
    return F.when(F.upper(label) == UNHEALTHY, 1).otherwise(0)


def label_decode(y: Column) -> Column:
    return F.when(y == 1, UNHEALTHY).otherwise(HEALTHY)
