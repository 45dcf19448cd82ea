"""Normalising identifiers: alleles, peptides, versioned names and protein changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of class I/II alleles and of protein changes.
ALLELE = r"^(?i:HLA-)?(?i)([ABC]|D[PQR][AB]1?)\*?(\d{2,3}):?(\d{2,3})(?::\d{2,3})*[A-Z]?$"
PANEL_ALLELE = r"^(?:HLA[-_]?)?([A-Z]{1,4}[0-9]?)\*?([0-9]{2}):?([0-9]{2,3})(?::[0-9]{2,3}){0,2}$"
SUFFIXED_ALLELE = r"^(?:HLA[-_]?)?([A-Z]{1,4}[0-9]?)\*?([0-9]{2}):?([0-9]{2,3})(?::[0-9]{2,3}){0,2}([NLSCAQGP]?)$"
ALLELE_TOKEN = r"(?:HLA-)?[A-Z]{1,4}[0-9]?\*[0-9]{2}:?[0-9]{2,3}(?::[0-9]{2,3}){0,2}[NLSCAQGP]?"
CHANGES = (
    ("frameshift", r"^(?i)p?\.?([A-Z])(\d+)(?:[A-Z]*)fs"),
    ("missense", r"^p?\.?([A-Z])(\d+)([A-Z])$"),
    ("deletion_range", r"^p?\.?([A-Z])(\d+)_([A-Z])(\d+)del$"),
    ("deletion", r"^p?\.?([A-Z])(\d+)del$"),
    ("insertion", r"^p?\.?([A-Z])(\d+)_([A-Z])(\d+)ins([ACDEFGHIKLMNPQRSTVWY]+)$"),
)
MAX_DELETION_SPAN = 30
CLASS_I = ("A", "B", "C")


def _trimmed(raw: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def _compact(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, r"\s+", ""))


def once(name: Column, read: Callable[[Column], Column]) -> Column:
    """``read`` of a name that is computed once: a lambda's argument, where a column would be computed again at each place."""
    return F.transform(F.array(name), read)[0]


def normalize_allele(raw: Column) -> Column:
    """``HLA-A*02:01`` from any accepted spelling, two fields; null otherwise."""
    name = _trimmed(raw)
    part = lambda i: F.regexp_extract(name, ALLELE, i)
    return F.when(name.rlike(ALLELE), F.concat(F.lit("HLA-"), F.upper(part(1)), F.lit("*"), part(2), F.lit(":"), part(3)))


def gene_of(allele: Column) -> Column:
    """The gene of a canonical name, as ``A`` of ``HLA-A*02:01``."""
    return F.regexp_extract(allele, r"^[^-]*-([^*]*)", 1)


def is_class_i(allele: Column) -> Column:
    return gene_of(allele).isin(*CLASS_I)


def genotype(tokens: Column) -> Column:
    """alleles, canonical, each once and in order, and the tokens that are ``unreadable``; empty tokens are left out."""
    tokens = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: _trimmed(t) != "")
    read = F.transform(tokens, normalize_allele)
    return F.struct(
        F.array_distinct(F.filter(read, lambda a: a.isNotNull())).alias("alleles"),
        F.array_distinct(F.filter(tokens, lambda t: normalize_allele(t).isNull())).alias("unreadable"),
    )


def genotype_tokens(text: Column) -> Column:
    """The names of a comma, semicolon or space separated list."""
    return F.split(text, r"[,;\s]+")


def normalize_peptide(raw: Column) -> Column:
    """Letters only, upper-case, white space dropped; null otherwise."""
    return once(_compact(raw), lambda name: F.when(name.rlike(r"^\p{L}+$"), name))


def normalize_panel_allele(raw: Column) -> Column:
    """The allele spelling of assay panels; null if it fits none."""
    # What may stand behind the end of the pattern, a line's end, is dropped.
    return once(compact_name(raw), lambda name: F.when(name.rlike(PANEL_ALLELE), F.regexp_replace(name, f"(?s){PANEL_ALLELE}.*", r"HLA-$1*$2:$3")))


def _one_allele(name: Column, alias: Column) -> Column:
    part = lambda i: F.regexp_extract(name, SUFFIXED_ALLELE, i)
    gene = F.when(part(1) == "CW", F.lit("C")).otherwise(part(1))
    # The format decides first, so an alias never rewrites a name that can be read.
    return F.when(name.rlike(SUFFIXED_ALLELE), F.concat(F.lit("HLA-"), gene, F.lit("*"), part(2), F.lit(":"), part(3), part(4))).otherwise(alias)


def allele_chains(raw: Column) -> Column:
    """The chains that a name states: several alleles, or two halves without any; else the name itself; empty for an empty name."""
    name = compact_name(raw)
    tokens = F.regexp_extract_all(name, F.lit(ALLELE_TOKEN), F.lit(0))
    halves = F.split(name, "-")
    paired = ~name.contains("*") & name.contains("-") & ~((F.size(halves) == 2) & (halves[0] == "HLA"))
    return F.when(name == "", F.array().cast("array<string>")).when(F.size(tokens) >= 2, tokens).when(paired, halves).otherwise(F.array(name))


def canonical_allele(raw: Column, aliases: Column) -> Column:
    """One canonical name; several chains are sorted and joined by ``-``, null if any fails.

    ``aliases`` maps chains (compact, upper-case) to canonical names.
    """
    read = F.transform(allele_chains(raw), lambda t: _one_allele(t, F.try_element_at(aliases, t)))
    return F.when((F.size(read) > 0) & F.forall(read, lambda r: r.isNotNull()), F.array_join(F.array_sort(read), "-"))


def compact_name(raw: Column) -> Column:
    """The form under which the alias table is looked up."""
    return F.replace(_compact(raw), F.lit("_"), F.lit("-"))


def strip_version(name: Column) -> Column:
    """An identifier without its version suffix."""
    return F.split(_trimmed(name), r"\.")[0]


def protein_change(text: Column) -> Column:
    """struct(kind, start, end, ref, alt) of a protein change, by the first pattern that fits; null if unreadable."""
    text = _trimmed(F.coalesce(text, F.lit("")))
    out = F.lit(None)
    for kind, pattern in reversed(CHANGES):
        part = lambda i, p=pattern: F.regexp_extract(text, p, i)
        start = part(2).try_cast("int")
        end = part(4).try_cast("int") if kind == "deletion_range" else start
        ref = F.lit("") if kind in ("deletion_range", "insertion") else part(1)
        alt = part(3) if kind == "missense" else part(5) if kind == "insertion" else F.lit("")
        found = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), ref.alias("ref"), alt.alias("alt"))
        found = F.when(start.isNotNull(), found)  # a number beyond any protein is unreadable
        if kind == "deletion_range":
            found = F.when((end >= start) & (end - start <= MAX_DELETION_SPAN), found)
        out = F.when(text.rlike(pattern), found).otherwise(out)
    return out
