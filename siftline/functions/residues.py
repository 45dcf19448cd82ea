"""Amino-acid constants and sequence functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard residues, the Kyte-Doolittle scale, the BLOSUM62
# substitution scores (lower triangle, in the order of ORDER) and the standard
# genetic code (bases in the order T, C, A, G).
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
KYTE_DOOLITTLE = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62_TRIANGLE = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
BLOSUM62: dict[tuple[str, str], int] = {}
for _i, _row in enumerate(BLOSUM62_TRIANGLE.split("\n")[1:-1]):
    for _j, _score in enumerate(map(int, _row.split())):
        BLOSUM62[ORDER[_i], ORDER[_j]] = BLOSUM62[ORDER[_j], ORDER[_i]] = _score

#: Sum of a pair's scores is looked up by its two residues written together.
PAIR_SCORES = {a + b: float(s) for (a, b), s in sorted(BLOSUM62.items())}


def literal_map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def is_valid(sequence: Column) -> Column:
    """Whether a sequence has standard residues only and at least one."""
    return sequence.rlike(f"^[{ALPHABET}]+$")


def clip(value: Column) -> Column:
    """A value held to 0..1; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def hydropathy(peptide: Column) -> Column:
    """Mean Kyte-Doolittle value of the contact residues (third to next-to-last), scaled to 0..1; 0.5 without any.

    Other characters count as 0.
    """
    inner = F.substring(peptide, 3, 1 << 20)
    inner = F.when(F.length(peptide) > 3, inner.substr(F.lit(1), F.length(peptide) - 3)).otherwise(F.lit(""))

    def mean(text: Column) -> Column:
        total = sum((F.length(text) - F.length(F.replace(text, F.lit(r)))) * F.lit(v) for r, v in KYTE_DOOLITTLE.items())
        return F.when(F.length(text) > 0, clip((total / F.length(text) + 4.5) / 9.0)).otherwise(F.lit(0.5))

    # The residues are cut out once, as a lambda's argument, and counted kind by kind, however long the sequence.
    return F.when(peptide.isNotNull(), F.transform(F.array(inner), mean)[0])


def mutation_exposure(position: Column, length: Column) -> Column:
    """0 at an anchor (second and last place), 0.5 at the first place or outside, 1 elsewhere."""
    outside = (length <= 0) | (position < 1) | (position > length)
    return F.when(outside, F.lit(0.5)).when((position == 2) | (position == length), F.lit(0.0)).when(position == 1, F.lit(0.5)).otherwise(F.lit(1.0))


def substitution_dissimilarity(mutant: Column, wildtype: Column) -> Column:
    """Mean of clip((4 - score) / 8) over substituted contact places; 0 without any; null without a wild type of equal length."""
    places = F.when(F.length(mutant) > 3, F.sequence(F.lit(3), F.length(mutant) - 1)).otherwise(F.array().cast("array<int>"))
    changed = F.filter(places, lambda p: F.substring(mutant, p, F.lit(1)) != F.substring(wildtype, p, F.lit(1)))
    # A pair's score is one step into an array; a map of literals would be searched key by key.
    scores = F.array(*[F.lit(float(BLOSUM62[a, b])) for a in ALPHABET for b in ALPHABET])
    at = lambda text, p: F.instr(F.lit(ALPHABET), F.substring(text, p, F.lit(1)))
    pair = lambda i, j: F.when((i > 0) & (j > 0), F.get(scores, (i - 1) * len(ALPHABET) + j - 1))
    value = lambda p: F.coalesce(clip((F.lit(4.0) - pair(at(mutant, p), at(wildtype, p))) / 8.0), F.lit(1.0))
    mean = lambda c: F.when(F.size(c) == 0, F.lit(0.0)).otherwise(clip(F.aggregate(c, F.lit(0.0), lambda acc, p: acc + value(p)) / F.size(c)))
    # As a lambda's argument the changed places are found once.
    return F.when(F.length(mutant) == F.length(wildtype), F.transform(F.array(changed), mean)[0])


def translate_codons(cds: Column) -> Column:
    """Residues of whole codons up to and including the first stop (``*``); unknown codons are X."""
    # Bases become digits 1 to 4 and anything else 0, so a codon is a number and its residue a place in CODE.
    digits = F.regexp_replace(F.translate(F.upper(cds), BASES, "1234"), "[^1-4]", "0")

    def residue(codon: Column) -> Column:
        number = codon.cast("int")
        place = F.floor(number / 100) * 16 + F.floor(number % 100 / 10) * 4 + number % 10 - 20
        return F.when(codon.contains("0"), "X").otherwise(F.substring(F.lit(CODE), place.cast("int"), F.lit(1)))

    def protein(text: Column) -> Column:
        whole = F.floor(F.length(text) / 3).cast("int")
        starts = F.when(whole > 0, F.sequence(F.lit(1), whole * 3 - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))), residue), "")

    # A lambda's argument is computed once, where a column would be computed again for each codon.
    made = F.transform(F.array(digits), protein)[0]
    return F.when(cds.isNotNull(), F.regexp_extract(made, r"^[^*]*\*?", 0))


def windows(sequence: Column, length: int) -> Column:
    """All substrings of a length, in order; none for shorter or null sequences."""
    starts = F.when(F.length(sequence) >= length, F.sequence(F.lit(1), F.length(sequence) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(sequence, i, F.lit(length)).alias("kmer")))
