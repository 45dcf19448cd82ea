"""Mutant proteins and the peptides that cover a protein change.

Everything is column arithmetic over a joined (variant, protein) row: no step needs
more than one variant at a time, so the plans have no shuffle of such rows but that of
the protein look-up, whose names are looked up first and stored; hashes of ids are counted
to find those that several rows share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import strip_version
from ..functions.residues import ALPHABET, is_valid
from ..sources.shared import stored

#: Annotation release from which a length change tells where a novel tail starts.
TAIL_RELEASE = 114
#: Lengths of class I peptides, and residues kept on either side.
LENGTHS = (8, 9, 10, 11)
FLANK = 10
#: Most shared ids, or names without a protein yet, that are sent to all tasks.
MOST_IDS = 100_000


def with_protein(variants: DataFrame, proteins: DataFrame) -> DataFrame:
    """Adds seq: the protein of a variant's transcript, else of the protein of that name, else of its gene; null without any.

    ``variants`` has transcript and gene; ``proteins`` protein, transcript, symbol and
    seq.  Of several proteins of one key the longest counts, then the first by name.
    """
    # Each distinct pair of names is looked up once, and only its protein meets the variants.
    plain = lambda c: F.coalesce(c, F.lit(""))
    named = variants.select(plain(strip_version(F.col("transcript"))).alias("_key"), plain(F.col("gene")).alias("_gene"), "*")
    asked, met = named.select("_key", "_gene").distinct(), []
    for key, column in (("_key", "transcript"), ("_key", "protein"), ("_gene", "symbol")):
        known = proteins.where(f"{column} <> '' and seq <> ''").select(F.col(column).alias("_name"), "protein", "seq")
        if met:  # what has a protein is not looked up again, and proteins that few names ask for are not shuffled whole
            left = asked.count()
            if left == 0:
                break
            if left <= MOST_IDS:
                known = known.join(F.broadcast(asked.select(F.col(key).alias("_name")).distinct()), "_name", "left_semi")
        best = known.groupBy("_name").agg(F.min_by("seq", F.struct(-F.length("seq"), "protein")).alias("seq"))
        # Sizes of files say little of texts made from them, so no side is sent to all tasks by such an estimate.
        looked = stored(asked.join(best.hint("merge"), F.col(key) == F.col("_name"), "left").select("_key", "_gene", "seq"))
        met.append(looked.where("seq is not null"))
        asked = looked.where("seq is null").select("_key", "_gene")
    found = reduce(DataFrame.unionByName, met).unionByName(asked.withColumn("seq", F.lit(None).cast("string")))
    return named.join(found.hint("merge"), ["_key", "_gene"]).drop("_key", "_gene")


def change_fields(variants: DataFrame) -> DataFrame:
    """What ``with_protein`` and ``mutant_proteins`` read of each variant, for callers that need no other column: both give the same with it.

    Only a frameshift has a tail, of which nothing counts from the first stop or unknown residue on,
    and a release and a length change that place it; an end that repeats the start is null.
    Columns that most rows lack stand last, side by side, so that shuffled rows compress well.
    """
    of_shift = lambda c: F.when(F.col("variant_class") != "frameshift", F.lit(None)).otherwise(c)
    end = F.when(~F.col("protein_end").eqNullSafe(F.col("protein_start")), F.col("protein_end"))
    return variants.select(
        "transcript", "gene", "variant_class", "aa_ref", "aa_alt", "protein_start", of_shift(_tail(F.col("downstream"))).alias("downstream"),
        end.alias("protein_end"), of_shift(F.col("release")).alias("release"), of_shift(F.col("length_change")).alias("length_change"),
    )


def _tail(downstream: Column) -> Column:
    """Residues before the first stop or unknown residue."""
    return F.regexp_extract(downstream, "^[^*X]*", 0)


def _cut(text: Column, start: Column, stop: Column) -> Column:
    """Characters start (from 0) to before stop; empty where there are none."""
    return F.when(stop > start, F.substring(text, F.greatest(start, F.lit(0)) + 1, stop - F.greatest(start, F.lit(0)))).otherwise(F.lit(""))


def mutant_proteins(variants: DataFrame) -> DataFrame:
    """Adds mutant, first and last (the altered residues: from 0, half open) and error, which is null where mutant is not.

    Needs seq, variant_class, protein_start, protein_end, aa_ref, aa_alt (empty for
    none), downstream, release and length_change.  A change within the frame replaces
    the stated residues; an insertion follows protein_start; a deletion leaves an empty
    interval at the junction.  A frameshift's tail ends before the first stop or
    unknown residue.  From TAIL_RELEASE on the length change places it: what lies
    between protein_start and the tail is the reference for an insertion, else the
    residues that aa_alt states.  Errors: no_protein, reference_mismatch, no_tail,
    missing_residues.
    """
    seq, size, start, shift = F.col("seq"), F.length("seq"), F.col("protein_start"), F.col("variant_class") == "frameshift"
    out = variants.withColumns({"_ref": F.coalesce("aa_ref", F.lit("")), "_alt": F.coalesce("aa_alt", F.lit("")), "_tail": _tail(F.coalesce("downstream", F.lit("")))})
    ref, alt, tail = F.col("_ref"), F.col("_alt"), F.col("_tail")
    out = out.withColumn("_placed", F.when(shift & (F.col("release") >= TAIL_RELEASE), size + F.col("length_change") - F.length(tail) + 1))
    placed = F.col("_placed")
    out = out.withColumn("_moved", placed.isNotNull() & (placed != start))
    moved = F.col("_moved")
    # The reference up to first, what comes in between, and the reference from resume on or the tail.
    inserted = F.when(shift, F.when(moved & (ref == ""), placed - 1).otherwise(start - 1)).otherwise(F.when(ref == "", start).otherwise(start - 1))
    between = F.when(~shift, alt).when(moved & (ref != ""), F.regexp_extract(alt, f"^[{ALPHABET}]*", 0)).otherwise(F.lit(""))
    out = out.withColumns({"first": inserted.cast("int"), "_between": between, "_resume": F.when(ref == "", start).otherwise(F.coalesce("protein_end", "protein_start"))})
    first, resume, bare = F.col("first"), F.col("_resume"), ~moved | (ref == "")
    misplaced = (start < 1) | (start - 1 > size) | F.coalesce((placed < 1) | (placed > size + 1) | (placed < start), F.lit(False))
    unlike = F.when(bare, _cut(seq, first, first + F.length(tail)) == tail).otherwise(_cut(seq, first, first + F.length(ref)) != ref)
    error = (
        F.when(seq.isNull(), F.lit("no_protein"))
        .when(~shift, F.when((first < 0) | (resume > size) | (_cut(seq, first, resume) != ref), F.lit("reference_mismatch")))
        .when(tail == "", F.lit("no_tail"))
        .when(misplaced | unlike, F.lit("reference_mismatch"))
        .when(~bare & (F.length("_between") != placed - start), F.lit("missing_residues"))
    )
    out = out.withColumn("error", error)
    mutant = F.concat(_cut(seq, F.lit(0), first), F.col("_between"), F.when(shift, tail).otherwise(_cut(seq, resume, size)))
    out = out.withColumn("mutant", F.when(F.col("error").isNull(), mutant))
    out = out.withColumn("last", F.when(shift, F.length("mutant")).otherwise(first + F.length(alt)))
    return out.drop("_ref", "_alt", "_tail", "_placed", "_moved", "_between", "_resume")


def window_starts(size: Column, first: Column, last: Column, length: Column, overlap: Column) -> Column:
    """Starts (from 0) of all windows of a length that hold the altered residues, or with ``overlap`` any of them.

    An empty interval is a junction: windows hold the residues on both sides of it.
    """
    low = F.when(last > first, F.when(overlap, first - length + 1).otherwise(last - length)).otherwise(first + 1 - length)
    high = F.when(last > first, F.when(overlap, last - 1).otherwise(first)).otherwise(first - 1)
    low, high = F.greatest(low, F.lit(0)), F.least(high, size - length)
    return F.when((low <= high) & (length <= size), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def shared_ids(variants: DataFrame, id_column: str) -> DataFrame:
    """(_hash): hashes of the ids that more than one row has, stored.

    A row shuffles the eight bytes of its id's hash.  Two ids of one hash are found as
    well; that only sends their rows the longer way.
    """
    hashes = variants.select(F.xxhash64(id_column).alias("_hash")).repartition("_hash")
    return stored(hashes.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"))


def _parted(built: DataFrame, id_column: str, shared: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows with a mutant whose id is theirs alone, and those that may share it; no rows of the latter are None."""
    whole = built.where("mutant is not null")
    shared = shared_ids(whole, id_column) if shared is None else shared
    n = shared.count()
    if n == 0:
        return whole, None
    ids, same = F.broadcast(shared) if n <= MOST_IDS else shared.hint("merge"), F.xxhash64(id_column) == F.col("_hash")
    return whole.join(ids, same, "left_anti"), whole.join(ids, same, "left_semi")


def _anchor() -> Column:
    return F.when(F.col("last") > F.col("first"), F.col("first")).otherwise(F.greatest(F.col("first") - 1, F.lit(0)))


def _described(start: Column, stop: Column, peptide: Column, flank: int) -> dict[str, Column]:
    """wildtype, position, n_flank and c_flank of a peptide; _pure and _clean tell whether seq and mutant have residues only."""
    before = _cut(F.col("seq"), start, stop)
    same = (F.col("variant_class") != "frameshift") & (F.length("mutant") == F.length("seq")) & (F.col("_pure") | is_valid(before)) & (before != "") & (before != peptide)
    left, right = _cut(F.col("mutant"), start - flank, start), _cut(F.col("mutant"), stop, stop + flank)
    return {
        "wildtype": F.when(same, before), "position": F.greatest(F.lit(1), _anchor() - start + 1).cast("int"),
        "n_flank": F.when(F.col("_clean"), left).otherwise(F.regexp_extract(left, f"[{ALPHABET}]*$", 0)),
        "c_flank": F.when(F.col("_clean"), right).otherwise(F.regexp_extract(right, f"^[{ALPHABET}]*", 0)),
    }


def _checked(rows: DataFrame) -> DataFrame:
    """Adds _clean and _pure: a sequence that is valid as a whole spares the check of each of its parts."""
    return rows.withColumns({"_clean": F.coalesce(is_valid(F.col("mutant")), F.lit(False)), "_pure": F.coalesce(is_valid(F.col("seq")), F.lit(False))})


def peptide_lists(built: DataFrame, id_column: str, lengths: tuple[int, ...] = LENGTHS, flank: int = FLANK, shared: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``built`` that have peptides, with ``found``: an array of their start, length, peptide, wildtype, position, n_flank and c_flank.

    What counts as a peptide is told at ``peptides``.  First the rows whose id is theirs alone;
    their repeats are left out within the row, and no list is shuffled.  Then, if there are
    any, those that share an id: each of their peptides has a row of its own.
    """
    first, last = (F.col(c).cast("int") for c in ("first", "last"))
    shift, size = F.col("variant_class") == "frameshift", F.length("mutant")

    def described(start: Column, n: int, peptide: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(n).alias("length"), peptide.alias("peptide"), *[c.alias(name) for name, c in _described(start, start + n, peptide, flank).items()])

    def sized(n: int) -> Column:
        def of(starts: Column) -> Column:
            cut = F.filter(F.array_distinct(F.transform(starts, lambda s: F.substring("mutant", s + 1, F.lit(n)))), lambda p: F.col("_clean") | is_valid(p))
            # The first window of a text is its first place from the lowest start on.
            at = lambda p: F.call_function("locate", p, F.col("mutant"), starts[0] + 1) - 1
            return F.transform(F.transform(cut, lambda p: F.struct(at(p).alias("s"), p.alias("p"))), lambda w: described(w["s"], n, w["p"]))

        # A lambda's argument is computed once.
        return F.transform(F.array(window_starts(size, first, last, F.lit(n), shift)), of)[0]

    def listed(rows: DataFrame) -> DataFrame:
        # As a generated row the list is made once; a filter on a plain column would be moved ahead and make all of it again.
        return _checked(rows).select(*built.columns, F.explode(F.array(F.flatten(F.array(*[sized(n) for n in lengths])))).alias("found")).where(F.size("found") > 0)

    alone, together = _parted(built, id_column, shared)
    if together is None:
        return listed(alone), None
    place = F.row_number().over(W.partitionBy(id_column, "_w.peptide").orderBy("_w.start"))
    merged = listed(together).withColumn("_w", F.explode("found")).withColumn("_place", place).where("_place = 1")
    return listed(alone), merged.withColumn("found", F.array("_w")).drop("_w", "_place")


def peptides(built: DataFrame, id_column: str, lengths: tuple[int, ...] = LENGTHS, flank: int = FLANK, shared: DataFrame | None = None) -> DataFrame:
    """All columns of ``built`` and start, length, peptide, wildtype, position, n_flank and c_flank; one row per peptide of a variant.

    ``built`` has the columns of ``mutant_proteins``; rows with an error give none.  A
    peptide with an unknown residue is left out, and one that occurs twice under one id
    counts at its first place.  ``wildtype`` is the reference at the same place where the
    frame and the length stay and it differs.  ``position`` is that of the first altered
    residue, 1 where it lies before.  Flanks end at the first unknown residue.  ``shared``
    has the ``shared_ids`` of the rows, if a narrower frame than ``built`` gave them.
    """
    first, last = (F.col(c).cast("int") for c in ("first", "last"))
    shift, size = F.col("variant_class") == "frameshift", F.length("mutant")

    def cut(rows: DataFrame) -> DataFrame:
        by_length = F.inline(F.array(*[F.struct(F.lit(n).alias("length"), window_starts(size, first, last, F.lit(n), shift).alias("_starts")) for n in lengths]))
        places = _checked(rows).select("*", by_length).select("*", F.explode("_starts").alias("start")).withColumn("peptide", F.substring("mutant", F.col("start") + 1, F.col("length")))
        # A repeat within a row is one that is found before its own start, from the row's lowest start on.
        once = F.call_function("locate", F.col("peptide"), F.col("mutant"), F.col("_starts")[0] + 1) == F.col("start") + 1
        return places.where((F.col("_clean") | is_valid(F.col("peptide"))) & once).drop("_starts")

    alone, together = _parted(built, id_column, shared)
    found = cut(alone)
    if together is not None:
        place = F.row_number().over(W.partitionBy(id_column, "peptide").orderBy("start"))
        found = found.unionByName(cut(together).withColumn("_place", place).where("_place = 1").drop("_place"))
    told = _described(F.col("start"), F.col("start") + F.col("length"), F.col("peptide"), flank)
    return found.select(*built.columns, "start", "length", "peptide", *[c.alias(name) for name, c in told.items()])
