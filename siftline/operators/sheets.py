"""Published sheets of mutations and of assay results, and why each of their rows was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.names import protein_change
from ..functions.residues import is_valid
from .claims import usable_aliases
from .matching import with_isoform

# Classes of the mutation sheet and their consequence terms.
CLASSES = {"Missense_Mutation": "missense_variant", "In_Frame_Del": "inframe_deletion", "In_Frame_Ins": "inframe_insertion"}
MUTATION_DROPS = ("patient", "class", "change", "isoform")
LABEL_DROPS = ("peptide", "allele", "call")


def _first(reasons: dict[str, Column]) -> Column:
    """The first reason that applies, or null."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in reasons.items()])


def tallied(rows: DataFrame, reasons: tuple[str, ...], label: str = "drops") -> tuple[DataFrame, Observation]:
    """The rows that were not dropped, and counts of all rows, the kept ones and each reason, taken while these are next used."""
    seen = Observation(label)
    counts = [F.count_if(F.coalesce(F.col("dropped") == name, F.lit(False))).alias(f"dropped_{name}") for name in reasons]
    kept = F.col("dropped").isNull()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("kept"), *counts).where(kept).drop("dropped"), seen


def tally(rows: DataFrame, detail: str | None = None) -> DataFrame:
    """(dropped, detail, n): rows by reason ('kept' without any), the class ones by ``detail`` if it is named."""
    told = F.when(F.col("dropped") == "class", F.col(detail)) if detail else F.lit(None).cast("string")
    return rows.groupBy(F.coalesce("dropped", F.lit("kept")).alias("dropped"), told.alias("detail")).agg(F.count("*").alias("n"))


def mutations(sheet: DataFrame, isoforms: DataFrame, patients: list[int], aliases: DataFrame | None = None) -> DataFrame:
    """The rows of a mutation sheet as variants: row_id, patient, the variant table's columns, class and ``dropped``.

    ``sheet``: row_id (unique), patient (a number), gene, class, change, chrom, pos, ref and
    alt, as text; rows whose patient is no number are headings and go.  ``isoforms``: symbol,
    transcript (unique), seq, primary.  ``aliases``: old, new; one counts where the gene itself is not
    known.  ``dropped`` names the first of MUTATION_DROPS: another patient, another class,
    a change that cannot be read, or no isoform that fits.  A deletion names only its ends, so its residues are the isoform's.
    """
    number = F.col("patient").try_cast("double").cast("int")
    # As a generated row the change is parsed once, not again in every expression that uses it.
    parsed = F.explode(F.array(F.when(F.trim("change").startswith("p."), protein_change(F.col("change"))))).alias("change")
    read = sheet.select(
        "row_id", number.alias("patient"), F.trim(F.coalesce("gene", F.lit(""))).alias("gene"), F.coalesce("class", F.lit("")).alias("class"), "chrom",
        F.col("pos").try_cast("double").cast("long").alias("pos"), F.coalesce("ref", F.lit("N")).alias("ref"), F.coalesce("alt", F.lit("N")).alias("alt"), parsed,
    ).where("patient is not null")
    c = F.col("change")
    early = _first({"patient": ~F.col("patient").isin(patients), "class": ~F.col("class").isin(list(CLASSES)), "change": c.isNull() | (c["kind"] == "frameshift")})
    read = read.withColumn("dropped", early)
    # Rows that drop by their text alone meet nothing; a row that is looked up goes along whole.
    nothing = {"transcript": F.lit(None).cast(isoforms.schema["transcript"].dataType), "span": F.lit(None).cast("string")}
    early = read.where("dropped is not null").withColumns(nothing)
    placed = with_isoform(read.where("dropped is null").drop("dropped"), isoforms, None if aliases is None else usable_aliases(aliases, isoforms))
    placed = placed.withColumn("span", F.substring(F.col("seq"), c["start"], c["end"] - c["start"] + 1)).withColumn("transcript", F.when(F.col("span") != "", F.col("transcript")))
    out = placed.drop("seq", "known").withColumn("dropped", F.when(F.col("transcript").isNull(), "isoform")).unionByName(early)
    acids = F.when(F.col("class") == "In_Frame_Del", F.concat("span", F.lit("/-"))).when(F.col("class") == "In_Frame_Ins", F.concat(F.lit("-/"), c["alt"])).otherwise(F.concat(c["ref"], F.lit("/"), c["alt"]))
    place = F.when(c["start"] == c["end"], c["start"].cast("string")).otherwise(F.concat_ws("-", c["start"].cast("string"), c["end"].cast("string")))
    term = F.coalesce(*[F.when(F.col("class") == k, F.lit(v)) for k, v in CLASSES.items()])
    kept = lambda value: F.when(F.col("dropped").isNull(), value)
    return out.select(
        "row_id", "patient", "chrom", "pos", "ref", "alt", "gene", "transcript", kept(term).alias("consequence"), kept(place).alias("protein_position"), kept(acids).alias("amino_acids"),
        F.lit("PASS").alias("filter"), "class", "dropped",
    )


def _flag(sheet: DataFrame, column: str) -> Column:
    """A secondary readout as text: na without the column, nd where it is not determined."""
    if column not in sheet.columns:
        return F.lit("na")
    value = F.col(f"`{column}`").try_cast("double").cast("int")
    return F.when(value == 1, "positive").when(value == 0, "negative").otherwise("nd")


def assay_labels(sheet: DataFrame, primary: str, secondary: dict[str, str], prefix: str, source: str) -> DataFrame:
    """The rows of an assay sheet as labels: sample_id, peptide, allele, assay, call, notes and ``dropped``.

    ``sheet``: patient (a number, else the row is a heading and goes), gene, change, peptide, allele and
    ``primary``, the readout that gives the call (1 or 0).  ``secondary`` names further readouts,
    which go into the notes only.  ``dropped`` is the first of LABEL_DROPS: no clean
    peptide, no allele, or an undetermined readout.
    """
    text = lambda name: F.trim(F.coalesce(name, F.lit("")))
    number = F.col("patient").try_cast("double").cast("int")
    value = F.col(f"`{primary}`").try_cast("double").cast("int")
    peptide, allele = F.upper(text("peptide")), text("allele")
    call = F.when(value == 1, "positive").when(value == 0, "negative")
    notes = F.concat_ws(
        ";", F.concat(F.lit("gene="), text("gene")), F.concat(F.lit("protein_change="), text("change")), *[F.concat(F.lit(f"{k}="), _flag(sheet, v)) for k, v in secondary.items()], F.lit(f"source={source}")
    )
    return sheet.where(number.isNotNull()).select(
        F.concat(F.lit(prefix), number.cast("string")).alias("sample_id"), peptide.alias("peptide"), F.when(allele.startswith("HLA-") | (allele == ""), allele).otherwise(F.concat(F.lit("HLA-"), allele)).alias("allele"),
        F.lit("ifng_elispot").alias("assay"), call.alias("call"), notes.alias("notes"), _first({"peptide": (peptide == "") | ~is_valid(peptide), "allele": allele == "", "call": call.isNull()}).alias("dropped"),
    )
