"""Submitted answers: JSON whose shape differs from file to file, with side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def read_submissions(spark: SparkSession, path: str, answer: str = "submission.json", side: str = "leaked_pairs.csv") -> DataFrame:
    """(submission, answer, side): one row per folder below ``path``, with the texts of its two files; null where one is missing.

    Each file is one row, as they are small and many.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    named = files.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("submission"), F.substring_index("file", "/", -1).alias("name"), "value")
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return named.where(F.col("name").isin(answer, side)).groupBy("submission").agg(of(answer).alias("answer"), of(side).alias("side"))


def _kind(value: Column) -> Column:
    """ARRAY, OBJECT, STRING and so on; it takes all parts of a value, so only texts are asked for it."""
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def _text(item: Column) -> Column:
    """The string that a variant is; null for anything else."""
    return F.when(_kind(item) == "STRING", item.try_cast("string"))


def _pairs(raw: Column) -> Column:
    """Pairs in canonical spelling from raw ones; null for those of which both cannot be read."""
    read = F.transform(raw, lambda c: F.struct(names.normalize_peptide(c["peptide"]).alias("peptide"), names.normalize_panel_allele(c["allele"]).alias("allele")))
    return F.transform(read, lambda c: F.when(c["peptide"].isNotNull() & c["allele"].isNotNull(), c))


def parsed(submissions: DataFrame) -> DataFrame:
    """Adds ``json``, the answer as a variant, and ``valid``: whether it is a JSON object."""
    # A text that could be read is an object if it begins with a brace; no part of it is asked for its kind.
    rows = submissions.withColumn("json", F.try_parse_json("answer"))
    return rows.withColumn("valid", F.coalesce(F.col("json").isNotNull() & F.col("answer").rlike(r"^[ \t\r\n]*\{"), F.lit(False)))


def side_rows(text: Column) -> Column:
    """Pairs of the first two cells of each line; the first line is left out unless its first cell is all letters, as are shorter lines."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x != "")
    bare = lambda c: F.regexp_replace(c, '^"|"$', "")
    # What stands behind the second comma is not cut further.
    cells = F.transform(lines, lambda x: F.split(x, ",", 3))
    kept = F.filter(cells, lambda c, i: (F.size(c) >= 2) & ((i > 0) | F.trim(bare(c[0])).rlike(r"^\p{L}+$")))
    return F.transform(kept, lambda c: F.struct(bare(c[0]).alias("peptide"), bare(c[1]).alias("allele")))


def submitted_pairs(submissions: DataFrame, field: str = "leaked_pairs") -> DataFrame:
    """(submission, valid, listed, stated, malformed, pairs) of each submission, one row each.

    The field is a list whose items are lists (peptide, allele, ...) or objects with
    peptide and mhc_allele; where it is null or absent the side file counts.  ``listed``
    tells whether there is a list at all, ``stated`` counts its items, ``malformed`` those that are
    no readable pair, and ``pairs`` has the distinct readable ones in canonical spelling,
    sorted.  Answers that are no JSON object are not valid and have none.
    """
    # The list is read as objects and as lists at once: an item that is neither is null in both, as is what is no list.
    objects, lists = (F.try_variant_get("json", f"$.{field}", f"array<{kind}>") for kind in ("struct<peptide: variant, mhc_allele: variant>", "array<variant>"))
    rows = parsed(submissions).withColumns({"_objects": objects, "_lists": lists})
    value = F.try_variant_get("json", f"$.{field}", "variant")
    absent = F.col("valid") & F.col("_objects").isNull() & (value.isNull() | F.is_variant_null(value))

    def texts(item: Column, i: Column) -> Column:
        at = lambda k: F.get(F.get("_lists", i), F.lit(k))
        return F.struct(_text(F.coalesce(item["peptide"], at(0))).alias("peptide"), _text(F.coalesce(item["mhc_allele"], at(1))).alias("allele"))

    rows = rows.withColumn("_raw", F.when(absent, side_rows(F.col("side"))).when(F.col("valid"), F.transform("_objects", texts)))
    out = rows.withColumn("_found", _pairs(F.col("_raw")))
    out = out.withColumn("_good", F.filter("_found", lambda p: p.isNotNull()))
    return out.select(
        "submission", "valid", F.col("_found").isNotNull().alias("listed"), F.coalesce(F.size("_found"), F.lit(0)).alias("stated"),
        F.coalesce(F.size("_found") - F.size("_good"), F.lit(0)).alias("malformed"), F.coalesce(F.sort_array(F.array_distinct("_good")), F.array()).alias("pairs"),
    )
