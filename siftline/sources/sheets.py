"""Sheets exported as text: headings over one or more lines, names that repeat."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SchemaError


def merged_names(headings: list[list[str]]) -> dict[str, int]:
    """Column names and their places: from left to right, at each place the lowest line first; the first of a repeated name counts."""
    out: dict[str, int] = {}
    for at in range(max(map(len, headings), default=0)):
        for line in reversed(headings):
            name = line[at].strip() if at < len(line) else ""
            if name:
                out.setdefault(name, at)
    return out


def read_sheet(spark: SparkSession, path: str, columns: dict[str, str], skip: int = 2, heading_lines: int = 1, sep: str = "\t", optional: tuple[str, ...] = ()) -> DataFrame:
    """The columns of one sheet as text: ``columns`` maps our names to those of the sheet, ``optional`` ones may be missing.

    The first ``skip`` lines are titles, the next ``heading_lines`` name the columns.  They come
    back as rows too, as a file is read in parts: tell rows by a column that must be a
    number.  Adds row_id, unique within the sheet.  A line never holds a cell's line break.
    """
    top = list(csv.reader([r.value for r in spark.read.text(path).head(skip + heading_lines)], delimiter=sep))
    places = merged_names(top[skip:])
    missing = [c for own, c in columns.items() if c not in places and own not in optional]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    width = max(map(len, top))
    raw = spark.read.csv(path, sep=sep, schema=", ".join(f"c{i} string" for i in range(width)), enforceSchema=True)
    return raw.select(F.monotonically_increasing_id().alias("row_id"), *[F.col(f"c{places[c]}").alias(own) for own, c in columns.items() if c in places])
