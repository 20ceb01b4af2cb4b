"""Word rules that several operators share, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: a blank and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    body = trimmed(text)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, SPACE))).cast("long")


def squeezed(text: Column) -> Column:
    """Each run of ASCII white space as one blank; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(frame: DataFrame) -> Column:
    """A hash of a row's columns, but for those that can't be hashed; it orders rows that are alike."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in frame.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()], F.lit(0))
