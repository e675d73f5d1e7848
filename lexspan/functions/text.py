"""Column functions that Spark has no builtin for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def nfkc(text: Column) -> Column:
    @pandas_udf("string")
    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))

    return normalise(text)


def title_case(text: Column) -> Column:
    """Each letter that follows no letter in upper case, all others in lower case (``initcap`` splits at white space only)."""
    letters = F.split(F.lower(text), "")
    step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(acc["inside"], c).otherwise(F.upper(c))).alias("out"), c.rlike(r"^\p{L}$").alias("inside"))
    return F.aggregate(letters, F.struct(F.lit("").alias("out"), F.lit(False).alias("inside")), step, lambda acc: acc["out"])


def regex(pattern: str) -> str:
    """A pattern for Java's engine as rules mean it: any case, Unicode classes, and a space for any white space."""
    return "(?iU)" + pattern.replace(" ", r"[\s\x1c-\x1f]+")


def near(a: str, b: str, window: int) -> str:
    """A pattern for both parts with at most ``window`` characters between them, whichever comes first."""
    gap = rf"[\s\S]{{0,{window}}}?"
    return "|".join(f"(?:{first}){gap}(?:{second})" for first, second in ((a, b), (b, a)))


def first_match(text: Column, pattern: str, hit: Column | None = None) -> tuple[Column, Column]:
    """Start (code points) and text of a pattern's first match, which is not empty; null without one.

    ``hit``: whether it matches, where that is known.
    """
    whole = "(?iU)" + pattern.removeprefix("(?iU)")
    hit = text.rlike(whole) if hit is None else hit
    return F.when(hit, F.length(F.split(text, whole, 2)[0]).cast("long")), F.when(hit, F.regexp_extract(text, whole, 0))
