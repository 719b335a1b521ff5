"""Script analysis: which writing systems a text uses, and whether it looks sane."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..config import EXPECTED_SCRIPT, FOREIGN_SCRIPTS, MALAYALAM
from .text import strip

NBSP_WORDS = r"(?U)\s+"


def _ranges(*ranges: tuple[int, int]) -> str:
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges) + "]"


def looks_sane(text: Column, regional: Column | None = None) -> Column:
    """At least three words of 1.5 to 25 characters on average, two fifths letters, digits or spaces,
    and for regional languages at most 5 % of the letters in foreign scripts."""
    body = strip(text)
    found = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, NBSP_WORDS))
    n = F.size(found)
    mean = F.aggregate(found, F.lit(0), lambda a, w: a + F.length(w)) / n
    plain = F.regexp_count(body, F.lit(r"(?U)[\p{L}\p{N}\s]")) / F.length(body)
    sane = F.when((body == "") | (n < 3), False).otherwise((mean >= 1.5) & (mean <= 25) & (plain >= 0.4))
    if regional is None:
        return F.coalesce(sane, F.lit(False))
    letters = F.regexp_count(body, F.lit(r"\p{L}"))
    foreign = F.regexp_count(body, F.lit(r"(?=\p{L})" + _ranges(*FOREIGN_SCRIPTS.values(), MALAYALAM)))
    return F.coalesce(sane & (~regional | (letters == 0) | (F.try_divide(foreign.cast("double"), letters.cast("double")) <= 0.05)), F.lit(False))


def output_valid(text: Column, language: Column) -> Column:
    """Recognised text of a known language may have 5 % foreign letters at most."""
    body = F.coalesce(strip(text), F.lit(""))
    letters = F.regexp_count(body, F.lit(r"\p{L}"))
    foreign = F.regexp_count(body, F.lit(r"(?=\p{L})" + _ranges(*FOREIGN_SCRIPTS.values())))
    known = F.split(language, "-")[0].isin(*EXPECTED_SCRIPT)
    return (F.when(body == "", False).when(~F.coalesce(known, F.lit(False)), True).when(letters < 5, True)
            .otherwise(F.try_divide(foreign.cast("double"), letters.cast("double")) <= 0.05))


#: Buckets in the order they are tried (fixed values).
BUCKETS = [("Kannada", _ranges(EXPECTED_SCRIPT["kn"])), ("Devanagari", _ranges((0x0900, 0x09FF))), ("Latin", r"(?=\p{L})" + _ranges((0x0000, 0x024F))),
           ("Digit", r"\p{N}"), ("Punct", r"\p{P}"), ("Space", r"(?U)\s")]


@pandas_udf(StringType())
def _name_of(x: pd.Series) -> pd.Series:
    return x.map(lambda c: (unicodedata.name(c, "UNKNOWN").split() or ["UNKNOWN"])[0].title() if c else None)


def script_of(char: Column) -> Column:
    """The bucket of one character; outside the buckets the first word of its Unicode name."""
    known = F.lit(False)
    out = None
    for name, pattern in BUCKETS:
        hit = char.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
        known = known | hit
    return out.otherwise(_name_of(F.when(~known, char)))


def script_distribution(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Characters by script of each key. Each row's characters are counted before the shuffle."""
    chars = rows.select(key, F.explode(F.split(F.col(text), "")).alias("c")).where("c <> ''").groupBy(key, "c").agg(F.count("*").alias("n"))
    return chars.select(key, script_of(F.col("c")).alias("script"), "n").groupBy(key, "script").agg(F.sum("n").alias("n_chars"))


def purity(text: Column, language: str = "kn") -> Column:
    """Share of the language's script in the characters that are no space, number or punctuation."""
    own = F.regexp_count(text, F.lit(_ranges(EXPECTED_SCRIPT[language])))
    all_ = F.regexp_count(text, F.lit(r"(?U)[^\p{Z}\p{N}\p{P}\s]"))
    return F.coalesce(F.try_divide(own.cast("double"), all_.cast("double")), F.lit(0.0))
