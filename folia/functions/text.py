"""Text normalisation, edit distances and small string functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

#: Texts up to this many characters use the built-in distance; longer ones the bit-parallel one.
SHORT_CHARS = 512


def strip(x: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Ligatures written out, white space made single spaces, ends stripped; case stays."""
    return F.trim(F.regexp_replace(F.replace(F.replace(x, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), r"(?U)\s+", " "))


def normalize(x: Column) -> Column:
    return F.lower(squeeze(x))


def words(normalized: Column) -> Column:
    """Words of a normalised text; none of an empty one."""
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def bit_parallel_distance(a, b) -> int:
    """Levenshtein distance of two sequences, one column of the table per big-integer step (Hyyrö)."""
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if m == 0:
        return len(a)
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for x in a:
        eq = at.get(x, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down)
        plus = down | (full & ~(diagonal | up))
        minus = diagonal & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) | 1
        minus <<= 1
        up = full & (minus | ~(diagonal | plus))
        down = plus & diagonal
    return score


def _differing(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Two sequences without their common beginning and end, which cost nothing."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    a, b, n = a[head:], b[head:], n - head
    apart = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(apart[0]) if len(apart) else n
    return a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()


@arrow_udf(LongType())
def _sequence_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Levenshtein distance of arrays. The elements of a batch become numbers of one dictionary, so no
    element is a Python object; null if either array is."""
    known = pc.and_(pc.is_valid(a), pc.is_valid(b)).to_numpy(zero_copy_only=False)
    codes = pc.fill_null(pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    ends = [np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))) for x in (a, b)]
    left, right = codes[: ends[0][-1]], codes[ends[0][-1] :]
    return pa.array([bit_parallel_distance(*_differing(left[ends[0][i] : ends[0][i + 1]], right[ends[1][i] : ends[1][i + 1]])) if known[i] else None for i in range(len(a))], pa.int64())


def char_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in characters."""
    long = (F.length(a) > SHORT_CHARS) & (F.length(b) > SHORT_CHARS)
    far = _sequence_distance(F.when(long & (a != b), F.split(a, "")), F.when(long & (a != b), F.split(b, "")))
    return F.when(a == b, F.lit(0).cast("long")).when(long, far).otherwise(F.levenshtein(a, b).cast("long"))


def short_char_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b)).cast("long")


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in words, of two arrays."""
    same = a == b
    return F.when(same, F.lit(0).cast("long")).otherwise(_sequence_distance(F.when(~same, a), F.when(~same, b)))


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Word distance over the words of the reference; null if it has none. May exceed 1."""
    r, h = words(normalize(ref)), words(normalize(hyp))
    return F.try_divide(word_distance(r, h).cast("double"), F.size(r).cast("double"))


def similarity_ratio(ref: Column, hyp: Column) -> Column:
    """1 - word error rate, not clamped."""
    return 1 - word_error_rate(ref, hyp)


def clamped(similarity: Column) -> Column:
    """At least 0; null stays null."""
    return F.when(similarity.isNotNull(), F.greatest(F.lit(0.0), similarity))


def character_error_rate(ref: Column, hyp: Column) -> Column:
    r, h = normalize(ref), normalize(hyp)
    return F.try_divide(char_distance(r, h).cast("double"), F.length(r).cast("double"))


#: LaTeX commands and what they are read as, in this order (fixed values).
LATEX = [("\\frac", ""), ("\\sqrt", "sqrt"), ("\\times", " x "), ("\\div", " / "), ("\\pm", " +/- "), ("\\leq", " <= "), ("\\geq", " >= "),
         ("\\neq", " != "), ("\\infty", "infinity"), ("\\pi", "pi"), ("\\alpha", "alpha"), ("\\beta", "beta"), ("\\gamma", "gamma"), ("\\theta", "theta"),
         ("\\sum", "SUM"), ("\\int", "INTEGRAL"), ("\\lim", "lim"), ("\\rightarrow", " -> "), ("\\leftarrow", " <- "), ("\\Rightarrow", " => "),
         ("\\cdot", " . "), ("\\ldots", "...")]


def latex_text(x: Column) -> Column:
    for command, plain in LATEX:
        x = F.replace(x, F.lit(command), F.lit(plain))
    return squeeze_spaces(F.regexp_replace(F.regexp_replace(x, r"\\[a-zA-Z]+", ""), r"[{}]", " "))


def squeeze_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def css_color(srgb: Column) -> Column:
    rgb = srgb.bitwiseAND(F.lit(0xFFFFFF))
    return F.when(srgb.isNull() | (srgb == 0), "#000").otherwise(F.concat(F.lit("#"), F.lower(F.lpad(F.hex(rgb.cast("long")), 6, "0"))))


def scaled(v: Column, factor: Column) -> Column:
    return F.round(F.coalesce(v, F.lit(0.0)) * factor, 1)


def escape_html(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def preview(x: Column, chars: int) -> Column:
    return F.concat(F.left(x, F.lit(chars)), F.when(F.length(x) > chars, "...").otherwise(""))


def json_from_fence(x: Column) -> Column:
    """The JSON inside a Markdown code fence, or the text itself."""
    return F.regexp_replace(strip(x), r"(?s)^```(?:json)?\s*|\s*```$", "")


def image_url(doc: Column, page: Column, index: Column, kind: Column) -> Column:
    return F.concat(F.lit("/api/images/"), doc, F.lit("/page_"), page.cast("string"), F.lit("/img_"), index.cast("string"), F.lit("."), kind)


def register(spark: SparkSession) -> None:
    """The metrics as SQL functions of the session."""
    spark.udf.register("folia_sequence_distance", _sequence_distance)
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION folia_normalize(t STRING) RETURNS STRING
      RETURN lower(trim(regexp_replace(replace(replace(t, 'ﬁ', 'fi'), 'ﬂ', 'fl'), r'(?U)\s+', ' ')))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION folia_cer(r STRING, h STRING) RETURNS DOUBLE
      RETURN try_divide(cast(levenshtein(folia_normalize(r), folia_normalize(h)) AS DOUBLE), cast(length(folia_normalize(r)) AS DOUBLE))""")


def json_list(content: Column, item: str) -> Column:
    """A JSON list (``item``: type of its elements), with or without a fence around it; anything else is null."""
    inner = strip(json_from_fence(content))
    # Broken JSON has no outermost array, however much of it could be read.
    return F.when(inner.startswith("[") & F.json_array_length(inner).isNotNull(), F.from_json(inner, f"array<{item}>"))
