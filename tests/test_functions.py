import random

import pytest
from pyspark.sql import functions as F

from folia import config
from folia.functions import scripts, text


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return rows.select(column.alias("x")).first().x


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("raw,want", [("  Hello   World  ", "hello world"), ("a\r\nb", "a b"), ("ﬁne ﬂow", "fine flow"), ("a  b", "a b"), ("", "")])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize(F.col("t")), t=raw) == want


def test_bit_parallel_distance():
    r = random.Random(0)
    assert [text.bit_parallel_distance(a, b) for a, b in (("kitten", "sitting"), ("cat", "bat"), ("", "abc"), ("abc", ""), ("", ""))] == [3, 1, 3, 3, 0]
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(40))] for _ in range(2))
        assert text.bit_parallel_distance(a, b) == lev(a, b)


@pytest.mark.parametrize("ref,hyp,wer", [("a b c d", "a x c y", 0.5), ("", "a", None), ("one two three", "one two four", 1 / 3), ("a", "x y z", 3.0)])
def test_word_error_rate(spark, ref, hyp, wer):
    got = one(spark, text.word_error_rate(F.col("r"), F.col("h")), r=ref, h=hyp)
    assert got is None if wer is None else got == pytest.approx(wer)


def test_clamped_keeps_null(spark):
    rows = spark.createDataFrame([(-2.0,), (0.4,), (None,)], "s double").select(text.clamped(F.col("s")).alias("c")).collect()
    assert [r.c for r in rows] == [0.0, 0.4, None]


def test_long_character_distance(spark):
    a, b = "ab" * 400, "ab" * 380 + "xyz"
    assert one(spark, text.char_distance(F.col("a"), F.col("b")), a=a, b=b) == lev(a, b)


@pytest.mark.parametrize("raw,parts", [(r"\frac{a}{b}", "ab"), (r"\sqrt{x}", ["sqrt"]), (r"\alpha + \beta = \gamma", ["alpha", "beta"]), (r"a \times b \div c", [" x ", " / "])])
def test_latex(spark, raw, parts):
    got = one(spark, text.latex_text(F.col("t")), t=raw)
    assert all(p in got for p in parts) and "\\" not in got and "{" not in got


def test_html_and_colors(spark):
    assert one(spark, text.escape_html(F.col("t")), t='<script>alert("x\'")</script>') == "&lt;script&gt;alert(&quot;x&#x27;&quot;)&lt;/script&gt;"
    rows = spark.createDataFrame([(None,), (0,), (0xFF00AA,), (10,)], "c int").select(text.css_color(F.col("c")).alias("x")).collect()
    assert [r.x for r in rows] == ["#000", "#000", "#ff00aa", "#00000a"]


def test_preview_and_fence(spark):
    assert len(one(spark, text.preview(F.col("t"), 100), t="a" * 1000)) == 103 and one(spark, text.preview(F.col("t"), 100), t="ab") == "ab"
    assert one(spark, text.json_from_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'


@pytest.mark.parametrize("raw,sane", [("", False), ("two words", False), ("these are sane words", True), ("a b c d", False), ("!!! ??? ### $$$ %%%", False), ("x" * 90 + " yy zz", False)])
def test_looks_sane(spark, raw, sane):
    assert one(spark, scripts.looks_sane(F.col("t")), t=raw) is sane


def test_regional_text(spark):
    kannada, thai = "ಕನ್ನಡ ಪಠ್ಯ ಇಲ್ಲಿ ಇದೆ", "ภาษา ไทย ครับ มาก"
    assert one(spark, scripts.looks_sane(F.col("t"), F.lit(True)), t=thai) is False and one(spark, scripts.looks_sane(F.col("t"), F.lit(False)), t="hello there my friends") is True
    assert one(spark, scripts.output_valid(F.col("t"), F.lit("kn-IN")), t=kannada) and not one(spark, scripts.output_valid(F.col("t"), F.lit("kn-IN")), t=thai)
    assert one(spark, scripts.output_valid(F.col("t"), F.lit("xx")), t=thai) and not one(spark, scripts.output_valid(F.col("t"), F.lit("kn")), t="  ")
    assert one(spark, scripts.purity(F.col("t")), t="ಕಕ ab 12") == 0.5 and one(spark, scripts.purity(F.col("t")), t="12 ..") == 0.0


def test_script_distribution(spark):
    rows = spark.createDataFrame([(1, "ab 1.ಕ$ด")], "doc_id int, text string")
    got = {r.script: r.n_chars for r in scripts.script_distribution(rows).collect()}
    assert got == {"Latin": 2, "Space": 1, "Digit": 1, "Punct": 1, "Kannada": 1, "Dollar": 1, "Thai": 1}


def test_registered_functions(spark):
    text.register(spark)
    assert spark.sql("SELECT folia_normalize('  A  b ') AS n, folia_cer('abcd', 'abxd') AS c").first() == ("a b", 0.25)


def test_settings(monkeypatch):
    monkeypatch.setenv("N", "99")
    assert config.env_int("N", 4, 1, 32) == 32 and config.env_int("MISSING", 4, 1, 32) == 4
    monkeypatch.setenv("N", "bad")
    assert config.env_int("N", 4, 1, 32) == 4 and config.env_bool("MISSING", True)
    assert config.gate(90, "kannada").min_pass_similarity == 0.35 and config.gate(90).decision_accuracy == 0.9
