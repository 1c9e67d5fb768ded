import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.functions import geometry as G
from quillframe.functions import text as T
from quillframe.operators import quality


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_form_sanitiser(spark):
    cases = {
        "10,000": "10000", "8.9": "8.9", "1,234,567,890 and 1,2345": "1234567890 and 1,2345", "2.21×10¹³": "2.21 x 10e3", "5 x 100": "5 x 10e0",
        "3x10^7": "3 x 10e7", "10⁻³": "10", "a <b> – “c”": "a b - \"c\"", "  ": "", "x\r\ny": "x y", "25 °C µl": "25 C ul", "^^": "", "": "",
    }
    assert apply(spark, T.sanitize_form, cases) == list(cases.values())
    assert apply(spark, T.sanitize_form, [None]) == [None]


def test_other_sanitisers(spark):
    assert apply(spark, T.sanitize_line, ["", "a<b>\rc", "10,000"]) == ["_", "a<b> c", "10000"]
    assert apply(spark, T.sanitize_word, ["", "a<b>=c{d}", "50% ×"]) == ["_", "abcd", "50% x"]
    assert apply(spark, T.sanitize_tile, ["", "50% a$"]) == [" ", "50 a"]


def test_split(spark):
    split = lambda c: F.array_join(T.split_chunks(c), "|")
    cases = {
        "short": "short", "a/b": "a/b", "abcdefgh/ijklmnop": "abcdefgh|ijklmnop", "one two three four five six": "one two three four five|six",
        "x" * 50: "x" * 24 + "|" + "x" * 24 + "|xx", "": "", "aaaa bbbb/cccc dddd eeee ffff gggg": "aaaa bbbb|cccc dddd eeee ffff gggg",
    }
    assert apply(spark, split, cases) == list(cases.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab /,.0123456789×¹^<é", max_size=80), min_size=30, max_size=30))
def test_properties(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    c = T.sanitize_form("v")
    out = df.select(c.alias("s"), T.split_chunks(c).alias("p")).collect()
    for r in out:
        assert all(32 <= ord(x) <= 126 for x in r.s) and "  " not in r.s and r.s == r.s.strip()
        assert all(len(x) <= 24 for x in r.p)


def test_round_tenth(spark):
    ys = [0.25, 0.35, 0.05, 0.15, 2.5, 1.45, 0.45, 100.05, 99.95, 0.0, 7.25, 7.75, 12.349999, 0.95, 40.649999999999999]
    df = spark.createDataFrame([(y,) for y in ys], "y double")
    assert [r.o / 10 for r in df.select(G.round_tenth(F.col("y")).alias("o")).collect()] == [round(y, 1) for y in ys]


def test_colours(spark):
    df = spark.createDataFrame([(2450411,), (0,), (8421504,), (None,)], "c int")
    assert [(r.b, r.k) for r in df.select(G.is_blue(F.col("c")).alias("b"), G.is_near_black(F.col("c")).alias("k")).collect()] == [(True, False), (False, True), (False, False), (False, True)]


def test_quality_rules(spark):
    m = spark.createDataFrame([(800, 51200, 160, 8, 160, "10000"), (400, 25600, 800, 100, 790, "abc"), (700, 44800, 1400, 300, 10, "abc"), (100, 6400, 640, 20, 0, "abc"), (100, 6400, 640, 90, 0, "abc")],
                              "w int, n_pixels long, n_ink long, ink_w int, n_left long, text string")
    assert [r.reason.split()[0] for r in quality.judge(m).collect()] == ["near_empty", "left_truncated", "sparse_wide", "too_narrow", "ok"]
    assert quality.judge(m).first().reason == "near_empty dens=0.0031"


@pytest.mark.parametrize("ceiling,text,tokens", [(16, "abc", 64), (256, "a" * 30, 256), (128, "12345", 96), (80, "12345", 80)])
def test_tokens(spark, ceiling, text, tokens):
    df = spark.createDataFrame([(ceiling, text)], "c int, t string")
    assert df.select(quality.first_tokens(F.col("c"), F.col("t"))).first()[0] == tokens
