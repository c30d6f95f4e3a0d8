"""Hand cases of the functions."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import strings as S
from lexloom.functions import words as W


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("given", "wanted"), [("гI", "гӏ"), ("ГӀ", "Гӏ"), ("х1ара", "хӏара"), ("к1", "к1"), ("ГI", "ГI"), ("х1г1а", "хӏгӏа"), ("", ""), (None, None)])
def test_palochka(spark, given, wanted):
    assert one(spark, S.normalize_palochka(F.col("t")), t=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Назрановцы", "Назран"), ("балкарцы", "балкар")])
def test_society_stem(spark, given, wanted):
    assert one(spark, S.society_stem(F.col("t")), t=given) == wanted


def test_html(spark):
    assert one(spark, S.fix_html(F.col("t")), t="&amp;lt;b&amp;gt; a  b\n&mdash;") == "a b\n—"
    assert one(spark, S.strip_html(F.col("t")), t="<p>a&nbsp;b</p>\n<i>c</i>&lt;") == "a b c <"
    assert one(spark, S.article(F.col("t"))["text"], t="<p>" + "x" * 31 + "</p><p>short</p>") == "x" * 31


def test_entries(spark):
    e = one(spark, S.dash_entry(F.col("t"), F.col("n")), t="сан // син - сад", n="дальше")
    assert (e.word, e.translation) == ("сан", "сад дальше")
    assert one(spark, S.dash_entry(F.col("t"), F.col("n")), t="без знака", n=None) is None
    assert one(spark, S.short_translation(F.col("t")), t="a, " + "b" * 70) == "a"
    s = one(spark, S.split_sides(F.col("t"), "[ыэ]"), t="Аа бб. Это ты. Вв.")
    assert (s.first, s.second) == ("Аа бб.", "Это ты. Вв.")


def test_misc(spark):
    assert one(spark, S.page_ranges(F.col("t")), t="0, 1,5-7,") == [0, 1, 5, 6, 7]
    assert one(spark, S.replace_nth_word(F.col("t"), F.lit(1), F.lit("X")), t=" a  b c") == " a  X c"
    assert one(spark, S.ellipsis(F.col("t"), 3), t="abcd") == "abc…"
    assert [tuple(v) for v in one(spark, S.verses(F.col("t")), t="<sup>1</sup> a <b>b</b><sup>2</sup> <sup>3</sup>c")] == [(1, "a b"), (3, "c")]
    assert one(spark, S.caps_title(F.col("t")), t="\n ПЕРВАЯ ГЛАВА\nтекст") == "ПЕРВАЯ ГЛАВА"
    assert one(spark, S.caps_title(F.col("t")), t="") is None


def test_words(spark):
    assert [tuple(x) for x in one(spark, W.positioned_words(F.col("t")), t="  а б ")] == [(1, "а"), (2, "б")]
    assert one(spark, S.strip_punctuation(F.col("t")), t="а-б, в1") == "абв"
    assert one(spark, W.model_words(F.col("t")), t="А-б- -в г") == ["а-б"]


def test_segments(spark):
    text = "x" * 50 + "\n\n" + "y" * 60 + "\n\n" + "s" * 10
    assert one(spark, W.segments(F.col("t"), 30, 115), t=text) == ["x" * 50 + "\n\n" + "y" * 60]
    assert one(spark, W.segments(F.col("t"), 30, 100), t=text) == ["x" * 50, "y" * 60]
    long = " ".join(["a" * 39 + "."] * 4)
    assert one(spark, W.segments(F.col("t"), 30, 100), t=long) == ["a" * 39 + ". " + "a" * 39 + "."] * 2
    assert one(spark, W.segments(F.col("t"), 30, 100), t="") == []


def test_sentences(spark):
    assert one(spark, W.sentences_joined(F.col("t")), t="Первое предложение тут. Второе предложение\nтут! ГЛАВА") == ["Первое предложение тут", "Второе предложение тут"]
    assert one(spark, W.sentences_kept(F.col("t")), t="Первое предложение. Второе предложение!") == ["Первое предложение.", "Второе предложение!"]
    assert one(spark, W.sentences_by_line(F.col("t")), t="коротко\nДостаточно длинная строка") == ["Достаточно длинная строка"]
