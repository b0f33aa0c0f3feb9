"""Text functions on documented examples and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from sondera.functions import geo
from sondera.functions import text as T


def value(spark, expression, **columns):
    names, row = list(columns), tuple(columns.values())
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in columns.items())
    return spark.createDataFrame([row], schema).select(expression.alias("x")).first()["x"] if names else None


@pytest.mark.parametrize(("given", "wanted"), [("нa изгoтовлeние", "на изготовление"), ("ckидки", "скидки"), ("сhаngаn", "changan"), ("abc", "abc"), ("слово", "слово"), (None, "")])
def test_homoglyphs(spark, given, wanted):
    assert value(spark, T.fix_homoglyphs("s"), s=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("б/у", "бу"), ("ж/д билет", "жд билет"), ("Ёлка-2!", "елка 2"), ("  A  b ", "a b"), ("", ""), (None, "")])
def test_normalize(spark, given, wanted):
    assert value(spark, T.normalize("s"), s=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Привет!!!", "привет!"), ("a  b\tc", "a b c"), ("ура 😀😀 да", "ура да"), (None, "")])
def test_clean(spark, given, wanted):
    assert value(spark, T.clean("s"), s=given) == wanted


def test_filters(spark):
    f = value(spark, T.parse_query_filters("s"), s="Тип услуги Маникюр, педикюр Вид услуги Красота, здоровье")
    assert (f.vid, f.tip, f.tip_auto, f.rating4) == (["Красота, здоровье"], ["Маникюр, педикюр"], [], False)
    f = value(spark, T.parse_query_filters("s"), s="Тип услуги автосервиса Шины Рейтинг пользователя 4 звезды")
    assert (f.vid, f.tip, f.tip_auto, f.rating4) == ([], [], ["Шины"], True)


def test_item_matches(spark):
    df = spark.createDataFrame([([], "x"), (["Красота"], "Вид услуги Красота и"), (["Красота"], "нет")], "v array<string>, p string")
    assert [r[0] for r in df.select(T.item_matches(F.col("v"), "p", "vid")).collect()] == [None, 1.0, 0.0]


def test_params_short(spark):
    got = value(spark, T.params_short("s"), s="Вид услуги Красота Тип услуги Маникюр Место оказания услуг Дом Название услуги стрижка волос Стоимость 100")
    assert got == "вид услуги: красота. тип услуги: маникюр. услуги: стрижка волос"
    assert value(spark, T.params_short("s"), s=None) == ""


def test_char_ngrams(spark):
    assert value(spark, T.char_ngrams(F.col("s"), 2, 3), s="ab") == [" a", "ab", "b ", " ab", "ab "]
    assert value(spark, T.char_ngrams(F.col("s"), 3, 5), s="a") == [" a "]
    assert value(spark, T.char_ngrams(F.col("s"), 2, 3), s="") == []


def test_counts(spark):
    assert value(spark, T.word_count("s"), s=" a  b\nc ") == 3
    assert value(spark, T.emoji_share("s"), s="😀 a b c") == pytest.approx(1 / 5)
    assert value(spark, T.strip("s"), s="\t a b \n") == "a b"
    assert value(spark, T.valid_item_id(F.col("s")), s="0123456789abcdef") is True


def test_haversine(spark):
    km = geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert value(spark, km, a=1.0, b=2.0, c=1.0, d=2.0) == 0.0
    assert value(spark, km, a=0.0, b=0.0, c=0.0, d=180.0) == pytest.approx(6371 * math.pi)
    assert spark.sql("select double(null) a, 0d b, 0d c, 0d d").select(km).first()[0] is None


def test_counted_emoji_are_not_those_that_cleaning_drops(spark):
    rows = [("a \u2b50 b",), ("1\ufe0f\u20e3 b",), ("x \U0001f600\u2600 y",), ("\U0001f004 z",), (None,)]
    got = [r.e for r in spark.createDataFrame(rows, "t string").select(T.emoji_share("t").alias("e")).collect()]
    assert [round(e, 6) for e in got] == [0, 0, 0.5, 0, 0]
