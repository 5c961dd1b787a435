import unicodedata

import pytest
from pyspark.sql import functions as F

from purselight.functions import dates, numbers, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_boilerplate(spark):
    rows = [("Клиент часто",), ("клиент часто",), ("Клиенты тратят",), ("transactions",), (None,), ("Все транзакции  и транзакция\u00a0",)]
    assert [x for (x,) in values(spark, rows, "t string", text.clean_claim(F.col("t")))] == ["часто", "часто", "Клиенты тратят", "", None, "и"]


def test_boxed(spark):
    rows = [(r"a \boxed{x} b \boxed{отток }",), ("none",), (None,), ("\\boxed{a\nb}",)]
    assert [x for (x,) in values(spark, rows, "t string", text.boxed(F.col("t")))] == ["отток", None, None, "a\nb"]


def test_labels(spark):
    ages = {"0": "до 18", "1": "18-25", "2": "26-45", "3": "46+"}
    rows = [("18-25",), ("46+",), ("неактивный",), ("не отток",), (None,), ("«лояльный»",), (" Активный_Клиент. ",), ("ＣＨＵＲＮ",), ("2",), ("x",)]
    assert [x for (x,) in values(spark, rows, "t string", text.label_of(F.col("t"), ages))] == [None, 3, 0, 1, None, 0, 0, 1, 2, None]
    assert values(spark, [("18-25",)], "t string", text.label_of(F.col("t"), ages, fix_hyphen=True)) == [(1,)]
    assert unicodedata.normalize("NFKC", "ＣＨＵＲＮ") == "CHURN"


def test_json_lists(spark):
    rows = [('x ["a"] y ["b"," c ", "", 5]',), ("[bad",), ("",), (None,), ('[["a"], "b"]',), ("[1] {}",)]
    assert [x for (x,) in values(spark, rows, "t string", text.claims_of(F.col("t")))] == [["b", "c", "5"], [], [], [], ['["a"]', "b"], ["1"]]


def test_names(spark):
    rows = [("Ёлка, чай/кофе",), ("--",), ("a" * 99,)]
    assert values(spark, rows, "t string", text.short_name(F.col("t")), text.safe_name(F.col("t"))) == [("Ёлка_чай_кофе", "лка_чай_кофе"), ("--", "unknown"), ("a" * 80, "a" * 80)]


def test_fill_keeps_other_braces(spark):
    got = values(spark, [("v{B}",)], "a string", text.fill(F.lit(r"{A} \boxed{отток} {B}"), A=F.col("a"), B=F.lit("w")))
    assert got == [(r"vw \boxed{отток} w",)]


def test_gender_and_lines(spark):
    assert values(spark, [("M",), ("ж.",), ("x",)], "t string", text.gender(F.col("t"))) == [("мужчина",), ("женщина",), (None,)]
    assert values(spark, [("a\nb",), ("abcdef",)], "t string", text.one_line(F.col("t"), 4)) == [("a\\nb",), ("abcd...",)]


def test_numbers(spark):
    rows = [(2.0,), (2.5004,), (0.0,), (None,), (float("nan"),), (-1234567.8912,)]
    assert [x for (x,) in values(spark, rows, "v double", numbers.as_text(F.col("v")))] == ["2.0", "2.5", "0.0", "нет данных", "нет данных", "-1234567.891"]
    assert values(spark, [("1.5",), ("x",), (None,)], "t string", numbers.number(F.col("t"))) == [(1.5,), (0.0,), (0.0,)]
    assert values(spark, [(1, 0)], "a int, b int", numbers.share(F.col("a"), F.col("b"))) == [(0.0,)]


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])]
    got = values(spark, rows, "a array<double>, b array<double>", numbers.cosine_distance(F.col("a"), F.col("b")), numbers.unit(F.col("a")), numbers.argmax(F.col("a")))
    assert got[0][0] == pytest.approx(1 - 24 / 25) and got[0][1] == pytest.approx([0.6, 0.8]) and got[0][2] == 1
    assert got[1] == (1.0, [0.0, 0.0], 0)
    ((p,),) = values(spark, [([1.0, 3.0],)], "a array<double>", numbers.softmax(F.col("a")))
    assert sum(p) == pytest.approx(1) and p[1] > p[0]


def test_dates(spark):
    rows = [("21OCT17:13:08:28",), ("bad",), ("21XXX17:13:08:28",), ("2017-10-21 01:02:03",), (None,)]
    got = values(spark, rows, "t string", F.date_format(dates.parse_churn(F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    assert [x for (x,) in got] == ["2017-10-21 13:08:28", None, "2017-01-21 13:08:28", "2017-10-21 01:02:03", None]
    rows = [("1999-12-31 23:00:00",), ("2024-01-07 05:59:59",), (None,)]
    ts = dates.parse(F.col("t"))
    got = values(spark, rows, "t string", dates.day_number(ts), dates.hour(ts), dates.weekday(ts), dates.weekday_name(dates.weekday(ts)), dates.period_of_day(dates.hour(ts)))
    assert got == [(-1, 23, 4, "Пт", "вечер"), (8772, 5, 6, "Вс", "ночь"), (0, 0, 0, "Пн", "ночь")]
