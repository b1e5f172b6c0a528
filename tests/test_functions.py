import pytest
from pyspark.sql import functions as F

from wardlight.functions import prices, text
from wardlight.functions import url as U


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_prices(spark):
    cases = {"$1,299.99": 1299.99, "1,000": 1000, "MYR 1,000.00": 1000, "€1.299,99": 1299.99, "€49,99": 49.99, "1.000": 1000, "10.000": 10000, "£ 1,000": 1000, "1,234,56": 1.234, "": None, "N/A": None, "free": None, "-5": None, "--": None}
    assert column(spark, [*cases, None], prices.parse_price) == [*cases.values(), None]


def test_unrealistic_discount(spark):
    pairs = [[("€1.299,99", "€49,99"), ("€899,00", "€29,99")], [], [("$10", "$0")], [("$100", "$90"), ("$100", "$10")], [("$100", "$90"), ("$100", "$80"), ("$100", "$10")]]
    assert column(spark, pairs, prices.unrealistic_discount, "array<struct<original: string, sale: string>>") == [True, False, False, True, False]


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://WWW.Example.com:8080/a?b#c", "www.example.com"), ("http://user:pw@h.org", "h.org"), ("example.com:8080", ""), ("javascript:go()", ""), ("example.com", None), ("", None), ("https://a_b.example/x", "a_b.example")],
)
def test_host(spark, url, host):
    assert column(spark, [url], U.host) == [host]


def test_resolve(spark):
    base = F.lit("https://h.example/a/b?q=1#x")
    cases = {"/c": "https://h.example/c", "c": "https://h.example/a/c", "?z": "https://h.example/a/b?z", "//o.example": "https://o.example/", "#p": "https://h.example/a/b?q=1#p", "mailto:x@y": "mailto:x@y", "http://k.example": "http://k.example/"}
    assert column(spark, list(cases), lambda c: U.resolve(c, base)) == list(cases.values())


def test_official(spark):
    assert column(spark, ["https://shop.umobile.com/x", "https://umobile.com", "https://myumobile.com", "umobile.com", None], lambda c: U.is_official(c, F.lit("www.umobile.com"))) == [True, True, False, True, False]


def test_brand_tokens(spark):
    values = ["Welcome to UMobile!", "jiuyoumobile", "see umobile.com", "x-umobile-y", None]
    assert column(spark, values, lambda c: text.contains_brand(c, "umobile")) == [True, False, False, True, False]
    assert column(spark, values, lambda c: text.contains_brand(c, F.lit("umobile"))) == [True, False, False, True, False]
    assert column(spark, ["a"], lambda c: text.contains_brand(c, F.lit(" "))) == [False]


def test_collapse(spark):
    assert column(spark, ["  a \n b\t", None], text.collapse) == ["a b", ""]
