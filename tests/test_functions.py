"""Slugs, guarded arithmetic and token flags."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions import text as t

SLUGS = [
    ("https://www.news.example/world/gulf/port-strike-hits-lng-2026-03-18/", "port strike hits lng"),
    ("https://example.com/some/Article-Title.HTML", "Article Title"),
    ("https://example.com/some/article_title.php?x=1#top", "article title"),
    ("https://example.com/a/abc123def", "abc123def"),
    ("https://example.com/", ""),
    ("https://example.com", ""),
    ("", ""),
    (None, ""),
    ("not-a-url", "not a url"),
    ("https://example.com/caf%C3%A9-price%20rise", "café price rise"),
    ("https://example.com/50%-off-oil", "50% off oil"),
    ("https://example.com/c++-news", "c++ news"),
    ("https://example.com/a/oil-news;jsessionid=4", "oil news"),
    ("https://example.com/a;v=1/", "a;v="),
    ("https://example.com/news/;x", "news"),
    ("//host/path/gas-report.aspx", "gas report"),
    ("https://example.com/x/12-31-2026-day-07", "day"),
    ("https://example.com/two words", "two words"),
]


def test_slug_of_a_broken_host(spark):
    urls = ["http://[::1/foo-bar-baz", "http://[::1]/foo-bar-baz", "//e.com/foo-bar", "/foo_bar?q=/x"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r.s for r in frame.select(t.slug("url").alias("s")).collect()]
    assert got == ["", "foo bar baz", "foo bar", "foo bar"]


def test_slugs(spark):
    frame = spark.createDataFrame(SLUGS, "url string, want string")
    rows = frame.select("url", "want", t.slug("url").alias("got")).collect()
    wrong = [(r.url, r.want, r.got) for r in rows if r.got != r.want]
    assert wrong == []


def test_division_by_zero_gives_null(spark):
    row = spark.range(1).select(
        c.pct_move(F.lit(0.0), F.lit(5.0)).alias("a"),
        c.guarded_ratio(F.lit(1), F.lit(0)).alias("b"),
        c.pct_move(F.lit(50.0), F.lit(55.0)).alias("c"),
    ).first()
    assert row.a is None and row.b is None and row.c == pytest.approx(10.0)


def test_constant_series_has_no_correlation(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert frame.agg(c.guarded_corr("x", "y").alias("r")).first().r is None


def test_one_sided_mean_counts_missing_as_zero(spark):
    frame = spark.createDataFrame([(-3.0,), (1.0,), (None,)], "x double")
    row = frame.agg(c.one_sided("x", "negative").alias("n"), c.one_sided("x", "positive").alias("p")).first()
    assert row.n == pytest.approx(-1.0) and row.p == pytest.approx(1 / 3)


def test_large_values_stay(spark):
    values = [1e29, -1e29, 1e308, 0.125, float("nan"), float("inf"), None]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.y for r in frame.select(c.round_half_up("x", 2).alias("y")).collect()]
    assert got == [1e29, -1e29, 1e308, 0.13, None, None, None]


def test_rounding_modes(spark):
    row = spark.range(1).select(
        c.round_half_up(F.lit(0.15), 1).alias("up"), c.round_half_even(F.lit(6.25), 1).alias("even")
    ).first()
    assert row.up == 0.2 and row.even == 6.2


def test_exact_tokens_do_not_count_prefixes(spark):
    frame = spark.createDataFrame([("ECON_OILEXPORT;X",), ("ECON_OIL",), (None,)], "v string")
    row = frame.agg(
        F.sum(t.contains_flag("v", "ECON_OIL")).alias("sub"),
        F.sum(t.exact_token_flag("v", "ECON_OIL")).alias("exact"),
    ).first()
    assert (row.sub, row.exact) == (2, 1)


def test_keyed_values_take_the_first_hit(spark):
    frame = spark.createDataFrame([("c2.21:4,c2.1:-7.5,c2.21:9,v10.1.1:1.2.3",)], "v string")
    keys, values = t.keyed_values("v", ["c2.1", "c2.21", "v10.1.1", "c3.2"])
    row = frame.select(*[t.first_value(keys, values, k).alias(k.replace(".", "_")) for k in ("c2.1", "c2.21", "v10.1.1", "c3.2")]).first()
    assert tuple(row) == (-7.5, 4.0, None, None)
