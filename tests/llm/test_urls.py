"""URL rules and models; the whole query is held against SQL by the tests of all queries."""

import pytest
from pyspark.sql import functions as F

from codeloom.llm import url_models
from codeloom.llm.url_queries import RULES

CASES = {
    "http://A.Example.COM/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://example.com/de/": ("example.com", "/de/", "com/", "allow"),
    "http://com/x?y=/en/": ("com", "/x", "com/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "ftp://a.net/es/#x": ("a.net", "/es/", "net/es/", "block"),
    "http://a.net/es": ("a.net", "/es", None, None),
    "http://b.com": ("b.com", "", None, None),
    "http://b.com?x=/y": ("b.com", "", None, None),
    "a.com/en/": ("", "", None, None),
    "": ("", "", None, None),
    "x://y://z/w": ("y:", "//z/w", None, None),
    "://h/p\nq": ("h", "/p\nq", None, None),
}


def test_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(CASES)] + [(99, None), (None, "http://a.net/fr/")], "page_id long, url string")
    rows = {r.page_id: r for r in url_models.judge(df, RULES).collect()}
    assert len(rows) == df.count()
    for i, (host, path, rule, verdict) in enumerate(CASES.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")
    assert (rows[99].host, rows[99].path, rows[99].verdict) == ("", "", "allow") and rows[None].verdict == "block"


@pytest.mark.parametrize("url", ["http://a.com?u=http://b.com/en/", "http://a.com#http://b.com/en/"])
def test_a_later_url_is_no_path(spark, url):
    row = url_models.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), RULES).first()
    assert (row.host, row.path, row.rule, row.verdict) == ("a.com", "", None, "allow")


def test_models_tell_classes_apart(spark):
    good = [f"http://news.example.org/story/{w}" for w in ("harvest", "garden", "history", "gardens", "harbour")] * 3
    bad = [f"http://win.example.org/xxq/zz{w}qz" for w in ("zq", "qq", "zz", "qz", "xq")] * 3
    rules = (url_models.UrlRule("allow", "example.org", "/story/"), url_models.UrlRule("block", "example.org", "/xxq/"))
    new = [(100, "http://news.example.net/story/gardening"), (101, "http://win.example.net/xxq/zzqzzq")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad)] + new + new[:1], "page_id long, url string")
    rows = url_models.judge(df, rules).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == df.count() and got[100].verdict == "allow" and got[101].verdict == "block"
    assert got[100].score > got[101].score and got[100].rule is None


@pytest.mark.parametrize("keep", ["false", "url LIKE '%.com/%'", "url NOT LIKE '%.com/%' AND url NOT LIKE '%.net/%'"])
def test_missing_classes(spark, sf, keep):
    pages = spark.read.parquet(f"{sf}/pages.parquet").filter(keep)
    rows = url_models.judge(pages.withColumn("padded", F.lit(1)).withColumn("total", F.lit(2)), RULES).collect()
    assert len(rows) == pages.count()
    if "NOT" in keep:
        assert {r.verdict for r in rows} == {"allow"}


def test_model_is_bounded_and_probabilities_add_up(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    padded = pages.select(url_models.letters(url_models.host_of(F.col("url")), url_models.path_of(F.col("url"))).alias("padded"))
    rows = url_models.model(padded.withColumn("accepted", F.col("padded").like("%com%"))).collect()
    assert len({r.gram for r in rows}) == len(rows) <= sum(url_models.N_LETTERS ** k for k in range(1, 5))
    assert {len(r.gram) for r in rows} == {1, 2, 3, 4}
