from pyspark.sql import functions as F

from mapweave.functions import urls


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalized_url(spark):
    assert one(spark, urls.normalize_url(F.lit("HTTPS://Ex.com/A/?q=1#f"))) == "https://ex.com/A?q=1"
    assert one(spark, urls.normalize_url(F.lit("http://ex.com///"))) == "http://ex.com"


def test_domain_variants(spark):
    assert one(spark, urls.netloc(F.lit("https://me@ex.com:81/x"))) == "me@ex.com:81"
    assert one(spark, urls.netloc(F.lit("not a url"))) == ""
    assert one(spark, urls.domain_or_first_segment(F.lit("ex.com/a/b"))) == "ex.com"


def test_spheres(spark):
    cases = {
        "https://www.bloomberg.com/x": ("news", 0.90, "domain_list"),
        "https://who.int": ("government", 0.90, "domain_list"),
        "https://dailyresearch.com": ("academia", 0.60, "pattern"),
        "https://cs.mit.edu/": ("academia", 0.95, "tld"),
        "https://x.gov/": ("government", 0.95, "tld"),
        "https://blog.greenpeace.org/": ("activist", 0.85, "domain_list"),
        "https://notun.org/": ("general", 0.30, "default"),
        "https://oecd.org/": ("international", 0.90, "domain_list"),
        "https://shop.com/": ("general", 0.30, "default"),
    }
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    got = {r["url"]: (r["sphere"], r["confidence"], r["method"]) for r in urls.classify_spheres(df).collect()}
    assert got.pop(None) == ("unknown", 0.0, "error")
    assert got == cases


def test_lists_and_suffixes(spark):
    hosts = spark.createDataFrame([("www.Bad.com",), ("a.example.com",), ("example.com",), ("x.dk",)], "d string")
    rows = hosts.select(
        urls.is_blacklisted("d", ["bad.com"]).alias("black"),
        urls.is_whitelisted("d", ["*.example.com", "x.dk"]).alias("white"),
        urls.is_excluded("d", ["example.com"]).alias("out"),
        urls.matches_tld("d", [".DK"]).alias("tld"),
    ).collect()
    assert [r["black"] for r in rows] == [True, False, False, False]
    assert [r["white"] for r in rows] == [False, True, False, True]
    assert [r["out"] for r in rows] == [False, True, True, False]
    assert [r["tld"] for r in rows] == [False, False, False, True]


def test_same_domain_and_terms(spark):
    links = F.array(*[F.lit(x) for x in (
        "https://example.com/1", "https://EXAMPLE.com/2", "https://other.com/", "https://subdomain.example.com/")])
    assert one(spark, urls.same_domain_links(links, F.lit("https://example.com"))) == [
        "https://example.com/1", "https://EXAMPLE.com/2"]
    assert one(spark, urls.url_terms(F.lit("https://e.com/Climate-change/a_report/x/"))) == ["climate", "change", "report"]
    assert one(spark, urls.sanitize_node_id(F.lit("a b/c:d?e&f=g"))) == "a_b_c_d_e_f_g"
