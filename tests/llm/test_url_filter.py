import pytest

from helixframe.llm import url_filter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


@pytest.fixture
def pages(spark):
    urls = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "http://x.net/es/3", "http://com", "ftp://bad.org/5", "http://good.org/6#t", None, "", "no scheme", "http://h?q=/en/", "http://bad.org/5"]
    return spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id long, url string, host string")


def test_rules_and_parts(spark, pages):
    labels = spark.createDataFrame([(5, 0, 0)] * 3 + [(6, 1, 0), (7, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, labels, RULES).collect()}
    assert len(got) == 11
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (got[1]["rule"], got[1]["verdict"]) == ("www.example.com/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/es/", "block")
    assert got[3]["path"] == "" and got[3]["rule"] is None
    assert (got[9]["host"], got[9]["path"]) == ("h", "")
    for k in (6, 7, 8):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == ("", "", None)
    assert got[4]["verdict"] == got[10]["verdict"] and {r["verdict"] for r in got.values()} <= {"allow", "block"}


def test_shrinkage(spark):
    counts = spark.createDataFrame([("a.one.org", 200, 190), ("b.one.org", 200, 10), ("c.two.net", 300, 290), ("d.two.net", 2, 0)], "host string, n long, good long")
    hosts = spark.createDataFrame([(h,) for h in ("a.one.org", "b.one.org", "c.two.net", "d.two.net", "new.two.net", "x.co.uk")], "host string")
    r = {x["host"]: x for x in url_filter.host_reputation(counts, hosts).collect()}
    assert r["a.one.org"]["verdict"] == "allow" and r["b.one.org"]["verdict"] == "block"
    # Two bad pages say little against a good domain; unseen hosts take the domain's mean with a wide bound.
    assert 0 < r["d.two.net"]["mean"] and r["d.two.net"]["mean"] > 2 / 200
    assert r["new.two.net"]["lower"] < r["c.two.net"]["lower"]
    assert r["x.co.uk"]["domain"] == "x.co.uk" and r["x.co.uk"]["suffix"] == "co.uk"


def test_without_labels_or_pages(spark, pages):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filter.filter_urls(pages, none, []).count() == 11
    assert url_filter.filter_urls(pages.limit(0), none, RULES).count() == 0
    assert "Python" not in url_filter.filter_urls(pages, none, RULES)._jdf.queryExecution().toString()
