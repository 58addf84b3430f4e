import pytest

from facetry.llm import urlfilter


def brute(url):
    """The longest rule by looking at all of them."""
    host, path = urlfilter.split_url(url)
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


URLS = ["http://a.example.com/en/7x", "http://example.com/en/8", "https://b.example.net/de/81?x", "http://example.net/de/9", "http://EXAMPLE.org/es/", "http://org/es", "http://xcom/en/", "ftp://com/en/#a", "no scheme", "", None, "://com/en/", "http://com", "http://example.com?/en/7", "http://a..example.com/en/70/1"]


@pytest.mark.parametrize("url", URLS)
def test_judge(url):
    assert urlfilter.judge(urlfilter.compile_rules(urlfilter.RULES), *urlfilter.split_url(url)) == brute(url)


def test_frame(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(0, URLS[0], "x")], "page_id long, url string, host string")
    got = urlfilter.filter_urls(pages).collect()
    assert len(got) == len(URLS) + 1
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {k: brute(u) for k, u in enumerate(URLS)}
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_rules_are_bounded():
    with pytest.raises(ValueError):
        urlfilter.compile_rules([("block", "a", "/")] * 3, max_rules=2)
