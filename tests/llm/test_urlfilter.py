from gristmill.llm import urlfilter
from gristmill.llm.queries import URL_RULES

PAGES = "page_id long, url string, host string, labels string, key string"


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:end], rest[end:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def test_verdicts(spark):
    urls = [None, "", "nothing", "http://", "x://A.EXAMPLE.com/en/71?u=/en/", "http://example.com/en/7", "http://notexample.com/en/7", "http://com/en/", "https://a.b.net/de/8", "https://example.net/de/8#x", "http://É.org/es/\n1", "a\nb://x.org/es/", "http://x.org?/es/", "http://.com/en/", "http://u@h.com:80/en/", "http://a.com/EN/", "http://a.com/en//x://b.org/es/", "." * 5000 + "://x", "h://" + "a." * 5000 + "net/de/", "h://a..com/en/"] * 2
    pages = spark.createDataFrame([(i, u, "h", "l", "k") for i, u in enumerate(urls)], PAGES)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(urls)}


def test_many_rules_by_joined_filter(spark, monkeypatch):
    listed = [(f"h{i}.example.com", f"/{i % 7}/", "block") for i in range(300)] + [("example.com", "", "allow"), ("h1.example.com", None, "block")]
    pages = spark.createDataFrame([(i, f"http://w.h{i}.example.com/{i % 5}/x", "", "", "") for i in range(400)], PAGES)
    rules = spark.createDataFrame([*listed, (None, "/x", "block")], "host string, path string, verdict string")
    want = {i: brute(f"http://w.h{i}.example.com/{i % 5}/x", [(h, p or "", v) for h, p, v in listed])[2:] for i in range(400)}
    for words in (urlfilter.LITERAL_WORDS, 1):
        monkeypatch.setattr(urlfilter, "LITERAL_WORDS", words)
        assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()} == want


def test_empty(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/en/", "", "", "")], PAGES)
    assert [(r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()] == [(None, "allow")]
    assert urlfilter.judge(pages.limit(0), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect() == []
