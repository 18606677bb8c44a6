from itertools import combinations

import pyarrow.parquet as pq

from linkweave.llm import url_filter as u

from . import helpers


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for text, verdict in u.RULES:
        h, p = text[: text.index("/")], text[text.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(text), text, verdict))
    return host, path, max(fits, default=None)


def test_query_equals_brute_force(spark):
    t = pq.read_table(f"{helpers.SF}/pages.parquet")
    rows = {r.page_id: r for r in u.op6_url_filter(spark, helpers.SF).collect()}
    assert len(rows) == t.num_rows
    for page, url in zip(t["page_id"].to_pylist(), t["url"].to_pylist(), strict=True):
        host, path, best = brute(url)
        r = rows[page]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[2] if best else r.verdict in ("allow", "block")


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "https://example.org", "https://example.org/en/1", "https://x.example.org/en/12/?q=1#f", "ftp://com/de/", "http://my.com?x=/de/", "http://notexample.org/es/", "a://b://c.com/fr/", "http://ÄB.com/fr/é\n/x", "http://org/"]


def test_odd_urls(spark):
    docs = [(i % 5 or None, url, "p", "host") for i, url in enumerate(URLS)]
    df = spark.createDataFrame(docs, "page_id long, url string, path string, tokens string")
    got = sorted(((r.url or "", r.host, r.path, r.rule or "") for r in u.judge(df).collect()))
    want = sorted(((x or "", *brute(x)[:2], (brute(x)[2] or ("", ""))[1]) for x in URLS))
    assert got == want
    assert u.judge(df.limit(0)).count() == 0
    alone = u.judge(spark.createDataFrame([(1, "http://a.net/x"), (1, None)], "page_id long, url string")).collect()
    assert [r.verdict for r in alone] == ["allow", "allow"]


def test_mined_rules_equal_brute_force(spark):
    data = [(["a", "b"], "block")] * 9 + [(["a"], "allow")] * 6 + [(["b", "c"], "block")] * 4 + [(["a", "b", "c"], "allow")] * 1
    n = len(data)
    want = {}
    for size in (1, 2, 3):
        for left in combinations("abc", size):
            for verdict in ("allow", "block"):
                cover = [v for t, v in data if set(left) <= set(t)]
                both = sum(v == verdict for v in cover)
                base = sum(v == verdict for _, v in data) / n
                if both / n >= 0.1 and cover and both / len(cover) >= 0.6 and both / len(cover) / base > 1:
                    want[left, verdict] = (round(both / len(cover), 6), round(both / n, 6))
    rules = u.mine(spark.createDataFrame(data, "tokens array<string>, verdict string"), 0.1, 0.6)
    assert {(tuple(sorted(r.antecedent)), r.verdict): (round(r.confidence, 6), round(r.support, 6)) for r in rules.collect()} == want
    sets = [["a"], ["b"], ["a", "b"], ["a", "b", "c"], ["d"]]
    got = {tuple(r.tokens): (round(r.by.confidence, 6), r.by.verdict) for r in u.matched(spark.createDataFrame([(s,) for s in sets], "tokens array<string>"), rules).collect()}
    for s in sets:
        fits = [(*want[k], -len(k[0]), k[1], k[0]) for k in want if set(k[0]) <= set(s)]
        assert got.get(tuple(s)) == ((max(fits)[0], max(fits)[3]) if fits else None)


def test_method_judges_what_no_rule_fits(spark):
    urls = [f"http://s{i % 7}.com/de/{i}.html" for i in range(60)] + [f"http://s{i % 7}.com/fr/{i}" for i in range(60)] + [f"http://x.net/{p}/{i}{e}" for i in range(5) for p, e in (("de", ".html"), ("fr", ""))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "page_id long, url string")
    for r in u.judge(df).collect():
        if "x.net" in r.url:
            assert r.rule is None and r.verdict == ("block" if "/de/" in r.url else "allow") and r.antecedent
