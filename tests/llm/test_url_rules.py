import re
from itertools import combinations

from helpers_llm import folder
from pyspark.sql import functions as F

from barlake.llm import queries, url_rules

FIXED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def fixed_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in FIXED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def judged(spark, pages, labels, **more):
    pages = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS verdict", "'t' AS tokens")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return url_rules.judge_urls(pages, labels, folder(spark), **more).collect()


def test_hosts_paths_and_fixed_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/?q=1#x", "http://net/", "http://net", "x://y://z.org/fr/a://b"]
    urls += ["https://www.example.com/de/1", "http://example.com/de", "http://notnet.org/fr/x", "http://ÄB.org?x/fr/", "h://a.net#/", "://", "http://a.net/\nb?c"]
    urls += ["http://example.net/en/" + "a" * 100_000, "http://net.example.org/fr/"]
    got = {r.page_id: r for r in judged(spark, list(enumerate(urls)), [])}
    for k, url in enumerate(urls):
        host, path = host_and_path(url)
        rule, verdict = fixed_rule(host, path)
        r = got[k]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), url
    assert judged(spark, [], []) == []


def brute_verdicts(spark, pages, labels, settings):
    """(page_id, url) -> verdict: every page is checked against all combinations of tokens that examples support, one by one."""
    rows = url_rules.split_urls(spark.createDataFrame(pages, "page_id long, url string"))
    columns = rows.select("url", url_rules.tokens_of(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")).alias("t"))
    tokens = {r.url: frozenset(r.t) for r in columns.collect()}
    told = {}
    for i, quality, toxic in labels:
        if i is not None:
            told[i] = told.get(i, False) or quality is None or quality == 0 or toxic == 1
    fixed = {u: fixed_rule(*host_and_path(u))[1] for _, u in pages}
    examples = [(tokens[u], fixed[u] == "block" or told.get(i, False)) for i, u in pages if fixed[u] or i in told]
    bad = sum(b for _, b in examples)
    support, confidence = max(settings.support, settings.rows / len(examples)) * len(examples), settings.confidence(bad / len(examples))
    hits = {}
    for own, is_bad in examples:
        for size in range(1, len(own) + 1):
            for rule in combinations(sorted(own), size):
                n, b = hits.get(rule, (0, 0))
                hits[rule] = n + 1, b + is_bad
    rules = {rule for rule, (n, b) in hits.items() if b >= support and b >= confidence * n}

    def matched(own):
        return any(rule in rules for size in range(1, len(own) + 1) for rule in combinations(sorted(own), size))

    return {(i, u): fixed[u] or ("block" if matched(tokens[u]) else "allow") for i, u in pages}, rules


def test_mined_rules_against_counts(spark):
    pages = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}-{'a' if i % 2 else 'b'}.org/{'x' if i % 5 else 'y'}/{i}") for i in range(120)]
    pages += [(None, "http://www.spam-a.org/q/7"), (500, "http://other.org/"), (0, pages[0][1])]
    labels = [(i, int(i % 3 != 0 or i % 30 == 0), 0) for i in range(100)] + [(3, 1, None), (None, 0, 0)]
    settings = url_rules.Settings(support=0.05, rows=5, gain=0.55)
    wanted, rules = brute_verdicts(spark, pages, labels, settings)
    got = judged(spark, pages, labels, settings=settings)
    verdicts = {(r.page_id, r.host + r.path): r.verdict for r in got}
    for (i, url), verdict in wanted.items():
        assert verdicts[i, "".join(host_and_path(url))] == verdict, url
    assert {r.verdict for r in got} == {"allow", "block"} and len(got) == len(pages)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_url_rules(spark, sf).collect()
    urls = {r.page_id: r.url for r in queries.table(spark, sf, "pages").collect()}
    labels = [(r.doc_id, r.quality, r.toxic) for r in queries.table(spark, sf, "labels").collect()]
    wanted, rules = brute_verdicts(spark, list(urls.items()), labels, url_rules.Settings())
    assert len(got) == len(urls) and rules
    for r in got:
        assert (r.host, r.path) == host_and_path(urls[r.page_id])
        assert r.rule == fixed_rule(r.host, r.path)[0]
        assert r.verdict == wanted[r.page_id, urls[r.page_id]]
        assert r.rule is not None or (r.confidence is not None) == (r.verdict == "block")
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
