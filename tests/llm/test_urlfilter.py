import re

import numpy as np

from conftest import SF001
from docspark.llm import queries, urlfilter

RULES = queries.URL_RULES
SCHEMA = "page_id long, url string, html string, host string, rule int, src string"


def split(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule_of(host, path):
    fit = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: x[0])[1:] if fit else (None, None)


def brute(pages, rounds=400, damping=0.85):
    pages = [(i, *split(u), h or "") for i, u, h in pages]
    edges = {}
    for _, src, _, html in pages:
        for u in re.findall(urlfilter._HREF, html):
            dst = split("http:" + u if u.startswith("//") else u)[0]
            if src and dst and src != dst:
                edges[src, dst] = edges.get((src, dst), 0) + 1
    ties = set()
    for _, h, _, _ in pages:
        labels = h.split(".")
        chain = [".".join(labels[k:]) for k in range(len(labels)) if len(labels) - k >= 2]
        ties |= {x for a, b in zip(chain, chain[1:]) for x in ((a, b), (b, a))}
    for e in ties:
        edges[e] = edges.get(e, 0) + 1
    nodes = sorted({n for e in edges for n in e} | {p[1] for p in pages})
    at = {n: k for k, n in enumerate(nodes)}
    good, bad = np.zeros(len(nodes)), np.zeros(len(nodes))
    for _, h, p, _ in pages:
        action = rule_of(h, p)[1]
        good[at[h]] += action == "allow"
        bad[at[h]] += action == "block"
    way = np.zeros((len(nodes), len(nodes)))
    for (a, b), n in edges.items():
        way[at[a], at[b]] = n
    def rank(m, s):
        s = s / s.sum() if s.sum() else s
        m = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        r = s
        for _ in range(rounds):
            r = damping * (r @ m) + (1 - damping) * s
        return r
    trust, distrust = rank(way, good), rank(way.T, bad)
    out = {}
    for i, h, p, _ in pages:
        rule, action = rule_of(h, p)
        t, d = (trust[at[h]], distrust[at[h]]) if h else (0, 0)
        out[i] = (h, p, rule, action or ("block" if t + d > 0 and round(d / (t + d), 9) > 0.5 else "allow"), t, d)
    return out


def cases():
    return [
        (1, "http://Example.COM/en/x?q#f", None), (2, "https://www.example.com/en/", '<a href="http://bad.net/es/1">x</a>'),
        (3, "http://good.org/a", '<a class="c" href=\'https://bad.net/z\'>x</a><a href=//friend.org>y</a>'),
        (4, "http://bad.net/es/a", ""), (5, "http://bad.net/de/a", "<a href=/local>"), (6, "http://friend.org/", '<A HREF="http://www.example.com/">'),
        (7, None, None), (8, "no scheme/net/es/", None), (9, "x://", None), (10, "http://com", None), (11, "http://com/", None), (12, "http://notcom/", None),
        (13, "http://a.b.c.example.com/en/1", None), (14, "ftp://h.net?x=/es/", None), (15, "http://u.net/es/://w.com/", None), (16, "http://ÀÉ.Com/é", None),
        (17, "http://sub.good.org/x", None), (18, "http://lonely.test/", None), (19, "http://", None), (20, "http:///en/", None), (21, "", None)]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in cases()], SCHEMA)
    want = brute(cases())
    got = {r.page_id: r for r in urlfilter.judge_urls(df, RULES).collect()}
    assert set(got) == set(want)
    for i, (h, p, rule, verdict, t, d) in want.items():
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, rule, verdict), (i, tuple(r))
        assert abs(r.distrust / ((r.trust + r.distrust) or 1) - d / ((t + d) or 1)) < 1e-3
        assert abs(r.trust - t) < 0.02 and abs(r.distrust - d) < 0.02
    assert {w[3] for w in want.values() if w[2] is None} == {"allow", "block"}


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in [(1, "http://a.com/", None)] * 3 + [(None, "http://a.net/es/", None)]], SCHEMA)
    assert sorted((str(r.page_id), r.verdict) for r in urlfilter.judge_urls(df, RULES).collect()) == [("1", "allow")] * 3 + [("None", "block")]
    assert urlfilter.judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(df, []).collect()} == {"allow"}


def test_query_on_a_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()]
    want = brute(rows)
    got = queries.QUERIES["op7_url_filter"](spark, SF001).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id][:4]


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    """However many links lie between: there is no number of rounds that cuts it off."""
    n = 30
    rows = [(i, f"http://h{i:02d}.x{i}/", f'<a href="http://h{i + 1:02d}.x{i + 1}/">n</a>' if i + 1 < n else "") for i in range(n)]
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)
    got = {r.page_id: r for r in urlfilter.judge_urls(df, [("block", f"x{n - 1}", "/")]).collect()}
    assert {r.verdict for r in got.values()} == {"block"} and all(r.distrust > 0 for r in got.values())
    assert all(got[i].distrust < got[i + 1].distrust for i in range(n - 1))
