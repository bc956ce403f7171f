"""URL filters against a plain search over links, and what pages declare."""

import random
import re

import pytest

from shopfront.llm import url_filter

RULES = [("block", "bad.com", "/"), ("allow", "good.bad.com", "/"), ("block", "x.org", "/ads"), ("allow", "x.org", "/ads/ok"),
         ("block", "tie.org", "/ab"), ("allow", "tie.org", "/ab"), ("block", "deep.a.net", "/"), ("block", "", "/"), ("maybe", "x.org", "/"), ("block", "net.nopath", None)]


@pytest.fixture(scope="module")
def judged(spark):
    rules = url_filter.rules_table(spark, RULES)

    def run(pages, redirects=None, **extra):
        """Extra columns clash with the results' names."""
        spark.conf.set("spark.sql.caseSensitive", "true")
        table = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in pages], "page_id bigint, url string, html string, URL string, host string")
        spark.conf.set("spark.sql.caseSensitive", "false")
        links = None if redirects is None else spark.createDataFrame(redirects, "source string, target string")
        rows = url_filter.judge(table, rules, links).collect()
        assert len(rows) == len(pages)
        return rows

    return run


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    tail = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", tail)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", tail[len(host):])[0]


def own_rule(url):
    host, path = parts(url)
    fit = [(len(h + (p or "")), v == "allow", h + (p or ""), v) for v, h, p in RULES
           if v in ("allow", "block") and h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return (max(fit)[2], max(fit)[3]) if fit else (None, None)


def brute(pages, redirects):
    near = {}
    for a, b in redirects:
        if a and b and "://" in a and "://" in b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for i, url, _ in pages:
        rule, verdict = own_rule(url)
        if verdict is None:
            seen, todo = {url}, [url]
            while todo:
                for other in near.get(todo.pop(), ()):
                    if other not in seen:
                        seen.add(other)
                        todo.append(other)
            said = {own_rule(u)[1] for u in seen}
            verdict = "block" if "block" in said and "allow" not in said else "allow"
        out.append((i, *parts(url), rule, verdict))
    return sorted(out, key=repr)


def test_groups_equal_a_plain_search(judged):
    rng = random.Random(4)
    hosts = ["bad.com", "good.bad.com", "x.org", "WWW.X.org", "tie.org", "a.net", "deep.a.net", "z.deep.a.net", "free.io", "else.io", "xbad.com", "net.nopath"]
    pool = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/ads', '/ads/ok', '/ads?x#y', '/abc', f'/{n}', f'?q={n}', f'#/{n}'])}" for n in range(300)]
    links = [(rng.choice(pool), rng.choice(pool)) for _ in range(110)]
    links += [(pool[n], pool[n + 1]) for n in range(250, 280)]  # a long chain
    links += [("http://hub.io/", u) for u in pool[:40]] + [(None, pool[0]), (pool[1], None), ("nowhere", pool[2]), (pool[3], pool[3])] + links[:5]
    pages = [(n, u, None) for n, u in enumerate(pool)] + [(1, pool[1], "x"), (None, pool[2], "y"), (7, "http://hub.io/", "")]
    assert sorted(map(tuple, judged(pages, links)), key=repr) == brute(pages, links)


def test_an_explicit_allow_stands_and_goes_before_blocks(judged):
    links = [("http://free.io/a", "http://bad.com/a"), ("http://free.io/b", "http://bad.com/b"), ("http://free.io/b", "http://good.bad.com/b")]
    pages = [(1, "http://free.io/a", ""), (2, "http://free.io/b", ""), (3, "http://bad.com/b", ""), (4, "http://good.bad.com/b", ""), (5, "http://free.io/c", "")]
    assert {r.page_id: r.verdict for r in judged(pages, links)} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_declared_links(spark, judged):
    declare = {
        1: '<LINK data-rel="x" href="//bad.com/1" REL="nofollow Canonical">', 2: "<link rel=canonical href=https://bad.com/2>",
        3: "<link href='/ads' rel='canonical'>", 4: '<meta http-equiv="Refresh" content="0; URL=http://bad.com/?a=1&amp;b=2">',
        5: '<!-- <link rel="canonical" href="http://bad.com/"> --><script>"<link rel=canonical href=http://bad.com/>"</script>',
        6: '<link rel="alternate" href="http://bad.com/"><p>canonical</p>', 7: '<link rel="canonical">', 8: '<link rel="canonical" href="mailto:a@b">',
        9: "<meta http-equiv='refresh' content='30'>", 10: "x" * 300_000 + "<link rel=canonical href=http://bad.com/10>", 11: None, 12: "",
    }
    pages = [(n, f"http://free.io/{n}" if n != 3 else "http://x.org/home", html) for n, html in declare.items()]
    got = {r.page_id: r.verdict for r in judged(pages)}
    assert got == {n: "block" if n in (1, 2, 3, 4, 10) else "allow" for n in declare}
    links = url_filter.page_links(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert ("http://free.io/4", "http://bad.com/?a=1&b=2") in [tuple(r) for r in links]


def test_awkward_addresses(judged):
    pages = [(1, None, None), (2, "", ""), (3, "bad.com/x", ""), (4, "://bad.com", ""), (5, "http://", ""), (6, "http://BAD.com", ""), (7, "a://b://bad.com/", ""),
             (8, "http://bad.com:80/", ""), (9, "http://bad.com\n/x", ""), (10, "http://" + "a." * 2000 + "bad.com/", ""), (11, "http://bad.com./", ""), (12, "HTTP://É.BAD.COM/É?É", ""), (13, "http://tie.org/abc", "")]
    assert sorted(map(tuple, judged(pages, [])), key=repr) == brute(pages, [])
    assert judged([], []) == [] and judged([]) == []


def test_usual_redirects(spark):
    page = "<title>An article</title>"
    rows = [("https://www.a.org/en/1.html?utm_source=x", page), ("http://a.org/en/1/#top", page), ("http://m.b.net/en/1?ref=y", page),
            ("http://c.com/en/1", "<title>Another</title>"), ("http://a.org/en/2?page=2&ref=x", page), (None, page), ("nowhere", page)]
    found = {tuple(r) for r in url_filter.usual_redirects(spark.createDataFrame(rows, "url string, html string")).collect() if r[0] != r[1]}
    assert found == {(rows[0][0], "https://a.org/en/1"), (rows[1][0], "https://a.org/en/1"), (rows[2][0], "https://b.net/en/1"),
                     (rows[3][0], "https://c.com/en/1"), (rows[4][0], "https://a.org/en/2?page=2"), ("https://b.net/en/1", "https://a.org/en/1")}
