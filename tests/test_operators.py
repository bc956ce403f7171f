import urllib.robotparser

import pytest

from shopfront.functions import crawl, fixed, robots, sitemaps
from shopfront.operators import crawl_plan as plans
from shopfront.operators import site_pages
from pyspark.sql import functions as F

from shopfront.operators import rule_index
from shopfront.operators.lookup import frequent, hot_keys, lookup
from shopfront.staging import lay_out
from shopfront.plans.lead_audit import audit_leads, write_audited
from shopfront.sources import fetches as log
from shopfront.sources.fetches import FETCH_SCHEMA

ROBOTS = [
    "",
    "User-agent: *\nDisallow: /",
    "User-agent: *\r\nDisallow:\r\n",
    "# c\nuser-agent : Shop  # us\nDISALLOW: /a # x\nAllow: /\n\nUser-agent: *\nDisallow: /b",
    "User-agent: *\nDisallow: /b\nUser-agent: front\nUser-agent: other\nAllow: /b/ok\nDisallow: /b",
    "User-agent: shopfront\n\nDisallow: /a\n",
    "Disallow: /a\nUser-agent: *\n \nDisallow: /b\n",
    "User-agent: *\nCrawl-delay: 5\nDisallow: /a%20b\nSitemap: x\nDisallow: /q?x=1\n",
    "User-agent: *\nAllow: /a/ok\nDisallow: /a\nDisallow: *\nDisallow: /$\n",
    "User-agent: *\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /\n",
    "User-agent:\nDisallow: /b\n",
    "User-agent: *\nDisallow: /?\n",
    "User-agent: *\nDisallow\nDisallow: /حجز\nRequest-rate: 1/5\nUser-agent: zz\nDisallow: /a",
    "user-agent: shopfront/2\nDisallow: /\n\n\nuser-agent: SHOP\nDisallow: /b\n",
]
PATHS = ["", "/", "/a", "/a/ok", "/a b", "/a%20b/c", "/b", "/b/ok?x", "/q?x=1&y", "/q", "/?", "/x*y",
         "?only", "/%D8%AD%D8%AC%D8%B2", "/a#frag", "/a;p?q"]


def test_robots_decisions_agree_with_the_standard_library(spark):
    files = spark.createDataFrame(list(enumerate(ROBOTS)), "f int, text string")
    targets = spark.createDataFrame([("https://h.test" + p,) for p in PATHS], "url string")
    agent = "shopfront/0.1 (+x)"
    got = (
        files.selectExpr("f", f"{robots.rules_for(robots.groups('text'), agent)} AS rules")
        .join(targets).selectExpr("f", "url", f"{robots.allows('rules', 'url')} AS ok").collect()
    )
    assert len(got) == len(ROBOTS) * len(PATHS)
    for row in got:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(ROBOTS[row["f"]].splitlines())
        assert row["ok"] == parser.can_fetch(agent, row["url"]), (ROBOTS[row["f"]], row["url"])


def test_rules_by_prefix_decide_as_a_look_at_each(spark):
    rules = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'http://hot.test', 'http://b.test') AS origin", "id AS seq", "id % 4 = 1 AS allow",
        "CASE WHEN id % 5000 = 0 THEN '' WHEN id > 29000 THEN concat('/', id % 7) ELSE concat('/', id % 11, '/', id * 31 % 9000, if(id % 2 = 0, '/', 'é')) END AS path",
    ).where("path <> '' OR seq > 20000")
    pages = spark.range(900).selectExpr(
        "element_at(array('http://hot.test', 'http://hot.test', 'http://b.test', 'http://none.test'), int(id % 4 + 1)) AS origin", "id"
    ).selectExpr("origin", "concat(origin, CASE WHEN id % 50 = 0 THEN '' WHEN id % 50 = 1 THEN '/' ELSE concat('/', id % 11, '/', id * 31 % 9000, '%C3%A9/x?', id % 3) END) AS url")
    pages = pages.union(pages.limit(20))
    listed = rules.groupBy("origin").agg(F.expr("transform(array_sort(collect_list(struct(seq, allow, path))), r -> struct(r.allow AS allow, r.path AS path))").alias("rules"))
    plain = pages.join(listed, "origin", "left").selectExpr("url", "origin", f"{robots.allows('rules', 'url')} AS allowed")
    for hot in (50, 10**6):
        got = rule_index.decide(pages, rules, min_hot_rows=hot)
        assert sorted(got.collect()) == sorted(plain.collect())
    assert 100 < got.where("NOT allowed").count() < 800


def test_robots_tables(spark):
    text = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /y\nSITEMAP:  u1 \nsitemap:u2\n\nUser-agent: *\nDisallow:\n"
    files = spark.createDataFrame([("o", text)], "origin string, text string")
    rows = plans.robots_rules(files).collect()
    assert [(r["group_no"], r["agents"], r["seq"], r["allow"], r["path"]) for r in rows] == [
        (0, ["a", "b"], 0, False, "/x"), (0, ["a", "b"], 1, True, "/y"), (1, ["*"], 0, True, ""),
    ]
    assert files.selectExpr(robots.sitemaps("text")).first()[0] == ["u1", "u2"]


def test_large_robots_file_stays_linear(spark):
    text = "User-agent: *\n" + "".join(f"Disallow: /{i}\n" for i in range(100_000))
    files = spark.createDataFrame([("o", text)], "origin string, text string")
    assert plans.robots_rules(files).count() == 100_000


def test_sitemap_expressions(spark):
    row = spark.sql("SELECT '<LOC> a </LOC><loc>b c</loc><loc>\nd\n</loc><loc></loc>' AS t").selectExpr(
        f"{sitemaps.locations('t')} AS locs",
        f"{sitemaps.children(chr(39).join(['array(', 'x', ',', 'a-page', ',', 'PAGES', ')']))} AS kids",
        f"{sitemaps.is_markup('t')} AS m",
    ).first()
    assert row["locs"] == ["a", "d"] and row["kids"] == ["a-page", "PAGES"] and row["m"]


ANCHORS = [
    ("/blog/all-about-easter-traditions-in-the-world", "Read more"),
    ("/property/x/abc/Prime-Location", "Prime location"), ("/a/b/c/d", "Contact us now"),
    ("/about", "About"), ("/contact/", "Contact"), ("//contact", "Contact"), ("/Contact", "x"),
    ("/contact?again", "dup"), ("/p?id=7", "Book an appointment"), ("/find-us", "Where"),
    ("/news", "Facts about pomegranates and other long headline text here"), ("#contact", "c"),
    ("mailto:contact@x.test", "contact"), ("/contact.pdf", "contact"), (" deep/../visit ", "v"),
    ("https://WWW.x.test/a//b/reserv", ""), ("ftp://x.test/contact", ""), ("/", "contact"), ("/page", "ABOUT"),
]


def test_crawl_plan_order_and_cut(spark):
    homes = spark.createDataFrame(
        [("http://x.test/shop/", ANCHORS, ["http://x.test/book-online", "http://y.test/book", "/about/"])],
        "url string, anchors array<struct<href:string,text:string>>, locs array<string>",
    )
    rows = plans.crawl_plan(homes, 20).orderBy("slot").collect()
    assert [(r["rank"], r["page_url"]) for r in rows] == [
        (0, "http://x.test/"), (0, "http://x.test/contact/"), (0, "http://x.test/Contact"),
        (0, "http://x.test/p?id=7"), (0, "http://x.test/book-online"), (0, "http://x.test/a/b/reserv"),
        (0, "http://x.test/a/b/c/d"), (1, "http://x.test/find-us"), (1, "http://x.test/shop/visit"),
        (2, "http://x.test/about"), (2, "http://x.test/page"),
    ]
    cut = plans.crawl_plan(homes, 4).orderBy("slot").collect()
    assert [r["page_url"] for r in cut] == [r["page_url"] for r in rows[:3]]
    assert plans.crawl_plan(homes, 1).count() == 0
    assert plans.candidates(homes).count() == 11


def test_origin_cut_of_sitemap_pages_loses_nothing(spark):
    """Cutting the sitemap per origin first gives the same plan as cutting once per site."""
    words = ["contact", "visit", "about", "book", "news", "location"]
    made = spark.range(300).selectExpr(
        "id", "'http://x.test/' || if(id % 3 = 0, '', concat('contact', id % 9)) AS url",
        f"""transform(sequence(0, int(id % 7)), i -> named_struct('href',
            '/' || element_at(array({', '.join(map(repr, words))}), int((id + i * 5) % 6 + 1)) || (i * id % 11),
            'text', if(i % 2 = 0, 'Contact', 'x'))) AS anchors""",
        f"""transform(sequence(0, int(id % 31)), i -> named_struct('loc',
            if(i % 5 = 4, '', '/') || element_at(array({', '.join(map(repr, words))}),
            int((id + i * 7) % 6 + 1)) || (i * id % 13), 'at', i)) AS locs""",
    )
    rooted = f"filter(locs, n -> NOT {crawl.depends_on_page('n.loc')})"
    relative = f"filter(locs, n -> {crawl.depends_on_page('n.loc')})"
    links, key = crawl.from_links("url", "anchors"), crawl.home_key("url")
    early = crawl.best(crawl.from_locations("'http://x.test'", rooted), "'none'", 4)
    at_once = f"concat({links}, {crawl.from_locations('url', 'locs')})"
    two_steps = f"concat({links}, {early}, {crawl.from_locations('url', relative)})"
    wrong = made.where(f"{crawl.best(at_once, key, 3)} <> {crawl.best(two_steps, key, 3)}")
    assert wrong.count() == 0 and made.where(f"size({crawl.best(at_once, key, 3)}) = 3").count() > 100


def test_site_values_in_page_order(spark):
    pages = spark.createDataFrame(
        [("a", 2, ["y", "x"], None), ("a", 1, ["x", "z", "x"], None), ("a", 3, ["w"], "n3"), ("a", 4, [], "n4"),
         ("b", 1, [], None), ("c", 9, ["q"], "n9")],
        "host string, no int, emails array<string>, number string",
    )
    got = {r["site"]: r["emails"] for r in site_pages.first_values(pages, "host", "no", "emails").collect()}
    assert got == {"a": "x, z, y", "c": "q"}
    got = {r["site"]: r["number"] for r in site_pages.first_value(pages, "host", "no", "number").collect()}
    assert got == {"a": "n3", "c": "n9"}


def test_lookup_keeps_every_row_and_splits_hot_keys(spark):
    left = spark.range(10_000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id) END AS key"
    )
    right = spark.range(5_000).selectExpr("concat('k', id * 2) AS key", "id AS v").union(
        spark.sql("SELECT 'hot', 77L")
    )
    assert hot_keys(left.where("key IS NOT NULL"), "key", 1000) == ["hot"]
    assert hot_keys(left, "key", 5000) == []
    def answer(table):
        rows = table.select("id", "key", "v").collect()
        return sorted(rows, key=lambda r: r["id"])

    plain = answer(left.join(right, "key", "left"))
    assert len(plain) == 10_000
    assert answer(lookup(left, right, "key", 1000)) == plain
    assert answer(lookup(left, right, "key", 1000, some_keys_null=True)) == plain
    assert answer(lookup(left, right, "key", 5000, some_keys_null=True)) == plain


def test_thousands_of_hot_keys_are_dealt_out(spark):
    left = spark.range(200_000).selectExpr(
        "id", "CASE WHEN id % 4 < 2 THEN 'hot' WHEN id % 4 = 2 THEN concat('k', id % 5000) WHEN id % 20 = 3 THEN NULL ELSE concat('r', id) END AS key"
    )
    right = spark.range(6_000).selectExpr("concat('k', id) AS key", "array_repeat(id, 50) AS v").union(spark.sql("SELECT 'hot', array(-1L)"))
    assert len(frequent(left, "key", 20)) == 1251 and frequent(left, "key", 20)[0] == ("hot", 100_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = lay_out(right.union(spark.sql("SELECT NULL, array(5L)")), "laid", "key")
        for some_null, other in ((False, right), (True, right), (True, laid)):
            joined = lookup(left, other, "key", 20, some_keys_null=some_null)
            sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
            if some_null:
                assert len(sizes) == 8 and sizes[-1] <= 1.5 * sizes[4]
            plain = left.join(right, "key", "left")
            assert joined.count() == 200_000 and joined.exceptAll(plain).isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fetch_log_columns(spark):
    rows = [
        ("u", "u", 200, {"Content-Type": "Text/HTML"}, bytearray(b"a\xff"), 1.0, None),
        ("v", "v", 404, {"content-type": "x"}, bytearray(), 1.0, None),
        ("w", "w", 0, {}, bytearray(), 1.0, "refused"),
    ]
    got = log.with_status(spark.createDataFrame(rows, FETCH_SCHEMA)).collect()
    assert [(r["ok"], r["answered"], r["content_type"], r["text"]) for r in got] == [
        (True, True, "text/html", "a�"), (False, True, "x", ""), (False, False, "", "")
    ]


def test_leads_are_audited_in_order(spark, tmp_path):
    leads = spark.createDataFrame(
        [("A", "a.test", "own title"), ("B", "", "t"), ("C", "https://a.test", "t"), ("D", "gone.test", "t")],
        "name string, website string, title string",
    ).coalesce(1)
    body = bytearray(b"<title>Found</title>" + b"." * 400)
    fetches = spark.createDataFrame(
        [("https://a.test", "https://a.test/", 200, {"Content-Type": "text/html"}, body, 5.0, None)], FETCH_SCHEMA
    )
    audited = audit_leads(leads, fetches)
    assert audited.columns[:4] == ["lead_no", "name", "website", "title"]
    rows = audited.orderBy("lead_no").collect()
    assert [(r["name"], r["title"], r["fetched"], r["url"]) for r in rows] == [
        ("A", "Found", "True", "https://a.test"), ("B", "", "False", ""),
        ("C", "Found", "True", "https://a.test"), ("D", "", "False", "https://gone.test"),
    ]
    assert rows[1]["problems"] == fixed.MESSAGES["no_url"] and rows[1]["error"] == "no url given"
    assert all(v is not None for r in rows for v in r.asDict().values())
    out = tmp_path / "audited"
    write_audited(audited, str(out))
    names = [x.split(",")[0] for p in sorted(out.glob("part-*")) for x in p.read_text().splitlines()]
    assert [n for n in names if n != "name"] == ["A", "B", "C", "D"]


def test_first_values_far_out(spark):
    pages = spark.sql(f"""SELECT 's' AS host, {2**43}L AS no, array('late') AS emails
        UNION ALL SELECT 's', 1L, array('early', 'second')""")
    got = site_pages.first_values(pages, "host", "no", "emails").collect()
    assert got[0]["emails"] == "early, second, late"


def test_fetch_log_rows(spark):
    from shopfront.sources import fetches

    twice = spark.createDataFrame([("u", "old", 1), ("u", "new", 2), ("v", "one", 1)], "url string, final_url string, day int")
    with pytest.raises(ValueError, match="latest"):
        fetches.require_distinct(twice)
    kept = fetches.latest(twice, "day")
    fetches.require_distinct(kept)
    assert sorted(map(tuple, kept.collect())) == [("u", "new"), ("v", "one")]
