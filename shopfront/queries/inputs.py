"""Inputs that the registered queries derive from the driver's tables.

Every page stands for the home page of a site of its own. Its markup is the page's HTML plus a
few snippets chosen by its number, because the pages themselves hold no forms, maps, phone
links and so on. Around it lie a robots.txt, sitemaps, inner pages and the roots over both
schemes: a crawl snapshot whose size grows with the table.

The expressions below are plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopfront.sources.fetches import FETCH_SCHEMA
from shopfront.staging import spread

Q = "chr(39)"  # a single quote
NL = "chr(10)"


def choose(*cases: tuple[str, str]) -> str:
    """Concatenation of the snippets whose condition holds."""
    parts = ", ".join(f"CASE WHEN {cond} THEN {text} ELSE '' END" for cond, text in cases)
    return f"concat({parts})"


MARKUP = choose(
    ("page_id % 2 = 0", "'<meta name=\"viewport\" content=\"width=device-width\">'"),
    ("page_id % 3 = 0", "'<META NAME=\"Description\" CONTENT=\" First one \">'"),
    ("page_id % 6 = 0",
     f"concat('<meta name=', {Q}, 'description', {Q}, ' content=\"Caf&eacute; &amp; more ', page_id, '\">')"),
    ("page_id % 7 = 1", "'<html lang=FR-ca>'"),
    ("page_id % 5 < 2", "'<a href=\"/contact\">Contact</a><a href=\"/contact/\">Again</a>'"),
    ("page_id % 5 = 2", "'<a href=\"/p?id=7&amp;x=1\">Book an  <b>appointment</b></a>'"),
    ("page_id % 4 = 1", "'<a href=find-us>Where we are</a><a href=\"/a/b/c/location\">Deep</a>'"),
    ("page_id % 4 = 2", f"concat('<a href=', {Q}, '/about#team', {Q}, '>About us</a>')"),
    ("page_id % 9 = 3",
     "'<a href=\"/contact-1\">1</a><a href=\"/contact-2\">2</a><a href=\"/contact-3\">3</a>'"),
    ("page_id % 9 = 3",
     "'<a href=\"/contact-4\">4</a><a href=\"/contact-5\">5</a><a href=\"/contact-6\">6</a>'"),
    ("page_id % 9 = 3",
     "'<a href=\"/visit\">v</a><a href=\"/visit.pdf\">v</a><a href=\"/a-propos\">p</a>'"),
    ("page_id % 9 = 4",
     "'<a href=\"https://other.example.org/contact\">x</a><a href=\"/All-About-The-Best-Of-Us\">y</a>'"),
    ("page_id % 8 = 1",
     "concat('<a href=\"mailto:Info', page_id, '@Clinic.com?subject=a\">m</a> sales', page_id % 50,"
     " '@shop.co.uk, logo@2x.png')"),
    ("page_id % 8 = 2", "'write to me@example.com, you@here.org; them@there.net. us@where.io'"),
    ("page_id % 8 = 3",
     "concat('<a href=\"tel:+961 1 ', page_id % 40, '\">t</a><A HREF=\"TEL:(0', page_id, ')\">u</A>')"),
    ("page_id % 10 = 1", "concat('<a href=\"https://wa.me/', 96130000000 + page_id, '\">w</a>')"),
    ("page_id % 10 = 2", "concat('<p onclick=\"go(?phone=+', 4470000 + page_id, ')\">WhatsApp</p>')"),
    ("page_id % 10 = 3", "concat('<a href=\"https://instagram.com/shop_', page_id, '/\">i</a>')"),
    ("page_id % 10 = 4", "'<a href=\"https://www.instagram.com/explore/\">i</a>'"),
    ("page_id % 11 = 1", "'<iframe src=\"https://www.Google.com/maps/embed?pb=1\"></iframe>'"),
    ("page_id % 11 = 2", "'<a href=\"https://g.page&#47;shop\">map</a>'"),
    ("page_id % 11 = 3", "'<a href=\"https://calendly.com/x\">Pick a slot</a>'"),
    ("page_id % 11 = 4", "'RÉSERVER'"),
    ("page_id % 12 = 1",
     "'<script type=\"application/ld+json\">{\"@type\":[\"Thing\",\"Dentist\"]}</script>'"),
    ("page_id % 12 = 2",
     "'<script type=\"application/ld+json\">{\"@graph\":[1,{\"@graph\":[{\"@type\":\"AutoLocalBusiness\"}]}]}</script>'"),
    ("page_id % 12 = 3",
     "'<script type=\"application/ld+json\">{\"@type\":\"Spa\"};</script>"
     "<script type=\"application/ld+json\">[{\"@type\":\"Organization\"}]</script>'"),
    ("page_id % 12 = 4",
     "'<script type=\"APPLICATION/LD+JSON\">[{\"@type\":\"Thing\"},{\"@type\":\"Spa\"}]</script>'"),
    ("page_id % 13 = 1", "'<form><input name=a><textarea></textarea></form>'"),
    ("page_id % 13 = 2", "'<form role=search><input type=search><input name=x></form>'"),
    ("page_id % 13 = 3", "'<form><input type=hidden><input type=email><select></select></form>'"),
    ("page_id % 13 = 4", "'<form><input><input type=submit></form><form role=\"search\"><textarea></textarea></form>'"),
    ("page_id % 31 = 1", "'This Domain is PARKED'"),
    ("page_id % 31 = 2", "'under Maintenance'"),
    ("page_id % 31 = 3", "'<title> - Coming Soon</title>'"),
    ("page_id % 14 = 1", "'<noscript>enable scripts</noscript><!-- <a href=\"/contact\">no</a> -->'"),
)
HOME = f"concat(html, {MARKUP})"

HOST = "concat('p', page_id, '.', split_part(url, '/', 3))"
START = f"""CASE page_id % 5 WHEN 0 THEN concat('http://', {HOST}, '/')
    WHEN 1 THEN concat({HOST}, '/') WHEN 2 THEN concat('https://', {HOST}, '/?q=', page_id)
    ELSE concat('https://', {HOST}, '/') END"""

_FORM = "'<form><input name=a><input name=b></form>'"
_PAD = "repeat('.', 300)"
_BODY_404 = "concat('<p>not found</p>', repeat('.', 300))"


def _row(url, body="''", status="200", final=None, error="NULL", kind="'text/html'", exists="1 = 1",
         elapsed="1.25 + page_id * 37 % 4000"):
    return {
        "url": url, "final_url": final or url, "status": status, "content_type": kind,
        "body": body, "elapsed_ms": elapsed, "error": error, "exists": exists,
    }


_ROOT_STATUS = """CASE WHEN scheme = 'https' AND page_id % 11 = 4 THEN 0
    WHEN scheme = 'http' AND page_id % 29 = 3 THEN 0
    WHEN scheme = 'https' AND page_id % 17 = 6 THEN 404 ELSE 200 END"""
_ROOT_ERROR = """CASE WHEN scheme = 'https' AND page_id % 11 = 4 THEN 'certificate has expired'
    WHEN scheme = 'http' AND page_id % 29 = 3 THEN 'refused' ELSE NULL END"""
_ROOT_BODY = f"""CASE WHEN scheme = 'https' AND page_id % 11 = 4 THEN ''
    WHEN scheme = 'http' AND page_id % 29 = 3 THEN ''
    WHEN scheme = 'https' AND page_id % 17 = 6 THEN {_BODY_404}
    WHEN page_id % 37 = 5 THEN '<p>hi</p>'
    WHEN page_id % 997 = 41 THEN concat({HOME}, '<!--', repeat('x', 3200000), '-->') ELSE {HOME} END"""
_ROOT_FINAL = """CASE WHEN scheme = 'https' AND (page_id % 23 = 7 OR page_id % 40 = 11) THEN concat(origin, '/welcome?l=en')
    WHEN scheme = 'http' AND page_id % 3 = 0 THEN concat('https://', host, '/')
    WHEN scheme = 'http' AND page_id % 23 = 8 THEN concat(origin, '/welcome/') ELSE {} END"""
_ROBOTS = f"""CASE page_id % 8
    WHEN 0 THEN concat('User-agent: *', {NL}, 'Disallow: /contact', {NL}, 'Allow: /', {NL},
                       'Sitemap: ', origin, '/extra.xml', {NL})
    WHEN 1 THEN concat('# rules', {NL}, 'User-agent: other', {NL}, 'Disallow: /', {NL}, {NL},
                       'user-agent: ShopFront', {NL}, 'User-agent: more', {NL}, 'allow: /about', {NL},
                       'DISALLOW: /a # why', {NL}, {NL}, 'User-agent: *', {NL}, 'Disallow: /', {NL})
    WHEN 2 THEN concat('sitemap: http://', host, '/sitemap.xml', {NL}, 'User-agent: *', {NL},
                       'Disallow:', {NL})
    WHEN 3 THEN CASE WHEN page_id % 3 = 0 THEN concat('User-agent: *', {NL}, 'Disallow: /', {NL})
                     ELSE concat('Disallow: /contact', {NL}, 'User-agent: *', {NL}, 'Crawl-delay: 3', {NL},
                                 'Disallow: /welcome', {NL}, 'Disallow: /p?id=7', {NL}) END
    ELSE 'nothing here' END"""
_SITEMAP = """CASE page_id % 6
    WHEN 0 THEN concat('<sitemapindex><loc>', origin, '/news.xml</loc><loc> ', origin, '/Pages.xml </loc><loc>',
                       origin, '/more.xml</loc></sitemapindex>')
    WHEN 1 THEN concat('<urlset><url><LOC>', origin, '/book-online</LOC></url><url><loc>about</loc></url><url><loc>',
                       origin, '/contact/</loc></url><url><loc>http://else.example.org/contact</loc></url></urlset>')
    WHEN 2 THEN concat(repeat(' ', 60), '<urlset></urlset>')
    WHEN 3 THEN concat('<urlset><loc>http://www.', host, '/visit</loc><loc>/blog/post</loc><loc>', origin,
                       '/contact-9</loc><loc>', origin, '/x-book</loc></urlset>')
    ELSE '<urlset></urlset>' END"""

# One entry per kind of row; columns in scope: page_id, url, html, scheme, host, origin.
ROWS = (
    _row("concat(origin, '/')", _ROOT_BODY, _ROOT_STATUS, _ROOT_FINAL.format("concat(origin, '/')"),
         _ROOT_ERROR, exists="page_id % 19 <> 5 AND NOT (scheme = 'http' AND page_id % 19 = 6)"),
    _row("concat(origin, '/?q=', page_id)", _ROOT_BODY, _ROOT_STATUS,
         _ROOT_FINAL.format("concat(origin, '/?q=', page_id)"), _ROOT_ERROR,
         exists="scheme = 'https' AND page_id % 5 = 2 AND page_id % 19 <> 5"),
    _row("concat(origin, '/robots.txt')", _ROBOTS, "CASE WHEN page_id % 8 > 4 THEN 404 ELSE 200 END",
         kind="'text/plain'"),
    _row("concat(origin, '/sitemap.xml')", _SITEMAP, "CASE WHEN page_id % 6 = 5 THEN 404 ELSE 200 END",
         kind="'application/xml'"),
    _row("concat(origin, '/Pages.xml')",
         "concat('<urlset><loc>', origin, '/visit</loc><loc>', origin, '/about</loc></urlset>')",
         kind="'application/xml'", exists="page_id % 4 <> 0"),
    _row("concat(origin, '/news.xml')", "concat('<urlset><loc>', origin, '/contact-8</loc></urlset>')",
         kind="'application/xml'"),
    _row("concat(origin, '/extra.xml')", "concat('<urlset><loc>', origin, '/find-us</loc></urlset>')",
         kind="'application/xml'"),
    _row("concat(origin, '/contact')",
         f"concat({_FORM}, '<a href=\"tel:00', page_id % 7, '\">t</a> team@shop', page_id, '.org wa.me/1', 1000000 + page_id,"
         f" {_PAD})",
         "CASE WHEN page_id % 7 = 2 THEN 500 ELSE 200 END",
         "CASE WHEN page_id % 10 = 6 THEN concat(origin, '//contact/') ELSE concat(origin, '/contact') END",
         exists="page_id % 4 <> 3"),
    _row("concat(origin, '/contact-1')", f"concat('again', {_PAD})",
         final="CASE WHEN page_id % 2 = 0 THEN concat(origin, '/') ELSE concat(origin, '/contact-2') END"),
    _row("concat(origin, '/contact-2')", f"concat('<a href=\"https://maps.app.goo.gl/x\">m</a>', {_PAD})"),
    _row("concat(origin, '/contact-3')", f"concat('third', {_PAD})", kind="'application/json'"),
    _row("concat(origin, '/contact-5')", f"concat('instagram.com/p/1 instagram.com/x', {_PAD})", kind="NULL"),
    _row("concat(origin, '/about')", f"concat('instagram.com/about_', page_id, {_PAD})"),
    _row("concat(origin, '/find-us')", f"concat('<a href=\"https://goo.gl/maps/1\">m</a>', {_PAD})"),
    _row("concat(origin, '/p?id=7&x=1')", f"concat('book online ', {_FORM}, {_PAD})"),
    _row("concat(origin, '/book-online')", f"concat('fresha.com/a', {_PAD})"),
)
_COLUMNS = ("url", "final_url", "status", "content_type", "body", "elapsed_ms", "error")


# --- Spark ------------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def home_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): every page with its snippets."""
    return spread(table(spark, sf_dir, "pages")).selectExpr("page_id", "url", f"{HOME} AS html")


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url): one start URL per page."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{START} AS url")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch log around all pages, from one scan of the table."""
    origins = spread(table(spark, sf_dir, "pages")).selectExpr(
        "page_id", "url", "html", f"{HOST} AS host", "explode(array('http', 'https')) AS scheme"
    ).selectExpr("*", "concat(scheme, '://', host) AS origin")

    def entry(row: dict[str, str]) -> str:
        fields = ", ".join(f"'{c}', cast({row[c]} AS {_TYPES[c]})" for c in _COLUMNS)
        return f"if({row['exists']}, named_struct({fields}), NULL)"

    rows = ", ".join(entry(r) for r in ROWS)
    log = origins.selectExpr(f"inline_outer(array_compact(array({rows})))").where("url IS NOT NULL")
    return log.selectExpr(
        "url", "final_url", "status",
        "if(content_type IS NULL, map(), map('Content-Type', content_type)) AS headers",
        "cast(body AS binary) AS body", "elapsed_ms", "error",
    ).to(FETCH_SCHEMA)


_TYPES = {c: "string" for c in _COLUMNS} | {"status": "int", "elapsed_ms": "double"}


# --- DuckDB -----------------------------------------------------------------------------
def _snapshot_sql() -> str:
    selects = " UNION ALL ".join(
        "SELECT " + ", ".join(f"{r[c]} AS {c}" for c in _COLUMNS)
        + f" FROM log_origins WHERE {r['exists']}"
        for r in ROWS
    )
    return f"""log_origins AS MATERIALIZED (
        SELECT page_id, url, html, {HOST} AS host, scheme, concat(scheme, '://', {HOST}) AS origin
        FROM pages, (VALUES ('http'), ('https')) AS s(scheme)),
    log AS MATERIALIZED ({selects})"""


HOME_SQL = f"home AS MATERIALIZED (SELECT page_id, url, {HOME} AS html FROM pages)"
START_SQL = f"starts AS MATERIALIZED (SELECT page_id, {START} AS url FROM pages)"
SNAPSHOT_SQL = _snapshot_sql()
