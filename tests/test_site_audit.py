"""Whole audits over small fetch logs, one site per situation, all in one run."""

import pytest

from shopfront.functions import fixed
from shopfront.plans.site_audit import AuditOptions, audit
from shopfront.sources import sinks
from shopfront.sources.fetches import FETCH_SCHEMA

HEAD = (
    '<head><title>Shop</title><meta name="viewport" content="x">'
    '<meta name="description" content="about us all"></head>'
)
FORM = '<form><input name="n"><textarea name="t"></textarea></form>'
LD = '<script type="application/ld+json">{"@graph":[{"@type":"Dentist"}]}</script>'


def page(body="", head=HEAD):
    return f"<!doctype html><html lang='en'>{head}<body>{body}<!-- {'.' * 300} --></body></html>"


class Log:
    """Rows of a fetch log, and the URLs to audit."""

    def __init__(self):
        self.rows, self.starts = {}, []

    def add(self, url, body="", status=200, final=None, error=None, kind="text/html", ms=10.0):
        if isinstance(body, str):
            body = body.encode()
        headers = {"Content-Type": kind} if kind else {}
        self.rows[url] = (url, final or url, status, headers, bytearray(body), ms, error)

    def site(self, url, pages=None, **kw):
        """A site whose http root redirects to its https start URL."""
        self.starts.append(url)
        if pages is not None:
            origin = "/".join(url.split("/")[:3])
            self.add(url, pages.pop("/", page()), **kw)
            self.add(origin.replace("https:", "http:") + "/", page(), final=url)
            for path, body in pages.items():
                self.add(origin + path, body)


def build():
    log = Log()
    full = page(
        '<a href="https://wa.me/9611234567">w</a><a href="https://maps.google.com/x">m</a>'
        '<a href="https://calendly.com/x">Pick a slot</a>' + LD
    )
    log.site("https://good.test/", {"/": full, "/sitemap.xml": "<urlset></urlset>"})
    log.site("https://bare.test/", {"/": "<html><body>" + "hello " * 60 + "</body></html>"})
    log.site("https://parked.test/", {"/": page("This DOMAIN is parked")})
    log.site("https://tiny.test/", {"/": "<p>hi"})
    log.site("https://gone.test/", {"/": page('<a href="/contact">c</a>')}, status=404)
    log.site("https://soon.test/", {"/": page(head="<head><title>Coming SOON</title></head>")})
    log.site("https://works.test/", {"/": page("site UNDER maintenance")})
    log.site("https://closed.test/", {"/": full, "/robots.txt": "User-agent: *\nDisallow: /\n"})
    log.site("https://moved.test/", {"/": full}, final="https://target.test/private/x")
    log.add("https://target.test/robots.txt", "User-agent: *\nDisallow: /private\n")
    log.site("https://down.test/")
    log.add("https://down.test/", status=0, error="timed out", ms=77.04)
    log.site("nowhere.test")

    contact = {"/": page('<a href="/contact-us">Contact</a><a href="/blog">Blog</a>'),
               "/contact-us": page(FORM)}
    log.site("https://form.test/", contact)
    log.site("https://map.test/", {
        "/": page('<a href="/find-us">Where</a>'),
        "/find-us": page('<iframe src="https://www.google.com/maps/embed?pb=1"></iframe>' + LD),
    })
    log.site("https://plain.test/", {
        "/": page('<a href="/contact">Contact</a><a href="/about">About</a>'),
        "/contact": page("call us"), "/about": page("who we are"),
    })
    log.site("https://mapped.test/", {
        "/": page('<a href="/contact?from=nav">Write</a>'),
        "/sitemap.xml": "<urlset><loc>https://mapped.test/book-online</loc><loc>/blog/post</loc>"
                        "<loc>http://else.test/contact</loc><loc>about</loc>"
                        "<loc>https://mapped.test/contact/</loc></urlset>",
        "/book-online": page('<a href="https://calendly.com/c">x</a>'),
        "/contact?from=nav": page(), "/about": page(),
    })
    many = "".join(f'<a href="/contact-{i}">c{i}</a>' for i in range(20))
    log.site("https://many.test/", {
        "/": page('<a href="https://other.test/contact">no</a>' + many),
        **{f"/contact-{i}": page() for i in range(20)},
    })
    log.site("https://part.test/", {
        "/": page('<a href="/contact">C</a><a href="/about">A</a>'),
        "/robots.txt": "# rules\nUser-agent: other\nDisallow: /about\n\nUser-agent: *\nDisallow: /contact\n",
        "/contact": page(FORM), "/about": page(),
    })
    log.site("https://fails.test/", {
        "/": page('<a href="/contact">C</a><a href="/about">A</a><a href="/visit">V</a>'
                  '<a href="/directions">D</a>')})
    log.add("https://fails.test/about", page(), status=500)
    log.add("https://fails.test/visit", page(), kind="application/json")
    log.add("https://fails.test/directions", page("wa.me/1234567"), kind=None)
    log.site("https://again.test/", {
        "/": page('<a href="/contact">C</a><a href="/contact-us">D</a><a href="/about">E</a>'),
        "/contact": page(FORM)})
    log.add("https://again.test/contact-us", page(FORM), final="https://again.test//contact/")
    log.add("https://again.test/about", page(), final="https://again.test/")
    log.site("https://search.test/", {"/": page(
        '<form role="search"><input type="search"><input name="x"></form>'
        '<form><input type="hidden"><input name="q"><input type="submit"></form>')})
    log.site("https://reach.test/", {
        "/": page('<a href="mailto:Info@Clinic.com?subject=x">m</a><a href="tel:+961 1 234">t</a>'
                  '<a href="https://instagram.com/p/1">i</a> logo@2x.png <a href="/contact">c</a>'),
        "/contact": page('<a href="tel:0099">t</a><a href="tel:+9611234">t</a> b@c.org info@clinic.com'
                         ' d@e.org f@g.org <a href="https://wa.me/9613123456">w</a>'
                         '<a href="https://www.instagram.com/clinic_x/">i</a>'),
    })

    log.starts.append("https://badcert.test/shop?x=1")
    log.add("https://badcert.test/shop?x=1", status=0, error="certificate has expired")
    log.add("http://badcert.test/shop", page())
    log.starts.append("https://certloop.test/")
    log.add("https://certloop.test/", status=0, error="handshake")
    log.add("http://certloop.test/", page(), final="https://www.certloop.test/")
    log.starts.append("https://noredirect.test/")
    log.add("https://noredirect.test/", page())
    log.add("http://noredirect.test/", page())
    log.starts.append("http://upgraded.test/")
    log.add("http://upgraded.test/", page(), final="https://upgraded.test/")
    log.starts.append("http://both.test/")
    log.add("http://both.test/", page())
    log.add("https://both.test/", page(), status=503)
    log.starts.append("http://insecure.test/")
    log.add("http://insecure.test/", page())
    log.add("https://insecure.test/", status=0, error="refused")
    log.site("https://oldmap.test/", {"/robots.txt": "Sitemap: http://oldmap.test/sm.xml\n"})
    log.add("http://oldmap.test/sm.xml", "<urlset></urlset>")
    log.site("https://oldurls.test/", {
        "/sitemap.xml": "<urlset><loc>http://www.oldurls.test/a</loc></urlset>"})
    log.site("https://cleanmap.test/", {
        "/sitemap.xml": "<urlset><loc>https://cleanmap.test/</loc></urlset>"})
    log.site("https://slow.test/", {"/": page("x" * 3_100_000)}, ms=3456.78)

    kids = "".join(f"<loc>https://index.test/{n}.xml</loc>" for n in ("news", "Pages", "more"))
    log.site("https://index.test/", {
        "/robots.txt": "SITEMAP: https://index.test/sitemap.xml\nsitemap:https://index.test/gone.xml",
        "/sitemap.xml": f"<sitemapindex>{kids}</sitemapindex>",
        "/Pages.xml": "<urlset><loc>https://index.test/visit</loc></urlset>",
        "/news.xml": "<urlset><loc>https://index.test/contact</loc></urlset>",
        "/visit": page(), "/contact": page(),
    })
    log.site("https://text.test/", {"/sitemap.xml": " " * 60 + "<urlset></urlset>"})
    return log


@pytest.fixture(scope="module")
def audits(spark):
    log = build()
    starts = spark.createDataFrame([(u,) for u in [*log.starts, "", log.starts[0]]], "url string")
    fetches = spark.createDataFrame(list(log.rows.values()), FETCH_SCHEMA)
    return audit(starts, fetches).cache()


@pytest.fixture(scope="module")
def sites(audits):
    rows = [r.asDict() for r in audits.collect()]
    named = {r["url"].split("//")[1].split("/")[0].removesuffix(".test"): r for r in rows}
    assert len(named) == len(rows)
    return named


def codes(site):
    return [c for c in site["problem_codes"] if not c.startswith("missing_")]


def test_complete_and_bare_sites(sites):
    good, bare = sites["good"], sites["bare"]
    assert good["problems"] == [] and good["notes"] == [] and good["fetched"]
    assert (good["title"], good["meta_description"], good["lang"]) == ("Shop", "about us all", "en")
    assert good["has_sitemap"] and good["https"] and good["http_redirects_to_https"] is True
    assert good["whatsapp_number"] == "9611234567" and good["pages_checked"] == ["/"]
    assert bare["problem_codes"] == [
        "missing_maps", "missing_whatsapp", "missing_booking", "missing_jsonld", "no_viewport",
        "no_title", "no_description", "no_sitemap",
    ]
    assert bare["problems"][0] == (
        "No Google Maps link on the home page (no contact/booking/location pages were found to check),"
        " makes it harder for customers to find the physical location."
    )


def test_broken_sites_are_not_crawled(sites):
    assert codes(sites["parked"]) == ["parked"]
    assert codes(sites["tiny"])[0] == "parked"
    assert codes(sites["gone"]) == ["error_page"]
    assert sites["gone"]["problems"][0] == "Site returned an error page (HTTP 404)."
    assert codes(sites["soon"])[0] == "maintenance" and codes(sites["works"]) == ["maintenance"]
    for name in ("parked", "tiny", "gone", "soon", "works"):
        assert sites[name]["broken_or_parked"] and not sites[name]["has_sitemap"]
        assert sites[name]["pages_checked"] == ["/"] and sites[name]["pages_failed"] == []


def test_stops(sites):
    closed, moved, down = sites["closed"], sites["moved"], sites["down"]
    assert closed["state"] == "robots_start" and closed["problem_codes"] == ["robots_start"]
    assert closed["robots_disallowed"] and not closed["fetched"] and closed["status"] == 0
    assert not closed["https"] and closed["pages_checked"] == [] and closed["title"] == ""
    assert moved["state"] == "robots_home" and moved["robots_disallowed"] and not moved["fetched"]
    assert moved["status"] == 200 and moved["https"] and moved["title"] == ""
    assert moved["page_weight_kb"] > 0 and moved["missing_sitewide"] == []
    assert down["problems"] == ["Site did not respond (timed out)."]
    assert down["broken_or_parked"] and down["error"] == "timed out" and down["load_time_ms"] == 77.0
    assert sites["nowhere"]["problems"] == ["Site did not respond (no response)."]
    assert sites["nowhere"]["url"] == "https://nowhere.test"


def test_presence_is_site_wide(sites):
    form, mapped = sites["form"], sites["map"]
    assert form["pages_checked"] == ["/", "/contact-us"] and form["form_found_on"] == ["/contact-us"]
    assert form["has_contact_form"] and "booking" not in form["missing_sitewide"]
    assert form["missing_home_only"] == ["booking"]
    assert form["notes"] == ["No online booking link or contact/enquiry form on the home page,"
                             " but found on /contact-us."]
    assert mapped["maps_found_on"] == ["/find-us"] and mapped["jsonld_found_on"] == ["/find-us"]
    assert mapped["missing_home_only"] == ["maps", "jsonld"]
    plain = sites["plain"]
    assert plain["missing_sitewide"] == ["maps", "whatsapp", "booking", "jsonld"]
    assert "any of the 3 pages checked (/, /contact, /about)" in plain["problems"][0]
    assert not sites["search"]["has_contact_form"]


def test_crawl_plan(sites):
    assert sites["mapped"]["pages_checked"] == ["/", "/contact?from=nav", "/book-online", "/about"]
    assert sites["mapped"]["booking_found_on"] == ["/book-online"]
    assert sites["many"]["pages_checked"] == ["/"] + [f"/contact-{i}" for i in range(7)]
    assert sites["part"]["pages_checked"] == ["/", "/about"]
    assert sites["fails"]["pages_checked"] == ["/", "/directions"]
    assert sites["fails"]["pages_failed"] == ["/contact", "/visit", "/about"]
    assert sites["again"]["pages_checked"] == ["/", "/contact"]
    assert sites["index"]["pages_checked"] == ["/", "/visit"] and sites["index"]["has_sitemap"]
    assert not sites["text"]["has_sitemap"]


def test_contacts_in_visit_order(sites):
    reach = sites["reach"]
    assert reach["emails"] == ["info@clinic.com", "b@c.org", "d@e.org"]
    assert reach["phones"] == ["+9611234", "0099"]
    assert reach["whatsapp_number"] == "9613123456"
    assert reach["instagram"] == "https://www.instagram.com/clinic_x"


@pytest.mark.parametrize(
    "name, https, redirects, error, told",
    [
        ("badcert", False, None, "certificate has expired", ["no_https"]),
        ("certloop", True, None, "handshake", []),
        ("noredirect", True, False, "", ["no_redirect"]),
        ("upgraded", True, True, "", []),
        ("both", True, False, "", ["no_redirect"]),
        ("insecure", False, None, "refused", ["no_https"]),
        ("oldmap", True, True, "", ["points_to_http"]),
        ("oldurls", True, True, "", ["points_to_http"]),
        ("cleanmap", True, True, "", []),
    ],
)
def test_https_questions(sites, name, https, redirects, error, told):
    site = sites[name]
    assert (site["https"], site["http_redirects_to_https"], site["https_error"]) == (
        https, redirects, error
    )
    assert [c for c in codes(site) if c in ("no_https", "no_redirect", "points_to_http")] == told
    assert site["sitemap_robots_http"] == ("points_to_http" in told)


def test_slow_and_heavy(sites):
    slow = sites["slow"]
    assert codes(slow)[-2:] == ["slow", "heavy"] and slow["load_time_ms"] == 3456.8
    assert slow["problems"][-2].startswith("Slow to load (3456ms)")
    assert slow["problems"][-1].startswith(f"Heavy page ({slow['page_weight_kb']}KB)")


def test_options(spark):
    log = build()
    starts = spark.createDataFrame([("https://many.test/",), ("https://mapped.test/",)], "url string")
    fetches = spark.createDataFrame(
        [r for u, r in log.rows.items() if "many" in u or "mapped" in u], FETCH_SCHEMA
    )
    options = AuditOptions(check_sitemap=False, max_pages=1)
    for site in audit(starts, fetches, options).collect():
        assert site["pages_checked"] == ["/"] and not site["has_sitemap"]
        assert "no_sitemap" not in site["problem_codes"]


def test_flat_rows_and_single_site_file(audits, tmp_path):
    flat = {r["url"]: r for r in sinks.flat_audits(audits).collect()}
    form = flat["https://form.test/"]
    assert list(form.asDict()) == list(fixed.AUDIT_FIELDS)
    assert form["pages_checked"] == "/ /contact-us" and form["form_found_on"] == "/contact-us"
    assert form["missing_sitewide"] == "maps,whatsapp,jsonld" and form["fetched"] == "True"
    assert flat["https://badcert.test/shop?x=1"]["http_redirects_to_https"] == ""
    assert flat["https://reach.test/"]["emails"] == "info@clinic.com, b@c.org, d@e.org"
    assert "; No WhatsApp" in form["problems"]
    out = tmp_path / "one"
    sinks.write_audit(audits, "https://form.test/", str(out))
    lines = [x for p in out.glob("part-*") for x in p.read_text().splitlines()]
    assert lines[0] == ",".join(fixed.AUDIT_FIELDS)
    assert len([x for x in lines if x.startswith("https://form.test/")]) == 1


def test_the_log_is_dealt_out_once(spark, sf_dir, monkeypatch):
    """Every plan of the audit: how often rows are dealt out anew, and that the log's never are."""
    from shopfront.operators import origins
    from shopfront.plans import site_audit
    from shopfront.queries import registry

    plans = []

    def seen(function):
        def run(table, *args, **options):
            plans.append(table._jdf.queryExecution().executedPlan().toString())
            return function(table, *args, **options)

        return run

    for module in (site_audit, origins):
        monkeypatch.setattr(module, "lay_out", seen(module.lay_out))
    monkeypatch.setattr(site_audit, "stage", seen(site_audit.stage))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        result = site_audit.audit(registry.starts(spark, sf_dir), registry.snapshot(spark, sf_dir), registry.OPTIONS)
        plans.append(result._jdf.queryExecution().executedPlan().toString())
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sum(plan.count("Exchange hashpartitioning") for plan in plans) <= 15
    scans = [line for plan in plans for line in plan.splitlines() if "facts_" in line and "FileScan" in line]
    assert len(scans) >= 5 and all("Bucketed: true" in line for line in scans)
