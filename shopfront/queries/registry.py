"""The registered queries: (spark, data folder) to DataFrame.

Lists come out joined to text, in their defined order, so that results compare by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfront.functions import contacts, crawl, detect, fixed, html, robots, sitemaps, urls
from shopfront.functions.text import decode_entities, fold_case, quoted
from shopfront.operators import crawl_plan as plans
from shopfront.operators import origins as origin_ops
from shopfront.operators import osm, rule_index, site_pages
from shopfront.operators.fetch_facts import ORIGIN_FACTS, fetch_facts
from shopfront.operators.lookup import lookup
from shopfront.plans import site_audit
from shopfront.plans.lead_audit import audit_leads
from shopfront.queries import inputs
from shopfront.queries.inputs import home_pages, snapshot, starts, table
from shopfront.sources import fetches as log
from shopfront.sources import leads as lead_files
from shopfront.sources import osm as osm_files
from shopfront.sources import sinks
from shopfront.staging import lay_out, shared_folder, spread, stage

AGENT = "shopfront/0.1 (+contact)"
OPTIONS = site_audit.AuditOptions(user_agent=AGENT)
SEP = " | "


def _joined(array: str, item: str = "x") -> str:
    return f"array_join(transform({array}, x -> {item}), '{SEP}')"


# --- URLs -------------------------------------------------------------------------------
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "regexp_replace(url, '^https?://', '')"
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        f"{urls.with_default_scheme(raw)} AS with_scheme",
        f"{urls.scheme('url')} AS scheme",
        f"{urls.authority('url')} AS authority",
        f"{urls.site_key('url')} AS site",
        f"{urls.path_query('url')} AS path_query",
        f"{urls.page_key(urls.path_query('url'))} AS page_key",
        f"{urls.clean_path('url')} AS clean_path",
        f"{urls.is_page_like(urls.clean_path('url'))} AS page_like",
        f"{urls.is_asset(urls.clean_path('url'))} AS asset",
        f"bigint(size({urls.segments(urls.clean_path('url'))})) AS depth",
    )


def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = html.with_page_facts(home_pages(spark, sf_dir), "links")
    each = links.selectExpr("page_id", "url", "posexplode_outer(links) AS (ord, href)").where(
        "href IS NOT NULL"
    )
    resolved = each.selectExpr("*", f"{urls.resolve('url', 'href')} AS resolved")
    return resolved.selectExpr(
        "page_id", "bigint(ord) AS ord", "href", f"{urls.is_page_href('href')} AS page_href",
        "resolved", f"{urls.site_key('resolved')} = {urls.site_key('url')} AS same_site",
    )


# --- page facts -------------------------------------------------------------------------
def _fact(name: str, *columns: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = html.with_page_facts(home_pages(spark, sf_dir), name)
        return facts.selectExpr("page_id", *(columns or (name,)))

    return query


def page_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html.with_page_facts(home_pages(spark, sf_dir), "has_viewport", "lang")
    return facts.select("page_id", "has_viewport", "lang")


def page_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return home_pages(spark, sf_dir).selectExpr(
        "page_id", f"{html.page_weight_kb('octet_length(html)')} AS page_weight_kb",
        f"{html.load_time_ms('page_id + 0.25D')} AS load_time_ms",
    )


def entity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"{decode_entities('html')} AS decoded"
    ).selectExpr("page_id", "bigint(length(decoded)) AS chars", "md5(decoded) AS digest")


# --- detectors --------------------------------------------------------------------------
def page_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html.with_page_facts(home_pages(spark, sf_dir), "decoded_links", "has_form").selectExpr(
        "*", f"{fold_case('html')} AS _folded"
    )
    return facts.selectExpr(
        "page_id", *(f"{detect.linked(c, '_folded', 'decoded_links')} AS {c}"
                     for c in ("maps", "whatsapp", "booking")), "has_form AS form",
    )


_BLOBS = f"""CASE page_id % 10
    WHEN 0 THEN '{{"@type":"Thing","@type":"Spa"}}' WHEN 1 THEN '{{"@type":"Spa","@type":"Thing"}}'
    WHEN 2 THEN '{{"@graph":[{{"@type":"Thing"}}],"n":NaN,"@graph":[{{"x":-Infinity,"@graph":[{{"@type":["Thing","Dentist"]}}]}}]}}'
    WHEN 3 THEN '{{"@graph":[{{"@type":"Spa"}}],"@graph":[]}}' WHEN 4 THEN '{{"@graph":"[{{@type:Spa}}]","a":{{"b":1,"b":2}}}}'
    WHEN 5 THEN concat('{{"a":{{"b":1,"b":2}},"name":"', page_id, '","@type":"AutoLocalBusiness"}}')
    WHEN 6 THEN '{{"@type":"Spa"' WHEN 7 THEN concat('{{', {inputs.Q}, '@type', {inputs.Q}, ':"Spa"}}')
    WHEN 8 THEN '[[{{"@type":"Spa"}}],{{"@type":["x",null,"Spa"]}}]' ELSE '{{"x":{{"@type":"Spa"}}}}' END"""


def page_loose_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured data as careless sites write it: repeated names, numbers that are none, cut short."""
    blobs = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_BLOBS} AS blob")
    return blobs.selectExpr("page_id", f"{detect.has_local_business('array(blob)')} AS local_business")


def page_local_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html.with_page_facts(home_pages(spark, sf_dir), "ldjson_blobs")
    return facts.selectExpr(
        "page_id", "bigint(size(ldjson_blobs)) AS blobs",
        f"{detect.has_local_business('ldjson_blobs')} AS local_business",
    )


def page_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = home_pages(spark, sf_dir).selectExpr(
        "page_id", "if(page_id % 17 = 6, 404, 200) AS status",
        "if(page_id % 37 = 5, '<p>hi</p>', html) AS html",
    )
    facts = html.with_page_facts(pages, "title").selectExpr("*", "lower(html) AS _lower")
    return facts.selectExpr(
        "page_id",
        f"{detect.is_parked('_lower')} AS parked",
        f"{detect.is_placeholder('status', 'octet_length(html)')} AS placeholder",
        f"{detect.is_error_page('status')} AS error_page",
        f"{detect.is_maintenance('_lower', 'title')} AS maintenance",
    ).selectExpr("*", "parked OR placeholder OR error_page OR maintenance AS broken_or_parked")


def document_booking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spread(table(spark, sf_dir, "documents"))
        .selectExpr("doc_id", f"{fold_case('text')} AS _folded")
        .selectExpr("doc_id", *(f"{detect.linked(c, '_folded', quoted(''))} AS {c}"
                                for c in ("maps", "whatsapp", "booking")))
    )


# --- contacts ---------------------------------------------------------------------------
def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contacts.emails("text", "cast(array() AS array<string>)")
    return spread(table(spark, sf_dir, "documents")).selectExpr("doc_id", f"{_joined(found)} AS emails")


def _page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html.with_page_facts(home_pages(spark, sf_dir), "links")
    return facts.selectExpr(
        "page_id", f"{urls.site_key('url')} AS site", f"{contacts.emails('html', 'links')} AS emails",
        f"{contacts.phones('links')} AS phones",
        f"{contacts.whatsapp_number(fold_case('html'))} AS whatsapp_number",
        f"{contacts.instagram('html')} AS instagram",
    )


def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_contacts(spark, sf_dir).selectExpr(
        "page_id", "site", f"{_joined('emails')} AS emails", f"{_joined('phones')} AS phones",
        "whatsapp_number", "instagram",
    )


def _site_list(column: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return site_pages.first_values(_page_contacts(spark, sf_dir), "site", "page_id", column)

    return query


def _site_value(column: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return site_pages.first_value(_page_contacts(spark, sf_dir), "site", "page_id", column)

    return query


def site_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html.with_page_facts(
        home_pages(spark, sf_dir), "decoded_links", "has_form", "ldjson_blobs"
    ).selectExpr("*", f"{fold_case('html')} AS _folded")
    checks = facts.selectExpr(
        f"{urls.site_key('url')} AS site",
        *(f"{detect.linked(c, '_folded', 'decoded_links')} AS {c}" for c in ("maps", "whatsapp", "booking")),
        "has_form AS form", f"{detect.has_local_business('ldjson_blobs')} AS jsonld",
    )
    return site_pages.presence(checks, "site", fixed.CHECKS)


# --- fetch log, robots, sitemaps --------------------------------------------------------
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.with_status(snapshot(spark, sf_dir)).selectExpr(
        "url", "ok", "answered", "content_type", "bigint(length(text)) AS chars",
        f"{log.is_html_answer('status', 'error', 'content_type')} AS readable",
    )


def _robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).where("url LIKE '%/robots.txt' AND status = 200").selectExpr(
        f"{urls.origin('url')} AS origin", f"{log.text('body')} AS text"
    )


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.robots_rules(_robots_files(spark, sf_dir)).selectExpr(
        "origin", "bigint(group_no) AS group_no", "array_join(agents, ',') AS agents",
        "bigint(seq) AS seq", "allow", "path",
    )


def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robots_files(spark, sf_dir).selectExpr(
        "origin", f"posexplode_outer({robots.sitemaps('text')}) AS (seq, sitemap)"
    ).where("seq IS NOT NULL").selectExpr("origin", "bigint(seq) AS seq", "sitemap")


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of the log against the robots.txt of its origin."""
    pages = snapshot(spark, sf_dir).selectExpr("url", f"{urls.origin('url')} AS origin")
    rules = _robots_files(spark, sf_dir).selectExpr(
        "origin", f"{robots.rules_for(robots.groups('text'), AGENT)} AS rules"
    )
    return lookup(pages, rules, "origin").selectExpr(
        "url", f"{robots.allows('rules', 'url')} AS allowed"
    )


def robots_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against 600 rules of its origin, of which many share a path."""
    pages = table(spark, sf_dir, "pages").selectExpr("url", f"{urls.origin('url')} AS origin")
    rules = pages.select("origin").distinct().selectExpr("origin", "explode(sequence(0L, 599L)) AS seq").selectExpr(
        "origin", "seq", "(seq + length(origin)) % 3 = 0 AS allow",
        """CASE WHEN seq = 599 THEN '/fr' ELSE concat('/', element_at(array('en', 'fr', 'de', 'es'), int(seq % 4 + 1)), '/',
            if(seq % 5 = 0, '', string(seq * 7 % 300)), if(seq % 5 = 0 AND seq < 550, string(seq * 13 % 97), '')) END AS path""",
    )
    return rule_index.decide(pages, rules)


def sitemap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = snapshot(spark, sf_dir).where("url LIKE '%.xml'").selectExpr(
        "url", f"{sitemaps.is_markup('body')} AS is_markup", f"{log.text('body')} AS text"
    )
    return files.selectExpr(
        "url", "is_markup", f"{sitemaps.is_index('lower(text)')} AS is_index",
        f"{_joined(sitemaps.locations('text'))} AS locs",
        f"{_joined(sitemaps.children(sitemaps.locations('text')))} AS children",
    )


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lay_out(fetch_facts(snapshot(spark, sf_dir)).select(*ORIGIN_FACTS), "facts", "url")


def sitemap_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every origin of the log: its sitemap files read, addresses found and the http finding."""
    facts = _facts(spark, sf_dir)
    origins = facts.selectExpr(f"{urls.origin('url')} AS origin").distinct()
    known = lay_out(origin_ops.origin_answers(origins, facts, AGENT), "known", "origin", dealt=True)
    read = origin_ops.with_sitemaps(known, facts)
    sample = f"concat(declared, slice(locs, 1, {fixed.SITEMAP_HTTP_SAMPLE}))"
    return read.selectExpr(
        "origin", "has_sitemap", f"{_joined('locs')} AS locs",
        f"{sitemaps.points_to_http(sample, 'origin')} AS points_to_http",
    )


# --- crawl plan -------------------------------------------------------------------------
def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.with_page_facts(home_pages(spark, sf_dir), "anchors")


def crawl_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    homes = _homes(spark, sf_dir).select("page_id", "url", "anchors")
    found = homes.selectExpr(
        "page_id", f"inline_outer({crawl.from_links('url', 'anchors')}) AS (key, ord, rank, depth, page_url)"
    ).where("key IS NOT NULL")
    return found.selectExpr(
        "page_id", "ord", "key", "bigint(rank) AS rank", "bigint(depth) AS depth", "page_url"
    )


def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = urls.origin("url")
    homes = _homes(spark, sf_dir).selectExpr(
        "url", "anchors", f"array({origin} || '/book', {origin} || '/news', 'visit') AS locs"
    )
    return plans.crawl_plan(homes, fixed.MAX_PAGES).selectExpr(
        "url", "bigint(slot) AS slot", "bigint(rank) AS rank", "bigint(depth) AS depth", "page_url"
    )


# --- site audit -------------------------------------------------------------------------
def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_audit.audit(starts(spark, sf_dir), snapshot(spark, sf_dir), OPTIONS)


def https_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_audit.answers(starts(spark, sf_dir), snapshot(spark, sf_dir), OPTIONS)
    return found.selectExpr(
        "url", "state", "home_url", "bigint(status) AS status", "https", "http_redirects_to_https",
        "https_error",
    )


def visited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audits(spark, sf_dir).selectExpr(
        "url", "array_join(pages_checked, ' ') AS pages_checked",
        "array_join(pages_failed, ' ') AS pages_failed", "has_sitemap", "sitemap_robots_http",
    )


def site_found_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audits(spark, sf_dir).selectExpr(
        "url", *(f"array_join({c}_found_on, ' ') AS {c}_found_on" for c in fixed.CHECKS),
        "array_join(emails, ', ') AS emails", "array_join(phones, ', ') AS phones",
        "whatsapp_number", "instagram",
    )


def site_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audits(spark, sf_dir).selectExpr(
        "url", "array_join(missing_sitewide, ',') AS missing_sitewide",
        "array_join(missing_home_only, ',') AS missing_home_only", "array_join(notes, '; ') AS notes",
    )


def site_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audits(spark, sf_dir).selectExpr(
        "url", "posexplode_outer(arrays_zip(problem_codes, problems)) AS (seq, p)"
    ).where("seq IS NOT NULL").selectExpr("url", "bigint(seq) AS seq", "p.problem_codes AS code", "p.problems AS problem")


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.flat_audits(_audits(spark, sf_dir))


def _limited(**options) -> Callable[[SparkSession, str], DataFrame]:
    """The audit's rows under other options."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        limits = site_audit.AuditOptions(user_agent=AGENT, **options)
        return sinks.flat_audits(site_audit.audit(starts(spark, sf_dir), snapshot(spark, sf_dir), limits))

    return run


def audit_one_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of one site's audit: that of the alphabetically first start."""
    audits = stage(_audits(spark, sf_dir), "audits")
    path = _scratch(spark, "one-site")
    sinks.write_audit(audits, audits.agg(F.min("url")).first()[0], path)
    return lead_files.read_csv_records(spark, path)


# --- leads ------------------------------------------------------------------------------
def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name")
    customers = spread(table(spark, sf_dir, "customer"))
    return customers.join(nations, F.expr("c_nationkey = n_nationkey"), "left")


def leads_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _customers(spark, sf_dir).selectExpr(
        "c_custkey AS id", "if(c_custkey % 9 = 0, '', c_name) AS Business_Name",
        "concat('shop', c_custkey, '.test') AS HomePage", "n_name AS country",
        "c_mktsegment AS sector", "'ignored' AS tel", "c_acctbal AS other_phone", "'x' AS Title",
    )
    mapping = {"phone": "no_such_column", "address": "other_phone", "bogus": "id"}
    return lead_files.from_table(records, mapping)


def _customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).selectExpr(
        "c_custkey",
        """to_json(named_struct(
             'company', if(c_custkey % 9 = 0, '', c_name), 'slug', concat('c', c_custkey),
             'web', if(c_custkey % 5 = 0, NULL, concat('shop', c_custkey, '.test')),
             'town', array(n_name, 'other'), 'industry', c_mktsegment, 'lat', c_nationkey,
             'address', named_struct('street', 'Main'), 'email', if(c_custkey % 4 = 0, 'own@x.test', ''),
             'contact', named_struct(
               'emails', if(c_custkey % 3 = 0, array(), array(concat('a', c_custkey, '@b.test'), 'c@d.test')),
               'email', concat('single', c_custkey, '@b.test'),
               'phone', if(c_custkey % 2 = 0, c_custkey, NULL)))) AS doc""",
    )


def leads_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wrapped document per customer, read back as records."""
    documents = _customer_records(spark, sf_dir).selectExpr(
        "concat('{\"meta\": [1], \"none\": [], \"items\": [', doc, '], \"more\": [{}]}') AS value"
    )
    records = lead_files.records_of_documents(documents, "value")
    return lead_files.from_json_records(records, contact_from="contact")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/shopfront/{name}-{uuid.uuid4().hex}"


def leads_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "records") + ".jsonl"
    _customer_records(spark, sf_dir).selectExpr("doc").write.text(path)
    return lead_files.load(spark, path, contact_from="contact", mapping={"category": "slug"})


def _write_documents(lines: DataFrame, path: str, ending: str = "") -> None:
    """Text files, one a ``doc``, of the ``line``s in the order of ``ord``."""
    # as one value: else Spark takes a union of tables that each lie by ``doc`` to lie by it too, and leaves out
    # the dealing, though it then coalesces the two apart, so that a document's lines end up in two files
    ordered = lines.repartition(F.struct("doc")).sortWithinPartitions("doc", "ord")
    ordered.select("doc", F.concat("line", F.lit(ending)).alias("line")).write.partitionBy("doc").text(path)


def _enclosed(lines: DataFrame, before: str, after: str) -> DataFrame:
    """``lines`` with one more at either end of each document, and commas between."""
    comma = "if(row_number() OVER (PARTITION BY doc ORDER BY ord, line) = 1, '', ', ') || line AS line"
    ends = lines.select("doc").distinct().selectExpr("doc", f"inline(array(struct(-1L, {before}), struct(bigint(1e15), {after}))) AS (ord, line)")
    return lines.selectExpr("doc", "row_number() OVER (PARTITION BY doc ORDER BY ord, line) AS ord", comma).unionByName(ends)


def leads_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in ten long documents, lists and objects with other members, some keys repeated; every record
    on several lines."""
    path = _scratch(spark, "documents")
    records = _customer_records(spark, sf_dir).selectExpr(
        "c_custkey % 10 AS doc", "c_custkey AS ord",
        "replace(if(c_custkey % 7 = 0, concat('{\"company\": \"}{\", ', substr(doc, 2)), doc), ',', concat(',', chr(10), ' ')) AS line",
    )
    before = """CASE WHEN doc % 2 = 0 THEN '[' WHEN doc % 3 = 0 THEN '{"items": [{"company": "earlier"}], "no": {"x": {}}, "items": ['
        ELSE '{"meta": {"n]": [1, {"a": "\\\\\\""}]}, "none": [], "items": [' END"""
    _write_documents(_enclosed(records, before, "if(doc % 2 = 0, ']', '], \"more\": [{\"company\": \"later\"}]}')"), path)
    return lead_files.load(spark, path, fmt="json", contact_from="contact")


def leads_csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in files with their columns in different orders and under different names, line breaks in cells."""
    path = _scratch(spark, "folder")
    rows = _customers(spark, sf_dir).selectExpr(
        "c_custkey % 6 AS doc", "c_custkey AS ord",
        f"""concat('"', c_name, ', ""', c_custkey, '"" "') AS n""", f"""concat('"line 1', {inputs.NL}, {inputs.NL}, c_mktsegment, '"') AS a""",
        "n_name AS c", "if(c_custkey % 2 = 0, '', c_mktsegment) AS k", "string(c_custkey) AS i",
    ).selectExpr("doc", "ord", "CASE doc % 3 WHEN 0 THEN concat_ws(',', n, a, c, k, i) WHEN 1 THEN concat_ws(',', i, k, c, n, a) ELSE concat_ws(',', a, n, i) END AS line")
    headers = rows.select("doc").distinct().selectExpr(
        "doc", "-1L AS ord", "CASE doc % 3 WHEN 0 THEN 'company,ADDR,Country,kind,id' WHEN 1 THEN 'id,kind,Country,title,addr' ELSE 'addr,Name,slug' END AS line"
    )
    _write_documents(rows.unionByName(headers), path)
    mapping = {"category": "kind", "city": "absent"}
    return lead_files.load(spark, path, fmt="csv", mapping=mapping)


def leads_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a CSV file and loaded back with aliases and an override."""
    path = _scratch(spark, "customers")
    rows = _customers(spark, sf_dir).selectExpr(
        "concat(' ', c_name, ', \"', c_custkey, '\" ') AS company",
        f"concat('line 1', {inputs.NL}, c_mktsegment) AS addr", "n_name AS Country",
        "if(c_custkey % 2 = 0, NULL, c_mktsegment) AS kind", "c_custkey AS id",
    )
    sinks.write_csv(rows, ["company", "addr", "Country", "kind", "absent", "id"], path)
    return lead_files.load(spark, path, fmt="csv", mapping={"category": "kind", "city": "absent"})


# --- OSM --------------------------------------------------------------------------------
def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements made from customers, every seventh of them twice."""
    return _customers(spark, sf_dir).selectExpr(
        "element_at(array('node', 'way', 'relation', 'area'), int(c_custkey % 4 + 1)) AS type",
        "c_custkey AS id",
        "if(c_custkey % 4 = 1, NULL, c_custkey % 170 - 85.5D) AS lat",
        "if(c_custkey % 4 = 1, NULL, if(c_custkey % 10 = 0, 0D, c_custkey * 7 % 350 - 175.25D)) AS lon",
        """if(c_custkey % 3 = 0, NULL, named_struct('lat', c_custkey % 90 - 45.5D,
               'lon', c_custkey % 160 - 80.5D)) AS center""",
        """map_filter(map(
             if(c_custkey % 6 = 0, 'name:en', 'name'), if(c_custkey % 8 = 0, '', c_name),
             element_at(array('amenity', 'shop', 'office', 'craft', 'leisure', 'other'),
                        int(c_custkey % 6 + 1)), lower(c_mktsegment),
             if(c_custkey % 5 = 0, 'contact:website', 'url'),
               if(c_custkey % 7 = 0, '', concat('shop', c_custkey, '.test')),
             'addr:housenumber', if(c_custkey % 2 = 0, string(c_custkey % 100), ''),
             if(c_custkey % 3 = 0, 'addr:street', 'addr:full'), concat('Street ', n_name),
             if(c_custkey % 4 = 0, 'addr:city', 'addr:suburb'), n_name,
             'contact:phone', string(c_custkey), 'addr:country', n_name), (k, v) -> k <> 'other') AS tags""",
        "explode(if(c_custkey % 7 = 0, array(1, 2), array(1))) AS copy",
    ).drop("copy")


def osm_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.to_leads(_elements(spark, sf_dir))


def _element_documents(spark: SparkSession, sf_dir: str) -> str:
    """A path with documents of elements, some with another list, one without any element."""
    path = _scratch(spark, "elements")
    lines = _elements(spark, sf_dir).selectExpr("id % 4 AS doc", "id AS ord", "to_json(struct(type, id, lat, lon, center, tags)) AS line")
    before = """if(doc = 1, '{"version": 0.6, "remark": [{"type": "node", "id": 0, "tags": {"name": "no"}}], "elements": [', '{"elements": [')"""
    none = lines.limit(1).selectExpr("9L AS doc", "0L AS ord", "'{\"remark\": [{\"type\": \"node\"}], \"elements\": []}' AS line")
    _write_documents(_enclosed(lines, before, "']}'").unionByName(none.select("doc", "ord", "line")), path)
    return path


def osm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements from documents, as leads."""
    return osm.to_leads(osm_files.read_elements(spark, _element_documents(spark, sf_dir)))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes all over the globe, ways of three nodes whose centers lie elsewhere, relations of two ways and a node."""
    member = "named_struct('type', '{}', 'ref', id + {}, 'lat', cast(NULL AS double), 'lon', cast(NULL AS double), 'geometry', cast(NULL AS array<struct<lat:double,lon:double>>))"
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "explode(array_compact(array('node', if(c_custkey % 5 = 0, 'way', NULL), if(c_custkey % 25 = 0, 'relation', NULL)))) AS type",
    ).selectExpr(
        "type", "id", "if(type = 'node', id * 37 % 600 / 4D - 75, NULL) AS lat", "if(type = 'node', id * 91 % 1440 / 4D - 180, NULL) AS lon",
        "if(type = 'node', NULL, named_struct('lat', 89D, 'lon', 0D)) AS center", "map('name', concat(type, ' ', id), 'shop', 'x') AS tags",
        "if(type = 'way', array(id, id + 1, id + 2), NULL) AS nodes",
        f"if(type = 'relation', array({member.format('node', 3)}, {member.format('way', 0)}, {member.format('way', 5)}), NULL) AS members",
    )


def osm_shapes_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by their lines, in areas of which one lies over the date line."""
    areas = table(spark, sf_dir, "region").selectExpr(
        "r_name AS area", "r_regionkey * 10 - 30D AS south", "if(r_regionkey = 0, 170D, r_regionkey * 60 - 150D) AS west",
        "r_regionkey * 10 - 15D AS north", "if(r_regionkey = 0, -170D, r_regionkey * 60 - 120D) AS east",
    )
    return osm.elements_in_areas(_shapes(spark, sf_dir), areas).select("area", "type", "id")


def osm_shapes_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads whose lines touch a box over the date line."""
    return osm.find(_shapes(spark, sf_dir), ["shop=x"], bbox="-60,120,20,-120").select("source_id", "name")


def osm_area_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of an area by its name."""
    return osm.find(
        _elements(spark, sf_dir), ["amenity", "shop", "office=machinery"], area="area 2", places=_places(spark, sf_dir),
    )


def osm_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tags, a box, websites only, each element once."""
    return osm.find(
        _elements(spark, sf_dir), ["amenity=building", "shop", "craft="], bbox="-60,-120,60,120.5",
        category="chosen", website_only=True,
    )


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('area ', n_regionkey) AS area", "n_nationkey - 40D AS south",
        "n_nationkey * 3 - 90D AS west", "n_nationkey + 5D AS north", "n_nationkey * 4 - 20D AS east",
        "n_nationkey AS rank",
    )


def osm_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = osm.first_places(_places(spark, sf_dir))
    elements = _elements(spark, sf_dir).dropDuplicates(["type", "id"])
    return osm.elements_in_areas(elements, boxes).selectExpr("area", "type", "id", "lat", "lon")


def osm_unknown_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _customers(spark, sf_dir).selectExpr("concat('area ', c_nationkey % 9) AS area").distinct()
    return osm.unknown_areas(asked, _places(spark, sf_dir))


# --- leads with audits ------------------------------------------------------------------
def leads_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads made from pages: some without a site, some sharing one, all kept."""
    leads = table(spark, sf_dir, "pages").selectExpr(
        "page_id AS id", "concat('Shop ', page_id) AS name",
        f"CASE WHEN page_id % 6 = 0 THEN '' ELSE {inputs.START} END AS website",
        f"CASE WHEN page_id % 12 = 0 THEN {inputs.START} ELSE '' END AS url", "'lead title' AS title",
    )
    return audit_leads(leads, snapshot(spark, sf_dir), OPTIONS).drop("lead_no")


QUERIES = {
    "url_parts": url_parts,
    "url_resolve": url_resolve,
    "page_title": _fact("title"),
    "page_description": _fact("meta_description"),
    "page_head": page_head,
    "page_visible_chars": _fact("visible_chars", "bigint(visible_chars) AS visible_chars"),
    "page_links": _fact("links", "bigint(size(links)) AS n_links", f"{_joined('links')} AS links"),
    "page_anchors": _fact(
        "anchors", "bigint(size(anchors)) AS n_anchors",
        f"{_joined('anchors', 'concat(x.href, chr(62), x.text)')} AS anchors",
    ),
    "page_jsonld": _fact("ldjson_blobs", f"{_joined('ldjson_blobs')} AS blobs"),
    "page_form": _fact("has_form"),
    "page_weight": page_weight,
    "entity_text": entity_text,
    "page_detectors": page_detectors,
    "page_local_business": page_local_business,
    "page_loose_jsonld": page_loose_jsonld,
    "page_broken": page_broken,
    "document_detectors": document_booking,
    "document_emails": document_emails,
    "page_contacts": page_contacts,
    "site_emails": _site_list("emails"),
    "site_phones": _site_list("phones"),
    "site_whatsapp": _site_value("whatsapp_number"),
    "site_instagram": _site_value("instagram"),
    "site_presence": site_presence,
    "fetch_status": fetch_status,
    "robots_rules": robots_rules,
    "robots_sitemaps": robots_sitemaps,
    "robots_allowed": robots_allowed,
    "robots_many_rules": robots_many_rules,
    "sitemap_locations": sitemap_locations,
    "sitemap_expansion": sitemap_expansion,
    "crawl_candidates": crawl_candidates,
    "crawl_plan": crawl_plan,
    "https_status": https_status,
    "visited_pages": visited_pages,
    "site_found_on": site_found_on,
    "site_missing": site_missing,
    "site_problems": site_problems,
    "audit_rows": audit_rows,
    "audit_home_only": _limited(max_pages=1),
    "audit_three_pages": _limited(max_pages=3),
    "audit_without_sitemaps": _limited(check_sitemap=False),
    "audit_one_site": audit_one_site,
    "leads_table": leads_table,
    "leads_json": leads_json,
    "leads_json_lines": leads_json_lines,
    "leads_csv": leads_csv,
    "leads_json_files": leads_json_files,
    "leads_csv_folder": leads_csv_folder,
    "osm_leads": osm_leads,
    "osm_selected": osm_selected,
    "osm_documents": osm_documents,
    "osm_area_leads": osm_area_leads,
    "osm_shapes_in_areas": osm_shapes_in_areas,
    "osm_shapes_selected": osm_shapes_selected,
    "osm_in_areas": osm_in_areas,
    "osm_unknown_areas": osm_unknown_areas,
    "leads_audited": leads_audited,
}
