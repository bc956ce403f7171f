"""The site audit: start URLs and a fetch log in, one audited row per site out.

Stages, each written once to the shared folder because later steps read it more than once:

1. ``facts``: one narrow row per fetch (a single pass over the bodies), laid out by URL, as every
   later join needs it;
2. ``homes``: which answer is the site's home page, with its facts;
3. ``origins``: robots rules, sitemaps and probes, once per scheme and host;
4. ``planned``: sites with their origin's data and their crawl plan.

The inner pages of a plan (at most ``max_pages - 1`` per site) are then looked up and gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.functions import crawl, findings, fixed, https, robots, urls
from shopfront.operators.fetch_facts import ANSWER_FACTS, fetch_facts
from shopfront.operators.lookup import lookup
from shopfront.operators.origins import origin_answers, origin_facts
from shopfront.sources import fetches as log
from shopfront.staging import lay_out, stage

_NO_STRINGS = "cast(array() AS array<string>)"
_HOME_FACTS = (
    "title", "meta_description", "has_viewport", "lang", "visible_chars", "page_weight_kb",
    "parked", "maintenance", "candidates",
)
_PAGE_FACTS = (
    *fixed.CHECKS, "emails", "phones", "whatsapp_number", "instagram",
)


@dataclass(frozen=True)
class AuditOptions:
    user_agent: str = "shopfront/0.1"
    check_sitemap: bool = True
    max_pages: int = fixed.MAX_PAGES


def start_urls(urls_table: DataFrame, column: str = "url") -> DataFrame:
    """Distinct URLs to audit, with the default scheme added; blank ones have no site."""
    return (
        urls_table.where(f"{column} <> ''")
        .selectExpr(f"{urls.with_default_scheme(column)} AS url")
        .distinct()
    )


def home_answers(
    starts: DataFrame, facts: DataFrame, kept: tuple[str, ...] = (*_HOME_FACTS, *_PAGE_FACTS)
) -> DataFrame:
    """Choose the answer that counts as the home page, and attach the facts that are ``kept``.

    When an https start failed and plain http answered, the http answer counts and the https
    error is kept. A URL that is not in the log did not respond. Only the starts that failed over https
    are looked up a second time.
    """
    columns = ("home_url", "status", "error", "load_time_ms", *kept)
    answer = facts.selectExpr("url AS _key", "final_url AS home_url", *columns[1:])
    # both addresses of a start are looked up in one pass over the log, then one of them is chosen
    asked = starts.selectExpr(
        "url", f"""inline(array_compact(array(struct(0 AS _rank, url AS _key),
            if({urls.scheme('url')} = 'https', struct(1 AS _rank, {https.plain_url('url')} AS _key), NULL))))"""
    )
    packed = F.struct(*columns, F.expr(f"coalesce({log.answered('status', 'error')}, false) AS answered"))
    one, other = (F.first(F.when(F.col("_rank") == rank, packed), ignorenulls=True) for rank in (0, 1))
    both = asked.join(answer, "_key", "left").groupBy("url").agg(one.alias("_one"), other.alias("_other"))
    failure = f"coalesce(nullif(_one.error, ''), '{fixed.ERROR_NO_RESPONSE}')"
    fell_back = "(NOT _one.answered AND coalesce(_other.answered, false))"
    chosen = both.selectExpr("url", f"if({fell_back}, _other, _one) AS _answer", f"if({fell_back}, {failure}, '') AS https_error")
    return chosen.selectExpr("url", "https_error", "_answer.*").selectExpr(
        "* EXCEPT (home_url, status, error, load_time_ms, answered)",
        "coalesce(home_url, url) AS home_url",
        "coalesce(status, 0) AS status",
        f"if(answered, '', coalesce(nullif(error, ''), '{fixed.ERROR_NO_RESPONSE}')) AS error",
        "coalesce(load_time_ms, 0D) AS load_time_ms",
        f"{urls.origin('url')} AS start_origin",
        f"{urls.origin('coalesce(home_url, url)')} AS home_origin",
    )


def _origins(homes: DataFrame) -> DataFrame:
    both = homes.selectExpr("explode(array_distinct(array(start_origin, home_origin))) AS origin")
    return both.distinct()


def known_sites(homes: DataFrame, origins: DataFrame, min_hot_rows: int = 1_000_000) -> DataFrame:
    """Sites with their state, HTTPS answers and everything else that ``origins`` knows."""
    start_rules = origins.selectExpr("origin AS start_origin", "rules AS _start_rules")
    of_home = origins.withColumnRenamed("origin", "home_origin")
    sites = lookup(homes, start_rules, "start_origin", min_hot_rows)
    sites = lookup(sites, of_home, "home_origin", min_hot_rows)
    state = f"""CASE WHEN NOT {robots.allows('_start_rules', 'url')} THEN 'robots_start'
        WHEN error <> '' THEN 'no_response'
        WHEN NOT {robots.allows('rules', 'home_url')} THEN 'robots_home' ELSE 'audited' END"""
    return sites.selectExpr(
        "* EXCEPT (https_error, probe_answered, probe_final_url, probe_error)",
        f"{state} AS state",
        f"{https.is_valid('home_url', 'https_error', 'probe_answered')} AS https",
        f"""{https.redirects('url', 'home_url', 'https_error', 'probe_answered',
                             'probe_final_url')} AS http_redirects_to_https""",
        f"{https.error('home_url', 'https_error', 'probe_answered', 'probe_error')} AS https_error",
    )


def plan_pages(
    homes: DataFrame, origins: DataFrame, options: AuditOptions, min_hot_rows: int = 1_000_000
) -> DataFrame:
    """Sites with their state, HTTPS answers, sitemap findings and the inner pages to look at."""
    known = known_sites(homes, origins, min_hot_rows).withColumn(
        "broken", F.expr("coalesce(parked OR maintenance OR status >= 400, false)")
    )
    use_sitemap = f"({str(options.check_sitemap).lower()} AND NOT broken AND state = 'audited')"
    nothing = f"cast(array() AS array<{crawl.CANDIDATE}>)"
    candidates = f"""concat(coalesce(candidates, {nothing}),
        if({use_sitemap}, concat(sitemap_pages,
           {crawl.from_locations('home_url', 'relative_locs')}), {nothing}))"""
    chosen = crawl.best(candidates, crawl.home_key("home_url"), options.max_pages - 1)
    allowed = f"filter({chosen}, c -> {robots.allows('rules', 'c.url')})"
    crawls = f"state = 'audited' AND NOT broken AND {options.max_pages} > 1"
    return known.selectExpr(
        "* EXCEPT (candidates, sitemap_pages, relative_locs, rules, _start_rules, declared,"
        " has_sitemap, points_to_http)",
        f"{use_sitemap} AND has_sitemap AS has_sitemap",
        f"{use_sitemap} AND https AND points_to_http AS sitemap_robots_http",
        f"""transform(if({crawls}, {allowed}, {nothing}), (c, i) ->
            named_struct('slot', i + 1, 'url', c.url)) AS plan""",
    )


def visited_pages(
    planned: DataFrame, facts: DataFrame, min_hot_rows: int = 1_000_000
) -> DataFrame:
    """Inner pages of every site in plan order, gathered per site: ``_inner`` and
    ``pages_failed``. A planned page that is not in the log failed.

    Shops under one host may all plan the same page; such rows stay where they are.
    """
    wanted = stage(planned.selectExpr("url", "inline(plan) AS (slot, _key)"), "wanted")
    looked = facts.selectExpr(
        "url AS _key", "final_url",
        f"{log.is_html_answer('status', 'error', 'content_type')} AS _read", *_PAGE_FACTS,
    )
    fields = ", ".join(f"'{name}', {name}" for name in _PAGE_FACTS)
    found = lookup(wanted, looked, "_key", min_hot_rows).selectExpr(
        "url",
        f"""named_struct('slot', slot, 'read', coalesce(_read, false),
            'path', {urls.path_query('if(coalesce(_read, false), final_url, _key)')},
            {fields}) AS page""",
    )
    # never more than max_pages - 1 rows per site, by the plan's own cut
    gathered = found.groupBy("url").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    return gathered.selectExpr(
        "url",
        "filter(pages, p -> p.read) AS _inner",
        "transform(filter(pages, p -> NOT p.read), p -> p.path) AS pages_failed",
    )


_LIVE = "state = 'audited'"
_SHOWN = "state IN ('audited', 'robots_home')"
_ANSWERS = (
    "url", "state", "home_url",
    f"{_SHOWN} AND https AS https",
    f"if({_SHOWN}, https_error, '') AS https_error",
    f"if({_SHOWN}, http_redirects_to_https, NULL) AS http_redirects_to_https",
    "if(state = 'robots_start', 0, status) AS status",
)


def _first(values: str) -> str:
    return f"coalesce(get(filter({values}, v -> v IS NOT NULL), 0), '')"


def gather(planned: DataFrame, visited: DataFrame, options: AuditOptions) -> DataFrame:
    """Merge the facts of a site's pages and word its findings."""
    fields = ", ".join(f"'{name}', {name}" for name in _PAGE_FACTS)
    home = f"""named_struct('slot', 0, 'read', true, 'path', {urls.path_query('home_url')},
        {fields})"""
    merged = planned.join(visited, "url", "left").selectExpr(
        f"* EXCEPT ({', '.join(_PAGE_FACTS)}, pages_failed)",
        f"coalesce(pages_failed, {_NO_STRINGS}) AS pages_failed",
        f"transform(if(_inner IS NULL, array({home}), concat(array({home}), _inner)), p ->"
        f" named_struct('key', {urls.page_key('p.path')}, 'p', p)) AS _pages",
    )
    # a redirect may land on a page that was seen before
    distinct = merged.withColumn(
        "_pages",
        F.expr(
            "transform(filter(_pages, (p, i) -> NOT exists(slice(_pages, 1, i),"
            " q -> q.key = p.key)), p -> p.p)"
        ),
    )
    live, shown = _LIVE, _SHOWN

    def listed(expression: str) -> str:
        return f"if({live}, {expression}, {_NO_STRINGS})"

    found_on = [
        f"{listed(f'transform(filter(_pages, p -> coalesce(p.{c}, false)), p -> p.path)')}"
        f" AS {c}_found_on"
        for c in fixed.CHECKS
    ]
    facts = distinct.selectExpr(
        *_ANSWERS,
        f"{live} AS fetched",
        "sitemap_robots_http",
        f"{live} AND has_viewport AS mobile_viewport",
        f"if({live}, title, '') AS title",
        f"if({live}, meta_description, '') AS meta_description",
        f"(state = 'no_response' OR ({live} AND broken)) AS broken_or_parked",
        f"if({shown}, page_weight_kb, 0D) AS page_weight_kb",
        "if(state = 'robots_start', 0D, load_time_ms) AS load_time_ms",
        "has_sitemap",
        "state IN ('robots_start', 'robots_home') AS robots_disallowed",
        f"if({live}, lang, '') AS lang",
        f"if({live}, visible_chars, 0) AS visible_text_chars",
        f"""{listed(f'slice(array_distinct(flatten(transform(_pages, p -> p.emails))), 1,'
                    f' {fixed.CONTACTS_KEPT})')} AS emails""",
        f"""{listed(f'slice(array_distinct(flatten(transform(_pages, p -> p.phones))), 1,'
                    f' {fixed.CONTACTS_KEPT})')} AS phones""",
        f"if({live}, {_first('transform(_pages, p -> p.whatsapp_number)')}, '') AS whatsapp_number",
        f"if({live}, {_first('transform(_pages, p -> p.instagram)')}, '') AS instagram",
        f"{listed('transform(_pages, p -> p.path)')} AS pages_checked",
        f"{listed('pages_failed')} AS pages_failed",
        *found_on,
        "if(state = 'no_response', error, '') AS error",
        "parked AS _parked", "maintenance AS _maintenance",
    )
    return word_findings(facts, options.check_sitemap)


def word_findings(sites: DataFrame, check_sitemap: bool) -> DataFrame:
    """Add presence flags, missing lists, problems and notes to merged site facts."""
    live = "state = 'audited'"
    flagged = sites.selectExpr(
        "*",
        "size(jsonld_found_on) > 0 AS has_jsonld_localbusiness",
        "size(maps_found_on) > 0 AS has_maps_link",
        "size(whatsapp_found_on) > 0 AS has_whatsapp_link",
        "size(booking_found_on) > 0 AS has_booking_link",
        "size(form_found_on) > 0 AS has_contact_form",
        f"if({live}, {findings.missing_sitewide()}, {_NO_STRINGS}) AS missing_sitewide",
        f"""if({live}, {findings.missing_home_only(urls.path_query('home_url'))}, {_NO_STRINGS})
            AS missing_home_only""",
    )
    worded = flagged.selectExpr(
        "*", f"{findings.problems(check_sitemap)} AS _problems", f"{findings.notes()} AS notes"
    )
    return worded.selectExpr(
        "* EXCEPT (_problems, _parked, _maintenance)",
        "transform(_problems, p -> p.code) AS problem_codes",
        "transform(_problems, p -> p.message) AS problems",
    )


def audit(
    starts: DataFrame, fetches: DataFrame, options: AuditOptions = AuditOptions()
) -> DataFrame:
    """Audit every start URL (column ``url``) against a fetch log, one typed row per URL.

    The log has one row per URL; one that has more is refused.
    """
    facts = lay_out(fetch_facts(fetches), "facts", "url")
    log.require_distinct(facts)
    return audit_facts(starts, facts, options)


def answers(
    starts: DataFrame, fetches: DataFrame, options: AuditOptions = AuditOptions()
) -> DataFrame:
    """How every start URL answers: its state and the three HTTPS questions, without a look at
    sitemaps, inner pages, or any body but those of robots files."""
    facts = lay_out(fetch_facts(fetches).select(*ANSWER_FACTS), "facts", "url")
    log.require_distinct(facts)
    homes = stage(home_answers(start_urls(starts), facts, kept=()), "homes")
    known = origin_answers(_origins(homes), facts, options.user_agent, sitemaps_too=False)
    return known_sites(homes, stage(known, "origins")).selectExpr(*_ANSWERS)


def audit_facts(
    starts: DataFrame, facts: DataFrame, options: AuditOptions = AuditOptions()
) -> DataFrame:
    """The audit from staged fetch facts, for logs that are already reduced."""
    homes = stage(home_answers(start_urls(starts), facts), "homes")
    origins = lay_out(
        origin_facts(_origins(homes), facts, options.user_agent, options.max_pages), "origins", "origin", dealt=True
    )
    planned = stage(plan_pages(homes, origins, options), "planned")
    return gather(planned, visited_pages(planned, facts), options)
