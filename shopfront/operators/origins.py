"""What belongs to an origin (scheme and host) rather than to a page: robots, sitemaps, probes.

Each is worked out once per origin, however many sites share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.functions import crawl, fixed, https, robots, sitemaps
from shopfront.sources import fetches as log
from shopfront.staging import lay_out

_NO_STRINGS = "cast(array() AS array<string>)"


def origin_answers(origins: DataFrame, facts: DataFrame, user_agent: str, sitemaps_too: bool = True) -> DataFrame:
    """How each origin answers: ``rules`` for the agent and ``declared`` sitemaps (empty without a robots.txt), the host's
    root over the other scheme, and with ``sitemaps_too`` what lies at /sitemap.xml.

    All of an origin's addresses are looked up in one pass over the log.
    """
    asked = [("robots", "origin || '/robots.txt'"), ("probe", https.probe_url("origin"))]
    told = {
        "robots": "if(robots_groups IS NULL, NULL, struct(robots_groups AS groups, robots_sitemaps AS sitemaps))",
        "probe": f"struct({log.answered('status', 'error')} AS answered, final_url, error)",
    }
    if sitemaps_too:
        asked.append(("sitemap", f"origin || '{_SITEMAP}'"))
        told["sitemap"] = f"if({_THERE}, {_FILE}, NULL)"
    addresses = ", ".join(f"struct('{what}' AS _what, {url} AS _url)" for what, url in asked)
    known = origins.selectExpr("origin", f"inline(array({addresses}))").join(
        facts.selectExpr("url AS _url", *(f"{sql} AS _{what}" for what, sql in told.items())), "_url", "left"
    )
    gathered = known.groupBy("origin").agg(
        *(F.first(F.when(F.col("_what") == what, F.col(f"_{what}")), ignorenulls=True).alias(f"_{what}") for what in told)
    )
    return gathered.selectExpr(
        "origin",
        f"coalesce({robots.rules_for('_robots.groups', user_agent)}, cast(array() AS array<struct<allow:boolean,path:string>>)) AS rules",
        f"coalesce(_robots.sitemaps, {_NO_STRINGS}) AS declared",
        "coalesce(_probe.answered, false) AS probe_answered", "_probe.final_url AS probe_final_url", "_probe.error AS probe_error",
        *(["_sitemap AS first_sitemap"] if sitemaps_too else []),
    )


_SITEMAP = "/sitemap.xml"
_THERE = "(status = 200 AND is_markup)"
_FILE = f"struct(is_index, if(is_index, {sitemaps.children('locs')}, NULL) AS children)"


def with_sitemaps(origins: DataFrame, facts: DataFrame) -> DataFrame:
    """Replace ``first_sitemap`` by ``has_sitemap`` and ``locs``, from the first few sitemap files of each origin.

    Breadth first from /sitemap.xml and the ``declared`` files. Each round reads the first
    file of the queue not read yet; a failed read counts, a repeated address does not.

    Rounds need to know of a file only whether it is there, and the few children of an index. So they carry
    queues and meet narrow rows; the addresses in the files, which are the bulk, are fetched once at the end,
    for the files that were read.
    """
    there = facts.where(_THERE)
    files = there.selectExpr("url AS _key", f"{_FILE} AS _file")
    turn = origins.selectExpr(
        "origin", f"concat(array(origin || '{_SITEMAP}'), declared) AS _queue", f"{_NO_STRINGS} AS _done", f"{_NO_STRINGS} AS _read",
        "false AS has_sitemap", f"origin || '{_SITEMAP}' AS _next", "first_sitemap AS _file",
    )
    for left in reversed(range(fixed.SITEMAP_FILES)):
        found = "(_next IS NOT NULL AND _file IS NOT NULL)"
        queues = turn.selectExpr(
            "origin",
            f"if({found} AND _file.is_index, concat(_queue, _file.children), _queue) AS _queue",
            "if(_next IS NULL, _done, array_append(_done, _next)) AS _done",
            f"if({found} AND NOT _file.is_index, array_append(_read, _next), _read) AS _read",
            f"(has_sitemap OR {found}) AS has_sitemap",
        )
        if left:
            # an origin with nothing left keeps a key of its own, so spent rows do not pile up
            turn = queues.selectExpr(
                "*",
                "get(array_except(_queue, _done), 0) AS _next",
                "coalesce(get(array_except(_queue, _done), 0), origin) AS _key",
            ).join(files, "_key", "left").drop("_key")
    wanted = queues.selectExpr("origin", "has_sitemap", "posexplode_outer(_read) AS (_at, _url)").withColumn(
        "_key", F.coalesce("_url", "origin")
    )
    listed = wanted.join(there.selectExpr("url AS _key", "locs AS _locs"), "_key", "left").groupBy("origin").agg(
        F.first("has_sitemap").alias("has_sitemap"),
        F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_locs")))).alias("_files"),  # one a round at most
    )
    return origins.drop("first_sitemap").join(listed, "origin").selectExpr(
        "* EXCEPT (_files)", f"coalesce(flatten(transform(_files, f -> f._locs)), {_NO_STRINGS}) AS locs"
    )


def with_sitemap_findings(origins: DataFrame, max_pages: int) -> DataFrame:
    """Replace ``locs`` by what sites need of them.

    ``points_to_http`` is the http finding. ``sitemap_pages`` keeps the best ``max_pages``
    candidates: a site uses at most ``max_pages - 1``, one more may be its home page, and one
    that repeats a link is replaced by that link, which ranks no lower. ``relative_locs`` are
    the addresses that only a page can resolve.
    """
    numbered = "transform(locs, (l, i) -> named_struct('loc', l, 'at', i))"
    rooted = f"filter({numbered}, n -> NOT {crawl.depends_on_page('n.loc')})"
    sample = f"concat(declared, slice(locs, 1, {fixed.SITEMAP_HTTP_SAMPLE}))"
    return origins.selectExpr(
        "* EXCEPT (locs)",
        f"{sitemaps.points_to_http(sample, 'origin')} AS points_to_http",
        f"""{crawl.best(crawl.from_locations('origin', rooted), "'none'", max_pages)}
            AS sitemap_pages""",
        f"filter({numbered}, n -> {crawl.depends_on_page('n.loc')}) AS relative_locs",
    )


def origin_facts(
    origins: DataFrame, facts: DataFrame, user_agent: str, max_pages: int
) -> DataFrame:
    """One row per origin with everything its sites share."""
    known = lay_out(origin_answers(origins, facts, user_agent), "known", "origin", dealt=True)
    return with_sitemap_findings(with_sitemaps(known, facts), max_pages)
