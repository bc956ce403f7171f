"""Tables around the crawl plan: candidates, chosen pages, robots rules.

Computed arrays are exploded by the outer forms, then filtered: for the plain forms the
optimizer puts a test of the array below, which would compute it several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shopfront.functions import crawl, robots


def candidates(homes: DataFrame) -> DataFrame:
    """Every qualifying link of the home pages (``url``, ``anchors``), one row each."""
    return homes.selectExpr(
        "url", f"inline_outer({crawl.from_links('url', 'anchors')})"
        " AS (key, ord, rank, depth, page_url)",
    ).where("key IS NOT NULL")


def crawl_plan(homes: DataFrame, max_pages: int) -> DataFrame:
    """The inner pages to look at, in order, for home pages (``url``, ``anchors``, ``locs``)."""
    numbered = "transform(locs, (l, i) -> named_struct('loc', l, 'at', i))"
    found = f"""concat({crawl.from_links('url', 'anchors')},
        {crawl.from_locations('url', numbered)})"""
    chosen = crawl.best(found, crawl.home_key("url"), max_pages - 1)
    listed = homes.selectExpr("url", f"posexplode_outer({chosen}) AS (slot, c)")
    return listed.where("slot IS NOT NULL").selectExpr(
        "url", "slot + 1 AS slot", "c.rank AS rank", "c.depth AS depth", "c.url AS page_url"
    )


def robots_rules(files: DataFrame, text: str = "text") -> DataFrame:
    """(origin, group_no, agents, seq, allow, path) of robots files (``origin``, text)."""
    return (
        files.selectExpr("origin", f"posexplode_outer({robots.groups(text)}) AS (group_no, g)")
        .where("group_no IS NOT NULL")
        .selectExpr("origin", "group_no", "g.agents AS agents", "posexplode_outer(g.rules) AS (seq, r)")
        .where("seq IS NOT NULL")
        .selectExpr("origin", "group_no", "agents", "seq", "r.allow AS allow", "r.path AS path")
    )
