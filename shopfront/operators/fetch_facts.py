"""Everything the audit needs from a fetch log, in one narrow pass over the bodies.

The bodies are the bulk of the data. They are read once, in place, without a shuffle; each row
becomes a small row of facts, and every later join and aggregate moves only those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.functions import contacts, crawl, detect, html, robots, sitemaps
from shopfront.functions.text import fold_lowered
from shopfront.sources import fetches as log

#: What the rows of origins are made of, for plans that look at no page: Spark then reads nothing else from bodies.
ORIGIN_FACTS = (
    "url", "final_url", "status", "error", "load_time_ms", "is_markup", "is_index", "locs", "robots_groups", "robots_sitemaps",
)
ANSWER_FACTS = ("url", "final_url", "status", "error", "load_time_ms", "robots_groups", "robots_sitemaps")
_NO_STRINGS = "cast(array() AS array<string>)"


def fetch_facts(fetches: DataFrame) -> DataFrame:
    """One row per fetch: the answer, the page facts, and the robots or sitemap content."""
    read = fetches.selectExpr(
        "url",
        "coalesce(final_url, url) AS final_url",
        "coalesce(status, 0) AS status",
        "error",
        "coalesce(elapsed_ms, 0D) AS elapsed_ms",
        f"{log.content_type('headers')} AS content_type",
        "coalesce(octet_length(body), 0) AS size",
        f"coalesce({sitemaps.is_markup('body')}, false) AS is_markup",
        f"coalesce({log.text('body')}, '') AS _text",
    )
    cased = read.selectExpr("*", "lower(_text) AS _lower").selectExpr(
        "*", f"{fold_lowered('_lower')} AS _folded"
    )
    parsed = html.with_nodes(cased, "_text")
    facts = {name: F.expr(sql) for name, sql in html.page_facts().items()}
    known = parsed.withColumns(facts)
    is_robots = "url LIKE '%/robots.txt' AND status = 200"
    return known.selectExpr(
        "url", "final_url", "status", "error", "content_type", "size", "is_markup",
        f"{html.load_time_ms('elapsed_ms')} AS load_time_ms",
        f"{html.page_weight_kb('size')} AS page_weight_kb",
        "title", "meta_description", "has_viewport", "lang", "visible_chars",
        # only the links worth a look are kept: were this a home page, these would be its plan
        f"{crawl.best(crawl.from_links('final_url', 'anchors'), crawl.home_key('final_url'))}"
        " AS candidates",
        f"{detect.linked('maps', '_folded', 'decoded_links')} AS maps",
        f"{detect.linked('whatsapp', '_folded', 'decoded_links')} AS whatsapp",
        f"{detect.linked('booking', '_folded', 'decoded_links')} AS booking",
        "has_form AS form",
        f"{detect.has_local_business('ldjson_blobs')} AS jsonld",
        f"({detect.is_parked('_lower')} OR {detect.is_placeholder('status', 'size')}) AS parked",
        f"{detect.is_maintenance('_lower', 'title')} AS maintenance",
        f"{contacts.emails('_text', 'links')} AS emails",
        f"{contacts.phones('links')} AS phones",
        f"{contacts.whatsapp_number('_folded')} AS whatsapp_number",
        f"{contacts.instagram('_text')} AS instagram",
        f"if(contains(_lower, '<loc>'), {sitemaps.locations('_text')}, {_NO_STRINGS}) AS locs",
        f"{sitemaps.is_index('_lower')} AS is_index",
        f"if({is_robots}, {robots.groups('_text')}, NULL) AS robots_groups",
        f"if({is_robots}, {robots.sitemaps('_text')}, NULL) AS robots_sitemaps",
    )
