"""Sitemap files as expressions."""

from __future__ import annotations

from shopfront.functions import fixed, urls
from shopfront.functions.text import regex


def is_markup(body: str) -> str:
    """``<`` near the start: some kind of XML, not a plain-text error."""
    return f"contains(left(cast({body} AS string), {fixed.SITEMAP_HEAD_BYTES}), '<')"


def is_index(lowered: str) -> str:
    return f"contains({lowered}, '<sitemapindex')"


def locations(text: str) -> str:
    """Every ``<loc>`` value, in document order."""
    return f"regexp_extract_all({text}, {regex('(?i)' + fixed.SITEMAP_LOC)}, 1)"


def children(locs: str) -> str:
    """The first few children of an index: those naming pages before the rest."""
    return f"""slice(concat(filter({locs}, f -> contains(lower(f), 'page')),
        filter({locs}, f -> NOT contains(lower(f), 'page'))), 1, {fixed.SITEMAP_CHILDREN})"""


def points_to_http(found: str, any_url_of_site: str) -> str:
    """Does any address start with the site's host over plain http?"""
    host = urls.site_key(any_url_of_site)
    return f"""exists({found}, f -> startswith(lower(f), 'http://' || {host})
        OR startswith(lower(f), 'http://www.' || {host}))"""
