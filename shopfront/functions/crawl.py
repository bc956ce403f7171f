"""The crawl plan of a site, worked out inside the row that holds its links.

All candidates of a site come from its own home page and sitemap, so ranking, de-duplication
and the top-k cut are array operations on one row: no explode, no window, no shuffle.
"""

from __future__ import annotations

from shopfront.functions import fixed, urls
from shopfront.functions.text import fold_case, regex, strip

CANDIDATE = "struct<key:string,ord:bigint,rank:int,depth:int,url:string>"
SITEMAP_ORD = 2**40  # sitemap addresses come after every link


def rank(path: str, page_like: str, label: str) -> str:
    """0 contact or booking, 1 location, 2 about, NULL for anything else.

    The path counts when it is page-like, the label when it is short.
    """
    seen = f"if({page_like}, {fold_case(path)}, '')"
    short = f"if(length({label}) <= {fixed.MAX_LABEL_CHARS}, {fold_case(label)}, '')"
    cases = " ".join(
        f"WHEN {seen} RLIKE {regex(p)} OR {short} RLIKE {regex(p)} THEN {i}"
        for i, p in enumerate(fixed.PAGE_RANKS)
    )
    return f"CASE {cases} END"


def _names_a_page(text: str) -> str:
    """Does any page pattern occur? No pattern spans a slash, so what it needs to match a
    resolved path must stand in the link or in the path of its page. Most links fail here.
    """
    return f"{fold_case(text)} RLIKE {regex('|'.join(fixed.PAGE_RANKS))}"


def _candidates(base: str, items: str) -> str:
    """The (raw, label, ord) items that may be pages to visit, in order.

    A path that is not page-like only counts with rank 0, which its label must then give.
    """
    named = f"""({_names_a_page("translate(x.raw, '\\t\\r\\n', '') || ' ' || x.label")}
        OR {_names_a_page(urls.path(base))})"""
    full = f"""transform(filter({items}, x -> {named} AND {urls.is_page_href('x.raw')}),
        x -> named_struct(
        'full', {urls.resolve(base, 'x.raw')}, 'label', x.label, 'ord', x.ord))"""
    same_site = f"""{urls.scheme('x.full')} IN ('http', 'https')
        AND {urls.site_key('x.full')} = {urls.site_key(base)}"""
    paths = f"""transform(filter({full}, x -> {same_site}), x -> named_struct(
        'path', {urls.clean_path('x.full')}, 'query', {urls.query('x.full')},
        'label', x.label, 'ord', x.ord))"""
    pages = f"""transform(filter({paths}, x -> NOT {urls.is_asset('x.path')}), x -> named_struct(
        'x', x, 'page_like', {urls.is_page_like('x.path')}))"""
    ranked = f"""transform({pages}, p -> named_struct('x', p.x, 'page_like', p.page_like,
        'rank', {rank('p.x.path', 'p.page_like', 'p.x.label')}))"""
    return f"""transform(filter({ranked}, r -> r.rank = 0 OR (r.page_like AND r.rank IS NOT NULL)),
        r -> named_struct('key', regexp_replace(r.x.path, '/$', ''), 'ord', bigint(r.x.ord),
          'rank', r.rank, 'depth', size({urls.segments('r.x.path')}),
          'url', {urls.origin(base)} || r.x.path || if(r.x.query = '', '', '?' || r.x.query)))"""


def from_links(base: str, links: str) -> str:
    """Candidates among the (href, text) links of the page ``base``, in order."""
    items = f"""transform({links}, (l, at) -> named_struct(
        'raw', {strip('l.href')}, 'label', l.text, 'ord', at))"""
    return _candidates(base, items)


def from_locations(base: str, locs: str) -> str:
    """Candidates among (loc, at) sitemap addresses; they come after every link."""
    items = f"""transform({locs}, l -> named_struct(
        'raw', {strip('l.loc')}, 'label', '', 'ord', {SITEMAP_ORD} + l.at))"""
    return _candidates(base, items)


def depends_on_page(loc: str) -> str:
    """A relative address, whose meaning depends on the page it is resolved against."""
    return f"""transform(array({strip(loc)}), raw -> {urls.authority('raw')} = ''
        AND NOT startswith(raw, '/')
        AND {urls.scheme('raw')} IN ('', 'http', 'https'))[0]"""


def home_key(url: str) -> str:
    return f"regexp_replace({urls.clean_path(url)}, '/$', '')"


def best(candidates: str, excluded_key: str, limit: int | None = None) -> str:
    """The first of every key, ordered by rank, depth and first appearance, cut to ``limit``."""
    ordered = f"""transform(array_sort(transform(
        transform(array(array_sort(filter({candidates}, c -> c.key <> {excluded_key}))), cs ->
          filter(cs, (c, i) -> i = 0 OR get(cs, i - 1).key <> c.key))[0],
        c -> named_struct('rank', c.rank, 'depth', c.depth, 'ord', c.ord, 'c', c))),
        r -> r.c)"""
    return ordered if limit is None else f"slice({ordered}, 1, {limit})"
