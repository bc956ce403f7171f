"""The registered queries in plain SQL for DuckDB, worked out the relational way.

Where the library folds arrays inside a row, the SQL here unnests, joins and ranks, so the two
sides share inputs and fixed values but no method. HTML is read with the simple patterns that
suffice for the well-formed markup of the tables.
"""

from __future__ import annotations

from shopfront.functions import fixed
from shopfront.queries.inputs import HOME_SQL, HOST, NL, SNAPSHOT_SQL, START, START_SQL

SEP = "' | '"
AGENT_NAME = "shopfront"
_WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160))"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


# --- scalar helpers ---------------------------------------------------------------------
_REFERENCES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"),
    ("&nbsp;", " "), ("&#47;", "/"), ("&amp;", "&"),
)


def decode(text: str) -> str:
    """The references that occur in the tables; a named one may lack its semicolon."""
    for reference, character in _REFERENCES:
        pattern = reference if reference.startswith("&#") else reference + "?"
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(character)}, 'g')"
    return text


def strip(text: str) -> str:
    return f"trim({text}, {_WS})"


def attr(tag: str, name: str) -> str:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    groups = " || ".join(f"regexp_extract({tag}, {_q(pattern)}, {i})" for i in (1, 2, 3))
    return decode(f"({groups})")


def drop(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_q(pattern)}, {_q(by)}, 'g')"


_BLOCKS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_HIDDEN = _BLOCKS + r"|<noscript\b.*?</noscript\s*>"
_TAG = r"(?s)</?[a-zA-Z][^>]*>|<![^>]*>"


def tags(markup: str, name: str) -> str:
    return f"regexp_extract_all({markup}, {_q(rf'(?is)<{name}\b[^>]*>')})"


def joined(values: str) -> str:
    return f"coalesce(array_to_string({values}, {SEP}), '')"


# --- URLs -------------------------------------------------------------------------------
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {_q(_URL)}, {group})"


def scheme(url: str) -> str:
    return f"lower({url_part(url, 1)})"


def authority(url: str) -> str:
    return url_part(url, 2)


def origin(url: str) -> str:
    return f"concat({scheme(url)}, '://', {authority(url)})"


def site(url: str) -> str:
    return f"regexp_replace(lower({authority(url)}), '^www\\.', '')"


def path(url: str) -> str:
    return f"regexp_replace({url_part(url, 3)}, ';[^/]*$', '')"


def suffix(url: str) -> str:
    return f"CASE WHEN {url_part(url, 4)} = '' THEN '' ELSE concat('?', {url_part(url, 4)}) END"


def path_query(url: str) -> str:
    return f"concat(CASE WHEN {path(url)} = '' THEN '/' ELSE {path(url)} END, {suffix(url)})"


def clean(url: str) -> str:
    return drop(f"(CASE WHEN {path(url)} = '' THEN '/' ELSE {path(url)} END)", "/+", "/")


def no_slash(text: str) -> str:
    return f"regexp_replace({text}, '/$', '')"


def page_key(text: str) -> str:
    return f"coalesce(nullif({no_slash(drop(text, '/+', '/'))}, ''), '/')"


def segment_list(clean_path: str) -> str:
    return f"list_filter(string_split({clean_path}, '/'), lambda s: s <> '')"


def page_like(clean_path: str) -> str:
    hyphens = f"lambda s: length(s) - length(replace(s, '-', '')) > {fixed.MAX_HYPHENS}"
    return f"""(length({clean_path}) <= {fixed.MAX_PATH_CHARS}
        AND len({segment_list(clean_path)}) <= {fixed.MAX_SEGMENTS}
        AND len(list_filter({segment_list(clean_path)}, {hyphens})) = 0)"""


def asset(clean_path: str) -> str:
    ends = [f"ends_with(lower({clean_path}), {_q('.' + s)})" for s in fixed.ASSET_SUFFIXES]
    return "(" + " OR ".join(ends) + ")"


def page_href(href: str) -> str:
    return f"({href} <> '' AND NOT regexp_matches({href}, {_q(fixed.NOT_PAGE_HREF)}, 'i'))"


def resolve(base: str, href: str) -> str:
    """Resolution without dot segments, which the tables do not have."""
    bare = f"regexp_replace({href}, '#.*$', '')"
    here = f"concat({scheme(base)}, '://', {authority(base)})"
    folder = f"regexp_replace({path(base)}, '[^/]*$', '')"
    merged = drop(f"concat('/', {folder}, {bare})", "^/+", "/")
    same_page = f"""CASE WHEN {bare} = '' THEN concat({here}, {url_part(base, 3)}, {suffix(base)})
        ELSE concat({here}, {url_part(base, 3)}, {bare}) END"""
    return f"""CASE WHEN regexp_matches({bare}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {bare}
        WHEN starts_with({bare}, '//') THEN concat({scheme(base)}, ':', {bare})
        WHEN starts_with({bare}, '/') THEN concat({here}, {bare})
        WHEN {bare} = '' OR starts_with({bare}, '?') THEN {same_page}
        ELSE concat({here}, {merged}) END"""


# --- page facts -------------------------------------------------------------------------
def facts_of(source: str, text: str, key: str) -> str:
    """CTEs ``page_tags`` and ``page_facts`` over ``source``."""
    description = "lambda m: lower(" + attr("m", "name") + ") = 'description'"
    viewport = "lambda m: lower(" + attr("m", "name") + ") = 'viewport'"
    real = "lambda f: NOT (f.kind = 'input' AND f.type IN " + _in(fixed.NOT_REAL_INPUTS) + ")"
    field = rf"(?is)<(?:input|select|textarea)\b[^>]*>"
    kind = "lower(regexp_extract(x, '^<([a-zA-Z]+)', 1))"
    fields = f"""list_filter(list_transform(regexp_extract_all(f, {_q(field)}), lambda x:
        {{'kind': {kind}, 'type': lower({attr('x', 'type')})}}), {real})"""
    form = f"""(len(list_filter({fields}, lambda y: y.kind = 'textarea')) > 0
        OR len({fields}) + CASE WHEN lower({attr("regexp_extract(f, '^<[^>]*>')", 'role')}) = 'search'
           THEN {fixed.SEARCH_FORM_START} ELSE 0 END >= {fixed.REAL_FIELDS})"""
    anchor = r"(?is)<a\b[^>]*>.*?</a\s*>"
    blob = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"
    label = drop("regexp_replace(a, '(?is)^<a[^>]*>|</a\\s*>$', '', 'g')", "<[^>]*>")
    return f"""page_tags AS MATERIALIZED (
        SELECT *, {drop(text, _BLOCKS, '<x>')} AS shown, {drop(text, _HIDDEN, '<x>')} AS visible
        FROM {source}),
    page_lists AS MATERIALIZED (
        SELECT *, {tags('shown', 'meta')} AS metas, {tags('shown', 'html')} AS htmls,
          list_filter(list_transform({tags('shown', 'a')}, lambda a: {attr('a', 'href')}),
                      lambda h: h <> '') AS links,
          list_filter(list_transform(regexp_extract_all(shown, {_q(anchor)}), lambda a:
            {{'href': {attr("regexp_extract(a, '^<[^>]*>')", 'href')},
              'text': {strip(drop(decode(label), '[\\s\\x{00a0}]+', ' '))}}}), lambda a: a.href <> '') AS anchors,
          regexp_extract_all(shown, '(?is)<form\\b.*?</form\\s*>') AS forms,
          list_filter(regexp_extract_all({drop(text, '(?is)<!--.*?-->')}, {_q(blob)}, 1),
                      lambda b: b <> '') AS blobs
        FROM page_tags),
    page_facts AS MATERIALIZED (
        SELECT {key}, links, anchors, blobs,
          {strip(decode("coalesce(array_to_string(regexp_extract_all(shown, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), ''), '')"))} AS title,
          coalesce({strip(attr(f'list_last(list_filter(metas, {description}))', 'content'))}, '') AS meta_description,
          len(list_filter(metas, {viewport})) > 0 AS has_viewport,
          coalesce(lower({attr('list_last(htmls)', 'lang')}), '') AS lang,
          CAST(coalesce(list_sum(list_transform(regexp_split_to_array(visible, {_q(_TAG)}),
            lambda t: length({strip(decode('t'))}))), 0) AS BIGINT) AS visible_chars,
          len(list_filter(forms, lambda f: {form})) > 0 AS form,
          {linked('maps', text)} AS maps, {linked('whatsapp', text)} AS whatsapp,
          {linked('booking', text)} AS booking,
          {parked(text)} AS parked_text,
          contains(lower({text}), '{fixed.MAINTENANCE_TEXT}') AS maintenance_text,
          {emails(text, 'links')} AS emails, {phones('links')} AS phones,
          nullif(regexp_extract({text}, {_q(fixed.WHATSAPP_NUMBER)}, 1, 'i'), '') AS whatsapp_number,
          {instagram(text)} AS instagram
        FROM page_lists)"""


_LINKED = {"maps": fixed.MAPS, "whatsapp": fixed.WHATSAPP, "booking": fixed.BOOKING}


def linked(check: str, text: str, links: str = "links") -> str:
    pattern = _q(_LINKED[check])
    return f"""(regexp_matches({text}, {pattern}, 'i') OR
        len(list_filter({links}, lambda l: regexp_matches(l, {pattern}, 'i'))) > 0)"""


def parked(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {_q(m)})" for m in fixed.PARKED) + ")"


def emails(text: str, links: str | None) -> str:
    """First distinct addresses of a page; the earliest position of each counts."""
    found = f"regexp_extract_all({text}, {_q(fixed.EMAIL)})"
    if links:
        mail = f"""list_filter({links}, lambda l: starts_with(lower(l), 'mailto:'))"""
        written = f"string_split(substr(l, 8), '?')[1]"
        found = f"""list_concat(flatten(list_transform({mail}, lambda l:
            regexp_extract_all({written}, {_q(fixed.EMAIL)}))), {found})"""
    bad = " OR ".join(f"ends_with(e, {_q(s)})" for s in fixed.EMAIL_BAD_SUFFIXES)
    kept = f"""list_filter(list_transform({found}, lambda e: lower(trim(e, '.'))), lambda e:
        NOT ({bad}) AND string_split(e, '@')[2] NOT IN {_in(fixed.EMAIL_BAD_DOMAINS)})"""
    return f"{_in_order(kept)}[1:{fixed.CONTACTS_KEPT}]"


def _in_order(values: str) -> str:
    """Distinct values in order of first occurrence."""
    return f"""list_filter({values}, lambda v, i: list_position({values}, v) = i)"""


def phones(links: str) -> str:
    digits = f"""list_filter(list_transform(list_filter({links}, lambda l: starts_with(lower(l), 'tel:')),
        lambda l: regexp_replace(substr(l, 5), '[^\\p{{Nd}}+]', '', 'g')), lambda p: p <> '')"""
    return _in_order(digits)


def instagram(text: str) -> str:
    handle = f"regexp_extract({text}, {_q(fixed.INSTAGRAM)}, 1)"
    return f"""CASE WHEN {handle} = '' OR lower({handle}) IN {_in(fixed.INSTAGRAM_RESERVED)} THEN NULL
        ELSE concat('https://www.instagram.com/', {handle}) END"""


def local_business(source: str, key: str) -> str:
    """CTE ``local_business``: keys with a LocalBusiness object, up to two @graph levels down."""
    names = f"""(contains(ty, '{fixed.LOCAL_BUSINESS}') OR ty IN {_in(fixed.LOCAL_BUSINESS_SUBTYPES)})"""
    return f"""ld_top AS (
        SELECT {key}, unnest(CASE WHEN json_type(b) = 'ARRAY' THEN json_extract(b, '$[*]') ELSE [b::JSON] END) AS j
        FROM (SELECT {key}, unnest(blobs) AS b FROM {source}) WHERE json_valid(b)),
    ld_one AS (SELECT {key}, unnest(json_extract(j, '$."@graph"[*]')) AS j FROM ld_top),
    ld_two AS (SELECT {key}, unnest(json_extract(j, '$."@graph"[*]')) AS j FROM ld_one),
    ld_types AS (
        SELECT {key}, unnest(CASE WHEN json_type(t) = 'ARRAY' THEN json_extract_string(t, '$[*]')
                             ELSE [json_extract_string(t, '$')] END) AS ty
        FROM (SELECT {key}, json_extract(j, '$."@type"') AS t FROM
              (FROM ld_top UNION ALL FROM ld_one UNION ALL FROM ld_two)) WHERE t IS NOT NULL),
    local_business AS MATERIALIZED (SELECT DISTINCT {key} FROM ld_types WHERE {names})"""


_HOME_FACTS = f"{HOME_SQL}, {facts_of('home', 'html', 'page_id, url, html')}"
_HOME_LD = f"{_HOME_FACTS}, {local_business('page_facts', 'page_id')}"


def _facts(select: str, with_: str = _HOME_FACTS) -> str:
    return f"WITH {with_} SELECT {select}"


# --- robots and sitemaps ----------------------------------------------------------------
def _robots_ctes() -> str:
    value = "trim(substr(bare, instr(bare, ':') + 1))"
    return f"""robots_files AS (
        SELECT {origin('url')} AS origin, body FROM log WHERE ends_with(url, '/robots.txt') AND status = 200),
    robots_lines AS MATERIALIZED (
        SELECT origin, no, line, trim(regexp_replace(line, '#.*$', '')) AS bare
        FROM robots_files, unnest(string_split(body, {NL})) WITH ORDINALITY AS u(line, no)),
    robots_sitemaps AS MATERIALIZED (
        SELECT origin, row_number() OVER (PARTITION BY origin ORDER BY no) - 1 AS seq,
               trim(substr(line, 9)) AS sitemap
        FROM robots_lines WHERE starts_with(lower(line), 'sitemap:')),
    robots_kinds AS (
        SELECT origin, no, {value} AS value,
          CASE WHEN line = '' THEN 'blank' WHEN NOT contains(bare, ':') THEN NULL
               WHEN lower(trim(split_part(bare, ':', 1))) = 'user-agent' THEN 'agent'
               WHEN lower(trim(split_part(bare, ':', 1))) IN ('allow', 'disallow', 'crawl-delay', 'request-rate')
               THEN lower(trim(split_part(bare, ':', 1))) END AS kind
        FROM robots_lines),
    robots_blocks AS (
        SELECT *, sum(CASE WHEN kind = 'blank' THEN 1 ELSE 0 END) OVER w AS block,
          lag(kind) OVER w AS before
        FROM robots_kinds WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY origin ORDER BY no)),
    robots_groups AS (
        SELECT *, sum(CASE WHEN kind = 'agent' AND coalesce(before, 'blank') <> 'agent' THEN 1 ELSE 0 END)
          OVER (PARTITION BY origin, block ORDER BY no) AS part
        FROM robots_blocks WHERE kind <> 'blank'),
    robots_entries AS (
        SELECT origin, block, part, min(no) AS first_no,
          list(value ORDER BY no) FILTER (kind = 'agent') AS agents
        FROM robots_groups WHERE part > 0 GROUP BY ALL HAVING count(*) FILTER (kind <> 'agent') > 0),
    robots_numbered AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY origin ORDER BY first_no) - 1 AS group_no FROM robots_entries),
    robots_rules AS MATERIALIZED (
        SELECT n.origin, n.group_no, n.agents,
          row_number() OVER (PARTITION BY n.origin, n.group_no ORDER BY g.no) - 1 AS seq,
          g.kind = 'allow' OR g.value = '' AS allow, g.value AS path
        FROM robots_numbered n JOIN robots_groups g USING (origin, block, part)
        WHERE g.kind IN ('allow', 'disallow')),
    robots_choice AS MATERIALIZED (
        SELECT origin, coalesce(
          min(group_no) FILTER (NOT list_contains(agents, '*')
            AND len(list_filter(agents, lambda a: contains('{AGENT_NAME}', lower(a)))) > 0),
          min(group_no) FILTER (list_contains(agents, '*'))) AS group_no
        FROM robots_numbered GROUP BY origin),
    robots_active AS MATERIALIZED (SELECT r.* FROM robots_rules r JOIN robots_choice USING (origin, group_no))"""


def _target(url: str) -> str:
    behind = f"regexp_replace({url}, '^[a-z]+://[^/?#]*', '')"
    return f"CASE WHEN {behind} = '' THEN '/' ELSE {behind} END"


def allowed(source: str, url: str, name: str, keys: str) -> str:
    """CTE giving the robots decision for the URLs of a table."""
    return f"""{name} AS MATERIALIZED (
        SELECT {keys}, coalesce(arg_min(r.allow, r.seq), true) AS allowed
        FROM (SELECT DISTINCT {keys}, {url} AS _u FROM {source}) s
        LEFT JOIN robots_active r
          ON r.origin = {origin('s._u')} AND starts_with({_target('s._u')}, r.path)
        GROUP BY ALL)"""


def _locs(body: str) -> str:
    return f"regexp_extract_all({body}, {_q('(?i)' + fixed.SITEMAP_LOC)}, 1)"


def _children(locs: str) -> str:
    named = "contains(lower(f), 'page')"
    return f"""list_concat(list_filter({locs}, lambda f: {named}),
        list_filter({locs}, lambda f: NOT {named}))[1:{fixed.SITEMAP_CHILDREN}]"""


_SITEMAP_FILES = f"""sitemap_files AS MATERIALIZED (
    SELECT url, contains(lower(body), '<sitemapindex') AS is_index, {_locs('body')} AS locs,
      {_children(_locs('body'))} AS kids
    FROM log WHERE status = 200 AND contains(substr(body, 1, {fixed.SITEMAP_HEAD_BYTES}), '<'))"""


def _sitemap_ctes(origins: str) -> str:
    """The file read in each round, by rank among the addresses known so far."""
    ctes = f"""{_SITEMAP_FILES},
    queue0 AS MATERIALIZED (
        SELECT origin, 0 AS lvl, 0 AS pos, concat(origin, '/sitemap.xml') AS url FROM {origins}
        UNION ALL SELECT o.origin, 0, 1 + seq, sitemap FROM {origins} o JOIN robots_sitemaps USING (origin)),
    read0 AS (SELECT NULL::VARCHAR AS origin, NULL::VARCHAR AS url, NULL::INT AS round WHERE false)"""
    for i in range(fixed.SITEMAP_FILES):
        ctes += f""",
    read{i + 1} AS MATERIALIZED (
        SELECT * FROM read{i} UNION ALL
        SELECT origin, arg_min(url, lvl * 100000 + pos), {i} FROM queue{i} q
        WHERE NOT EXISTS (SELECT 1 FROM read{i} r WHERE r.origin = q.origin AND r.url = q.url) GROUP BY origin),
    queue{i + 1} AS MATERIALIZED (
        SELECT * FROM queue{i} UNION ALL
        SELECT r.origin, {i + 1}, k.pos, k.kid FROM read{i + 1} r JOIN sitemap_files f USING (url),
          unnest(f.kids) WITH ORDINALITY AS k(kid, pos) WHERE r.round = {i} AND f.is_index)"""
    last = f"read{fixed.SITEMAP_FILES}"
    return ctes + f""",
    sitemap_locs AS MATERIALIZED (
        SELECT r.origin, row_number() OVER (PARTITION BY r.origin ORDER BY r.round, k.pos) AS place, k.loc
        FROM {last} r JOIN sitemap_files f USING (url), unnest(f.locs) WITH ORDINALITY AS k(loc, pos)
        WHERE NOT f.is_index),
    sitemap_found AS MATERIALIZED (
        SELECT o.origin, count(f.url) > 0 AS has_sitemap
        FROM {origins} o LEFT JOIN {last} r USING (origin) LEFT JOIN sitemap_files f USING (url) GROUP BY o.origin),
    sitemap_http AS MATERIALIZED (
        SELECT o.origin, coalesce(bool_or(starts_with(lower(a.u), concat('http://', {site('o.origin')}))
            OR starts_with(lower(a.u), concat('http://www.', {site('o.origin')}))), false) AS points_to_http
        FROM {origins} o LEFT JOIN (
          SELECT origin, sitemap AS u FROM robots_sitemaps
          UNION ALL SELECT origin, loc FROM sitemap_locs WHERE place <= {fixed.SITEMAP_HTTP_SAMPLE}) a USING (origin)
        GROUP BY o.origin)"""


# --- crawl plan -------------------------------------------------------------------------
def _plan_ctes(links: str, home: str, keep: int) -> str:
    """CTEs from a table (key columns, home_url, ord, href, label) to the ranked candidates."""
    ranks = " ".join(
        f"WHEN ({page_like('pth')} AND regexp_matches(pth, {_q(p)}, 'i')) OR"
        f" (length(label) <= {fixed.MAX_LABEL_CHARS} AND regexp_matches(label, {_q(p)}, 'i')) THEN {i}"
        for i, p in enumerate(fixed.PAGE_RANKS)
    )
    return f"""plan_urls AS MATERIALIZED (
        SELECT *, {resolve('home_url', 'href')} AS full_url
        FROM (SELECT * REPLACE ({strip('href')} AS href) FROM {links}) WHERE {page_href('href')}),
    plan_paths AS MATERIALIZED (
        SELECT *, {clean('full_url')} AS pth FROM plan_urls
        WHERE {scheme('full_url')} IN ('http', 'https') AND {site('full_url')} = {site('home_url')}),
    plan_ranked AS MATERIALIZED (
        SELECT *, CASE {ranks} END AS rank, len({segment_list('pth')}) AS depth, {no_slash('pth')} AS key,
          concat({origin('home_url')}, pth, {suffix('full_url')}) AS page_url
        FROM plan_paths WHERE NOT {asset('pth')}),
    plan_candidates AS MATERIALIZED (
        SELECT * FROM plan_ranked WHERE rank = 0 OR (rank IS NOT NULL AND {page_like('pth')})),
    plan_first AS MATERIALIZED (
        SELECT * FROM plan_candidates WHERE key <> {no_slash(clean('home_url'))}
        QUALIFY row_number() OVER (PARTITION BY {home}, key ORDER BY ord) = 1),
    plan AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY {home} ORDER BY rank, depth, ord) AS slot
        FROM plan_first QUALIFY slot <= {keep})"""


# --- the audit --------------------------------------------------------------------------
_LOG_FACTS = f"""{SNAPSHOT_SQL}, {facts_of(
    'log', 'body', 'url, final_url, status, content_type, body, elapsed_ms, error')},
    {local_business('page_facts', 'url')},
    facts AS MATERIALIZED (
      SELECT f.*, l.url IS NOT NULL AS jsonld,
        parked_text OR (status < 400 AND strlen(body) < {fixed.PLACEHOLDER_BYTES}) AS parked,
        maintenance_text OR contains(lower(title), '{fixed.MAINTENANCE_TITLE}') AS maintenance
      FROM page_facts f LEFT JOIN local_business l USING (url))"""
_ANSWERED = "({0}.status <> 0 AND {0}.error IS NULL)"
_PAGES_KEPT = fixed.MAX_PAGES - 1


def _audit_ctes(pages_kept: int = _PAGES_KEPT, check_sitemap: bool = True) -> str:
    """``check_sitemap`` false: no addresses, no finding and no problem from sitemaps."""
    sitemaps_count = str(check_sitemap).lower()
    ok = lambda alias: f"coalesce({_ANSWERED.format(alias)}, false)"
    path_of = path_query("home_url")
    checks = ", ".join(fixed.CHECKS)
    found = ", ".join(
        f"""coalesce(string_agg(path, ' ' ORDER BY page_no) FILTER ({c}), '') AS {c}_found_on,
        coalesce(list(path ORDER BY page_no) FILTER ({c}), []) AS {c}_list"""
        for c in fixed.CHECKS
    )
    return f"""{_LOG_FACTS}, {START_SQL}, {_robots_ctes()},
    start_list AS MATERIALIZED (
        SELECT DISTINCT CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN url
                        ELSE concat('https://', url) END AS start_url FROM starts),
    answers AS MATERIALIZED (
        SELECT s.start_url, NOT {ok('a')} AND {ok('b')} AND {scheme('s.start_url')} = 'https' AS fell_back,
          coalesce(a.error, '{fixed.ERROR_NO_RESPONSE}') AS first_error, b.url AS plain
        FROM start_list s LEFT JOIN log a ON a.url = s.start_url
        LEFT JOIN log b ON b.url = concat('http://', {authority('s.start_url')},
             CASE WHEN {path('s.start_url')} = '' THEN '/' ELSE {path('s.start_url')} END)),
    homes AS MATERIALIZED (
        SELECT a.start_url, CASE WHEN fell_back THEN first_error ELSE '' END AS fall_error,
          f.* EXCLUDE (url, final_url, error, status), coalesce(f.final_url, a.start_url) AS home_url,
          coalesce(f.status, 0) AS status,
          CASE WHEN {ok('f')} THEN '' ELSE coalesce(f.error, '{fixed.ERROR_NO_RESPONSE}') END AS error
        FROM answers a LEFT JOIN facts f ON f.url = CASE WHEN fell_back THEN a.plain ELSE a.start_url END),
    home_origins AS MATERIALIZED (SELECT DISTINCT {origin('home_url')} AS origin FROM homes),
    {_sitemap_ctes('home_origins')},
    {allowed('homes', 'start_url', 'start_allowed', 'start_url')},
    {allowed('homes', 'home_url', 'home_allowed', 'home_url')},
    states AS MATERIALIZED (
        SELECT h.*, CASE WHEN NOT sa.allowed THEN 'robots_start' WHEN h.error <> '' THEN 'no_response'
            WHEN NOT ha.allowed THEN 'robots_home' ELSE 'audited' END AS state,
          coalesce(h.parked OR h.maintenance OR h.status >= 400, false) AS broken,
          {scheme('h.home_url')} AS home_scheme, {ok('p')} AS probed, p.final_url AS probe_final,
          coalesce(p.error, '{fixed.ERROR_NO_HTTPS}') AS probe_error
        FROM homes h JOIN start_allowed sa USING (start_url) JOIN home_allowed ha ON ha.home_url = h.home_url
        LEFT JOIN log p ON p.url = concat(CASE WHEN {scheme('h.home_url')} = 'https' THEN 'http' ELSE 'https' END,
             '://', {authority('h.home_url')}, '/')),
    secured AS MATERIALIZED (
        SELECT s.*, {sitemaps_count} AND m.has_sitemap AND state = 'audited' AND NOT broken AS has_sitemap,
          home_scheme = 'https' OR (fall_error = '' AND probed) AS https,
          CASE WHEN home_scheme = 'https' AND {scheme('start_url')} = 'http' THEN true
               WHEN home_scheme = 'https' AND probed THEN {scheme('probe_final')} = 'https'
               WHEN home_scheme = 'http' AND fall_error = '' AND probed THEN false END AS redirects,
          CASE WHEN home_scheme = 'http' AND fall_error = '' AND NOT probed THEN probe_error
               ELSE fall_error END AS https_error,
          {sitemaps_count} AND points_to_http AND state = 'audited' AND NOT broken
            AND (home_scheme = 'https' OR (fall_error = '' AND probed)) AS sitemap_robots_http
        FROM states s JOIN sitemap_found m ON m.origin = {origin('s.home_url')}
        JOIN sitemap_http t ON t.origin = m.origin),
    audit_links AS MATERIALIZED (
        SELECT start_url, home_url, a.ord AS ord, a.a.href AS href, a.a.text AS label
        FROM secured, unnest(anchors) WITH ORDINALITY AS a(a, ord) WHERE state = 'audited' AND NOT broken
        UNION ALL SELECT start_url, home_url, 1000000000 + l.place, l.loc, ''
        FROM secured JOIN sitemap_locs l ON l.origin = {origin('home_url')} WHERE {sitemaps_count} AND state = 'audited' AND NOT broken),
    {_plan_ctes('audit_links', 'start_url', pages_kept)},
    {allowed('plan', 'page_url', 'plan_allowed', 'page_url')},
    looked AS MATERIALIZED (
        SELECT p.start_url, p.slot, p.page_url, f.*,
          coalesce(f.error IS NULL AND f.status < 400 AND f.url IS NOT NULL
            AND (coalesce(f.content_type, '') = '' OR contains(lower(f.content_type), 'html')), false) AS readable
        FROM plan p JOIN plan_allowed USING (page_url) LEFT JOIN facts f ON f.url = p.page_url
        WHERE plan_allowed.allowed),
    pages_all AS MATERIALIZED (
        SELECT start_url, 0 AS page_no, {path_of} AS path, {checks}, emails, phones, whatsapp_number, instagram
        FROM secured WHERE state = 'audited'
        UNION ALL SELECT start_url, slot, {path_query('final_url')}, {checks}, emails, phones, whatsapp_number, instagram
        FROM looked WHERE readable),
    visited AS MATERIALIZED (
        SELECT *, {page_key('path')} AS pkey FROM pages_all
        QUALIFY row_number() OVER (PARTITION BY start_url, pkey ORDER BY page_no) = 1),
    failed AS MATERIALIZED (
        SELECT start_url, string_agg({path_query('page_url')}, ' ' ORDER BY slot) AS pages_failed
        FROM looked WHERE NOT readable GROUP BY start_url),
    visit_lists AS MATERIALIZED (
        SELECT start_url, count(*) AS n_pages, string_agg(path, ' ' ORDER BY page_no) AS pages_checked,
          string_agg(path, ', ' ORDER BY page_no) AS pages_listed, {found},
          arg_min(whatsapp_number, page_no) FILTER (whatsapp_number IS NOT NULL) AS whatsapp_number,
          arg_min(instagram, page_no) FILTER (instagram IS NOT NULL) AS instagram
        FROM visited GROUP BY start_url),
    {_site_top('visited', 'start_url', 'page_no', 'emails', 'site_emails')},
    {_site_top('visited', 'start_url', 'page_no', 'phones', 'site_phones')},
    audits AS MATERIALIZED (
        SELECT s.start_url AS url, s.state, s.home_url, s.state = 'audited' AS fetched,
          s.state IN ('audited', 'robots_home') AS known, s.https, s.redirects, s.https_error, s.status, s.error,
          s.has_viewport, s.title, s.meta_description, s.broken, s.parked, s.maintenance, s.lang, s.visible_chars,
          round_even(strlen(s.body) / 1024.0, 1) AS weight, round_even(coalesce(s.elapsed_ms, 0), 1) AS load_ms,
          s.has_sitemap, s.sitemap_robots_http, coalesce(f.pages_failed, '') AS pages_failed,
          v.* EXCLUDE (start_url, whatsapp_number, instagram), v.whatsapp_number, v.instagram,
          coalesce(e.emails, '') AS emails, coalesce(t.phones, '') AS phones,
          list_distinct(list_concat(booking_list, form_list)) AS contact_list, {path_query('s.home_url')} AS home_path
        FROM secured s LEFT JOIN visit_lists v USING (start_url) LEFT JOIN failed f USING (start_url)
        LEFT JOIN site_emails e USING (start_url) LEFT JOIN site_phones t USING (start_url)),
    checks AS MATERIALIZED ({_check_rows()}),
    check_lists AS MATERIALIZED (
        SELECT url, coalesce(string_agg(name, ',' ORDER BY no) FILTER (n_found = 0), '') AS missing_sitewide,
          coalesce(string_agg(name, ',' ORDER BY no) FILTER (n_found > 0 AND NOT at_home), '') AS missing_home_only,
          coalesce(string_agg(concat('No ', label, ' on the home page, but found on ', shown, '.'), '; ' ORDER BY no)
            FILTER (n_found > 0 AND NOT at_home), '') AS notes
        FROM checks GROUP BY url),
    problems AS MATERIALIZED (SELECT * FROM ({_problem_rows()}) WHERE {sitemaps_count} OR code <> 'no_sitemap')"""


def _site_top(source: str, key: str, page: str, column: str, name: str) -> str:
    return f"""{name}_first AS (
        SELECT {key}, u.v AS v, min({page} * 1000 + u.pos) AS place
        FROM {source}, unnest({column}) WITH ORDINALITY AS u(v, pos) GROUP BY ALL),
    {name} AS MATERIALIZED (
        SELECT {key}, string_agg(v, ', ' ORDER BY place) AS {column}
        FROM (SELECT * FROM {name}_first
              QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY place) <= {fixed.CONTACTS_KEPT}) GROUP BY {key})"""


def _check_rows() -> str:
    selects = []
    for no, (name, label) in enumerate(fixed.CHECK_LABELS.items()):
        found = "contact_list" if name == "booking" else f"{name}_list"
        shown = f"array_to_string({found}, ', ')"
        if name == "booking":
            forms = "list_filter(form_list, lambda p: NOT list_contains(booking_list, p))"
            shown = f"array_to_string(list_concat(booking_list, {forms}), ', ')"
        selects.append(
            f"""SELECT url, {no} AS no, '{name}' AS name, {_q(label)} AS label,
            {_q(fixed.CHECK_ADVICE[name])} AS advice, len({found}) AS n_found,
            list_contains({found}, home_path) AS at_home, {shown} AS shown, n_pages, pages_listed
            FROM audits WHERE state = 'audited'"""
        )
    return " UNION ALL ".join(selects)


def _problem_rows() -> str:
    told = fixed.MESSAGES

    def fill(template: str, *values: str) -> str:
        parts = template.split("{}")
        out = [_q(parts[0])]
        for value, part in zip(values, parts[1:]):
            out += [value, _q(part)]
        return "concat(" + ", ".join(out) + ")"

    live = "state = 'audited' AND "
    where = f"CASE WHEN n_pages = 1 THEN {_q(fixed.WHERE_HOME)} ELSE {fill(fixed.WHERE_PAGES, 'n_pages', 'pages_listed')} END"
    why = "CASE WHEN https_error = '' THEN '' ELSE concat(' (', https_error, ')') END"
    rules = [
        (0, "robots_start", "state = 'robots_start'", fill(told["robots"])),
        (0, "robots_home", "state = 'robots_home'", fill(told["robots"])),
        (0, "no_response", "state = 'no_response'", fill(told["no_response"], "error")),
        (4, "error_page", live + "status >= 400", fill(told["error_page"], "status")),
        (5, "parked", live + "parked AND status < 400", fill(told["parked"])),
        (6, "maintenance", live + "maintenance", fill(told["maintenance"])),
        (11, "no_https", live + "NOT https", fill(told["no_https"], why)),
        (12, "no_redirect", live + "https AND redirects = false", fill(told["no_redirect"])),
        (13, "points_to_http", live + "https AND sitemap_robots_http", fill(told["points_to_http"])),
        (14, "no_viewport", live + "NOT has_viewport", fill(told["no_viewport"])),
        (15, "no_title", live + "title = ''", fill(told["no_title"])),
        (16, "no_description", live + "meta_description = ''", fill(told["no_description"])),
        (17, "no_sitemap", live + "NOT has_sitemap AND NOT broken", fill(told["no_sitemap"])),
        (18, "slow", live + f"load_ms > {fixed.SLOW_MS}",
         fill(told["slow"], "CAST(trunc(load_ms) AS BIGINT)")),
        (19, "heavy", live + f"weight > {fixed.HEAVY_KB}", fill(told["heavy"], "weight")),
    ]
    selects = [
        f"SELECT url, {no} AS no, '{code}' AS code, {text} AS problem FROM audits WHERE {condition}"
        for no, code, condition, text in rules
    ]
    selects.append(
        f"""SELECT url, 7 + no, concat('missing_', name), {fill(told['missing'], 'label', where, 'advice')}
        FROM checks WHERE n_found = 0"""
    )
    return " UNION ALL ".join(selects)


_AUDIT = _audit_ctes()


def _audit(select: str, source: str = "audits") -> str:
    return f"WITH {_AUDIT} SELECT {select} FROM {source}"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'True' ELSE 'False' END"


def _if(condition: str, value: str, other: str = "''") -> str:
    return f"coalesce(CASE WHEN {condition} THEN {value} END, {other})"


def _flat_fields() -> dict[str, str]:
    live = "state = 'audited'"
    text = lambda v: f"CAST({v} AS VARCHAR)"
    found = {f"{c}_found_on": f"coalesce({c}_found_on, '')" for c in fixed.CHECKS}
    flags = {
        "has_jsonld_localbusiness": "jsonld", "has_maps_link": "maps", "has_whatsapp_link": "whatsapp",
        "has_booking_link": "booking", "has_contact_form": "form",
    }
    return {
        "url": "url", "fetched": _flag("fetched"), "https": _flag("known AND https"),
        "https_error": _if("known", "https_error"),
        "http_redirects_to_https": _if("known AND redirects IS NOT NULL", _flag("redirects")),
        "sitemap_robots_http": _flag("sitemap_robots_http"),
        "status": f"CASE WHEN state = 'robots_start' THEN '0' ELSE {text('status')} END",
        "mobile_viewport": _flag(f"{live} AND has_viewport"),
        "title": _if(live, "title"), "meta_description": _if(live, "meta_description"),
        **{name: _flag(f"coalesce({c}_found_on, '') <> ''") for name, c in flags.items()},
        "pages_checked": "coalesce(pages_checked, '')", "pages_failed": "pages_failed", **found,
        "missing_sitewide": "coalesce(missing_sitewide, '')",
        "missing_home_only": "coalesce(missing_home_only, '')",
        "broken_or_parked": _flag(f"state = 'no_response' OR ({live} AND broken)"),
        "page_weight_kb": _if("known", text("CAST(weight AS DOUBLE)"), "'0.0'"),
        "load_time_ms": f"CASE WHEN state = 'robots_start' THEN '0.0' ELSE {text('CAST(load_ms AS DOUBLE)')} END",
        "has_sitemap": _flag("has_sitemap"),
        "robots_disallowed": _flag("state IN ('robots_start', 'robots_home')"),
        "lang": _if(live, "lang"), "visible_text_chars": _if(live, text("visible_chars"), "'0'"),
        "emails": "emails", "whatsapp_number": "coalesce(whatsapp_number, '')", "phones": "phones",
        "instagram": "coalesce(instagram, '')", "error": _if("state = 'no_response'", "error"),
        "problems": "coalesce(problem_text, '')", "notes": "coalesce(notes, '')",
    }


_FLAT = _flat_fields()
_FLAT_SOURCE = """audits LEFT JOIN check_lists USING (url) LEFT JOIN (
    SELECT url, string_agg(problem, '; ' ORDER BY no) AS problem_text FROM problems GROUP BY url) USING (url)"""


def _audit_rows_sql(condition: str = "true", **options) -> str:
    fields = ", ".join(f"{_FLAT[f]} AS {f}" for f in fixed.AUDIT_FIELDS)
    return f"WITH {_audit_ctes(**options)} SELECT {fields} FROM {_FLAT_SOURCE} WHERE {condition}"


# --- leads and OSM ----------------------------------------------------------------------
def _lead(**values: str) -> str:
    fields = {f: "''" for f in fixed.LEAD_FIELDS} | {"source": "'local'"} | values
    return ", ".join(f"{sql} AS {f}" for f, sql in fields.items())


_CUSTOMERS = "customer LEFT JOIN nation ON c_nationkey = n_nationkey"
_NAMED = "c_custkey % 9 <> 0"
_JSON_LEAD = dict(
    name="c_name", website="CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('shop', c_custkey, '.test') END",
    phone="CASE WHEN c_custkey % 2 = 0 AND c_custkey <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END",
    email="CASE WHEN c_custkey % 4 = 0 THEN 'own@x.test' WHEN c_custkey % 3 = 0"
          " THEN concat('single', c_custkey, '@b.test') ELSE concat('a', c_custkey, '@b.test') END",
    city="n_name", category="c_mktsegment", source_id="concat('c', c_custkey)", lat="CAST(c_nationkey AS VARCHAR)",
)


def _element_ctes() -> str:
    """Elements relationally: one row per element, its tags as columns, NULL where absent."""
    keys = ("amenity", "shop", "office", "craft", "leisure")
    tag_columns = ", ".join(
        f"CASE WHEN c_custkey % 6 = {i} THEN lower(c_mktsegment) END AS {k}" for i, k in enumerate(keys)
    )
    return f"""elements AS MATERIALIZED (
        SELECT ['node', 'way', 'relation', 'area'][c_custkey % 4 + 1] AS type, c_custkey AS id,
          coalesce(nullif(CASE WHEN c_custkey % 4 <> 1 THEN c_custkey % 170 - 85.5 END, 0),
                   CASE WHEN c_custkey % 3 <> 0 THEN nullif(c_custkey % 90 - 45.5, 0) END)::DOUBLE AS lat,
          coalesce(nullif(CASE WHEN c_custkey % 4 <> 1 THEN
                     CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_custkey * 7 % 350 - 175.25 END END, 0),
                   CASE WHEN c_custkey % 3 <> 0 THEN nullif(c_custkey % 160 - 80.5, 0) END)::DOUBLE AS lon,
          coalesce(CASE WHEN c_custkey % 4 <> 1 THEN c_custkey % 170 - 85.5 END,
                   CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 90 - 45.5 END)::DOUBLE AS at_lat,
          coalesce(CASE WHEN c_custkey % 4 <> 1 THEN
                     CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_custkey * 7 % 350 - 175.25 END END,
                   CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 160 - 80.5 END)::DOUBLE AS at_lon,
          CASE WHEN c_custkey % 8 = 0 THEN '' ELSE c_name END AS name, {tag_columns},
          CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('shop', c_custkey, '.test') END AS website,
          CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 100 AS VARCHAR) ELSE '' END AS housenumber,
          CASE WHEN c_custkey % 3 = 0 THEN concat('Street ', n_name) ELSE '' END AS street,
          n_name, c_custkey % 4 = 0 AS in_city, CAST(c_custkey AS VARCHAR) AS phone
        FROM {_CUSTOMERS}),
    element_copies AS (FROM elements UNION ALL FROM elements WHERE id % 7 = 0)"""


_OSM_LEAD = _lead(
    name="name", website="website", phone="phone",
    address="trim(concat_ws(' ', nullif(housenumber, ''), nullif(street, ''), n_name))",
    city="CASE WHEN in_city THEN n_name ELSE '' END", country="n_name",
    category="coalesce(amenity, shop, office, craft, leisure, '')", source="'osm'",
    source_id="concat(type, '/', id)", lat="coalesce(CAST(lat AS VARCHAR), '')",
    lon="coalesce(CAST(lon AS VARCHAR), '')",
)
_PLACES = """places AS (
    SELECT concat('area ', n_regionkey) AS area, n_nationkey - 40 AS south, n_nationkey * 3 - 90 AS west,
      n_nationkey + 5 AS north, n_nationkey * 4 - 20 AS east, n_nationkey AS rank FROM nation)"""


_SHAPE_AREAS = """SELECT r_name AS area, r_regionkey * 10 - 30 AS south, r_regionkey * 10 - 15 AS north,
          unnest(CASE WHEN r_regionkey = 0 THEN [170, -180] ELSE [r_regionkey * 60 - 150] END) AS west,
          unnest(CASE WHEN r_regionkey = 0 THEN [180, -170] ELSE [r_regionkey * 60 - 120] END) AS east FROM region"""


def _shapes_sql(select: str, boxes: str = _SHAPE_AREAS) -> str:
    """Pairs of nodes by element, the short way round; a box meets a line that enters it before leaving."""
    def enters(sign: str) -> str:
        pick, other = ("least", "greatest") if sign == "in" else ("greatest", "least")
        axes = [
            f"CASE WHEN {a}2 = {a}1 THEN CASE WHEN {a}1 BETWEEN {low} AND {high} THEN {0 if sign == 'in' else 1} ELSE {2 if sign == 'in' else -1} END"
            f" ELSE {pick}(({low} - {a}1) / ({a}2 - {a}1), ({high} - {a}1) / ({a}2 - {a}1)) END"
            for a, low, high in (("lat", "south", "north"), ("lon", "west", "east"))
        ]
        return f"{other}({', '.join(axes)}, {0 if sign == 'in' else 1})"

    return f"""WITH spots AS MATERIALIZED (
        SELECT c_custkey AS id, c_custkey * 37 % 600 / 4 - 75 AS lat, c_custkey * 91 % 1440 / 4 - 180 AS lon FROM customer),
    pairs AS (
        SELECT 'node' AS type, id, id AS a, id AS b FROM spots
        UNION ALL SELECT 'way', id, id + n, id + n + 1 FROM spots, (VALUES (0), (1)) AS s(n) WHERE id % 5 = 0
        UNION ALL SELECT 'relation', id, id + 3, id + 3 FROM spots WHERE id % 25 = 0
        UNION ALL SELECT 'relation', r.id, r.id + m + n, r.id + m + n + 1 FROM spots r, (VALUES (0), (5)) AS t(m), (VALUES (0), (1)) AS s(n)
          WHERE r.id % 25 = 0 AND r.id + m IN (SELECT id FROM spots)),
    ends AS (
        SELECT type, p.id, coalesce(a.lat, b.lat) AS lat1, coalesce(a.lon, b.lon) AS lon1, coalesce(b.lat, a.lat) AS lat2, coalesce(b.lon, a.lon) AS far
        FROM pairs p LEFT JOIN spots a ON p.a = a.id LEFT JOIN spots b ON p.b = b.id WHERE a.id IS NOT NULL OR b.id IS NOT NULL),
    lines AS (
        SELECT type, id, lat1, lat2, lon1 + turn AS lon1, CASE WHEN far - lon1 > 180 THEN far - 360 WHEN far - lon1 < -180 THEN far + 360 ELSE far END + turn AS lon2
        FROM ends, (VALUES (-360), (0), (360)) AS v(turn)),
    boxes AS ({boxes}),
    found AS MATERIALIZED (SELECT DISTINCT area, type, id FROM lines, boxes WHERE {enters('in')} <= {enters('out')})
    SELECT {select}"""


def _leads_audited_sql() -> str:
    """Leads joined to flat audits; a lead without a site gets the fixed row."""
    lead_columns = ["id", "name", "website", "url", "title"]
    no_site = {f: "''" for f in fixed.AUDIT_FIELDS}
    no_site |= {f: "'False'" for f, sql in _FLAT.items() if sql.startswith("CASE WHEN") and "'True'" in sql}
    no_site["http_redirects_to_https"] = "''"
    no_site |= {"status": "'0'", "visible_text_chars": "'0'", "page_weight_kb": "'0.0'", "load_time_ms": "'0.0'"}
    no_site |= {"error": _q(fixed.ERROR_NO_URL), "problems": _q(fixed.MESSAGES["no_url"])}
    merged = ", ".join(
        [f"l.{c}" for c in lead_columns if c not in fixed.AUDIT_FIELDS]
        + [f"coalesce(a.{f}, {no_site[f]}) AS {f}" for f in fixed.AUDIT_FIELDS]
    )
    flat = ", ".join(f"{_FLAT[f]} AS {f}" for f in fixed.AUDIT_FIELDS)
    return f"""WITH {_AUDIT}, flat AS MATERIALIZED (SELECT {flat} FROM {_FLAT_SOURCE}),
    leads AS (
        SELECT page_id AS id, concat('Shop ', page_id) AS name, 'lead title' AS title,
          CASE WHEN page_id % 6 = 0 THEN '' ELSE {START} END AS website,
          CASE WHEN page_id % 6 = 0 AND page_id % 12 <> 0 THEN '' ELSE {START} END AS site
        FROM pages)
    SELECT {merged} FROM leads l LEFT JOIN flat a ON l.site <> '' AND a.url =
      CASE WHEN regexp_matches(l.site, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l.site ELSE concat('https://', l.site) END"""


# --- all --------------------------------------------------------------------------------
_RAW = "regexp_replace(url, '^https?://', '')"
_SITE_PAGES = f"""{_HOME_FACTS}, sited AS MATERIALIZED (SELECT *, {site('url')} AS site FROM page_facts)"""


def _log(select: str, extra: str = "") -> str:
    return f"WITH {SNAPSHOT_SQL}{extra} SELECT {select}"


ORACLE_SQL = {
    "url_parts": f"""SELECT page_id,
        CASE WHEN regexp_matches({_RAW}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {_RAW}
             ELSE concat('https://', {_RAW}) END AS with_scheme,
        {scheme('url')} AS scheme, {authority('url')} AS authority, {site('url')} AS site,
        {path_query('url')} AS path_query, {page_key(path_query('url'))} AS page_key,
        {clean('url')} AS clean_path, {page_like(clean('url'))} AS page_like,
        {asset(clean('url'))} AS asset, CAST(len({segment_list(clean('url'))}) AS BIGINT) AS depth
        FROM pages""",
    "url_resolve": f"""WITH {_HOME_FACTS}, flat AS (
        SELECT page_id, url, l.href AS href, l.pos - 1 AS ord
        FROM page_facts, unnest(links) WITH ORDINALITY AS l(href, pos)),
        found AS (SELECT *, {resolve('url', 'href')} AS resolved FROM flat)
        SELECT page_id, CAST(ord AS BIGINT) AS ord, href, {page_href('href')} AS page_href, resolved,
        {site('resolved')} = {site('url')} AS same_site FROM found""",
    "page_title": _facts("page_id, title FROM page_facts"),
    "page_description": _facts("page_id, meta_description FROM page_facts"),
    "page_head": _facts("page_id, has_viewport, lang FROM page_facts"),
    "page_visible_chars": _facts("page_id, visible_chars FROM page_facts"),
    "page_links": _facts(f"page_id, CAST(len(links) AS BIGINT) AS n_links, {joined('links')} AS links FROM page_facts"),
    "page_anchors": _facts(
        f"""page_id, CAST(len(anchors) AS BIGINT) AS n_anchors,
        {joined("list_transform(anchors, lambda a: concat(a.href, '>', a.text))")} AS anchors FROM page_facts"""),
    "page_jsonld": _facts(f"page_id, {joined('blobs')} AS blobs FROM page_facts"),
    "page_form": _facts("page_id, form AS has_form FROM page_facts"),
    "page_weight": f"""WITH {HOME_SQL} SELECT page_id,
        CAST(round_even(strlen(html) / 1024.0, 1) AS DOUBLE) AS page_weight_kb,
        CAST(round_even(page_id + 0.25, 1) AS DOUBLE) AS load_time_ms FROM home""",
    "entity_text": f"""SELECT page_id, CAST(length({decode('html')}) AS BIGINT) AS chars,
        md5({decode('html')}) AS digest FROM pages""",
    "page_detectors": _facts("page_id, maps, whatsapp, booking, form FROM page_facts"),
    "page_loose_jsonld": "SELECT page_id, page_id % 10 IN (0, 2, 5, 8) AS local_business FROM pages",
    "page_local_business": _facts(
        """f.page_id, CAST(len(blobs) AS BIGINT) AS blobs, l.page_id IS NOT NULL AS local_business
        FROM page_facts f LEFT JOIN local_business l USING (page_id)""", _HOME_LD),
    "page_broken": f"""WITH {HOME_SQL}, seen AS (
        SELECT page_id, CASE WHEN page_id % 17 = 6 THEN 404 ELSE 200 END AS status,
          CASE WHEN page_id % 37 = 5 THEN '<p>hi</p>' ELSE html END AS html FROM home),
        {facts_of('seen', 'html', 'page_id, status, html')},
        found AS (SELECT page_id, parked_text AS parked, status < 400 AND strlen(html) < {fixed.PLACEHOLDER_BYTES}
          AS placeholder, status >= 400 AS error_page,
          maintenance_text OR contains(lower(title), '{fixed.MAINTENANCE_TITLE}') AS maintenance FROM page_facts)
        SELECT *, parked OR placeholder OR error_page OR maintenance AS broken_or_parked FROM found""",
    "document_detectors": "SELECT doc_id, " + ", ".join(
        f"regexp_matches(text, {_q(p)}, 'i') AS {c}" for c, p in _LINKED.items()) + " FROM documents",
    "document_emails": f"SELECT doc_id, {joined(emails('text', None))} AS emails FROM documents",
    "page_contacts": _facts(
        f"""page_id, site, {joined('emails')} AS emails, {joined('phones')} AS phones,
        whatsapp_number, instagram FROM sited""", _SITE_PAGES),
    "site_emails": f"""WITH {_SITE_PAGES}, {_site_top('sited', 'site', 'page_id', 'emails', 'top')}
        SELECT site, emails FROM top""",
    "site_phones": f"""WITH {_SITE_PAGES}, {_site_top('sited', 'site', 'page_id', 'phones', 'top')}
        SELECT site, phones FROM top""",
    "site_whatsapp": f"""WITH {_SITE_PAGES} SELECT site, whatsapp_number FROM sited WHERE whatsapp_number IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1""",
    "site_instagram": f"""WITH {_SITE_PAGES} SELECT site, instagram FROM sited WHERE instagram IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1""",
    "site_presence": f"""WITH {_HOME_LD}, checked AS (
        SELECT {site('url')} AS site, maps, whatsapp, booking, form, l.page_id IS NOT NULL AS jsonld
        FROM page_facts f LEFT JOIN local_business l USING (page_id)),
        counted AS (SELECT site, count(*) AS pages,
          {', '.join(f'CAST(count(*) FILTER ({c}) AS BIGINT) AS {c}_pages' for c in fixed.CHECKS)}
          FROM checked GROUP BY site)
        SELECT *, {', '.join(f'{c}_pages > 0 AS has_{c}' for c in fixed.CHECKS)},
        concat_ws(',', CASE WHEN maps_pages = 0 THEN 'maps' END, CASE WHEN whatsapp_pages = 0 THEN 'whatsapp' END,
          CASE WHEN booking_pages + form_pages = 0 THEN 'booking' END, CASE WHEN jsonld_pages = 0 THEN 'jsonld' END)
          AS missing FROM counted""",
    "fetch_status": _log(
        """url, error IS NULL AND status >= 200 AND status < 400 AS ok,
        status <> 0 AND error IS NULL AS answered, lower(coalesce(content_type, '')) AS content_type,
        CAST(length(body) AS BIGINT) AS chars, error IS NULL AND status < 400
          AND (content_type IS NULL OR contains(lower(content_type), 'html')) AS readable FROM log"""),
    "robots_rules": _log(
        """origin, CAST(group_no AS BIGINT) AS group_no, array_to_string(agents, ',') AS agents,
        CAST(seq AS BIGINT) AS seq, allow, path FROM robots_rules""", f", {_robots_ctes()}"),
    "robots_sitemaps": _log(
        "origin, CAST(seq AS BIGINT) AS seq, sitemap FROM robots_sitemaps", f", {_robots_ctes()}"),
    "robots_allowed": _log(
        "url, allowed FROM decided", f", {_robots_ctes()}, {allowed('log', 'url', 'decided', 'url')}"),
    "robots_many_rules": f"""WITH listed AS (
          SELECT url, {origin('url')} AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS target FROM pages),
        rules AS (
          SELECT seq, CASE WHEN seq = 599 THEN '/fr' ELSE concat('/', ['en', 'fr', 'de', 'es'][seq % 4 + 1], '/',
            CASE WHEN seq % 5 = 0 THEN '' ELSE CAST(seq * 7 % 300 AS VARCHAR) END,
            CASE WHEN seq % 5 = 0 AND seq < 550 THEN CAST(seq * 13 % 97 AS VARCHAR) ELSE '' END) END AS path
          FROM range(600) AS r(seq)),
        first AS (
          SELECT url, origin, min(seq) AS seq FROM (SELECT DISTINCT * FROM listed) JOIN rules ON starts_with(target, path) GROUP BY ALL)
        SELECT l.url, l.origin, coalesce((f.seq + length(l.origin)) % 3 = 0, true) AS allowed FROM listed l LEFT JOIN first f USING (url, origin)""",
    "sitemap_locations": _log(
        f"""url, contains(substr(body, 1, {fixed.SITEMAP_HEAD_BYTES}), '<') AS is_markup,
        contains(lower(body), '<sitemapindex') AS is_index, {joined(_locs('body'))} AS locs,
        {joined(_children(_locs('body')))} AS children FROM log WHERE ends_with(url, '.xml')"""),
    "sitemap_expansion": _log(
        f"""f.origin, f.has_sitemap, points_to_http, coalesce(string_agg(l.loc, {SEP} ORDER BY l.place), '') AS locs
        FROM sitemap_found f JOIN sitemap_http USING (origin) LEFT JOIN sitemap_locs l USING (origin) GROUP BY ALL""",
        f""", {_robots_ctes()}, all_origins AS MATERIALIZED (SELECT DISTINCT {origin('url')} AS origin FROM log),
        {_sitemap_ctes('all_origins')}"""),
    "crawl_candidates": f"""WITH {_HOME_FACTS}, links AS (
        SELECT page_id, url AS home_url, a.ord - 1 AS ord, a.a.href AS href, a.a.text AS label
        FROM page_facts, unnest(anchors) WITH ORDINALITY AS a(a, ord)), {_plan_ctes('links', 'home_url', 7)}
        SELECT page_id, CAST(ord AS BIGINT) AS ord, key, CAST(rank AS BIGINT) AS rank,
        CAST(depth AS BIGINT) AS depth, page_url FROM plan_candidates""",
    "crawl_plan": f"""WITH {_HOME_FACTS}, links AS (
        SELECT url AS home_url, a.ord AS ord, a.a.href AS href, a.a.text AS label
        FROM page_facts, unnest(anchors) WITH ORDINALITY AS a(a, ord)
        UNION ALL SELECT url, 1000000 + l.place, l.loc, '' FROM page_facts,
          unnest([concat({origin('url')}, '/book'), concat({origin('url')}, '/news'), 'visit'])
          WITH ORDINALITY AS l(loc, place)), {_plan_ctes('links', 'home_url', _PAGES_KEPT)}
        SELECT home_url AS url, CAST(slot AS BIGINT) AS slot, CAST(rank AS BIGINT) AS rank,
        CAST(depth AS BIGINT) AS depth, page_url FROM plan""",
    "audit_home_only": _audit_rows_sql(pages_kept=0),
    "audit_three_pages": _audit_rows_sql(pages_kept=2),
    "audit_without_sitemaps": _audit_rows_sql(check_sitemap=False),
    "audit_one_site": _audit_rows_sql("url = (SELECT min(url) FROM audits)"),
    "https_status": _audit(
        """url, state, home_url, CAST(CASE WHEN state = 'robots_start' THEN 0 ELSE status END AS BIGINT) AS status,
        known AND https AS https, CASE WHEN known THEN redirects END AS http_redirects_to_https,
        CASE WHEN known THEN https_error ELSE '' END AS https_error"""),
    "visited_pages": _audit(
        "url, coalesce(pages_checked, '') AS pages_checked, pages_failed, has_sitemap, sitemap_robots_http"),
    "site_found_on": _audit(
        "url, " + ", ".join(f"coalesce({c}_found_on, '') AS {c}_found_on" for c in fixed.CHECKS)
        + ", emails, phones, coalesce(whatsapp_number, '') AS whatsapp_number, coalesce(instagram, '') AS instagram"),
    "site_missing": _audit(
        """url, coalesce(missing_sitewide, '') AS missing_sitewide, coalesce(missing_home_only, '') AS
        missing_home_only, coalesce(notes, '') AS notes""", "audits LEFT JOIN check_lists USING (url)"),
    "site_problems": _audit(
        "url, row_number() OVER (PARTITION BY url ORDER BY no) - 1 AS seq, code, problem", "problems"),
    "audit_rows": _audit_rows_sql(),
    "leads_table": f"""SELECT {_lead(name='c_name', website="concat('shop', c_custkey, '.test')",
        country='n_name', category='c_mktsegment', address='CAST(c_acctbal AS VARCHAR)',
        source_id='CAST(c_custkey AS VARCHAR)')} FROM {_CUSTOMERS} WHERE {_NAMED}""",
    "leads_json": f"SELECT {_lead(**_JSON_LEAD)} FROM {_CUSTOMERS} WHERE {_NAMED}",
    "leads_json_lines": f"""SELECT {_lead(**_JSON_LEAD | dict(category="concat('c', c_custkey)"))}
        FROM {_CUSTOMERS} WHERE {_NAMED}""",
    "leads_csv": f"""SELECT {_lead(name="concat(' ', c_name, ', " + '"' + "', c_custkey, '" + '"' + " ')",
        address=f"concat('line 1', {NL}, c_mktsegment)", country='n_name',
        category="CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END",
        source_id='CAST(c_custkey AS VARCHAR)')} FROM {_CUSTOMERS}""",
    "leads_json_files": f"SELECT {_lead(**_JSON_LEAD)} FROM {_CUSTOMERS} WHERE {_NAMED}",
    "leads_csv_folder": f"""SELECT {_lead(name="concat(c_name, ', " + '"' + "', c_custkey, '" + '"' + " ')",
        address="concat('line 1', chr(10), chr(10), c_mktsegment)", country="CASE WHEN c_custkey % 3 = 2 THEN '' ELSE n_name END",
        category="CASE WHEN c_custkey % 3 = 2 OR c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END",
        source_id="CAST(c_custkey AS VARCHAR)")} FROM {_CUSTOMERS}""",
    "osm_documents": f"WITH {_element_ctes()} SELECT {_OSM_LEAD} FROM element_copies WHERE name <> ''",
    "osm_shapes_in_areas": _shapes_sql("area, type, id FROM found"),
    "osm_shapes_selected": _shapes_sql(
        "concat(type, '/', id) AS source_id, concat(type, ' ', id) AS name FROM found",
        "SELECT '' AS area, -60 AS south, 20 AS north, unnest([120, -180]) AS west, unnest([180, -120]) AS east"),
    "osm_area_leads": f"""WITH {_element_ctes()}, {_PLACES} SELECT {_OSM_LEAD} FROM elements, places
        WHERE area = 'area 2' AND rank = (SELECT min(rank) FROM places WHERE area = 'area 2') AND name <> '' AND type <> 'area'
          AND (amenity IS NOT NULL OR shop IS NOT NULL OR office = 'machinery')
          AND at_lat BETWEEN south AND north AND at_lon BETWEEN west AND east""",
    "osm_leads": f"WITH {_element_ctes()} SELECT {_OSM_LEAD} FROM element_copies WHERE name <> ''",
    "osm_selected": f"""WITH {_element_ctes()} SELECT * REPLACE ('chosen' AS category) FROM (
        SELECT {_OSM_LEAD} FROM elements WHERE type <> 'area' AND name <> '' AND website <> ''
        AND (amenity = 'building' OR shop IS NOT NULL OR craft IS NOT NULL)
        AND at_lat BETWEEN -60 AND 60 AND at_lon BETWEEN -120 AND 120.5)""",
    "osm_in_areas": f"""WITH {_element_ctes()}, {_PLACES},
        boxes AS (FROM places QUALIFY row_number() OVER (PARTITION BY area ORDER BY rank) = 1)
        SELECT area, type, id, at_lat AS lat, at_lon AS lon FROM elements JOIN boxes
        ON at_lat BETWEEN south AND north AND at_lon BETWEEN west AND east""",
    "osm_unknown_areas": f"""WITH {_PLACES} SELECT DISTINCT concat('area ', c_nationkey % 9) AS area FROM customer
        WHERE concat('area ', c_nationkey % 9) NOT IN (SELECT area FROM places)""",
    "leads_audited": _leads_audited_sql(),
}
