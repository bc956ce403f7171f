"""URL expressions after RFC 3986, with the lenient reading that crawl data needs.

``parse_url`` is not used: it rejects characters such as ``|`` and hosts with ``_``.
"""

from __future__ import annotations

from shopfront.functions import fixed
from shopfront.functions.text import regex

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def has_scheme(url: str) -> str:
    return f"({url} RLIKE '^{_SCHEME}:')"


def with_default_scheme(url: str) -> str:
    """Prefix ``https://`` when there is no scheme; ``host:80`` counts as having one."""
    return f"if({has_scheme(url)}, {url}, 'https://' || {url})"


def scheme(url: str) -> str:
    return f"lower(regexp_extract({url}, '^({_SCHEME}):', 1))"


def authority(url: str) -> str:
    """Host with port and userinfo, as written."""
    return f"regexp_extract({url}, '^(?:{_SCHEME}:)?//([^/?#]*)', 1)"


def origin(url: str) -> str:
    return f"({scheme(url)} || '://' || {authority(url)})"


def site_key(url: str) -> str:
    """Lower-case authority without one leading ``www.``."""
    return f"regexp_replace(lower({authority(url)}), '^www\\\\.', '')"


def _path_and_params(url: str) -> str:
    return f"regexp_extract({url}, '^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)', 1)"


def path(url: str) -> str:
    """Path without ``;params`` of the last segment; may be empty."""
    return f"regexp_replace({_path_and_params(url)}, ';[^/]*$', '')"


def query(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*\\\\?([^#]*)', 1)"


def _query_suffix(url: str) -> str:
    return f"if({query(url)} = '', '', '?' || {query(url)})"


def path_query(url: str) -> str:
    """Path plus ``?query``; an empty path is ``/``."""
    return f"(coalesce(nullif({path(url)}, ''), '/') || {_query_suffix(url)})"


def without_fragment(url: str) -> str:
    return f"regexp_replace({url}, '(?s)#.*$', '')"


def clean_path(url: str) -> str:
    """Path with runs of slashes collapsed; an empty path is ``/``."""
    return f"regexp_replace(coalesce(nullif({path(url)}, ''), '/'), '/+', '/')"


def segments(clean: str) -> str:
    return f"filter(split({clean}, '/'), seg -> seg <> '')"


def is_page_like(clean: str) -> str:
    """Short paths only: few segments, few characters, few hyphens per segment."""
    return f"""(length({clean}) <= {fixed.MAX_PATH_CHARS}
        AND size({segments(clean)}) <= {fixed.MAX_SEGMENTS}
        AND NOT {clean} RLIKE '[^/-]*(?:-[^/-]*){{{fixed.MAX_HYPHENS + 1}}}')"""


def is_page_href(href: str) -> str:
    """False for mail, phone and script targets, bare fragments and nothing."""
    return f"({href} <> '' AND NOT lower({href}) RLIKE {regex(fixed.NOT_PAGE_HREF)})"


def is_asset(clean: str) -> str:
    return f"(lower({clean}) RLIKE r'\\.({'|'.join(fixed.ASSET_SUFFIXES)})$')"


def page_key(path_and_query: str) -> str:
    """Identity of a page on its site: collapsed slashes, no trailing one."""
    return (
        f"coalesce(nullif(regexp_replace(regexp_replace({path_and_query}, '/+', '/'),"
        " '/$', ''), ''), '/')"
    )


def unquote(text: str) -> str:
    """Percent-decoding that leaves ``+`` and malformed escapes alone."""
    escaped = f"regexp_replace({text}, '%(?![0-9a-fA-F]{{2}})', '%25')"
    return f"if(contains({text}, '%'), url_decode(replace({escaped}, '+', '%2B')), {text})"


def _remove_dots(merged: str) -> str:
    folded = f"""aggregate(split({merged}, '/'), cast(array() AS array<string>), (acc, seg) ->
        CASE seg WHEN '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0))
                 WHEN '.' THEN acc ELSE array_append(acc, seg) END)"""
    ends_in_dots = f"{merged} RLIKE r'(^|/)\\.\\.?$'"
    joined = f"array_join(if({ends_in_dots}, array_append({folded}, ''), {folded}), '/')"
    rooted = f"regexp_replace({joined}, '^(?!/)', '/')"
    return f"if({merged} RLIKE r'(^|/)\\.\\.?(/|$)', {rooted}, {merged})"


def resolve(base: str, href: str) -> str:
    """Absolute URL of ``href`` on page ``base``, without fragment."""
    bare = without_fragment(f"translate({href}, '\\t\\r\\n', '')")
    own_path = _path_and_params("ref")
    merged = f"""if(startswith({own_path}, '/'), {own_path}, regexp_replace(
        '/' || regexp_replace({path(base)}, '[^/]*$', '') || {own_path}, '/+', '/'))"""
    on_base = f"{scheme(base)} || '://' || {authority(base)}"
    return f"""transform(array({bare}), ref -> CASE
        WHEN {has_scheme('ref')} AND {scheme('ref')} <> {scheme(base)} THEN ref
        WHEN {authority('ref')} <> '' THEN {scheme(base)} || '://' || {authority('ref')}
          || regexp_replace({own_path}, '^(?!/|$)', '/') || {_query_suffix('ref')}
        WHEN {own_path} = '' THEN {on_base} || {_path_and_params(base)}
          || if({query('ref')} = '', {_query_suffix(base)}, {_query_suffix('ref')})
        ELSE {on_base} || transform(array({merged}), mrg -> {_remove_dots('mrg')})[0]
          || {_query_suffix('ref')} END)[0]"""
