"""Page facts from HTML, as SQL expressions.

A page is cut once into a short array of nodes (one regular expression, one pass); every fact
is then a filter or fold over that array. ``with_page_facts`` adds the facts to a table.

Rules for odd markup: ``>`` inside a quoted attribute value does not end the tag; an unclosed
comment, script or style runs to the end of the text; an unfinished tag at the end is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.functions import fixed
from shopfront.functions.text import any_of, collapse, decode_entities, regex, strip

# Possessive quantifiers keep the matcher iterative, so long pages cannot exhaust its stack.
_IN_TAG = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
# the same, but short of a slash that closes the element at once; a slash that ends an unquoted
# value belongs to it
_OPEN_TAG = (
    r"""(?:[^>=/]++|=\s*+(?:"[^"]*+"|'[^']*+')|=[^\s"'>=]++|=|/(?!>))*+"""
)


def _raw_text_block(tag: str) -> str:
    return (
        rf"<(?i:{tag})(?=[\s/>]){_OPEN_TAG}>.*?(?:</\s*+(?i:{tag})\s*+>|\z)"
    )


_NODE = "(?s)" + "|".join(
    [
        r"[^<]++",
        r"<!--.*?(?:--\s*+>|\z)",
        _raw_text_block("script"),
        _raw_text_block("style"),
        rf"<[a-zA-Z]{_IN_TAG}>",
        r"</[^>]*+>",
        r"<[!?][^>]*+>",
        r"<(?:[a-zA-Z/!?].*)?+\z",
        r"<",
    ]
)
_NAME = r"^<(/?[a-zA-Z][^\s/>]*)"
_RAW_TEXT = (
    rf"(?s)^<[a-zA-Z]{_OPEN_TAG}>(.*)</\s*+(?i:script|style)\s*+>\z"
)
_ATTRIBUTE = (
    r"""[^\s/>"'=][^\s/=>]*+(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))?"""
)
_VALUE = r"""(?s)^[^=]*+=++\s*+(["']?)(.*)\1$"""
_SELF_CLOSED = rf"""(?s)^<[a-zA-Z]{_OPEN_TAG}/>\z"""


_TAGS_READ = ("html", "meta", "a", "script", "form", "input")
_ATTRIBUTES_READ = ("href", "name", "content", "lang", "type", "role")
_TAGS_KEPT = (
    "html", "title", "/title", "meta", "a", "/a", "script", "/script", "/style", "noscript",
    "/noscript", "form", "/form", "input", "select", "textarea",
)


def _attributes(raw: str) -> str:
    """The attributes of a tag that some fact needs, in order, as (name, decoded value)."""
    # the tag's own name comes out like an attribute, but is never one that is read
    wanted = f"""filter(regexp_extract_all({raw}, {regex(_ATTRIBUTE)}, 0),
        att -> att RLIKE r'^(?i:{"|".join(_ATTRIBUTES_READ)})(?:\\s*=|$)')"""
    return f"""transform({wanted}, att -> named_struct(
        'name', lower(regexp_extract(att, '^[a-zA-Z]+', 0)),
        'value', transform(array(regexp_extract(att, {regex(_VALUE)}, 2)), val ->
          {decode_entities('val')})[0]))"""


def nodes(text: str) -> str:
    """Cut HTML into nodes: ``pos``, lower-case ``name`` ('' for text), ``raw``, ``data`` and
    ``attributes``.

    ``data`` is the decoded text of a text node, or the undecoded body of a script or style.
    """
    is_text = "(NOT startswith({0}, '<') OR {0} = '<')"
    named = f"""transform(regexp_extract_all({text}, {regex(_NODE)}, 0), t -> named_struct(
        't', t, 'name', if({is_text.format('t')}, '', lower(regexp_extract(t, {regex(_NAME)}, 1)))))"""
    return f"""transform({named}, (r, pos) -> named_struct(
        'pos', pos, 'name', r.name, 'raw', r.t,
        'data', CASE WHEN {is_text.format('r.t')}
                       THEN {decode_entities('r.t')}
                     WHEN r.name IN ('script', 'style')
                       THEN regexp_extract(r.t, {regex(_RAW_TEXT)}, 1) ELSE '' END,
        'attributes', if(r.name IN ({any_of(_TAGS_READ)}), {_attributes('r.t')}, array())))"""


def attribute(node: str, name: str) -> str:
    """Decoded value of an attribute of a node; the last one wins, '' if absent."""
    return f"""coalesce(try_element_at(
        filter({node}.attributes, att -> att.name = '{name}'), -1).value, '')"""


def _named(tags: str, *names: str) -> str:
    return f"filter({tags}, nd -> nd.name IN ({any_of(names)}))"


def _self_closed(raw: str) -> str:
    return f"(endswith({raw}, '/>') AND {raw} RLIKE {regex(_SELF_CLOSED)})"


def _joined_data(all_nodes: str, after: str, before: str) -> str:
    """Concatenated data of the nodes strictly between two positions."""
    return f"""array_join(transform(slice({all_nodes}, {after} + 2,
        greatest({before} - {after} - 1, 0)), nd -> nd.data), '')"""


def title(all_nodes: str, tags: str) -> str:
    """Text of every title element, concatenated and trimmed."""
    marks = _named(tags, "title", "/title")
    end = f"coalesce(get(marks, k + 1).pos, size({all_nodes}))"
    joined = f"""transform(array({marks}), marks -> array_join(transform(marks, (m, k) ->
        if(m.name = 'title' AND NOT {_self_closed('m.raw')},
           {_joined_data(all_nodes, 'm.pos', end)}, '')), ''))[0]"""
    return strip(joined)


def meta_description(tags: str) -> str:
    """Content of the last description meta tag, trimmed."""
    found = f"""filter({_named(tags, 'meta')},
        m -> lower({attribute('m', 'name')}) = 'description')"""
    content = f"transform({found}, m -> {attribute('m', 'content')})"
    return f"coalesce({strip(f'try_element_at({content}, -1)')}, '')"


def has_viewport(tags: str) -> str:
    return f"""exists({_named(tags, 'meta')},
        m -> lower({attribute('m', 'name')}) = 'viewport')"""


def language(tags: str) -> str:
    """Language of the last html tag, lower-cased."""
    found = f"transform({_named(tags, 'html')}, m -> lower({attribute('m', 'lang')}))"
    return f"coalesce(try_element_at({found}, -1), '')"


def kept_tags(all_nodes: str) -> str:
    """The nodes that are tags some fact looks for."""
    return f"filter({all_nodes}, nd -> nd.name IN ({any_of(_TAGS_KEPT)}))"


def visible_chars(all_nodes: str, tags: str) -> str:
    """Summed trimmed length of the text nodes outside script, style and noscript."""
    hiding = "('noscript', '/noscript', '/script', '/style')"
    length = f"length({strip('n.data')})"
    plain = f"""aggregate({all_nodes}, 0, (chars, n) ->
        if(n.name = '', chars + {length}, chars))"""
    return f"""if(exists({tags}, t -> t.name IN {hiding}), {_visible_chars(all_nodes)}, {plain})"""


def _visible_chars(all_nodes: str) -> str:
    return f"""aggregate({all_nodes}, named_struct('skip', 0, 'chars', 0), (acc, n) ->
        named_struct(
          'skip', CASE WHEN n.name = '' THEN acc.skip
                       WHEN n.name = 'noscript' AND NOT {_self_closed('n.raw')} THEN acc.skip + 1
                       WHEN n.name IN ('/noscript', '/script', '/style')
                       THEN greatest(acc.skip - 1, 0) ELSE acc.skip END,
          'chars', if(n.name = '' AND acc.skip = 0,
                      acc.chars + length({strip('n.data')}), acc.chars)),
        acc -> acc.chars)"""


def anchor_marks(tags: str) -> str:
    """Opening ``<a>`` tags with a non-empty href, and closing ones, in document order."""
    return f"""filter(transform({_named(tags, 'a', '/a')}, m -> named_struct(
          'pos', m.pos, 'opens', m.name = 'a',
          'empty', m.name = 'a' AND {_self_closed('m.raw')},
          'decoded', m.name = 'a' AND contains(m.raw, '&'),
          'href', if(m.name = 'a', {attribute('m', 'href')}, ''))),
        m -> NOT m.opens OR m.href <> '')"""


def links(marks: str) -> str:
    """Every non-empty link target, in document order."""
    return f"transform(filter({marks}, m -> m.opens), m -> m.href)"


def decoded_links(marks: str) -> str:
    """The links that the text may not show as such, one per line."""
    return f"array_join(transform(filter({marks}, m -> m.opens AND m.decoded), m -> m.href), '\\n')"


def anchors(all_nodes: str, marks: str) -> str:
    """(href, text) of every closed link; a nested link replaces the open one."""
    text = collapse(_joined_data(all_nodes, "m.pos", f"get({marks}, k + 1).pos"))
    return f"""filter(transform({marks}, (m, k) ->
        if(m.opens AND (m.empty OR NOT coalesce(get({marks}, k + 1).opens, true)),
           named_struct('href', m.href, 'text', if(m.empty, '', {text})), NULL)),
        a -> a IS NOT NULL)"""


def ldjson_blobs(tags: str) -> str:
    """Bodies of the JSON-LD scripts."""
    return f"""transform(filter({_named(tags, 'script')}, m ->
        m.data <> '' AND lower({attribute('m', 'type')}) = 'application/ld+json'),
        m -> m.data)"""


def has_form(tags: str) -> str:
    """A form with a textarea, or with two or more real fields.

    Fields count for the innermost open form; a search form starts far below zero.
    """
    kinds = f"""transform({_named(tags, 'form', '/form', 'input', 'select', 'textarea')},
        m -> CASE
          WHEN m.name = 'form' AND {_self_closed('m.raw')} THEN 'ignored'
          WHEN m.name = 'form' AND lower({attribute('m', 'role')}) = 'search' THEN 'search'
          WHEN m.name = 'input' AND lower({attribute('m', 'type')})
            IN ({any_of(fixed.NOT_REAL_INPUTS)}) THEN 'ignored'
          ELSE m.name END)"""
    outer = "slice(acc.open, 1, greatest(size(acc.open) - 1, 0))"
    is_field = "(k IN ('input', 'select', 'textarea') AND size(acc.open) > 0)"
    fields = "try_element_at(acc.open, -1) + 1"
    return f"""aggregate({kinds},
        named_struct('open', cast(array() AS array<int>), 'found', false),
        (acc, k) -> named_struct(
          'open', CASE WHEN k = 'form' THEN array_append(acc.open, 0)
                       WHEN k = 'search' THEN array_append(acc.open, {fixed.SEARCH_FORM_START})
                       WHEN k = '/form' THEN {outer}
                       WHEN {is_field} THEN array_append({outer}, {fields})
                       ELSE acc.open END,
          'found', acc.found OR ({is_field} AND (k = 'textarea'
                   OR coalesce({fields}, 0) >= {fixed.REAL_FIELDS}))),
        acc -> acc.found)"""


def page_weight_kb(size_in_bytes: str) -> str:
    return f"bround({size_in_bytes} / 1024.0D, 1)"


def load_time_ms(elapsed_ms: str) -> str:
    return f"bround({elapsed_ms}, 1)"


def page_facts() -> dict[str, str]:
    """Fact name to expression over the working columns of ``with_nodes``."""
    return {
        "title": title("_nodes", "_tags"),
        "meta_description": meta_description("_tags"),
        "has_viewport": has_viewport("_tags"),
        "lang": language("_tags"),
        "visible_chars": visible_chars("_nodes", "_tags"),
        "links": links("_marks"),
        "decoded_links": decoded_links("_marks"),
        "anchors": anchors("_nodes", "_marks"),
        "ldjson_blobs": ldjson_blobs("_tags"),
        "has_form": has_form("_tags"),
    }


def with_nodes(pages: DataFrame, text: str = "html") -> DataFrame:
    """Add the working columns ``_nodes``, ``_tags`` and ``_marks``."""
    return (
        pages.selectExpr("*", f"{nodes(text)} AS _nodes")
        .selectExpr("*", f"{kept_tags('_nodes')} AS _tags")
        .selectExpr("*", f"{anchor_marks('_tags')} AS _marks")
    )


def with_page_facts(pages: DataFrame, *facts: str, text: str = "html") -> DataFrame:
    """Add the named HTML facts (all of them by default) of the page in column ``text``."""
    known = page_facts()
    wanted = {name: F.expr(known[name]) for name in facts or known}
    return with_nodes(pages, text).withColumns(wanted).drop("_nodes", "_tags", "_marks")
