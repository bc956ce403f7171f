"""Page detectors: what a page links to, declares or looks like."""

from __future__ import annotations

from shopfront.functions import fixed
from shopfront.functions.text import any_of, at_first_letter, fold_case, mark_json_texts, quoted, regex

# Detector name to: pattern, the letters a match can start with, and the same pattern in parts: a text that every
# match of some alternatives holds, with what then has to be there, plain texts or a pattern, unless the text itself
# is all of it. Texts are found far faster than the whole pattern, and most pages hold few of the first ones.
_LINKED = {
    "maps": (fixed.MAPS, "gm", {
        "goo": (("maps.google.", "maps.googleapis.com", "maps.app.goo.gl", "goo.gl/maps"), r"google\.[a-z.]+/maps"),
        "g.page/": None,
    }),
    "whatsapp": (fixed.WHATSAPP, "wajc", {
        "whatsapp": None, "wa.": (("wa.me/", "wa.link/"), None), "joinchat": None, "click-to-chat": None,
    }),
    "booking": (fixed.BOOKING, "cbarfsvح", {
        "appointment": None, "rendez-vous": None, "réserver": None, "حجز": None,
        "reserv": (("reserve", "reservation"), None),
        "book": (("booking", "simplybook.me"), r"book(?:\.?now|[- ](?:an?|your|online|appointment|a ))"),
        ".com": (("calendly.com", "fresha.com", "setmore.com", "acuityscheduling.com", "vagaro.com"), None),
    }),
}


def _one_of(c: str, texts) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(text)})" for text in texts) + ")"


def linked(check: str, folded: str, links: str) -> str:
    """Does the case-folded text, or a link with decoded references, show the feature?

    ``links`` is the text of the links that differ from what the page's text shows.
    """
    pattern, letters, parts = _LINKED[check]
    in_text = []
    for first, rest in parts.items():
        found = f"contains({folded}, {quoted(first)})"
        if rest:
            texts, more = rest
            either = _one_of(folded, texts) + (f" OR {folded} RLIKE {regex(more)}" if more else "")
            found = f"({found} AND ({either}))"
        in_text.append(found)
    in_links = f"{fold_case(links)} RLIKE {regex(at_first_letter(pattern, letters))}"
    return f"({' OR '.join(in_text)} OR ({links} <> '' AND {in_links}))"


def is_local_business(types: str) -> str:
    return f"""exists({types}, ty -> coalesce(contains(ty, '{fixed.LOCAL_BUSINESS}')
        OR ty IN ({any_of(fixed.LOCAL_BUSINESS_SUBTYPES)}), false))"""


def _json(text: str, kind: str) -> str:
    return f"from_json({text}, '{kind}', map('allowSingleQuotes', 'false'))"


def _objects(array: str) -> str:
    """Texts of the objects in a JSON list."""
    return f"filter({_json(array, 'array<string>')}, x -> startswith(x, '{{'))"


def _last(entries: str, key: str) -> str:
    """Value of the last member of that name, '' without one."""
    return f"coalesce(try_element_at(filter({entries}, e -> e.key = 's{key}'), -1).value, '')"


def _types(value: str) -> str:
    """The texts of an ``@type``; of values that are none, their JSON."""
    items = f"if(startswith({value}, '['), {_json(value, 'array<string>')}, array({value}))"
    return f"transform({items}, x -> if(startswith(x, 's'), substr(x, 2), x))"


def has_local_business(blobs: str) -> str:
    """A LocalBusiness object in any JSON-LD blob, at the top or in ``@graph`` lists.

    The walk goes one ``@graph`` level per step, for as many levels as the text can hold; a level is
    the texts of its objects. Of members with one name the last counts, as to readers of JSON. A blob that is not
    one JSON value is skipped. Texts are marked first, so that none is taken for a list or an object.
    """
    none = "cast(array() AS array<string>)"
    # the brackets turn trailing text after the first value into a syntax error
    parsed = _json(f"'[' || {mark_json_texts('b')} || ']'", "array<string>")
    top = f"""transform(array({parsed}), v -> CASE WHEN size(v) <> 1 OR v IS NULL OR v[0] IS NULL THEN {none}
        WHEN startswith(v[0], '[') THEN {_objects('v[0]')} ELSE filter(v, x -> startswith(x, '{{')) END)[0]"""
    levels = r"if(contains(b, '\\'), regexp_count(b, r'\['), regexp_count(b, '@graph'))"
    members = f"transform(acc.level, c -> coalesce(map_entries({_json('c', 'map<string,string>')}), array()))"
    graph = _last("m", "@graph")
    below = f"flatten(transform(ms, m -> if(startswith({graph}, '['), {_objects(graph)}, {none})))"
    found = f"exists(ms, m -> {is_local_business(_types(_last('m', '@type')))})"
    return f"""exists({blobs}, b -> aggregate(sequence(0, {levels}),
        named_struct('level', coalesce({top}, {none}), 'found', false),
        (acc, i) -> transform(array({members}), ms -> named_struct('level', {below}, 'found', acc.found OR {found}))[0],
        acc -> acc.found))"""


def is_parked(lowered: str) -> str:
    named = [m for m in fixed.PARKED if "domain" in m]  # one look at the text for all of these
    others = [m for m in fixed.PARKED if m not in named]
    return f"((contains({lowered}, 'domain') AND {_one_of(lowered, named)}) OR {_one_of(lowered, others)})"


def is_placeholder(status: str, size_in_bytes: str) -> str:
    return f"({status} < 400 AND {size_in_bytes} < {fixed.PLACEHOLDER_BYTES})"


def is_error_page(status: str) -> str:
    return f"({status} >= 400)"


def is_maintenance(lowered: str, title: str) -> str:
    return (
        f"(contains({lowered}, '{fixed.MAINTENANCE_TEXT}')"
        f" OR contains(lower({title}), '{fixed.MAINTENANCE_TITLE}'))"
    )
