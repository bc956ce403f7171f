"""Contact details that one page publishes."""

from __future__ import annotations

from shopfront.functions import fixed
from shopfront.functions.text import any_of, at_first_letter, regex

# The e-mail pattern, read in linear time: a match starts where a run of address characters
# starts or where the last match ended, and the run is taken whole. Each turn of the domain's loop
# goes on to the next label that begins with two letters; it never goes back, so it needs no stack
# however many labels there are. The last such label gives the end.
_EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@"
    r"(?:[A-Za-z0-9-]++\.(?:(?![A-Za-z]{2})[A-Za-z0-9-]++\.)*+(?=[A-Za-z]{2}))++[A-Za-z]{2,}"
)


def _around_signs(text: str) -> str:
    """The text with less between its ``@``: of each part that a space or angle bracket divides, what lies before the
    first of these and after the last. No address holds one, so the same addresses stand in it."""
    before, after = "part", "part"
    for mark in (" ", "<", ">"):
        before, after = f"substring_index({before}, '{mark}', 1)", f"substring_index({after}, '{mark}', -1)"
    return f"""array_join(transform(split({text}, '@'), part ->
        if({before} = part, part, concat({before}, ' ', {after}))), '@')"""


def _found_emails(text: str) -> str:
    return (
        f"if(contains({text}, '@'), regexp_extract_all({_around_signs(text)}, {regex(_EMAIL)}, 0),"
        " cast(array() AS array<string>))"
    )


def emails(text: str, links: str) -> str:
    """First few distinct addresses: those of mailto links, then those in the text."""
    mailto = f"""flatten(transform(filter({links}, l -> lower(l) LIKE 'mailto:%'), l ->
        {_found_emails("substring_index(substr(l, 8), '?', 1)")}))"""
    suffix = "|".join(s.lstrip(".") for s in fixed.EMAIL_BAD_SUFFIXES)
    return f"""slice(array_distinct(filter(transform(
        concat({mailto}, {_found_emails(text)}), e -> lower(btrim(e, '.'))),
        e -> NOT e RLIKE r'\\.({suffix})$'
          AND split(e, '@')[1] NOT IN ({any_of(fixed.EMAIL_BAD_DOMAINS)}))),
        1, {fixed.CONTACTS_KEPT})"""


def phones(links: str) -> str:
    """Distinct numbers of the ``tel:`` links, digits and plus signs only, in order."""
    return f"""array_distinct(filter(transform(filter({links}, l -> lower(l) LIKE 'tel:%'),
        l -> regexp_replace(substr(l, 5), r'[^\\p{{Nd}}+]', '')), p -> p <> ''))"""


def whatsapp_number(folded: str) -> str:
    """First WhatsApp number in the case-folded text, or NULL."""
    pattern = at_first_letter(fixed.WHATSAPP_NUMBER, "wp")
    there = f"(contains({folded}, 'wa.me/') OR contains({folded}, 'phone='))"
    return f"if({there}, nullif(regexp_extract({folded}, {regex(pattern)}, 1), ''), NULL)"


def instagram(text: str) -> str:
    """Profile address from the first Instagram link, or NULL if that is not a profile."""
    handle = f"regexp_extract({text}, {regex(fixed.INSTAGRAM)}, 1)"
    return f"""if(contains({text}, 'instagram.com/'), transform(array({handle}), h ->
        if(h = '' OR lower(h) IN ({any_of(fixed.INSTAGRAM_RESERVED)}), NULL,
           'https://www.instagram.com/' || h))[0], NULL)"""
