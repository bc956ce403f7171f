"""String expressions shared by the other function modules.

Every function in this package takes and returns SQL expression text: wrap it in ``F.expr``
or paste it into ``spark.sql``. All of it stays on built-in Spark functions.
"""

from __future__ import annotations

import html.entities
import json

from shopfront.functions.fixed import WHITESPACE


def regex(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def quoted(value: str) -> str:
    """A plain SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(values) -> str:
    """The inside of an IN list."""
    return ", ".join(quoted(v) for v in values)


_SPACE = quoted("".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE)).replace("\\\\u", "\\u")
_SPACE_RUN = "[" + "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE) + "]+"


def strip(c: str) -> str:
    """Trim Unicode whitespace, no-break space included."""
    return f"btrim({c}, {_SPACE})"


def collapse(c: str) -> str:
    """Trim, and turn every run of whitespace into one space."""
    return f"btrim(regexp_replace({c}, {regex(_SPACE_RUN)}, ' '))"


def fold_lowered(c: str) -> str:
    """Lower-cased text with the letters that Unicode case folding equates with ASCII ones."""
    return f"replace(replace(replace({c}, 'i\\u0307', 'i'), '\\u0131', 'i'), '\\u017f', 's')"


def fold_case(c: str) -> str:
    """Text as a case-insensitive Unicode pattern sees it."""
    return fold_lowered(f"lower({c})")


def at_first_letter(pattern: str, letters: str) -> str:
    """Put a one-letter lookahead before an alternation, so most positions fail at once."""
    return f"(?=[{letters}]){pattern}"


_JSON_TEXT = r'((?:[^"\\]|\\.)*+)"'


def mark_json_texts(c: str) -> str:
    """JSON in which every text, names too, begins with an ``s``. Read as texts, values then show their kind
    by their first letter: a text that looks like a list or an object is none."""
    return f"regexp_replace({c}, {regex('(?s)"' + _JSON_TEXT)}, '\"s$1\"')"


def unmark_json_texts(c: str) -> str:
    return f"regexp_replace({c}, {regex('(?s)"s' + _JSON_TEXT)}, '\"$1\"')"


# --- character references ---------------------------------------------------------------
# The named references come from the public HTML5 table that ships with Python.
_NAMED = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
_LEGACY = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
_UNASSIGNED_C1 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_C1 = {
    str(n): chr(n) if n in _UNASSIGNED_C1 else bytes([n]).decode("cp1252")
    for n in range(0x80, 0xA0)
}


def _map_literal(table: dict, schema: str) -> str:
    text = json.dumps(table).replace("'", "\\u0027")
    return f"from_json(r'{text}', '{schema}')"


def _by_initial(names: dict[str, str]) -> str:
    table: dict[str, dict[str, str]] = {}
    for name, value in names.items():
        table.setdefault(name[0], {})[name] = value
    return _map_literal(table, "map<string,map<string,string>>")


_NAMED_MAP = _by_initial(_NAMED)
_LEGACY_MAP = _by_initial(_LEGACY)
_C1_MAP = _map_literal(_C1, "map<string,string>")


def _look_up(table: str, name: str) -> str:
    return f"try_element_at(try_element_at({table}, left({name}, 1)), {name})"


def _character(code: str) -> str:
    """The character a numeric reference stands for."""
    return f"""CASE
        WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN '\\ufffd'
        WHEN {code} BETWEEN 128 AND 159 THEN try_element_at({_C1_MAP}, string({code}))
        WHEN {code} BETWEEN 1 AND 8 OR {code} = 11 OR {code} BETWEEN 14 AND 31 OR {code} = 127
          OR {code} BETWEEN 64976 AND 65007 OR ({code} & 65534) = 65534 THEN ''
        ELSE decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') END"""


def _code(ref: str) -> str:
    """Code point of a ``#…;`` reference; far out of range for overlong digits."""
    digits = f"regexp_replace(regexp_extract({ref}, '[0-9a-fA-F]+', 0), '^0+(?=.)', '')"
    number = f"if(lower({ref}) LIKE '#x%', conv({digits}, 16, 10), {digits})"
    return f"if(length({digits}) > 9, 1114112L, bigint({number}))"


def _decode_after_ampersand(p: str) -> str:
    """Decode the text that follows one ``&``."""
    number = f"regexp_extract({p}, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?', 0)"
    named = f"regexp_extract({p}, '^[a-zA-Z][a-zA-Z0-9]{{1,31}};', 0)"
    longest_first = "|".join(sorted(_LEGACY, key=len, reverse=True))
    legacy = f"regexp_extract({p}, '^(?:{longest_first})', 0)"
    # one-element arrays name an intermediate value inside a lambda
    return f"""CASE
        WHEN startswith({p}, 'amp;') THEN '&' || substr({p}, 5)
        WHEN startswith({p}, 'nbsp;') THEN '\\u00a0' || substr({p}, 6)
        WHEN startswith({p}, '#') THEN transform(array({number}), ref ->
            if(ref = '', '&' || {p}, transform(array({_code('ref')}), code ->
                {_character('code')})[0] || substr({p}, length(ref) + 1)))[0]
        ELSE coalesce(
            transform(array({named}), ref ->
                {_look_up(_NAMED_MAP, 'ref')} || substr({p}, length(ref) + 1))[0],
            transform(array({legacy}), ref ->
                {_look_up(_LEGACY_MAP, 'ref')} || substr({p}, length(ref) + 1))[0],
            '&' || {p}) END"""


def decode_entities(c: str) -> str:
    """Replace HTML character references, named and numeric, in one left-to-right pass.

    Most text has no reference, and most references are ``&amp;``: both have a short way.
    """
    return f"""CASE WHEN NOT contains({c}, '&') THEN {c}
        WHEN NOT {c} RLIKE '&(?!amp;)' THEN replace({c}, '&amp;', '&')
        ELSE transform(array(split({c}, '&')), pieces ->
          pieces[0] || array_join(transform(slice(pieces, 2, size(pieces)), piece ->
            {_decode_after_ampersand('piece')}), ''))[0] END"""


def number_text(value: str) -> str:
    """A double in the usual short form: plain decimals from 0.0001 up to sixteen digits, else with
    an exponent of two digits at least (``0.0005``, ``12345678.5``, ``1e-07``)."""
    shown = f"string({value})"
    plain = f"rtrim('0', string(cast({shown} AS decimal(38, 21))))"
    mantissa = rf"regexp_replace(split({shown}, 'E')[0], r'\.0$', '')"
    power = f"int(split({shown}, 'E')[1])"
    exponent = f"concat('e', if({power} < 0, '-', '+'), lpad(string(abs({power})), 2, '0'))"
    return f"""CASE WHEN NOT contains({shown}, 'E') THEN {shown}
        WHEN abs({value}) >= 1e-4D AND abs({value}) < 1e16D
          THEN if(endswith({plain}, '.'), {plain} || '0', {plain})
        ELSE {mantissa} || {exponent} END"""
