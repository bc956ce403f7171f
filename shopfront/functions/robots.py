"""robots.txt as expressions: groups, rules, and the decision for one URL.

A file becomes one array of groups in its own row, so a check is a lookup in that array: no
rule rows are joined to URLs, and no origin can blow a join up. Rules are the plain ones: the
first matching prefix of the chosen group decides.
"""

from __future__ import annotations

from shopfront.functions import urls
from shopfront.functions.text import quoted, regex, strip

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# agents, then rules, with nothing blank between them
_GROUP = r"(?:A[^\n]*+\n)++(?:[-+0][^\n]*+\n)++"
GROUPS = "array<struct<agents:array<string>,rules:array<struct<allow:boolean,path:string>>>>"


def lines(text: str) -> str:
    return f"split({text}, {regex(_LINE_BREAK)})"


def _coded_line(line: str) -> str:
    """One line as a letter and its value: A agent, - disallow, + allow, 0 other rule.

    A blank line stays blank, and NULL marks a line to skip. An empty Disallow allows.
    """
    bare = strip(f"regexp_replace({line}, '(?s)#.*$', '')")
    # a lone "?" at the end names no query
    rule = "regexp_replace(replace(value, '\\n', ' '), '^([^?]*)\\\\?$', '$1')"
    return f"""if({line} = '', '', transform(array({bare}), bare -> if(NOT contains(bare, ':'), NULL,
        transform(array(named_struct(
            'key', lower({strip("substring_index(bare, ':', 1)")}),
            'val', {strip("substr(bare, instr(bare, ':') + 1)")})), kv ->
          transform(array({urls.unquote('kv.val')}), value -> CASE kv.key
            WHEN 'user-agent' THEN 'A' || replace(value, '\\n', ' ')
            WHEN 'disallow' THEN if(value = '', '+', '-' || {rule})
            WHEN 'allow' THEN '+' || {rule}
            WHEN 'crawl-delay' THEN '0'
            WHEN 'request-rate' THEN '0' END)[0])[0]))[0])"""


def groups(text: str) -> str:
    """Groups of a robots.txt in file order: their agents and their rules."""
    coded = f"""array_join(filter(transform({lines(text)}, line -> {_coded_line('line')}),
        c -> c IS NOT NULL), '\\n') || '\\n'"""
    return f"""transform(regexp_extract_all({coded}, {regex(_GROUP)}, 0), g -> transform(
        array(filter(split(g, '\\n'), c -> c <> '')), cs -> named_struct(
          'agents', transform(filter(cs, c -> startswith(c, 'A')), c -> substr(c, 2)),
          'rules', transform(filter(cs, c -> left(c, 1) IN ('-', '+')), c -> named_struct(
            'allow', startswith(c, '+'), 'path', substr(c, 2)))))[0])"""


def sitemaps(text: str) -> str:
    """Values of the ``Sitemap:`` lines, in file order."""
    return f"""transform(filter({lines(text)}, line -> lower(line) LIKE 'sitemap:%'),
        line -> {strip('substr(line, 9)')})"""


def rules_for(all_groups: str, user_agent: str) -> str:
    """Rules of the group that applies to a user agent, empty if none does.

    The first group naming the agent wins, else the first ``*`` group.
    """
    name = quoted(user_agent.split("/")[0].lower())
    named = f"""filter({all_groups}, g -> NOT array_contains(g.agents, '*')
        AND exists(g.agents, a -> contains({name}, lower(a))))"""
    default = f"filter({all_groups}, g -> array_contains(g.agents, '*'))"
    return f"""coalesce(get({named}, 0).rules, get({default}, 0).rules,
        cast(array() AS array<struct<allow:boolean,path:string>>))"""


def target(url: str) -> str:
    """What rules are matched against: everything behind the authority, percent-decoded."""
    behind = "regexp_extract(u, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?(.*)$', 1)"
    plain = "regexp_replace(regexp_replace({}, '#$', ''), '^([^?]*)\\\\?$', '$1')"
    return f"""transform(array({urls.unquote(url)}), u ->
        coalesce(nullif({plain.format(behind)}, ''), '/'))[0]"""


def allows(rules: str, url: str) -> str:
    """Decision of the first matching rule; allowed if there is none (or no robots file)."""
    return f"""coalesce(transform(array({target(url)}), t ->
        get(filter({rules}, r -> startswith(t, r.path)), 0).allow)[0], true)"""
