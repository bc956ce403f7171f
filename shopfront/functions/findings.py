"""Problems and notes of a site, as expressions over its audit row.

Each problem has a stable code and a message; both lists come out in the same order.
"""

from __future__ import annotations

from shopfront.functions import fixed
from shopfront.functions.text import quoted

WORDED = tuple(fixed.CHECK_LABELS)  # checks that are reported when missing


def message(template: str, *values: str) -> str:
    """A template with its holes filled by expressions."""
    parts = template.split("{}")
    pieces = [quoted(parts[0])]
    for value, part in zip(values, parts[1:]):
        pieces += [f"coalesce(string({value}), '')", quoted(part)]
    return "concat(" + ", ".join(pieces) + ")"


def where_looked(paths: str) -> str:
    """How the pages that were checked are named."""
    several = message(fixed.WHERE_PAGES, f"size({paths})", f"array_join({paths}, ', ')")
    return f"if(size({paths}) = 1, {quoted(fixed.WHERE_HOME)}, {several})"


def present(check: str) -> str:
    """Pages that satisfy a check; a contact form satisfies the booking check too."""
    if check == "booking":
        return "array_distinct(concat(booking_found_on, form_found_on))"
    return f"{check}_found_on"


def missing_sitewide() -> str:
    cases = ", ".join(f"if(size({present(c)}) = 0, '{c}', NULL)" for c in WORDED)
    return f"array_compact(array({cases}))"


def missing_home_only(home_path: str) -> str:
    cases = ", ".join(
        f"if(size({present(c)}) > 0 AND NOT array_contains({present(c)}, {home_path}), '{c}', NULL)"
        for c in WORDED
    )
    return f"array_compact(array({cases}))"


def notes() -> str:
    cases = ", ".join(
        f"if(array_contains(missing_home_only, '{c}'), "
        + message(
            fixed.NOTE_HOME_ONLY, quoted(fixed.CHECK_LABELS[c]), f"array_join({present(c)}, ', ')"
        )
        + ", NULL)"
        for c in WORDED
    )
    return f"array_compact(array({cases}))"


def _audited_rules(check_sitemap: bool) -> list[tuple[str, str, str]]:
    """(code, condition, message) of every rule for a site that was read, in report order."""
    told = fixed.MESSAGES
    why = "if(https_error = '', '', concat(' (', https_error, ')'))"
    looked = where_looked("pages_checked")
    missing = [
        (
            f"missing_{c}",
            f"array_contains(missing_sitewide, '{c}')",
            message(
                told["missing"], quoted(fixed.CHECK_LABELS[c]), looked,
                quoted(fixed.CHECK_ADVICE[c]),
            ),
        )
        for c in WORDED
    ]
    no_sitemap = f"{str(check_sitemap).lower()} AND NOT has_sitemap AND NOT broken_or_parked"
    return [
        ("error_page", "status >= 400", message(told["error_page"], "status")),
        ("parked", "status < 400 AND _parked", message(told["parked"])),
        ("maintenance", "_maintenance", message(told["maintenance"])),
        *missing,
        ("no_https", "NOT https", message(told["no_https"], why)),
        ("no_redirect", "https AND http_redirects_to_https = false", message(told["no_redirect"])),
        ("points_to_http", "https AND sitemap_robots_http", message(told["points_to_http"])),
        ("no_viewport", "NOT mobile_viewport", message(told["no_viewport"])),
        ("no_title", "title = ''", message(told["no_title"])),
        ("no_description", "meta_description = ''", message(told["no_description"])),
        ("no_sitemap", no_sitemap, message(told["no_sitemap"])),
        ("slow", f"load_time_ms > {fixed.SLOW_MS}", message(told["slow"], "bigint(load_time_ms)")),
        (
            "heavy", f"page_weight_kb > {fixed.HEAVY_KB}",
            message(told["heavy"], "page_weight_kb"),
        ),
    ]


def problems(check_sitemap: bool) -> str:
    """Problems of a site as an array of (code, message)."""
    def entry(code: str, condition: str, worded: str) -> str:
        return f"if({condition}, named_struct('code', '{code}', 'message', {worded}), NULL)"

    told = fixed.MESSAGES
    rules = ", ".join(entry(*rule) for rule in _audited_rules(check_sitemap))
    stop = {
        "no_url": message(told["no_url"]),
        "robots_start": message(told["robots"]),
        "robots_home": message(told["robots"]),
        "no_response": message(told["no_response"], "error"),
    }
    stopped = " ".join(
        f"WHEN '{state}' THEN array(named_struct('code', '{state}', 'message', {worded}))"
        for state, worded in stop.items()
    )
    return f"CASE state {stopped} ELSE array_compact(array({rules})) END"
