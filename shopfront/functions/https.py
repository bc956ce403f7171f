"""Whether a site offers, forces and announces HTTPS, read off the fetch log.

A probe that answers with an error page has answered. An https error seen before falling back
to http settles that there is no HTTPS, unless the fallback itself led back to https.
"""

from __future__ import annotations

from shopfront.functions import fixed, urls


def is_valid(final_url: str, https_error: str, probe_answered: str) -> str:
    return f"""CASE WHEN {urls.scheme(final_url)} = 'https' THEN true
        WHEN {https_error} <> '' THEN false ELSE {probe_answered} END"""


def redirects(
    start_url: str, final_url: str, https_error: str, probe_answered: str, probe_final_url: str
) -> str:
    """Does plain http lead to https? NULL if nobody can tell."""
    return f"""CASE WHEN {urls.scheme(final_url)} = 'https' AND {urls.scheme(start_url)} = 'http'
          THEN true
        WHEN {urls.scheme(final_url)} = 'https' AND {probe_answered}
          THEN {urls.scheme(probe_final_url)} = 'https'
        WHEN {urls.scheme(final_url)} <> 'https' AND {https_error} = '' AND {probe_answered}
          THEN false END"""


def error(final_url: str, https_error: str, probe_answered: str, probe_error: str) -> str:
    return f"""if({urls.scheme(final_url)} <> 'https' AND {https_error} = ''
          AND NOT {probe_answered},
        coalesce(nullif({probe_error}, ''), '{fixed.ERROR_NO_HTTPS}'), {https_error})"""


def probe_url(url: str) -> str:
    """The root of the same host over the other scheme."""
    return f"""(if({urls.scheme(url)} = 'https', 'http://', 'https://')
        || {urls.authority(url)} || '/')"""


def plain_url(url: str) -> str:
    """Where to look when only https may be broken: same host and path, no query."""
    return f"('http://' || {urls.authority(url)} || coalesce(nullif({urls.path(url)}, ''), '/'))"
