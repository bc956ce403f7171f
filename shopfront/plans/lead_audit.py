"""Audit of a list of leads: every lead row with the audit of its website."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.functions import fixed, urls
from shopfront.functions.text import quoted
from shopfront.operators.lookup import lookup
from shopfront.plans.site_audit import AuditOptions, audit
from shopfront.sources import sinks
from shopfront.staging import stage

_FLAGS = (
    "fetched", "https", "sitemap_robots_http", "mobile_viewport", "has_jsonld_localbusiness",
    "has_maps_link", "has_whatsapp_link", "has_booking_link", "has_contact_form",
    "broken_or_parked", "has_sitemap", "robots_disallowed",
)
NO_SITE = (
    {f: "" for f in fixed.AUDIT_FIELDS}
    | {f: "False" for f in _FLAGS}
    | {"status": "0", "visible_text_chars": "0", "page_weight_kb": "0.0", "load_time_ms": "0.0"}
    | {"error": fixed.ERROR_NO_URL, "problems": fixed.MESSAGES["no_url"]}
)


def lead_url(columns: list[str]) -> str:
    """The lead's website, else its url column, '' if it has neither."""
    named = [f"nullif(`{c}`, '')" for c in ("website", "url") if c in columns]
    return f"coalesce({', '.join([*named, quoted('')])})"


def free_name(columns: list[str], name: str = "lead_no") -> str:
    """``name``, with underscores added while a column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def with_site(leads: DataFrame, site: str) -> DataFrame:
    """Add the address that a lead's website is audited under, null without one."""
    url = lead_url(leads.columns)
    return leads.withColumn(site, F.expr(f"if({url} = '', NULL, {urls.with_default_scheme(url)})"))


def merge_audits(
    leads: DataFrame, audits: DataFrame, min_hot_rows: int = 1_000_000, order: str = "lead_no", site: str | None = None
) -> DataFrame:
    """Leads joined to flat audits, ``order`` (their column that gives the order) first. On a name
    clash the audit value wins; names that differ by case are different columns.

    Leads without a website match nothing, and a website that many leads share does not gather them in one
    task. Staged leads that have their address already name its column as ``site``.
    """
    columns = [c for c in leads.columns if c not in (order, site)]
    if site is None:
        site = free_name(leads.columns, "_site")
        leads = stage(with_site(leads, site), "leads")
    renamed = audits.selectExpr(f"url AS `{site}`", *(f"{f} AS _audit_{f}" for f in fixed.AUDIT_FIELDS))
    joined = lookup(leads, renamed, site, min_hot_rows, some_keys_null=True)
    merged = [
        f"coalesce(_audit_{c}, {quoted(NO_SITE[c])}) AS `{c}`"
        if c in fixed.AUDIT_FIELDS
        else f"`{c}`"
        for c in sinks.merged_fields(columns)
    ]
    return joined.selectExpr(f"`{order}`", *merged)


def audit_leads(
    leads: DataFrame, fetches: DataFrame, options: AuditOptions = AuditOptions(), order: str | None = None
) -> DataFrame:
    """Every lead with the audit columns added. The first column gives the order of the input: the leads' own column
    ``order``, as ``leads.load`` adds it, or else ``lead_no`` (with underscores if the leads have such a
    column themselves), which numbers the rows as Spark reads them.

    A website that occurs in many leads is audited once. The leads are written once.
    """
    if order is None:
        order = free_name(leads.columns)
        leads = leads.withColumn(order, F.monotonically_increasing_id())
    site = free_name(leads.columns, "_site")
    numbered = stage(with_site(leads, site), "numbered")
    sites = numbered.where(F.col(site).isNotNull()).select(F.col(site).alias("url"))
    audits = stage(sinks.flat_audits(audit(sites, fetches, options)), "audits")
    return merge_audits(numbered, audits, order=order, site=site)


def write_audited(audited: DataFrame, path: str) -> None:
    """The merged rows as CSV, in the order of the lead file, which the first column gives."""
    order, *fields = audited.columns
    sinks.write_csv(audited.orderBy(order), fields, path)
