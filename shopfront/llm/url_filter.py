"""URL filters that follow redirects: a block on one address of a page holds for its other addresses.

Rules decide what they fit, the longest first. Redirects and canonical links join addresses into groups, by
distributed connected components; an address that no rule fits takes what its group says. An explicit
allow is stronger than a block that only reached an address through its group.

Everything is built-in Spark: hosts meet rules by an equi-join on the host's endings, groups are found
by joins and aggregations of 16-byte fingerprints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfront.functions import urls
from shopfront.functions.text import regex
from shopfront.llm.common import pick
from shopfront.llm.graph import components
from shopfront.staging import release, stage

# Verdict, host, path of the rules of the registered query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"  # where neither a rule nor a group decides

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def host(url: str) -> str:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return f"coalesce(translate(regexp_extract({url}, {regex('(?s)^.*?://([^/?#]*)')}, 1), {_CAPITALS}), '')"


def path(url: str) -> str:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return f"coalesce(regexp_extract({url}, {regex('(?s)^.*?://[^/?#]*([^?#]*)')}, 1), '')"


def fingerprint(url: str) -> str:
    return f"unhex(md5({url}))"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def fitting(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``addresses`` (``host, path`` and others) with ``rule`` and ``ruled``: the longest rule that fits, and its
    verdict; null where none fits.

    Hosts are met with rules once a distinct host: each ending of a host, label by label, is looked up by
    equality. The few rules of a host then come back to its addresses, where paths are compared in the row.
    """
    mine = pick(rules, verdict="string", host="string", path="string").where("verdict IN ('allow', 'block') AND host <> ''")
    mine = mine.select(
        F.col("host").alias("_ending"),
        F.struct(  # in the order of preference: the longest, an allow before a block
            (F.length("host") + F.length(F.coalesce("path", F.lit("")))).alias("long"), (F.col("verdict") == "allow").alias("allow"),
            F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), F.coalesce("path", F.lit("")).alias("path"),
        ).alias("_rule"),
    )
    endings = "transform(sequence(1, size(split(host, '[.]'))), n -> substring_index(host, '.', n - 1 - size(split(host, '[.]'))))"
    hosts = addresses.select("host").where("host <> ''").distinct().select("host", F.explode(F.expr(endings)).alias("_ending"))
    of_host = hosts.join(mine, "_ending").groupBy("host").agg(F.sort_array(F.collect_list("_rule"), asc=False).alias("_rules"))
    first = F.expr("try_element_at(filter(_rules, r -> startswith(path, r.path)), 1)")
    found = addresses.join(of_host, "host", "left").withColumn("_rule", first)
    return found.select(
        *addresses.columns, F.col("_rule.rule").alias("rule"),
        F.when(F.col("_rule.allow"), "allow").when(~F.col("_rule.allow"), "block").alias("ruled"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``source, target``: canonical links and immediate refreshes that pages declare, as absolute addresses."""
    quoted = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(tag: str, name: str) -> str:
        found = " || ".join(f"regexp_extract({tag}, {regex(f'(?is)[^a-z0-9-]{name}{quoted}')}, {at})" for at in (1, 2, 3))
        return f"trim(replace({found}, '&amp;', '&'))"

    canonical = f"""transform(filter(regexp_extract_all(bare, {regex('(?is)<link[^a-z0-9][^>]*>')}, 0),
        t -> array_contains(split(lower({attribute('t', 'rel')}), r'\\s+'), 'canonical')), t -> {attribute('t', 'href')})"""
    refresh = f"""transform(filter(regexp_extract_all(bare, {regex('(?is)<meta[^a-z0-9][^>]*>')}, 0),
        t -> lower({attribute('t', 'http-equiv')}) = 'refresh'),
        t -> trim(regexp_replace(regexp_extract({attribute('t', 'content')}, {regex('(?is)^[0-9. ]*[;,] *url *= *(.*)$')}, 1), {regex("^['\"]|['\"]$")}, '')))"""
    some = pick(pages, url="string", html="string").where(
        f"contains(url, '://') AND html RLIKE {regex('(?i)canonical|refresh')}"
    )
    bare = some.withColumn("bare", F.expr(f"regexp_replace(html, {regex('(?is)<!--.*?-->|<script[^a-z].*?</script')}, ' ')"))
    each = bare.select("url", F.explode(F.expr(f"filter(concat({canonical}, {refresh}), l -> l <> '')")).alias("href"))
    return each.select(F.col("url").alias("source"), F.expr(urls.resolve("url", "href")).alias("target"))


def usual_redirects(pages: DataFrame) -> DataFrame:
    """``source, target``: the redirects that sites usually have, worked out from the addresses of ``pages``.

    Scheme and fragment, a first label ``www``, ``m`` or ``blog``, the parameters ``ref`` and ``utm_...``, and a
    last slash or ``.html`` make no other page. Pages that several sites hold under one path and with one title
    are copies of one article; as copies declare the first publication, they lead to the alphabetically first address.
    """
    site = f"regexp_replace({host('url')}, {regex('^(www|m|blog)[.]')}, '')"
    file = f"regexp_replace({path('url')}, {regex('([.]html|/)$')}, '')"
    kept = f"regexp_replace({urls.query('url')}, {regex('(^|&)(ref|utm_[a-z]+)=[^&]*')}, '')"
    title = f"regexp_extract(html, {regex('(?is)<title>([^<]+)')}, 1)"
    known = pick(pages, url="string", html="string").where("contains(url, '://')").select(
        F.col("url").alias("source"), F.expr(f"'https://' || {site} || {file} || if({kept} = '', '', '?' || {kept})").alias("target"),
        F.when(F.expr(f"{file} <> '' AND {title} <> ''"), F.expr(fingerprint(f"{file} || '>' || {title}"))).alias("_article"),
    ).distinct()
    copies = known.where("_article IS NOT NULL").select("target", "_article").distinct()
    first = copies.groupBy("_article").agg(F.min("target").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    moved = copies.join(first, "_article").select(F.col("target").alias("source"), F.col("_first").alias("target"))
    return known.select("source", "target").unionByName(moved)


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id, url, html``).

    ``rules`` have ``verdict`` (allow or block), ``host`` and ``path``; a rule fits its host and all
    subdomains where the path starts with the rule's. The longest decides, an allow before a block of the same
    length. ``redirects`` have ``source`` and ``target``; with what pages declare themselves they make groups of
    addresses. Where no rule fits: allow if a rule allows an address of the group, or else block if one blocks, or
    else allow.

    A null URL, or one without ``://``, has an empty host and path, no rule, and is allowed. Links to or from
    such addresses, and rules without a host or with another verdict, take no part. Repeated rows come
    out repeated, rows without ``page_id`` too; other columns are not read. A null ``html`` declares nothing.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(pick(redirects, source="string", target="string"))
    links = links.where("contains(source, '://') AND contains(target, '://') AND source <> target").distinct()
    links = stage(links, "url-links")
    # each address of a group once, with its own rule; what groups say is a handful of bytes an address
    prints = links.select(F.expr(fingerprint("source")).alias("a"), F.expr(fingerprint("target")).alias("b"))
    groups = components(prints)
    ends = links.select(F.col("source").alias("url")).unionByName(links.select(F.col("target").alias("url"))).distinct()
    ends = ends.select(F.expr(fingerprint("url")).alias("node"), F.expr(host("url")).alias("host"), F.expr(path("url")).alias("path"))
    ruled = fitting(ends, rules).where("ruled IS NOT NULL").select("node", "ruled")
    said = (
        ruled.join(groups, "node").groupBy("component")
        .agg(F.bool_or(F.col("ruled") == "allow").alias("allowed"))
        .select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("passed"))
    )
    passed = groups.join(said, "component").where(F.col("passed") != DEFAULT).select("node", "passed")
    passed = stage(passed, "url-passed")
    release(links)
    named = pick(pages, page_id="bigint", url="string").select(
        "page_id", F.expr(host("url")).alias("host"), F.expr(path("url")).alias("path"),
        F.when(F.expr("contains(url, '://')"), F.expr(fingerprint("url"))).alias("node"),
    )
    own = fitting(named, rules)
    asks = F.col("ruled").isNull() & F.col("node").isNotNull()  # the others stay where they are
    reached = own.where(asks).join(passed, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("passed", F.lit(DEFAULT)).alias("verdict")
    )
    settled = own.where(~asks).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(DEFAULT)).alias("verdict"))
    return settled.unionByName(reached)
