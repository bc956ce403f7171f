"""robots.txt decisions for rule sets of any size, by joins instead of a look at every rule.

An array of rules in a site's row (``functions/robots.py``) is right for the files that sites have, of some dozens of
rules. For tens of thousands, the first rule of each path stands in a table, and an address meets it by
those of its own prefixes that are as long as some rule. Its cost follows from how many lengths the rules
have, not from how many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.functions import robots
from shopfront.operators.lookup import lookup
from shopfront.staging import stage

_KEY = "concat(length(origin), ':', origin, path)"


def first_matches(rules: DataFrame) -> DataFrame:
    """(origin, path, seq, allow): of the rules with one path the first, the only one that can ever decide."""
    first = F.min(F.struct("seq", "allow")).alias("first")
    return rules.groupBy("origin", "path").agg(first).select("origin", "path", "first.*")


def decide(pages: DataFrame, rules: DataFrame, min_hot_rows: int = 1_000_000) -> DataFrame:
    """(url, origin, allowed) for every row of ``pages`` (``url``, ``origin``), by ``rules`` (``origin``, ``seq``, ``allow``,
    ``path``) of the group that applies: the first that an address begins with decides, and without one it is allowed.

    Origins with most of the pages, and rules that most addresses begin with, are split (see ``lookup``).
    """
    first = stage(first_matches(rules), "first-matches")
    lengths = first.groupBy("origin").agg(F.collect_set(F.length("path")).alias("_lengths"))
    asked = stage(pages.select("url", "origin").distinct(), "asked")
    aimed = lookup(asked, lengths, "origin", min_hot_rows).selectExpr("url", "origin", "_lengths", f"{robots.target('url')} AS _target")
    prefixes = aimed.selectExpr(
        "url", "origin", "explode(transform(filter(_lengths, n -> n <= length(_target)), n -> left(_target, n))) AS path"
    )
    keyed = stage(prefixes.selectExpr("url", "origin", f"{_KEY} AS _rule"), "prefixes")
    met = lookup(keyed, first.selectExpr(f"{_KEY} AS _rule", "seq", "allow"), "_rule", min_hot_rows).where("seq IS NOT NULL")
    decided = met.groupBy("url", "origin").agg(F.min_by("allow", "seq").alias("allowed"))
    return pages.select("url", "origin").join(decided, ["url", "origin"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
