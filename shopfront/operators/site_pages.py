"""Site-wide merges over any number of pages per site.

A site may own a third of all rows, so nothing gathers a site's pages: values are reduced
before every shuffle, and only the few that are kept are ever listed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfront.functions import fixed

def first_values(
    pages: DataFrame, site: str, page_no: str, values: str, keep: int = fixed.CONTACTS_KEPT
) -> DataFrame:
    """(site, values): the first distinct values of a list column, in page order, joined.

    Each value is reduced to its first position (partial aggregation), then the first few per
    site are kept (the window's limit also runs before its shuffle).
    """
    # the outer form keeps the optimizer from testing the list, and so computing it, first
    listed = pages.selectExpr(
        f"{site} AS site", f"bigint({page_no}) AS _page",
        f"posexplode_outer({values}) AS (_pos, _value)",
    ).where("_value IS NOT NULL")
    firsts = listed.groupBy("site", "_value").agg(F.expr("min(struct(_page, _pos))").alias("_at"))
    kept = firsts.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("site").orderBy("_at"))
    ).where(F.col("_rank") <= keep)
    return kept.groupBy("site").agg(
        F.expr(
            "array_join(transform(array_sort(collect_list(struct(_rank, _value))),"
            " v -> v._value), ', ')"
        ).alias(values)
    )


def first_value(pages: DataFrame, site: str, page_no: str, value: str) -> DataFrame:
    """(site, value): the first value that is not NULL, in page order."""
    return (
        pages.where(f"{value} IS NOT NULL")
        .groupBy(F.col(site).alias("site"))
        .agg(F.min_by(value, page_no).alias(value))
    )


def presence(pages: DataFrame, site: str, checks: tuple[str, ...]) -> DataFrame:
    """Per site: on how many pages each check holds, whether it holds at all, and the rest.

    ``missing`` names the checks that hold nowhere, a contact form standing in for booking.
    """
    counts = [F.count_if(F.col(c)).alias(f"{c}_pages") for c in checks]
    sums = pages.groupBy(F.col(site).alias("site")).agg(
        F.count(F.lit(1)).alias("pages"), *counts
    )
    met = {c: f"{c}_pages > 0" for c in checks}
    if "booking" in met and "form" in met:
        met["booking"] = "booking_pages + form_pages > 0"
    named = ", ".join(f"if({met[c]}, NULL, '{c}')" for c in checks if c != "form")
    return sums.selectExpr(
        "*", *(f"{c}_pages > 0 AS has_{c}" for c in checks),
        f"array_join(array_compact(array({named})), ',') AS missing",
    )
