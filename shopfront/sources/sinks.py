"""CSV sinks and the flat forms they write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.functions import fixed


def write_csv(rows: DataFrame, fields: tuple[str, ...] | list[str], path: str) -> None:
    """Write the named columns in order; other columns are dropped, missing ones are ''.

    Columns are read by position, so names may differ by case alone, as a lead file's ``Title`` and
    the audit's ``title`` do; the writer is told that such names are different.
    """
    names, spark = rows.columns, rows.sparkSession
    flat = rows.toDF(*(f"_{at}" for at in range(len(names))))
    columns = [
        F.coalesce(F.col(f"_{names.index(f)}").cast("string"), F.lit("")).alias(f)
        if f in names
        else F.lit("").alias(f)
        for f in fields
    ]
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        (
            flat.select(*columns)
            .write.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def write_leads(leads: DataFrame, path: str) -> None:
    write_csv(leads, fixed.LEAD_FIELDS, path)


_JOINED = {
    "problems": "; ", "notes": "; ", "pages_checked": " ", "pages_failed": " ",
    "missing_sitewide": ",", "missing_home_only": ",", "emails": ", ", "phones": ", ",
} | {f"{c}_found_on": " " for c in fixed.CHECKS}


def flat_audits(audits: DataFrame) -> DataFrame:
    """Audit rows as text: lists joined, unknown answers '', flags ``True`` or ``False``."""
    flat = []
    for field in fixed.AUDIT_FIELDS:
        if field in _JOINED:
            text = f"array_join({field}, '{_JOINED[field]}')"
        elif dict(audits.dtypes)[field] == "boolean":
            text = f"initcap(string({field}))"
        else:
            text = f"string({field})"
        flat.append(f"coalesce({text}, '') AS {field}")
    return audits.selectExpr(*flat)


def write_audit(audits: DataFrame, url: str, path: str) -> None:
    """The audit of one site as a one-row CSV."""
    write_csv(flat_audits(audits.where(F.col("url") == url)), fixed.AUDIT_FIELDS, path)


def merged_fields(lead_columns: list[str]) -> list[str]:
    """Columns of the merged file: the lead's own, then the audit columns not among them."""
    return lead_columns + [f for f in fixed.AUDIT_FIELDS if f not in lead_columns]
