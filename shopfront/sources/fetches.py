"""The fetch log: one row per requested URL.

Columns: ``url, final_url, status, headers map<string,string>, body binary, elapsed_ms, error``.
A URL must occur once; a failed request has status 0 or an error. A log of several crawls is brought
into that form by ``latest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FETCH_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.BinaryType()),
        T.StructField("elapsed_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


def text(body: str) -> str:
    """UTF-8 text of a body, with replacement characters for malformed bytes."""
    return f"make_valid_utf8(cast({body} AS string))"


def ok(status: str, error: str) -> str:
    """No error and a status from 200 up to 399."""
    return f"({error} IS NULL AND {status} >= 200 AND {status} < 400)"


def answered(status: str, error: str) -> str:
    """Any HTTP answer at all, error pages included."""
    return f"(coalesce({status}, 0) <> 0 AND {error} IS NULL)"


def content_type(headers: str) -> str:
    """Lower-cased Content-Type, '' if absent."""
    return (
        f"lower(coalesce(nullif({headers}['Content-Type'], ''), {headers}['content-type'], ''))"
    )


def is_html_answer(status: str, error: str, kind: str) -> str:
    """The page can be read: no error, no error status, and HTML or untyped."""
    return (
        f"coalesce({error} IS NULL AND {status} < 400"
        f" AND ({kind} = '' OR contains({kind}, 'html')), false)"
    )


def with_status(fetches: DataFrame) -> DataFrame:
    """Add ``ok``, ``answered``, ``content_type`` and ``text`` to a fetch log."""
    return fetches.selectExpr(
        "*",
        f"{ok('status', 'error')} AS ok",
        f"{answered('status', 'error')} AS answered",
        f"{content_type('headers')} AS content_type",
        f"{text('body')} AS text",
    )


def latest(fetches: DataFrame, when: str) -> DataFrame:
    """The row with the largest ``when`` (a column of the log) of each URL, without that column. Rows
    of one URL are reduced before they are shuffled; on a tie any one of them is taken, whole."""
    kept = [c for c in fetches.columns if c not in ("url", when)]
    newest = F.max_by(F.struct(*kept), when).alias("_row")
    return fetches.groupBy("url").agg(newest).select("url", "_row.*").select(
        *(c for c in fetches.columns if c != when)
    )


def require_distinct(rows: DataFrame) -> None:
    """An error if some URL occurs more than once; only URLs are counted, not their rows moved."""
    twice = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(
            f"the fetch log has {twice[0]['n']} rows for {twice[0]['url']!r}; reduce it with"
            " sources.fetches.latest first"
        )
