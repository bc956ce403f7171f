"""Language by Bayesian fusion of what a text says and where it comes from.

Evidence: the likelihood of the text under a model of character sequences; the language that the
markup declares; the language that the address suggests; and a prior for the host, smoothed towards
its address suffix, which is smoothed towards the whole corpus. How far declarations and addresses can
be trusted is itself estimated, by grouped sums of the text-only posteriors over all rows.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfront.llm.common import by_batch, held, pick
from shopfront.llm.gru import core, grams
from shopfront.operators.lookup import lookup
from shopfront.staging import stage

BUCKETS = 1 << 14
#: The sample the text model learns from: rows of each language, however many languages there are.
SAMPLE_ROWS = 1000
#: Words whose evidence counts in full; that of a longer text is scaled down to so many, since its
#: words are far from independent.
FULL_WORDS = 30
#: Weight, in rows, of the suffix in a host's prior and of the corpus in a suffix's; of the
#: corpus in what declarations and addresses say.
HOST_WEIGHT, SUFFIX_WEIGHT, HINT_WEIGHT = 5.0, 20.0, 2.0
KEPT_CHUNKS = 300_000

#: Country suffixes that suggest a language; fixed values.
SUFFIX_LANGUAGE = {
    "ar": "es", "at": "de", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "cz": "cs", "de": "de",
    "dk": "da", "es": "es", "fi": "fi", "fr": "fr", "gr": "el", "hu": "hu", "ie": "en", "it": "it",
    "jp": "ja", "kr": "ko", "mx": "es", "nl": "nl", "no": "no", "nz": "en", "pl": "pl", "pt": "pt",
    "ro": "ro", "ru": "ru", "se": "sv", "tr": "tr", "ua": "uk", "uk": "en", "us": "en",
}
_DECLARED = re.compile(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})")
_URL = re.compile(r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)")


def visible(html: str) -> str:
    """The text between tags, without comments, scripts and styles; one pass."""
    out, at, lower = [], 0, html.lower()
    while at < len(html):
        tag = html.find("<", at)
        if tag < 0:
            out.append(html[at:])
            break
        out.append(html[at:tag])
        closing = ">"
        if html.startswith("<!--", tag):
            closing = "-->"
        elif lower.startswith("<script", tag):
            closing = "</script"
        elif lower.startswith("<style", tag):
            closing = "</style"
        end = lower.find(closing, tag + 1)
        if end < 0:
            break
        at = end + len(closing)
        if closing[0] == "<":
            at = html.find(">", at) + 1 or len(html)
    return " ".join(out)


def address(url: str | None) -> tuple[str | None, str, str | None]:
    """Host, its suffix, and the language the address suggests, by path or country."""
    found = _URL.match(url or "")
    if not found or not found[1]:
        return None, "", None
    host = found[1].lower().rstrip(".")
    suffix = host.rpartition(".")[2]
    first = found[2].strip("/").split("/")[0].lower()
    path = re.fullmatch(r"([a-z]{2})(?:[-_][a-z]{2})?", first)
    return host, suffix, path[1] if path else SUFFIX_LANGUAGE.get(suffix)


class TextModel:
    """Log likelihoods of words in each language, from counts of hashed character sequences."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.name = languages, uuid.uuid4().hex
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """[words, languages]: the mean over a word's sequences, against the mean language."""
        found, at = grams(words)
        summed = np.add.reduceat(self.logs[found % BUCKETS], at[:-1], axis=0)
        each = summed / np.diff(at)[:, None]
        return each - each.mean(axis=1, keepdims=True)


class Reader:
    def __init__(self, model: TextModel):
        self.model = model
        self.start()

    def start(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.languages)), np.float32)

    def evidence(self, texts: list[str]) -> list[list[float]]:
        """Log likelihoods of the texts, scaled down to ``FULL_WORDS`` words."""
        cut = [text.split() for text in texts]
        new = list(set().union(*cut).difference(self.number))
        if len(new) + len(self.number) > KEPT_CHUNKS:
            self.start()
            new = list(set().union(*cut))
        tables = [self.table]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))
            made = self.model.words([core(c) for c in part])
            made[[not any(map(str.isalpha, c)) for c in part]] = 0  # says nothing
            tables.append(made)
        self.table = np.concatenate(tables)
        out = []
        for chunks in cut:
            if not chunks:
                out.append([0.0] * len(self.model.languages))
                continue
            at = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
            total = self.table[at].sum(axis=0, dtype=np.float64)
            out.append((total * min(1.0, FULL_WORDS / len(chunks))).tolist())
        return out


def reader(model: TextModel) -> Reader:
    return held(("language reader", model.name), lambda: Reader(model))


def fit(labelled: DataFrame) -> TextModel:
    """The text model from at most ``SAMPLE_ROWS`` rows of every value of ``lang`` (``doc_id, text,
    lang``), those whose ids have the smallest hashes."""
    rows = pick(labelled, doc_id="bigint", text="string", lang="string").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {row["lang"]: row["count"] for row in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return TextModel(["und"], np.zeros((BUCKETS, 1)))
    # hashes are spread evenly, so the smallest of a language lie below twice their share of all hashes
    below = [(lang, min(2**63 - 1, -(2**63) + 2**64 * 2 * SAMPLE_ROWS // n)) for lang, n in sizes.items()]
    bounds = F.broadcast(rows.sparkSession.createDataFrame(below, "lang string, below bigint"))
    mixed = F.xxhash64("doc_id")
    first = rows.join(bounds, "lang").where(mixed <= F.col("below")).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(mixed, "doc_id"))
    chosen = first.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS).select("doc_id", "lang").distinct()

    def work(part: dict[str, list]) -> dict[str, list]:
        counts = {}
        for text, lang in zip(part["text"], part["lang"]):
            words = [core(c) for c in text.split()]
            if words:
                found = np.bincount(grams(words)[0] % BUCKETS, minlength=BUCKETS)
                counts[lang] = counts.get(lang, 0) + found
        out = {"lang": [], "bucket": [], "n": []}
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            out["lang"] += [lang] * len(at)
            out["bucket"] += at.tolist()
            out["n"] += found[at].tolist()
        return out

    few = rows.join(F.broadcast(chosen), ["doc_id", "lang"])  # at most SAMPLE_ROWS ids a language
    found = by_batch(few, "lang string, bucket int, n bigint", work).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((BUCKETS, len(languages)))
    number = {lang: at for at, lang in enumerate(languages)}
    each = found.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns"))
    for row in each.toLocalIterator():  # at most BUCKETS counts a language
        counts[row["buckets"], number[row["lang"]]] = row["ns"]
    return TextModel(languages, counts)


EVIDENCE = "kind string, id bigint, host string, suffix string, declared string, hint string, logs array<double>"


def page_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """Evidence of web pages (``page_id, url, html``)."""

    def known(language: str | None) -> str:
        return "none" if not language else language if language in model.languages else "other"

    def work(rows: dict[str, list]) -> dict[str, list]:
        html = [h or "" for h in rows["html"]]
        places = [address(url) for url in rows["url"]]
        said = [_DECLARED.search(h) for h in html]
        return {
            "kind": ["page"] * len(html), "id": rows["page_id"],
            "host": [p[0] for p in places], "suffix": [p[1] for p in places],
            "declared": [known(s[1].lower() if s else None) for s in said],
            "hint": [known(p[2]) for p in places],
            "logs": reader(model).evidence([visible(h) for h in html]),
        }

    return by_batch(pick(pages, page_id="bigint", url="string", html="string"), EVIDENCE, work)


def document_evidence(docs: DataFrame, model: TextModel) -> DataFrame:
    """Evidence of plain documents (``doc_id, text, source``): the source stands for the host."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        size = len(rows["doc_id"])
        return {
            "kind": ["document"] * size, "id": rows["doc_id"],
            "host": [s and f"source:{s}" for s in rows["source"]], "suffix": ["source:"] * size,
            "declared": ["none"] * size, "hint": ["none"] * size,
            "logs": reader(model).evidence([t or "" for t in rows["text"]]),
        }

    return by_batch(pick(docs, doc_id="bigint", text="string", source="string"), EVIDENCE, work)


def _posterior(logs: str) -> str:
    return (f"transform({logs}, x -> exp(x - array_max({logs})) / aggregate({logs}, 0D,"
            f" (s, y) -> s + exp(y - array_max({logs}))))")


def _array(values: np.ndarray) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _sums(table: DataFrame, size: int, *keys: str) -> DataFrame:
    each = [F.sum(F.col("own")[at]).alias(f"_{at}") for at in range(size)]
    return table.groupBy(*keys).agg(*each).select(*keys, F.array(*(f"_{at}" for at in range(size))).alias("sums"))


def fuse(evidence: DataFrame, model: TextModel) -> DataFrame:
    """``kind, id, host, declared, hint, lang, confidence`` for every row of ``evidence``.

    ``lang`` is the likeliest language, the first in the alphabet on a tie; without any evidence it
    is the prior's. A null or empty text says nothing, a row without a host takes the prior of
    its suffix, and one without an address that of the corpus. Null ids stay; repeated rows come out
    repeated; an empty table gives no rows.
    """
    languages, size = model.languages, len(model.languages)
    rows = stage(evidence.withColumn("own", F.expr(_posterior("logs"))), "language-evidence")

    # bounded tables: a row for each suffix is aggregated by Spark, and one for each known language
    whole = np.array((_sums(rows, size).first() or [None])[0] or [0.0] * size) if not rows.isEmpty() else np.zeros(size)
    corpus = (whole + 1) / (whole.sum() + size)
    trust = {}
    for name in ("declared", "hint"):
        counted = {row[name]: np.array(row["sums"]) for row in _sums(rows, size, name).collect()}
        total = sum(c.sum() for c in counted.values())
        said = {}
        for value, sums in counted.items():
            share = sums.sum() / total
            said[value] = np.log((sums + HINT_WEIGHT * share) / (whole + HINT_WEIGHT))
        trust[name] = said

    prior = f"transform(sums, (x, i) -> (x + {SUFFIX_WEIGHT}D * {_array(corpus)}[i]) / (aggregate(sums, 0D, (s, y) -> s + y) + {SUFFIX_WEIGHT}D))"
    suffixes = _sums(rows, size, "suffix").select("suffix", F.expr(prior).alias("suffix_prior"))
    hosts = _sums(rows.where("host IS NOT NULL"), size, "host").withColumnRenamed("sums", "host_sums")
    placed = lookup(lookup(rows, suffixes, "suffix"), hosts, "host", some_keys_null=True)

    def said(name: str) -> str:
        cases = " ".join(f"WHEN '{value}' THEN {_array(logs)}" for value, logs in sorted(trust[name].items()))
        return f"CASE {name} {cases} ELSE {_array(np.zeros(size))} END" if cases else _array(np.zeros(size))

    # a row's own text must not count twice, so it is taken out of its host's sums
    host_prior = (
        f"transform(suffix_prior, (p, i) -> ln((greatest(coalesce(host_sums[i] - own[i], 0D), 0D) + {HOST_WEIGHT}D * p)"
        f" / (greatest(coalesce(aggregate(host_sums, 0D, (s, y) -> s + y) - 1D, 0D), 0D) + {HOST_WEIGHT}D)))"
    )
    joined = placed.withColumn("prior", F.expr(host_prior)).withColumn("d", F.expr(said("declared"))).withColumn("h", F.expr(said("hint")))
    fused = joined.withColumn("fused", F.expr("transform(logs, (x, i) -> x + prior[i] + d[i] + h[i])"))
    final = fused.withColumn("posterior", F.expr(_posterior("fused")))
    names = "array(" + ", ".join(f"'{name}'" for name in languages) + ")"
    return final.select(
        "kind", "id", "host", "declared", "hint",
        F.expr(f"{names}[cast(array_position(posterior, array_max(posterior)) - 1 AS int)]").alias("lang"),
        F.round(F.array_max("posterior"), 6).alias("confidence"),
    )


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``kind, doc_id, page_id, host, declared, hint, lang, confidence`` for all documents and pages.
    The text model learns from a bounded sample of ``docs``; priors and trust come from all rows."""
    model = fit(docs)
    evidence = document_evidence(docs, model).unionByName(page_evidence(pages, model))
    found = fuse(evidence, model)
    return found.select(
        "kind", F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        "host", "declared", "hint", "lang", "confidence",
    )
