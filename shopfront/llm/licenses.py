"""Licences of files: sparse TF-IDF cosine of headers to templates, then directory inheritance.

A header is what stands around a word that hints at a licence. Its terms, weighted by how rare they
are among all headers of the corpus, are compared with templates; the stretch that fits best counts.
A file that is the text of a licence, compared as a whole with full texts, or that is named as licence files
are, or that is mostly a statement, speaks for its directory; a file without a licence of its own takes
that of its nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.llm.common import by_batch, pick
from shopfront.operators.lookup import lookup
from shopfront.staging import stage

#: Statements and openings of notices by licence; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this'
     " file except in compliance with the License. You may obtain a copy of the License at"
     " http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
     " software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms"
     " of the GNU General Public License as published by the Free Software Foundation, either"
     " version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are"
     " permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal"),
    ("Proprietary", "Copyright. All rights reserved. Confidential and proprietary"),
)
LEAST = 0.75  # cosine from which a header is a licence's
WHOLE = 0.85  # cosine of a whole file to a full text from which it is that licence's text
FILE_SHARE = 0.5  # a file is a licence file when the fitting stretch is this much of its terms
AROUND = 48  # terms on either side of a hint that may belong to its header
_HINT = re.compile(r"(?i)licen[cs]|copyright|spdx|permission is hereby|redistribut|rights reserved|public domain")
#: Names of licence files, as a pattern for Spark.
NAMED = r"(?i)(^|/)((un)?licen[cs]es?|copying|copyright|notice)([._-][^/]*)?$"
_TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_HINT_TERM = re.compile(r"licen[cs]|copyright|spdx|permission|redistribut|reserved|domain")


def terms(text: str) -> list[str]:
    return [t.casefold() for t in _TERM.findall(text)]


TEMPLATE_TERMS = [(name, terms(text)) for name, text in TEMPLATES]
VOCABULARY = frozenset(t for _, words in TEMPLATE_TERMS for t in words)


def full_texts() -> list[tuple[str, list[str]]]:
    """Terms of whole licences. Two are made from their siblings, which differ by a clause or a word:
    BSD-2-Clause lacks the third clause, and AGPL-3.0 names itself where GPL-3.0 does."""
    folder = resources.files("shopfront.llm") / "license_texts"
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    texts["BSD-2-Clause"] = re.sub(r"(?s)3\. Neither.*?permission\.", "", texts["BSD-3-Clause"])
    texts["AGPL-3.0"] = re.sub(r"(?i)\bgnu general public", "GNU Affero General Public", texts["GPL-3.0"])
    return [(name, terms(text)) for name, text in sorted(texts.items())]


def headers(words: list[str]) -> list[tuple[int, int]]:
    """Stretches of terms around hints; hints that lie close share one."""
    out: list[tuple[int, int]] = []
    for at, word in enumerate(words):
        if _HINT_TERM.match(word):
            start, end = max(0, at - AROUND), min(len(words), at + AROUND + 1)
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


def cosine(words: list[str], template: dict[str, float], rarity: dict[str, float], other: float) -> float:
    """``template`` holds weights of length 1; ``other`` is the rarity of a term no template has."""
    counted = Counter(words)
    dot = norm = 0.0
    for word, n in counted.items():
        weight = n * rarity.get(word, other)
        norm += weight * weight
        dot += weight * template.get(word, 0.0)
    return dot / math.sqrt(norm) if norm else 0.0


class Matcher:
    def __init__(self, headers_with: dict[str, int], all_headers: int):
        total = all_headers + len(TEMPLATES)
        counts = Counter(headers_with)
        for _, words in TEMPLATE_TERMS:
            counts.update(set(words))
        self.other = math.log(1 + total)
        self.rarity = {t: math.log(1 + total / (1 + counts[t])) + 0.1 for t in VOCABULARY}
        self.templates = []
        for name, words in TEMPLATE_TERMS:
            weights = {w: n * self.rarity[w] for w, n in Counter(words).items()}
            length = math.sqrt(sum(x * x for x in weights.values()))
            self.templates.append((name, len(words), {w: x / length for w, x in weights.items()}))
        texts = full_texts()
        held = Counter(w for _, words in texts for w in set(words))
        self.full_rarity = {w: math.log(1 + len(texts) / n) for w, n in held.items()}
        self.full_other = math.log(1 + len(texts))
        self.full = [(name, self.weighed(words)) for name, words in texts]

    def weighed(self, words: list[str]) -> dict[str, float]:
        """Weights of length 1 of a whole text's terms; repeats add by their logarithm."""
        weights = {w: (1 + math.log(n)) * self.full_rarity.get(w, self.full_other) for w, n in Counter(words).items()}
        length = math.sqrt(sum(x * x for x in weights.values()))
        return {w: x / length for w, x in weights.items()}

    def whole(self, words: list[str]) -> tuple[float, str]:
        """Cosine and licence of the full text that the whole file is most like."""
        weights = self.weighed(words)
        return max((sum(x * full.get(w, 0.0) for w, x in weights.items()), name) for name, full in self.full)

    def stretch(self, words: list[str]) -> tuple[float, str, int]:
        """Cosine, licence and size of the stretch of a header that fits a template best. Windows of the
        template's size slide over the header; the best one is trimmed while that helps."""
        best = (0.0, "", 0)
        for name, size, weights in self.templates:
            gains = [weights.get(w, 0.0) for w in words]
            wide = min(size, len(words))
            total = top = sum(gains[:wide])
            at = 0
            for start in range(1, len(words) - wide + 1):
                total += gains[start + wide - 1] - gains[start - 1]
                if total > top + 1e-12:
                    top, at = total, start
            part = words[at : at + wide]
            fits = cosine(part, weights, self.rarity, self.other)
            while len(part) > 1:
                shorter = max((part[1:], part[:-1]), key=lambda p: cosine(p, weights, self.rarity, self.other))
                trimmed = cosine(shorter, weights, self.rarity, self.other)
                if trimmed <= fits + 1e-12:
                    break
                part, fits = shorter, trimmed
            if fits > best[0] + 1e-9:
                best = (fits, name, len(part))
        return best

    def text(self, text: str) -> tuple[str | None, float, str | None]:
        """Licence, cosine, and what the text is: ``full``, a licence's text; ``statement``, mostly a
        statement of one; or null."""
        if not _HINT.search(text):
            return None, 0.0, None
        words = terms(text)
        fits, name = self.whole(words)
        if fits >= WHOLE:
            return name, round(fits, 6), "full"
        found = max((self.stretch(words[a:b]) for a, b in headers(words)), default=(0.0, "", 0))
        if found[0] < LEAST:
            return None, round(found[0], 6), None
        return found[1], round(found[0], 6), "statement" if found[2] >= FILE_SHARE * len(words) else None


def matcher(files: DataFrame) -> Matcher:
    """Rarity of the templates' terms over the headers of all files; its size is the templates'."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        counts, all_headers = Counter(), 0
        for text in rows["text"]:
            if _HINT.search(text):
                words = terms(text)
                for start, end in headers(words):
                    all_headers += 1
                    counts.update(VOCABULARY.intersection(words[start:end]))
        counts[""] = all_headers
        return {"term": list(counts), "n": list(counts.values())}

    rows = by_batch(files.select("text"), "term string, n bigint", work).groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {row["term"]: row["n"] for row in rows}
    return Matcher(counts, counts.pop("", 0))


def scan(files: DataFrame) -> DataFrame:
    """``doc_id, path, own_license, cosine, license, inherited_from`` for every row of ``files``
    (``doc_id, text, path``).

    ``inherited_from`` is the ancestor directory whose licence file speaks for the file, null for
    a licence of its own or none at all. ``.`` is the root of relative paths, for which only files speak
    that are full texts or named as licence files. Of several licence files in a directory the best fitting
    counts, then the one of the smallest path. Null and empty texts have no licence of their own; a
    file without a path inherits nothing. Repeated rows come out repeated; other columns are not
    read; an empty table gives no rows.
    """
    files = pick(files, doc_id="bigint", text="string", path="string").withColumn("text", F.coalesce("text", F.lit("")))
    found = matcher(files)

    def work(rows: dict[str, list]) -> dict[str, list]:
        each = [found.text(text) for text in rows["text"]]
        return {"doc_id": rows["doc_id"], "path": rows["path"], "own_license": [e[0] for e in each],
                "cosine": [e[1] for e in each], "is": [e[2] for e in each]}

    schema = "doc_id bigint, path string, own_license string, cosine double, is string"
    own = by_batch(files, schema, work)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    own = stage(own.withColumn("dir", F.when(F.col("path").contains("/"), folder).when(F.col("path") != "", F.lit("."))), "license-own")

    speaks = F.min(F.struct(-F.col("cosine"), F.col("path"), F.col("own_license").alias("license")))
    named = F.col("own_license").isNotNull() & F.col("path").rlike(NAMED)
    file = named | (F.col("is") == "full") | ((F.col("is") == "statement") & (F.col("dir") != "."))
    licensed = own.where(file & F.col("dir").isNotNull()).groupBy("dir").agg(speaks.alias("best")).select(
        F.col("dir").alias("ancestor"), "best.license"
    )
    # ancestors of each directory once, however many files it holds
    parts = F.split("dir", "/")
    inside = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("ancestor")))
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit(".").alias("ancestor")))
    relative = ~F.col("dir").startswith("/") & ~F.col("dir").isin("", ".")
    each = F.explode(F.when(relative, F.concat(root, inside)).otherwise(inside))
    above = own.where("dir IS NOT NULL AND own_license IS NULL").select("dir").distinct().select("dir", each.alias("up"))
    nearest = above.select("dir", "up.*").join(licensed, "ancestor").groupBy("dir").agg(
        F.max_by(F.struct("ancestor", "license"), "depth").alias("near")
    )
    inherits = F.col("own_license").isNull()
    return lookup(own, nearest, "dir", some_keys_null=True).select(
        "doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "near.license").alias("license"),
        F.when(inherits, F.col("near.ancestor")).alias("inherited_from"),
    )
