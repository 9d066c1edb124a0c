"""License scans as an exact set-similarity join of text blocks with templates, in DataFrame operations alone.

A template and a block are sets of words, ordered by how many texts hold each word, the rarest first. A block contains a
template if it holds ``threshold`` of its words, say o of them. Then the prefixes of both, all but their last o - 1 words,
share a word (prefix filter); the block has o words of the vocabulary at least (length filter); and from the places of
the shared word enough words remain on both sides (positional filter). The join is on prefix words; what passes is
verified by intersecting the sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import text_key, text_or_empty, written
from codeweft.llm.quality_rules import let

#: A word of a text in which A to Z are as good as a to z; what stands between two words.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The phrases looked for word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences of well-known licenses by label.
TEMPLATES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl-3.0": ["licensed under the GNU General Public License, version 3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"],
    "gpl-2.0": ["licensed under the GNU General Public License, version 2", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"],
    "lgpl": ["licensed under the GNU Lesser General Public License"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
THRESHOLD = 0.9


def template_sets(templates: dict[str, list[str]]) -> list[tuple[str, frozenset[str]]]:
    return [(label, frozenset(re.findall(LICENSE_WORD, t.lower()))) for label, texts in templates.items() for t in texts]


def let_words(low: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates use(words) on what stands between separators; the first and the last of these may be empty."""
    return let(F.split(low, f"{BETWEEN}+", -1), use)


def counted(words: Column) -> Column:
    return F.size(words) - (F.get(words, F.lit(0)) == "").cast("int") - ((F.size(words) > 1) & (F.get(words, F.size(words) - 1) == "")).cast("int")


def all_in(held: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(held, w) for w in words))


def scanned(documents: DataFrame, keep: tuple[str, ...], text: str, sets: list[tuple[str, frozenset[str]]], threshold: float) -> DataFrame:
    """One scan of the texts, written: keep as _0, _1 ..., k1, k2, n_words, held (the words of the templates and phrases that the
    text has) and low, the text in lower case, which is null unless the text as a whole has all words of a phrase or enough
    of a template's. Whatever has to be looked at more closely is looked at there.

    The lower case of no other letter than A to Z holds a letter of PHRASES, so that lower() is as good as A to Z alone."""
    asked = [p.split() for p in PHRASES]
    known = F.array(*map(F.lit, sorted(set().union(*(w for _, w in sets), *asked))))
    low = F.lower(text_or_empty(text))
    stats = let_words(low, lambda w: F.struct(counted(w).cast("long").alias("n_words"), F.array_intersect(w, known).alias("held")))
    rows = documents.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keep)), *text_key(text), stats.alias("s"), low.alias("low"))
    enough = lambda words: F.size(F.array_intersect("s.held", F.array(*map(F.lit, sorted(words))))) >= needed(words, threshold)
    closer = reduce(lambda a, b: a | b, [*(all_in(F.col("s.held"), words) for words in asked), *(enough(words) for _, words in sets)])
    return written(rows.select(*(f"_{i}" for i in range(len(keep))), "k1", "k2", "s.n_words", "s.held", F.when(closer, F.col("low")).alias("low")))


def needed(words: frozenset[str], threshold: float) -> int:
    return math.ceil(Fraction(str(threshold)) * len(words))


def template_matches(rows: DataFrame, sets: list[tuple[str, frozenset[str]]], threshold: float) -> DataFrame:
    """rows of scanned() -> (k1, k2, block, label, containment) for every block of a text that contains a template, equal texts being one.

    Blocks are the text's lines and its paragraphs (what stands between blank lines), numbered in that order; block is the
    least number of those with the same words of the vocabulary. All blocks of all texts take part: a block can't have
    more of a template's words than its text has. As many counts as the templates have words reach the driver.
    """
    vocabulary = sorted(set().union(*(w for _, w in sets)))
    often = {r["word"]: r["count"] for r in rows.select(F.explode("held").alias("word")).groupBy("word").count().collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    ranked = [(i, label, sorted(order[w] for w in words), needed(words, threshold)) for i, (label, words) in enumerate(sets)]
    prefixes = [(i, label, words, need, at) for i, label, words, need in ranked for at in range(len(words) - need + 1)]
    index = rows.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("has"), F.lit(need).alias("need"), F.lit(at).alias("t_at"), F.lit(words[at]).alias("word")) for i, label, words, need, at in prefixes))))

    texts = rows.where("low is not null").groupBy("k1", "k2").agg(F.first("low").alias("low"))
    blocks = F.array_distinct(F.concat(F.split("low", "\n"), F.split("low", r"\n[\x20\x09\x0D]*\n")))
    rank = F.create_map(*(F.lit(x) for w, i in order.items() for x in (w, i)))
    known = lambda b: F.array_sort(F.transform(F.array_intersect(F.split(b, f"{BETWEEN}+"), F.array(*map(F.lit, vocabulary))), lambda w: F.element_at(rank, w)))
    least = min(need for _, _, _, need in ranked)
    # a prefix as long as the least demanding template asks for; each template then takes its own part of it
    held = texts.select("k1", "k2", F.posexplode(blocks).alias("block", "b")).select("k1", "k2", "block", known(F.col("b")).alias("b_has")).where(F.size("b_has") >= least)
    held = held.groupBy("k1", "k2", "b_has").agg(F.min("block").alias("block"))
    probes = held.select("*", F.posexplode(F.slice("b_has", F.lit(1), F.size("b_has") - least + 1)).alias("b_at", "word"))
    size, t_size = F.size("b_has"), F.size("has")
    fits = (size >= F.col("need")) & (F.col("b_at") <= size - F.col("need")) & (F.least(size - F.col("b_at"), t_size - F.col("t_at")) >= F.col("need"))
    pairs = probes.join(F.broadcast(index), "word").where(fits).select("k1", "k2", "block", "b_has", "template", "label", "has", "need").distinct()
    shared = pairs.withColumn("shared", F.size(F.array_intersect("b_has", "has"))).where("shared >= need")
    return shared.groupBy("k1", "k2", "block", "label").agg(F.max(F.col("shared") / F.size("has")).alias("containment"))


def phrase_places(rows: DataFrame) -> DataFrame:
    """rows of scanned() -> (k1, k2, n_base, first_word, last_word, base) for the texts in which a phrase's words stand consecutively."""

    def places(phrase: str, words: Column) -> Column:
        first, *rest = phrase.split()
        here = lambda w, i: F.when(reduce(lambda a, b: a & b, (F.get(words, i + k) == r for k, r in enumerate(rest, 1)), w == first), i)
        return F.filter(F.transform(words, here), lambda i: i.isNotNull())

    def hits(words: Column) -> Column:
        skipped = (F.get(words, F.lit(0)) == "").cast("int")
        of = lambda p: let(places(p, words), lambda at: F.when(F.size(at) > 0, F.struct(F.size(at).alias("n"), (F.array_min(at) - skipped).alias("first"), (F.array_max(at) - skipped).alias("last"), F.lit(PHRASES[p]).alias("label"))))
        return F.filter(F.array(*(F.when(all_in(F.col("held"), p.split()), of(p)) for p in PHRASES)), lambda h: h.isNotNull())

    some = reduce(lambda a, b: a | b, (all_in(F.col("held"), p.split()) for p in PHRASES))
    texts = rows.where(F.col("low").isNotNull() & some).groupBy("k1", "k2").agg(F.first("low").alias("low"), F.first("held").alias("held"))
    found = texts.select("k1", "k2", let_words(F.col("low"), hits).alias("hits")).where(F.size("hits") > 0)
    part = lambda name: F.transform("hits", lambda h: h[name])
    return found.select(
        "k1",
        "k2",
        F.aggregate(part("n"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_base"),
        F.array_min(part("first")).cast("long").alias("first_word"),
        F.array_max(part("last")).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(part("label"))).alias("base"),
    )


def scan_licenses(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep``, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score.

    score is the greatest containment of a template in a block of the text, 0 if none reaches the threshold. Null counts as
    empty and has no words. Equal texts give equal results, an empty table an empty one; other columns don't matter.
    """
    sets = [(label, words) for label, words in template_sets(templates) if words]
    rows = scanned(documents, keep, text, sets, threshold)
    more = template_matches(rows, sets, threshold).groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    # written, so that the planner knows their size: the rows stay where they are if it is below the threshold for broadcasts
    found = written(phrase_places(rows).join(more, ["k1", "k2"], "full"))
    rows = rows.select(*(f"_{i}" for i in range(len(keep))), "k1", "k2", "n_words").join(found, ["k1", "k2"], "left")
    none = F.array().cast("array<string>")
    base = F.coalesce("base", none)
    return rows.select(
        *(F.col(f"_{i}").alias(k) for i, k in enumerate(keep)),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        base.alias("base_labels"),
        F.array_sort(F.array_union(base, F.coalesce("more", none))).alias("labels"),
        F.coalesce("containment", F.lit(0.0)).alias("score"),
    )
