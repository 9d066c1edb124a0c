"""Secret scans through a trigram inverted index, in DataFrame operations alone.

Each rule's regular expression yields a Boolean query of trigrams (see trigrams.py). The index posts, for each trigram
that some query names, the texts that contain it; postings are intersected by text, and a rule's expression runs only
over the texts that meet its query. A rule whose expression demands no trigram runs over all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import text_key, text_or_empty, written
from codeweft.llm.quality_rules import let
from codeweft.llm.trigrams import Clause, selective, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and don't overlap; those whose ``group`` is shorter than ``least`` are dropped.

    ``plain`` says what is looked for where ``pattern`` also matches what is to be dropped, so as not to look at it again from
    every place within; the rule's trigrams are derived from it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    plain: str = ""

    @property
    def query(self) -> tuple[Clause, ...]:
        return selective(trigram_query(self.plain or self.pattern))


#: The base kinds, in their order, then others whose formats are public.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),  # shorter runs are dropped anyway
)
JWT = r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", rf"({JWT})|eyJ[A-Za-z0-9_-]++", group=1, least=40, plain=JWT.replace("++", "+")),  # a run that is none is passed over at once
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: Entries of an array that is built up by copying.
CHUNK = 256
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def grams_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for clause in r.query for alternative in clause for g in alternative})


def postings(documents: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """The inverted index: (gram, k1, k2) for each of the trigrams that a text, in lower case, contains; equal texts are one."""
    low = F.lower(text_or_empty(text))
    rows = documents.select(*text_key(text), low.alias("low"))
    there = F.filter(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull())
    return rows.select(F.explode(there).alias("gram"), "k1", "k2")


def meets(rule: Rule, held: Column) -> Column:
    """Whether the trigrams ``held`` by a text meet the rule's query."""
    each = lambda words: reduce(lambda a, b: a & b, (F.array_contains(held, g) for g in sorted(words)))
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, map(each, sorted(clause, key=sorted))) for clause in rule.query))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, ranks): for each text that meets the query of some rule, the places of those rules in ``rules``."""
    asked = [(i, r) for i, r in enumerate(rules) if r.query]
    held = index.groupBy("k1", "k2").agg(F.collect_set("gram").alias("held"))
    ranks = F.filter(F.array(*(F.when(meets(r, F.col("held")), F.lit(i)) for i, r in asked)), lambda i: i.isNotNull())
    return held.select("k1", "k2", ranks.alias("ranks")).where(F.size("ranks") > 0)


def running(x: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array of int, what ``combine`` makes of 0 and all entries before it.

    An array that grows by an entry is copied each time; here that holds for chunks of the array, and for one entry a chunk, so
    that the work is in proportion to the array up to millions of entries."""
    zero = F.lit(0)

    def plain(chunk: Column, start: Column) -> Column:
        step = lambda s, v: F.struct(combine(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(chunk, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

    chunks = F.transform(F.sequence(zero, F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, CHUNK))
    starts = lambda c: plain(F.transform(c, lambda chunk: F.aggregate(chunk, zero, combine)), zero)
    return F.when(F.size(x) > 0, let(chunks, lambda c: F.flatten(F.zip_with(c, starts(c), plain)))).otherwise(F.array().cast("array<int>"))


def matches(t: Column, rule: Rule, rank: int) -> Column:
    """A rule's matches in a text, what stands between them, and what is measured of each."""
    of = lambda group: F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(group))
    return F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), F.split(t, rule.pattern, -1).alias("pieces"), of(0).alias("found"), of(rule.group).alias("values"))


def spans_of(m: Column, length: Callable[[Column], Column]) -> Column:
    """Spans of the kept ones of matches(), in units of ``length``; each starts where the pieces and matches before it end."""
    steps = F.transform(m["found"], lambda x, i: length(F.get(m["pieces"], i)) + length(x))

    def span(x: Column, i: Column, before: Column) -> Column:
        start = F.get(before, i) + length(F.get(m["pieces"], i))
        return F.when(F.length(F.get(m["values"], i)) >= m["least"], F.struct(start.alias("start"), m["rank"].alias("rank"), (start + length(x)).alias("end"), m["kind"].alias("kind")))

    every = let(let(steps, lambda x: running(x, lambda a, b: a + b)), lambda before: F.transform(m["found"], lambda x, i: span(x, i, before)))
    return F.filter(every, lambda s: s.isNotNull())


def all_spans(t: Column, rules: tuple[Rule, ...], length: Callable[[Column], Column] = F.length) -> Column:
    """Spans of all rules on a row of with_candidates(), in order of start and of the rules."""
    found = F.filter(F.array(*(F.when(applies(r, i, t), matches(t, r, i)) for i, r in enumerate(rules))), lambda m: m.isNotNull())
    return F.array_sort(F.flatten(F.transform(found, lambda m: spans_of(m, length)))).cast(SPAN)


def merged(spans: Column) -> Column:
    """Sorted spans, of which those that overlap are one: it ends with the last of them and is named by the first."""

    def runs(before: Column, ends: Column) -> Column:
        firsts = F.filter(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(before, i), i)), lambda i: i.isNotNull())
        run = lambda s, end: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), end.alias("end"), s["kind"].alias("kind"))
        return let(firsts, lambda at: F.transform(at, lambda i, k: run(F.get(spans, i), F.coalesce(F.get(before, F.get(at, k + 1)), F.array_max(ends)))))

    return let(F.transform(spans, lambda s: s["end"]), lambda ends: let(running(ends, lambda a, b: F.greatest(a, b)), lambda before: runs(before, ends)))


def replaced(t: Column, runs: Column) -> Column:
    """The text with each of ``runs``, in bytes, replaced by its kind in brackets. Bytes are cut out in constant time each."""

    def put(utf8: Column) -> Column:
        cut = lambda start, end: F.substring(utf8, start + 1, end - start).cast("string")
        before = lambda i: F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)
        parts = F.transform(runs, lambda s, i: F.concat(cut(before(i), s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(F.get(runs, F.size(runs) - 1)["end"], F.octet_length(utf8)))

    return let(F.encode(t, "UTF-8"), put)


def applies(rule: Rule, rank: int, t: Column) -> Column:
    """Whether a rule is to be tried on a row of with_candidates()."""
    if rule.query:
        return F.coalesce(F.array_contains("_ranks", rank), F.lit(False))
    return t.rlike(rule.pattern)


def with_candidates(documents: DataFrame, rules: tuple[Rule, ...], text: str) -> DataFrame:
    """Adds _ranks, the rules whose queries the row's text meets (null: none); the other columns stay.

    The candidates are written first: the planner then knows their size, and leaves the texts where they are if it is below
    the threshold for broadcasts. Otherwise both sides are plain exchanges, of which adaptive execution splits a hot key.
    """
    found = candidates(postings(documents, grams_of(rules), text), rules)
    found = written(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("ranks").alias("_ranks")))
    rows = documents.withColumns(dict(zip(("_k1", "_k2"), text_key(text), strict=True)))
    return rows.join(found, ["_k1", "_k2"], "left").drop("_k1", "_k2")


def scan(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The columns ``keep`` and spans, an array of (start, rank, end, kind) in code points, ends exclusive, in order of start
    and of the rules. Null counts as empty and has none. Kinds are found independently and may overlap. Equal texts give
    equal results, an empty table an empty one; columns that aren't named have no influence."""
    rows = documents.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keep)), text_or_empty(text).alias("_text"))
    rows = with_candidates(rows, rules, "_text")
    return rows.select(*(F.col(f"_{i}").alias(k) for i, k in enumerate(keep)), all_spans(F.col("_text"), rules).alias("spans"))


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", length: str | None = None) -> DataFrame:
    """``documents`` with each secret that scan() finds in ``text`` replaced by its kind in brackets; null stays null.

    Secrets that overlap are replaced together, by the kind of the one that starts first, the earlier rule's if several do.
    ``length`` names a column that is set to the new text's length, if there is one. All other columns stay as they are.
    """
    named = documents.select(*(documents[c].alias(f"_{i}") for i, c in enumerate(documents.columns)))
    own = f"_{documents.columns.index(text)}"
    rows = with_candidates(named, rules, own)
    t = F.col(own)
    clean = let(all_spans(t, rules, F.octet_length), lambda spans: F.when(F.size(spans) > 0, let(merged(spans), lambda runs: replaced(t, runs))).otherwise(t))
    rows = rows.withColumn(own, clean)
    out = rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(documents.columns)))
    return out if length not in documents.columns else out.withColumn(length, F.length(text).cast(documents.schema[length].dataType))
