"""Quality rules learned as a decision list, in DataFrame operations alone.

Sequential covering: a rule grows by the threshold condition that gains most on two thirds of the labelled rows that no
earlier rule covers, and is pruned back from its end on the other third; it joins the list if what it covers is bad
often enough. The list is emitted as one ordered conditional expression. All that is learned from are counts of
labelled rows by feature and bin, which Spark sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import WORD, labelled, one_text_each, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
#: At most about so many labelled rows are used, picked by a hash of the id.
FIT_ROWS = 20_000
BINS, MOST_RULES, MOST_CONDITIONS = 24, 8, 3
LEAST_BAD, LEAST_PRECISION = 4, 0.9
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
#: What rules may test: shares, so that the length of a text alone condemns none.
FEATURES = {
    "chars_a_word": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "upper_case": ("n_upper", "word_chars"),
    "marks_a_word": ("n_marks", "n_words"),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all the places where ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that occurs twice or more: windows are hashed, sorted with their
    places, and the places of those that equal a neighbour are swept in order."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.struct(F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))).alias("h"), i.alias("at")),
    )

    def places(found: Column) -> Column:
        twin = lambda x, i: (F.get(found, i - 1)["h"] == x["h"]) | (F.get(found, i + 1)["h"] == x["h"])
        marked = F.transform(found, lambda x, i: F.when(twin(x, i), x["at"]))
        return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

    def swept(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) > WINDOW, let(let(F.array_sort(windows), places), swept)).otherwise(0)


def counted(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS (long) for whole texts; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    stats = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = documents.withColumns({"_words": stats, "_lines": by_line, "_n": F.length(t), "_symbols": without(SYMBOLS), "_upper": without("[A-Z]"), "_marks": without(r"[!?;:()\[\]{}_=+~^@/\\-]")})
    out = out.withColumns({k: F.col(f"_words.{k}").cast("long") for k in ("n_words", "word_chars", "n_repeat_words")} | {k: F.col(f"_lines.{k}").cast("long") for k in ("n_lines", "n_dup_lines")})
    out = out.withColumns({k: (F.col("_n") - F.col(c)).cast("long") for k, c in (("n_symbols", "_symbols"), ("n_upper", "_upper"), ("n_marks", "_marks"))})
    return out.drop("_words", "_lines", "_n", "_symbols", "_upper", "_marks")


def feature(name: str) -> Column:
    part, of = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(part), F.col(of)), F.lit(0.0))


def edges_below(value: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return feature(self.feature) > self.cut if self.above else feature(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.4g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def decision(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the name of the first rule that a row of counted() meets, or null."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.column(), F.lit(str(r))).otherwise(out)
    return out


def fit_rules(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learns rules for label 0 from labelled() rows. Of conditions that gain equally the first by FEATURES, then the least cut, then
    the one above it is taken.

    About ``fit_rows`` labels at most are broadcast to the scan of the texts; the driver sees counts by feature and bin.
    """
    rows = counted(one_text_each(documents, labelled(labels, doc_id, label, fit_rows), doc_id, text), "_text")
    seen = written(rows.select((F.crc32(F.col("_id").cast("string")) % 3 == 0).alias("prune"), (F.col("_label") == 0).alias("bad"), *COUNTS))
    names = [*FEATURES]
    got = seen.agg(*(F.percentile_approx(feature(f), [i / BINS for i in range(1, BINS)], 10_000) for f in names)).first()
    edges = {f: sorted(set(got[i] or [])) for i, f in enumerate(names)}
    if not any(edges.values()):
        return []
    bins = F.array(*(F.struct(F.lit(f).alias("f"), edges_below(feature(f), e).alias("bin")) for f, e in edges.items() if e))

    def tallies(where: Column) -> tuple[int, int]:
        r = seen.where(where).agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
        return r["p"], r["n"]

    def grown(left: Column) -> list[Condition]:
        found: list[Condition] = []
        here = left & ~F.col("prune")
        while len(found) < MOST_CONDITIONS:
            table = seen.where(here).select("bad", F.inline(bins)).groupBy("f", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            p, n = (sum(r[k] for r in table if r["f"] == table[0]["f"]) for k in "pn") if table else (0, 0)
            if p < LEAST_BAD or not n:
                break
            best, cond = 1e-9, None
            for f, cut in ((f, c) for f, e in edges.items() for c in range(len(e))):
                for above in (True, False):
                    # bin b holds values above b edges, so that "above edges[cut]" is bin > cut
                    a, b = (sum(r[k] for r in table if r["f"] == f and (r["bin"] > cut) == above) for k in "pn")
                    gain = a * (math.log2(a / (a + b)) - math.log2(p / (p + n))) if a >= LEAST_BAD else 0
                    if gain > best:
                        best, cond = gain, Condition(f, above, edges[f][cut])
            if cond is None:
                break
            # halfway to the next value that was seen, so that what lies just beyond the cut isn't judged by it alone
            beyond = seen.agg(F.min(F.when(feature(cond.feature) > cond.cut, feature(cond.feature)))).first()[0]
            if beyond is not None:
                cond = Condition(cond.feature, cond.above, (cond.cut + beyond) / 2)
            found.append(cond)
            here = here & cond.column()
        return found

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < MOST_RULES and (conditions := grown(left)):
        worth = {}
        for k in range(1, len(conditions) + 1):
            p, n = tallies(left & F.col("prune") & Rule(tuple(conditions[:k])).column())
            worth[k] = (p - n) / (p + n) if p + n else -1.0
        best = min(k for k in worth if worth[k] == max(worth.values()))
        rule = Rule(tuple(conditions[:best]))
        p, n = tallies(left & rule.column())
        if p < LEAST_BAD or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule)
        left = left & ~rule.column()
    return rules


def judge(documents: DataFrame, rules: list[Rule], text: str = "text", least_words: int = 50) -> DataFrame:
    """Adds COUNTS, base_failed, rule (the first rule met, or null) and kept (neither base_failed nor a rule) to ``documents``.

    base_failed: fewer than ``least_words`` words, or more than half of the words in repeated windows. A null or empty text has
    no words and fails. Rows are independent of each other; columns of these names are replaced.
    """
    out = counted(documents, text)
    out = out.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("rule", decision(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_rows(documents: DataFrame, rules: list[Rule], text: str = "text", least_words: int = 50) -> DataFrame:
    """The rows of ``documents`` that judge() keeps, with their own columns alone."""
    named = documents.select(*(documents[c].alias(f"_{i}") for i, c in enumerate(documents.columns)))
    # the row number is there so that the filter stays above the counts: pushed down, it would have them computed again
    out = judge(named, rules, f"_{documents.columns.index(text)}", least_words).withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0")
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(documents.columns)))
