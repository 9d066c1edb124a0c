"""Source code as a table of tokens, their brackets matched by running depth, and the chains of calls that they form.

One alternation tells code from strings and comments in a single scan; every token becomes a row of (unit, i, t), ``unit`` being what is read by
itself, such as a method. Depth is a running sum, so that all that follows are windows over a unit: sorts, no matter how
deep brackets nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.extract import COMMENT, QUOTED, all_of

NAME = r"\\?[A-Za-z_]\w*+(?:\\\w++)*+"
TOKEN = rf"(?s){COMMENT}|{QUOTED}|\$\w++|{NAME}|\d[\w.]*+|\?->|->|::|=>|\.\.\.|\?\?=|[=!<>]=++|&&|\|\||\?\?|[-+*/.%&|^]=|\S"
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
LINKS = ("->", "?->", "::")
#: Words of the language that a parenthesis may follow without being called, and those that stand before an operand.
WORDS = (
    "if", "elseif", "else", "while", "for", "foreach", "switch", "match", "return", "echo", "print", "and", "or", "xor", "function", "fn", "use", "catch", "unset", "isset", "empty", "exit", "list",
    "include", "include_once", "require", "require_once", "clone", "instanceof", "throw", "yield", "case", "static", "as", "do", "try", "finally", "global", "declare", "array",
)


def dealt(units: DataFrame) -> DataFrame:
    """units(unit, text) dealt to all tasks by unit, while they are still narrow: windows over a unit's tokens then need no shuffle of tokens."""
    return units.select("unit", "text").repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")


def tokens(units: DataFrame, text: str = "text") -> DataFrame:
    """units(unit, text) -> (unit, i, t), comments aside."""
    rows = units.select("unit", F.posexplode(all_of(F.col(text), TOKEN, 0)).alias("i", "t"))
    return rows.where(~F.col("t").rlike(r"^(?:/[*/]|#(?!\[).)"))


def next_of(column: str, within: str, order: str) -> Column:
    """The next value after a row's own, nulls left out, within a unit's rows of one ``within``: in the order that other windows sort by, too."""
    return F.expr(f"lead({column}) ignore nulls over (partition by unit, {within} order by {order})")


def nested(rows: DataFrame) -> DataFrame:
    """tokens() with g, the place of the innermost bracket around each (-1: none), and pair, where the bracket that belongs to it stands.
    A bracket itself counts as being outside."""
    t = F.col("t")
    opens, closes = t.isin(*OPEN), t.isin(*CLOSE)
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(Window.partitionBy("unit").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    outer = F.struct((F.col("depth") - opens.cast("int")).alias("level"), F.lit(False).alias("inner"))
    inner = F.struct((F.col("depth") + closes.cast("int")).alias("level"), F.lit(True).alias("inner"))
    # a bracket stands in two levels: the one that it is in, and the one that it delimits
    rows = rows.withColumn("depth", depth).withColumn("x", F.explode(F.when(opens | closes, F.array(outer, inner)).otherwise(F.array(outer)))).select("unit", "i", "t", "x.level", "x.inner")
    before = Window.partitionBy("unit", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda which: F.last(F.when(which, F.col("i")), ignorenulls=True).over(before)
    rows = rows.withColumn("_closes", F.when(closes & ~F.col("inner"), F.col("i"))).withColumns({
        "g": F.coalesce(last(opens & F.col("inner")), F.lit(-1)),
        "pair": F.when(opens, next_of("_closes", "level", "i")).when(closes, last(opens & ~F.col("inner"))),
    })
    return rows.where("not inner").select("unit", "i", "t", "g", "pair")


def chains(rows: DataFrame) -> DataFrame:
    """nested() tokens gathered into operands with all that is called on or taken of them: (unit, g, first, last, text, parts, n).

    text joins the tokens by blanks; what stands in brackets isn't part of it, it forms chains of its own whose g is the bracket's place: ``$a->b(1)`` is
    ``$a -> b ( )``. Every other token is a chain by itself. parts are its tokens with their places, n is its number within g."""
    by = Window.partitionBy("unit", "g").orderBy("i")
    prev = F.lag("t").over(by)
    member = F.coalesce(F.lag("t", 2).over(by).isin(*LINKS), F.lit(False))  # a member may have any name
    called = (prev.rlike(rf"^(?:\$\w+|{NAME})$") & (member | ~F.lower(prev).isin(*WORDS))) | prev.isin(")", "]")
    joins = F.col("t").isin(*LINKS, ")", "]") | F.coalesce(prev.isin(*LINKS) | (F.lower(prev) == "new"), F.lit(False)) | (F.col("t").isin("(", "[") & F.coalesce(called, F.lit(False)))
    numbered = rows.withColumn("joins", joins).withColumn("n", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("unit", "g", "n").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.max("pair").alias("pair"), F.sort_array(F.collect_list(F.struct("i", "t"))).alias("parts"))
    return out.withColumn("text", F.array_join("parts.t", " "))


def around(rows: DataFrame) -> DataFrame:
    """chains() with their neighbours in the same brackets: before and its text, next1 to next3 (first, last, text, pair), and the places of the next
    semicolon, of the next semicolon or comma, and of the next brace, null where the brackets close before."""
    by = Window.partitionBy("unit", "g").orderBy("n")
    one = F.struct("first", "last", "text", "pair")
    marks = {"stop": (";",), "comma": (";", ","), "brace": ("{",)}
    marked = rows.withColumns({f"_{k}": F.when(F.col("text").isin(*t), F.col("first")) for k, t in marks.items()})
    return marked.withColumns({
        "before": F.lag("text").over(by), **{f"next{k}": F.lead(one, k).over(by) for k in (1, 2, 3)}, **{k: next_of(f"_{k}", "g", "n") for k in marks},
    }).drop(*(f"_{k}" for k in marks))


def same_or(column: Column, *texts: str) -> Column:
    return F.coalesce(column.isin(*texts), F.lit(False))
