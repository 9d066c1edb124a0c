"""Lexical search and the two ordered folds over ranked items: de-duplication and packing into a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import single_blanks, text_fingerprint
from codeweft.operators.lineage import cut

#: Texts without any of this are what text_fingerprint() would make of their blanks.
ODD_BLANKS = r"(?U)[\s\x00](?:(?<! )|(?= |\z)|(?<=\A ))"
#: Candidates that one question to the graph gathers; what has been gathered is ranked whole.
CANDIDATES = 160
WEIGHTS = {"symbol_name": 3, "summary": 2, "file_path": 1}


def contains_any(words: list[str], columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w)) for w in words for c in columns))


def lexical_score(words: list[str], weights: dict[str, int]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.contains(F.lower(F.col(c)), F.lit(w)), n).otherwise(0) for w in words for c, n in weights.items()))


def leading(rows: DataFrame, per: str | list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each value of ``per``, numbered in _n. Tasks drop what can't be among them before the shuffle, so a
    value that very many rows have is met by one task in few."""
    keys = [per] if isinstance(per, str) else per
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)


def lexical_top(rows: DataFrame, words: list[str], weights: dict[str, int], ties: list[str], most: int) -> DataFrame:
    """The ``most`` rows with the greatest score, ranked before they are cut; rows without any word are left out."""
    return rows.withColumn("score", lexical_score(words, weights)).where("score > 0").orderBy(F.desc("score"), *ties).limit(most)


def ranked(items: DataFrame, packet: str) -> DataFrame:
    """The items of each packet by score, then id, numbered from 1."""
    order = Window.partitionBy(packet).orderBy(F.desc("score"), "id")
    return items.withColumn("rn", F.row_number().over(order))


def deduplicated(items: DataFrame, packet: str) -> DataFrame:
    """items(packet, id, score, text, ...): in order of rank an item stays unless its id or its text, blanks apart, has been kept
    before. An item that is dropped blocks no other. Items of the same score, id and text are one; which of their other
    columns stay is open. ``items`` are read more than once: a table that is written.

    Items whose id and text are each alone in their packet stay. Numbers of 64 bits tell of the others, of which they may only name too many;
    these are settled round by round: an item that comes first both among those of its id and among those of its text stays, and all others
    of these go. All are aggregations, so that no packet is held in one place, and few rounds are needed, as ids seldom recur.
    """
    text_key = text_fingerprint(F.coalesce("text", F.lit("")))
    said = F.coalesce("text", F.lit(""))
    own = F.array(F.xxhash64(packet, F.lit("id"), "id"), F.xxhash64(packet, F.lit("text"), F.when(said.rlike(ODD_BLANKS), single_blanks(said)).otherwise(said)))
    again = cut(items.select(F.explode(own).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"))
    if again.isEmpty():
        return items
    marked = items.withColumns({"_a": own[0], "_b": own[1]})
    alone = marked.join(again, F.col("_a") == F.col("_h"), "left_anti").join(again, F.col("_b") == F.col("_h"), "left_anti").select(*items.columns)
    many = marked.join(again.withColumnRenamed("_h", "_a"), "_a", "left_semi").unionByName(marked.join(again.withColumnRenamed("_h", "_a"), "_a", "left_anti").join(again.withColumnRenamed("_h", "_b"), "_b", "left_semi"))
    return alone.unionByName(_settled(many.select(*items.columns), packet, text_key))


def _settled(items: DataFrame, packet: str, text_key: Column) -> DataFrame:
    order = F.struct((-F.col("score")).alias("a"), F.col("id").alias("b"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("c"))
    left = items.withColumns({"_fp": text_key, "_o": order})
    firsts = [F.first(c).alias(c) for c in items.columns if c not in (packet, "_fp", "_o")]
    left = cut(left.groupBy(packet, "_fp", "_o").agg(*firsts))
    kept = None
    while not left.isEmpty():
        by_id = left.groupBy(packet, "id").agg(F.min("_o").alias("_i"))
        by_text = left.groupBy(packet, "_fp").agg(F.min("_o").alias("_t"))
        new = cut(left.join(by_id, [packet, "id"]).join(by_text, [packet, "_fp"]).where("_o = _i and _o = _t").drop("_i", "_t"))
        kept = new if kept is None else kept.unionByName(new)
        left = cut(left.join(new.select(packet, "id"), [packet, "id"], "left_anti").join(new.select(packet, "_fp"), [packet, "_fp"], "left_anti"))
    return (left if kept is None else kept).select(*items.columns)


def folded(items: DataFrame, packet: str, header: str | Column, budget: int, bytes_a_token: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """(packet, used, taken, omitted): what packed() and shown() are made of. taken(id, compact, ...) has the ``carried`` columns of the items, too."""
    room = max(0, budget) * bytes_a_token
    text = F.lit(header) if isinstance(header, str) else header
    # sizes instead of texts go through the shuffle
    narrow = items.select(packet, "id", "score", *carried, F.least(F.octet_length(text), F.lit(room)).alias("start"), F.octet_length("text").alias("full"), F.octet_length("compact").alias("small"))
    sized = ranked(narrow, packet).select(packet, "start", F.struct("rn", "id", "full", "small", *carried).alias("x"))
    held = sized.groupBy(packet).agg(F.max("start").alias("start"), F.array_sort(F.collect_list("x")).alias("items"), F.sum(F.col("x.full").cast("long") + 1).alias("whole"), F.min(F.coalesce("x.full", F.lit(0))).alias("least"))
    kind = f"array<struct<id:string,compact:boolean{''.join(f',{c}:{items.schema[c].dataType.simpleString()}' for c in carried)}>>"
    zero = F.struct(F.col("start").alias("used"), F.array().cast(kind).alias("taken"), F.lit(0).alias("omitted"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(s["used"] > 0, 1).otherwise(0)
        use_small = (s["used"] + gap + x["full"] > room) & x["small"].isNotNull()
        size = F.when(use_small, x["small"]).otherwise(x["full"])
        takes = (s["used"] + gap + size <= room) & (size > 0)
        one = F.array(F.struct(x["id"].cast("string").alias("id"), use_small.alias("compact"), *(x[c].alias(c) for c in carried)))
        return F.struct(
            F.when(takes, s["used"] + gap + size).otherwise(s["used"]).alias("used"),
            F.when(takes, F.concat(s["taken"], one.cast(kind))).otherwise(s["taken"]).alias("taken"),
            (s["omitted"] + F.when(takes, 0).otherwise(1)).alias("omitted"),
        )

    # where all items fit one after the other, all are taken whole, and there is nothing to fold
    every = F.transform("items", lambda x: F.struct(x["id"].cast("string").alias("id"), F.lit(False).alias("compact"), *(x[c].alias(c) for c in carried))).cast(kind)
    whole = F.struct((F.col("start") + F.col("whole")).cast("int").alias("used"), every.alias("taken"), F.lit(0).alias("omitted"))
    fits = (F.col("start") > 0) & (F.col("least") > 0) & (F.col("start") + F.col("whole") <= room)
    return held.select(packet, F.when(fits, whole).otherwise(F.aggregate("items", zero, step)).alias("p")).select(packet, "p.*")


def packed(items: DataFrame, packet: str, header: str | Column, budget: int, bytes_a_token: int = 4) -> DataFrame:
    """items(packet, id, score, text, compact) -> one row a packet: the ids packed, in order, the bytes they take with the
    header, and how many were omitted or compacted.

    Items are taken greedily while they fit, one byte parting each from what stands before; one that doesn't fit is tried in
    its compact form, if it has one, and otherwise left out, and later ones may still fit. The order makes this a fold: the
    ids and sizes of one packet, not its texts, meet in one row. A packet is one answer, whose parts are bounded where they are gathered.
    The header is one for all packets, or a column of the items that is the same throughout a packet.
    """
    return of_folded(folded(items, packet, header, budget, bytes_a_token), packet)


def of_folded(out: DataFrame, packet: str) -> DataFrame:
    return out.select(packet, "used", F.transform("taken", lambda t: t["id"]).alias("ids"), "omitted", F.size(F.filter("taken", lambda t: t["compact"])).alias("compacted"))


def shown(items: DataFrame, packet: str, header: str | Column, budget: int, bytes_a_token: int = 4) -> DataFrame:
    """(packet, body): the texts of the items that packed() takes, full or compact, a line each. Ids are unique within a packet."""
    return texts_of(folded(items, packet, header, budget, bytes_a_token), items, packet)


def texts_of(out: DataFrame, items: DataFrame, packet: str) -> DataFrame:
    taken = out.select(packet, F.posexplode("taken").alias("at", "t"))
    rows = taken.select(packet, "at", F.col("t.id").alias("id"), F.col("t.compact").alias("_small")).join(items.withColumn("id", F.col("id").cast("string")), [packet, "id"])
    line = F.struct("at", F.when(F.col("_small"), F.col("compact")).otherwise(F.col("text")).alias("line"))
    return rows.groupBy(packet).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("body"))


def limited(rows: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows in order, with truncated: whether there was at least one more. One row more is read, none is counted."""
    probe = rows.orderBy(*order).limit(most + 1)
    numbered = probe.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    more = F.max("_n").over(Window.partitionBy(F.lit(0))) > most
    return numbered.withColumn("truncated", more).where(F.col("_n") <= most).drop("_n")
