"""Mixing sources to target weights by hash thresholds, in DataFrame operations alone.

Sizes are summed by source and by the leading bits of a row hash. In the running sum of such a histogram one bucket holds
the point where a source's budget is spent; only its rows are summed again by the next bits, and so on, until a bucket
is a single hash. Rows that share that hash (repeated ones) are told apart by a second hash, of their place, in the same way.
What lies below is taken: one comparison a row, and no rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.common import WORD, partitions, written

#: Bits of the row hash, and how many of them a histogram adds to those before.
HASH_BITS, STEP_BITS = 60, 12
#: Weights go round in this order over the sources by name; a source is repeated so often at most.
WEIGHTS, MOST = (1, 2, 3), 3


def row_hash(doc_id: str, text: str) -> Column:
    """The first 60 bits of the MD5 of id and text: the same on every run, and the same in other engines."""
    name = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def in_ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ranges of ``order``, with _part, the number of their range: what follows in order is summed range by range."""
    spark = rows.sparkSession
    return written(rows.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Rows of in_ranges() with the sums of all rows before each in ``order``. A range is summed by itself; what comes before it
    is taken from a row a range."""
    of_range = rows.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    ahead = of_range.select("_part", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(ahead), "_part")
    return summed.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(*(f"_{n}" for n in sums), "_part")


def targets_by_source(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, size) -> (source, source_size, target): all sizes together, shared by weight.

    Sources in order of their code points, null last, weigh ``weights`` in turn. A target stops at ``most`` times its source's
    size and the excess goes to the others by weight, until none is above. The fixed point is found at once: in order
    of size against weight, the first source that stays below its stop sets the level of all that follow. Sources are ranked and
    summed in ranges, however many there are.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.asc_nulls_last("source")]
    cycle = F.array(*map(F.lit, weights))
    ranked = running(in_ranges(total, by_name), by_name, {"rank": F.lit(1)}).withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    ranked = ranked.withColumn("stop", F.col("source_size") * most).withColumn("ratio", F.col("stop") / F.col("weight"))
    by_ratio = [F.col("ratio"), F.col("rank")]
    ordered = running(in_ranges(ranked, by_ratio), by_ratio, {"stopped": F.col("stop"), "weighed": F.col("weight")})
    whole = total.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_all"))
    weight_of_all = ranked.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("_weights"))
    leveled = ordered.join(F.broadcast(whole)).join(F.broadcast(weight_of_all))  # one row each
    leveled = written(leveled.withColumn("level", (F.col("_all") - F.col("stopped")) / (F.col("_weights") - F.col("weighed"))))
    level = leveled.where("ratio > level").agg(F.min(F.struct("ratio", "rank", "level"))["level"].alias("_level"))
    stop = F.col("stop").cast("double")
    target = F.least(stop, F.coalesce(F.col("_level") * F.col("weight"), stop))
    return leveled.join(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def _narrowed(rows: DataFrame, left: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(rows, edge): by nested histograms of the hash ``by``, the rows at the point where what is left of each source's budget is spent, and
    for each source that value of the hash, their number and sizes, and what is left for them."""
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        summed = rows.groupBy("source", F.shiftright(by, shift).alias("bucket")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"))
        summed = summed.withColumn("end", F.sum("sum").over(Window.partitionBy("source").orderBy("bucket"))).alias("s")
        edge = summed.join(left.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))).where("end - sum <= left and end > left")
        edge = written(edge.select("s.source", "bucket", (F.col("left") - F.col("end") + F.col("sum")).alias("left"), "sum", "n"))
        same = F.col("r.source").eqNullSafe(F.col("e.source")) & (F.shiftright(f"r.{by}", shift) == F.col("e.bucket"))
        rows = rows.alias("r").join(edge.alias("e"), same).select("r.*")
        left = edge.select("source", "left")
    return rows, edge


def cuts(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """sizes(source, size, hash, place), budgets(source, budget) -> (source, cut, place_cut): rows with a hash below ``cut`` come nearest to the
    budget, with those of that hash whose place is below ``place_cut``.

    A row is in if half of its size still fits, so that the sum misses the budget by half a row at most. Rows of equal
    hash have equal sizes: as many of them are in as fit.
    """
    rows, edge = _narrowed(sizes, budgets.select("source", F.col("budget").alias("left")), "hash")
    fits = F.when(F.col("sum") <= 2 * F.col("left"), 1).otherwise(0)
    single = edge.where("n = 1").select("source", (F.col("bucket") + fits).alias("cut"), F.lit(0).cast("long").alias("place_cut"))
    several = edge.where("n > 1").select("source", F.col("bucket").alias("cut"), "left")
    if several.isEmpty():
        return single
    wanted = several.alias("e")
    rows = written(rows.alias("r").join(wanted, F.col("r.source").eqNullSafe(F.col("e.source"))).select("r.*"))
    _, last = _narrowed(rows, several.select("source", "left"), "place")
    last = last.select(F.col("source").alias("_source"), (F.col("bucket") + fits).alias("place_cut"))
    return single.unionByName(several.join(last, F.col("source").eqNullSafe(F.col("_source"))).select("source", "cut", "place_cut"))


def sized(documents: DataFrame, text: str, source: str, doc_id: str) -> dict[str, Column]:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return {"_source": F.col(source), "_size": size, "_hash": row_hash(doc_id, text), "_number": F.monotonically_increasing_id()}


def place() -> Column:
    """A hash of a row's number, which is written with the row: it tells repeated rows apart, evenly."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col("_number")), 64 - HASH_BITS)


def plan_of(rows: DataFrame) -> DataFrame:
    """Written rows(_source, _size, _hash, _number) -> (source, source_size, target, whole, cut, place_cut), one row a source: a row of it is
    taken ``whole`` times, and once more if it lies below the cut."""
    rows = rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("hash"), place().alias("place"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(0).cast("long")
    sources = written(targets_by_source(rows).withColumn("whole", whole))
    budget = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    cut = cuts(rows.where("size > 0"), sources.select("source", budget.alias("budget"))).alias("c")
    joined = sources.alias("s").join(cut, F.col("s.source").eqNullSafe(F.col("c.source")), "left")
    return joined.select("s.source", "source_size", "target", "whole", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cut", "place_cut")))


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns and _copies to written rows(_source, _hash, _number, ...). The plan is written first: the planner then knows
    its size, and leaves the rows where they are if it is below the threshold for broadcasts."""
    plan = written(plan.select(*(F.col(c).alias(f"_p_{c}") for c in plan.columns)))
    joined = rows.join(plan, F.col("_source").eqNullSafe(F.col("_p_source")))
    below = (F.col("_hash") < F.col("_p_cut")) | ((F.col("_hash") == F.col("_p_cut")) & (place() < F.col("_p_place_cut")))
    return joined.withColumn("_copies", F.col("_p_whole") + below.cast("long"))


def mix(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The columns ``keep`` of each row, its size, source_size, target and taken.

    size is the number of words of the whole text (null: 0); taken is how many words the mix takes of the row, repeats
    counted: a source is taken whole as often as its target allows, and once more up to the cut of what remains. The
    taken words of a source miss its target by half of one row's size at most, repeated rows included: of equal rows, as many are
    taken once more as fit. An empty table gives an empty result; sources without words have target 0; null is a source of its own.
    """
    named = {f"_{i}": F.col(k) for i, k in enumerate(keep)}
    rows = written(documents.select(*(c.alias(n) for n, c in (named | sized(documents, text, source, doc_id)).items())))
    out = copies(rows, plan_of(rows))
    results = {"size": "_size", "source_size": "_p_source_size", "target": "_p_target"}
    return out.select(*(F.col(n).alias(k) for n, k in zip(named, keep, strict=True)), *(F.col(c).alias(k) for k, c in results.items()), (F.col("_size") * F.col("_copies")).alias("taken"))


def mixed_rows(documents: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of ``documents`` with all their columns, whatever their names, each as often as mix() takes it (a
    row without words as often as its source is taken whole, and once more by the same cut).

    The rows are written with their numbers, so that repeated ones are told apart in the same way throughout."""
    own = {c: f"_{i}" for i, c in enumerate(documents.columns)}
    named = documents.select(*(documents[c].alias(n) for c, n in own.items()))
    rows = written(named.withColumns(sized(named, own[text], own[source], own[doc_id])))
    out = copies(rows, plan_of(rows)).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*(F.col(n).alias(c) for c, n in own.items()))


ORACLE = """
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) as rank from s),
w as (select *, (rank - 1) % 3 + 1 as weight, source_size * 3 as stop, cast(source_size * 3 as double) / ((rank - 1) % 3 + 1) as ratio from r),
l as (select *, cast(sum(source_size) over () - coalesce(sum(stop) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0) as double)
    / cast(sum(weight) over (order by ratio, rank rows between current row and unbounded following) as double) as level from w),
f as (select arg_min(level, (ratio, rank)) as level from l where ratio > level),
t as (select source, source_size, case when f.level is null then cast(stop as double) else least(cast(stop as double), f.level * weight) end as target from l, f),
b as (select *, case when source_size > 0 then cast(least(3, floor(target / source_size + 1e-9)) as bigint) else 0 end as whole from t),
g as (select source, h, sum(size) as n from d where size > 0 group by source, h),
c as (select source, h, n, sum(n) over (partition by source order by h) - n as before from g),
o as (select *, row_number() over (partition by source, h order by doc_id) - 1 as j from d)
select d.doc_id, d.size, b.source_size, b.target,
  cast(d.size * (b.whole + case when c.before is not null and c.before + (d.j + 0.5) * d.size <= greatest(0.0, b.target - b.whole * b.source_size) then 1 else 0 end) as bigint) as taken
from o as d join b on d.source is not distinct from b.source
left join c on d.source is not distinct from c.source and d.h = c.h
"""
