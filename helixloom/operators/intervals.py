"""Half-open genomic intervals: overlap joins, islands, coverage, region sums and window statistics.

Intervals are columns tid, begin, end with begin < end; column names are parameters. Overlap joins are equi-joins
on (tid, level, bin). An interval's own level is the finest whose bins are at least as wide as it is. A pair meets at the
coarser of its two own levels, so a row enters its own level, and the coarser ones only for partners that are at home
there: two intervals that are both finer never meet at a coarse level. A pair is kept only in the bin where the later
of the two begins, so no pair appears twice and nothing is de-duplicated. At each level a row touches at most two bins,
whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bin width of the finest level, and how many times wider each next level is.
BIN, FACTOR, LEVELS = 1024, 16, 4
#: Places that are summed or merged in one task before contigs are put together.
BLOCK = 1 << 20


def center(begin: Column, end: Column) -> Column:
    """The central position of a range, to the left of the middle for even sizes."""
    return begin + F.shiftright(F.greatest(end - begin, F.lit(1)) - 1, 1)


def intersects(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    return (a_begin < b_end) & (b_begin < a_end)


def expanded(begin: Column, end: Column, by: int, length: Column | None = None) -> tuple[Column, Column]:
    """The range grown by `by` on both sides, within [0, length)."""
    high = end + by
    return F.greatest(begin - by, F.lit(0)), F.least(high, length) if length is not None else high


def _level(size: Column) -> Column:
    """The finest level whose bins are at least as wide as the interval."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(size <= BIN * FACTOR**k, F.lit(k)).otherwise(out)
    return out


def _keyed(df: DataFrame, begin: str, end: str, own_kind: int, other_kind: int) -> DataFrame:
    """df with _meet (level and kind of meeting as one number), _bin and _first (how many of its bins begin before it at that level).

    Kind 0 is for two intervals of one level; own_kind is for partners of finer levels, other_kind for coarser ones.
    """
    own = _level(F.col(end) - F.col(begin))
    finer = [F.when(own < k, F.lit(3 * k + other_kind)) for k in range(1, LEVELS + 1)]
    meets = F.array_compact(F.array(3 * own, 3 * own + own_kind, *finer))
    width = f"(BIGINT({BIN}) * CAST(pow({FACTOR}, _meet div 3) AS BIGINT))"
    floor = lambda x: f"CAST(floor(({x}) / {width}) AS BIGINT)"
    return df.withColumn("_meet", F.explode(meets)).withColumn("_bin", F.explode(F.sequence(F.expr(floor(f"`{begin}`")), F.expr(floor(f"`{end}` - 1")))))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs that share a bin, before their places are compared: left has _tid, _lb, _le and right _rtid, _rb, _re."""
    a, b = _keyed(left, "_lb", "_le", 1, 2), _keyed(right, "_rb", "_re", 2, 1).withColumnsRenamed({"_meet": "_rmeet", "_bin": "_rbin"})
    return a.join(b, (F.col("_tid") == F.col("_rtid")) & (F.col("_meet") == F.col("_rmeet")) & (F.col("_bin") == F.col("_rbin")))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", left_cols=("tid", "begin", "end"), right_cols=("tid", "begin", "end"), gap: int = 0) -> DataFrame:
    """Rows of left with the rows of right on the same tid that overlap them, or lie within gap of them.

    how: inner, left_semi or left_anti. The tables must not share column names for inner. Semi and anti joins move
    places and a hash of 128 bits that stands for all columns of a row; equal rows share it, as they share the result.
    """
    (lt, lb, le), (rt, rb, re) = left_cols, right_cols
    places = lambda t, b, e, names, by=0: [F.col(t).alias(names[0]), (F.col(b).cast("long") - by).alias(names[1]), (F.col(e).cast("long") + by).alias(names[2])]
    of_left, of_right = places(lt, lb, le, ("_tid", "_lb", "_le"), gap), places(rt, rb, re, ("_rtid", "_rb", "_re"))
    width = f"(BIGINT({BIN}) * CAST(pow({FACTOR}, _meet div 3) AS BIGINT))"
    met = (F.col("_lb") < F.col("_re")) & (F.col("_rb") < F.col("_le")) & (F.expr(f"CAST(floor(greatest(_lb, _rb) / {width}) AS BIGINT)") == F.col("_bin"))
    if how == "inner":
        helpers = ["_tid", "_lb", "_le", "_rtid", "_rb", "_re", "_meet", "_bin", "_rmeet", "_rbin"]
        return candidates(left.select("*", *of_left), right.select("*", *of_right)).where(met).drop(*helpers)
    columns = [F.col(f"`{c}`") for c in left.columns]
    ident = [F.xxhash64(*columns).alias("_id1"), F.xxhash64(F.lit(1), *columns).alias("_id2")]
    # whether any partner is met is all that counts, so right intervals that overlap are one, as far as blocks go
    hulls = block_hulls(right.select(F.col(rt).alias("tid"), F.col(rb).alias("begin"), F.col(re).alias("end")), touching=True)
    hit = candidates(left.select(*ident, *of_left), hulls.select(*places("tid", "begin", "end", ("_rtid", "_rb", "_re")))).where(met).select("_id1", "_id2").distinct()
    return left.select("*", *ident).join(hit, ["_id1", "_id2"], how).select(*left.columns)


def islands(df: DataFrame, keys=("tid",), begin: str = "begin", end: str = "end", touching: bool = False, gap: int = 0) -> DataFrame:
    """Adds island: the number, from 0 in each key, of the run of ranges that overlap (or touch) through each other."""
    w = Window.partitionBy(*keys).orderBy(begin, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = before.isNull() | ((F.col(begin) > before + gap) if touching or gap else (F.col(begin) >= before))
    return df.withColumn("_new", apart.cast("long")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def block_hulls(df: DataFrame, keys=("tid",), begin: str = "begin", end: str = "end", touching: bool = False, gap: int = 0) -> DataFrame:
    """Hulls of the islands among the ranges that begin in each block of places, and how many ranges they have; hulls of different blocks may overlap."""
    block = F.expr(f"`{begin}` div {BLOCK}")
    local = islands(df.select(*keys, F.col(begin).alias("begin"), F.col(end).alias("end"), block.alias("_block")), (*keys, "_block"), touching=touching, gap=gap)
    return local.groupBy(*keys, "_block", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island", "_block")


def merged(df: DataFrame, keys=("tid",), begin: str = "begin", end: str = "end", touching: bool = False, gap: int = 0) -> DataFrame:
    """One row for each island: its hull and how many ranges it has.

    Ranges are merged within blocks of places first, so that a contig's task sees hulls, not ranges: later blocks begin
    later, so merging their hulls in order gives the same islands.
    """
    hulls = block_hulls(df, keys, begin, end, touching, gap)
    return islands(hulls, keys, touching=touching, gap=gap).groupBy(*keys, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n").alias("n"))


def with_hulls(df: DataFrame, keys=("tid",), stored=lambda x: x) -> DataFrame:
    """df (begin, end and others) with island, h_begin and h_end: the number and the hull of the island that each range is in.

    Each range knows its island among those of its block, and each of these its island of the contig, so they are put
    together by an equi-join and no range is repeated. stored: how to keep a table that is read more than once.
    """
    own = [*keys, "_block", "_local"]
    local = stored(islands(df.withColumn("_block", F.expr(f"begin div {BLOCK}")), (*keys, "_block")).withColumnRenamed("island", "_local"))
    whole = islands(local.groupBy(*own).agg(F.min("begin").alias("begin"), F.max("end").alias("end")), keys)
    w = Window.partitionBy(*keys, "island")
    return local.join(whole.select(*own, "island", F.min("begin").over(w).alias("h_begin"), F.max("end").over(w).alias("h_end")), own).drop("_block", "_local")


def steps(df: DataFrame, keys=("tid",), begin: str = "begin", end: str = "end", weight: Column | None = None) -> DataFrame:
    """pos and change of the summed weight at each place where it changes; added up before any shuffle."""
    weight = F.lit(1).cast("long") if weight is None else weight
    events = F.explode(F.array(F.struct(F.col(begin).alias("pos"), weight.alias("change")), F.struct(F.col(end).alias("pos"), (-weight).alias("change"))))
    return df.select(*keys, events.alias("e")).select(*keys, "e.pos", "e.change").groupBy(*keys, "pos").agg(F.sum("change").alias("change"))


def coverage(df: DataFrame, keys=("tid",), begin: str = "begin", end: str = "end", weight: Column | None = None) -> DataFrame:
    """begin, end and depth of the runs of equal summed weight, places without any left out.

    Places are summed along blocks; what lies before a block, and where the next one begins, comes from a row for each block.
    """
    out = steps(df, keys, begin, end, weight).withColumn("_block", F.expr(f"pos div {BLOCK}"))
    along = Window.partitionBy(*keys).orderBy("_block")
    blocks = out.groupBy(*keys, "_block").agg(F.sum("change").alias("_change"), F.min("pos").alias("_first"))
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_change").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(along).alias("_after"))
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    out = out.join(blocks, [*keys, "_block"])
    depth = F.col("_before") + F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("depth", depth).withColumn("next", F.coalesce(F.lead("pos").over(w), "_after"))
    return out.where("next IS NOT NULL AND depth <> 0").select(*keys, F.col("pos").alias("begin"), F.col("next").alias("end"), "depth")


def region_peak(df: DataFrame, keys=("tid",), begin: str = "begin", end: str = "end", weight: Column | None = None) -> DataFrame:
    """The largest summed weight of any place."""
    return coverage(df, keys, begin, end, weight).groupBy(*keys).agg(F.max("depth").alias("peak"))


def minimum_span(df: DataFrame, keys, position: str, window: int = 4) -> DataFrame:
    """The shortest distance that window + 1 successive positions span (or all of them, if fewer), per key."""
    w = Window.partitionBy(*keys).orderBy(position)
    n = F.count("*").over(Window.partitionBy(*keys))
    ahead = F.lead(position, window).over(w)
    first, last = F.min(position).over(Window.partitionBy(*keys)), F.max(position).over(Window.partitionBy(*keys))
    return df.select(*keys, F.when(n <= window, last - first).otherwise(ahead - F.col(position)).alias("span")).groupBy(*keys).agg(F.min("span").alias("min_span"))


def window_average(df: DataFrame, keys, order, value: str, size: int) -> DataFrame:
    """Adds window_sum and window_n over the last size rows; nulls take a place but do not count."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(size - 1), 0)
    return df.withColumn("window_sum", F.sum(value).over(w)).withColumn("window_n", F.count(value).over(w))


def circular_count(df: DataFrame, keys, order, flag: Column, size: int) -> DataFrame:
    """Adds recent, how many of the last size flags are set, and recent_max, its running maximum."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("recent", F.sum(flag.cast("long")).over(w.rowsBetween(-(size - 1), 0))).withColumn("recent_max", F.max("recent").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def adjacent_groups(df: DataFrame, keys, order, same) -> DataFrame:
    """Adds run: the number, from 0, of the run of rows that equal the row just before them in the columns `same`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    unlike = F.lit(False)
    for c in same:
        unlike = unlike | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    new = F.when(F.row_number().over(w) == 1, 0).otherwise(unlike.cast("long"))
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
