"""Distributions and rates: fragment sizes, depths, counters and stable sums of logarithms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUANTILE_BINS = 1000
UPPER_TRIM = 0.9995


def rounded_size(size: Column) -> Column:
    """Sizes above 1000 keep their three leading digits."""
    digits = F.length(size.cast("string"))
    scale = F.pow(F.lit(10), F.greatest(digits - 3, F.lit(0))).cast("long")
    return F.when(size > 1000, size - size % scale).otherwise(size)


def size_histogram(df: DataFrame, keys, size: str) -> DataFrame:
    return df.where(F.col(size).isNotNull()).groupBy(*keys, rounded_size(F.col(size).cast("long")).alias("size")).agg(F.count("*").alias("n"))


def size_cdf(histogram: DataFrame, keys) -> DataFrame:
    """Adds below (observations of at most this size) and total."""
    w = Window.partitionBy(*keys).orderBy("size")
    return histogram.withColumn("below", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def quantile(cdf: DataFrame, keys, p: float) -> DataFrame:
    """The size at quantile p, by a table of 1000 bins: the first size whose share, in thousandths, reaches bin ceil(1000 p)."""
    import math

    bin_number = max(math.ceil(p * QUANTILE_BINS - 1e-9), 1)
    reached = F.rint(F.col("below") * QUANTILE_BINS / F.col("total")) >= bin_number
    return cdf.where(reached).groupBy(*keys).agg(F.min("size").alias("size")).withColumn("p", F.lit(p))


def quantiles(cdf: DataFrame, keys, ps) -> DataFrame:
    """quantile() of several p, as rows, in one pass over the table."""
    import math

    wanted = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(max(math.ceil(p * QUANTILE_BINS - 1e-9), 1)).alias("bin")) for p in ps])
    each = cdf.select(*keys, "size", F.rint(F.col("below") * QUANTILE_BINS / F.col("total")).alias("_at"), F.explode(wanted).alias("_w"))
    return each.where("_at >= _w.bin").groupBy(*keys, F.col("_w.p").alias("p")).agg(F.min("size").alias("size")).select(*keys, "size", "p")


def trimmed(histogram: DataFrame, keys, p: float = UPPER_TRIM) -> DataFrame:
    """The histogram without the sizes above quantile p."""
    at = quantile(size_cdf(histogram, keys), keys, p).select(*keys, F.col("size").alias("_at"))
    joined = histogram.join(at, list(keys)) if keys else histogram.join(F.broadcast(at), F.lit(True))
    return joined.where("size <= _at").drop("_at")


def nearest_density(histogram: DataFrame, keys, size: int, bins: int = 5) -> DataFrame:
    """Density at a size from the nearest `bins` observed sizes: their count over total and the span they cover."""
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col("size") - size), "size")
    near = histogram.withColumn("_rank", F.row_number().over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    near = near.where(F.col("_rank") <= bins).groupBy(*keys, "total").agg(F.sum("n").alias("near"), (F.max("size") - F.min("size") + 1).alias("span"))
    return near.select(*keys, (F.col("near") / (F.col("total") * F.col("span"))).alias("density"))


def converged(a: DataFrame, b: DataFrame, keys, tolerance: int = 1) -> DataFrame:
    """Whether two tables of quantiles (keys, p, size) agree within tolerance at every p."""
    both = a.join(b.select(*keys, "p", F.col("size").alias("_size")), [*keys, "p"])
    return both.groupBy(*keys).agg(F.bool_and(F.abs(F.col("size") - F.col("_size")) <= tolerance).alias("converged"))


def orientation(df: DataFrame, keys, orient: str, least: int = 100, share: float = 0.9) -> DataFrame:
    """The commonest orientation of each group, its share, and whether it is a consensus."""
    counts = df.groupBy(*keys, orient).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", orient)).alias("_best"), F.sum("n").alias("total"))
    return best.select(*keys, F.col(f"_best.{orient}").alias(orient), F.col("_best.n").alias("n"), "total", ((F.col("total") >= least) & (F.col("_best.n") >= F.col("total") * share)).alias("consensus"))


def without_outlier_blocks(df: DataFrame, keys, order, size: str, block: int = 1000, large: int = 5000, share: float = 0.01) -> DataFrame:
    """Rows of blocks of `block` successive rows in which fewer than `share` are `large` or larger."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_block", F.floor((F.row_number().over(w) - 1) / block).cast("long"))
    bad = F.avg((F.col(size) >= large).cast("int")).over(Window.partitionBy(*keys, "_block"))
    return numbered.withColumn("_bad", bad).where(F.col("_bad") < share).drop("_bad", "_block")


def median_depth(df: DataFrame, keys, depth: str) -> DataFrame:
    """Exact median of the depths above zero; 0 where there are none."""
    return df.groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col(depth) > 0, F.col(depth))), F.lit(0.0)).alias("median_depth"))


def merged_depths(df: DataFrame, contig: str, depth: str) -> DataFrame:
    return df.groupBy(contig).agg(F.sum(depth).alias("depth"))


def noise_rates(df: DataFrame) -> DataFrame:
    """Adds the rates of anomalous or split reads, assembly reads and remote reads from the counters of a sample."""
    return (
        df.withColumn("anomalous_rate", (F.col("anom") + F.col("split") - F.col("anom_and_split") + 10) / (F.col("total") + 1000))
        .withColumn("assembly_rate", (F.col("assm") + 10) / (F.col("total") + 1000))
        .withColumn("remote_rate", (F.col("remote") + 100) / (F.col("total") + 10000))
    )


def reservoir(df: DataFrame, keys, ident: str, n: int) -> DataFrame:
    """A fixed sample of n rows of each group: those with the least hashes of ident, so any run gives the same."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.col(ident).cast("string")), ident)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def stream_stats(df: DataFrame, keys, value: str) -> DataFrame:
    """Count, sum, mean, sample variance, deviation, error of the mean, least and greatest; null where undefined."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.var_samp(v)).alias("variance"), F.min(v).alias("least"), F.max(v).alias("greatest"))
    return out.withColumn("deviation", F.sqrt("variance")).withColumn("error", F.sqrt(F.col("variance") / F.col("n")))


def root_mean_square(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def log_sum(df: DataFrame, keys, value: str) -> DataFrame:
    """log(sum(exp(value))) of each group, stable."""
    top = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(value).alias("_top"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = df.join(top, same)
    return joined.groupBy(*keys, "_top").agg(F.sum(F.exp(F.col(value) - F.col("_top"))).alias("_sum")).select(*keys, (F.col("_top") + F.log("_sum")).alias("log_sum"))


def best_of_group(df: DataFrame, keys, *order) -> DataFrame:
    """The first row of each group by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def clipped_histogram(df: DataFrame, value: Column, most: int) -> DataFrame:
    """n of each value, with all from most on together."""
    return df.groupBy(F.least(value, F.lit(most).cast("long")).alias("bin")).agg(F.count("*").alias("n"))
