"""Shared helpers of the training-data operators: reading tables, shipping code, cutting lineage, words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space (space and U+0009..U+000D), as a Java regular expression class.
SPACE = r"[ \t-\r]"
#: Bytes of one Arrow batch handed to a Python worker; long texts make batches of few rows.
ARROW_BYTES = 16 << 20

_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one input table (all of them if none are named), through Spark's reader only."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def ship(spark: SparkSession, rows: int = 500) -> None:
    """Sets the rows of an Arrow batch (few, as texts may be long), and makes this package importable in Python workers: at once if PYTHONPATH has it, else as a zip by Spark's own file server."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES)), ("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    root = Path(__file__).resolve().parents[2]
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if os.path.realpath(root) in paths or app in _shipped:
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp()) / "helixloom_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted((root / "helixloom").rglob("*.py")):
            out.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and Spark runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='helixloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet into the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    # the shuffle files of what has been written are not needed again; without this they stay until the driver's next collection
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a table made by stored(), once nothing lazy refers to it any more."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_words(text: F.Column) -> F.Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{SPACE}+")
    return F.filter(parts, lambda w: w != "")


def text_key(text: F.Column) -> F.Column:
    """128 bits that equal texts share; null has a key of its own."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(F.sha2(text, 256), 1, 32))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, each made longer until no column of df has it."""
    known, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        out.append(name)
    return out


def boxed(df: DataFrame, *extra: F.Column) -> DataFrame:
    """All columns of df in one struct named row, with other columns beside it, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *extra)


def unboxed(df: DataFrame, columns: list[str], *extra: F.Column) -> DataFrame:
    """The named columns out of row, and others."""
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *extra)


#: Most rows of a decision about documents, or most array entries in one, that are sent to all tasks (some tens of MB), counted first; more are joined by shuffling.
DECISIONS = 500_000


def few(df: DataFrame, places: bool = False) -> DataFrame:
    """df (stored), marked for broadcast if it is counted small. places: count what its arrays hit_words and hit_items hold, too."""
    n = df.agg(F.sum(F.size("hit_words") + F.size("hit_items") + 1)).first()[0] if places else df.count()
    return F.broadcast(df) if (n or 0) <= DECISIONS else df


def least_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each root of found (doc_id, version, root) the row of docs with the least doc_id (then version), once.

    What goes is decided without the texts: a document that is not its root's least, and all but one row of repeated ones.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    rows = found.groupBy("root", key.alias("key")).agg(F.count("*").alias("n"))
    least = rows.groupBy("root").agg(F.min("key").alias("least"))
    marked = rows.join(least, "root").select("key", (F.col("key") != F.col("least")).alias("goes"), F.col("n") > 1)
    marked = marked.toDF("key", "goes", "repeated").where("goes OR repeated")
    marked = stored(marked.select(F.col("key.doc_id").alias("id"), F.col("key.version").alias("v"), "goes"), "decisions")
    boxes = boxed(docs, F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_text"))
    joined = boxes.join(few(marked), F.col("of_id").eqNullSafe(F.col("id")) & (F.col("of_text") == F.col("v")), "left")
    once = joined.where(~F.col("goes")).dropDuplicates(["of_id", "of_text"])
    return unboxed(joined.where("goes IS NULL").unionAll(once), docs.columns)
