"""Stage tables and the manifest: what is done is read, what isn't is computed."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("lectern.stages")
STEPS = ("chunk", "plan", "extract", "verify", "synthesize", "audit", "images", "render")


class StageStore:
    """Parquet tables of a folder, one for each step, partitioned by book so that a book's can be dropped alone."""

    def __init__(self, spark: SparkSession, folder: str, book: str = "book_id"):
        self.spark, self.folder, self.book = spark, folder.rstrip("/"), book

    def path(self, step: str) -> str:
        return f"{self.folder}/{step}"

    def read(self, step: str) -> DataFrame | None:
        """The step's table; None where it is missing or unreadable."""
        return _readable(self.spark, self.path(step))

    def run(self, step: str, books: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The step's rows of the given books; only books without any are computed, and added to the table."""
        have = self.read(step)
        todo = books if have is None else books.join(have.select(self.book).distinct(), self.book, "left_anti")
        if todo.take(1):
            compute(todo).write.mode("append").partitionBy(self.book).parquet(self.path(step))
        return self.spark.read.parquet(self.path(step)).join(books.select(self.book), self.book, "left_semi")

    def reset(self, step: str, book: str | None = None) -> list[str]:
        """Drop the tables (or one book's part) of a step and all later ones; 'chunk' drops everything."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = []
        for s in STEPS[STEPS.index(step) :]:
            where = jvm.org.apache.hadoop.fs.Path(self.path(s) if book is None else f"{self.path(s)}/{self.book}={book}")
            if where.getFileSystem(conf).delete(where, True):
                gone.append(s)
        return gone


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the folder of spark.checkpoint.dir; only where that is unset (one machine) into a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lectern-"))
    return df.checkpoint()


def upsert(old: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """old with the rows of new in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    """The version that the table's pointer names."""
    _, where, fs = _hadoop(spark, f"{path}/CURRENT")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def save(df: DataFrame, path: str) -> None:
    """Replace a table as one step: a new version is written beside the others, and then the pointer to the current one
    is renamed over the old pointer, which file systems do as one step. Readers see the old table or the new
    one. The version before stays for those who are reading it; older ones go."""
    spark = df.sparkSession
    old, new = _current(spark, path), f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{new}")
    jvm, beside, fs = _hadoop(spark, f"{path}/.{new}")
    out = fs.create(beside, True)
    out.write(bytearray(new.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(beside), context.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")), options)
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (old, new):
            fs.delete(status.getPath(), True)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that save wrote last; None if there is none, or none that can be read."""
    version = _current(spark, path)
    if version is None:
        return None
    return _readable(spark, f"{path}/{version}")


def _readable(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path; None where it is missing or damaged (Spark says so by several kinds of error)."""
    try:
        df = spark.read.parquet(path)
        df.limit(1).collect()
        return df
    except Exception as e:  # noqa: BLE001
        log.info("%s is not readable: %s", path, str(e).split("\n")[0])
        return None


def base_name(path):
    return F.substring_index(path, "/", -1)


def finished(index: DataFrame, outputs: DataFrame, saved: DataFrame) -> DataFrame:
    """(sha256) of books that need no run: all files of the index entry but the EPUB are in the output folder, and,
    if the entry has a title and both saved steps exist, so is the EPUB (else it is only built again).

    index: sha256, title, files; outputs: name; saved: sha256, has_synthesis, has_images.
    """
    files = index.select("sha256", F.explode_outer("files").alias("file")).withColumn("name", base_name("file"))
    there = outputs.select(F.col("name").alias("__n"), F.lit(True).alias("there")).distinct()
    seen = files.join(there, files["name"] == there["__n"], "left")
    epub = F.endswith("name", F.lit(".epub"))
    stats = seen.groupBy("sha256").agg(F.coalesce(F.bool_and(F.when(~epub, F.coalesce("there", F.lit(False)))), F.lit(True)).alias("pages"), F.coalesce(F.bool_or(F.when(epub, F.coalesce("there", F.lit(False)))), F.lit(False)).alias("epub"))
    rows = index.select("sha256", "title").join(stats, "sha256").join(saved, "sha256", "left")
    rebuild = F.col("title").isNotNull() & ~F.col("epub") & F.coalesce(F.col("has_synthesis") & F.col("has_images"), F.lit(False))
    return rows.where(F.col("pages") & ~rebuild).select("sha256")


def to_do(books: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    return books if force else books.join(done, "sha256", "left_anti")


def stale(old_files: DataFrame, new_files: DataFrame, outputs: DataFrame) -> DataFrame:
    """(name) of files that the last run wrote, this one did not, and that are still there."""
    names = old_files.select(base_name("file").alias("name")).distinct()
    return names.join(new_files.select(base_name("file").alias("name")), "name", "left_anti").join(outputs.select("name"), "name", "left_semi")
