"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package from where the driver did; on a cluster without
    # that folder the package comes with --py-files.
    home, path = str(Path(__file__).parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{path}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, wide: bool = False) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage.

    The stage that makes df runs in as many tasks as its input has parts. Narrow rows (ids,
    hashes, counts) are then dealt anew, so that files are sized by bytes and their number
    follows the rows; wide ones (texts, sets) stay as they were dealt. The folder is
    spark.checkpoint.dir; where that is unset, a local master (tests) takes a temporary
    folder, and a cluster has none, which is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="veilframe-"))
    return (df if wide else df.hint("rebalance")).checkpoint()


def forget(df: DataFrame) -> None:
    """Deletes the files of a frame that checkpoint() gave; it can't be read any more."""
    at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if at.isDefined():
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of BATCH rows, so that the memory of both sides
    follows a few hundred texts. The setting is the session's."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return df.mapInArrow(run, schema)


def held(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks until unpersist(); a lost part is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def spaced(text: Column) -> Column:
    """Text with each of the other five ASCII white-space characters as a space."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """All [^\\x20\\x09-\\x0D]+ of a text in order; null text: none."""
    return F.array_remove(F.split(spaced(F.coalesce(text, F.lit(""))), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def is_space(c: str) -> bool:
    return c in " \t\n\x0b\x0c\r"


#: The same words in Python: str.split() would also split at other Unicode spaces.
SPACES_TO_BLANK = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def split_words(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(SPACES_TO_BLANK).split(" ") if w]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
