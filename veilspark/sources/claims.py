"""Tables that several writers may append to, one at a time: who appends takes a number
that nobody else can take, then its rows come in as one file at once."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _file(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def claim(spark: SparkSession, folder: str, number: int) -> bool:
    """True for the one caller that gets the number: a file that must not exist yet is
    made in a folder which readers of the table pass over. The store has to make
    files exclusively, as distributed file systems do."""
    files, path = _file(spark, f"{folder}/_claims/{number}")
    if files.getScheme() == "file":  # Hadoop looks first and makes the file then; the system does both at once
        name = path.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        try:
            os.close(os.open(name, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        files.create(path, False).close()
    except Py4JJavaError:
        if not files.exists(path):
            raise
        return False
    return True


def give_up(spark: SparkSession, folder: str, number: int) -> None:
    """Free a number whose holder died before its rows came in."""
    files, path = _file(spark, f"{folder}/_claims/{number}")
    files.delete(path, False)


def append_claimed(rows: DataFrame, folder: str, number: int) -> None:
    """Append a few rows to the table in folder, under a number that the caller has
    claimed. They are written aside and renamed as one file, so readers see all of
    them or none, and no writer clears the unfinished work of another."""
    spark = rows.sparkSession
    files, aside = _file(spark, f"{folder}/_claims/{number}.rows")
    rows.coalesce(1).write.mode("overwrite").parquet(aside.toString())
    (part,) = [f.getPath() for f in files.listStatus(aside) if f.getPath().getName().startswith("part-")]
    _, to = _file(spark, f"{folder}/part-{number:012d}.parquet")
    if files.exists(to) or not files.rename(part, to):
        raise OSError(f"could not add {to.toString()}")
    files.delete(aside, True)
