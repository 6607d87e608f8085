"""Tables that cut the lineage between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: shuffle files go when the write that needed them has ended, not when the driver happens
#: to collect its garbage.  Batches of rows are small, as long texts and sets are held in them several times.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
#: For writes that make long texts: methods too long for the JVM to compile, which it then interprets, are not made; Spark makes shorter ones.
LONG_EXPRESSIONS = {"spark.sql.codegen.hugeMethodLimit": "8000"}
#: For writes of short rows: batches end at a number of rows alone, as Spark else measures a batch again at each row.
SHORT_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": "2147483647"}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none and all runs on one machine (tests), a temporary folder is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="framewise-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it (else give it with ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def write_table(df: DataFrame, name: str, more: dict[str, str] | None = None) -> str:
    """Write ``df`` once to the shared folder, under the settings above and ``more``; gives the path.

    What reads the table does not run ``df`` again, and a lost executor takes
    nothing with it.  The folder goes with :func:`drop_tables`, or when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framewise/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    settings = SETTINGS | (more or {})
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return path


def stored(df: DataFrame, name: str, more: dict[str, str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, more))


def tables() -> list[str]:
    """Paths of the tables that are still there, in the order they were written."""
    return list(_written)


def drop_tables(*paths: str) -> None:
    for path in paths:
        spark = _written.pop(path)
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended already; the folder is left
            pass


def hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path, of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def make_folder(spark: SparkSession, path: str) -> None:
    """A new folder; an error where the name is taken."""
    files, target = hadoop(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    files.mkdirs(target)


def _rename(spark: SparkSession, new: str, path: str, over: bool) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if over else kind.NONE
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (new, path))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf).rename(source, target, how)


def write_text(spark: SparkSession, path: str, text: str, over: bool = True) -> None:
    """A file that appears whole or not at all, in any store; without ``over`` a FileExistsError where the name is taken."""
    aside = f"{path}.{uuid.uuid4().hex}"
    files, target = hadoop(spark, aside)
    out = files.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        _rename(spark, aside, path, over)
    except Exception as error:
        files.delete(target, False)
        if not over and files.exists(hadoop(spark, path)[1]):
            raise FileExistsError(path) from error
        raise


def read_text(spark: SparkSession, path: str) -> str:
    files, target = hadoop(spark, path)
    with_ = files.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(with_)).decode()
    finally:
        with_.close()


def take_name(files: Any, new: Any, here: Any, before: Any) -> None:
    """``new`` gets the name ``here``.  What has it so far waits as ``before``: it goes when that is done, and comes back where it fails."""
    waits = files.exists(here)
    if waits and not files.rename(here, before):
        raise OSError(f"{here} could not make way")
    try:
        if not files.rename(new, here):
            raise OSError(f"{new} could not take the name {here}")
    except BaseException:
        if waits and not files.exists(here):
            files.rename(before, here)
        raise
    if waits:
        files.delete(before, True)


class Scratch:
    """Tables of one run of an operator, by name, so that each goes after its last reader."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = write_table(df, name)
        return df.sparkSession.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        drop_tables(*(self.paths.pop(name) for name in names))


atexit.register(lambda: drop_tables(*tables()))
