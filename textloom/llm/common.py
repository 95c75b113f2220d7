"""What several operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space between words, as a class of Java, Python and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves all other letters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def quoted(name: str) -> Column:
    """The column of that name, whatever letters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A name like this one that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder is set, in local mode only: other machines would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a table written in the shared folder; its readers read the columns that they need."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def publish(store, temp: str, final: str) -> None:
    """Gives a whole file its name. Where a task ran twice the file may be there already, with the same bytes."""
    try:
        store.move(temp, final)
    except OSError:
        if not store.get_file_info(final).is_file:
            raise
        store.delete_file(temp)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row, however often it is used: no rule of the optimizer copies an expression through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def cells(name: str) -> dict:
    """A store that lasts as long as the Python process, for what is costly to load."""
    return vars(sys).setdefault("_textloom", {}).setdefault(name, {})


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 2000) -> DataFrame:
    """fn over slices of at most `rows` rows of each Arrow batch; a slice at a time is held as Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
