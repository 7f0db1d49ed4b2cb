"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where all tasks run in the driver's own process and the session names none (tests) a
    temporary folder is set; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, light: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors.

    ``light``, for small rows: by a quarter as many tasks as there are shuffle partitions, each of
    which still takes its partitions one after the other; there are fewer files."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    (df.coalesce(tasks) if light else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name for SQL, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, also those with dots in their names."""
    return [col(c) for c in df.columns]


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front as long as a column has that name (in any case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str = "", seen: Iterable[Column] = ()) -> DataFrame:
    """``mapInArrow`` over whole rows, whatever the names of the columns (dots, backticks, repeats).

    ``run`` gets the columns of ``df`` and then those of ``seen``, named by their places; it returns
    those of ``df``, under the names that it got, and those that the schema ``added`` names."""
    from pyspark.sql.types import StructType

    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    more = StructType.fromDDL(added) if added else StructType()
    # columns of ``seen`` name those of ``df``, so they are made before the renaming
    wide = df.select("*", *seen) if seen else df
    given = wide.toDF(*[f"c{i}" for i in range(len(wide.columns))])
    return given.mapInArrow(tidy(run), StructType([*plain.schema.fields, *more.fields])).toDF(*names, *more.names)


def text_slices(texts: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    """The texts as Python strings, few at a time, each time with the place of the first."""
    for at in range(0, len(texts), rows):
        yield at, texts.slice(at, rows).to_pylist()


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[list[list]], dict[str, list]]], columns: list[str], schema: str
) -> DataFrame:
    """``mapInArrow`` over ``columns``: ``make`` builds, once a task, a function from column
    lists to the lists of the columns in ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    kinds = StructType.fromDDL(schema)
    names = kinds.names
    kinds = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kinds)])
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                got = work([c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(got[n], type=f.type) for n, f in zip(names, arrow, strict=True)], schema=arrow)

    # plain names on either side: an id column may have a dot in its name
    given = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return given.mapInArrow(tidy(run), kinds).toDF(*names)


def once(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept by the worker process for the next task with the same ``key``.

    One object at a time: that of the last key.  A new process just makes it again."""
    held = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if held.get("key") != key:
        held.update(key=None, made=None)
        held.update(made=make(), key=key)
    return held["made"]


def tidy(run: Callable) -> Callable:
    """An Arrow function that gives the memory of its finished task back to the system; worker
    processes live on, and would keep it beside those of other stages."""

    def tidied(batches):
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
        if trim:
            trim(0)

    return tidied


def file_bytes(path: str) -> bytes:
    """A vocabulary file on the driver; its bytes travel with the task, so workers need no such file."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)
