"""Shared plumbing of the training-data operators.

Texts reach Python as Arrow binary columns, so bytes methods (``lower``,
``split``, ``strip``: ASCII only, which is what the contracts ask for) run
without decoding.  Work tables that cut lineage are written below the folder
the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name inside the folder shared by driver and executors."""
    base = spark.conf.get(_DEFAULT_CONF, None) or spark.sparkContext.getConf().get(_DEFAULT_CONF)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        # tests on one machine
        base = "file://" + tempfile.mkdtemp(prefix="scrivener-")
        spark.conf.set(_DEFAULT_CONF, base)
    return f"{base.rstrip('/')}/scrivener-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Work tables of one computation; those that nothing reads any more are deleted."""

    def __init__(self):
        self.paths: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = shared_dir(spark)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, spark: SparkSession, keep: int = 0) -> None:
        """Delete all tables but the last ``keep``."""
        old, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in old:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, text as binary, null as empty) of every row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
        *(F.col(c) for c in more),
    )


def map_docs(df: DataFrame, row_fn_factory: Callable[[], Callable[[bytes], tuple]], fields: list[pa.Field], schema: str) -> DataFrame:
    """Row-wise map of (doc_id, text): ``row_fn_factory()`` is built once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = row_fn_factory()
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            step = 2048
            for at in range(0, batch.num_rows, step):
                part = column.slice(at, step)
                out = list(zip(*[fn(x.as_py()) for x in part])) or [()] * len(fields)
                arrays = [ids.slice(at, step)] + [pa.array(v, f.type) for v, f in zip(out, fields)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f.name for f in fields]])

    return df.mapInArrow(run, "doc_id long, " + schema)
