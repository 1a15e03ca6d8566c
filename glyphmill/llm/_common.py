"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus, read by Spark alone, so any store that Spark knows will do.

    A corpus of so few files that cores would idle is spread over them; a larger one is not shuffled.
    """
    found, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    if table in ("documents", "pages") and found.rdd.getNumPartitions() * 2 <= cores:
        return found.repartition(cores)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or f"file:{tempfile.gettempdir()}/glyphmill").rstrip("/")


class Workspace:
    """Tables that cut lineage: parquet in the shared folder, so a lost executor costs a reread only.

    ``cut`` writes and rereads; ``drop`` deletes what is no longer needed. What is left when the
    session ends goes then.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/glyphmill-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._cut_path)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # noqa: BLE001  the gateway may be gone at exit
            pass


def texts(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8 bytes; a null text is an empty one."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def each_text(function: Callable[[bytes | None], object], kind: pa.DataType) -> Callable[[Column], Column]:
    """A column function of one text column: whole texts as UTF-8 bytes, null as None, some hundred at a time."""

    @F.arrow_udf(pa_to_spark(kind))
    def run(column: pa.Array) -> pa.Array:
        raw = column.cast(pa.binary())
        parts = [pa.array([function(x) for x in raw.slice(at, 512).to_pylist()], kind) for at in range(0, len(raw), 512)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def pa_to_spark(kind: pa.DataType) -> str:
    return {pa.bool_(): "boolean", pa.string(): "string", pa.int64(): "long"}[kind]


def slot(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, so other columns of any name cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT_PARTS, HOT_LEAST, SALT = 1000, 64, 16  # a key of more than 1 / HOT_PARTS of all rows is hot, but for keys of few rows


def hot_keys(counts: DataFrame, on: list[str], n: str, total: int) -> list[int]:
    """Hashes of the counted keys that have more than 1 / HOT_PARTS of all rows: at most HOT_PARTS numbers."""
    found = counts.where(F.col(n) > max(HOT_LEAST, total // HOT_PARTS)).select(F.xxhash64(*on).alias("h")).distinct().collect()
    return [r["h"] for r in found]


def _is_hot(on: list[str], hot: list[int]) -> Column:
    return F.expr(f"xxhash64({', '.join(on)}) in ({', '.join(f'{h}L' if h > -(2**63) else 'bigint(-9223372036854775808)' for h in hot)})")


def join_hot(many: DataFrame, few: DataFrame, on: list[str], hot: list[int], how: str = "inner") -> DataFrame:
    """many.join(few, on, how), with no task that gets all rows of a hot key: those meet a broadcast of their few rows.

    hot: as of ``hot_keys``; ``few`` has a bounded number of rows of bounded size for each key.
    """
    if not hot:
        return many.join(few, on, how)
    held = _is_hot(on, hot)
    return many.where(held).join(F.broadcast(few.where(held)), on, how).unionByName(many.where(~held).join(few.where(~held), on, how))


def join_salted(many: DataFrame, few: DataFrame, on: list[str], hot: list[int], by: str) -> DataFrame:
    """many.join(few, on), where rows of a hot key are dealt to SALT tasks by another column; few's rows may be of any size."""
    if not hot:
        return many.join(few, on)
    held = _is_hot(on, hot)
    left = many.withColumn("_salt", F.when(held, F.pmod(F.xxhash64(by), F.lit(SALT))).otherwise(0).cast("int"))
    right = few.withColumn("_salt", F.explode(F.when(held, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"]).drop("_salt")
