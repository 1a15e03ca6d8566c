"""Reading raw texts and writing filtered ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.filters import compose, filter_lines


def spread(table: DataFrame) -> DataFrame:
    """The table over all cores, if it is so small that its files give fewer pieces; else as it is, unshuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() * 2 <= cores else table


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text: a row for each file, whole; .gz is unpacked. For files that fit a task."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length, text: UTF-8 where the bytes are valid, else read as ISO-8859-1."""
    raw = spark.read.format("binaryFile").load(paths)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("path", "length", text.alias("text"))


def read_chunks(spark: SparkSession, paths: str | list[str], separator: str = "\n") -> DataFrame:
    """text: a row for each piece of a file up to the separator, so files of any size split among tasks."""
    return spark.read.option("lineSep", separator).text(paths).select(F.col("value").alias("text"))


def read_slices(spark: SparkSession, paths: str | list[str], size: int = 16 << 20) -> DataFrame:
    """path, start, text: files of any size in slices of about ``size`` bytes, with or without separators.

    Sizes are listed without reading; each slice is read by itself, from the first character that begins in it to the
    last one, so the slices of a file of valid UTF-8 put together are the file. Other bytes are read as U+FFFD.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    slices = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))

    def cut(data: bytes, at: int) -> int:
        """The first place from ``at`` on where a character begins; a character has four bytes at most."""
        return next((k for k in range(at, min(at + 3, len(data))) if data[k] & 0xC0 != 0x80), min(at + 3, len(data)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    data = f.read_at(size + 3, start)
                text = data[cut(data, 0) if start else 0 : cut(data, size)].decode(errors="replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([text], pa.string())], names=["path", "start", "text"])

    return slices.repartition("path", "start").mapInArrow(read, "path string, start long, text string")


def sample(docs: DataFrame, every: int, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """A fixed 1-in-``every`` sample by id: the same rows in every pass."""
    return docs.where(F.pmod(F.col(id_col) + F.lit(seed), F.lit(every)) == 0)


def sample_pieces(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", seed: int = 0) -> DataFrame:
    """id, piece: from after the last separator before a place fixed by the id, to the first separator that makes
    it at least ``length`` characters, or to the end. Texts up to the length are whole."""
    t, n = F.col(text_col), F.length(text_col)
    at = F.pmod(F.col(id_col) * F.lit(2654435761) + F.lit(seed), F.greatest(n - length, F.lit(1))).cast("int")
    head = F.substr(t, F.lit(1), at)
    tail_of_head = F.length(F.substring_index(head, separator, -1))
    start = at - tail_of_head
    rest = F.substr(t, start + 1)
    after = F.instr(F.substr(rest, F.lit(length)), separator)
    piece = F.when(after > 0, F.substr(rest, F.lit(1), F.lit(length) + after - 1)).otherwise(rest)
    return docs.select(id_col, F.when(n <= length, t).otherwise(piece).alias("piece"))


def directory_of(index: Column) -> Column:
    """12345 -> 1/2/3/4/12345; ids of one digit lie under 0."""
    plain = index.cast("string")
    padded = F.when(F.length(plain) < 2, F.lpad(plain, 2, "0")).otherwise(plain)
    digits = F.split(F.substr(padded, F.lit(1), F.length(padded) - 1), "")
    return F.concat_ws("/", digits, F.array(plain))


def candidate_addresses(index: Column, root: str) -> Column:
    """The addresses at which a text may be, in the order of preference."""
    return F.array(*[F.concat(F.lit(root.rstrip("/") + "/"), directory_of(index), F.lit("/"), index.cast("string"), F.lit(e)) for e in (".txt", "-8.txt", "-0.txt")])


def write_filtered(spark: SparkSession, source: str, target: str, caps: bool = False, words: bool = False) -> None:
    """Filter a text file line by line into a folder of text files."""
    lines = spark.read.text(source)
    one = F.regexp_replace(filter_lines(F.concat("value", F.lit("\n")), caps, words), r"\n\z", "")
    lines.select(F.when(F.col("value") == "", F.lit("")).otherwise(one).alias("value")).write.text(target)


def prepare(docs: DataFrame, filters: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Headers stripped, paragraphs unwrapped, filters applied: id, text."""
    from glyphmill.operators.clean import clean_text, strip_headers

    return clean_text(strip_headers(docs, id_col, text_col), id_col).select(id_col, compose(filters)(F.col("text")).alias("text"))
