"""Reading texts, sequences of numbers and patterns; writing patterns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.functions.text import without_nul


def read_texts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """doc_id, path, text: every file under path is a text, at most its first limit symbols. A text with the symbol 0 is an error when it is read."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    cut = whole if limit is None else whole.withColumn("text", F.substring("text", 1, limit))
    return without_nul(cut.select(F.xxhash64("path").alias("doc_id"), "path", "text"))


def read_table(spark: SparkSession, path: str, id_col: str, text_col: str, kind: str = "parquet") -> DataFrame:
    """doc_id, text: two columns of a table in any format that Spark reads."""
    return without_nul(spark.read.format(kind).load(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))


def read_sequences(spark: SparkSession, path: str, num_bytes: int) -> DataFrame:
    """path, pos, sym: every file under path is a sequence of little-endian numbers of num_bytes (1, 2, 4 or 8). A size that isn't a multiple is an error."""
    if num_bytes not in (1, 2, 4, 8):
        raise ValueError("num_bytes must be 1, 2, 4 or 8")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(content) % num_bytes:
                    raise ValueError(f"the size of {path_} is not a multiple of {num_bytes}")
                numbers = np.frombuffer(content, dtype=f"<u{num_bytes}").astype(np.int64)
                for at in range(0, len(numbers), 500_000):
                    part = numbers[at : at + 500_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path_] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["path", "pos", "sym"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos long, sym long")


def write_sequence(seq: DataFrame, path: str, num_bytes: int) -> None:
    """Writes a sequence (pos, sym) as a file of little-endian numbers, by the driver, which holds a partition at a time."""
    if num_bytes not in (1, 2, 4, 8):
        raise ValueError("num_bytes must be 1, 2, 4 or 8")
    spark, target = seq.sparkSession, path.rstrip("/") + "/sequence.bin"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        part: list[int] = []
        for row in seq.select("sym").orderBy("pos").toLocalIterator():  # one partition at a time
            part.append(row.sym)
            if len(part) == 500_000:
                stream.write(bytearray(np.array(part, dtype=f"<u{num_bytes}").tobytes()))
                part = []
        stream.write(bytearray(np.array(part, dtype=f"<u{num_bytes}").tobytes()))
    finally:
        stream.close()


def write_patterns(patterns: DataFrame, path: str, swaps: int = 0) -> None:
    """Patterns of one length with their header: how many, how long, how many swaps made them."""
    lengths = patterns.agg(F.count(F.lit(1)).alias("cnt"), F.min(F.length("pattern")).alias("least"), F.max(F.length("pattern")).alias("most")).first()
    if lengths.least != lengths.most:
        raise ValueError("patterns of one file have one length")
    head = [F.lit(lengths.cnt).cast("long").alias("cnt"), F.lit(lengths.most).cast("long").alias("len"), F.lit(swaps).cast("long").alias("swaps")]
    patterns.select("pattern_id", "pattern", *head).write.mode("overwrite").parquet(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern_id, pattern, cnt, len, swaps."""
    return spark.read.parquet(path)
