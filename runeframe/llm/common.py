"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.plans.scratch import kept

# What separates words, and what a word is.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column of any name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Values that running() takes at once.
STEP = 64


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each value, merge() of 0, all before it and itself. Within a step from its start, after what the steps before come to."""

    def upto(array: Column, n: Column) -> Column:
        return F.aggregate(F.slice(array, 1, n), F.lit(0), merge)

    def stepped(steps: Column) -> Column:
        def placed(ahead: Column) -> Column:
            return F.flatten(F.transform(steps, lambda step, b: F.transform(step, lambda _, i: merge(F.get(ahead, b), upto(step, i + 1)))))

        sums = F.transform(steps, lambda step: upto(step, F.size(step)))
        return let(sums, lambda s: let(F.transform(s, lambda _, b: upto(s, b)), placed))

    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda at: F.slice(v, at, STEP)), stepped)

    return let(values, cut)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: int, *columns: Column) -> Column:
    """Hash-random hexadecimal key of fixed length; null columns count as a value of their own."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]
    return F.md5(F.concat_ws("\x01", F.lit(str(seed)), *parts))


#: Equal ranges that random_key() values are dealt to: as many as three hexadecimal digits tell apart.
KEY_RANGES = 4096


def key_range(key: Column) -> Column:
    """Which of KEY_RANGES ranges a key falls in. Keys are uniform, so the ranges are even without sampling."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


#: df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation.
settled = kept


#: Rows of a batch that goes to Python where its rows are whole texts.
TEXT_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What is planned and run meanwhile sends batches of so many rows to Python: both sides hold a batch, and a batch of texts is as large as they are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def given_back() -> None:
    """Memory that a Python worker has freed goes back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; what it held is given back when it ends."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        given_back()

    return wrapped


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run, for applyInArrow; what it held is given back after each group."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        given_back()
        return out

    return wrapped
