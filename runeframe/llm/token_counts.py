"""Token counts as rollups that signed deltas maintain. DataFrame functions only.

A document's count under a tokenizer version is a fact that is inserted (+), deleted (-) or revised (- the old count,
+ the new). Totals by source, language and version are sums of those signed facts, so a batch is aggregated by itself, in
proportion to its own rows.

The rollup's state is a manifest: a snapshot of totals, and the batches committed since. A batch is written to a folder of its own, then a manifest of the next number
names it; a commit that dies before that has done nothing, and one that is repeated after it does nothing more. After FOLD_AFTER batches
they are folded into a new snapshot, so totals are read from one snapshot and a few batches however many there have been.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runeframe.llm.common import quoted

#: Version pieces-2: runs of letters and digits, and any other single character but white space.
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"
KEYS = ("source", "lang", "version")
SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])
#: Batches beside the snapshot before they are folded into it.
FOLD_AFTER = 16


def facts(docs: DataFrame, version: str, tokens: Column, sign: int = 1, *, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """A signed fact for each row of docs: source, lang, version, docs (the sign), tokens (sign times the count).

    tokens is a count for each row, of a text however long; null (of a null text, say) counts as 0, and its row as a document. Null sources and languages are values like any other;
    repeated rows count each; an empty table gives no facts; other columns, whatever their names, are not looked at.
    """
    count = F.coalesce(tokens, F.lit(0)).cast("long")
    return docs.select(
        quoted(source_col).cast("string").alias("source"), quoted(lang_col).cast("string").alias("lang"), F.lit(version).alias("version"), F.lit(sign).cast("long").alias("docs"), (count * sign).alias("tokens")
    )


def inserted(docs: DataFrame, version: str, tokens: Column, **options) -> DataFrame:
    """Facts of rows that are new; see facts()."""
    return facts(docs, version, tokens, 1, **options)


def deleted(docs: DataFrame, version: str, tokens: Column, **options) -> DataFrame:
    """Facts of rows that are gone, with the counts they were inserted with; see facts()."""
    return facts(docs, version, tokens, -1, **options)


def revised(docs: DataFrame, old: tuple[str, Column], new: tuple[str, Column], **options) -> DataFrame:
    """Facts that take back the old (version, count) of each row and add the new, from one pass over docs; nulls, repeated rows and other columns as in facts()."""
    both = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("sign"), F.lit(v).alias("version"), F.coalesce(t, F.lit(0)).cast("long").alias("n")) for s, (v, t) in ((-1, old), (1, new))]))
    source, lang = options.get("source_col", "source"), options.get("lang_col", "lang")
    each = docs.select(quoted(source).cast("string").alias("source"), quoted(lang).cast("string").alias("lang"), both.alias("fact"))
    return each.select("source", "lang", F.col("fact.version").alias("version"), F.col("fact.sign").alias("docs"), (F.col("fact.sign") * F.col("fact.n")).alias("tokens"))


def rolled_up(deltas: DataFrame) -> DataFrame:
    """Sums of signed facts by key; null is a key like any other. Partial sums are made before the shuffle, so a hot key sends a row from each task."""
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """Rollups under a path that Spark can read and write. One writer commits at a time; of two that try, the second starts again from the manifest of the first."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _place(self, name: str):
        place = self._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}")
        return place, place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    # ---- manifests

    def _numbers(self) -> list[int]:
        place, files = self._place("manifests")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(place) if s.getPath().getName().isdigit()) if files.exists(place) else []

    def _state(self) -> tuple[int, dict]:
        """The last manifest's number and what it says. One that was not written to its end counts for nothing."""
        last = 0
        for number in reversed(self._numbers()):
            last = max(last, number)
            place, files = self._place(f"manifests/{number}")
            stream = files.open(place)
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return last, json.loads(text)
            except ValueError:
                continue
        return last, {"snapshot": None, "folded": None, "batches": {}}

    def _publish(self, number: int, state: dict) -> bool:
        """Writes the manifest of a number, unless there is one already."""
        place, files = self._place(f"manifests/{number}")
        try:
            stream = files.create(place, False)
        except Py4JJavaError:
            if not files.exists(place):
                raise
            return False
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        return True

    # ---- batches

    def _known(self, batch: str, state: dict) -> bool:
        if batch in state["batches"]:
            return True
        folded = state["folded"] and self._spark.read.schema("batch string").parquet(f"{self._path}/{state['folded']}").where(F.col("batch") == batch)
        return bool(folded and folded.limit(1).count())

    def committed(self) -> DataFrame:
        """batch: the names of all batches that count."""
        _, state = self._state()
        recent = self._spark.createDataFrame([(b,) for b in state["batches"]], "batch string")
        return recent.unionByName(self._spark.read.schema("batch string").parquet(f"{self._path}/{state['folded']}")) if state["folded"] else recent

    def commit(self, batch: str, *deltas: DataFrame) -> bool:
        """Adds a batch of facts under any name; False, and nothing done, if a batch of that name counts already. An empty batch is a batch too."""
        if self._known(batch, self._state()[1]):
            return False
        folder = f"data/{uuid.uuid4().hex}"
        rolled_up(reduce(DataFrame.unionByName, deltas)).write.parquet(f"{self._path}/{folder}")
        while True:
            number, state = self._state()
            if self._known(batch, state):
                return False
            if self._publish(number + 1, state | {"batches": state["batches"] | {batch: folder}}):
                break
        if len(state["batches"]) + 1 >= FOLD_AFTER:
            self.fold()
        return True

    def fold(self) -> bool:
        """Writes a new snapshot of the totals and the names in them, and starts with no batches beside it. False if a commit came between; the old state holds then."""
        number, state = self._state()
        snapshot, folded = f"data/{uuid.uuid4().hex}", f"data/{uuid.uuid4().hex}"
        self._sum(state).write.parquet(f"{self._path}/{snapshot}")
        self.committed().write.parquet(f"{self._path}/{folded}")
        return self._publish(number + 1, {"snapshot": snapshot, "folded": folded, "batches": {}})

    def clean(self) -> int:
        """Deletes what the last manifest doesn't name: folders of commits that died, folded ones, older manifests. Not while others commit or read. How many went."""
        number, state = self._state()
        used, gone = {state["snapshot"], state["folded"], *state["batches"].values(), f"manifests/{number}"}, 0
        for top in ("data", "manifests"):
            place, files = self._place(top)
            for s in files.listStatus(place) if files.exists(place) else []:
                if f"{top}/{s.getPath().getName()}" not in used and (top == "data" or s.getPath().getName().isdigit()):
                    gone += files.delete(s.getPath(), True)
        return gone

    def delete(self) -> bool:
        """Deletes the rollup."""
        place, files = self._place("")
        return files.delete(place, True)

    # ---- totals

    def _sum(self, state: dict) -> DataFrame:
        parts = [p for p in (state["snapshot"], *state["batches"].values()) if p]
        if not parts:
            return self._spark.createDataFrame([], SCHEMA)
        return rolled_up(self._spark.read.schema(SCHEMA).parquet(*[f"{self._path}/{p}" for p in parts])).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over committed batches, without keys that came to nothing."""
        return self._sum(self._state()[1])
