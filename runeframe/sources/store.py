"""An index of suffixes on disk: Parquet tables and a manifest.

An index is a folder named by its parameters. Its suffixes are runs sorted by key, as the tasks that read the texts make them: no suffix travels. Keys and numbers are written as differences from those before,
and a look-up of few patterns reads only the pages whose keys can start with one. A stage whose table is complete is not built again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.operators import blocks as block_ops
from runeframe.operators.suffixes import count_up, index_rows, look_up

#: How sorted runs are written: strings as what differs from the one before.
SORTED = {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}


def fingerprint(docs: DataFrame) -> tuple:
    """Number of documents and sum of their hashes: the same for the same documents in any order."""
    return tuple(docs.where("text is not null").agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first())


def index_path(base: str, b: int, fac_dens: int, key: int) -> str:
    return f"{base.rstrip('/')}/b={b}/fac_dens={fac_dens}/key={key}"


@dataclass
class Index:
    spark: SparkSession
    base: str
    b: int = 4096
    fac_dens: int = 1
    key: int = 16

    @property
    def path(self) -> str:
        return index_path(self.base, self.b, self.fac_dens, self.key)

    def _place(self, table: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def has(self, table: str) -> bool:
        place, files, jvm = self._place(table)
        return files.exists(jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS"))

    def _write(self, table: str, df: DataFrame, **options: str) -> None:
        df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def build(self, docs: DataFrame, with_blocks: bool = True) -> Index:
        """Builds what isn't there yet from docs (doc_id, text): corpus, suffixes, and with_blocks the block tables; without factors if fac_dens is 0.

        An index of other documents at this place is replaced. One that a stream fills is not touched: that is an error.
        """
        place, files, jvm = self._place("suffixes")
        if files.exists(place) and not self.has("suffixes") and any(s.getPath().getName().startswith("batch=") for s in files.listStatus(place)):
            raise ValueError("a stream appends to this index")
        here = fingerprint(docs)
        if self.has("fingerprint") and tuple(self.read("fingerprint").first()) != here:
            self.delete()
        if not self.has("fingerprint"):
            self._write("fingerprint", self.spark.createDataFrame([here], "docs long, sum decimal(38,0)"))
        if not self.has("corpus"):
            self._write("corpus", docs.select("doc_id", "text").where("text is not null"))
        corpus = self.read("corpus")
        if not self.has("suffixes"):
            self._write("suffixes", index_rows(corpus, self.key), **SORTED)
        if with_blocks and not self.has("blocks"):
            if not self.has("block_table"):
                self._write("block_table", block_ops.block_table(corpus, self.b, parse=self.fac_dens > 0))
            table = self.read("block_table")
            if self.fac_dens:
                self._write("factors", block_ops.factors(table, fac_dens=self.fac_dens))
            self._write("blocks", block_ops.blocks(table, corpus))
        return self

    def locate(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, doc_id, pos through the index; patterns without symbols have no row here."""
        return look_up(self.read("suffixes"), self.read("corpus"), patterns, self.key)

    def count(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, occurrences: for every pattern with symbols, 0 included."""
        found = count_up(self.read("suffixes"), self.read("corpus"), patterns, self.key)
        return patterns.select("pattern_id").join(found, "pattern_id", "left").fillna(0, ["occurrences"])

    def count_with_steps(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, doc_id, occurrences, matched_depth, answered_in_blocks, block_size: a count by document and what of it the block prefixes alone answered."""
        near = block_ops.narrowed(self.read("blocks"), patterns)
        exact = self.locate(patterns.join(near.where("not answered").select("pattern_id").distinct(), "pattern_id", "left_semi")).groupBy("pattern_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        both = near.join(exact, ["pattern_id", "doc_id"], "left")
        occurrences = F.when(F.col("answered"), F.col("size")).otherwise(F.coalesce("n", F.lit(0)))
        return both.select("pattern_id", "doc_id", occurrences.alias("occurrences"), F.col("depth").alias("matched_depth"), F.col("answered").alias("answered_in_blocks"), F.col("size").alias("block_size"))

    def report(self, patterns: DataFrame) -> DataFrame:
        """One row over count_with_steps(): queries, mean depth, share answered by blocks, mean size of the blocks of others."""
        steps = self.count_with_steps(patterns)
        return steps.agg(F.count(F.lit(1)).alias("queries"), F.avg("matched_depth").alias("avg_depth"), F.avg(F.col("answered_in_blocks").cast("int")).alias("answered_ratio"), F.avg(F.when(~F.col("answered_in_blocks"), F.col("block_size"))).alias("avg_block"))

    def structure(self) -> dict:
        """The tables of the index and their bytes, as a tree."""
        children = []
        for table in ("fingerprint", "corpus", "suffixes", "block_table", "blocks", "factors"):
            place, files, _ = self._place(table)
            if files.exists(place):
                children.append({"name": table, "class": "parquet", "size": files.getContentSummary(place).getLength()})
        return {"name": "index", "class": f"b={self.b},fac_dens={self.fac_dens},key={self.key}", "size": sum(c["size"] for c in children), "children": children}

    def write_structure(self, kind: str = "json") -> str:
        """structure() as JSON, or as lines of R that make a nested list."""
        tree = self.structure()
        if kind == "json":
            return json.dumps(tree)

        def as_r(node: dict) -> str:
            below = "".join(f", {as_r(c)}" for c in node.get("children", []))
            return f'list(name="{node["name"]}", class="{node["class"]}", size={node["size"]}{below})'

        return as_r(tree)

    def save_manifest(self) -> None:
        self.spark.createDataFrame([(self.write_structure(),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")

    def delete(self) -> bool:
        place, files, jvm = self._place("")
        return files.delete(jvm.org.apache.hadoop.fs.Path(self.path), True)
