"""Command line: build an index of a table of texts, query it, measure it."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.operators import blocks as block_ops
from runeframe.operators import mining, search
from runeframe.sources.corpus import read_table, read_texts, write_patterns
from runeframe.sources.store import Index


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="runeframe", description=__doc__)
    p.add_argument("input", help="Parquet table with columns doc_id and text, or a folder of text files with --files")
    p.add_argument("index", help="folder of indexes")
    p.add_argument("--files", action="store_true")
    p.add_argument("-b", "--threshold", type=int, default=4096, help="suffixes of a block at most")
    p.add_argument("-f", "--fac-dens", type=int, default=1, help="every n-th border of a factor is kept; 0: no factors")
    p.add_argument("--pattern-len", type=int, default=20)
    p.add_argument("--pattern-number", type=int, default=100)
    modes = p.add_mutually_exclusive_group(required=True)
    for mode in ("generate-index", "interactive", "delete", "mem-info", "output-statistics", "greedy", "reconstruct", "factor-occ-freq", "output-factors", "generate-patterns", "benchmark", "benchmark-int"):
        modes.add_argument(f"--{mode}", action="store_const", const=mode, dest="mode")
    p.add_argument("--patterns", help="table of patterns, written or read")
    p.add_argument("--swaps", type=int, default=0)
    return p


def one_pattern(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.createDataFrame([(0, pattern)], "pattern_id long, pattern string")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("runeframe").getOrCreate()
    docs = read_texts(spark, args.input) if args.files else read_table(spark, args.input, "doc_id", "text")
    index = Index(spark, args.index, args.threshold, args.fac_dens)
    if args.mode == "delete":
        print(index.delete())
        return 0
    if args.mode == "generate-patterns":
        write_patterns(mining.random_patterns(docs, args.pattern_number, args.pattern_len, args.swaps), args.patterns, args.swaps)
        return 0
    index.build(docs)
    if args.mode == "generate-index":
        index.save_manifest()
    elif args.mode == "mem-info":
        print(index.write_structure())
    elif args.mode == "output-statistics":
        block_ops.index_statistics(index.read("blocks")).show()
    elif args.mode == "greedy":
        block_ops.parse_report(index.read("factors"), index.read("blocks")).show()
    elif args.mode == "reconstruct":
        block_ops.reconstruct(index.read("factors"), index.read("blocks")).show(truncate=False)
    elif args.mode == "factor-occ-freq":
        block_ops.factor_frequencies(index.read("factors"), index.read("blocks")).orderBy("freq").show()
    elif args.mode == "output-factors":
        index.read("blocks").select("doc_id", "block", "prefix").orderBy("doc_id", "block").show(truncate=False)
    elif args.mode == "interactive":
        interactive(spark, index, docs)
    else:
        patterns, began = spark.read.parquet(args.patterns), time.time()
        if args.mode == "benchmark-int":
            index.report(patterns).show()
        else:
            index.count(patterns).agg(F.count(F.lit(1)).alias("patterns"), F.sum("occurrences").alias("occurrences"), F.count_if(F.col("occurrences") > 0).alias("found")).show()
        print(f"# real_ms = {1000 * (time.time() - began):.0f}")
    return 0


def interactive(spark: SparkSession, index: Index, docs: DataFrame) -> None:
    """Lines of input: 'c pattern' counts, 'l pattern' locates, 'k pattern' shows context; an empty line ends."""
    while line := input():
        what, _, pattern = line.partition(" ")
        asked = one_pattern(spark, pattern)
        if what == "c":
            index.count(asked).show()
        elif what == "l":
            index.locate(asked).orderBy("doc_id", "pos").show(1000)
        elif what == "k":
            search.in_context(docs, asked).show(truncate=False)
