"""Global orders by ranges, hashes of substrings, pattern workloads, and streams with state."""

import collections
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from runeframe.functions.text import rolling_hashes
from runeframe.operators import arrays, mining, search
from runeframe.plans import scratch
from runeframe.streaming import windows
from tests.test_text import patterns, texts


def test_rows_in_a_global_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 50), i, rnd.randint(0, 9)) for i in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int, w long").repartition(7)
    got = sorted((r.nth, r.a, r.b, r.before) for r in scratch.in_order(frame, "a", "b", total={"before": F.col("w")}).collect())
    expected, so_far = [], 0
    for nth, (a, b, w) in enumerate(sorted(rows)):
        expected.append((nth, a, b, so_far))
        so_far += w
    assert got == expected and scratch.in_order(frame.limit(0), "a").count() == 0


def test_shared_folder_is_named_on_a_cluster(monkeypatch):
    class Session:
        def __init__(self, master, folder):
            self.conf, self.sparkContext = type("C", (), {"get": lambda self, key, default: folder})(), type("S", (), {"master": master})()

    assert scratch.shared_folder(Session("spark://m:7077", "s3://b/x")) == "s3://b/x" and scratch.shared_folder(Session("local[2]", None))
    for master in ("spark://m:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch.shared_folder(Session(master, None))


def test_rolling_hashes():
    codes = np.random.default_rng(1).integers(97, 99, 2000)
    text = "".join(map(chr, codes))
    for k, low, high in rolling_hashes(codes, (1, 7, 40, 3000)):
        names = collections.defaultdict(set)
        for i, h in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            names[text[i : i + k]].add(h)
        assert len(low) == max(0, len(text) - k + 1) and all(len(x) == 1 for x in names.values()) and len(set.union(set(), *names.values())) == len(names)


@pytest.mark.parametrize("part", [30, 10**6])
def test_grid_of_substrings(spark, monkeypatch, part):
    monkeypatch.setattr(mining, "PART", part)
    rnd, values = random.Random(5), []
    for _ in range(30):
        values.append("".join(rnd.choice("ab\U0001f600") for _ in range(rnd.randint(0, 120))))
    count = collections.Counter((k, t[i : i + k]) for t in values for k in (2, 5) for i in range(len(t) - k + 1))
    ranges = ((1, 1), (2, 10), (100, 10**6))
    cell = {(k, a, b): {g: n for (kk, g), n in count.items() if kk == k and a <= n <= b} for k in (2, 5) for a, b in ranges}
    assert {(r.k, r.least, r.most): r.candidates for r in mining.kgram_grid(texts(spark, values), (2, 5), ranges).collect()} == {c: len(x) for c, x in cell.items() if x}
    got = collections.defaultdict(dict)
    for r in mining.grid_patterns(texts(spark, values), 7, (2, 5), ranges).collect():
        got[r.k, r.least, r.most][r.pattern] = r.occ
    assert all(len(x) == min(7, len(cell[c])) and all(cell[c][p] == n for p, n in x.items()) for c, x in got.items()) and len(got) == sum(bool(x) for x in cell.values())


def test_large_batches_are_joined(spark, monkeypatch):
    docs, asked = texts(spark, ["abracadabra", "", None, "cabra\nabra"]), patterns(spark, ["abra", "a", "", "bra\nabra", "x", "abra"])
    near = sorted(map(tuple, search.occurrences(docs, asked).collect())), sorted(map(tuple, search.count(docs, asked).collect())), sorted(map(tuple, search.in_context(docs, asked, 2, 3, 2).collect()))
    monkeypatch.setattr(search, "ahocorasick", None)
    assert near == (sorted(map(tuple, search.occurrences(docs, asked).collect())), sorted(map(tuple, search.count(docs, asked).collect())), sorted(map(tuple, search.in_context(docs, asked, 2, 3, 2).collect())))


def test_bad_neighbours_are_found(spark):
    values = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 3, 4, 4, 1, 2])], "key string, idx long, val int")
    good = arrays.smaller_neighbours(values, ["key"])
    assert arrays.bad_neighbours(values, good, ["key"]).count() == 0
    bad = good.withColumn("psv", F.when(F.col("idx") == 3, F.lit(2)).when(F.col("idx") != 5, F.col("psv")))
    assert sorted(r.query.idx for r in arrays.bad_neighbours(values, bad, ["key"]).collect()) == [3, 5]


def test_streams_keep_state_over_batches(spark, tmp_path):
    schema = "user long, n long, kind string, ts timestamp"
    at = lambda h: datetime(2024, 1, 1, h)

    def feed(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        windows.store_latest(windows.window_counts(source, "1 hour", "2 hours", ["kind"]), [], str(tmp_path / "w"), str(tmp_path / "ws")).awaitTermination()
        windows.store_latest(windows.running_runs(source, "user", "kind", "n"), [], str(tmp_path / "r"), str(tmp_path / "rs")).awaitTermination()
        counts = windows.latest(spark.read.parquet(str(tmp_path / "w")), ["kind", "start"]).collect()
        runs = windows.latest(spark.read.parquet(str(tmp_path / "r")), ["user"]).collect()
        return {(r.kind, r.start.hour): r.n for r in counts}, {r.user: (r.runs, r.length, r.last) for r in runs}

    feed("1", [(1, 1, "a", at(1)), (1, 2, "a", at(1)), (2, 3, "b", at(9))])
    assert run() == ({("a", 1): 2, ("b", 9): 1}, {1: (1, 2, "a"), 2: (1, 1, "b")})
    # One event within the delay, one behind it: its window is closed
    feed("2", [(1, 4, "a", at(8)), (1, 5, "a", at(1)), (2, 6, "a", at(9))])
    assert run() == ({("a", 1): 2, ("b", 9): 1, ("a", 8): 1, ("a", 9): 1}, {1: (1, 4, "a"), 2: (2, 1, "a")})
