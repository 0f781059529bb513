"""Reading, indexes on disk, logs, streams and the command line."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from runeframe import cli
from runeframe.operators import search
from runeframe.plans.telemetry import timed
from runeframe.sources import corpus, logs
from runeframe.sources.store import Index
from runeframe.streaming.append import append_stream
from tests.test_text import patterns, random_texts, texts


def test_reading_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("line\nother é")
    (tmp_path / "t" / "b.txt").write_text("b")
    assert sorted(r.text for r in corpus.read_texts(spark, str(tmp_path / "t")).collect()) == ["b", "line\nother é"]
    assert sorted(r.text for r in corpus.read_texts(spark, str(tmp_path / "t"), limit=3).collect()) == ["b", "lin"]
    for size, code in ((1, "B"), (2, "H"), (4, "I"), (8, "Q")):
        (tmp_path / f"n{size}").write_bytes(struct.pack(f"<5{code}", 1, 2, 3, 250, 0))
        assert [r.sym for r in corpus.read_sequences(spark, str(tmp_path / f"n{size}"), size).orderBy("pos").collect()] == [1, 2, 3, 250, 0]
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a multiple"):
        corpus.read_sequences(spark, str(tmp_path / "odd"), 2).collect()
    with pytest.raises(ValueError):
        corpus.read_sequences(spark, str(tmp_path / "odd"), 3)


def test_pattern_files(spark, tmp_path):
    corpus.write_patterns(patterns(spark, ["abc", "xyz"]), str(tmp_path / "p"), swaps=2)
    assert sorted(map(tuple, corpus.read_patterns(spark, str(tmp_path / "p")).collect())) == [(0, "abc", 2, 3, 2), (1, "xyz", 2, 3, 2)]
    with pytest.raises(ValueError):
        corpus.write_patterns(patterns(spark, ["a", "bb"]), str(tmp_path / "q"))


def test_index(spark, tmp_path):
    values = [t for t in random_texts() if t and len(t) > 8]
    docs = texts(spark, values)
    asked = patterns(spark, ["a", "ab", "zz", "é\U0001f600", "x" * 39 + "y"] + [t[3:40] for t in values])
    index = Index(spark, str(tmp_path), b=4, fac_dens=2, key=6).build(docs)
    expected = sorted(map(tuple, search.locate(docs, asked).collect()))
    assert sorted(map(tuple, index.locate(asked).collect())) == expected
    assert sorted(map(tuple, index.count(asked).collect())) == sorted(map(tuple, search.count(docs, asked).collect()))
    steps = {(r.pattern_id, r.doc_id): r.occurrences for r in index.count_with_steps(asked).collect() if r.occurrences}
    counts = {}
    for p, d, _ in expected:
        counts[p, d] = counts.get((p, d), 0) + 1
    assert steps == counts
    assert index.report(asked).first().queries > 0
    modified = {t: spark._jvm.java.io.File(f"{index.path}/{t}/_SUCCESS").lastModified() for t in ("corpus", "suffixes", "blocks")}
    Index(spark, str(tmp_path), b=4, fac_dens=2, key=6).build(docs)
    assert modified == {t: spark._jvm.java.io.File(f"{index.path}/{t}/_SUCCESS").lastModified() for t in modified}
    tree = json.loads(index.write_structure())
    assert tree["size"] == sum(c["size"] for c in tree["children"]) > 0 and index.write_structure("r").startswith('list(name="index"')
    plan = index.locate(patterns(spark, ["ab"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(key,ab)" in plan
    index.save_manifest()
    assert index.delete() and not index.has("suffixes")


def test_logs(spark):
    lines = ["# n = 5", "noise", "# name = a", "# t = 1.5", "#  n =  7 ", "# name = b"]
    frame = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    rows = logs.numeric(logs.records(frame, ["n", "name", "t"]), ["n", "name", "t"]).orderBy("record").collect()
    assert [(r.n, r.name, r.t) for r in rows] == [(5.0, "a", 1.5), (7.0, "b", None)]
    runs = spark.createDataFrame([(0, p, v) for p, v in ((0, 1.0), (0, 3.0), (1, 5.0), (2, 4.0))], "dens long, phase long, ms double")
    assert [(r["mean"], r.cost) for r in logs.phase_costs(runs, ["dens"], "phase", "ms").orderBy("phase").collect()] == [(2.0, 2.0), (5.0, 3.0), (4.0, -1.0)]
    assert tuple(logs.mean_table(runs, "dens", "phase", [0, 1], "ms", 1000).first()) == (0, 2.0, 5.0)


def test_appending_a_stream(spark, tmp_path):
    for i, part in enumerate((["abab"], ["xaby", None])):
        texts(spark, part).withColumn("doc_id", F.col("doc_id") + 10 * i).write.mode("append").parquet(str(tmp_path / "in"))
        append_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "marks"), key=3).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/suffixes"))
    assert rows.count() == 8 and rows.where("key like 'ab%'").count() == 3


def test_command_line(spark, tmp_path, capsys):
    texts(spark, ["mississippi", "barbarabar"]).write.parquet(str(tmp_path / "docs"))
    common = [str(tmp_path / "docs"), str(tmp_path / "index"), "-b", "3", "--pattern-len", "2", "--pattern-number", "9", "--patterns", str(tmp_path / "patterns")]
    for mode in ("generate-patterns", "generate-index", "mem-info", "output-statistics", "greedy", "reconstruct", "factor-occ-freq", "output-factors", "benchmark", "benchmark-int", "delete"):
        assert cli.main([*common, f"--{mode}"], spark) == 0
    said = capsys.readouterr().out
    assert "mississippi" in said and "# real_ms" in said and "True" in said


def test_readings_are_logs(spark):
    reading = timed("ten", spark.range(10))
    assert reading.rows == 10 and reading.real_ms > 0
    frame = spark.createDataFrame([("f", i, x) for i, x in enumerate(reading.lines())], "file string, line_no long, line string")
    assert logs.records(frame, ["name", "rows"]).first().rows == "10"
