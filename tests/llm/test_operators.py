"""Operators against plain versions, over rows with everything that is odd and over empty tables."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runeframe.llm import bpe, components, hashing, line_dedup, mixing, ngram_join, pii, quality, queries, sharding, substring_dedup, token_counts, topk
from runeframe.llm.common import n_words, running
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).cache()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in brute.odd_rows()}


def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def test_mixing(spark, docs):
    rows = mixing.mix_sources(docs, carry=[]).collect()
    size, source = {r[0]: len(brute.words(r[1])) for r in brute.odd_rows()}, {r[0]: r[3] for r in brute.odd_rows()}
    sizes = collections.Counter()
    for key, n in size.items():
        sizes[source[key]] += n
    targets, taken = brute.targets(sizes), collections.Counter()
    assert len(rows) == len(size)
    for r in rows:
        assert r.size == size[r.id] and r.source == source[r.id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(0 <= targets[s] - taken[s] < 1 + 1e-6 for s in targets)
    again = mixing.mix_sources(docs.repartition(7), carry=[]).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert {s: n for s, n in mixed.groupBy("source").agg(F.sum(n_words(F.col("text")))).collect()} == {s: n for s, n in taken.items() if n}
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.mixed_rows(empty(spark)).count() == 0


def test_targets_are_those_of_the_rounds(spark):
    rnd = random.Random(5)
    for _ in range(4):
        sizes = {f"s{i:02}": rnd.choice([0, 1, 5, 1000, 10**6]) for i in range(rnd.randint(1, 9))} | {None: rnd.randint(0, 50)}
        frame = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_src boolean, src string, source_size long")
        got = {None if r.no_src else r.src: r.target for r in mixing.source_targets(frame).collect()}
        assert got == pytest.approx(brute.targets(sizes))


def test_sharding(spark, docs, texts, tmp_path):
    for n in (1, 5, 40):
        got = sorted(((r.id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.stratified_shards(docs, n, carry=[]).collect()), key=lambda r: r[0])
        assert got == brute.shards(brute.odd_rows(), n)
        counts = collections.Counter(r[3] for r in got)
        assert max(counts[s] for s in range(n)) - min(counts[s] for s in range(n)) <= 1
    mix = collections.Counter((r.shard, r.row.source) for r in sharding.stratified_shards(docs, 2).collect())
    assert all(abs(mix[0, s] - mix[1, s]) <= 1 for s in (None, "s1", "s2", "s\U0001f600", ""))
    assert sharding.stratified_shards(empty(spark), 4).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(texts)


def test_pii(spark, docs, texts):
    rows = {r.id: r for r in pii.find_pii(docs).collect()}
    for key, text in texts.items():
        assert [(s.kind, s.start, s.end) for s in rows[key].spans if s.base] == brute.pii(text), text
        assert all((text or "")[s.start : s.end] == s.match for s in rows[key].spans)
    assert [s.match for r in rows.values() for s in r.spans if s.kind == "iban" and r.id < 100] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    masked = {r.id: r.masked for r in pii.masked(pii.find_pii(docs)).collect()}
    assert masked[19] == "IBAN [iban] bank [iban]" and masked[0] == "" and masked[4] == texts[4]
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_finds_ibans_before_anything(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    texts = {
        f"{de} Bank": [de], f"{de} BIC COBADEFF": [de], f"{de} 5 items": [de], f"{no} A": [no], f"{de} {gb} {no} 12 X": [de, gb, no], f"AT20 {de} OK": [de], f"{de.replace(' ', '')} BIC": [de.replace(" ", "")],
        f"{de}A BIC": [], "DE88 3704 0044 0532 0130 00 BIC": [], f"x{de}": [], "ZZ18 1234 5678 9012 34 AB": ["ZZ18 1234 5678 9012 34"], "AB12 " * 3000 + f"{de} Z": [de], "\U0001f600 " + de + " Z": [de],
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r for r in pii.find_pii(frame).collect()}
    for i, (text, expected) in enumerate(texts.items()):
        spans = [s for s in got[i].spans if s.kind == "iban"]
        assert [s.match for s in spans] == expected and all(text[s.start : s.end] == s.match for s in spans), text[-60:]


def test_pii_scores_by_context(spark):
    texts = {
        "call +1 (743) 555-3824 now": {"phone": 90}, "no. +1 (743) 555-3824 now": {"phone": 60}, "e.g. the sample +1 (743) 555-3824": {"phone": 40},
        "SSN: 536-90-4399.": {"ssn": 70}, "part no. 536-90-4399": {}, "SSN 666-90-4399, 536-00-4399, 536-90-0000": {}, "example SSN: 536-90-4399": {},
        "She was born on 1984-02-29 in Spring": {"birth": 60}, "released on 1984-02-29": {}, "born 1984-13-01": {},
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x': {"secret": 70}, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962": {}, "my password hunter2hunter2hunter2": {"secret": 70}, "the key internationalizationally": {},
        "a sample account DE89370400440532013000": {"iban": 80}, "sample DE89370400440532013000": {}, "pay DE89370400440532013000": {"iban": 70},
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: {s.kind: s.score for s in r.spans} for r in pii.find_pii(frame).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_running_sums(spark):
    rnd = random.Random(7)
    lists = [[rnd.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 1000)]
    frame = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    sums, tops = zip(*frame.select(running(F.col("x"), lambda a, b: a + b), running(F.col("x"), lambda a, b: F.greatest(a, b))).collect(), strict=True)
    assert [list(x) for x in sums] == [list(itertools.accumulate(x)) for x in lists] and [list(x) for x in tops] == [list(itertools.accumulate(x, max)) for x in lists]


def test_masking_overlaps(spark):
    frame = spark.createDataFrame([(1, "mail a@10.0.0.1.example.org and b@c.de"), (2, "x" * 3 + " 1.2.3.4 " * 200), (3, None)], "doc_id long, text string")
    got = {r.id: r.masked for r in pii.masked(pii.find_pii(frame)).collect()}
    assert got == {1: "mail [email] and [email]", 2: "xxx" + " [ip] " * 200, 3: ""}


def test_quality(spark, docs, texts):
    for r in quality.quality_rules(docs).collect():
        n, chars, symbols, dup, repeated = brute.quality(texts[r.id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated), texts[r.id]
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(empty(spark)).count() == 0


def test_quality_keeps_good_and_drops_bad(spark, small):
    judged = quality.quality_rules(spark.read.parquet(f"{small}/documents.parquet")).join(spark.read.parquet(f"{small}/labels.parquet").withColumnRenamed("doc_id", "id"), "id")
    assert judged.where("quality = 1 and not base_failed and not kept").count() == 0
    assert judged.where("quality = 0 and kept").count() <= 1


@pytest.mark.parametrize("n, percent, limits", [(4, 85, {}), (5, 80, {"GROUP_ROWS": 7, "FEW_PAIRS": 0}), (1, 60, {"LEADERS": 1, "ROUNDS": 1, "GROUP_ROWS": 20, "BATCH": 3000}), (2, 100, {"FEW_PAIRS": 0, "BATCH": 500, "ROUNDS": 0})])
def test_ngram_join(spark, docs, monkeypatch, n, percent, limits):
    """Groups dealt to parts, joins without broadcasts, many batches, and ends after few rounds among them."""
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(n)
    base = [f"t{rnd.randint(0, 400)}" for _ in range(200)]
    extra = []
    for i in range(120):  # a large group of near copies, and chains of them
        w = list(base)
        for _ in range(rnd.choice([0, 1, 3, 8, 20])):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 50)}"
        extra.append((1000 + i, " ".join(w[: rnd.choice([200, 190, 150])]), "en", "s1", 1, None, None, None, None, None, None))
    frame = docs.unionByName(spark.createDataFrame(extra, brute.SCHEMA))
    expected = brute.near_components([(r[0], r[1]) for r in [*brute.odd_rows(), *extra]], n, percent)
    assert sorted(map(tuple, ngram_join.near_duplicates(frame, n=n, percent=percent).collect())) == sorted(expected)
    kept = ngram_join.one_of_each(frame, n=n, percent=percent)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(key for key, _, c in expected if key == c)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    repeated = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_duplicates(repeated).collect()} == {3}


def test_one_of_each_with_repeated_and_null_ids(spark):
    same, other, near = "a b c d e", "p q r s t", " ".join(f"w{i}" for i in range(80))
    rows = [(3, same, 1), (3, same, 1), (None, same, 1), (7, same, 1), (7, other, 2), (None, "k l m n o", 3), (None, "k l m n o", 3), (3, near, 4), (5, near + " x", 4), (5, other + " u v w", 5), (9, "", 6), (9, "", 6), (None, None, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class int")
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(3, same, 1), (7, other, 2), (None, "k l m n o", 3), (3, near, 4), (5, other + " u v w", 5), (9, "", 6), (9, "", 6), (None, None, 6)]))


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (300, 300)] + [(rnd.randint(400, 420), rnd.randint(400, 420)) for _ in range(15)]
    parent = {x: x for link in links for x in link}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent}


def test_substring_dedup(spark, docs):
    rnd = random.Random(9)
    passages = [[f"p{rnd.randint(0, 30)}" for _ in range(rnd.randint(19, 70))] for _ in range(6)]
    extra = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 15))] + rnd.choice(passages)
        extra.append((-30 + i if i != 30 else 999, " ".join(w), "en", None, 1, None, None, None, None, None, None))
    frame = docs.unionByName(spark.createDataFrame(extra, brute.SCHEMA))
    rows = [*((r[0], r[1]) for r in brute.odd_rows()), *((r[0], r[1]) for r in extra)]
    keys = collections.Counter(k for k, _ in rows)
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(frame).collect() if keys[r.id] == 1}
    expected = {key: (n, gone, kept) for key, n, gone, kept in brute.repeats(rows) if keys[key] == 1}
    assert got == expected
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_substring_dedup_of_repeated_and_unnamed_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    assert sorted((str(r.id), r.n_removed) for r in substring_dedup.remove_repeats(frame).collect()) == [("1", 0), ("1", 0), ("2", 25), ("None", 25)]


@pytest.mark.parametrize("few, salt", [(10**6, 10**6), (0, 10**6), (0, 3)])
def test_line_dedup(spark, docs, monkeypatch, few, salt):
    monkeypatch.setattr(line_dedup, "FEW_LINES", few)
    monkeypatch.setattr(line_dedup, "PAGES_A_SALT", salt)
    extra = [(2000 + i, f"Top of the page\n\n own {i}\nTop of the page\nrare {i % 3}", "en", "site", 1, None, None, None, None, None, None) for i in range(12)]
    frame = docs.unionByName(spark.createDataFrame(extra, brute.SCHEMA))
    rows = [(r[3], (r[1] or "").split("\n")) for r in [*brute.odd_rows(), *extra]]
    for ratio in (0.06, 0.5, 0.0):
        got = collections.Counter(tuple(r.kept) for r in line_dedup.drop_boilerplate(frame, F.col("source"), line_dedup.text_lines(F.col("text")), ratio=ratio).collect())
        assert got == collections.Counter(map(tuple, brute.boilerplate(rows, ratio)))
    kept = line_dedup.without_boilerplate(frame)
    clash = frame.withColumnRenamed("words", "boilerplate").withColumnRenamed("key", "salt").withColumnRenamed("a.b", "host")
    assert line_dedup.without_boilerplate(clash).where("boilerplate = 'w' and salt = 'k' and host = 'dot'").count() == frame.where("words = 'w'").count()
    assert kept.columns == frame.columns and kept.where("doc_id = 2001").first().text == "\n own 1\nrare 1"
    small = spark.createDataFrame([(i, f"Menu\nown {i}", "s") for i in range(2)] + [(9, "Menu", "one page")], "doc_id long, text string, source string")
    assert sorted(r.text for r in line_dedup.without_boilerplate(small).collect()) == ["Menu", "own 0", "own 1"]
    assert line_dedup.without_boilerplate(empty(spark)).count() == 0
    hosts = spark.createDataFrame([("HTTP://A.b:80/x",), ("ftp://c?d",), ("nothing",), (None,)], "url string").select(line_dedup.host_of(F.col("url")))
    assert [r[0] for r in hosts.collect()] == ["a.b", "c", None, None]


def test_bpe(spark, docs, texts, monkeypatch):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN)
    for r in coded.collect():
        assert r.ids == library.encode_ordinary(texts[r.id] or "") and bytes(r.decoded).decode() == (texts[r.id] or "")
    back = bpe.decode_documents(coded, VOCABULARY, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (texts[r.id] or "") for r in back.collect())
    assert bpe.encode_documents(empty(spark), VOCABULARY, public_tokenizers.PATTERN).count() == 0 and bpe.decode_documents(coded.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    for bad in (-1, 10**6):
        with pytest.raises(Exception, match="not in the vocabulary"):
            bpe.decode_documents(spark.createDataFrame([(1, [bad])], "id long, ids array<int>"), VOCABULARY, public_tokenizers.PATTERN).collect()

    # Long texts of all sorts, some repeated, in chunks so small that each has many; runs longer than an overlap among them
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr(bpe, "OVERLAP", 12)
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    rnd, long = random.Random(1), {}
    for i in range(300):
        odd = ["a" * 30, " " * 30] if i % 3 == 0 else []
        long[i] = "".join(rnd.choice(["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "!", " x", "😀", *odd]) for _ in range(rnd.randint(0, 400)))
    rows = [(i, t, None) for i, t in long.items()] + [(None, long[7], None), (5, long[5], None), (5, long[5], None), (8, long[9], None), (400, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = bpe.encode_documents(frame, VOCABULARY, public_tokenizers.PATTERN).collect()
    expected = [(key, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for key, t, _ in rows]
    assert sorted(map(str, ((r.id, tuple(r.ids), bytes(r.decoded)) for r in got))) == sorted(map(str, expected))


@pytest.mark.parametrize("fold_after", [2, 100])
def test_token_counts(spark, docs, tmp_path, monkeypatch, fold_after):
    monkeypatch.setattr(token_counts, "FOLD_AFTER", fold_after)
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0 and rollup.committed().count() == 0
    n, double = n_words(F.col("text")), n_words(F.col("text")) * 2
    assert rollup.commit("a/b=c d", token_counts.inserted(docs, "v1", n))
    once = sorted(map(str, rollup.totals().collect()))
    assert not rollup.commit("a/b=c d", token_counts.inserted(docs, "v1", n))
    assert sorted(map(str, rollup.totals().collect())) == once
    assert rollup.commit("b", token_counts.deleted(docs.where("doc_id >= 100"), "v1", n), token_counts.revised(docs.where("doc_id < 100"), ("v1", n), ("v2", double)))
    assert rollup.commit("", token_counts.inserted(empty(spark), "v3", n)) and not rollup.commit("a/b=c d", token_counts.inserted(docs, "v1", n))
    expected = collections.defaultdict(lambda: [0, 0])
    for r in brute.odd_rows():
        if r[0] < 100:
            expected[r[3], r[2], "v2"][0] += 1
            expected[r[3], r[2], "v2"][1] += 2 * len(brute.words(r[1]))
    for _ in range(2):
        assert {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in rollup.totals().collect()} == dict(expected)
        assert sorted(r[0] for r in rollup.committed().collect()) == ["", "a/b=c d", "b"]
        rollup.fold()
        rollup.clean()
    assert len(list((tmp_path / "rollup" / "data").iterdir())) == 2
    assert rollup.delete() and rollup.totals().count() == 0


def test_token_counts_after_commits_that_died(spark, docs, tmp_path, monkeypatch):
    rollup, n = token_counts.TokenRollup(spark, str(tmp_path / "rollup")), F.lit(3)
    rollup.commit("a", token_counts.inserted(docs, "v", n))
    before = sorted(map(str, rollup.totals().collect()))
    with monkeypatch.context() as m:  # dies with its data written and its manifest not
        m.setattr(token_counts.TokenRollup, "_publish", lambda self, number, state: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            rollup.commit("b", token_counts.inserted(docs, "v", n))
    assert sorted(map(str, rollup.totals().collect())) == before
    (tmp_path / "rollup" / "manifests" / "2").write_text('{"snapshot": nu')  # dies within its manifest
    assert sorted(map(str, rollup.totals().collect())) == before
    assert rollup.commit("b", token_counts.inserted(docs, "v", n)) and rollup.totals().agg(F.sum("docs")).first()[0] == 2 * docs.count()
    publish = token_counts.TokenRollup._publish

    def late(self, number, state):  # another writer comes first
        monkeypatch.setattr(token_counts.TokenRollup, "_publish", publish)
        token_counts.TokenRollup(spark, str(tmp_path / "rollup")).commit("d", token_counts.inserted(docs, "v", n))
        return publish(self, number, state)

    monkeypatch.setattr(token_counts.TokenRollup, "_publish", late)
    assert rollup.commit("c", token_counts.inserted(docs, "v", n)) and rollup.totals().agg(F.sum("docs")).first()[0] == 4 * docs.count()
    rollup.clean()
    assert len(list((tmp_path / "rollup" / "data").iterdir())) == 4


def test_token_counts_of_the_query_are_tokens(spark, small, monkeypatch):
    commits, commit = [], token_counts.TokenRollup.commit
    monkeypatch.setattr(token_counts.TokenRollup, "commit", lambda self, batch, *deltas: (commits.append((batch, deltas[0])), commit(self, batch, *deltas))[1])
    found = queries.op10_token_counts(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tokens = bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN).agg(F.sum(F.size("ids"))).first()[0]
    inserted = dict(commits[:1])["insert"]
    assert inserted.agg(F.sum("tokens"), F.sum("docs")).first() == (tokens, docs.count())
    assert {r.version for r in found.collect()} == {"pieces-2"}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string")


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "GROUP", 4)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(5, 12))
    x = np.floor(256 * (centres[rnd.integers(0, 5, 400)] + 0.05 * rnd.normal(size=(400, 12))).astype("f4").astype("f8"))
    x[100:180] = x[100]  # one very common vector
    x[300:] = np.floor(256 * rnd.normal(size=(100, 12)))
    rows = [(i, (v / 256).tolist(), 0, "x") for i, v in enumerate(x)]
    odd = [(1000, None, 1, None), (1001, [1.0, None] * 6, 1, None), (1002, [float("nan")] * 12, 1, None), (1003, [], 1, None), (None, [1.0] * 12, 1, None), (1050, [float("inf")] * 12, 1, None)]
    got = topk.exact_topk(vectors(spark, rows + odd), k=5, is_query=lambda c: c % 50 == 0)
    expected = []
    for q in range(0, 400, 50):
        order = sorted((-int(x[j] @ x[q]), j) for j in range(400) if j != q)[:5]
        expected += [(q, r, j, -s) for r, (s, j) in enumerate(order, 1)]
    assert sorted(map(tuple, got.collect())) == expected


def test_cover_trees_cover():
    rnd = np.random.default_rng(2)
    clusters = np.floor(rnd.normal(size=(20, 6)) * 900)[rnd.integers(0, 20, 3000)] + np.floor(rnd.normal(size=(3000, 6)) * 40)
    for x in (clusters, np.floor(rnd.normal(size=(3000, 40)) * 100), np.zeros((500, 3)), np.array([[1.0, 2.0]]), np.floor(10.0 ** rnd.uniform(0, 30, (400, 2)))):
        perm, tree = topk.cover_tree(x)
        y = x[perm]
        assert sorted(perm.tolist()) == list(range(len(x))) and (tree.lo[0], tree.hi[0], tree.skip[0]) == (0, len(x), len(tree.lo))
        for i in range(len(tree.lo)):
            assert topk.distances(y[tree.lo[i] : tree.hi[i]], y[tree.centre[i]]).max() <= tree.radius[i]
            down = tree.children(i)
            if down:
                assert [tree.lo[c] for c in down] + [tree.hi[i]] == [tree.lo[i], *(tree.hi[c] for c in down)]
    assert len(topk.cover_tree(clusters)[1].lo) > 20
    assert (topk.Tree.unpack(tree.pack()).radius == tree.radius).all() and (topk.Tree.unpack(tree.pack()).skip == tree.skip).all()


def test_topk_of_few_and_of_large(spark):
    few = vectors(spark, [(0, [0.5, -0.5], 0, ""), (1, [0.25], 0, ""), (2, [1e30, 0.0], 0, "")])
    got = sorted(map(tuple, topk.exact_topk(few, is_query=lambda c: c < 2).collect()))
    assert got == [(0, 1, 2, 2**63 - 1), (0, 2, 1, 128 * 64), (1, 1, 2, 2**63 - 1), (1, 2, 0, 64 * 128)]
    assert topk.exact_topk(vectors(spark, []), is_query=lambda c: c < 2).count() == 0
    assert topk.exact_topk(few, is_query=lambda c: c > 10).count() == 0


def test_word_hashes_follow_words():
    texts = [b"", b" a  b\tc ", b"a b c", b"x" * 100 + b" a", "é \xa0 ü".encode(), b"\x1c \x0b\x0c z"]
    hashes, counts = hashing.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    by_word = {}
    for w, h in zip((w for t in texts for w in t.split()), hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert len(hashing.grams(hashes[:2], 4)) == 0 and hashing.grams(hashes[:3], 3)[0] == hashing.grams(hashes[3:6], 3)[0]


def test_blobs_come_back():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 1000):
        columns = [rnd.integers(0, 2**b, n, dtype=np.uint64) for b in (1, 9, 48, 63)]
        assert all((a == b).all() for a, b in zip(hashing.unpack(hashing.pack(*columns)), columns, strict=True))


def test_no_operator_reads_by_name_it_made_up(docs):
    """Columns of the input keep their values though they are named as helpers are."""
    kept = quality.keep_good(docs).collect()
    assert kept and all(r["a.b"] in ("dot", None) and r["row"] in ("r", None) and r["words"] in ("w", None) for r in kept)
    assert re.match("doc_id", docs.columns[0])
