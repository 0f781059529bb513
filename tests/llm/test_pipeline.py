"""The pipeline's stages, each against a plain version on the rows that the one before it returned."""

import collections

import corpus_pipeline
import public_tokenizers

from runeframe.llm import line_dedup, quality
from tests.llm import brute


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append((before, docs))
    assert all(after.columns == columns for _, after in kept[:-1])

    before, after = kept[0]
    stay = {r.id for r in quality.quality_rules(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == stay

    before, after = kept[1]
    rows = before.collect()
    lines = brute.boilerplate([(r.source, r.text.split("\n")) for r in rows], corpus_pipeline.LINE_RATIO, once=True)
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: "\n".join(x) for r, x in zip(rows, lines, strict=True)}

    before, after = kept[2]
    expected = [key for key, _, first in brute.near_components([(r.doc_id, r.text) for r in before.collect()], corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR) if key == first]
    assert sorted(r.doc_id for r in after.collect()) == sorted(expected)

    before, after = kept[3]
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before.collect():
        sizes[r.source] += len(brute.words(r.text))
    for r in after.collect():
        taken[r.source] += len(brute.words(r.text))
    targets = brute.targets(sizes)
    assert all(0 <= targets[s] - taken[s] < 1 + 1e-6 for s in targets)

    before, after = kept[4]
    assert after.count() == before.count() and after.where("not decoded_equal").count() == 0
    assert corpus_pipeline.run(spark, small).count() == after.count()
    assert public_tokenizers.path(corpus_pipeline.VOCABULARY)


def test_copies_leave_one(spark, tmp_path):
    """A third of a source are copies of one clean text: its representative comes out, whole."""
    clean = "The river runs past the old mill and the people of the village walk along it in the evening when the work of the day is done."
    body = [(i, clean) for i in range(10)] + [(i, f"House {i} of the street {i * 7} was built by the family {i * 13} and it has the number {i * 31} on the door to the garden {i * 3}.") for i in range(10, 30)]
    rows = [(i, t, "en", "web", len(t)) for i, t in body]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.text for r in line_dedup.without_boilerplate(spark.read.parquet(str(tmp_path / "documents.parquet"))).where("doc_id < 10").collect()} == {clean}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [0, *range(10, 30)] and out[0].n_tokens > 20


def test_texts_go_to_python_in_small_batches(spark):
    from runeframe.llm import common, ngram_join

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.sparkContext.accumulator(0)
    before = spark.conf.get(name)

    def run(batches):
        for batch in batches:
            if batch.num_rows > 100:
                seen.add(1)
            yield batch

    with common.small_batches(spark, 100):
        common.settled(spark.range(1000).coalesce(1).mapInArrow(common.lean(run), "id long"))
    assert (seen.value, spark.conf.get(name)) == (0, before)
    docs = spark.createDataFrame([(i, f"a b c d {i % 3} e f g h i j k l") for i in range(30)], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs, percent=100).collect()) == [0, 1, 2]
    assert spark.conf.get(name) == before
