"""Quality rules: a table of thresholds, compiled into one projection. DataFrame functions only.

The measures of a text are columns of one projection over its words and lines; each row of RULES compiles to one comparison
of a measure with its bounds. Repeats of 5-word windows: hashes of all windows first; only a text in which two agree
pays for sorting its windows and merging their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeframe.llm.common import let, quoted, words

#: (measure, least, most, words): texts of so many words or more must stay within the bounds; None: no bound. Texts are kept that pass all rules.
RULES: tuple[tuple[str, float | None, float | None, int], ...] = (
    ("n_words", 10, None, 0),
    ("repeat_ratio", None, 0.20, 0),
    ("mean_word_chars", 1.5, 25.0, 0),
    ("symbols_per_word", None, 0.30, 0),
    ("shouted_per_word", None, 0.50, 0),
    ("bar_per_word", None, 0.30, 0),
    ("dup_line_ratio", None, 0.60, 0),
    ("stop_ratio", 0.02, None, 30),
)
#: Words so common in their language that running text of some length holds one.
STOP_WORDS = (
    "a an and are as at be but by for from has have he in is it of on or that the this to was were which with "
    "au aux ce dans de des du elle en est et il la le les mais ou par pas pour que qui sur un une "
    "als auch auf das dem den der die ein eine er es für im ist mit nicht sie sind und von zu "
    "al como con del el los las lo más no para pero por se su una y"
).split()
WINDOW = 5


def repeated_words(n_col: Column, grams: Column) -> Column:
    """Words covered by windows that occur twice or more; grams: a value for each window, by position."""

    def covered(positions: Column) -> Column:
        nxt = lambda i: F.element_at(positions, i + 2)
        steps = F.transform(positions, lambda p, i: F.when(i + 1 < F.size(positions), F.least(F.lit(WINDOW), nxt(i) - p)).otherwise(WINDOW))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def among(ordered: Column) -> Column:
        def repeats(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.element_at(ordered, F.greatest(i, F.lit(1)))["gram"] == s["gram"]).otherwise(False)
            after = F.when(i + 1 < F.size(ordered), F.element_at(ordered, F.least(i + 2, F.size(ordered)))["gram"] == s["gram"]).otherwise(False)
            return before | after

        return let(F.sort_array(F.transform(F.filter(ordered, repeats), lambda s: s["at"])), covered)

    placed = F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(F.sort_array(placed), among)).cast("long")


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row for each input row: id, the measures, and row, a struct of all columns, if carry."""
    text = F.coalesce(quoted(text_col), F.lit(""))

    def of_words(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(grams, lambda g: repeated_words(F.size(w), g))).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop"),
        )

    lines = lambda: F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        quoted(id_col).alias("id"),
        *([F.struct(*[quoted(c) for c in docs.columns]).alias("row")] if carry else []),
        let(words(text), of_words).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[|]")).cast("long").alias("n_bars"),
        F.regexp_count(text, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_shouted"),
        let(lines(), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    ).select(
        "id",
        *(["row"] if carry else []),
        "w.*",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        F.try_divide(F.col("w.n_repeat_words"), F.col("w.n_words")).alias("repeat_ratio"),
        F.try_divide(F.col("w.word_chars"), F.col("w.n_words")).alias("mean_word_chars"),
        F.try_divide(F.col("n_symbols") - F.col("n_bars"), F.col("w.n_words")).alias("symbols_per_word"),
        F.try_divide(F.col("n_bars"), F.col("w.n_words")).alias("bar_per_word"),
        F.try_divide(F.col("n_shouted"), F.col("w.n_words")).alias("shouted_per_word"),
        F.try_divide(F.col("lines.dup"), F.col("lines.n")).alias("dup_line_ratio"),
        F.try_divide(F.col("w.n_stop"), F.col("w.n_words")).alias("stop_ratio"),
    )


def verdict(rules=RULES) -> Column:
    """True where all measures lie within the bounds of the rules that hold for so many words; a measure that can't be taken (no words) passes."""
    passed = F.lit(True)
    for name, least, most, words_ in rules:
        for test in ([F.col(name) >= least] if least is not None else []) + ([F.col(name) <= most] if most is not None else []):
            passed = passed & F.coalesce((F.col("n_words") < words_) | test, F.lit(True))
    return passed


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES, carry: bool = False) -> DataFrame:
    """measure()'s columns and two verdicts: base_failed (under 10 words, or over a fifth of them in repeated windows)
    and kept (not base_failed, and within all rules).

    A null text has no words and fails; an empty table gives no rows; repeated rows are each judged; columns of the input stay inside row.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(docs, id_col=id_col, text_col=text_col, carry=carry).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with its columns, whatever their names. Repeated rows stay repeated; null and empty texts go; an empty table gives no rows."""
    return quality_rules(docs, carry=True, **options).where("kept").select("row.*")
