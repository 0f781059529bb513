"""Line dedup by frequency relative to the site. DataFrame functions only.

For each host: in how many of its pages does a line stand, divided by the pages of the host. Lines above a ratio are boilerplate
of that host and are dropped from its pages. Lines meet as 64-bit hashes, once a page, and counts are made before the shuffle.

Boilerplate is few lines: a host has fewer than (lines of a page) / ratio. They are counted first. Up to FEW_LINES they are broadcast and pages stay where they are.
Beyond, pages meet them by host; a host of many pages is dealt to as many salts as its pages need, and its lines to each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeframe.llm.common import let, quoted, settled

#: A line is boilerplate above this share of its host's pages. What stands in one page alone isn't repeated, whatever its share.
RATIO = 0.5
#: Lines of boilerplate (a host and a number each) that are broadcast; beyond, pages of a host in one part of the join. Hosts beyond that are
#: fewer than pages / PAGES_A_SALT, so their list is broadcast.
FEW_LINES, PAGES_A_SALT = 200_000, 100_000
#: Closing tags of blocks, after which a line of a web page ends.
BLOCK_END = r"(</(?:p|div|li|ul|nav|h1|h2|article|footer|header|title|script|style|head)>|<br>)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def html_lines(html: Column) -> Column:
    """Lines of a web page: they end at line feeds and after closing tags of blocks."""
    return F.split(F.regexp_replace(html, BLOCK_END, "$1\n"), "\n")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def drop_boilerplate(pages: DataFrame, host: Column, lines: Column, *, ratio: float = RATIO, same: Column | None = None) -> DataFrame:
    """One row for each input row: row (struct of its columns), n_lines, n_dropped, kept (array of lines, in order).

    A blank line is never dropped and stays as it is; nor is a line that stands in one page of its host only. A null or empty text has one empty line. Pages without host (null) form a host of
    their own. A line counts once a page, however often it stands there; repeated rows are pages of their own, unless same is given: then
    rows of a host that agree in it count as one page, for its lines and for the pages of the host. An empty table gives no rows.
    Columns of the input stay inside row.
    """
    site, every = ["no_host", "host"], F.coalesce(lines, F.array(F.lit("")))
    hosts = [F.coalesce(host.cast("string"), F.lit("")).alias("host"), host.isNull().alias("no_host")]
    hashed = F.transform(F.filter(every, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))
    page = [] if same is None else [same.alias("page")]
    once, found = pages.select(*hosts, *page), pages.select(*hosts, *page, F.explode(F.array_distinct(hashed)).alias("line"))
    if page:
        once, found = once.distinct(), found.distinct()
    totals = once.groupBy(*site).agg(F.count(F.lit(1)).alias("pages"))
    common = settled(
        found.groupBy(*site, "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)  # before the join: most lines go here
        .join(totals, site)
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .select(*site, "line")
    )
    listed = common.groupBy(*site).agg(F.collect_set("line").alias("boilerplate"))
    # Pages travel as they are; their lines are cut again behind the join.
    row = F.struct(*[quoted(c) for c in pages.columns])
    dealt = pages.select(row.alias("row"), *hosts)
    if common.count() <= FEW_LINES:
        joined = dealt.join(F.broadcast(listed), site, "left")
    else:
        salts = F.ceil(F.col("pages") / PAGES_A_SALT).cast("int")
        hot = totals.where(F.col("pages") > PAGES_A_SALT).select(*site, salts.alias("salts"))
        spread = F.pmod(F.xxhash64(*[F.col("row")[c] for c, kind in pages.dtypes if "map" not in kind]), F.coalesce("salts", F.lit(1))).cast("int")
        salted = listed.join(hot, site, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        joined = dealt.join(F.broadcast(hot), site, "left").withColumn("salt", spread).join(salted, [*site, "salt"], "left")
    # lines is given in the names of the input, so it is read from the row's columns; the added column takes a name that the input doesn't have
    name = "boilerplate"
    while name in pages.columns:
        name += "_"
    joined = joined.select("row.*", F.coalesce("boilerplate", F.array().cast("array<bigint>")).alias(name))
    kept = let(every, lambda x: F.struct(F.size(x).alias("n"), F.filter(x, lambda y: (F.trim(y) == "") | ~F.array_contains(quoted(name), F.xxhash64(y))).alias("kept")))
    cut = joined.select(row.alias("row"), kept.alias("x"))
    return cut.select("row", F.col("x.n").cast("long").alias("n_lines"), (F.col("x.n") - F.size("x.kept")).cast("long").alias("n_dropped"), F.col("x.kept").alias("kept"))


def without_boilerplate(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", ratio: float = RATIO) -> DataFrame:
    """The rows of docs, with its columns, their text without the boilerplate lines of their source, and the length column, if there is one, adjusted.

    Copies of a text count as one page of their source: many copies alone don't make a document's own lines boilerplate. A text that loses no line
    stays as it is, null included, and so does its length; repeated rows stay repeated; a null source is a source; an empty table gives no rows; columns of any name stay.
    """
    dropped = drop_boilerplate(docs, quoted(source_col), text_lines(quoted(text_col)), ratio=ratio, same=F.xxhash64(F.coalesce(quoted(text_col), F.lit(""))))
    text = F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("row")[text_col])
    fresh = {text_col: text, chars_col: F.when(F.col("n_dropped") > 0, F.length(text).cast("long")).otherwise(F.col("row")[chars_col]) if chars_col in docs.columns else None}
    return dropped.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
