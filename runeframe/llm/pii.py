"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.
DataFrame functions only.

A pattern's spans come from two passes of the same matcher: split() gives what lies between the matches,
regexp_extract_all() the matches, and running sums of their lengths give offsets in code points. Both run only where a
cheap test finds what every match needs. Patterns are written so that no text costs more than linear
time: repetitions are possessive, bounded, or of one class; a match may start only where the run it would lie in starts, or where the previous match ended.
Running sums are taken in steps, so a text of very many matches costs little more than one of few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeframe.llm.common import let, quoted, running


@dataclass(frozen=True)
class Kind:
    """How a kind of personal data is found. needs: a cheap test that every text with a match passes (a character, or a pattern in brackets).

    score: in hundredths, before context. whole: what a match must have the form of. ahead: the pattern matches the beginning alone, and its first group looks ahead at all that may follow.
    """

    name: str
    pattern: str
    needs: str
    score: int
    base: bool = True
    whole: str = ""
    ahead: bool = False


#: In the order in which kinds are listed. Base kinds are reported whenever their check passes; others by score. A kind that starts below REPORTED is reported by its context alone.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 90),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", 70),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "[0-9]", 80),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 60),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))", "[0-9]", 70, base=False, ahead=True),
    Kind("ssn", r"[A-Za-z0-9-]{11,}", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 40, base=False, whole=r"(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})"),
    Kind("birth", r"[A-Za-z0-9-]{10,}", "[0-9]{4}-[0-9]{2}-[0-9]{2}", 30, base=False, whole=r"(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"),
    Kind("secret", r"[A-Za-z0-9_/+-]{20,}", "[A-Za-z0-9_/+-]{20}", 40, base=False, whole=r".*(?:[0-9].*[A-Za-z]|[A-Za-z].*[0-9]).*"),
)
#: Characters of a country's account numbers, without blanks.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Beginnings of words that raise a score where they stand within REACH characters of a span, and by how much.
CONTEXT = {
    "email": "mail|contact|write|schreib", "ip": "ip|host|server|address", "card": "card|visa|credit|karte|tarjeta|carte", "phone": "phone|call|tel|fax|mobile", "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer", "birth": "born|birth|dob|geboren|geburt|naci|naissance", "secret": "token|secret|key|password|passwd|pwd|credential|bearer|authorization",
}
#: Words that lower it: what is given as an example is nobody's.
EXAMPLE = "example|sample|dummy|placeholder|beispiel|ejemplo|exemple"
REACH, RAISE, LOWER, REPORTED = 40, 30, 20, 60
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit counts double, less 9 if that is above 9."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(moved, F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)) == 1


def account(head: Column, tail: Column) -> Column:
    """The account number that begins with head: head and the blocks of tail that belong to it, null if no such is one.

    It has the length of its country; where the country is not known, the longest that passes mod 97 is taken.
    """
    known = F.create_map(*[F.lit(x) for n, codes in IBAN_CHARS.items() for code in codes.split() for x in (code, n)])

    def longest(blocks: Column) -> Column:
        wholes = F.transform(F.sequence(F.lit(1), F.size(blocks)), lambda k: F.concat(head, F.array_join(F.slice(blocks, 1, k), " ")))

        def passes(whole: Column) -> Column:
            plain = F.regexp_replace(whole, " ", "")
            fits = F.coalesce(F.length(plain) == F.try_element_at(known, F.substring(head, 1, 2)), F.length(plain) >= 15)
            return F.when(fits, mod97(plain)).otherwise(F.lit(False))

        return F.try_element_at(F.filter(wholes, passes), F.lit(-1))

    return let(F.split(tail, " "), longest)


def _apart(spans: Column) -> Column:
    """Confirmed spans, without those that begin within the one kept before."""
    kept = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.aggregate(F.filter(spans, lambda s: s["match"].isNotNull()), kept, lambda out, s: F.when(F.coalesce(s["start"] < F.try_element_at(out, F.lit(-1))["end"], F.lit(False)), out).otherwise(F.concat(out, F.array(s))))


def _confirmed(kind: Kind, match: Column) -> Column:
    digits = F.length(_digits(match))
    if kind.name == "ip":
        # leading zeros don't count: at most three digits are left then, so a cast can't overflow
        short = F.transform(F.split(match, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda part: (F.length(part) <= 3) & (F.substring(part, 1, 3).cast("int") <= 255))
    if kind.name == "card":
        return F.when(digits.between(13, 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind.name == "phone":
        return digits.between(9, 15)
    return match.rlike(f"^{kind.whole}$") if kind.whole else F.lit(True)


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, match>> of all confirmed matches, by start."""
    pattern = F.lit(kind.pattern)

    def found(t: Column) -> Column:
        between, matches = F.split(t, kind.pattern, -1), F.regexp_extract_all(t, pattern, F.lit(0))

        def located(pair: Column) -> Column:
            hits = pair["hits"]
            both = F.zip_with(F.slice(pair["gaps"], 1, F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
            heads = F.zip_with(running(both, lambda a, b: a + b), hits, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("match")))
            if not kind.ahead:
                return heads

            def whole(s: Column, tail: Column) -> Column:
                return let(account(s["match"], tail), lambda m: F.struct(s["start"].alias("start"), (s["start"] + F.length(m)).alias("end"), m.alias("match")))

            return _apart(F.zip_with(heads, F.regexp_extract_all(t, pattern, F.lit(1)), whole))

        return let(F.struct(between.alias("gaps"), matches.alias("hits")), located)

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    needed = text.rlike(kind.needs) if kind.needs.startswith("[") else F.contains(text, F.lit(kind.needs))
    return F.filter(F.when(needed, found(text)).otherwise(none), lambda s: _confirmed(kind, s["match"]))


def _score(text: Column, kind: Kind, span: Column) -> Column:
    begin = F.greatest(span["start"] - REACH, F.lit(0))
    near = F.concat_ws(" ", F.substring(text, begin + 1, span["start"] - begin), F.substring(text, span["end"] + 1, F.lit(REACH)))

    def scored(words: Column) -> Column:
        told = lambda these: words.rlike(f"(?:^|[^a-z0-9])(?:{these})")
        return F.lit(kind.score) + F.when(told(CONTEXT[kind.name]), RAISE).otherwise(0) - F.when(told(EXAMPLE), LOWER).otherwise(0)

    return let(F.translate(near, UPPER, LOWERED), scored)


def _described(text: Column, kind: Kind) -> Callable[[Column], Column]:
    def describe(s: Column) -> Column:
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), _score(text, kind, s).alias("score"), F.lit(kind.base).alias("base"))

    return describe


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, text, and spans, array<struct<kind, start, end, match, score, base>>, by kind in
    the order of KINDS, then start. Offsets are code points, end exclusive; scores are hundredths.

    A base span is kept whatever its score; a span of another kind only from REPORTED on. A null text is an empty one
    and has no spans. Kinds may overlap; within a kind spans don't. Repeated rows are each reported; a null id stays null; an empty table gives no rows. Other columns are not looked at.
    """
    base = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    base = base.withColumns({f"{k.name}_found": _spans(F.col("text"), k) for k in KINDS})
    base = base.withColumns({k.name: F.transform(f"{k.name}_found", _described(F.col("text"), k)) for k in KINDS})
    spans = F.concat(*[F.col(k.name) if k.base else F.filter(F.col(k.name), lambda s: s["score"] >= REPORTED) for k in KINDS])
    return base.select("id", "text", spans.alias("spans"))


def masked(found: DataFrame) -> DataFrame:
    """find_pii()'s rows with masked instead of text: spans replaced by their kind in brackets. Spans that overlap are replaced as one, by the kind of the first
    (of those that start together, the longest). A text without spans stays; repeated rows stay repeated; an empty table gives no rows."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))

    def replaced(spans: Column) -> Column:
        def joined(ends: Column) -> Column:
            before = F.transform(spans, lambda _, i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0))
            parts = F.zip_with(spans, before, lambda s, b: F.when(s["start"] >= b, F.concat(F.substring(F.col("text"), b + 1, s["start"] - b), F.lit("["), s["kind"], F.lit("]"))))
            rest = F.substring(F.col("text"), F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + 1, F.length("text"))
            return F.concat(F.array_join(F.array_compact(parts), ""), rest)

        return let(running(F.transform(spans, lambda s: -s["neg"]), lambda a, b: F.greatest(a, b)), joined)

    return found.withColumn("masked", let(ordered, replaced)).drop("text")
