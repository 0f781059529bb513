"""Plain versions of the operators, and rows with everything that is odd."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, id long, key string, `a.b` string, words string"


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def odd_texts():
    passage = " ".join(f"w{i}" for i in range(40))
    return [
        None, "", "   \n\t ", "a", "one two three", "one two three", "ONE two\tthree", "zażółć gęślą \U0001f600 jaźń " * 7, passage, passage + " end", "start here " + passage, passage + " " + passage,
        "x" * 5000, "y " * 3000, "1 " * 300 + "@" * 50, "a@b.cd.ef+x@y.z mail j.d-e@f-g.hi.", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0000000000000000000001.2.3.4", "4111 1111 1111 1111 and 4111111111111112 or 4111-1111-1111-1111",
        "+1 (743) 555-3824 +49 1 +1234567890123456 tel +44 20 7946 0958.", "IBAN GB82 WEST 1234 5698 7654 32 bank DE89370400440532013000", "1" * 3000 + " " + "1 " * 2000, "a" * 20000 + "@", "é" * 30 + " x@y.zz", "line\nline\n\nline\nother",
        "the same five words are the same five words are the same five words are here", "tail\x1fof\x85text with odd blanks", "\x00nul \x01 inside", "### *** $$$ || %% && <> a b c d e f",
    ]


def odd_rows():
    """Rows as tuples: nulls in every column, repeated rows, ties in ids' order, columns named as helpers might be."""
    texts = odd_texts()
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "s1", "s2", "s\U0001f600", ""][i % 5], None if i % 4 == 0 else len(t or ""), 7, "r", -1, "k", "dot", "w") for i, t in enumerate(texts)]
    rows += [(100 + i, t, "en", "s1", 1, None, None, None, None, None, None) for i, t in enumerate(texts)]
    return rows


def documents(spark, extra=()):
    return spark.createDataFrame([*odd_rows(), *extra], SCHEMA)


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """The contract's rounds, one by one."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > epochs * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = epochs * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def shards(rows, n):
    """(id, size, checksum, shard, slot) by id: ranks in the order of keys within each source, fractions of them, one order cut in n parts."""
    def key(r):
        return hashlib.md5(f"0\x01{r[0]}".encode()).hexdigest()

    placed = []
    for source in {r[3] for r in rows}:
        mine = sorted((r for r in rows if r[3] == source), key=lambda r: (key(r), r[0]))
        placed += [((i + 0.5) / len(mine), source is None, (source or "").encode(), r) for i, r in enumerate(mine)]
    placed.sort(key=lambda p: p[:3])
    out, slots = [], collections.Counter()
    for nth, (_, _, _, r) in enumerate(placed):
        shard = nth * n // len(placed)
        out.append((r[0], len((r[1] or "").encode()) + 16, crc(r[1]), shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PII.items() for m in re.finditer(p, text or "") if ok(m.group())]


def quality(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def shingles(text, n):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_components(rows, n, percent):
    """For each (id, text): size of its set, smallest id it reaches."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = collections.Counter((a, b) for h in holders.values() for j, b in enumerate(h) for a in h[:j])
    for (a, b), m in common.items():
        if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
            parent[root(b)] = root(a)
    low = {}
    for i, (key, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), key), key)
    return [(key, len(sets[i]), low[root(i)]) for i, (key, _) in enumerate(rows)]


def repeats(rows, window=20):
    """For each (id, text): words, how many go, what stays."""
    first = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (key, i))
    out = []
    for key, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (key, i) for j in range(i, i + window)}
        out.append((key, len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def boilerplate(rows, ratio, least=2, once=False):
    """For each (host, lines): the lines that stay. once: rows that agree in both count as one page."""
    counted = set((h, tuple(lines)) for h, lines in rows) if once else rows
    pages, count = collections.Counter(h for h, _ in counted), collections.Counter((h, x) for h, lines in counted for x in set(lines) if x.strip(" "))
    return [[x for x in lines if not x.strip(" ") or not (count[h, x] >= least and count[h, x] > ratio * pages[h])] for h, lines in rows]


def crc(text):
    return zlib.crc32((text or "").encode())
