"""The queries op1 to op10 as SQL for DuckDB, where SQL can say the same. The others are held against plain versions in tests/llm."""

from __future__ import annotations

from runeframe.llm import pii
from runeframe.llm.line_dedup import BLOCK_END, HOST, RATIO
from runeframe.llm.mixing import EPOCHS, SHARE, WEIGHTS
from runeframe.llm.quality import RULES, STOP_WORDS
from runeframe.llm.token_counts import PIECE

WORD = r"[^\x20\x09-\x0D]+"
#: ws(doc_id, text, w): every document with the list of its words.
WORDS = f"ws AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)"


def joined_words(n: int) -> str:
    """n words of w from place i on, joined by blanks."""
    return f"array_to_string(w[i + 1 : i + {n}], ' ')"


RULE_SQL = {
    "n_words": "n_words",
    "repeat_ratio": "n_repeat_words / nullif(n_words, 0)",
    "mean_word_chars": "word_chars / nullif(n_words, 0)",
    "symbols_per_word": "(n_symbols - bars) / nullif(n_words, 0)",
    "shouted_per_word": "shouted / nullif(n_words, 0)",
    "bar_per_word": "bars / nullif(n_words, 0)",
    "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
    "stop_ratio": "n_stop / nullif(n_words, 0)",
}


def rules() -> str:
    tests = [f"coalesce(n_words < {words} OR {RULE_SQL[name]} {sign} {limit}, true)" for name, least, most, words in RULES for sign, limit in ((">=", least), ("<=", most)) if limit is not None]
    return " AND ".join(tests)


def luhn(digits: str) -> str:
    return f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN substr({digits}, length({digits}) - i, 1)::INT ELSE 2 * substr({digits}, length({digits}) - i, 1)::INT - CASE WHEN substr({digits}, length({digits}) - i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


def mod97(plain: str) -> str:
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    return f"list_reduce(list_prepend(0, list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c: {value})), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"


def op5() -> str:
    """Every kind by its plain pattern, with spans as rows."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: NOT coalesce(try_cast(x AS HUGEINT) <= 255, false))) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn(digits)}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
    }
    plain |= {k.name: (k.pattern, f"regexp_full_match(m, '{k.whole}')") for k in pii.KINDS if k.whole}

    def located(kind: str, text: str, pattern: str) -> str:
        return f"""{kind}_at AS (SELECT doc_id, m, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM (SELECT doc_id, unnest(hits) AS m, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i
FROM (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS hits, regexp_split_to_array({text}, '{pattern}') AS gaps FROM d)))"""

    parts = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)", located("head", "' ' || t", "[^A-Za-z0-9][A-Z]{2}[0-9]{2}")]
    known = ", ".join(f"'{code}': {n}" for n, codes in pii.IBAN_CHARS.items() for code in codes.split())
    whole_plain = "replace(x, ' ', '')"
    parts.append(rf"""heads AS (SELECT h.doc_id, substr(m, 2) AS head, e - 5 AS s, regexp_extract(substr(t, e::INT, 64), '^((?:\x20?[A-Z0-9]){{11,30}})(?:[^A-Za-z0-9]|$)', 1) AS tail FROM head_at h JOIN d USING (doc_id)),
wholes AS (SELECT doc_id, s, head, list_transform(range(1, len(string_split(tail, ' ')) + 1), lambda k: head || array_to_string(string_split(tail, ' ')[1:k], ' ')) AS w FROM heads WHERE tail <> ''),
accounts AS (SELECT doc_id, s, list_filter(w, lambda x: coalesce(length({whole_plain}) = (map {{{known}}})[substr(head, 1, 2)], length({whole_plain}) >= 15) AND {mod97(whole_plain)})[-1] AS m FROM wholes),
iban_found AS (SELECT doc_id, s, s + length(m) AS e FROM accounts WHERE m IS NOT NULL)""")
    for name, (pattern, check) in plain.items():
        parts += [located(name, "t", pattern), f"{name}_found AS (SELECT doc_id, e - length(m) AS s, e FROM {name}_at WHERE {check})"]
    told = lambda these: f"regexp_matches(near, '(?:^|[^a-z0-9])(?:{these})')"
    near = f"translate(concat(substr(t, (greatest(s - {pii.REACH}, 0) + 1)::INT, (s - greatest(s - {pii.REACH}, 0))::INT), ' ', substr(t, (e + 1)::INT, {pii.REACH})), '{pii.UPPER}', '{pii.LOWERED}')"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {o} AS o, '{k.name}' AS kind, s, e, {k.base} AS base, ({k.score} + CASE WHEN {told(pii.CONTEXT[k.name])} THEN {pii.RAISE} ELSE 0 END - CASE WHEN {told(pii.EXAMPLE)} THEN {pii.LOWER} ELSE 0 END)::BIGINT AS score FROM (SELECT *, {near} AS near FROM {k.name}_found JOIN d USING (doc_id))"
        for o, k in enumerate(pii.KINDS)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name in ("email", "ip", "card", "phone"))
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s)"
    return f"""WITH {", ".join(parts)}, scored AS ({each}), told AS (SELECT * FROM scored WHERE base OR score >= {pii.REPORTED})
SELECT d.doc_id, {counts}, sha256(coalesce({listed} FILTER (base), '')) AS base_sha256, coalesce({listed}, '') AS spans, count(kind) AS n_spans, max(score) AS top_score FROM d LEFT JOIN told USING (doc_id) GROUP BY ALL"""


#: The table of the CRC-32 that gzip and PNG use, from its polynomial.
def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def op3(n_shards: int = 40) -> str:
    """Ranks in the order of keys, fractions of them, and cuts; the checksum byte by byte."""
    data = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[xor(c, b) % 256 + 1])), 4294967295)"
    return f"""WITH d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, {crc} AS text_crc32, md5('0' || chr(1) || doc_id) AS key FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS frac FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS LAST) - 1 AS nth, count(*) OVER () AS total FROM r),
s AS (SELECT *, nth * {n_shards} // total AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, nth - (shard * total + {n_shards - 1}) // {n_shards} AS slot, NULL::INT AS grown_shard FROM s"""


OP4 = f"""WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, {joined_words(4)} AS gram FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 3, 1) END)) AS i FROM low)),
sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY ALL),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * m >= 85 * (p.n + q.n - m)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT DISTINCT x, x FROM pairs UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON r.y = b.x)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, coalesce(min(r.y), d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id"""
ORACLE: dict[str, str] = {
    "op1_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op2_mix_sources": f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('0' || chr(1) || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, list_value({", ".join(map(str, WEIGHTS))})[(nth % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS weight, {EPOCHS}.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, nth) AS o FROM w),
l AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT *, least(cap, coalesce((SELECT arg_min(level, o) FROM l WHERE level <= cap / weight) * weight, cap)) AS target FROM l),
c AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken FROM c""",
    "op3_stratified_shards": op3(),
    "op4_ngram_join": OP4,
    "op5_pii": op5(),
    "op6_quality_rules": f"""WITH {WORDS}, g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM (SELECT doc_id, i, {joined_words(5)} AS gram FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0))) AS i FROM ws))),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS at FROM g CROSS JOIN range(0, 5) AS t(j) WHERE c > 1) GROUP BY ALL),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(coalesce(text, ''), '[|]')) AS bars,
len(list_filter(w, lambda x: x LIKE '%!!')) AS shouted, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS n_stop FROM ws),
x AS (SELECT doc_id, n_words, word_chars, n_symbols, bars, shouted, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_stop, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules()} AS kept FROM y""",
    "op7_line_dedup": f"""WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, string_split(regexp_replace(coalesce(html, ''), '{BLOCK_END}', '\\1' || chr(10), 'g'), chr(10)) AS lines FROM pages),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY ALL),
n AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM p) WHERE trim(line, ' ') <> '' GROUP BY ALL),
b AS (SELECT n.host, list(line) AS gone FROM n JOIN h ON n.host IS NOT DISTINCT FROM h.host WHERE n > 1 AND n > {RATIO}::DOUBLE * pages GROUP BY ALL),
k AS (SELECT page_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM p LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host)
SELECT page_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k""",
    "op8_substring_dedup": f"""WITH {WORDS}, win AS (SELECT doc_id, i, {joined_words(20)} AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 19, 0))) AS i FROM ws)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM later CROSS JOIN range(0, 20) AS t(j)), lists AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY ALL),
kept AS (SELECT doc_id, string_agg(w[place + 1], ' ' ORDER BY place) AS s FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS place FROM ws) e ANTI JOIN gone USING (doc_id, place) GROUP BY ALL)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM ws LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op10_token_counts": f"""SELECT source, lang, 'pieces-2' AS version, count(*) AS docs, sum(len(regexp_extract_all(text, '{PIECE}')))::BIGINT AS tokens FROM documents
WHERE len(regexp_extract_all(text, '{WORD}')) >= 10 GROUP BY ALL""",
}
