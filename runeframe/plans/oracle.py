"""The queries as SQL for DuckDB, where SQL can say the same over whole tables."""

from __future__ import annotations

from runeframe.plans.queries import B

#: Common table expressions, by what they give.
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
NAMES = "names AS (SELECT p_partkey AS doc_id, p_name AS text FROM part)"
WORDS = r"words AS (SELECT DISTINCT w AS pattern_id, length(w) AS m FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM benchmark) WHERE w <> '')"


def pieces(source: str, overlap: int) -> str:
    """pieces(doc_id, start, piece): texts in pieces of 256 symbols and the overlap."""
    return f"pieces AS (SELECT doc_id, s AS start, substring(text, s + 1, {256 + overlap}) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 256)) AS s FROM {source}))"


def grams(k: int, source: str = "pieces") -> str:
    return f"SELECT doc_id, start + i AS pos, substring(piece, i + 1, {k}) AS gram FROM (SELECT doc_id, start, piece, unnest(range(0, least(256, length(piece) - {k} + 1))) AS i FROM {source} WHERE length(piece) >= {k})"


WORD_PLACES = f"""{WORDS}, {pieces("documents", 63)}, lengths AS (SELECT DISTINCT m FROM words),
places AS (SELECT pattern_id, doc_id, start + i AS pos FROM (
  SELECT doc_id, start, substring(piece, i + 1, l.m) AS gram, l.m, i FROM (SELECT doc_id, start, piece, unnest(range(0, least(256, length(piece)))) AS i FROM pieces) CROSS JOIN lengths l WHERE i + l.m <= length(piece)
) g JOIN words w ON g.gram = w.pattern_id AND g.m = w.m)"""
PASSAGE_PLACES = """hits AS (SELECT item_id AS pattern_id, doc_id, d.text, b.text AS pattern FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
places AS (SELECT pattern_id, doc_id, i AS pos, text, length(pattern) AS m FROM (SELECT pattern_id, doc_id, text, pattern, unnest(range(0, length(text) - length(pattern) + 1)) AS i FROM hits) WHERE substring(text, i + 1, length(pattern)) = pattern)"""
#: sa(doc_id, rank, pos, suffix, text, n) and lcps(..., lcp, bwt) of names or turns; n counts the sentinel.
def suffixes_of(source: str) -> str:
    return f"""sa AS (SELECT doc_id, text, pos, length(text) + 1 AS n, substring(text, pos + 1) AS suffix, row_number() OVER (PARTITION BY doc_id ORDER BY substring(text, pos + 1)) - 1 AS rank
FROM (SELECT doc_id, text, unnest(range(0, length(text) + 1)) AS pos FROM {source}))"""


def common(a: str, b: str, rows: str, most: int = 4096) -> str:
    """rows with l: the symbols that a and b share at their start, by halving."""
    out, step = f"SELECT *, 0::BIGINT AS l FROM {rows}", most
    while step:
        out = f"SELECT * REPLACE (CASE WHEN l + {step} <= least(length({a}), length({b})) AND substring({a}, l + 1, {step}) = substring({b}, l + 1, {step}) THEN l + {step} ELSE l END AS l) FROM ({out})"
        step //= 2
    return out


def lcp_of(source: str) -> str:
    return f"""{suffixes_of(source)}, before AS (SELECT *, coalesce(lag(suffix) OVER (PARTITION BY doc_id ORDER BY rank), '') AS prev FROM sa),
lcps AS (SELECT * RENAME (l AS lcp), CASE WHEN pos = 0 THEN '' ELSE substring(text, pos, 1) END AS bwt FROM ({common("prev", "suffix", "before")}))"""


SA, LCP = f"{NAMES}, {suffixes_of('names')}", f"{NAMES}, {lcp_of('names')}"
TURN_SA, TURN_LCP = f"{TURNS}, {suffixes_of('turns')}", f"{TURNS}, {lcp_of('turns')}"
#: prefixes(doc_id, rank, pos, d, prefix, bwt): of every suffix with a mark for its end, every prefix.
PREFIXES = f"""{LCP}, prefixes AS (SELECT doc_id, text, n, rank, pos, bwt, d, substring(text || chr(1), pos + 1, d) AS prefix FROM (SELECT *, unnest(range(1, n - pos + 1)) AS d FROM lcps))"""
BLOCKS = f"""{PREFIXES}, light AS (SELECT doc_id, prefix FROM prefixes GROUP BY ALL HAVING count(*) <= {B}),
depths AS (SELECT doc_id, rank, min(d) AS depth FROM prefixes JOIN light USING (doc_id, prefix) GROUP BY ALL),
bt AS (SELECT p.*, d.depth, min(rank) OVER (PARTITION BY doc_id, prefix) AS block FROM prefixes p JOIN depths d USING (doc_id, rank) WHERE p.d = d.depth),
blk AS (SELECT doc_id, block, replace(prefix, chr(1), '') AS prefix, any_value(depth) AS depth, count(*) AS size, count(*) > 1 AND count(DISTINCT bwt) = 1 AS reducible FROM bt GROUP BY doc_id, block, prefix)"""
PARSE = f"""{BLOCKS}, walk(doc_id, factor_no, pos) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT FROM names UNION ALL
SELECT w.doc_id, w.factor_no + 1, w.pos + b.depth FROM walk w JOIN bt b ON w.doc_id = b.doc_id AND w.pos = b.pos WHERE w.pos + b.depth < b.n),
fac AS (SELECT w.doc_id, w.factor_no, b.block, w.pos AS start_pos, b.depth FROM walk w JOIN bt b ON w.doc_id = b.doc_id AND w.pos = b.pos)"""
TREE = f"""{PREFIXES}, inner_nodes AS (SELECT doc_id, min(rank) AS lb, max(rank) AS rb, any_value(d) AS depth FROM (
  SELECT p.doc_id, p.rank, p.d, p.prefix, substring(text || chr(1), p.pos + p.d + 1, 1) AS next FROM prefixes p
) GROUP BY doc_id, prefix HAVING count(DISTINCT next) > 1),
nodes AS (SELECT doc_id, lb, rb, depth FROM inner_nodes UNION ALL SELECT doc_id, rank, rank, n - pos FROM sa UNION ALL SELECT doc_id, 0, length(text), 0 FROM names WHERE length(text) > 0),
held AS (SELECT a.doc_id, a.lb, a.rb, a.depth, b.lb AS up_lb, b.rb AS up_rb, b.depth AS up_depth FROM nodes a LEFT JOIN nodes b ON a.doc_id = b.doc_id AND b.lb <= a.lb AND b.rb >= a.rb AND b.depth < a.depth),
tree AS (SELECT doc_id, lb, rb, depth, count(up_lb) AS node_depth, arg_max(up_lb, up_depth) AS parent_lb, arg_max(up_rb, up_depth) AS parent_rb, max(up_depth) AS parent_depth FROM held GROUP BY ALL)"""
#: Nodes of turns by where suffixes part: the last rank before with a smaller LCP, the first after.
TURN_TREE = f"""{TURN_LCP}, p AS (SELECT doc_id, rank, lcp FROM lcps WHERE rank > 0), e AS (SELECT doc_id, max(rank) AS last FROM lcps GROUP BY ALL),
ends AS (SELECT a.doc_id, a.rank, a.lcp, coalesce(max(b.rank) FILTER (b.rank < a.rank), 0) AS lb, min(b.rank) FILTER (b.rank > a.rank) - 1 AS rb FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND b.lcp < a.lcp GROUP BY ALL),
inner_nodes AS (SELECT DISTINCT doc_id, lb, coalesce(rb, last) AS rb, lcp AS depth FROM ends JOIN e USING (doc_id)),
nodes AS (SELECT * FROM inner_nodes UNION ALL SELECT doc_id, rank, rank, n - pos FROM lcps)"""
#: Of blocks of several suffixes, one step, and where chains of steps end.
REDUCED = f"""{BLOCKS}, heads AS (SELECT doc_id, block, arg_min(pos, rank) AS pos, any_value(n) AS n FROM bt GROUP BY ALL), several AS (SELECT doc_id, block, reducible FROM blk WHERE size > 1),
hops AS (SELECT s.doc_id, s.block, t.block AS dest, t.rank - t.block AS x FROM several s JOIN heads h USING (doc_id, block) JOIN bt t ON t.doc_id = s.doc_id AND t.pos = (h.pos - 1 + h.n) % h.n WHERE s.reducible),
chain(doc_id, block, dest, x, d) AS (SELECT doc_id, block, block, 0::BIGINT, 0::BIGINT FROM several UNION ALL SELECT c.doc_id, c.block, h.dest, c.x + h.x, c.d + 1 FROM chain c JOIN hops h ON h.doc_id = c.doc_id AND h.block = c.dest),
reduced AS (SELECT doc_id, block, arg_max(dest, d) AS dest_block, arg_max(x, d) AS delta_x, max(d) AS delta_d FROM chain GROUP BY ALL)"""
FIRST_WORDS = "heads AS (SELECT DISTINCT string_split(text, ' ')[1] AS pattern_id FROM names)"
NEAR_BLOCKS = """above AS (SELECT pattern_id, doc_id, true AS answered, sum(size) AS size, any_value(length(pattern_id)) AS depth FROM blk JOIN heads ON starts_with(prefix, pattern_id) GROUP BY ALL),
below AS (SELECT pattern_id, doc_id, false AS answered, size, depth FROM blk JOIN heads ON starts_with(pattern_id, prefix) AND length(prefix) < length(pattern_id) AND depth = length(prefix) AND prefix <> ''),
near AS (SELECT * FROM above UNION ALL SELECT * FROM below)"""
SAMPLED = f"""{pieces('documents', 9)}, c AS (SELECT gram FROM ({grams(10)}) GROUP BY gram HAVING count(*) BETWEEN 8 AND 12), r AS (SELECT gram, row_number() OVER (ORDER BY md5('1:' || gram), gram) - 1 AS nth, count(*) OVER () AS m FROM c),
t AS (SELECT count(*) AS n FROM benchmark), picked AS (SELECT turn * least(n, m) + nth AS pattern_id, gram AS pattern FROM r CROSS JOIN t CROSS JOIN range(0, 1000) AS g(turn) WHERE nth < n AND turn * least(n, m) + nth < n)"""
#: A text's longest match from a place on is with the passage's suffix before or after it in order.
MATCHES = f"""WITH {pieces('documents', 511)}, parts AS (SELECT DISTINCT substring(text, i + 1) AS s FROM (SELECT text, unnest(range(0, length(text))) AS i FROM benchmark)),
places AS (SELECT doc_id, start + i AS pos, substring(piece, i + 1, 512) AS s FROM (SELECT doc_id, start, piece, unnest(range(0, least(256, length(piece)))) AS i FROM pieces)),
low AS (SELECT p.doc_id, p.pos, p.s, coalesce(a.s, '') AS t FROM places p ASOF LEFT JOIN parts a ON p.s >= a.s), high AS (SELECT p.doc_id, p.pos, p.s, coalesce(a.s, '') AS t FROM places p ASOF LEFT JOIN parts a ON p.s <= a.s)
SELECT doc_id, pos, max(l) AS length FROM (SELECT doc_id, pos, l FROM ({common("s", "t", "low", 256)}) UNION ALL SELECT doc_id, pos, l FROM ({common("s", "t", "high", 256)})) GROUP BY ALL"""



SEQ = "seq AS (SELECT event_id AS pos, user_id AS sym FROM events)"
ERRORS = "bits AS (SELECT user_id, event_id AS pos, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS b, lag(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)"
VALUES = "vals AS (SELECT user_id, event_id AS idx, value AS val FROM events)"
PLACES = """places AS (SELECT 'W' AS child, NULL AS parent UNION ALL SELECT 'R' || r_regionkey, 'W' FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer)"""
PSI = f"{TURN_SA}, links AS (SELECT doc_id, rank, pos, coalesce(lead(rank) OVER (PARTITION BY doc_id ORDER BY pos), first_value(rank) OVER (PARTITION BY doc_id ORDER BY pos)) AS psi, coalesce(lag(rank) OVER (PARTITION BY doc_id ORDER BY pos), first_value(rank) OVER (PARTITION BY doc_id ORDER BY pos DESC)) AS lf FROM sa)"


def windows(width: int) -> str:
    return f"ranges AS (SELECT DISTINCT event_id // {width} AS query, event_id // {width} * {width} AS i, (event_id // {width} + 1) * {width} AS j FROM events)"


def entropy(k: int, source: str) -> str:
    if k:
        inner = f"SELECT substring(gram, 1, {k}) AS context, substring(gram, {k + 1}, 1) AS sym FROM ({grams(k + 1)})"
        ends = f"SELECT right(text, {k}), '' FROM {source} WHERE length(text) >= {k}"
    else:
        inner, ends = f"SELECT '' AS context, gram AS sym FROM ({grams(1)})", f"SELECT '', '' FROM {source}"
    return f"""SELECT {k}::BIGINT AS k, (SELECT sum(length(text) + 1)::BIGINT FROM {source}) AS n, count(*) AS contexts, round(sum(occ * log2(occ) - s) / (SELECT sum(length(text) + 1) FROM {source}), 6) AS hk
FROM (SELECT context, sum(m)::DOUBLE AS occ, sum(m * log2(m)) AS s FROM (SELECT context, sym, count(*) AS m FROM ({inner} UNION ALL {ends}) GROUP BY ALL) GROUP BY context)"""


def grid() -> str:
    from runeframe.operators.mining import GRID_LENGTHS, GRID_RANGES

    cells = ", ".join(f"({a}, {b})" for a, b in GRID_RANGES)
    each = " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, count(*) AS occ FROM ({grams(k)}) GROUP BY gram" for k in GRID_LENGTHS)
    return f"WITH {pieces('documents', max(GRID_LENGTHS) - 1)}, each AS ({each}), cells(least, most) AS (VALUES {cells}) SELECT k, least::BIGINT AS least, most::BIGINT AS most, count(*) AS candidates FROM each JOIN cells ON occ BETWEEN least AND most GROUP BY ALL"


RMQ = """{ranges}, asked AS (SELECT query, (i / 2)::BIGINT AS l, j - 1 AS r FROM ranges) SELECT query, l, r, {pick} AS idx FROM asked LEFT JOIN events ON event_id BETWEEN l AND r GROUP BY ALL"""

ORACLE: dict[str, str] = {
    "indexed_locate": f"WITH {PASSAGE_PLACES} SELECT pattern_id, doc_id, pos FROM places",
    "index_report": f"""WITH RECURSIVE {BLOCKS}, {FIRST_WORDS}, {NEAR_BLOCKS} SELECT count(*) AS queries, avg(depth) AS avg_depth, avg(answered::INT) AS answered_ratio, avg(size) FILTER (NOT answered) AS avg_block FROM near""",
    "places_verified": f"WITH {PASSAGE_PLACES} SELECT pattern_id, count(*) AS here, count(*) FILTER (substring(text, pos + 2, m) = substring(text, pos + 1, m)) AS behind FROM places GROUP BY ALL",
    "pattern_intervals": f"WITH {TURN_SA}, {WORDS}, lengths AS (SELECT DISTINCT m FROM words) SELECT pattern_id, doc_id, min(rank) AS lb, max(rank) AS rb FROM (SELECT doc_id, rank, substring(suffix, 1, l.m) AS head FROM sa CROSS JOIN lengths l WHERE l.m <= length(suffix)) s JOIN words w ON s.head = w.pattern_id GROUP BY ALL",
    "bwt_select": f"""WITH {TURN_LCP}, r AS (SELECT doc_id, bwt AS sym, rank AS pos, row_number() OVER (PARTITION BY doc_id, bwt ORDER BY rank) AS j FROM lcps), js(j) AS (VALUES (1), (2), (5))
SELECT s.doc_id, s.sym, js.j::BIGINT AS j, r.pos FROM (SELECT DISTINCT doc_id, bwt AS sym FROM lcps) s CROSS JOIN js LEFT JOIN r ON r.doc_id = s.doc_id AND r.sym = s.sym AND r.j = js.j""",
    "sampled_patterns": f"WITH {SAMPLED} SELECT pattern_id, pattern FROM picked",
    "pattern_file": f"WITH {SAMPLED} SELECT pattern_id, pattern, count(*) OVER () AS cnt, 10::BIGINT AS len, 0::BIGINT AS swaps FROM picked",
    "text_files": "SELECT left(n_name || ' - a nation' || chr(10), 20) AS text FROM nation",
    "number_files": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, user_id AS sym FROM events",
    "stream_window_counts": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS start, count(*) AS n FROM events GROUP BY ALL",
    "stream_runs": """WITH x AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events),
r AS (SELECT user_id, event_type, count(*) AS length, max(event_id) AS ending FROM x GROUP BY user_id, event_type, island) SELECT user_id, count(*) AS runs, arg_max(length, ending) AS length, arg_max(event_type, ending) AS last FROM r GROUP BY ALL""",
    "documents_cube": "SELECT lang, source, grouping_id(lang, source)::BIGINT AS level, count(*) AS docs, sum(length(text))::BIGINT AS symbols FROM documents GROUP BY CUBE (lang, source)",
    "documents_rollup": "SELECT lang, source, grouping_id(lang, source)::BIGINT AS level, count(*) AS docs FROM documents GROUP BY ROLLUP (lang, source)",
    "kgram_sets": f"""WITH {TURNS}, t AS (SELECT DISTINCT substring(text, i + 1, 8) AS gram FROM (SELECT text, unnest(range(0, length(text) - 7)) AS i FROM turns)), b AS (SELECT DISTINCT substring(text, i + 1, 8) AS gram FROM (SELECT text, unnest(range(0, length(text) - 7)) AS i FROM benchmark))
SELECT 'both' AS part, count(*) AS grams, min(gram) AS least FROM (SELECT gram FROM t INTERSECT SELECT gram FROM b) UNION ALL SELECT 'passages', count(*), min(gram) FROM (SELECT gram FROM b EXCEPT SELECT gram FROM t) UNION ALL SELECT 'any', count(*), min(gram) FROM (SELECT gram FROM t UNION SELECT gram FROM b)""",
    "scalar_functions": """SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, sum(date_diff('day', o_orderdate::DATE, (o_orderdate + INTERVAL 1 MONTH)::DATE))::BIGINT AS days, strftime(max((o_orderdate + INTERVAL 1 MONTH)::DATE), '%Y-%m-%d') AS last_due,
sum(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END)::BIGINT AS priority, count(*) FILTER (dayofweek(o_orderdate) = 0) AS sundays FROM orders GROUP BY ALL""",
    "json_values": "SELECT event_type, key, count(*) AS n, sum(val)::BIGINT AS total, max(val) AS most FROM (SELECT event_type, key, json_extract_string(props, '$.' || key)::BIGINT AS val FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events)) GROUP BY ALL",
    "psv_nsv_check": "SELECT 0::BIGINT AS bad",
    "rmq_descent": f"""WITH RECURSIVE {VALUES}, v AS (SELECT user_id, list(val ORDER BY idx) AS v FROM vals GROUP BY ALL),
walk(user_id, step, l, r) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, len(v)::BIGINT - 1 FROM v UNION ALL
SELECT user_id, step + 1, CASE WHEN m - l >= r - m THEN l ELSE m + 1 END, CASE WHEN m - l >= r - m THEN m - 1 ELSE r END FROM (SELECT w.*, l + list_position(v[l + 1:r + 1], list_min(v[l + 1:r + 1])) - 1 AS m FROM walk w JOIN v USING (user_id) WHERE l <= r) WHERE CASE WHEN m - l >= r - m THEN l <= m - 1 ELSE m + 1 <= r END)
SELECT user_id, step, l, r, l + list_position(v[l + 1:r + 1], list_min(v[l + 1:r + 1])) - 1 AS idx FROM walk JOIN v USING (user_id)""",
    "block_reductions": f"WITH RECURSIVE {REDUCED} SELECT doc_id, block, dest_block, delta_x, delta_d FROM reduced",
    "block_headers": f"WITH RECURSIVE {REDUCED} SELECT doc_id, dest_block, string_agg(delta_x || ':' || delta_d || ':' || block, ' ' ORDER BY delta_x, delta_d, block) AS header FROM reduced WHERE delta_d > 0 GROUP BY ALL",
    "block_delta_stats": f"WITH RECURSIVE {REDUCED} SELECT max(delta_x) AS max_x, round(avg(delta_x), 6) AS avg_x, max(delta_d) AS max_d, round(avg(delta_d), 6) AS avg_d FROM reduced",
    "chunk_filter": f"""WITH RECURSIVE {BLOCKS}, {FIRST_WORDS}, walk(pattern_id, doc_id, rest) AS (SELECT pattern_id, doc_id, pattern_id FROM heads CROSS JOIN names WHERE pattern_id <> '' UNION
SELECT w.pattern_id, w.doc_id, CASE WHEN starts_with(b.prefix, w.rest) THEN '' ELSE substring(w.rest, b.depth::INT + 1) END FROM walk w JOIN blk b ON b.doc_id = w.doc_id AND b.prefix <> '' AND w.rest <> '' AND (starts_with(b.prefix, w.rest) OR (starts_with(w.rest, b.prefix) AND b.depth = length(b.prefix))))
SELECT pattern_id, count(*) AS docs FROM walk WHERE rest = '' GROUP BY ALL""",
    "kgram_occ_between": f"WITH {pieces('documents', 3)} SELECT gram, count(*) AS occ FROM ({grams(4)}) GROUP BY gram HAVING count(*) BETWEEN 8 AND 12",
    "kgram_grid": grid(),
    "pattern_count": f"WITH {WORD_PLACES} SELECT w.pattern_id, count(p.pos) AS occurrences FROM words w LEFT JOIN places p USING (pattern_id) GROUP BY ALL",
    "indexed_count": f"WITH {WORD_PLACES} SELECT w.pattern_id, count(p.pos) AS occurrences FROM words w LEFT JOIN places p USING (pattern_id) GROUP BY ALL",
    "pattern_locate": f"WITH {PASSAGE_PLACES} SELECT pattern_id, doc_id, pos FROM places",
    "pattern_missing": "SELECT item_id AS pattern_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))",
    "pattern_batch_report": f"WITH {WORD_PLACES} SELECT count(*) AS patterns, sum(c)::BIGINT AS occurrences, count(*) FILTER (c > 0) AS found FROM (SELECT w.pattern_id, count(p.pos) AS c FROM words w LEFT JOIN places p USING (pattern_id) GROUP BY ALL)",
    "earliest_places": f"WITH {WORD_PLACES} SELECT pattern_id, rank, doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY doc_id, pos) AS rank FROM places) WHERE rank <= 3",
    "kwic_topk": f"""WITH {PASSAGE_PLACES}, ordered AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY doc_id, pos) AS rank FROM places)
SELECT pattern_id, rank, doc_id, pos, list_last(string_split(substring(text, greatest(pos - 10, 0) + 1, pos - greatest(pos - 10, 0)), chr(10))) AS "left", string_split(substring(text, pos + m + 1, 10), chr(10))[1] AS "right" FROM ordered WHERE rank <= 5""",
    "extract_span": "SELECT doc_id, CASE WHEN doc_id % 50 + 19 < length(text) THEN substring(text, doc_id % 50 + 1, 20) END AS span FROM documents",
    "matching_stats": MATCHES,
    "matching_stats_names": f"""WITH {NAMES}, pairs AS (SELECT a.doc_id AS id, a.text AS first, b.text AS second FROM names a JOIN names b ON b.doc_id = a.doc_id + 1)
SELECT id, pos, (SELECT coalesce(max(l), 0) FROM (SELECT unnest(range(1, length(second) - pos + 1)) AS l) WHERE contains(first, substring(second, pos + 1, l))) AS length FROM (SELECT id, first, second, unnest(range(0, length(second))) AS pos FROM pairs)""",
    "border_tables": f"""WITH {NAMES}, each AS (SELECT doc_id, pos, substring(text, 1, pos + 1) AS p FROM (SELECT doc_id, text, unnest(range(0, length(text))) AS pos FROM names))
SELECT doc_id, pos, coalesce(list_max(list_filter(range(1, length(p)), lambda l: left(p, l) = right(p, l))), 0) AS border FROM each""",
    "block_narrowing": f"WITH RECURSIVE {BLOCKS}, {FIRST_WORDS}, {NEAR_BLOCKS} SELECT pattern_id, answered, count(*) AS docs, sum(size)::BIGINT AS size, max(depth) AS depth FROM near GROUP BY ALL",
    "reverse_text": "SELECT doc_id, md5(reverse(text)) AS reversed_md5 FROM documents",
    "nul_check": "SELECT count(*) AS docs, count(*) FILTER (contains(text, chr(0))) AS with_nul, sum(length(text))::BIGINT AS symbols FROM documents",
    "word_bits": f"""WITH {NAMES}, places AS (SELECT doc_id, list_filter(range(0, 62), lambda b: (doc_id >> b) & 1 = 1) AS p FROM names)
SELECT doc_id, len(p)::BIGINT AS ones, list_max(p) AS highest, p[2] AS second, list_min(list_filter(p, lambda b: b > 3)) AS after3, list_max(list_filter(p, lambda b: b <= 3)) AS upto3 FROM places""",
    "alphabet_c_array": f"WITH {pieces('documents', 0)}, counts AS (SELECT gram AS sym, count(*) AS freq FROM ({grams(1)}) GROUP BY ALL) SELECT sym, row_number() OVER (ORDER BY sym) - 1 AS comp, freq, (sum(freq) OVER (ORDER BY sym) - freq)::BIGINT AS c_before FROM counts",
    "sigma": f"WITH {pieces('documents', 0)} SELECT count(DISTINCT gram) + 1 AS sigma FROM ({grams(1)})",
    "suffix_array": f"WITH {TURNS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY substring(text, pos + 1)) - 1 AS rank, pos FROM (SELECT doc_id, text, unnest(range(0, length(text) + 1)) AS pos FROM turns)",
    "inverse_suffix_array": f"WITH {TURN_SA} SELECT doc_id, pos AS at, rank AS isa FROM sa",
    "suffix_array_of_numbers": """WITH seqs AS (SELECT user_id AS seq_id, string_agg(left(event_type, 1), '' ORDER BY event_id) AS text FROM events GROUP BY ALL)
SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY substring(text, pos + 1)) - 1 AS rank, pos FROM (SELECT seq_id, text, unnest(range(0, length(text) + 1)) AS pos FROM seqs)""",
    "bwt_and_lcp": f"WITH {TURN_LCP} SELECT doc_id, rank, bwt, lcp FROM lcps",
    "psi_and_lf": f"WITH {PSI} SELECT doc_id, rank, pos, psi, lf FROM links",
    "psi_three_times": f"WITH {TURN_SA} SELECT a.doc_id, a.rank, b.rank AS to FROM sa a JOIN sa b ON a.doc_id = b.doc_id AND b.pos = (a.pos + 3) % a.n".replace("AS to", 'AS "to"'),
    "suffix_array_check": "SELECT 0::BIGINT AS bad",
    "first_row_symbols": f"WITH {TURN_SA} SELECT doc_id, rank, substring(suffix, 1, 1) AS sym FROM sa",
    "backward_steps": f"""WITH {TURN_SA}, syms AS (SELECT DISTINCT doc_id, substring(suffix, 1, 1) AS sym FROM sa WHERE suffix <> '') SELECT s.doc_id, s.sym, 0::BIGINT AS lb, max(n) - 1 AS rb, min(rank) FILTER (starts_with(suffix, sym)) AS new_lb, max(rank) FILTER (starts_with(suffix, sym)) AS new_rb
FROM syms s JOIN sa USING (doc_id) GROUP BY s.doc_id, s.sym""",
    "bwt_rank": f"WITH {TURN_LCP} SELECT doc_id, rank AS pos, bwt AS sym, row_number() OVER (PARTITION BY doc_id, bwt ORDER BY rank) - 1 AS rank FROM lcps",
    "text_statistics": f"""WITH {TURN_LCP}, x AS (SELECT doc_id, lcp, bwt = lag(bwt) OVER (PARTITION BY doc_id ORDER BY rank) AS same FROM lcps)
SELECT doc_id, count(*) AS n, count(*) - count(*) FILTER (same) AS runs, round(100.0 * count(*) FILTER (same) / count(*), 6) AS equal_percent, round(avg(lcp), 6) AS mean_lcp FROM x GROUP BY ALL""",
    "lcp_info": f"WITH {TURN_LCP} SELECT doc_id, max(lcp) AS max_lcp, sum(lcp)::BIGINT AS sum_lcp, round(avg(lcp), 6) AS mean_lcp FROM lcps GROUP BY ALL",
    "entropy_h0": f"WITH {pieces('documents', 0)} {entropy(0, 'documents')}",
    "entropy_hk": f"WITH {TURNS}, {pieces('turns', 4)} " + " UNION ALL ".join(entropy(k, "turns") for k in range(5)),
    "lcp_entropy": f"WITH {TURN_LCP}, c AS (SELECT count(*)::DOUBLE AS m FROM lcps GROUP BY lcp) SELECT round(log2(sum(m)) - sum(m * log2(m)) / sum(m), 6) AS h0 FROM c",
    "suffix_dump": f"WITH {PSI} SELECT l.doc_id, l.rank, CASE WHEN l.pos = 0 THEN '' ELSE substring(text, l.pos, 1) END AS bwt, psi, lf, l.pos, substring(suffix, 1, 5) AS head FROM links l JOIN sa USING (doc_id, rank)",
    "blocks_heavy_light": f"WITH {BLOCKS} SELECT doc_id, block, prefix, depth, size, reducible FROM blk",
    "block_stats": f"""WITH {BLOCKS} SELECT sum(size)::BIGINT AS n, count(*) AS k, count(*) FILTER (size = 1) AS k_s, count(*) FILTER (reducible) AS k_re, count(*) FILTER (size > 1 AND NOT reducible) AS k_ir,
coalesce(sum(size) FILTER (size > 1 AND NOT reducible), 0)::BIGINT AS n_ir, max(depth) AS max_depth FROM blk""",
    "block_trie_nodes": f"""WITH {BLOCKS}, heavy AS (SELECT doc_id, count(*) AS h FROM (SELECT doc_id, prefix FROM prefixes GROUP BY ALL HAVING count(*) > {B}) GROUP BY ALL), b AS (SELECT doc_id, count(*) AS blocks FROM blk GROUP BY ALL)
SELECT doc_id, 1 + coalesce(h, 0) + blocks AS nodes, blocks FROM b LEFT JOIN heavy USING (doc_id)""",
    "block_minimal_depths": f"WITH {BLOCKS} SELECT doc_id, block AS lb, min(depth) AS min_depth FROM blk GROUP BY ALL",
    "singleton_pointers": f"WITH {BLOCKS} SELECT doc_id, block, min(pos) AS pos FROM bt GROUP BY ALL HAVING count(*) = 1",
    "blocks_under_prefix": f"WITH {BLOCKS}, heads AS (SELECT DISTINCT left(string_split(text, ' ')[1], 1) AS pattern_id FROM names) SELECT pattern_id, doc_id, block, depth, size FROM blk JOIN heads ON starts_with(prefix, pattern_id)",
    "factor_search": f"WITH {NAMES}, each AS (SELECT doc_id, text, string_split(text, ' ')[1] AS pattern, unnest(range(0, length(text))) AS pos FROM names) SELECT doc_id, pattern, pos FROM each WHERE substring(text, pos + 1, length(pattern)) = pattern",
    "condensed_bwt": f"WITH {BLOCKS} SELECT doc_id, rank, bwt FROM bt WHERE rank = block",
    "greedy_parse": f"WITH RECURSIVE {PARSE} SELECT doc_id, factor_no, block, start_pos, depth, factor_no % 2 = 0 AS border FROM fac",
    "factor_positions": f"WITH RECURSIVE {PARSE} SELECT s.doc_id, s.pos, max(factor_no) AS factor_no FROM sa s JOIN fac f ON s.doc_id = f.doc_id AND f.start_pos <= s.pos GROUP BY ALL",
    "factor_freq_hist": f"WITH RECURSIVE {PARSE}, used AS (SELECT doc_id, block, count(*) AS c FROM fac GROUP BY ALL) SELECT coalesce(c, 0) AS freq, count(*) AS blocks FROM blk LEFT JOIN used USING (doc_id, block) GROUP BY ALL",
    "parse_report": f"""WITH RECURSIVE {PARSE}, f AS (SELECT doc_id, count(*) AS factors FROM fac GROUP BY ALL), b AS (SELECT doc_id, count(*) AS blocks, sum(size) AS n FROM blk GROUP BY ALL)
SELECT doc_id, factors, blocks, round(n / factors, 6) AS mean_length, length(ltrim(bin(greatest(blocks - 1, 1)), '0')) AS bits FROM f JOIN b USING (doc_id)""",
    "reconstruct_text": f"WITH {NAMES} SELECT doc_id, text FROM names",
    "reconstruct_turns": f"WITH {TURNS} SELECT doc_id, text FROM turns",
    "tree_nodes": f"WITH {TREE} SELECT doc_id, lb, rb, depth, node_depth, parent_lb, parent_rb FROM tree",
    "tree_children": f"""WITH {TREE} SELECT t.doc_id, parent_lb, parent_rb, row_number() OVER w AS child_no, substring(text, pos + parent_depth + 1, 1) AS sym, lb, rb, depth, lead(lb) OVER w AS sibling_lb, lead(rb) OVER w AS sibling_rb
FROM tree t JOIN sa ON sa.doc_id = t.doc_id AND sa.rank = t.lb WHERE parent_lb IS NOT NULL WINDOW w AS (PARTITION BY t.doc_id, parent_lb, parent_rb ORDER BY lb)""",
    "tree_degrees": f"WITH {TREE} SELECT doc_id, parent_lb AS lb, parent_rb AS rb, count(*) AS degree FROM tree WHERE parent_lb IS NOT NULL GROUP BY ALL",
    "tree_orders": f"""WITH {TREE} SELECT doc_id, lb, rb, row_number() OVER (PARTITION BY doc_id ORDER BY (lb < rb)::INT, lb, rb DESC) - 1 AS node_id, row_number() OVER (PARTITION BY doc_id ORDER BY lb, rb DESC) - 1 AS preorder,
row_number() OVER (PARTITION BY doc_id ORDER BY rb, lb DESC) - 1 AS postorder, row_number() OVER (PARTITION BY doc_id ORDER BY node_depth, lb) - 1 AS breadth_first FROM tree""",
    "tree_labels": f"WITH {TREE} SELECT t.doc_id, lb, rb, substring(text, pos + 1, depth) AS label, CASE WHEN depth > 0 THEN substring(text, pos + 1, 1) END AS first FROM tree t JOIN sa ON sa.doc_id = t.doc_id AND sa.rank = t.lb",
    "tree_lca": f"""WITH {TURN_TREE}, spans AS (SELECT doc_id, rank AS span FROM lcps WHERE rank + 2 < n) SELECT s.doc_id, span, arg_max(lb, depth) AS lca_lb, arg_max(rb, depth) AS lca_rb, max(depth) AS lca_depth
FROM spans s JOIN inner_nodes t ON s.doc_id = t.doc_id AND lb <= span AND rb >= span + 2 GROUP BY ALL""",
    "tree_nodes_turns": f"""WITH {TURN_TREE}, held AS (SELECT a.doc_id, a.lb, a.rb, a.depth, b.lb AS up_lb, b.rb AS up_rb, b.depth AS up_depth FROM nodes a LEFT JOIN inner_nodes b ON a.doc_id = b.doc_id AND b.lb <= a.lb AND b.rb >= a.rb AND b.depth < a.depth)
SELECT doc_id, lb, rb, depth, count(up_lb) AS node_depth, arg_max(up_lb, up_depth) AS parent_lb, arg_max(up_rb, up_depth) AS parent_rb FROM held GROUP BY ALL""",
    "tree_walk": f"WITH {SA}, {FIRST_WORDS} SELECT pattern_id, doc_id, min(rank) AS lb, max(rank) AS rb FROM sa JOIN heads ON starts_with(suffix, pattern_id) GROUP BY ALL",
    "tree_select_leaf": f"WITH {SA} SELECT d.doc_id, 3::BIGINT AS i, rank AS lb, rank AS rb, n - pos AS depth FROM names d LEFT JOIN sa ON sa.doc_id = d.doc_id AND rank = 2",
    "tree_inv_id": f"""WITH {TREE}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (lb < rb)::INT, lb, rb DESC) - 1 AS node_id FROM nodes)
SELECT d.doc_id, length(d.text) + 1 AS node_id, lb, rb, depth FROM names d LEFT JOIN numbered t ON t.doc_id = d.doc_id AND t.node_id = length(d.text) + 1""",
    "tree_skipped": f"WITH {TREE}, heads AS (SELECT * FROM nodes WHERE depth = 1 AND lb < rb) SELECT doc_id, lb, rb FROM nodes a WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = a.doc_id AND h.lb <= a.lb AND h.rb >= a.rb AND h.depth < a.depth)",
    "double_enclose": f"""WITH {TREE}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lb, rb DESC) - 1 AS pre FROM tree), opens AS (SELECT doc_id, lb, rb, node_depth, 2 * pre - node_depth AS o FROM numbered),
asked AS (SELECT a.doc_id, a.lb AS query, a.o AS i, b.o AS j FROM opens a JOIN opens b ON a.doc_id = b.doc_id AND a.lb = a.rb AND b.lb = b.rb AND b.lb = a.lb + 2),
around AS (SELECT k.doc_id, k.query, max(o) AS double_enclose FROM asked k JOIN opens t ON t.doc_id = k.doc_id AND t.lb <= k.query AND t.rb >= k.query + 2 GROUP BY ALL),
inside AS (SELECT k.doc_id, k.query, min(o) AS rr_enclose FROM asked k JOIN opens t ON t.doc_id = k.doc_id AND t.lb > k.query AND t.lb <= k.query + 2 AND t.rb >= k.query + 2 AND t.lb < t.rb GROUP BY ALL)
SELECT doc_id, query, i, j, double_enclose, rr_enclose FROM asked LEFT JOIN around USING (doc_id, query) LEFT JOIN inside USING (doc_id, query)""",
    "tree_suffix_links": f"""WITH {TREE}, labelled AS (SELECT t.doc_id, lb, rb, depth, substring(text || chr(1), pos + 1, depth) AS label FROM nodes t JOIN sa ON sa.doc_id = t.doc_id AND sa.rank = t.lb)
SELECT a.doc_id, a.lb, a.rb, b.lb AS link_lb, b.rb AS link_rb FROM labelled a JOIN labelled b ON a.doc_id = b.doc_id AND b.label = substring(a.label, 2) AND b.depth = a.depth - 1 WHERE (a.depth > 0 AND a.lb < a.rb) OR (a.lb = a.rb AND a.depth > 1)""",
    "tree_weiner_links": f"""WITH {TREE}, labelled AS (SELECT t.doc_id, lb, rb, depth, substring(text || chr(1), pos + 1, depth) AS label FROM nodes t JOIN sa ON sa.doc_id = t.doc_id AND sa.rank = t.lb),
longer AS (SELECT l.doc_id, l.lb, l.rb, s.rank, substring(s.suffix, 1, 1) AS sym FROM labelled l JOIN sa s ON s.doc_id = l.doc_id AND s.suffix <> '' AND starts_with(substring(s.suffix || chr(1), 2), l.label))
SELECT doc_id, lb, rb, sym, min(rank) AS link_lb, max(rank) AS link_rb FROM longer GROUP BY ALL""",
    "tree_entropy": f"""WITH {TREE}, m AS (SELECT doc_id, parent_lb AS lb, parent_rb AS rb, (rb - lb + 1)::DOUBLE / (parent_rb - parent_lb + 1) AS p FROM tree WHERE parent_lb IS NOT NULL)
SELECT doc_id, lb, rb, round(sum(-p * log2(p)), 6) AS h0 FROM m GROUP BY ALL""",
    "tree_parentheses": f"""WITH {TREE}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lb, rb DESC) - 1 AS pre FROM tree), inside AS (SELECT a.doc_id, a.lb, a.rb, count(*) AS c FROM tree a JOIN tree b ON a.doc_id = b.doc_id AND b.lb >= a.lb AND b.rb <= a.rb AND b.node_depth >= a.node_depth GROUP BY ALL),
pairs AS (SELECT doc_id, lb, rb, 2 * pre - node_depth AS "open", 2 * pre - node_depth + 2 * c - 1 AS "close", node_depth + 1 AS level, parent_lb, parent_rb FROM numbered JOIN inside USING (doc_id, lb, rb))
SELECT a.doc_id, a."open", a."close", a.level, b."open" AS enclose FROM pairs a LEFT JOIN pairs b ON a.doc_id = b.doc_id AND a.parent_lb = b.lb AND a.parent_rb = b.rb""",
    "symbol_access": f"WITH {SEQ}, {windows(64)} SELECT i AS pos, sym FROM ranges LEFT JOIN seq ON seq.pos = i",
    "symbol_rank": f"WITH {SEQ} SELECT a.pos AS query, a.pos * 2 AS i, a.sym, count(b.pos) AS rank FROM seq a LEFT JOIN seq b ON a.sym = b.sym AND b.pos < a.pos * 2 GROUP BY ALL",
    "symbol_select": f"WITH {SEQ}, js(j) AS (VALUES (1), (2), (5), (100000)), r AS (SELECT pos, sym, row_number() OVER (PARTITION BY sym ORDER BY pos) AS j FROM seq) SELECT s.sym, js.j::BIGINT AS j, r.pos FROM (SELECT DISTINCT sym FROM seq) s CROSS JOIN js LEFT JOIN r ON r.sym = s.sym AND r.j = js.j",
    "symbol_inverse_select": f"WITH {SEQ} SELECT pos, sym, row_number() OVER (PARTITION BY sym ORDER BY pos) - 1 AS rank FROM seq",
    "interval_symbols": f"WITH {SEQ}, {windows(100)}, r AS (SELECT pos, sym, row_number() OVER (PARTITION BY sym ORDER BY pos) - 1 AS rank FROM seq) SELECT query, sym, min(rank) AS rank_i, max(rank) + 1 AS rank_j FROM ranges JOIN r ON pos >= i AND pos < j GROUP BY ALL",
    "count_lex_smaller": f"WITH {SEQ}, {windows(100)}, asked AS (SELECT *, query * 7 % 150 AS sym FROM ranges) SELECT query, i, j, a.sym, count(*) FILTER (s.sym < a.sym) AS smaller FROM asked a LEFT JOIN seq s ON pos >= i AND pos < j GROUP BY ALL",
    "range_search_2d": "WITH ends AS (SELECT max(l_orderkey * 8 + l_linenumber) // 25 AS step FROM lineitem) SELECT n_nationkey::BIGINT AS query, l_orderkey * 8 + l_linenumber AS pos, l_quantity AS value FROM nation CROSS JOIN ends JOIN lineitem ON l_orderkey * 8 + l_linenumber BETWEEN n_nationkey * step AND n_nationkey * step + step // 4 AND l_quantity BETWEEN n_nationkey AND n_nationkey + 5",
    "symbol_runs": """WITH x AS (SELECT user_id, event_id AS pos, event_type AS sym, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
SELECT user_id, min(pos) AS start, sym, count(*) AS length FROM x GROUP BY user_id, sym, island""",
    "bit_rank": f"""WITH {ERRORS} SELECT user_id, pos, coalesce(sum(b) OVER w, 0)::BIGINT AS rank1, coalesce(sum(1 - b) OVER w, 0)::BIGINT AS rank0, coalesce(sum((p = 1 AND b = 0)::INT) OVER w, 0)::BIGINT AS rank10, coalesce(sum((p = 0 AND b = 1)::INT) OVER w, 0)::BIGINT AS rank01
FROM bits WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "bit_select": f"""WITH {ERRORS}, each AS (SELECT user_id, pos, b::VARCHAR AS pattern FROM bits UNION ALL SELECT user_id, pos, p::VARCHAR || b::VARCHAR FROM bits WHERE p <> b)
SELECT user_id, pos, pattern, row_number() OVER (PARTITION BY user_id, pattern ORDER BY pos) AS j FROM each""",
    "onezero_count": f"WITH {ERRORS} SELECT user_id, sum(b)::BIGINT AS ones, count(*) FILTER (p = 1 AND b = 0) AS pairs10, count(*) FILTER (p = 0 AND b = 1) AS pairs01 FROM bits GROUP BY ALL",
    "nearest_one": f"""WITH {ERRORS} SELECT user_id, pos, max(CASE WHEN b = 1 THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS previous, min(CASE WHEN b = 1 THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM bits""",
    "nearest_one_after_changes": f"""WITH {ERRORS}, changed AS (SELECT user_id, pos, CASE WHEN lo = hi THEN b WHEN pos = lo THEN 1 WHEN pos = hi THEN 0 ELSE b END AS b FROM (SELECT *, min(pos) OVER (PARTITION BY user_id) AS lo, max(pos) OVER (PARTITION BY user_id) AS hi FROM bits))
SELECT user_id, pos, max(CASE WHEN b = 1 THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS previous, min(CASE WHEN b = 1 THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM changed""",
    "rmq_windows": "WITH " + RMQ.format(ranges=windows(100), pick="arg_min(event_id, (value, event_id))"),
    "rmaxq_windows": "WITH " + RMQ.format(ranges=windows(100), pick="arg_max(event_id, (value, -event_id))"),
    "psv_nsv": f"""WITH {VALUES} SELECT a.user_id, a.idx, a.val, max(b.idx) FILTER (b.idx < a.idx) AS psv, min(b.idx) FILTER (b.idx > a.idx) AS nsv FROM vals a LEFT JOIN vals b ON a.user_id = b.user_id AND b.val < a.val GROUP BY ALL""",
    "element_fills": "SELECT length(ltrim(bin(max(event_id % 7)), '0')) AS bits_mod, length(ltrim(bin(max(event_id)), '0')) AS bits_id, sum(event_id % 7)::BIGINT AS sum_mod FROM events",
    "ordinal_tree": f"WITH {PLACES} SELECT p.child, p.parent, CASE WHEN p.parent IS NOT NULL THEN row_number() OVER (PARTITION BY p.parent ORDER BY p.child) END AS child_no, (SELECT count(*) FROM places q WHERE q.parent = p.child) AS degree FROM places p",
    "louds_bits": f"""WITH RECURSIVE {PLACES}, walk(child, path, depth) AS (SELECT child, [child], 0 FROM places WHERE parent IS NULL UNION ALL SELECT p.child, list_append(w.path, p.child), w.depth + 1 FROM places p JOIN walk w ON p.parent = w.child),
deg AS (SELECT w.child, w.path, w.depth, (SELECT count(*) FROM places q WHERE q.parent = w.child) AS d FROM walk w), ord AS (SELECT *, sum(d + 1) OVER (ORDER BY depth, path) - d - 1 AS first FROM deg)
SELECT (first + k)::BIGINT AS pos, CASE WHEN k < d THEN 1 ELSE 0 END AS bit FROM (SELECT first, d, unnest(range(0, d + 1)) AS k FROM ord)""",
    "kv_log_pivot": """SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS record, event_id::DOUBLE AS event, user_id::DOUBLE AS "user", json_extract_string(props, '$.k')::DOUBLE AS k FROM events""",
    "phase_costs": """WITH m AS (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS mean FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linenumber, round(mean, 4) AS mean, round(mean - coalesce(lag(mean) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber), 0), 4) AS cost FROM m""",
    "mean_table": """SELECT l_linenumber, round(avg(l_quantity) FILTER (l_returnflag = 'A') * 1000 / 1000, 6) AS A, round(avg(l_quantity) FILTER (l_returnflag = 'N') * 1000 / 1000, 6) AS N, round(avg(l_quantity) FILTER (l_returnflag = 'R') * 1000 / 1000, 6) AS R FROM lineitem GROUP BY ALL""",
}
