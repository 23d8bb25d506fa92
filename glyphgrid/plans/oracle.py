"""SQL for DuckDB that gives the results of the catalogue's queries by other means."""

from __future__ import annotations

CONVERSATIONS = "t AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
DOCUMENTS = "t AS (SELECT doc_id, text FROM documents)"
BENCHMARK = "t AS (SELECT item_id AS doc_id, text FROM benchmark)"
#: characters with positions from 0
CH = "ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS p FROM t WHERE text <> '')"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def leads(n: int) -> str:
    return ", ".join(["c AS c0", *[f"lead(c, {k}) OVER w AS c{k}" for k in range(1, n)]])


def grams(n: int, texts: str = DOCUMENTS) -> str:
    """g(doc_id, p, gram): every window of n characters."""
    parts = " || ".join(f"c{k}" for k in range(n))
    return f"WITH {texts}, {CH}, g0 AS (SELECT doc_id, p, {leads(n)} FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY p)), g AS (SELECT doc_id, p, {parts} AS gram FROM g0 WHERE c{n - 1} IS NOT NULL) "


def hit(pattern: str) -> str:
    return " AND ".join(f"c{k} = {quote(c)}" for k, c in enumerate(pattern))


def windows(n: int, texts: str = DOCUMENTS) -> str:
    return f"WITH {texts}, {CH}, g AS (SELECT doc_id, p, {leads(n)} FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY p)) "


def count_patterns(patterns: tuple[str, ...], texts: str = DOCUMENTS) -> str:
    rows = " UNION ALL ".join(f"SELECT {quote(p)} AS pattern, count(*) FILTER (WHERE {hit(p)}) AS occ FROM g" for p in patterns)
    return windows(max(map(len, patterns)), texts) + rows


def index_count(patterns: tuple[str, ...], texts: str = DOCUMENTS) -> str:
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS pattern_id, count(*) FILTER (WHERE {hit(p)}) AS occ FROM g" for i, p in enumerate(patterns))
    return windows(max(map(len, patterns)), texts) + rows


def count_per_doc(pattern: str) -> str:
    return windows(len(pattern)) + f"SELECT t.doc_id, count(g.p) AS occ FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND {hit(pattern)} GROUP BY 1"


def overlapping_and_disjoint(patterns: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {quote(p)} AS pattern, (SELECT count(*) FROM g WHERE {hit(p)}) AS overlapping, (SELECT CAST(sum((length(text) - length(replace(text, {quote(p)}, ''))) // {len(p)}) AS BIGINT) FROM t) AS disjoint" for p in patterns
    )
    return windows(max(map(len, patterns))) + rows


DRAW = "(({i}) * 1103515245 + 12345) % ({n})"
BEGIN_12 = DRAW.format(i="doc_id", n="length(text) - 11")
SAMPLE = f"SELECT doc_id AS pattern_id, doc_id, {BEGIN_12} AS begin, substr(text, {BEGIN_12} + 1, 12) AS pattern FROM documents WHERE length(text) >= 12"
COUNT_BATCH_FIXED = grams(12) + f", pat AS ({SAMPLE}), counts AS (SELECT gram, count(*) AS n FROM g GROUP BY 1) SELECT pattern_id, coalesce(n, 0) AS occ FROM pat LEFT JOIN counts ON pattern = gram"


def sweep(table: str, high: int) -> str:
    begin = DRAW.format(i="doc_id + size", n="length(text) - size + 1")
    return f"SELECT doc_id * 1024 + size AS pattern_id, doc_id, size, {begin} AS begin, substr(text, {begin} + 1, size) AS pattern FROM {table}, (SELECT CAST(pow(2, unnest(range(0, {high + 1}))) AS BIGINT) AS size) WHERE length(text) >= size"


SWEEP = f"WITH {DOCUMENTS} " + sweep("t", 8)
COUNT_BATCH_VARLEN = f"""WITH {CONVERSATIONS}, pat AS ({sweep("t", 6)}),
sizes AS (SELECT DISTINCT size FROM pat),
win AS (SELECT size, substr(text, p + 1, size) AS gram FROM (SELECT text, size, unnest(range(0, length(text) - size + 1)) AS p FROM t, sizes WHERE length(text) >= size)),
counts AS (SELECT gram, count(*) AS n FROM win GROUP BY size, gram)
SELECT pattern_id, coalesce(n, 0) AS occ FROM pat LEFT JOIN counts ON pattern = gram"""
COUNT_ABSENT = f"""WITH {DOCUMENTS}, {CH}, alphabet AS (SELECT DISTINCT c FROM ch),
pat(pattern_id, pattern) AS (VALUES (CAST(1 AS BIGINT), 'a☃'), (2, 'the'), (3, 'Жук'), (4, 'tion of')),
own AS (SELECT pattern_id, unnest(string_split(pattern, '')) AS c FROM pat)
SELECT pattern_id, pattern, CAST(0 AS BIGINT) AS occ FROM pat WHERE pattern_id IN (SELECT pattern_id FROM own WHERE c NOT IN (SELECT c FROM alphabet))"""
GRAMS_4 = grams(4) + "SELECT gram, count(*) AS cnt FROM g GROUP BY 1"
DIFF_CHECK = grams(6, CONVERSATIONS) + f""", pat AS (SELECT doc_id AS pattern_id, substr(text, {DRAW.format(i="doc_id", n="length(text) - 5")} + 1, 6) AS pattern FROM t WHERE length(text) >= 6),
c AS (SELECT gram, count(*) AS n FROM g GROUP BY 1) SELECT count(*) FILTER (WHERE n IS NULL) AS mismatches, count(*) AS total, CAST(sum(n) AS BIGINT) AS one, CAST(sum(n) AS BIGINT) AS other FROM pat LEFT JOIN c ON pattern = gram"""


def locate(pattern: str, most: int | None = None) -> str:
    first = f" QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) <= {most}" if most else ""
    return windows(len(pattern)) + f"SELECT doc_id, p AS pos FROM g WHERE {hit(pattern)}" + first


def display_context(pattern: str, around: int) -> str:
    return windows(len(pattern)) + f"SELECT doc_id, p AS pos, substr(text, greatest(p - {around}, 0) + 1, p + {len(pattern) + around} - greatest(p - {around}, 0)) AS context FROM g JOIN t USING (doc_id) WHERE {hit(pattern)}"


def doc_counts(patterns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {quote(p)} AS pattern, count(*) FILTER (WHERE contains(text, {quote(p)})) AS df FROM documents" for p in patterns)


LISTING_RUNS = "SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS island FROM documents WHERE contains(text, 'the')) GROUP BY island"
CONTAINMENT = """SELECT doc_id, item_id, CAST((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS BIGINT) AS occ
FROM documents d JOIN benchmark b ON contains(d.text, b.text)"""

ALPHABET = "alphabet AS (SELECT c, row_number() OVER (ORDER BY c) AS symbol FROM (SELECT DISTINCT c FROM ch))"
SYMBOL_TABLE = f"WITH {DOCUMENTS}, {CH}, {ALPHABET} SELECT c AS ch, symbol FROM alphabet"
ENCODE = f"WITH {CONVERSATIONS}, {CH}, {ALPHABET} SELECT doc_id, p AS pos, symbol FROM ch JOIN alphabet USING (c)"
TEXT_PARAMS = "SELECT doc_id, length(text) + 1 AS n, len(list_distinct(string_split(text, ''))) + 1 AS sigma FROM documents"
WIDTH = f"SELECT doc_id, CAST(ceil(log2(sigma)) AS BIGINT) AS width FROM ({TEXT_PARAMS})"


def typed(texts: str = CONVERSATIONS) -> str:
    """ty(doc_id, p, c, kind), bo(doc_id, p, c, sl, sl_start): suffix types, and the factor of each position."""
    return f"""WITH {texts}, {CH},
cmp AS (SELECT doc_id, p, c, CASE WHEN nx IS NULL OR c > nx THEN 'L' WHEN c < nx THEN 'S' END AS s FROM (SELECT *, lead(c) OVER (PARTITION BY doc_id ORDER BY p) AS nx FROM ch)),
ty AS (SELECT doc_id, p, c, last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind FROM cmp),
lm AS (SELECT *, coalesce(kind = 'S' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY p) = 'L', false) AS lms FROM ty),
sl AS (SELECT *, CAST(sum(CAST(lms AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS BIGINT) AS sl FROM lm),
bo AS (SELECT *, min(p) OVER (PARTITION BY doc_id, sl) AS sl_start FROM sl)"""


SL_TYPES = typed() + " SELECT doc_id, p AS pos, kind FROM ty"
LMS = typed() + " SELECT doc_id, p AS pos FROM lm WHERE lms"
SL_FACTORS = typed() + " SELECT doc_id, sl, min(p) AS start, count(*) AS len FROM bo GROUP BY 1, 2"


def blocks(lam: int, texts: str) -> str:
    """f(doc_id, start, len, factor, ord)."""
    return typed(texts) + f""",
f0 AS (SELECT doc_id, sl, (p - sl_start) // {lam} AS b, min(p) AS start, count(*) AS len, string_agg(c, '' ORDER BY p) AS factor FROM bo GROUP BY 1, 2, 3),
f AS (SELECT doc_id, start, len, factor, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS ord FROM f0)"""


def factors(lam: int) -> str:
    return blocks(lam, CONVERSATIONS) + " SELECT doc_id, ord, start, len, factor FROM f"


LAMBDAS = " UNION ALL ".join(f"SELECT * FROM ({blocks(k, BENCHMARK)} SELECT CAST({k} AS BIGINT) AS lambda, count(*) AS blocks, count(DISTINCT factor) AS factors, CAST(sum(len) AS BIGINT) AS chars FROM f)" for k in range(1, 9))


DICTIONARY = "d0 AS (SELECT factor, count(*) AS freq FROM f GROUP BY 1), d AS (SELECT factor, freq, row_number() OVER (ORDER BY factor) AS lex_id, CAST(sum(freq) OVER (ORDER BY factor) - freq AS BIGINT) AS bucket_start FROM d0)"
LEX_DICTIONARY = blocks(4, DOCUMENTS) + f", {DICTIONARY} SELECT factor, lex_id, freq, bucket_start FROM d"
COLEX_DICTIONARY = blocks(4, DOCUMENTS) + f", {DICTIONARY} SELECT reverse(factor) AS rev, row_number() OVER (ORDER BY reverse(factor)) AS colex_id, lex_id FROM d"
LEX_TEXT = blocks(4, CONVERSATIONS) + f", {DICTIONARY} SELECT doc_id, ord, lex_id FROM f JOIN d USING (factor)"
INNER = """s AS (SELECT substr(factor, a, n) AS sub, freq FROM (SELECT factor, freq, a, unnest(range(1, length(factor) - a + 1)) AS n FROM (SELECT factor, freq, unnest(range(2, length(factor))) AS a FROM d WHERE length(factor) > 2))),
su AS (SELECT sub, CAST(sum(freq) AS BIGINT) AS cnt FROM s GROUP BY 1)"""
SUB_FACTORS = blocks(7, DOCUMENTS) + f", {DICTIONARY}, {INNER} SELECT sub, cnt FROM su"
TRIE_DEPTH = blocks(7, DOCUMENTS) + f", {DICTIONARY}, {INNER} SELECT length(sub) AS depth, count(*) AS nodes FROM su GROUP BY 1"
INDEX_PARAMS = blocks(4, DOCUMENTS) + " SELECT doc_id, count(*) + 1 AS n, count(DISTINCT factor) + 1 AS sigma FROM f GROUP BY 1"
INDEX_RUNS = blocks(4, BENCHMARK) + """,
seq AS (SELECT doc_id, list(factor ORDER BY ord) AS l FROM f GROUP BY 1),
rot AS (SELECT doc_id, i, CASE WHEN i = 0 THEN '' ELSE l[i] END AS before, l[i + 1:] AS rest FROM (SELECT doc_id, l, unnest(range(0, len(l) + 1)) AS i FROM seq)),
o AS (SELECT doc_id, before, row_number() OVER (PARTITION BY doc_id ORDER BY rest) AS row FROM rot)
SELECT doc_id, CAST(count(*) AS BIGINT) AS r FROM (SELECT doc_id, before, lag(before) OVER (PARTITION BY doc_id ORDER BY row) AS b FROM o) WHERE b IS NULL OR b <> before GROUP BY 1"""


INDEX_PARAMETERS = f"SELECT * FROM ({INDEX_RUNS}) JOIN ({blocks(4, BENCHMARK)} SELECT doc_id, count(*) + 1 AS n, count(DISTINCT factor) + 1 AS sigma FROM f GROUP BY 1) USING (doc_id)"


def range_counts(patterns: tuple[str, ...], prefix: bool) -> str:
    test = "starts_with(factor, {p})" if prefix else "ends_with(factor, {p}) AND factor <> {p}"
    return blocks(4, DOCUMENTS) + " " + " UNION ALL ".join(f"SELECT {quote(p)} AS p, count(*) FILTER (WHERE {test.format(p=quote(p))}) AS freq FROM f" for p in patterns)


def decomposition(patterns: tuple[str, ...], lam: int) -> str:
    n = max(map(len, patterns))
    head = typed(DOCUMENTS) + f""",
pl AS (SELECT doc_id, p, sl_start + ((p - sl_start) // {lam}) * {lam} AS a, least(sl_start + ((p - sl_start) // {lam}) * {lam} + {lam - 1}, max(p) OVER (PARTITION BY doc_id, sl)) AS z, {leads(n)} FROM bo WINDOW w AS (PARTITION BY doc_id ORDER BY p))"""
    rows = []
    for p in patterns:
        last = f"p + {len(p) - 1}"
        where = {"prefix_full": f"p = a AND {last} <= z", "suffix": f"p > a AND {last} = z", "interior": f"p > a AND {last} < z", "spanning": f"{last} > z"}
        rows.append(f"SELECT {quote(p)} AS p, " + ", ".join(f"count(*) FILTER (WHERE {w}) AS {k}" for k, w in where.items()) + f", count(*) AS total FROM pl WHERE {hit(p)}")
    return head + " " + " UNION ALL ".join(rows)


SUFFIXES = f"""WITH {CONVERSATIONS},
x AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN '' ELSE substr(text, pos, 1) END AS ch, row_number() OVER (PARTITION BY doc_id ORDER BY substr(text, pos + 1)) - 1 AS row, length(text) + 1 AS n
FROM (SELECT doc_id, text, unnest(range(0, length(text) + 1)) AS pos FROM t))"""


def suffixes(columns: str) -> str:
    return SUFFIXES + f" SELECT {columns} FROM x"


HEADS = ", h AS (SELECT *, CASE WHEN lag(ch) OVER (PARTITION BY doc_id ORDER BY row) <> ch THEN 1 ELSE 0 END AS head FROM x), r AS (SELECT *, CAST(sum(head) OVER (PARTITION BY doc_id ORDER BY row) AS BIGINT) AS run_id FROM h)"
BWT_RUNS_R = SUFFIXES + HEADS + " SELECT doc_id, max(run_id) + 1 AS r FROM r GROUP BY 1"
BWT_RUNS = SUFFIXES + HEADS + " SELECT doc_id, run_id, min(row) AS start, count(*) AS len, min(ch) AS ch FROM r GROUP BY 1, 2"
ASKED = "q AS (SELECT doc_id, (length(text) + 1) // 2 AS at, CAST(3 AS BIGINT) AS k, unnest(['e', 't', 'a']) AS ch FROM t)"
RANK = SUFFIXES + f", {ASKED} SELECT q.doc_id, q.at, q.ch, count(*) FILTER (WHERE x.row < q.at) AS rank FROM q LEFT JOIN x ON x.doc_id = q.doc_id AND x.ch = q.ch GROUP BY 1, 2, 3"
SELECT = SUFFIXES + f", {ASKED}, y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ch ORDER BY row) AS k FROM x) SELECT doc_id, ch, k, row FROM q JOIN y USING (doc_id, ch, k)"
# the row of the whole text follows the empty suffix, whose row is 0
LF = SUFFIXES + " SELECT doc_id, row, coalesce(lag(row) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS lf FROM x"
PSI = SUFFIXES + " SELECT doc_id, row, coalesce(lead(row) OVER w, min(CASE WHEN pos = 0 THEN row END) OVER (PARTITION BY doc_id)) AS psi FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
PLACES = SUFFIXES + ", y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ch ORDER BY row) - 1 AS rank FROM x)"
INVERSE_SELECT = PLACES + " SELECT doc_id, row, ch, rank FROM y WHERE row % 5 = 3"


def lex_intervals(patterns: tuple[str, ...]) -> str:
    rows = ", ".join(f"({quote(p)})" for p in patterns)
    return SUFFIXES + f", pat(pattern) AS (VALUES {rows}) SELECT doc_id, pattern, min(row) AS lo, max(row) AS hi FROM x JOIN t USING (doc_id) JOIN pat ON starts_with(substr(text, pos + 1, 8), pattern) GROUP BY 1, 2"


LCP_ROWS = f"""WITH {BENCHMARK}, x AS (SELECT doc_id, substr(text, pos + 1) AS s FROM (SELECT doc_id, text, unnest(range(0, length(text) + 1)) AS pos FROM t)),
o AS (SELECT doc_id, s, row_number() OVER w - 1 AS row, coalesce(lag(s) OVER w, '') AS b FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
l AS (SELECT doc_id, row, len(list_filter(range(1, least(length(s), length(b)) + 1), lambda k: left(s, k) = left(b, k))) AS lcp FROM o)"""
LCP = LCP_ROWS + " SELECT doc_id, row, lcp FROM l"
LONGEST = LCP_ROWS + " SELECT doc_id, max(lcp) AS len FROM l GROUP BY 1"

PLCP = LCP_ROWS + f", n AS (SELECT doc_id, length(text) AS n FROM t) SELECT doc_id, n - length(s) AS pos, lcp AS plcp FROM l JOIN o USING (doc_id, row) JOIN n USING (doc_id)"
TREE = LCP_ROWS + """, nodes AS (SELECT doc_id, k, left(s, k) AS prefix, min(row) AS lo, max(row) AS hi FROM (SELECT doc_id, row, s, unnest(range(0, length(s) + 1)) AS k FROM o) GROUP BY 1, 2, 3),
inner_nodes AS (SELECT doc_id, max(k) AS depth, lo, hi FROM nodes WHERE hi > lo OR k = 0 GROUP BY doc_id, lo, hi)"""
SUFFIX_TREE = TREE + " SELECT doc_id, depth, lo, hi FROM inner_nodes"
TREE_DEGREES = TREE + """, up AS (SELECT a.doc_id, a.lo AS clo, a.hi AS chi, max(b.depth) AS d FROM inner_nodes a JOIN inner_nodes b ON a.doc_id = b.doc_id AND b.lo <= a.lo AND b.hi >= a.hi AND (b.lo < a.lo OR b.hi > a.hi) GROUP BY 1, 2, 3)
SELECT b.doc_id, b.lo, b.hi, count(*) AS children FROM up JOIN inner_nodes b ON b.doc_id = up.doc_id AND b.depth = up.d AND b.lo <= clo AND b.hi >= chi GROUP BY 1, 2, 3"""
LCA = LCP_ROWS + """, pairs AS (SELECT doc_id, CAST(5 AS BIGINT) AS a, unnest(range(6, 41)) AS b FROM t)
SELECT doc_id, a, b, min(lcp) AS depth FROM pairs JOIN l USING (doc_id) WHERE row > a AND row <= b GROUP BY 1, 2, 3"""
NAMED_NODES = TREE + ", i AS (SELECT doc_id, depth, lo, hi, prefix FROM inner_nodes JOIN nodes USING (doc_id, lo, hi) WHERE k = depth)"
TREE_LINKS = NAMED_NODES + " SELECT a.doc_id, a.lo, a.hi, b.lo AS link_lo, b.hi AS link_hi FROM i a JOIN i b ON a.doc_id = b.doc_id AND b.prefix = substr(a.prefix, 2) WHERE a.depth > 0"
TREE_PARENTS = TREE + " SELECT a.doc_id, a.lo, a.hi, max(b.depth) AS parent_depth, a.hi - a.lo + 1 AS leaves FROM inner_nodes a JOIN inner_nodes b ON a.doc_id = b.doc_id AND b.lo <= a.lo AND b.hi >= a.hi AND (b.lo < a.lo OR b.hi > a.hi) GROUP BY 1, 2, 3"
TREE_LEAVES = TREE + """, up AS (SELECT l.doc_id, l.row, max(depth) AS depth FROM l JOIN inner_nodes i ON i.doc_id = l.doc_id AND l.row BETWEEN lo AND hi GROUP BY 1, 2)
SELECT doc_id, row, depth AS parent_depth, row - min(row) OVER (PARTITION BY doc_id, lo) AS place FROM up JOIN inner_nodes i USING (doc_id, depth) WHERE row BETWEEN lo AND hi"""
NEAREST = """SELECT c_custkey AS q, (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey <= c_custkey) AS pred,
(SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey >= c_custkey) AS succ FROM customer"""
OFFSETS = "SELECT doc_id, CAST(sum(length(text) + 1) OVER (ORDER BY doc_id) - length(text) - 1 AS BIGINT) AS start, length(text) + 1 AS size FROM documents"
OWNERS = f"""WITH o AS ({OFFSETS}), q AS (SELECT DISTINCT o_orderkey * 13 AS pos FROM orders)
SELECT pos, doc_id, pos - start AS inside FROM q JOIN o ON pos >= start AND pos < start + size"""
CODES = """SELECT x, length(b) AS width, CAST(bit_count(x) AS BIGINT) AS ones, repeat('0', length(b) - 1) || b AS gamma, repeat('0', length(bin(length(b))) - 1) || bin(length(b)) || substr(b, 2) AS delta, x AS back
FROM (SELECT o_orderkey + 1 AS x, bin(o_orderkey + 1) AS b FROM orders)"""

MIDDLE = SUFFIXES + ", m AS (SELECT * FROM x WHERE row >= n // 4 AND row < 3 * n // 4)"
RANGE_2D = MIDDLE + " SELECT doc_id, count(*) FILTER (WHERE row BETWEEN n // 3 AND n // 2 AND pos BETWEEN 0 AND n // 2) AS n FROM m GROUP BY 1"
QUANTILE = MIDDLE + " SELECT doc_id, ch FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ch, row) = 10"
INTERVAL_SYMBOLS = MIDDLE + " SELECT doc_id, ch, count(*) AS freq FROM m GROUP BY 1, 2"
LEX_COUNT = MIDDLE + " SELECT doc_id, count(*) FILTER (WHERE ch < 'm') AS smaller, count(*) FILTER (WHERE ch > 'm') AS greater FROM m GROUP BY 1"
INTERSECT = MIDDLE + ", s AS (SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, ch, count(*) AS c FROM m GROUP BY ALL) SELECT a.conv_id, a.ch, a.c AS n_left, b.c AS n_right FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.ch = b.ch AND a.turn = 0 AND b.turn = 1"
PRED_SUCC = f"WITH {DOCUMENTS}, {CH}, q(q) AS (VALUES ('B'), ('h'), ('~')) SELECT doc_id, q, max(c) FILTER (WHERE c <= q) AS pred, min(c) FILTER (WHERE c >= q) AS succ FROM ch, q GROUP BY 1, 2"
RMQ = """SELECT range_id, arg_min(event_id, (value, event_id)) AS argmin, min(value) AS minimum
FROM (SELECT event_id AS range_id FROM events WHERE event_id % 97 = 0) r JOIN events e ON e.event_id BETWEEN r.range_id AND r.range_id + 1499 GROUP BY 1"""

SWAP_A, SWAP_B = DRAW.format(i="pattern_id", n="length(pattern)"), DRAW.format(i="pattern_id + 7", n="length(pattern)")
MUTATION = f"""WITH pat AS ({SAMPLE}), s AS (SELECT *, least({SWAP_A}, {SWAP_B}) AS swap_l, greatest({SWAP_A}, {SWAP_B}) AS swap_r, string_split(pattern, '') AS c FROM pat)
SELECT pattern_id, swap_l, swap_r, array_to_string(list_transform(range(0, len(c)), lambda i: CASE WHEN i = swap_l THEN c[swap_r + 1] WHEN i = swap_r THEN c[swap_l + 1] ELSE c[i + 1] END), '') AS mutant FROM s"""
DNA = """WITH r AS (SELECT pos, copy, (((pos * 7919 + 42) * 1103515245 + 12345) % 1073741824) // 1024 AS b, (((pos * 104729 + copy * 1299709 + 42) * 1103515245 + 12345) % 1073741824) // 1024 AS die
FROM (SELECT unnest(range(0, 5000)) AS pos), (SELECT unnest(range(0, 7)) AS copy)),
l AS (SELECT pos, copy, CASE WHEN copy = 0 OR die % 100 >= 3 THEN ['A', 'C', 'G', 'T'][b % 4 + 1] WHEN (die // 100) % 2 = 1 THEN ['A', 'C', 'G', 'T'][(die // 200) % 4 + 1] ELSE '' END AS ch FROM r)
SELECT copy, string_agg(ch, '' ORDER BY pos) AS text FROM l GROUP BY 1"""
SIZE_FORMAT = """SELECT doc_id,
CASE WHEN s >= 1073741824 THEN printf('%.2fGiB', s / 1073741824) WHEN s >= 1048576 THEN printf('%.2fMiB', s / 1048576) WHEN s >= 1024 THEN printf('%.2fKiB', s / 1024) ELSE s || 'B' END AS size,
CASE WHEN ns >= 1e9 THEN printf('%.2fs', ns / 1e9) WHEN ns >= 1e6 THEN printf('%.2fms', ns / 1e6) WHEN ns >= 1e3 THEN printf('%.2fus', ns / 1e3) ELSE printf('%.2fns', ns) END AS time
FROM (SELECT doc_id, strlen(text) * doc_id AS s, CAST(strlen(text) * doc_id * 1000 + 7 AS DOUBLE) AS ns FROM documents)"""
SPACE = blocks(4, DOCUMENTS) + f""", {DICTIONARY}, parts AS (
SELECT 'texts' AS component, sum(strlen(text)) AS bytes FROM t UNION ALL SELECT 'dictionary', sum(strlen(factor)) FROM d UNION ALL SELECT 'alphabet', sum(strlen(c)) FROM (SELECT DISTINCT c FROM ch))
SELECT component, CAST(sum(bytes) AS BIGINT) AS bytes FROM parts GROUP BY ROLLUP (component)"""
ENTROPY = windows(3) + " " + " UNION ALL ".join(
    f"SELECT CAST({k} AS BIGINT) AS k, round(sum(cnt * log2(n / cnt)) / sum(cnt), 6) AS entropy FROM (SELECT *, sum(cnt) OVER (PARTITION BY context) AS n FROM (SELECT {context} AS context, c{k} AS c, CAST(count(*) AS DOUBLE) AS cnt FROM g WHERE c{k} IS NOT NULL GROUP BY 1, 2))"
    for k, context in enumerate(("''", "c0", "c0 || c1"))
)


def pattern_factors(last_s: bool) -> str:
    """Factor starts inside patterns whose last run is of type S (as before a larger character) or not (as at the end)."""
    more = "|| chr(1114111)" if last_s else ""
    pat = f"t AS (SELECT pattern_id AS doc_id, pattern {more} AS text, length(pattern) AS n FROM ({SAMPLE}))"
    return typed(pat) + f" SELECT lm.doc_id AS pattern_id, {str(last_s).lower()} AS last_s, p AS start FROM lm JOIN t USING (doc_id) WHERE lms AND p < n"


PATTERN_FACTORS = f"SELECT * FROM ({pattern_factors(False)}) UNION ALL SELECT * FROM ({pattern_factors(True)})"


def interval_sizes(patterns: tuple[str, ...]) -> str:
    """Occurrences in each text, and whether there are none."""
    n = max(map(len, patterns))
    rows = " UNION ALL ".join(f"SELECT t.doc_id, {quote(p)} AS pattern, count(g.p) AS size, count(g.p) = 0 AS is_empty FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND {hit(p)} GROUP BY 1" for p in patterns)
    return windows(n, CONVERSATIONS) + rows


UNIQUE_RANGE = MIDDLE + " SELECT DISTINCT doc_id, ch FROM m WHERE ch >= 'd' AND ch < 'p'"
MERGED = """tt AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations UNION ALL SELECT -item_id - 1, text FROM benchmark), t AS (SELECT * FROM tt)"""
STREAM_WINDOWS = """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, q AS pattern, CAST(sum(length(props) - length(replace(props, q, ''))) AS BIGINT) AS occ
FROM events, (VALUES ('1'), ('7')) v(q) GROUP BY 1, 2"""
