"""SQL for DuckDB that the longer queries of the corpus operators are compared with."""

from __future__ import annotations

from rivalry.llm import leaks
from rivalry.llm.secrets import BASE, BREAK, KINDS, NEEDS, REACH, ROLE, WEAK


def _text(pattern: str) -> str:
    return pattern.replace("'", "''")


def secrets_sql() -> str:
    """Matches and the text between them give positions; weak parts are linked by EXISTS over all parts of their scope."""
    kinds = {k: (*v, KINDS.index(k)) for k, v in {**BASE, **WEAK}.items()} | {"break": (BREAK, 0, 0, -1)}
    found = "\nUNION ALL ".join(
        f"SELECT {no} AS k, {least} AS least, doc_id, string_split_regex(t, '{_text(p)}') AS g, regexp_extract_all(t, '{_text(p)}', 0) AS m, regexp_extract_all(t, '{_text(p)}', {group}) AS v FROM d"
        for p, group, least, no in kinds.values()
    )
    role = "CASE k " + " ".join(f"WHEN {KINDS.index(k)} THEN '{r}'" for k, r in ROLE.items()) + " END"
    need = " AND ".join(
        f"(w.k <> {KINDS.index(k)} OR ("
        + " AND ".join(f"EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.scope = w.scope AND p.role = '{r}' AND abs(p.s - w.s) <= {REACH})" for r in roles)
        + "))"
        for k, roles in NEEDS.items()
    )
    names = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    span = f"concat({names}, ':', s, ':', e)"
    value = KINDS.index("value")
    n = len(BASE)
    counts = ", ".join(f"count(CASE WHEN k = {KINDS.index(k)} THEN 1 END) AS n_{k}" for k in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
u AS (SELECT k, least, doc_id, i, length(g[i]) AS gl, length(m[i]) AS ml, length(v[i]) AS vl FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f) x),
q AS (SELECT *, CAST(sum(gl + ml) OVER (PARTITION BY k, doc_id ORDER BY i) - ml AS BIGINT) AS s FROM u),
a AS MATERIALIZED (SELECT q.k, q.doc_id, s, s + ml AS e, substr(t, s + 1, ml) AS x FROM q JOIN d USING (doc_id) WHERE vl >= least),
b AS MATERIALIZED (SELECT k, doc_id, s, e FROM a WHERE k BETWEEN 0 AND {n - 1}),
weak AS (SELECT k, doc_id, s, e FROM a WHERE k >= {n} AND (k <> {value} OR (regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]')))
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)),
parts AS MATERIALIZED (SELECT *, {role} AS role, (SELECT count(*) FROM a z WHERE z.k = -1 AND z.doc_id = y.doc_id AND z.s < y.s) AS scope FROM (SELECT * FROM b UNION ALL SELECT * FROM weak) y),
linked AS (SELECT k, doc_id, s, e FROM parts w WHERE k >= {n} AND {need}),
spans AS (SELECT *, true AS base FROM b UNION ALL SELECT *, false FROM linked),
g AS (SELECT doc_id, {counts}, coalesce(string_agg({span}, ',' ORDER BY s, k) FILTER (WHERE base), '') AS base_text, string_agg({span}, ',' ORDER BY s, k) AS spans, count(CASE WHEN NOT base THEN 1 END) AS n_linked FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (doc_id)"""


def leaks_sql() -> str:
    """Without seeds: whatever agrees in 80 per cent has a run of agreeing tokens of some length, so runs are joined.

    A window of 13 or 12 tokens of which two differ has a run of four; shorter items have shorter ones. The
    diagonals that share a run are then compared token by token, over the whole of both texts.
    """
    token = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    differ = lambda n: n * (100 - leaks.AGREE) // 100
    run = {n: -(-(n - differ(n)) // (differ(n) + 1)) for n in range(1, leaks.WINDOW + 1)}
    grams = sorted(set(run.values()))
    size = "CASE least(len(w), %d) %s END" % (leaks.WINDOW, " ".join(f"WHEN {n} THEN {g}" for n, g in run.items()))
    gram = lambda t, g, more: (
        f"SELECT id, w, {g} AS g, p, array_to_string(w[p + 1 : p + {g}], ' ') AS x FROM (SELECT *, unnest(range(0, len(w) - {g - 1})) AS p FROM {t} WHERE len(w) >= {g}{more}) y"
    )
    return f"""
WITH dt AS MATERIALIZED (SELECT doc_id AS id, {token} AS w FROM documents), bt AS MATERIALIZED (SELECT DISTINCT item_id AS id, {token} AS w FROM benchmark),
bg AS MATERIALIZED ({" UNION ALL ".join(gram("bt", g, f" AND {size} = {g}") for g in grams)}),
dg AS ({" UNION ALL ".join(gram("dt", g, f" AND EXISTS (SELECT 1 FROM bg WHERE g = {g})") for g in grams)}),
h AS (SELECT DISTINCT dg.id AS doc_id, bg.id AS item_id, dg.w AS dw, bg.w AS bw, dg.p - bg.p AS shift, least({leaks.WINDOW}, len(bg.w)) AS win FROM dg JOIN bg USING (g, x)),
s AS (SELECT *, unnest(range(greatest(0, -shift), least(len(bw), len(dw) - shift) - win + 1)) AS k FROM h),
c AS (SELECT doc_id, item_id, win, shift + k AS place, len(list_filter(range(0, win), lambda j: dw[shift + k + j + 1] = bw[k + j + 1])) AS agreeing FROM s)
SELECT doc_id, item_id, CAST(max(win) AS INT) AS "window", max(agreeing) AS agreeing, arg_max(place, agreeing * 1000000000 - place) AS doc_token
FROM c WHERE agreeing * 100 >= win * {leaks.AGREE} GROUP BY 1, 2"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def near_duplicates_sql(size: int = 4, percent: int = 80) -> str:
    """Links by counting shared shingles, components by recursion over the links."""
    words = WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) >= {size} THEN list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i : i + {size - 1}], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
r(id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reached) AS component_id, d.doc_id = min(r.reached) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n"""


def repeats_sql(window: int = 35) -> str:
    """Windows as joined words; a word goes if one of the windows that cover it starts more than once."""
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
x AS MATERIALIZED (SELECT doc_id, i, w[i] AS word, CASE WHEN i + {window - 1} <= len(w) THEN array_to_string(w[i : i + {window - 1}], ' ') END AS x FROM i),
c AS (SELECT x FROM x WHERE x IS NOT NULL GROUP BY x HAVING count(*) > 1),
f AS (SELECT doc_id, i, word, max(CASE WHEN c.x IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN c ON c.x = x.x),
k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)"""


def nearest_sql(every: int = 20, k: int = 20, scale: int = 64) -> str:
    """All inner products, ranked."""
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= {k}"""


def collocations_sql(longest: int = 5, least: int = 100, top: int = 2000, scale: int = 1000, cover: int = 100) -> str:
    """All phrases are counted; cuts and longer phrases are looked up."""
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY 1),
s AS (SELECT lang, w, unnest(range(1, {longest + 1})) AS k FROM w), i AS (SELECT lang, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM s),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL HAVING count(*) >= {least}),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
z AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, n.n, ({scale} * c.a::HUGEINT * n.n) // (l.f::HUGEINT * r.f) AS score FROM x c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 :], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
u AS (SELECT lang, w, k, a, unnest(range(2, k)) AS m FROM c WHERE k >= 3), v AS (SELECT *, unnest(range(1, k - m + 2)) AS i FROM u),
h AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM v GROUP BY 1, 2),
o AS (SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS INT) AS rank, b.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE 100 * coalesce(longer, 0) < {cover} * a)
SELECT * FROM o WHERE rank <= {top}"""


def trie_sql(every: int = 20, most: int = 4) -> str:
    """Prefixes as text; each node is joined with the prefixes of the conversation that names it. CRC-32 by a table of its 256 steps."""
    words = WORDS.format("coalesce(text, '')")
    return f"""
WITH RECURSIVE g AS (SELECT range AS b, range AS v, 0 AS i FROM range(0, 256) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM g WHERE i < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY b) AS tab FROM g WHERE i = 8),
t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i,
  concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS x, len({words}) AS words FROM conversations WHERE conv_id IS NOT NULL),
m AS MATERIALIZED (SELECT c, count(*) AS n FROM t GROUP BY 1),
h AS MATERIALIZED (SELECT m.c, b.c AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(m.c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda r, s: xor(r // 256, tab[xor(r, s) % 256 + 1])), 4294967295) % {most} AS h, coalesce(b.n, 0) AS bn
  FROM m CROSS JOIN tab LEFT JOIN m b ON b.c = m.c - m.c % {every}),
r AS MATERIALIZED (SELECT c, 0 AS d, '' AS x, 0 AS words FROM m UNION ALL SELECT h.c, t.i, t.x, t.words FROM h JOIN t ON t.c = h.base AND t.i <= h.h
  UNION ALL SELECT h.c, t.i - h.h + least(h.h, h.bn), t.x, t.words FROM h JOIN t ON t.c = h.c AND t.i > h.h),
k AS MATERIALIZED (SELECT c, d, words, sha256(string_agg(concat(length(x), ':', x), '') OVER (PARTITION BY c ORDER BY d)) AS key, max(d) OVER (PARTITION BY c) = d AS last FROM r),
p AS MATERIALIZED (SELECT *, min(c) OVER (PARTITION BY d, key) AS rep FROM k),
v AS MATERIALIZED (SELECT rep AS conv_id, d AS depth, count(*) AS n_convs, (count(*) - 1) * min(words) AS own, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
a AS MATERIALIZED (SELECT v.*, q.rep AS parent_conv_id FROM v LEFT JOIN p q ON q.c = v.conv_id AND q.d = v.depth - 1),
s AS MATERIALIZED (SELECT a.*, coalesce(y.n, 0) AS n_children FROM a LEFT JOIN (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n FROM a GROUP BY 1, 2) y ON y.parent_conv_id = a.conv_id AND y.depth = a.depth),
e AS (SELECT p.rep AS conv_id, p.d AS depth, sum((s.n_children = 0)::INT) AS n_leaves, sum(s.own) AS saved_tokens FROM s JOIN p ON p.c = s.conv_id AND p.d <= s.depth GROUP BY 1, 2)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM s JOIN e USING (conv_id, depth)"""
