"""Exact top-k search, phrase collocations and the conversation trie against plain Python, on hand-made rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from rivalry.llm import nearest, phrases, queries, tries

DATA = Path("/root/testdata/sf0.001")
CLASHES = "row long, need double, c long, d long, k int, up long, words long, part int, hash long"


# ---- top-k


def best(rows, asked, k):
    out = []
    for q, v in asked:
        met = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(met)[:k])]
    return Counter(out)


def usable(rows):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-30, 30, (4, dim))
    return [(i, [float(x) for x in centres[i % 4] + rng.integers(-4, 5, dim)]) for i in range(n)]


@pytest.mark.parametrize(("block", "query_block", "pivots"), [(4096, 1024, 32), (16, 4, 5), (7, 3, 1)])
def test_top_k_finds_what_a_scan_finds(spark, block, query_block, pivots):
    rows = vectors(150, 6, 1)
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(300, None), (301, [1.0, None] + [0.0] * 4), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [2.0, 3.0]), (305, [5.0, -1.0]), (306, []), (307, []), rows[10]]
    df = spark.createDataFrame([(*r, 1, 2.0, 3, 4, 5, 6, 7, 8, 9) for r in rows], f"vec_id long, embedding array<double>, {CLASHES}").repartition(3)
    got = nearest.top_k(df, df.where("vec_id % 5 = 0"), 7, n_pivots=pivots, block=block, query_block=query_block)
    assert Counter(tuple(r) for r in got.collect()) == best(usable(rows), [r for r in usable(rows) if r[0] % 5 == 0], 7)


def test_top_k_with_other_ids_and_large_components(spark):
    rows = [(f"v{i}", v) for i, v in vectors(40, 3, 2)] + [("big", [2.0**40, -(2.0**30), 1.0]), ("huge", [2.0**62, 2.0**62, 0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = Counter(tuple(r) for r in nearest.top_k(df, df, 5, block=9).collect())
    hold = lambda s: max(1 - (1 << 63), min((1 << 63) - 1, s))
    want = Counter()
    for q, v in rows:
        met = sorted((-hold(sum(int(a) * int(b) for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)
        want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(met[:5]))
    assert got == want


def test_bounds_eliminate_candidates(spark):
    rows = vectors(4000, 8, 3)
    seen = []
    search = nearest._eliminate(5)
    table = nearest.pivot_table(spark.createDataFrame(rows, "id long, v array<double>"), nearest.choose_pivots(spark.createDataFrame(rows, "id long, v array<double>"), 32, 1024))
    c = table.toPandas()
    q = c.iloc[:64].assign(row=range(64), need=float("-inf"))
    was = nearest._highest
    nearest._highest = lambda s, k: (seen.append(s.size - 5 * len(s)), was(s, k))[1]
    try:
        got = search(q, c)
    finally:
        nearest._highest = was
    assert len(got) == 5 * 64 and sum(seen) < 0.6 * 64 * 4000  # the rest is never scored
    want = best(rows, rows[:64], 5)
    assert Counter(zip(got.query_id, got.vec_id, got.score, strict=True)) == Counter({(a, b, s): n for (a, _, b, s), n in want.items()})


def test_top_k_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nearest.top_k(df, df, 3).count() == 0


# ---- collocations


def collocated(rows, longest, least, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    f = {x: c for x, c in f.items() if c >= least}
    out = defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) < 2:
            continue
        inside = [x for x, c in f.items() if x[0] == lang and len(x) - 1 > len(w) and c >= a and any(list(x[i : i + len(w)]) == w for i in range(1, len(x) - len(w) + 1))]
        if inside:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), " ".join(w), f[lang, *w[:k]], f[lang, *w[k:]], n[lang]))
    return Counter((lang, r + 1, x[3], -x[1], x[4], x[5], x[6], -x[0]) for lang, xs in out.items() for r, x in enumerate(sorted(xs)[:top]))


def texts():
    rng = random.Random(5)
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("...", "de"), ("é" * 3000, "fr")]
    for i in range(120):
        w = [rng.choice("the of and Big data is fast É über x1".split()) for _ in range(rng.randrange(1, 60))]
        for _ in range(3):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(["new york city", "New York city hall", "a a a a", "to be or not to be"]).split()
        rows.append((rng.choice([" ", "\t", "  "]).join(w).replace("fast", rng.choice(["fast,", "fast.", "fast\n"])), rng.choice(["en", "en", "de", None])))
    return rows + rows[-3:]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_collocations_are_those_of_full_counts(spark, most):
    rows = texts()
    df = spark.createDataFrame([(*r, 1, 2.0, 3, 4, 5, 6, 7, 8, 9) for r in rows], f"text string, lang string, {CLASHES}").repartition(4)
    got = phrases.collocations(df, 5, 9, 40, broadcast_bytes=most)
    assert Counter(tuple(r) for r in got.collect()) == collocated(rows, 5, 9, 40)


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string"), 5, 2).count() == 0


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(6)
    keys = np.concatenate((rng.integers(0, 1 << 40, 60_000), np.repeat(rng.integers(0, 1 << 40, 50), 40))).astype(np.uint64)
    rng.shuffle(keys)
    s = phrases.Summary(20, size=62_000 // 20)
    for part in np.array_split(keys, 40):
        s.add(*phrases.counted(part))
    own, n = np.unique(keys, return_counts=True)
    s.settle()
    assert s.error < 20 and set(own[n >= 40].tolist()) <= set(s.reaching(40).tolist())
    assert len(s.keys) <= s.size == 62_000 // 20  # it had no need to grow
    true = dict(zip(own.tolist(), n.tolist(), strict=True))
    assert all(c <= true[k] <= c + s.error for k, c in zip(s.keys.tolist(), s.counts.tolist(), strict=True))


# ---- tries


def trie(rows):
    md5 = lambda r, t: hashlib.md5(f"{len(r or '')}:{r or ''}{t or ''}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), md5(role, text), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + x[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
        ends[tuple(x)].append(c)
    out = Counter()
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        own_ends = ",".join(map(str, sorted(ends.get(node, []))))
        children = sum(len(x) == len(node) + 1 for x in below)
        out[min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children, len(leaves), saved, hashlib.sha256(own_ends.encode()).hexdigest()] += 1
    return out


def talks():
    rng, rows = random.Random(9), []
    openings = [("user", "Hi there"), ("system", "Be kind, \t please"), ("user", None), (None, "x")]
    for c in range(70):
        if c in (20, 33):
            continue
        rows += [(c, t, *(openings[rng.randrange(4)] if rng.random() < 0.7 else ("assistant", f"r{rng.randrange(3)}"))) for t in range(rng.randrange(1, 7))]
    rows += [(45, t, "user", f"long {t % 3}") for t in range(7, 90)] + [(46, t, "user", f"long {t % 3}") for t in range(7, 70)]
    rows += [(200 + i, 0, "user", "same") for i in range(30)]  # copies: many ends of one node
    rows += [(5, None, "user", "before"), (5, None, "user", "before too"), (6, 0, "user", "twin"), (6, 0, "assistant", "twin"), (6, 0, "assistant", "twin"), (None, 0, "user", "nobody"), (-3, 0, "user", "minus"), (-3, 1, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("band", "block", "ends"), [(8, 256, 4096), (2, 3, 4), (3, 10, 1)])
def test_trie_has_all_prefixes(spark, band, block, ends):
    rows = [r for r in talks() if r[0] is None or r[0] >= 0]
    df = spark.createDataFrame([(*r, 1, 2.0, 3, 4, 5, 6, 7, 8, 9) for r in rows], f"conv_id long, turn long, role string, text string, {CLASHES}").repartition(3)
    got = tries.conversation_trie(df, band=band, block=block, ends=ends)
    assert Counter(tuple(r) for r in got.collect()) == trie(rows)


def test_trie_of_an_empty_table(spark):
    assert tries.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- every registered query that has SQL


def value(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("key", list(queries.ORACLES))
def test_query_matches_its_sql(spark, key):
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = queries.QUERIES[key](spark, str(DATA)), con.sql(queries.ORACLES[key])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(value, r)) for r in df.collect()) == Counter(tuple(value(r[i]) for i in at) for r in want.fetchall())
