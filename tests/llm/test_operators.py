"""The corpus operators on hand-made rows: null, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivalry.llm import archives, leaks, media, neardup, packing, secrets, substrings, tokens, toxicity, urls
from rivalry.llm.common import components
from rivalry.llm.queries import RULES, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, key long, node long, n long, salt int, length int, start int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    rng = random.Random(11)
    texts = [None, "", " \t\n", "one", "two words", "Ünïcödé \U0001f600 ﬁ", "x" * 5000, " ".join(words(rng, 6000))]
    passage = words(rng, 60)
    for i in range(30):
        w = words(rng, 80 + i)
        if i % 3 == 0:
            w[10:10] = passage
        texts.append(" ".join(w))
    base = words(rng, 120)
    for i in range(12):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[9], texts[9], "A b C d e f", "a B c D e f"]
    rows = [(i, t, "en", 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    return rows + [rows[9]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = [(i, i + 1) for i in range(40)]
    assert {r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def test_media_round_trip(spark, docs, none):
    rows = media.decode_media(media.encode_texts(docs)).collect()
    assert len(rows) == len(corpus())
    text = {r[0]: (r[1] or "").encode() for r in corpus()}
    seen = {}
    for r in rows:
        assert bytes(r.payload) == media.padded(text[r.doc_id]) and r.n_bytes == len(text[r.doc_id])
        assert len(r.rgb) == r.height * r.width * 3
        assert seen.setdefault(text[r.doc_id], (r.feature, bytes(r.media))) == (r.feature, bytes(r.media))
    assert media.decode_media(media.encode_texts(none)).count() == 0


def test_media_is_a_jpeg_that_other_readers_take(spark, tmp_path):
    rng = random.Random(1)
    files = media.encode([bytes(rng.choice(b"etaoins") for _ in range(192 * n)) for n in (1, 7, 300)])
    for i, f in enumerate(files):
        (tmp_path / f"{i}.jpg").write_bytes(f)
    got = spark.read.format("image").load(str(tmp_path)).select("image.origin", "image.width", "image.height", "image.data").collect()
    assert len(got) == 3
    for r in got:
        frame = media.parse(files[int(r.origin[-5])])
        own = media.rgb(frame, media.samples([frame], media.coefficients([frame]))[0]).astype(int)
        other = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[:, :, ::-1].astype(int)
        assert own.shape == other.shape
        luma = np.array([0.299, 0.587, 0.114])
        assert np.abs(own @ luma - other @ luma).max() < 4  # the other reader smooths chroma, which leaves brightness


def test_media_refuses_other_files():
    with pytest.raises(ValueError):
        media.parse(b"GIF89a")


def brute_near(rows, size, percent):
    sets = {}
    for r in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        w = WORD.findall(t)
        sets[r[0]] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_brute_force(docs, size):
    got = neardup.near_duplicates(docs, size).collect()
    assert len(got) == len(corpus())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(corpus(), size, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(3)
    base, rows = words(rng, 150, 10**6), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 4, 80)


def test_near_duplicates_of_nothing(none, spark):
    assert neardup.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()}
    assert got == {None: (None, True), 1: (1, True), 2: (1, False)}
    assert neardup.drop_near_duplicates(odd).count() == 2
    named = odd.where("doc_id is not null").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.lit(1).alias("gone"), F.lit(2).alias("rep"))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(named).collect()} == {"d1": "d1", "d2": "d1"}
    assert [tuple(r) for r in neardup.drop_near_duplicates(named).collect()] == [("d1", "a b c d e f", 1, 2)]
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l m")], "doc_id long, text string")
    assert sorted(neardup.near_duplicates(twice, 5, 60).collect()) == sorted(neardup.near_duplicates(twice, 5, 60).collect())


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def test_base_spans_against_regular_expressions(spark):
    rng = random.Random(5)
    parts = ["password", "Secret=", "token: ", "api_key='", "abcdef", "=", ":", " ", "\n", "é\U0001f600", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "x", '"', "short", "\n\n", "user=bob", "https://h.example"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(300)] + [(300, None), (301, ""), (302, "a" * 200_000), (3, None)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        spans = [(m.start(), k, m.end()) for k, name in enumerate(BASE) for m in BASE[name][0].finditer(t or "") if len(m[BASE[name][1]]) >= BASE[name][2]]
        names = list(BASE)
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
        counts = Counter(k for _, k, _ in spans)
        want[i].append((counts[0], counts[1], counts[2], hashlib.sha256(text.encode()).hexdigest()))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_assign, r.n_access, r.n_hex, r.base_sha256))
        assert len(r.spans.split(",")) == r.n_assign + r.n_access + r.n_hex + r.n_linked or not r.spans
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_weak_parts_need_their_complement(spark, none):
    strong, value = "AKIA" + "A1" * 8, "Zx9Kq2LmNo3PqRs5"
    rows = [
        (1, f"login=alice then {value}"),  # an identifier and a secret-like value
        (2, f"only {value} here"),
        (3, f"login=alice\n\n{value}"),  # another scope
        (4, f"{strong} " + "-" * 500 + f" {value}"),  # too far
        (5, f"{strong} https://api.example.com password=hunter22"),
        (6, "https://api.example.com password=hunter22"),
        (7, "login=bob"),
        (8, f"{'.' * 195}login=alice {value}"),  # across two cells
    ]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_linked for i in range(1, 9)] == [2, 0, 0, 0, 1, 0, 0, 2]
    assert got[1].spans.split(",")[0].startswith("ident:0:11")
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[1] == "[REDACTED] then [REDACTED]" and clean[2] == rows[1][1]
    wide = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS span_doc", "3 AS start", "4 AS `end`")
    assert {r.doc_id: (r.text, r.spans, r.end) for r in secrets.redact(wide).collect()} == {k: (v, 1, 4) for k, v in clean.items()}
    assert secrets.scan_secrets(none).count() == 0 and secrets.redact(none).count() == 0


def test_dense_secrets_in_long_texts(spark):
    """Thousands of spans in one text, redacted across blocks of characters, in texts beyond one byte a character."""
    rng = random.Random(17)
    rows, want = [], {}
    for i, n in enumerate((0, 1, 100, 128, 129, 400, 9000)):
        parts, clean = [], []
        for k in range(n):
            gap = " " + "".join(rng.choices("xyzé\U0001f600 ", k=rng.randrange(80))) + " "
            value = f"password=hunter{k:06d}"
            parts += [gap, value]
            clean += [gap, "[REDACTED]"]
        rows.append((i, "".join(parts)))
        want[i] = "".join(clean)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.text for r in secrets.redact(d).collect()} == want
    for r in secrets.scan_secrets(d).collect():
        spans = [m.span() for m in re.finditer("password=hunter[0-9]+", rows[r.doc_id][1])]
        assert r.base_sha256 == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, b in spans).encode()).hexdigest()


def test_leaks(spark, none):
    rng = random.Random(8)
    items = [words(rng, n, 10**5) for n in (60, 20, 9, 5)]
    rows = [(i, " ".join(w)) for i, w in enumerate(items)]
    free = lambda n: words(rng, n, 10**5)
    swapped = list(items[0])
    swapped[20], swapped[33] = "other", "else"
    docs = [
        (1, " ".join(free(30) + items[0] + free(30))), (2, " ".join(free(2000) + swapped + free(5))), (3, " ".join(free(300))),
        (4, ("; ".join(items[1])).upper()), (5, " ".join(items[2])), (6, " ".join(items[3] * 3)), (7, None), (8, ""),
        (9, " ".join(free(10) + items[0][10:24] + free(10))), (10, " ".join(items[0][:6] + free(40) + items[0][30:36])),
        (11, " ".join(free(1010) + items[1] + items[0])), (1, " ".join(items[1])),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows + [(9, None), (1, rows[1][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.window, r.agreeing, r.doc_token) for r in leaks.find_leaks(d, b).collect()}
    assert set(got) == {(1, 0), (2, 0), (4, 1), (5, 2), (6, 3), (9, 0), (11, 0), (11, 1), (1, 1)}
    assert got[1, 0] == (13, 13, 30) and got[5, 2] == (9, 9, 0) and got[11, 1] == (13, 13, 1010)
    assert sorted(r.doc_id for r in leaks.drop_leaks(d, b).collect()) == [3, 7, 8, 10]
    shuffled = leaks.find_leaks(d, b, broadcast_bytes=0)
    assert "BroadcastHashJoin" in leaks.find_leaks(d, b)._jdf.queryExecution().toString()
    assert {(r.doc_id, r.item_id): (r.window, r.agreeing, r.doc_token) for r in shuffled.collect()} == got
    assert leaks.find_leaks(none, b).count() == 0 and leaks.find_leaks(d, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_seeds_tolerate_two_substitutions_in_a_window():
    for a in range(leaks.WINDOW):
        for b in range(a):
            assert any(not {a, b} & {s + o for o in m} for m in leaks.MASKS for s in range(leaks.WINDOW - m[-1]))


def test_every_allowed_substitution_is_found(spark):
    """Items of every length, each with every set of differing tokens that leaves 80 per cent."""
    rng = random.Random(12)
    items, docs = [], []
    for n in (*range(1, 15), 20):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for e in range(4):
            for gone in combinations(range(min(n, 13)), e):
                w = ["other" if k in gone else t for k, t in enumerate(item[:13])]
                docs.append((1000 * len(docs) + n, " ".join([*words(rng, 9), *w, *words(rng, 9)]), n, e))
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, n) for i, _, n, e in docs if 100 * (min(n, 13) - e) >= 80 * min(n, 13)}


def test_token_counts_agree_with_the_library(spark, docs, none):
    import sentencepiece

    model = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    extra = [" lead", "trail ", "a  b", "   ", "▁ x", "<s> a </s>", "tab\tx\n\ny", "　", "a \x00"]
    rows = corpus() + [(1000 + i, t, "en", 1, 2, 3, 4, 5, 6) for i, t in enumerate(extra)]
    for frequent in (0, 1000):
        got = tokens.count_tokens(spark.createDataFrame(rows, SCHEMA), model, 100, frequent).collect()
        assert len(got) == len(rows)
        want = {r[0]: len(sp.encode(r[1] or "")) for r in rows}
        assert {r.doc_id: r.n_tokens for r in got} == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert tokens.count_tokens(none, model).count() == 0


def edits(a, b):
    """Edit distance in which a swap of neighbours is one edit (each letter is edited once)."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_misspelled_terms_against_edit_distance():
    lex = toxicity.Lexicon({"worthless": 2.0, "clown": 1.5, "idiot": 1.0, "bad": 1.0, "scum": 1.0, "stem*": 3.0}, ["clowns"])
    rng = random.Random(4)
    for _ in range(6000):
        w = list(rng.choice(["worthless", "clown", "scum", "idiot"]))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abcs1")
        if rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "x")
        if rng.random() < 0.3:
            i = rng.randrange(len(w) - 1)
            w[i], w[i + 1] = w[i + 1], w[i]
        word = "".join(w)
        if word in lex.terms:
            assert lex.hit(word)[0] == 0
        else:
            near = any(edits(word, t) <= 1 and (len(t) > 4 or t[0] == word[0]) for t in lex.terms if len(t) >= 4)
            assert (lex.hit(word) is not None) == near, word
    assert lex.hit("clowns") is None and lex.hit("clownz") == (2, 1.5) and lex.hit("idoit") == (2, 1.0) and lex.hit("scvm") == (2, 0.5)
    assert lex.hit("stemming") == (1, 3.0) and lex.hit("stem") is None
    assert lex.features("an id1ot and a cl@wn")[2] > 0
    plain, quoted = lex.features("you clown here"), lex.features('he said "clown" to me')
    assert plain[0] > 0 and plain[4] > 0 and quoted[0] == 0 and quoted[3] > 0
    assert lex.features("")[:5] == [0.0] * 5


def test_toxicity_learns_and_holds_out(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(40)]
        toxic = rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["vermin", "nitwit", "zagfoo", "zagbar", "zagqux", "zagzig"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(rows + [(2000, None), (2001, ""), (0, rows[0][1])], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, lab).collect()
    assert len(got) == 903
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    odd = lab.withColumn("toxic", F.when(F.col("toxic") == 1, 3).otherwise(-1)).withColumn("features", F.lit(0))
    wide = d.withColumn("features", F.lit(1)).withColumn("gone", F.lit(2))
    again = {(r.doc_id, r.score) for r in toxicity.score_toxicity(wide, odd).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    kept = toxicity.drop_toxic(wide, odd)
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    nothing = toxicity.score_toxicity(d, lab.limit(0)).agg(F.max("score")).first()[0]
    assert nothing == 0.0
    assert toxicity.score_toxicity(none, lab.limit(0)).count() == 0


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 256, 2).collect()
    want = Counter()
    for r in corpus():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 256 or 256
        for k, s in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[s : s + 256] if k else ids[:first]
            want[r[0], k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for own in placed.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256
    assert len(placed) <= 1.1 * sum(r.length for r in got) / 256 + 1
    assert packing.pack_documents(none, path).count() == 0


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - s)
    return len(gaps)


def test_sweeps_match_as_many_as_can_be():
    rng = random.Random(9)
    for _ in range(400):
        items, slots = (np.array([0] + [rng.choice((0, 0, 1, 3)) for _ in range(12)]) for _ in range(2))
        won, at = packing.sweep(items, slots)
        order = [s for s in range(13) for _ in range(slots[s])]
        used = [at[n] + k for n in range(13) for k in range(won[n])]
        assert len(set(used)) == len(used)
        assert all(order[at[n] + k] >= n for n in range(13) for k in range(won[n]))
        assert (won <= items).all()
        free = sorted(order)
        most = 0
        for n in sorted((n for n in range(13) for _ in range(items[n])), reverse=True):
            if free and free[-1] >= n:
                free.remove(next(s for s in free if s >= n))
                most += 1
        assert won.sum() == most


@pytest.mark.parametrize("spread", ["even", "short", "equal", "halves", "one"])
def test_rounds_pack_like_best_fit_decreasing(spark, spread):
    rng = random.Random(spread)
    draw = {
        "even": lambda: rng.randint(1, 100), "short": lambda: min(100, int(rng.expovariate(0.1)) + 1), "equal": lambda: 7,
        "halves": lambda: rng.choice((50, 51, 49, 34, 33, 1)), "one": lambda: 1,
    }[spread]
    sizes = [draw() for _ in range(700)]
    rows = [(i // 2, i % 2, 0, n, 0) for i, n in enumerate(sizes)] + [(0, 0, 0, sizes[0], 0)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), 100).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for own in placed.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 100
    best = best_fit_decreasing([*sizes, sizes[0]], 100)
    assert len(placed) <= best + max(1, best // 100)


@pytest.mark.parametrize("seed", range(3))
def test_ids_agree_with_the_library(seed):
    ids = packing._Ids(tokenizer("byte_bpe_50k.json"))
    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "é", "\t", "ab.", "<|endoftext|>", "½", "　", "'s", "x1", "\x00", "€", "word,", "ß!", "²", "_", "-", "中", "\x1c", "\x85", "\r\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert ids.of(t) == ids.encode(t), repr(t)


def test_urls(spark, none):
    cases = {
        None: ("", "", None, "allow"), "no-scheme/casino": ("", "", None, "block"), "http://X.Example.NET/en/1?casino": ("x.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net": ("example.net", "", None, "allow"), "http://example.net/": ("example.net", "/", "net/", "block"), "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "http://a.example.com/de/x": ("a.example.com", "/de/x", "example.com/de/", "block"), "http://a.org/fr/casino": ("a.org", "/fr/casino", "org/fr/", "allow"),
        "http://casino.org/": ("casino.org", "/", None, "block"), "http://mycasino.org/": ("mycasino.org", "/", None, "allow"), "http://free.org/x": ("free.org", "/x", None, "allow"),
        "http://free-bets.org/": ("free-bets.org", "/", None, "block"), "http://free.org/free": ("free.org", "/free", None, "allow"), "http://a.org#casino": ("a.org", "", None, "block"),
        "http://casinox.org/" + "x/" * 50_000: ("casinox.org", "/" + "x/" * 50_000, None, "allow"),
    }
    rows = [(i, u, "h", "r") for i, u in enumerate(cases)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), RULES).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge_urls(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), RULES).count() == 0


def test_repeats_against_brute_force(docs, none, spark):
    window = 35
    rows = corpus()
    own = [WORD.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
    want = []
    for r, w in zip(rows, own, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in substrings.remove_repeats(docs, window, with_text=True).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.remove_repeats(none).count() == 0
    one = " ".join(["same"] * 100)
    assert substrings.remove_repeats(spark.createDataFrame([(1, one)], "doc_id long, text string")).first().n_removed == 100


def test_paths_are_compacted_by_doubling(spark):
    """A path of 37 nodes, one of 2, a lone node and a branching one."""
    rows = [(i, 100 + i if i else 0, 101 + i) for i in range(37)] + [(50, 0, 7), (51, 7, 0), (60, 0, 0), (70, 0, 900), (71, 0, 900)]
    got = substrings.compacted(spark.createDataFrame(rows, "node long, into long, out_of long")).collect()
    assert {r.node: (r.path, r.step) for r in got} == {i: (0, i) for i in range(37)} | {50: (50, 0), 51: (50, 1), 60: (60, 0), 70: (70, 0), 71: (71, 0)}


def test_long_shared_passages_between_other_words(spark):
    """Passages of 40 to 400 words that overlap, in other surroundings and white space."""
    rng = random.Random(21)
    long = words(rng, 600, 10**6)
    texts = []
    for i in range(40):
        a, n = rng.randrange(200), rng.randrange(20, 400)
        w = words(rng, rng.randrange(50), 10**6) + long[a : a + n] + words(rng, rng.randrange(50), 10**6)
        texts.append(rng.choice((" ", "\n", " \t ")).join(w))
    own = [WORD.findall(t) for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in own for i in range(len(w) - 34))
    want = {}
    for k, w in enumerate(own):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[k] = " ".join(x for j, x in enumerate(w) if j not in gone)
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 35, with_text=True)
    assert {r.doc_id: r.kept_text for r in got.collect()} == want


def test_archives(spark, none):
    texts = ["<p>a</p>", None, "", "<p>a</p>", "é" * 4000, "WARC/1.1\r\n\r\nx", "line\r\n\r\n\r\nHTTP/1.1", "<p>a</p>", "odd"]
    rows = [(i, None if i == 3 else f"http://h/{i} x\n", t) for i, t in enumerate(texts)] + [(7, "http://h/7", "<p>a</p>"), (None, "u", "<p>a</p>"), (None, "u", "only")]
    rows += [(20, "filedesc://x 1 2", "H"), (21, "filedesc:", "1"), (22, "WARC/1.1\r\n\r\n", "x" * 3_000_000), (23, "", "\u2028\0")]
    wide = [(*r, "s", 1, "v", "k") for r in rows]  # columns with the names that the operator uses
    got = archives.convert_pages(spark.createDataFrame(wide, "page_id long, url string, html string, sha string, size int, value string, kept string")).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[t or ""] = max(i, last.get(t or "", -1))
    text = {i: t or "" for i, _, t in rows if i is not None}
    for r in got:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) in {("revisit", 7), ("response", None)}
            continue
        t = text[r.page_id]
        assert r.payload_bytes == len(t.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        kept = last[t] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if kept else ("revisit", last[t]))
    assert archives.convert_pages(none.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))).count() == 0


def test_small_payloads_do_not_revisit(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = {r.page_id: r.record_type for r in archives.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), 3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_by_version(version):
    entries = [("http://a b/", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n"), ("", "20010203040506", "text/plain", b"")]
    got = list(archives.arc_records(archives.arc_file(entries, version)))
    assert [r["content"] for r in got] == [e[3] for e in entries] and got[0]["url"] == "http://a%20b/" and ("status" in got[0]) == (version == 2)
    with pytest.raises(ValueError):
        list(archives.arc_records(archives.arc_file(entries, version)[:-20]))
    record = archives.warc_record(got[0], "k")
    assert b"WARC-Date: 2001-02-03T04:05:06Z" in record and b"WARC-Type: response" in record
    with pytest.raises(ValueError):
        list(archives.arc_records(b"filedesc://x 0.0.0.0 20000101000000 text/plain 9\n7 0 other\n\n"))


def test_archive_files_are_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdefgh", k=rng.randrange(4000))), None) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long").coalesce(2)
    archives.write_archives(pages, str(tmp_path / "w"), file_bytes=20_000)
    files = [p.read_bytes() for p in (tmp_path / "w").glob("*.txt")]
    assert len(files) > 10 and max(map(len, files)) < 20_000 + 4_000
    back = [gzip.decompress(f) for f in files]
    assert sum(f.count(b"WARC/1.1\r\n") for f in back) == 300
    assert sum(f.count(b"\x1f\x8b\x08") for f in files) >= 300  # a member for each record
    assert archives.read_archives(spark, str(tmp_path / "w")).count() == 300
