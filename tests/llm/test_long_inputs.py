"""Inputs without the bounds that earlier code had: very many spans in a text, very long items, short terms, texts without spaces, ids that aren't numbers."""

import random
import re
import time

import pytest

from rivalry.llm import leaks, packing, secrets, tokens, toxicity
from rivalry.llm import phrases as PH
from rivalry.llm.queries import tokenizer


def test_secrets_of_one_text_take_linear_time(spark):
    def took(n):
        text = " ".join(f"password=hunter{i:06d} AKIAIOSFODNN7EXAMPL{i % 10} https://h{i % 7}.example.com/x" for i in range(n // 3))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        (row,) = secrets.scan_secrets(df).collect()
        assert row.n_assign == n // 3
        return time.perf_counter() - start

    took(300)
    assert took(200_000) < 60


def test_an_item_is_searched_to_its_end(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(10**6)}" for _ in range(3 * leaks.BLOCK + 500)]
    at = [0, leaks.BLOCK - 5, 2 * leaks.BLOCK + 11, len(item) - 20]
    docs = spark.createDataFrame([(i, "before " + " ".join(item[p : p + 20])) for i, p in enumerate(at)] + [(9, "none of it " * 9)], "doc_id long, text string")
    got = leaks.find_leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3} and all(r.agreeing == leaks.WINDOW and r.doc_token == 1 for r in got)


def test_toxicity_learns_short_words_under_ids_of_text(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = ["".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(30)]
        bad = rng.random() < 0.25
        for _ in range(4 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["傻", "zq"])
        rows.append((f"doc-{i}", " ".join(w)))
        labels.append((f"doc-{i}", int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(labels, "doc_id string, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, lab).collect()}
    held = [(got[d].predicted, t) for d, t in labels if got[d].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert toxicity.drop_toxic(df, lab).count() == sum(not r.predicted for r in got.values())


@pytest.mark.parametrize("text", ["語" * 5000, "ab1,x;" * 3000, "長い文。" * 2000 + " " + "x" * 9000])
def test_texts_without_spaces_are_not_kept(spark, text):
    df = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    path = tokenizer("piece_bpe_32k.model")
    lengths = tokens._Lengths({}, path)
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, path).collect()} == {1: lengths.count(text), 2: lengths.count(text + " end")}
    assert all(len(x) <= tokens.LONGEST for x in lengths)
    ids = packing._Ids(tokenizer("byte_bpe_50k.json"))
    assert ids.of(text) == ids.encode(text)
    assert all(len(x) <= packing.LONGEST for held in (ids.parts, ids.words, ids.firsts) for x in held)


def test_sentencepiece_agrees(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    text = "x" * 300 + " " + "語" * 200 + "  a"
    got = tokens.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer("piece_bpe_32k.model")).first()
    assert got.n_tokens == len(sp.encode(text)) and re.search("a$", text)


def test_summaries_of_a_partition_are_small(spark, monkeypatch):
    """What a task that merges summaries gets, which may be one Arrow batch: not three times the text of 64 MB."""
    sent = []
    monkeypatch.setattr(PH, "exact_counts", lambda *a: None)
    monkeypatch.setattr(PH, "frequent_hashes", lambda docs, sizes, least, parts, n_bytes, known=None: sent.append(n_bytes / parts) or spark.range(0).selectExpr("id AS hash"))
    docs = spark.range(64, numPartitions=4).selectExpr("repeat('ab ', 1048576) AS text", "'en' AS lang")
    PH.frequent_phrases(docs, 5, 100)
    assert len(sent) == 2 and max(sent) <= 16 << 20
