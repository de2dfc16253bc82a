"""Each stage of the corpus pipeline takes effect on its own input, and the whole agrees with a brute-force version."""

import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as pipeline
from rivalry.llm import secrets
from rivalry.llm.common import scratch_dir, scratch_scope, written
from rivalry.llm.queries import tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def free(rng, n):
    return " ".join("".join(rng.choices("bcdfgaeiou", k=7)) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Tables with toxic documents, copies, benchmark passages and secrets."""
    rng, folder = random.Random(2), str(tmp_path_factory.mktemp("sf"))
    item = free(rng, 40)
    texts = {i: free(rng, 60) for i in range(300)}
    labels = []
    for i in range(300):
        toxic = i % 5 == 0
        if toxic:
            texts[i] = f"{free(rng, 20)} vermin {free(rng, 15)} nitwit {free(rng, 20)}"
        labels.append((i, int(toxic)))
    texts[1], texts[2] = texts[3], texts[3] + " end"
    texts[4] += " " + item
    texts[6] += " password=hunter2222"
    texts[7] = ""
    texts[8] = free(rng, 3000)
    texts[9] = " ".join(w if k % 9 else "other" for k, w in enumerate(item.split()))
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(900, None, "en", "s", 0), (11, texts[11], "en", "s", 1), (None, texts[12], "en", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    return folder, docs, rows, item


def toxic(i):
    return i is not None and i < 300 and i % 5 == 0


def test_stages(spark, made):
    folder, docs, rows, _ = made
    out = dict(pipeline.STAGES)
    clean = out["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows if not toxic(r[0])}
    kept = out["near_dedup"](spark, docs, folder)
    assert {r[0] for r in rows} - {r.doc_id for r in kept.collect()} == {2, 3}
    safe = out["decontamination"](spark, docs, folder)
    assert {r[0] for r in rows} - {r.doc_id for r in safe.collect()} == {4, 9}
    hidden = {r.doc_id: r for r in out["secrets"](spark, docs, folder).collect()}
    assert hidden[6].text.endswith("[REDACTED]") and hidden[6].n_chars == len(hidden[6].text) and hidden[8].text == rows[8][1] and hidden[900].text is None
    assert {r.doc_id for r in out["packing"](spark, docs, folder).collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_stages_take_empty_tables_and_clashing_columns(spark, made, stage):
    folder, docs, rows, _ = made
    step = dict(pipeline.STAGES)[stage]
    assert step(spark, docs.limit(0), folder).count() == 0
    if stage == "packing":
        return
    names = "gone spans span_doc span_key features label rep key bad text_key sequence_id".split()
    wide = docs.where("doc_id < 20").selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(names)])
    plain = step(spark, docs.where("doc_id < 20"), folder)
    assert step(spark, wide, folder).exceptAll(plain).count() == 0 and step(spark, wide, folder).count() == plain.count()


def brute(rows, item):
    """Ids, texts and pieces after each stage, in plain Python; toxic documents are known by how they were made."""
    from tokenizers import Tokenizer

    rows = [r for r in rows if not toxic(r[0])]
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    rows = [r for r in rows if r[0] is None or group[r[0]] == r[0]]
    tokens = re.findall(r"\w+", item.lower())

    def leaks(text):
        w = re.findall(r"\w+", (text or "").lower())
        return any(sum(x == y for x, y in zip(w[a : a + 13], tokens[b : b + 13], strict=True)) >= 11 for a in range(len(w) - 12) for b in range(len(tokens) - 12))

    bad = {r[0] for r in rows if leaks(r[1]) and r[0] is not None}
    assign = re.compile(secrets.BASE["assign"][0])
    rows = [(r[0], assign.sub("[REDACTED]", r[1] or "")) for r in rows if r[0] not in bad]
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    out = []
    for i, t in rows:
        own = library.encode(t, add_special_tokens=False).ids + [2]
        ends = range(len(own) % 1024 or 1024, len(own) + 1, 1024)
        for k, end in enumerate(ends):
            start = ends[k - 1] if k else 0
            out.append((i, k, start, end - start, zlib.crc32(np.array(own[start:end], "<u4").tobytes())))
    return out


def test_run_against_brute_force(spark, made):
    folder, _, rows, item = made
    got = pipeline.run(spark, folder).collect()
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=order) == sorted(brute(rows, item), key=order)
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for own in placed.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024


def test_scratch_of_a_scope_is_deleted(spark):
    before = written(spark.range(3).toDF("x"), "kept")
    with scratch_scope(spark):
        written(spark.range(3).toDF("x"), "gone")
        inside = Path(scratch_dir(spark).removeprefix("file://"))
        assert list(inside.glob("gone-*"))
    assert not inside.exists() and before.count() == 3
