"""The registered corpus queries do their whole job."""

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from rivalry.llm import media, queries
from rivalry.llm.common import scratch_dir


@pytest.mark.parametrize("pipeline", [False, True])
def test_only_the_first_piece_is_short(spark, tmp_path, pipeline):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    texts = [" ".join(f"word{i * j % 977}" for j in range(n)) for i, n in enumerate((0, 3, 900, 1800))]
    one = " a" * 1023  # with the end id a full piece, if each word is one id
    texts += [one, one * 2, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    if pipeline:
        got = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    else:
        got = queries.op7_best_fit_packing(spark, str(tmp_path))
    own = defaultdict(list)
    for r in got.collect():
        own[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    cut = 0
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        cut += len(bounds) > 2
        want = [(k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False))]
        assert sorted(own[i]) == want
    assert cut >= 2


def test_every_part_of_a_url_is_judged(spark, tmp_path):
    cases = {
        "http://r.example.org/out?u=casino-porn.example": ("r.example.org", "/out", "block", 2), "xxx-casino.example/porn": ("", "", "block", 3),
        "http://a.org/x#casino": ("a.org", "/x", "block", 1), "http://a.org/free?q=BETS": ("a.org", "/free", "block", 0),
        "http://a.org/x?q=casinoss": ("a.org", "/x", "allow", 0), "http://a.org/fr/?casino": ("a.org", "/fr/", "allow", 1),
        None: ("", "", "allow", 0), "no-scheme": ("", "", "allow", 0),
    }
    spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.host, r.path, r.verdict, r.n_strict) for r in queries.op8_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(cases.values()))


def plain_tensor(payload):
    """The RGB tensor of a payload, without any JPEG: blocks of coefficients, inverse transform, repeated chroma, colours."""
    mcus = -(-len(payload) // 384)
    cols = min(mcus, max(64, -(-mcus // 4000)))
    rows = -(-mcus // cols)
    v = np.zeros(rows * cols * 384)
    v[: len(payload)] = media._TO[np.frombuffer(payload, np.uint8)]
    zigzag = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    basis = np.array([[np.cos((2 * i + 1) * k * np.pi / 16) * (np.sqrt(1 / 8) if k == 0 else 0.5) for k in range(8)] for i in range(8)])
    planes, at = [], 0
    for k in (2, 1, 1):
        plane = np.zeros((rows * k * 8, cols * k * 8))
        for y in range(rows * k):
            for x in range(cols * k):
                block = np.zeros((8, 8))
                for c, (i, j) in zip(v[at : at + 64], zigzag, strict=True):
                    block[i, j] = c
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis @ block @ basis.T
                at += 64
        planes.append(np.clip(np.round(plane + 128), 0, 255))
    luma, cb, cr = planes[0], *(np.kron(p, np.ones((2, 2))) - 128 for p in planes[1:])
    rgb = np.stack((luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb), 2)
    return np.clip(np.round(rgb), 0, 255).astype(int)


def test_media_are_stored_and_tensors_returned(spark, tmp_path):
    texts = ["some text", "", "x" * 3000, None, "Ünï \x00\x7f" * 90, " ".join(map(str, range(9000)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(scratch_dir(spark).removeprefix("file://"))
    seen = set(folder.glob("op1-*"))
    got = {r.doc_id: r for r in queries.op1_progressive_jpeg(spark, str(tmp_path)).collect()}
    new = [str(p) for p in set(folder.glob("op1-*")) - seen]
    assert len(new) == 1 and len(got) == len(texts)
    assert {r.doc_id: hashlib.sha256(r.media).hexdigest() for r in spark.read.parquet(*new).collect()} == {i: r.media_sha256 for i, r in got.items()}
    for i, r in got.items():
        text = (texts[i] or "").encode()
        payload = text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and len(r.rgb) == 3 * r.height * r.width
        assert r.feature.startswith(f"{r.height}x{r.width}:") and r.feature.endswith(f"{zlib.crc32(r.rgb):08x}")
        if len(text) < 5000:
            own = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3).astype(int)
            want = plain_tensor(payload)
            assert own.shape == want.shape and np.abs(own - want).max() <= 2 and (own == want).mean() > 0.85  # whole numbers are rounded once more
