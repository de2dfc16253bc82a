"""Frequent phrases and their collocation scores: mergeable summaries find what can be frequent, a second pass counts exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivalry.llm.common import BROADCAST_BYTES, written
from rivalry.llm.words import Words, chunks, mix, windows

#: Bytes of text for each hash partition of the summaries. What is sent to one may come in one Arrow batch and is some two to three
#: times as long.
PARTITION_BYTES = 16 << 20
#: Entries of a worker's summaries, over all its hash partitions, that it holds before it sends them on.
HELD = 1_000_000
#: Phrases that a worker counts before it sends them on.
COUNTED = 200_000
#: A summary's error stays below this share of the threshold.
SHARE = 0.5
#: A language's candidates are ranked in so many parts first.
PARTS = 64

_BREAKS = bytes(range(256)).maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_SECOND = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Words [^\\x20\\x09]+ of the pieces of texts between [.,;:!?\\x0A-\\x0D], A-Z lower-cased: hashes, and for each word how many
    follow it in its piece."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        data = b"\n".join(texts).translate(_BREAKS)
        self.words = w = Words([data], lower=True)
        raw = np.frombuffer(w.data, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text = np.searchsorted(np.cumsum(sizes), w.starts, "right")
        #: the language is part of a word
        self.hash = mix(w.hash ^ langs[self.text])
        piece = np.searchsorted(np.flatnonzero(raw == 10), w.starts)
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if len(piece) else np.empty(0, np.int64)
        self.after = last[np.searchsorted(last, np.arange(len(piece)))] - np.arange(len(piece))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of all phrases of k words, and the phrases' hashes."""
        at = np.flatnonzero(self.after >= k - 1)
        if k == 1:
            return at, self.hash
        return at, windows(self.hash, k, k)[at]

    def phrase(self, at: int, k: int) -> bytes:
        w = self.words
        return b" ".join(w.data[w.starts[i] : w.ends[i]].lower() for i in range(at, at + k))


def lang_keys(langs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in langs), np.uint64, len(langs))


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """Misra-Gries counters that can be merged. No count is too high; each is too low by `error` at most, which stays under `most`.

    Reducing n counters to `size` takes the (size + 1)-th highest count from each, so the error is at most mass / (size + 1): a size of
    mass / most is enough. Where the mass turns out higher and the error would pass `most`, the summary doubles its size instead.
    """

    def __init__(self, most: float, size: int):
        self.most, self.size, self.error = most, size, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > self.size:
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.keys, self.counts = counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self.waiting, self.n_waiting = [], 0
        if len(self.keys) > self.size:
            cut = int(np.partition(self.counts, len(self.counts) - self.size - 1)[len(self.counts) - self.size - 1])
            if self.error + cut >= self.most:
                self.size *= 2
                return
            self.error += cut
            kept = self.counts > cut
            self.keys, self.counts = self.keys[kept], self.counts[kept] - cut

    def reaching(self, least: int) -> np.ndarray:
        """Keys whose true count may be `least` or more."""
        self.settle()
        return self.keys[self.counts + self.error >= least]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[Pieces, list[str]]]:
    texts = [t.encode() for t in batch.column(0).to_pylist()]
    langs = batch.column(1).to_pylist()
    for a, b in chunks(texts):
        yield Pieces(texts[a:b], lang_keys(langs[a:b])), langs[a:b]


def _known(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def frequent_hashes(docs: DataFrame, sizes: tuple[int, ...], least: int, parts: int, n_bytes: int, known=None) -> DataFrame:
    """(hash) of every phrase of one of `sizes` words that occurs `least` times, and of some that occur less often.

    docs (text, lang), n_bytes: the texts' length, from which the summaries' size is reckoned at a word for four bytes. known: a broadcast sorted array of the hashes of frequent pairs; phrases with another pair in them can't be
    frequent. Workers add up the phrases of their texts in each hash partition; these summaries without error are merged where the
    partition is, in memory that holds mass / (SHARE * least) counters.
    """

    size = max(1 << 12, int(n_bytes / 4 / parts * len(sizes) / (SHARE * least)))

    def summarise(batches):
        def sent(held: list[np.ndarray], counts: list[np.ndarray]):
            keys, n = counted(np.concatenate(held), np.concatenate(counts))
            ends = np.searchsorted(keys, np.array([((p << 64) // parts) for p in range(1, parts)], np.uint64)) if parts > 1 else np.empty(0, int)
            ends = np.concatenate(([0], ends, [len(keys)]))
            own = [p for p in range(parts) if ends[p] < ends[p + 1]]
            blob = [(keys[ends[p] : ends[p + 1]].tobytes(), n[ends[p] : ends[p + 1]].astype(np.uint32).tobytes()) for p in own]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([x for x, _ in blob], pa.binary()), pa.array([y for _, y in blob], pa.binary())], ["part", "keys", "counts"])

        held, counts, waiting = [], [], 0
        for batch in batches:
            for pieces, _ in _texts(batch):
                pairs = None
                if known is not None:
                    at, keys = pieces.grams(2)
                    pairs = np.zeros(len(pieces.hash) + 1, np.int64)
                    pairs[at + 1] = _known(keys, known.value)
                    pairs = np.cumsum(pairs)
                for k in sizes:
                    at, keys = pieces.grams(k)
                    if pairs is not None:
                        keys = keys[pairs[at + k - 1] - pairs[at] == k - 1]
                    if len(keys):
                        keys, n = counted(keys)
                        held.append(keys)
                        counts.append(n)
                        waiting += len(keys)
                if waiting > HELD:
                    keys, n = counted(np.concatenate(held), np.concatenate(counts))
                    held, counts, waiting = [keys], [n], len(keys)
                    if waiting > HELD // 2:
                        yield sent(held, counts)
                        held, counts, waiting = [], [], 0
        if waiting:
            yield sent(held, counts)

    def merge(batches):
        merged: dict[int, Summary] = {}
        for batch in batches:
            for part, keys, counts in zip(*batch.columns, strict=True):  # the batch's own memory, not copied
                merged.setdefault(part.as_py(), Summary(SHARE * least, size)).add(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32))
        for own in merged.values():
            yield pa.RecordBatch.from_arrays([pa.array(own.reaching(least).view(np.int64))], ["hash"])

    sent = docs.select("text", "lang").mapInArrow(summarise, "part int, keys binary, counts binary")
    return sent.repartition(parts, "part").mapInArrow(merge, "hash long")


_ENTRY = ["lang", "k", "phrase", "f"]


def exact_counts(docs: DataFrame, longest: int, least: int, parts: int, known=None, hashes: DataFrame | None = None) -> DataFrame:
    """(lang, k, phrase, f): counts of the phrases of 1 to `longest` words whose hashes are known, and k = 0 for the number of words.

    known: a broadcast sorted array of hashes. Or hashes: the same as a table, which is joined after each task has added up its phrases.
    Tasks send what they have added up in lists, one for each of the `parts` partitions that add them up again.
    """

    def count(batches):
        totals: dict[str, int] = {}
        seen: dict[tuple[int, int], list] = {}  # hash and second hash -> lang, k, phrase and count

        def sent():
            held = [(xxhash.xxh3_64_intdigest(x.encode()), x, 0, "", n) for x, n in totals.items()]
            held += [(h, x, k, phrase.decode(), n) for (h, _), (x, k, phrase, n) in seen.items()]
            seen.clear()
            totals.clear()
            own: dict[int, list] = {}
            for row in held:
                own.setdefault(row[0] % parts, []).append(row)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()]
            lists = [[[r[i] if i else (r[0] ^ (1 << 63)) - (1 << 63) for r in rows] for rows in own.values()] for i in range(5)]
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, kinds, strict=True))], ["part", "hash", *_ENTRY])

        for batch in batches:
            for pieces, langs in _texts(batch):
                for i, n in zip(*np.unique(pieces.text, return_counts=True), strict=True):
                    totals[langs[i]] = totals.get(langs[i], 0) + int(n)
                sizes = pieces.words.ends - pieces.words.starts
                other = mix(pieces.hash * _SECOND + sizes.astype(np.uint64))
                for k in range(1, longest + 1):
                    at, keys = pieces.grams(k)
                    if known is not None:
                        kept = _known(keys, known.value)
                        at, keys = at[kept], keys[kept]
                    if not len(at):
                        continue
                    second = other[at] if k == 1 else windows(other, k, k + 100)[at]
                    order = np.lexsort((second, keys))
                    at, keys, second = at[order], keys[order], second[order]
                    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (second[1:] != second[:-1])))
                    n = np.diff(np.append(first, len(keys)))
                    for i, h, s, c in zip(at[first].tolist(), keys[first].tolist(), second[first].tolist(), n.tolist(), strict=True):
                        old = seen.get((h, s))
                        if old:
                            old[3] += c
                        else:
                            seen[h, s] = [langs[pieces.text[i]], k, pieces.phrase(i, k), c]
                if len(seen) > COUNTED:
                    yield sent()
        yield sent()

    def add(batches):
        total: dict[tuple, int] = {}
        for batch in batches:
            for lists in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                for *entry, n in zip(*lists, strict=True):
                    entry = tuple(entry)
                    total[entry] = total.get(entry, 0) + n
        rows = [(*entry, n) for entry, n in total.items() if not entry[1] or n >= least]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], _ENTRY)

    kind = ", ".join(f"{n} array<{t}>" for n, t in zip(["hash", *_ENTRY], ["long", "string", "int", "string", "long"], strict=True))
    out = docs.select("text", "lang").mapInArrow(count, f"part int, {kind}")
    if hashes is None:
        return out.repartition(parts, "part").mapInArrow(add, "lang string, k int, phrase string, f long")
    out = out.select(F.explode(F.arrays_zip("hash", *_ENTRY)).alias("x")).select("x.*")
    out = out.where("k = 0").union(out.join(hashes.distinct(), "hash", "left_semi"))
    return out.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= least))


def _collected(hashes: DataFrame, most: int):
    """The sorted hashes as a broadcast, if they are `most` bytes at most."""
    n = hashes.count()
    if 8 * n > most:
        return None
    keys = np.array([r.hash for r in hashes.toLocalIterator()], np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(np.unique(keys))


def frequent_phrases(docs: DataFrame, longest: int, least: int, broadcast_bytes: int = BROADCAST_BYTES // 2) -> DataFrame:
    """docs (text, lang) -> (lang, k, phrase, f): all phrases of 1 to `longest` words that occur `least` times or more; k = 0: all words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(size // PARTITION_BYTES)
    short = written(frequent_hashes(docs, tuple(range(1, min(longest, 2) + 1)), least, parts, size), "short")
    known = _collected(short, broadcast_bytes)
    hashes = short
    if longest > 2:
        hashes = short.union(written(frequent_hashes(docs, tuple(range(3, longest + 1)), least, parts, size, known), "long"))
    known = _collected(hashes, broadcast_bytes)
    return exact_counts(docs, longest, least, parts, known, None if known else hashes)


def _joined(words: Column, start: int | Column, n: int | Column) -> Column:
    return F.concat_ws(" ", F.slice(words, start, n))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, scale: int = 1000, cover: int = 100, text_col: str = "text", lang_col: str = "lang", broadcast_bytes: int = BROADCAST_BYTES // 2) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the `top` phrases of 2 to `longest` words by score.

    First pass: the phrases of each hash partition go into Misra-Gries summaries whose error stays below half of `least`, so that every
    phrase that occurs `least` times survives; words and pairs first, then the longer ones whose pairs have all survived (where these are
    few enough to be broadcast). Second pass: the survivors are counted exactly, by their words. Then n counts all words of the language,
    a the phrase; of all cuts of the phrase into two, of which l and r count the parts, the lowest score floor(scale * a * n / (l * r)) is
    kept, ties to the shortest first part. A phrase inside a longer one goes if 100 * f(longer) >= cover * a. Products are decimals.

    Null texts are empty, a null language is `und`; very long texts are read whole, in blocks; repeated rows count each; ties in score
    go by a, then by the bytes of the phrase; other columns aren't read; no frequent phrase gives no rows.
    """
    docs = docs.select(F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(lang_col, F.lit("und")).alias("lang"))
    counts = written(frequent_phrases(docs, longest, least, broadcast_bytes), "phrases")
    part = lambda name: counts.where("k > 0").select("lang", F.col("phrase").alias(f"{name}_phrase"), F.col("f").alias(name))
    words = F.split("phrase", " ")
    cand = counts.where("k >= 2").withColumnRenamed("f", "a")
    cuts = cand.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"l_phrase": _joined(words, 1, F.col("cut")), "r_phrase": _joined(words, F.col("cut") + 1, F.col("k") - F.col("cut"))})
    cuts = cuts.join(part("l"), ["lang", "l_phrase"]).join(part("r"), ["lang", "r_phrase"]).join(counts.where("k = 0").select("lang", F.col("f").alias("n")), "lang")
    big = lambda c: f"cast({c} AS decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({big('a')} * {big('n')} * {int(scale)}BD) div ({big('l')} * {big('r')})"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    inner = cand.where("k >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))).select("lang", _joined(words, F.col("at"), F.col("size")).alias("phrase"), "a")
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(held, ["lang", "phrase"], "left").where(F.coalesce("longer", F.lit(0)) * 100 < F.col("a") * cover)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    kept = kept.withColumn("part", F.pmod(F.hash("phrase"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
