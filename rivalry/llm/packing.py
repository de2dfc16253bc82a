"""Best-fit packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivalry.llm.common import fresh, id_and_text, written

#: Entries of a worker's cache of words, and of its cache of marks; longer ones aren't kept.
CACHE = 400_000
LONGEST = 64
PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"

#: Words that the pre-tokeniser surely cuts into letters and marks.
_PLAIN = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


class _Whole(Exception):
    """A word that can't be encoded apart from its text."""


class _Words(dict):
    """Ids of words as little-endian bytes, each with `lead` before it, kept within CACHE entries: half of them are those met since the
    other half was full, so that frequent words stay."""

    def __init__(self, owner: _Ids, lead: str):
        super().__init__()
        self.owner, self.lead, self.older = owner, lead, {}

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Whole
        if len(self) > CACHE // 2:
            self.older = dict(self)
            self.clear()
        if word in self.older:
            ids = self[word] = self.older[word]
            return ids
        if word.isalpha():
            ids = self.owner.packed(self.lead + word)
        else:
            plain = _PLAIN.fullmatch(word)
            if plain and plain[1].isalpha():
                letters, marks = plain.groups()
                ids = self[letters] + self.owner.part(marks)
            else:
                ids = self.owner.encode(self.lead + word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class _Ids:
    """Token ids of a text as little-endian bytes.

    The pre-tokeniser always cuts before one space between two other characters, and around line ends
    between such, so the ids of a text are those of its words and line ends. Texts with other spacing or with
    special strings go to the library whole, and so do words that aren't plain.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.parts: dict[str, bytes] = {}
        self.words, self.firsts = _Words(self, " "), _Words(self, "")
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = (b for b in range(256) if b not in plain)
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)} | {b: b for b in plain}
        self.single = self._by_rank(path) or self._by_library
        self.line_end = self.part("\n")

    def _by_library(self, piece: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]

    def _by_rank(self, path: str):
        """A faster form of the library's merges, from the same file: pairs are merged by the lowest id. None where the file's merges
        aren't in the order of their ids. Tokens that their own merges don't lead to are left to the library."""
        import tiktoken

        model = json.loads(Path(path).read_text())["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"].get("".join(p)) for p in pairs]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or None in ids or ids != sorted(ids):
            return None
        letters = {chr(c): b for b, c in self.alphabet.items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        texts = ((t.decode(errors="replace"), t, i) for t, i in ranks.items())
        astray = {x for x, t, i in texts if x.encode() == t and self._by_library(x) != [i]}
        fast = tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda piece: self._by_library(piece) if piece in astray else fast(piece)

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def packed(self, pretoken: str) -> bytes:
        own = self.single(pretoken)
        return struct.pack(f"<{len(own)}I", *own)

    def part(self, pretoken: str) -> bytes:
        ids = self.parts.get(pretoken)
        if ids is None:
            if len(self.parts) > CACHE:
                self.parts.clear()
            ids = self.packed(pretoken)
            if len(pretoken) <= LONGEST:
                self.parts[pretoken] = ids
        return ids

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.encode(text)
        out: list[bytes] = []
        ends = -1  # line ends before the line
        try:
            for line in text.split("\n"):
                ends += 1
                if not line:
                    continue
                if ends:  # of a run of line ends before a character the last one stands alone
                    out += [self.part("\n" * (ends - 1)), self.line_end] if ends > 1 else [self.line_end]
                    ends = 0
                first, *words = line.split(" ")
                out.append(self.firsts[first])
                out += map(self.words.__getitem__, words)
        except _Whole:
            return self.encode(text)
        if ends > 0:
            out.append(self.part("\n" * ends))
        return b"".join(out)


_WORKER: dict[str, _Ids] = {}


def _ids_of(path: str):
    """One tokenizer and cache for each Python worker, which lives on from task to task."""
    if path not in _WORKER:
        _WORKER[path] = _Ids(path)
    return _WORKER[path].of


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of each document's ids and end_id.

    Only the first piece may be below capacity.
    """
    docs = id_and_text(docs, id_col, text_col)
    end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches):
        ids_of = _ids_of(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = ids_of(text) + end
                lead = -len(ids) % wide  # what the first piece lacks
                for k, end_at in enumerate(range(wide - lead, len(ids) + wide, wide)):
                    at = max(0, end_at - wide)
                    part = ids[at:end_at]
                    for column, v in zip(rows, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[0], pa.int64())),
                    pa.array(rows[1], pa.int32()),
                    *(pa.array(r, pa.int64()) for r in rows[2:]),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(cut, PIECE.format(id=dict(docs.dtypes)["doc_id"]))


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df range-sorted by keys, with `pos` counting its rows from 0 in that order.

    Each task numbers its own range; the sizes of the ranges, a row for each task, are summed and broadcast.
    Equal rows are dealt over ranges by their place in the input.
    """
    tie = fresh(df, "tie")
    numbered = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
    numbered = written(numbered.drop(tie).withColumn("pos", F.monotonically_increasing_id()), name)
    part = F.shiftright("pos", 33)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = numbered.groupBy(part.alias("part")).count()
    sizes = written(sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), f"{name}-sizes")
    at = F.col("before") + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("part", part).join(F.broadcast(sizes), "part").withColumn("pos", at).drop("part", "before")


def _by_size(df: DataFrame, column: str, capacity: int) -> np.ndarray:
    """How many rows have each size from 0 to capacity."""
    out = np.zeros(capacity + 1, np.int64)
    for r in df.groupBy(column).count().collect():  # at most `capacity` rows
        out[r[0]] = r[1]
    return out


def sweep(items: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Match documents with successor slots: (documents of each length that win a slot, slot position of the first of them).

    items and slots count documents of each length and slots of each size. Taking lengths from the longest,
    a document wins while a slot of its size or more is left; of equal documents the first ranks win. Winners
    then take slots in the order of their lengths: each the successor of its length (the smallest slot that
    holds it) or, where that is taken, the next one. Both are prefix extremes over the sizes.
    """
    at_least = slots[::-1].cumsum()[::-1]
    longer = items[::-1].cumsum()[::-1]
    won_so_far = longer + np.minimum(0, np.minimum.accumulate((at_least - longer)[::-1])[::-1])
    won = won_so_far - np.append(won_so_far[1:], 0)
    before = won.cumsum() - won
    successor = slots.cumsum() - slots
    return won, before + np.maximum.accumulate(np.where(won > 0, successor - before, 0))


def _slots(bins: DataFrame, longest: int, shortest: int) -> DataFrame:
    """bins (sequence_id, gap) -> slots (sequence_id, gap, slot, size): a gap takes as many documents as it would of the longest."""
    n = F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("int")
    rows = bins.where(F.col("gap") >= shortest).select("sequence_id", "gap", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("slot"))
    size = F.when(F.col("slot") > 0, longest).otherwise(F.least(F.lit(longest), F.col("gap") - (F.col("n") - 1) * longest))
    return rows.select("sequence_id", "gap", "slot", size.cast("int").alias("size"))


def _slot_sizes(gaps: np.ndarray, longest: int, shortest: int) -> np.ndarray:
    """How many slots of each size _slots makes of so many gaps of each size."""
    out = np.zeros_like(gaps)
    for gap in np.flatnonzero(gaps):
        if gap >= shortest:
            n = max(1, gap // longest)
            out[longest] += gaps[gap] * (n - 1)
            out[min(longest, gap - (n - 1) * longest)] += gaps[gap]
    return out


def _runs(items: DataFrame, lo: np.ndarray, n: np.ndarray, at: np.ndarray) -> DataFrame:
    """The items of positions lo[k]:lo[k] + n[k] of each length k, with turn = at[k], at[k] + 1, ..."""
    own = np.flatnonzero(n)
    rows = [(int(k), int(lo[k]), int(n[k]), int(at[k])) for k in own]
    plan = F.broadcast(items.sparkSession.createDataFrame(rows, "run_length long, lo long, n long, at long"))
    near = items.where(F.col("length").between(int(own[0]), int(own[-1])))
    inside = (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("lo") + F.col("n"))
    near = near.join(plan, (F.col("length") == F.col("run_length")) & inside)
    return near.withColumn("turn", F.col("pos") - F.col("lo") + F.col("at")).drop("run_length", "lo", "n", "at")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give each piece a sequence_id and the offset inside it; sequences hold at most `capacity` tokens and have no holes.

    Bulk-synchronous best fit. Pieces are range-sorted by length once. Each round range-sorts the slots of
    the open gaps, lets sweep() tell which ranks win a slot and at which position, joins pieces and slots on
    that position, and updates the gaps. A gap offers one slot, or as many as it would hold of the longest
    document of the round, and a round covers lengths down to a third of the longest one left. As many
    sequences as all that is left must need beyond the gaps are opened for the longest of the rest; where
    that is none and few have won, as many as the tokens of the rest fill. Documents, gaps and matches stay distributed; the driver sees counts by size
    (at most `capacity` numbers). A sequence_id is the position of the first piece in it.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = ranked(pieces, ["length", "doc_id", "piece"], "pack-items")
    total = _by_size(items, "length", capacity)
    first, left = total.cumsum() - total, total.copy()
    left[capacity] = 0
    full = items.where(F.col("length") == capacity)
    done = [full.select(*names, F.col("pos").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    bins = pieces.sparkSession.createDataFrame([], "sequence_id long, gap long")
    sizes = np.arange(capacity + 1)
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        shortest = longest // 3 + 1
        active = np.where(sizes >= shortest, left, 0)
        lo = first + total - left
        placed = []
        gaps = _by_size(bins, "gap", capacity)
        won, at = sweep(active, _slot_sizes(gaps, longest, shortest))
        if won.any():
            slots = ranked(_slots(bins, longest, shortest), ["size", "sequence_id", "slot"], "pack-slots")
            met = _runs(items, lo, won, at).join(slots.select("sequence_id", "gap", "slot", F.col("pos").alias("turn")), "turn")
            own = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
            ahead = F.coalesce(F.sum("length").over(own), F.lit(0))
            placed.append(met.select(*names, "sequence_id", (capacity - F.col("gap") + ahead).alias("offset")))
        rest = active - won
        # sequences that are needed even if all gaps could be filled
        need = max(-(-int(((left - gaps) * sizes).sum()) // capacity), int(rest[capacity // 2 + 1 :].sum()))
        if rest.any() and need <= 0 and 16 * won.sum() < active.sum():
            need = -(-int((rest * sizes).sum()) // capacity)
        if rest.any() and need > 0:
            each = capacity // int(np.flatnonzero(rest)[-1])
            longer = rest[::-1].cumsum()[::-1] - rest
            alike = sizes > (capacity // (each + 1) if each <= 3 else 0)  # pairs and triples of like lengths go together
            opened = np.where(alike, np.clip(need * each - longer, 0, rest), 0)
            own = W.partitionBy(F.floor(F.col("turn") / each)).orderBy("turn")
            ahead = F.coalesce(F.sum("length").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            new = _runs(items, lo + won, opened, longer)
            placed.append(new.select(*names, F.first("pos").over(own).alias("sequence_id"), ahead.alias("offset")))
            won = won + opened
        placed = written(reduce(DataFrame.union, placed), "pack-placed")
        done.append(placed)
        left = left - won
        if left.any():
            filled = placed.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
            gap = F.coalesce("gap", F.lit(capacity)) - F.coalesce("filled", F.lit(0))
            bins = bins.join(filled, "sequence_id", "full").select("sequence_id", gap.alias("gap"))
            bins = written(bins.where(F.col("gap") >= int(np.flatnonzero(left)[0])), "pack-gaps")
    return reduce(DataFrame.union, done)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Every document, with end_id after its ids, is placed; only documents over `capacity` are cut, into full
    pieces of which the first may be shorter. A null or empty text is one piece of one id. Very long texts
    are encoded whole, by one worker each. Repeated rows are packed each; ties in length are ordered by
    doc_id and piece; rows with a null id are packed like others; other columns, whatever their names, are
    not read; an empty table gives no rows.
    """
    pieces = written(tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pack-pieces")
    return pack(pieces, capacity)
