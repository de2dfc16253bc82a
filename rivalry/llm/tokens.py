"""Token counts per text: a two-tier lookup of pre-token lengths inside map tasks."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.common import id_and_text

#: Entries of the broadcast table, and those that one task proposes for it.
FREQUENT = 50_000
PER_TASK = 20_000
#: A worker forgets its rare pre-tokens beyond this many, and never keeps one of more characters: texts without spaces are one pre-token.
CACHE = 300_000
LONGEST = 64


def _processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def check_model(model_path: str) -> None:
    """Pre-tokens can be counted apart only if no piece holds a space mark after another character and text isn't rewritten."""
    sp = _processor(model_path)
    mark = "▁"
    if any(mark in sp.id_to_piece(i).lstrip(mark) for i in range(sp.get_piece_size())):
        raise ValueError("a piece crosses word borders; pre-token lengths can't be added up")
    if sp.encode("a  b", out_type=str) != [mark + "a", mark, mark + "b"]:
        raise ValueError("the model merges spaces; pre-token lengths can't be added up")


class _Lengths(dict):
    """Lengths of pre-tokens that follow a space. Misses are encoded and kept, within CACHE entries."""

    def __init__(self, frequent: dict[str, int], model_path: str):
        super().__init__(frequent)
        self.frequent, self.sp = frequent, _processor(model_path)

    def __missing__(self, piece: str) -> int:
        n = len(self.sp.encode(piece))  # the model puts a space before a text by itself
        if len(piece) <= LONGEST:
            if len(self) > len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        pieces = text.split(" ")
        if "" in pieces or "▁" in text:  # runs of spaces merge with what follows: leave such texts to the library
            return self._spaced(text)
        return sum(map(self.__getitem__, pieces))

    def _spaced(self, text: str) -> int:
        """A run of spaces belongs to the word after it. The library adds the first space of each part."""
        if "▁" in text:
            return len(self.sp.encode(text))
        total, run = 0, 0
        pieces = text.split(" ")
        for piece in pieces[:-1]:
            if piece:
                total, run = total + self[" " * run + piece], 0
            else:
                run += 1
        if not run and not pieces[-1]:
            return total + 1  # one last space is a piece of its own; the library drops it where it stands alone
        return total + self[" " * run + pieces[-1]]


def frequent_pretokens(docs: DataFrame, size: int = FREQUENT) -> DataFrame:
    """Frequent pre-tokens: of those that tasks propose, the `size` with the highest counts.

    Each task counts its own pre-tokens, forgetting rare ones where they are many, and proposes PER_TASK of
    them; only these proposals are shuffled. The table is about, not exactly, the most frequent ones: which
    they are changes the speed of the lookup and never a count.
    """

    def propose(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(x for x in text.split(" ") if 0 < len(x) <= LONGEST)
            if len(seen) > 20 * PER_TASK:
                seen = Counter(dict(seen.most_common(10 * PER_TASK)))
        top = [(k, n) for k, n in seen.most_common(PER_TASK) if n > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"]
        )

    return (
        docs.select("text")
        .mapInArrow(propose, "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(size)
    )


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) per input row.

    First tier: a broadcast table of at most `frequent` lengths. Second tier: the worker's own cache, filled
    by the library. The texts' pre-tokens are never shuffled, only each task's proposals for the table. A null
    or empty text has 0 bytes and 0 tokens; a very long one is counted whole; repeated rows give repeated
    results; null ids are kept; ties in frequency go by the pre-token; other columns, whatever their names,
    are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    check_model(model_path)
    docs = id_and_text(docs, id_col, text_col)
    words = [r.piece for r in frequent_pretokens(docs, frequent).collect()]  # at most `frequent` short strings
    sp = _processor(model_path)
    shared = spark.sparkContext.broadcast(dict(zip(words, map(len, sp.encode(words)), strict=True)) if words else {})

    def count(batches):
        lengths = _Lengths(shared.value, model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [lengths.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
