"""Repeated passages: a sparse de Bruijn graph of token k-mers, compacted with joins and checked at its source coordinates."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivalry.llm.common import id_and_text, written
from rivalry.llm.words import Words, chunks, mix, windows

#: Words of a node. A node is the smallest k-mer of some window, so equal windows have equal nodes.
NODE = 8
_STEP = 0xD6E8FEB86659FD93


class Graph:
    """Nodes of some texts: position, hash, text number and the hash of the edge to the next node of the text."""

    def __init__(self, texts: list[bytes], window: int, node: int = NODE):
        self.words = w = Words(texts)
        h, text = w.hash, w.text
        n = len(h) - window + 1
        if n <= 0:
            self.valid = np.empty(0, np.int64)
            self.of_window = self.pos = self.valid
            self.hash = self.edge = np.empty(0, np.uint64)
            self.text = self.valid
            return
        kmers = windows(h, node)
        self.valid = np.flatnonzero(text[:n] == text[window - 1 :])  # windows within one text
        ahead = np.lib.stride_tricks.sliding_window_view(kmers, window - node + 1)
        at = np.empty(len(self.valid), np.int64)
        for i in range(0, len(at), 1 << 16):
            own = self.valid[i : i + (1 << 16)]
            at[i : i + (1 << 16)] = own + ahead[own].argmin(1)
        self.pos, self.of_window = np.unique(at, return_inverse=True)
        self.hash, self.text = kmers[self.pos], text[self.pos]
        self.edge = np.zeros(len(self.pos), np.uint64)  # 0: no next node
        for i in np.flatnonzero(self.text[1:] == self.text[:-1]).tolist():
            self.edge[i] = self.digest(int(self.pos[i]), int(self.pos[i + 1]) + node)

    def digest(self, lo: int, hi: int) -> int:
        """A hash of the words lo:hi themselves (their bytes at the source coordinates), never 0."""
        w = self.words
        starts, ends = w.starts[lo:hi], w.ends[lo:hi]
        text = w.data[starts[0] : ends[-1]]
        if ((starts[1:] - ends[:-1]) != 1).any() or b"\n" in text or b"\t" in text:
            text = b" ".join([w.data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        return xxhash.xxh3_64_intdigest(text) | 1

    def before(self) -> np.ndarray:
        """The edge that leads to each node; 0 at the first of a text."""
        out = np.zeros_like(self.edge)
        out[1:] = np.where(self.text[1:] == self.text[:-1], self.edge[:-1], np.uint64(0))
        return out


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def _lists(values: np.ndarray, texts: np.ndarray, n: int) -> pa.Array:
    ends = np.searchsorted(texts, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_longs(values)))


def _graph_rows(docs: DataFrame, window: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts, 1 << 20):
                g = Graph(texts[a:b], window)
                w = g.words
                keys = []
                for i in range(b - a):
                    own = w.hash[w.first[i] : w.first[i + 1]]
                    code = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    keys.append(np.frombuffer(code, np.int64))
                keys = np.array(keys).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(a, b - a), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                        pa.array(np.diff(w.first), pa.int64()),
                        *(_lists(v, g.text, b - a) for v in (g.hash, g.before(), g.edge)),
                    ],
                    ["key", "k1", "k2", "n_words", "node", "before", "after"],
                )

    kind = "key long, k1 long, k2 long, n_words long, node array<long>, before array<long>, after array<long>"
    return docs.select("key", "text").mapInArrow(rows, kind)


def _edges(docs: DataFrame, window: int) -> DataFrame:
    """docs (key, text, nodes, paths, steps): rows (h1, h2, key, run, known); run is start + (windows << 32).

    A repeated node has its compacted path and its step in it. Nodes in line with one path and steps in line
    are one path wherever they occur, so every window inside it is known to repeat. Windows with a repeated
    node outside such paths are rows of their own; those that a batch holds more than once are known too,
    and one row stands for them.
    """

    def rows(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            nodes, paths, steps = (batch.column(c).to_pylist() for c in ("nodes", "paths", "steps"))
            ids = np.asarray(batch.column("key").to_pylist(), np.int64)
            for a, b in chunks(texts, 4 << 20):
                g = Graph(texts[a:b], window)
                if not len(g.pos):
                    continue
                path_of, step_of = np.zeros(len(g.pos), np.int64), np.full(len(g.pos), -1, np.int64)
                hashes = _longs(g.hash)
                ends = np.searchsorted(g.text, np.arange(b - a + 1))
                for i in range(b - a):
                    own = dict(zip(nodes[a + i], zip(paths[a + i], steps[a + i], strict=True), strict=True))
                    got = [own.get(x, (0, -1)) for x in hashes[ends[i] : ends[i + 1]].tolist()]
                    if got:
                        path_of[ends[i] : ends[i + 1]], step_of[ends[i] : ends[i + 1]] = np.array(got, np.int64).T
                seen = step_of >= 0
                # compacted paths: first and last node of each node's path
                tied = np.zeros(len(seen), bool)
                tied[1:] = seen[1:] & seen[:-1] & (g.text[1:] == g.text[:-1]) & (path_of[1:] == path_of[:-1]) & (step_of[1:] == step_of[:-1] + 1)
                path = np.cumsum(~tied) - 1
                low = g.pos[~tied]
                high = g.pos[np.concatenate((np.flatnonzero(~tied)[1:], [len(tied)])) - 1] + NODE
                start = g.valid
                own_path = path[g.of_window]
                candidate = seen[g.of_window]
                known = candidate & (start >= low[own_path]) & (start + window <= high[own_path])
                open_ = np.flatnonzero(candidate & ~known)
                # the second hash only where it is sent
                h = g.words.hash
                at = start[open_]
                h1, h2 = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                f1, f2 = 1, 1
                for k in range(window):
                    x = h[at + k]
                    h1 += x * np.uint64(f1)
                    h2 += mix(x) * np.uint64(f2)
                    f1, f2 = f1 * _STEP % (1 << 64), f2 * 0xA0761D6478BD642F % (1 << 64)
                h1, h2 = mix(h1), mix(h2)
                both = np.stack((h1, h2), 1).view("u8,u8").ravel()
                _, first, back, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
                known[open_[count[back] > 1]] = True
                doc = g.words.text[start]
                offset = g.words.first[doc]
                yes = np.flatnonzero(known)
                new = np.ones(len(yes), bool)
                new[1:] = (np.diff(yes) != 1) | (doc[yes[1:]] != doc[yes[:-1]]) | (np.diff(start[yes]) != 1)
                run_at = yes[new]
                run_n = np.diff(np.concatenate((np.flatnonzero(new), [len(yes)])))
                one = open_[first]
                key = ids[a:b]
                runs = [(start[one] - offset[one]) + (1 << 32), (start[run_at] - offset[run_at]) + (run_n << 32)]
                keys = [key[doc[one]], key[doc[run_at]]]
                own1 = mix(keys[1].view(np.uint64) + runs[1].astype(np.uint64)) if len(run_at) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_longs(np.concatenate((h1[first], own1)))),
                        pa.array(np.concatenate((_longs(h2[first]), runs[1]))),
                        pa.array(np.concatenate(keys)), pa.array(np.concatenate(runs)),
                        pa.array(np.arange(len(one) + len(run_at)) >= len(one)),
                    ],
                    ["h1", "h2", "key", "run", "known"],
                )

    return docs.select("key", "text", "nodes", "paths", "steps").mapInArrow(rows, "h1 long, h2 long, key long, run long, known boolean")


def _cut(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """docs (doc_id, text, copies, runs) -> the result rows."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def rows(batches):
        for batch in batches:
            n_words, n_removed, sha, kept_texts = [], [], [], []
            texts, copies, runs = (batch.column(c).to_pylist() for c in ("text", "copies", "runs"))
            for text, many, own in zip(texts, copies, runs, strict=True):
                w = Words([text.encode()])
                n = len(w.starts)
                gone = np.zeros(n + 1, np.int64)
                if many > 1 and n >= window:
                    gone[0] = 1
                elif own:
                    r = np.asarray(own, np.int64)
                    start = r & 0xFFFFFFFF
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + (r >> 32) + window - 1, -1)
                keep = np.cumsum(gone)[:n] == 0
                kept = b" ".join([w.data[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)])
                n_words.append(n)
                n_removed.append(n - int(keep.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if with_text else None)
            out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept_texts, pa.string())] * with_text, names)

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string"
    return docs.select("doc_id", "text", "copies", "runs").mapInArrow(rows, kind + ", kept_text string" * with_text)


def compacted(nodes: DataFrame) -> DataFrame:
    """nodes (node, into, out_of) -> rows (node, path, step): nonbranching paths and the place of each node in its path.

    into and out_of are the one edge that leads to or from a node everywhere, or 0. An edge that is both the
    only way out of one node and the only way into another ties the two. Pointers to the node before are
    doubled by joins until all point to the first of their path, in as many rounds as the logarithm of the
    longest path. A text's first node has no way into it, so that paths can't be rings.
    """
    back = nodes.where("into <> 0").select("node", F.col("into").alias("edge"))
    tied = back.join(nodes.where("out_of <> 0").select(F.col("out_of").alias("edge"), F.col("node").alias("to")), "edge")
    at = nodes.select("node").join(tied.select("node", "to"), "node", "left")
    at = at.select("node", F.coalesce("to", "node").alias("path"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("step"))
    at = written(at, "substrings-paths")
    while True:
        ends = at.where("step > 0").select(F.col("node").alias("path"), F.col("path").alias("far"), F.col("step").alias("more"))
        doubled = at.where("step > 0").join(ends, "path", "left")
        doubled = doubled.select("node", F.coalesce("far", "path").alias("path"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), F.col("far").isNotNull().alias("moved"))
        doubled = written(doubled, "substrings-doubled")
        if doubled.where("moved").isEmpty():
            return at
        at = at.where("step = 0").union(doubled.drop("moved"))


def remove_repeats(
    docs: DataFrame, window: int = 35, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept_sha256[, kept_text]) per row: words in a window that starts anywhere else go.

    1. Texts with equal words are one class; only one of them goes on, and all of a class of two or more
    are repeated. 2. Each window of `window` words has its smallest NODE-mer as node; nodes met once are
    dropped. 3. An edge is a hash of the words from one node to the next, read at their source coordinates.
    Repeated nodes learn whether the edges to and from them branch, and compacted() joins nonbranching paths
    to runs of windows known to repeat. 4. The other windows of repeated nodes are counted by a 128-bit hash
    of their words and the repeated ones go back to their source coordinates. Map tasks combine equal windows
    of a batch first, so that a passage of a third of all texts is a few rows for each task; what is joined
    on a node or class is written before, so that a frequent one can be split among tasks.

    A null or empty text has no words; a text under `window` words loses nothing; a very long one is one task's
    work; repeated rows are copies of each other; overlapping runs count once; other columns, whatever their
    names, are not read; null ids are kept; an empty table gives no rows.
    """
    if window < NODE + 1:
        raise ValueError(f"window must be over {NODE}")
    rows = id_and_text(docs, id_col, text_col).select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    graph = written(_graph_rows(rows, window), "substrings-graph")
    classes = graph.groupBy("k1", "k2", "n_words").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    classes = written(classes, "substrings-copied")
    of_class = graph.select("key", "k1", "k2", "n_words").join(classes, ["k1", "k2", "n_words"])
    of_class = written(of_class.select("key", "rep", "copies").distinct(), "substrings-classes")
    reps = graph.join(of_class.where("key <> rep").select("key"), "key", "left_anti")
    met = reps.where(F.size("node") > 0).dropDuplicates(["key"]).select("key", F.inline(F.arrays_zip("node", "before", "after")))
    many = written(met.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "substrings-many")
    met = written(met.join(many, "node"), "substrings-nodes")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(0)
    paths = compacted(written(met.groupBy("node").agg(one("before").alias("into"), one("after").alias("out_of")), "substrings-branches"))
    listed = met.select("key", "node").join(paths, "node").groupBy("key").agg(F.collect_set(F.struct("node", "path", "step")).alias("own"))
    listed = listed.select("key", F.col("own.node").alias("nodes"), F.col("own.path").alias("paths"), F.col("own.step").alias("steps"))
    listed = written(listed, "substrings-listed")
    edges = _edges(rows.join(listed, "key").select("key", "text", "nodes", "paths", "steps"), window)
    counted = edges.withColumn("n", F.count("*").over(W.partitionBy("h1", "h2"))).where("known or n > 1")
    runs = counted.groupBy("key").agg(F.collect_list("run").alias("runs"))
    rows = rows.join(of_class.select("key", "copies"), "key", "left").join(runs, "key", "left")
    return _cut(rows.withColumn("copies", F.coalesce("copies", F.lit(1))), window, with_text)
