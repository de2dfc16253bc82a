"""Toxicity scores: a learned lexicon as a trie, Levenshtein automata for misspelled terms, context windows for quotation."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry.llm.common import id_and_text, without, written

#: Labelled rows that are learned from, at most; taken in the order of a hash of doc_id.
TRAIN_ROWS = 8000
#: A stem is the first letters of several terms.
STEM_LENGTHS = (4, 5, 6)
#: The context window of a hit: words that tell quotation or address, and characters in which quotation marks are looked for.
WINDOW, QUOTE_REACH = 6, 40
#: Misspelled terms of four letters must keep the first one, and weigh less.
SHORT, SHORT_WEIGHT = 4, 0.5
CACHE = 200_000
#: Longer words aren't kept.
LONGEST = 64

# Words that report speech, and words that address somebody.
REPORTING = frozenset("said says called wrote word words term quote quoted dit mot dijo palabra sagte wort".split())
ADDRESS = frozenset("you your youre u tu vous te du dich ihr usted eres".split())
QUOTES = "\"“”«»„‘’"

#: Letters and digits, with marks inside that stand for letters.
_WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")


class Lexicon:
    """Terms in a trie with weights. Stems end in '*' and match any longer word. innocent words are misspellings of nothing."""

    def __init__(self, weights: dict[str, float], innocent: Iterable[str] = ()):
        self.root: dict = {}
        self.stems = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        self.terms = {t: w for t, w in weights.items() if not t.endswith("*")}
        for term, w in self.terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, w)
        # one edit leaves the first or the second half of a term whole, but for a swap of the letters in the middle
        self.halves: set[tuple[int, str]] = set()
        for t in self.terms:
            mid = len(t) // 2
            if len(t) >= SHORT:
                for x in (t, t[: mid - 1] + t[mid] + t[mid - 1] + t[mid + 1 :]):
                    self.halves |= {(len(t), x[:mid]), (len(t), "-" + x[mid:])}
        self.innocent = frozenset(innocent)
        self.known = _Known(self)

    def fuzzy(self, word: str, edits: int = 1) -> float:
        """The largest weight of a term of SHORT letters or more within `edits` of word, or 0; a swap of neighbours is one edit.

        The Levenshtein automaton of word runs along the trie: its state at a node is a row of distances
        (and the row before it, for swaps), and a branch ends where both are over `edits`.
        """
        best = 0.0
        width = len(word) + 1
        todo = [(self.root, "", tuple(range(width)), None)]
        while todo:
            node, came, row, before = todo.pop()
            for c, child in node.items():
                if c == "":
                    term, weight = child
                    if row[-1] <= edits and len(term) >= SHORT and (len(term) > SHORT or term[0] == word[0]):
                        best = max(best, weight if len(term) > SHORT else weight * SHORT_WEIGHT)
                    continue
                new = [row[0] + 1]
                for i in range(1, width):
                    v = min(new[-1] + 1, row[i] + 1, row[i - 1] + (word[i - 1] != c))
                    if before and i > 1 and word[i - 1] == came and word[i - 2] == c:
                        v = min(v, before[i - 2] + 1)
                    new.append(v)
                if min(new) <= edits or min(row) < edits:
                    todo.append((child, c, tuple(new), row))
        return best

    def near(self, word: str) -> bool:
        """Whether word has half of a term of about its length."""
        for n in (len(word) - 1, len(word), len(word) + 1):
            if (n, word[: n // 2]) in self.halves or (n, "-" + word[n // 2 - n :]) in self.halves:
                return True
        return False

    def hit(self, word: str) -> tuple[int, float] | None:
        """(0 term, 1 stem, 2 misspelled; weight) of a lower-case word, or None."""
        if word in self.terms:
            return 0, self.terms[word]
        stem = max((self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if len(word) > n), default=0.0)
        if stem:
            return 1, stem
        if len(word) >= SHORT - 1 and word not in self.innocent and self.near(word) and (w := self.fuzzy(word)):
            return 2, w
        return None

    def features(self, text: str) -> list[float]:
        """Sums of weights: terms, stems, misspelled terms, quoted hits, addressed hits; and hits for 100 words."""
        low = text.lower()
        words = _WORD.findall(low)
        sums = [0.0] * 5
        hits = 0
        own = list(set(words))
        known = {w: h for w, h in zip(own, map(self.known.__getitem__, own), strict=True) if h}
        if known:
            spots = list(_WORD.finditer(low))
            for i, m in enumerate(spots):
                h = known.get(m[0])
                if h is None:
                    continue
                hits += 1
                kind, w = h
                near = {s[0] for s in spots[max(0, i - WINDOW) : i + WINDOW + 1]}
                left, right = low[max(0, m.start() - QUOTE_REACH) : m.start()], low[m.end() : m.end() + QUOTE_REACH]
                quoted = any(sum(left.count(q) for q in QUOTES) % 2 and q in right for q in QUOTES) or bool(near & REPORTING)
                if quoted:
                    sums[3] += w
                else:
                    sums[kind] += w
                    if near & ADDRESS:
                        sums[4] += w
        return [math.log1p(x) for x in sums] + [math.log1p(100 * hits / max(1, len(words)))]


class _Known(dict):
    """Hits of words that a worker has met, within CACHE entries."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, float] | None:
        hit = self.lexicon.hit(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = hit
        return hit


FEATURES = 6
#: The last lexicon of a Python worker, which lives on from task to task.
_WORKER: dict[str, Lexicon] = {}


def _lexicon(name: str, parts: tuple[dict[str, float], list[str]]) -> Lexicon:
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Lexicon(*parts)
    return _WORKER[name]


def _held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows (doc_id, text, toxic) to learn from: at most `rows` labels outside the held-out third, which are broadcast.

    A label of 1 or more is toxic (1), any other not (0); of several labels of a document the largest counts.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max(F.col("toxic").cast("double")) >= 1).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], list[str]]:
    """Words and stems that toxic documents hold and others hardly do, with weights.

    A form counts once for each document and each word before it, whichever is fewer, so that copies of one
    document prove nothing. Its log-likelihood ratio against the base rate must be 20 or more (40 for stems,
    which also need three words). Second: the words of other documents that are one edit from a term, and so
    mean themselves. What reaches the driver is bounded by the words of the sample, which has train_rows rows.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    rows = sample.select("doc_id", "toxic", words.alias("w")).select(
        "doc_id", "toxic",
        F.inline(F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("prev"))),
    ).distinct()
    rows = written(rows, "toxic-words")
    total = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return {}, []
    base = total[1] / (total[0] + total[1])
    stems = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEM_LENGTHS]
    forms = rows.select("doc_id", "toxic", "word", "prev", F.explode(F.array_compact(F.array(F.col("word"), *stems))).alias("form"))
    rough = forms.groupBy("form").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("t >= 3 and t >= 0.8 * n").select("form")
    kept = forms.join(rough, "form")
    counts = kept.groupBy("form").agg(
        F.count_distinct("prev").alias("contexts"),
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("toxic_docs"),
        F.count_distinct(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("other_docs"),
        F.count_distinct("word").alias("words"),
    )
    t = F.least(F.col("contexts"), F.col("toxic_docs")).cast("double")
    o = F.col("other_docs").cast("double")
    p = t / (t + o)
    ratio = 2 * (t * F.log(p / base) + F.when(o > 0, o * F.log((1 - p) / (1 - base))).otherwise(0.0))
    stem = F.col("form").endswith("*")
    good = (p >= 0.9) & F.when(stem, (ratio >= 40) & (F.col("words") >= 3)).otherwise(ratio >= 20)
    top = counts.withColumn("ratio", ratio).where(good)
    weights = {r.form: 1.0 + math.log10(r.ratio / 20) for r in top.select("form", "ratio").collect()}
    lexicon = sample.sparkSession.sparkContext.broadcast(weights)

    def neighbours(batches):
        lex = Lexicon(lexicon.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if (lex.hit(w) or (0,))[0] == 2], pa.string())], ["word"])

    seen = rows.where("toxic = 0").groupBy("word").agg(F.count_distinct("doc_id").alias("n")).where("n > 1").select("word")
    return weights, [r.word for r in seen.mapInArrow(neighbours, "word string").collect()]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per row of docs; labels has (doc_id, toxic).

    The lexicon and six weights are learned from at most train_rows labelled documents outside the held-out
    third. Labels of 1 or more are toxic, all others aren't; null labels and labels of unknown documents are
    left out; without labels of both kinds every score is 0. A null or empty text has the features of a text
    without hits; a very long one is scored whole; a null doc_id isn't held out; ids are of any type that both tables have; repeated rows get equal
    scores; rows that share an id but not a text are scored apart; other columns, whatever their names, are
    not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    sample = written(labelled_sample(docs, labels, train_rows), "toxic-sample")
    weights, innocent = learn_lexicon(sample)
    lexicon, name = spark.sparkContext.broadcast((weights, innocent)), uuid.uuid4().hex

    def featured(batches):
        lex = _lexicon(name, lexicon.value)
        for batch in batches:
            values = [lex.features(t) for t in batch.column("text").to_pylist()]
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.list_(pa.float64()))], [*names, "features"])

    coefficients, intercept = [0.0] * FEATURES, None
    if weights:
        train = written(sample.mapInArrow(featured, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, features array<double>"), "toxic-train")
        model = LogisticRegression(labelCol="toxic", regParam=0.001, maxIter=50).fit(
            train.select(F.col("toxic").cast("double").alias("toxic"), array_to_vector("features").alias("features"))
        )
        coefficients, intercept = [float(x) for x in model.coefficients], float(model.intercept)
    scored = docs.select("doc_id", "text").mapInArrow(featured, f"doc_id {dict(docs.dtypes)['doc_id']}, features array<double>")
    z = F.lit(intercept if intercept is not None else 0.0)
    for i, c in enumerate(coefficients):
        z = z + F.col("features")[i] * c
    score = F.lit(0.0) if intercept is None else 1 / (1 + F.exp(-z))
    out = scored.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are predicted toxic.

    Rows with a null id stay; rows that share an id go if one of their texts is toxic; all columns stay,
    whatever their names; an empty table gives no rows.
    """
    bad = score_toxicity(docs, labels, threshold, id_col=id_col, text_col=text_col).where("predicted = 1")
    return without(docs, bad.select("doc_id"), id_col)
