"""Near-duplicate documents: min-max hashing, banding, exact confirmation, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.common import components, id_and_text, without, written
from rivalry.llm.words import Words, chunks, mix, windows

#: Each permutation gives two signature values: its minimum and its maximum.
PERMUTATIONS = 64
#: Values of a band: BAND / 2 minima and as many maxima. 32 bands of 4: a pair at similarity 0.8 is missed
#: with a chance of (1 - 0.8 ** 4) ** 32 = 5e-8, one at 0.9 with 1e-15.
BAND = 4
#: Hash groups of the profiles that bound what two sets can share.
GROUPS = 64
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 4096, dtype=np.uint64)


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The set of each text as sorted distinct hashes of `size` consecutive words (all words if fewer), A-Z lower-cased."""
    words = Words(texts, lower=True)
    out = []
    for i in range(len(texts)):
        h = words.hash[words.first[i] : words.first[i + 1]]
        out.append(np.unique(windows(h, min(size, len(h)), min(size, len(h)))) if len(h) else np.empty(0, np.uint64))
    return out


def band_keys(sets: list[np.ndarray], permutations: int = PERMUTATIONS, band: int = BAND) -> np.ndarray:
    """Min-max signatures of non-empty sets, folded into one key for each band: array (sets, bands)."""
    joined = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    low = np.empty((permutations, len(sets)), np.uint64)
    high = np.empty_like(low)
    for p in range(permutations):
        v = joined * _MULTIPLY[p] + _ADD[p]
        low[p], high[p] = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
    half = band // 2
    keys = []
    for b in range(permutations // half):
        own = range(b * half, (b + 1) * half)
        other = [(p + half) % permutations for p in own]  # a band's maxima are of other permutations than its minima
        key = np.full(len(sets), b + 1, np.uint64)
        for values in (*(low[p] for p in own), *(high[p] for p in other)):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values)
        keys.append(key)
    return np.stack(keys, 1)


def _id(df: DataFrame) -> str:
    return dict(df.dtypes)["doc_id"]


def signatures(docs: DataFrame, size: int, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """Rows (doc_id, n_shingles, key1, key2, bands): keys are equal for equal sets; no bands for empty sets."""

    def sign(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            n, k1, k2, bands = [], [], [], []
            for a, b in chunks(texts):
                sets = shingles(texts[a:b], size)
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full, permutations, band).view(np.int64).tolist()) if full else iter(())
                for s in sets:
                    n.append(len(s))
                    k1.append(int(np.add.reduce(s).astype(np.int64)) if len(s) else 0)
                    k2.append(int(np.add.reduce(mix(s + np.uint64(0x5851F42D4C957F2D))).astype(np.int64)) if len(s) else 0)
                    bands.append(next(keys) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "key1", "key2", "bands"],
            )

    return docs.mapInArrow(sign, f"doc_id {_id(docs)}, n_shingles long, key1 long, key2 long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, set): the full set of each document as sorted 64-bit hashes."""

    def full(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                sets = [s.tobytes() for s in shingles(texts[a:b], size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return docs.mapInArrow(full, f"doc_id {_id(docs)}, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * |A and B| >= percent * |A or B| holds for the full sets."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def confirm(batches):
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(confirm, f"a {_id(sets)}, b {_id(sets)}")


def _profiles(sets: DataFrame) -> DataFrame:
    """sets (doc_id, set) -> rows (doc_id, profile): how many shingles that others of these sets hold too fall in each of GROUPS hash groups."""

    def members(batches):
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                h = np.frombuffer(value.as_py(), np.int64)
                own = pa.array([key.as_py()], key.type).take(pa.array(np.zeros(len(h), np.int64)))
                yield pa.RecordBatch.from_arrays([own, pa.array(h)], ["doc_id", "shingle"])

    def count(batches):
        for batch in batches:
            out = []
            for value, own in zip(batch.column("set").to_pylist(), batch.column("own").to_pylist(), strict=True):
                h = np.frombuffer(value, np.int64)
                if own:
                    h = h[~np.isin(h, np.array(own, np.int64))]
                out.append(np.bincount((h.view(np.uint64) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "profile"])

    each = sets.mapInArrow(members, f"doc_id {_id(sets)}, shingle long")
    held = each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1")
    own = held.groupBy("doc_id").agg(F.collect_list("shingle").alias("own"))
    return sets.join(own, "doc_id", "left").select("doc_id", "set", "own").mapInArrow(count, f"doc_id {_id(sets)}, profile array<int>")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, band: int = BAND, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of docs; doc_id is of any type with an order.

    1. Documents with equal sets form a class, which its smallest doc_id stands for.
    2. Classes meet in the buckets of the bands of their min-max signatures. Two star rounds confirm each
       class against the smallest, then the largest, of each of its buckets on full sets, and join what is
       linked into components. 3. Every pair of a bucket that lies in two components is then confirmed, so
       each candidate pair is either confirmed, refused, or already connected; nothing is capped. What is
       joined on a class or bucket is written before, so that a frequent one can be split among tasks.

    A text without words is linked with nothing, as is a null one; fewer than `size` words count as one
    shingle; a very long text is one task's work; rows with a null id get a component of null and are kept;
    rows that repeat a doc_id are one document, and where their texts differ the links of the id are
    confirmed on the text whose set comes last in byte order; ties don't arise, since components have a
    smallest id; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    signed = written(signatures(docs, size, permutations, band), "neardup-signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("key1", "key2", "n_shingles").agg(F.min("bands").alias("bands"), F.min("doc_id").alias("rep"))
    classes = written(classes, "neardup-classes")
    buckets = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    buckets = written(buckets.join(written(shared, "neardup-shared"), "bucket"), "neardup-buckets")
    near = (F.least("n", "m") * 100) >= (F.greatest("n", "m") * percent)  # sizes bound the similarity

    ids = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = _sets(docs.join(ids, "doc_id", "left_semi"), size)
    sets = written(sets.groupBy("doc_id").agg(F.max("set").alias("set")), "neardup-sets")
    member = buckets.select("rep").distinct().withColumn("comp", F.col("rep"))
    links, tried, own = None, None, None
    for stage in ("first", "best", "rest"):
        rows = buckets.join(member, "rep") if links is not None else buckets.withColumn("comp", F.col("rep"))
        able = F.lit(True)
        other = {"rep": "b", "n": "m", "comp": "other"}
        if stage != "first":
            open_ = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
            rows = rows.join(written(open_.select("bucket"), "neardup-split"), "bucket", "left_semi")
            if own is None:
                own = _profiles(sets.join(rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
                own = own.withColumn("most", F.aggregate("profile", F.lit(0), lambda a, x: a + x))
                own = written(own.withColumnRenamed("doc_id", "rep"), "neardup-profiles")
            rows = written(rows.join(own, "rep").where(F.col("most") * 100 >= F.col("n") * percent), "neardup-open")
            enough = lambda x: x * (100 + percent) >= (F.col("n") + F.col("m")) * percent
            common = F.aggregate(F.zip_with("profile", "its_profile", lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
            able = enough(F.least("most", "its")) & enough(common)
            other |= {"most": "its", "profile": "its_profile"}
        if stage == "rest":
            right = rows.withColumnsRenamed(other)
            pairs = rows.withColumnRenamed("rep", "a").join(right, "bucket").where(F.expr("a < b and comp <> other") & near & able)
        else:
            # the smallest of a bucket, then the one with the smallest share of shingles of its own
            at = F.lit(0.0) if stage == "first" else -F.col("most") / F.col("n")
            star = rows.groupBy("bucket").agg(F.min(F.struct(at, *other)).alias("s"))
            star = written(star.select("bucket", *[F.col(f"s.{k}").alias(v) for k, v in other.items()]), "neardup-stars")
            pairs = rows.withColumnRenamed("rep", "a").join(star, "bucket").where(F.expr("comp <> other") & near & able)
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "neardup-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = written(_confirmed(pairs, sets, percent), "neardup-links")
        links = found if links is None else links.union(found)
        joined = written(components(links, "neardup-comp"), "neardup-members")
        member = buckets.select("rep").distinct().join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        member = member.select("rep", F.coalesce("component", "rep").alias("comp"))
    # classes are found by smallest doc_id; the component of a class is that of its members
    named = classes.select("key1", "key2", F.col("n_shingles").alias("n"), "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    named = written(named.select("key1", "key2", "n", F.coalesce("component", "rep").alias("component")), "neardup-named")
    same = (signed.key1 == named.key1) & (signed.key2 == named.key2) & (signed.n_shingles == named.n)
    out = signed.join(named, same & (signed.n_shingles > 0) & signed.doc_id.isNotNull(), "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id.

    Rows with a null id, or a null or empty text, stay; rows that repeat an id stay or go together; all
    columns stay, whatever their names; an empty table gives no rows.
    """
    gone = near_duplicates(docs, size, percent, id_col=id_col, text_col=text_col).where("not kept")
    return without(docs, gone.select("doc_id"), id_col)
