"""The trie of all conversation prefixes, with totals of subtrees rolled up in bands of depths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivalry.llm.common import written

#: Turns of a conversation that one task numbers and adds up together; longer ones are cut.
BLOCK = 256
#: Depths in a band: a node explodes to fewer ancestors than this at a time.
BAND = 8
#: Ids in one piece of a node's list of ends.
ENDS = 4096
_LOW = 0xFFFFFFFF


def numbered(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns (c, turn, ..) with i, counted from 1 by turn within c. Counts run within blocks of turn numbers, and over the blocks' sizes."""
    at = turns.withColumn("_b", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    sizes = at.groupBy("c", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("c").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("c", "_b").orderBy(F.asc_nulls_first("turn"), "content"))
    return at.withColumn("_i", own).join(sizes.select("c", "_b", before.alias("_before")), ["c", "_b"]).withColumn("i", F.col("_i") + F.col("_before")).drop("_b", "_i", "_before")


def with_prefix_keys(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (c, d, content, words), d from 0: adds k1, k2, the key of the prefix that ends there, and p1, p2, that of the prefix before.

    A key is the sum of 128-bit hashes of each turn with its depth, so that it can be added up by blocks: four sums of 32 bits each.
    """
    parts = [f"_s{i}" for i in range(4)]
    salted = [F.xxhash64("content", "d", F.lit(s)) for s in (1, 2)]
    limbs = [x for h in salted for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_LOW)))]
    rows = rows.withColumn("_b", F.floor(F.col("d") / block)).withColumns({p: F.when(F.col("d") > 0, x).otherwise(F.lit(0)) for p, x in zip(parts, limbs, strict=True)})
    blocks = rows.groupBy("c", "_b").agg(*[F.sum(p).alias(p) for p in parts])
    earlier = W.partitionBy("c").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("c", "_b", *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"_o{i}") for i, p in enumerate(parts)])
    run = W.partitionBy("c", "_b").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"_r{i}": F.sum(p).over(run) for i, p in enumerate(parts)}).join(blocks, ["c", "_b"])
    total = [(F.col(f"_r{i}") + F.col(f"_o{i}")).bitwiseAND(F.lit(_LOW)) for i in range(4)]
    last = [(F.col(f"_r{i}") + F.col(f"_o{i}") - F.col(p)).bitwiseAND(F.lit(_LOW)) for i, p in enumerate(parts)]
    joined = lambda hi, lo: F.shiftleft(hi, 32).bitwiseOR(lo)
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], joined(*total[:2]).alias("k1"), joined(*total[2:]).alias("k2"), joined(*last[:2]).alias("p1"), joined(*last[2:]).alias("p2"))


def _key(a: str = "k1", b: str = "k2") -> Column:
    return F.struct(F.col(a).alias("k1"), F.col(b).alias("k2"))


def _added(parts: DataFrame, sums: list[str]) -> DataFrame:
    return parts.groupBy("k1", "k2").agg(*[F.sum(s).alias(s) for s in sums])


def roll_up(rows: DataFrame, nodes: DataFrame, sums: list[str], band: int = BAND) -> DataFrame:
    """(k1, k2, *sums): for each node the sums over its subtree, itself included.

    rows (c, d, k1, k2): the prefixes of every conversation; nodes (k1, k2, d, conv_id, *sums), conv_id being one that has the node.
    Upwards, a node explodes to its ancestors within its band of depths; that completes what the band holds of each node. The roots of
    the bands, with what they have gathered, are nodes of a trie with a band's share of the depth, which is rolled up in the same way.
    Downwards, the total of each root of a band is added to its ancestors within the band above. So rounds are twice the logarithm of
    the depth to the base of the band, and no node explodes to more than a band's depths.
    """
    deepest = nodes.agg(F.max("d")).first()[0]
    if deepest is None:
        return nodes.select("k1", "k2", *sums)
    weights, within, above, step = nodes.select("k1", "k2", *sums), [], [], 1
    while True:
        own = rows.where(F.col("d") % step == 0).select("c", "d", "k1", "k2")
        on = [F.col("c") == F.col("conv_id"), F.col("d") == F.col("nd")]
        kept = nodes.where(F.col("d") % step == 0).select("conv_id", F.col("d").alias("nd"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
        here = own.withColumn("up", F.collect_list(_key()).over(W.partitionBy("c", F.floor(F.col("d") / (step * band))).orderBy("d").rowsBetween(W.unboundedPreceding, 0)))
        here = here.join(kept, on).select("k1", "k2", "up")
        gathered = here.join(weights, ["k1", "k2"]).select(F.explode("up").alias("a"), *sums).select("a.k1", "a.k2", *sums)
        partial = written(_added(gathered, sums), "gathered")
        within.append(partial)
        if step * band > deepest:
            break
        # the nodes strictly between a root of a band and the root of the band above it
        over = own.where("d > 0").withColumn("up", F.collect_list(_key()).over(W.partitionBy("c", F.floor((F.col("d") - 1) / (step * band))).orderBy("d").rowsBetween(W.unboundedPreceding, -1)))
        roots = over.where(F.col("d") % (step * band) == 0).join(kept, on).select("k1", "k2", "up")
        above.append(written(roots, "above"))
        step *= band
        weights = partial.join(nodes.where(F.col("d") % step == 0).select("k1", "k2"), ["k1", "k2"])
    total = within.pop()
    for partial, roots in zip(reversed(within), reversed(above), strict=True):
        passed = _added(roots.join(total, ["k1", "k2"]).select(F.explode("up").alias("a"), *sums).select("a.k1", "a.k2", *sums), sums)
        rest = partial.join(total, ["k1", "k2"], "left_anti")
        rest = rest.join(passed.toDF("k1", "k2", *[f"+{s}" for s in sums]), ["k1", "k2"], "left").select("k1", "k2", *[(F.col(s) + F.coalesce(F.col(f"+{s}"), F.lit(0))).alias(s) for s in sums])
        total = written(total.union(rest), "totals")
    return total


def _list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in their order, joined by commas; only the running hash is held."""
    key, digest, out = None, None, []
    for batch in batches:
        for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
            if (k1, k2) == key:
                digest.update(b",")
            else:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256()
            digest.update(text.encode())
    if key:
        out.append((*key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["k1", "k2", "ends_sha256"])


def end_hashes(rows: DataFrame, ids: int = ENDS) -> DataFrame:
    """(k1, k2, ends_sha256) of rows (k1, k2, c): the ids of a node are joined in pieces by ranges of ids; what fits one piece is hashed
    where it is, the pieces of the rest are streamed through a running hash."""
    pieces = rows.groupBy("k1", "k2", F.floor(F.col("c") / ids).alias("piece")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string"))).alias("text"))
    pieces = written(pieces, "ends")
    many = pieces.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    one = pieces.join(many, ["k1", "k2"], "left_anti").select("k1", "k2", F.sha2("text", 256).alias("ends_sha256"))
    more = pieces.join(many, ["k1", "k2"], "left_semi").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece")
    return one.union(more.select("k1", "k2", "text").mapInArrow(_list_hashes, "k1 long, k2 long, ends_sha256 string"))


def with_shared_openings(turns: DataFrame, every: int, most: int) -> DataFrame:
    """turns (c, i, content, words) -> (c, d, content, words): c opens with the first h turns of c - c % every, h = crc32(c) % most, and
    goes on with its own after its first h; a row of depth 0 for each c."""
    sizes = turns.groupBy("c").agg(F.count("*").alias("n"))
    base = F.col("c") - F.col("c") % every
    convs = written(sizes.withColumn("base", base).withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % most), "conversations")
    heads = turns.where((F.col("c") % every == 0) & (F.col("i") < most)).select(F.col("c").alias("base"), "i", "content", "words")
    opened = convs.join(heads, "base").where("i <= h").select("c", F.col("i").alias("d"), "content", "words")
    opens = convs.join(convs.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left").select("c", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    kept = turns.join(opens, "c").where("i > h").select("c", (F.col("i") - F.col("h") + F.col("taken")).alias("d"), "content", "words")
    top = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit("").alias("content"), F.lit(0).cast("long").alias("words"))
    return top.unionByName(opened).unionByName(kept)


def contents(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, turn, content, words): content is the MD5 of role and text, words counts [^\\x20\\x09-\\x0D]+ of the text; texts go no further."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.md5(both.cast("binary")).alias("content"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def prefix_trie(rows: DataFrame, band: int = BAND, block: int = BLOCK, ends: int = ENDS) -> DataFrame:
    """The nodes of the trie of rows (c, d, content, words), with a row of depth 0 for each c: one row per distinct prefix.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member, the depth, the
    parent's smallest member, members, children, childless nodes of the subtree, words that are repeated in the subtree beyond their
    first use, and the hash of the members that end here. A conversation with a third of all turns is cut in blocks of `block`; a
    prefix that a third of all conversations share is summed before it is shuffled. No rows give no nodes.
    """
    rows = written(with_prefix_keys(rows, block), "prefixes")
    nodes = rows.groupBy("k1", "k2", "d").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = written(nodes, "nodes")
    children = nodes.where("d > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "weighed")
    totals = roll_up(rows, nodes, ["n_leaves", "saved_tokens"], band)
    last = rows.groupBy("c").agg(F.max_by(_key(), "d").alias("key")).select("key.k1", "key.k2", "c")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("d") + 1).alias("d"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, ["k1", "k2"]).join(end_hashes(last, ends), ["k1", "k2"], "left").join(parents, ["p1", "p2", "d"], "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 4, band: int = BAND, block: int = BLOCK, ends: int = ENDS) -> DataFrame:
    """The trie of the rebuilt conversations (see with_shared_openings and prefix_trie).

    Null roles and texts count as empty. Turns go by their number, null first; turns that share a number, by the MD5 of role and text, so
    that repeated rows are turns each. Rows without a conv_id take no part. Very long texts are hashed whole; other columns aren't read;
    an empty table gives no rows.
    """
    turns = written(numbered(contents(conversations), block), "turns")
    return prefix_trie(with_shared_openings(turns, every, most), band, block, ends)
