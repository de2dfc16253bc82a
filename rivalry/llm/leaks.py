"""Benchmark passages inside documents, found with spaced seeds. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry.llm.common import BROADCAST_BYTES, without, written

#: A leak is so many tokens in line (the whole item if it is shorter), of which at least AGREE per cent agree.
WINDOW, AGREE = 13, 80
#: Token offsets that each seed looks at; the others may differ. With these three, any two differing tokens
#: in 13 leave at least one seed whole, wherever the 13 lie.
MASKS = ((0, 3, 4, 5, 7), (0, 1, 2, 5, 7), (0, 1, 5, 7, 8))
SPAN = 1 + max(m[-1] for m in MASKS)
#: Offsets that all masks look at: positions whose tokens there aren't those of any seed are dropped first.
COMMON = tuple(sorted(set(MASKS[0]).intersection(*MASKS[1:])))
#: Tokens in a block of a document; blocks bound the memory of long texts.
BLOCK = 1024
#: Bytes of a seed row and of a token, by which broadcasts are sized.
SEED_BYTES, TOKEN_BYTES = 64, 16
#: Tokens to either side of a seed that a window around it can reach.
REACH = WINDOW + SPAN


def short_masks(length: int) -> list[tuple[int, ...]]:
    """The masks of an item under WINDOW tokens: every (e + 1)th token, e being the tokens that may differ.

    The masks share no token, so e differing tokens leave one of them whole.
    """
    step = length - -(-length * AGREE // 100) + 1
    return [tuple(range(i, length, step)) for i in range(step)]


def tokens_of(text: Column) -> Column:
    """Letters and digits in lower case; everything else separates."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens_of(text), lambda t: F.xxhash64(t))


def _blocks(hashes: str) -> Column:
    """Blocks of BLOCK hashes as structs (begin, lead, w): w has up to REACH hashes before the block, lead of them, and REACH after it."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0)), F.lit(BLOCK)),
        lambda b: F.struct(
            b.alias("begin"),
            F.least(b, F.lit(REACH)).alias("lead"),
            F.slice(hashes, F.greatest(b - REACH, F.lit(0)) + 1, F.lit(BLOCK + 2 * REACH)).alias("w"),
        ),
    )


def _positions(rows: DataFrame, block: int, span: int) -> DataFrame:
    """rows has `w` (hashes) and `lead`: a row (pos, c) for each of `block` positions after lead, c being the next `span` hashes."""
    slices = [F.slice("w", F.col("lead") + 1 + j, block).alias(f"c{j}") for j in range(span)]
    return rows.select("*", F.posexplode(F.arrays_zip(*slices)).alias("pos", "c"))


def _seeds(positions: DataFrame, masks: Iterable[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """A row (mask, seed) for each of the numbered masks that fits at a position."""
    masks = list(masks)
    one = lambda m: F.when(F.col(f"c.c{m[-1]}").isNotNull(), F.xxhash64(*[F.col(f"c.c{j}") for j in m]))
    rows = positions.select("*", *[one(m).alias(f"s{i}") for i, m in masks])
    rows = rows.select("*", F.expr(f"stack({len(masks)}, {', '.join(f'{i}, s{i}' for i, _ in masks)}) as (mask, seed)"))
    return rows.drop("c", *[f"s{i}" for i, _ in masks]).where("seed is not null")


def _common(positions: DataFrame) -> DataFrame:
    return positions.withColumn("common", F.xxhash64(*[F.col(f"c.c{j}") for j in COMMON]))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row (doc_id, item_id, window, agreeing, doc_token) for each document that holds a passage of a benchmark item.

    Blocks of each document give a hash of the COMMON tokens of every position, and where a seed has the
    same, a hash per mask; both meet the seeds of the benchmark. Items under WINDOW tokens have masks of
    their own length, short_masks(). Seeds carry only (item_id, place); around a hit the document's tokens
    are kept, the item's are fetched, both are laid in line, and the best window of WINDOW tokens (the whole
    item if shorter) must agree in AGREE per cent. Every passage that does is found. Seeds and items are
    broadcast while they take at most broadcast_bytes, counted first; beyond, the same joins are shuffled.

    agreeing is the most tokens that agree in such a window and doc_token the first place in the document of
    one with that many. Null or empty texts give nothing, on either side, and so do empty tables; very long
    texts, of documents and of items, are cut into overlapping blocks; an item under five tokens must agree in all of them; repeated rows
    count once; two texts under one item_id, or doc_id, count as one item, or document; a null id is an id
    like others; other columns, whatever their names, are not read.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), _hashes(F.col(item_text)).alias("item"))
    items = items.where(F.size("item") > 0).distinct().withColumn("item_key", F.xxhash64("item_id", "item"))
    items = written(items, "leaks-items")
    sizes = items.groupBy(F.least(F.size("item"), F.lit(WINDOW)).alias("n")).agg(F.sum(F.size("item")).alias("tokens")).collect()
    sized = lambda df, n: F.broadcast(df) if n <= broadcast_bytes else df
    n_tokens = sum(r.tokens for r in sizes)
    shorts = sorted(r.n for r in sizes if r.n < WINDOW)  # at most WINDOW - 1 lengths
    short = [(100 * n + i, m, n) for n in shorts for i, m in enumerate(short_masks(n))]
    span = max([SPAN, *shorts])

    rows = docs.select(F.col(id_col).alias("doc_id"), _hashes(F.col(text_col)).alias("h"))
    blocks = rows.where(F.size("h") > 0).select("doc_id", F.inline(_blocks("h")))
    laid = items.select("item_key", F.col("item").alias("w"), F.lit(0).alias("lead"))
    if any(r.n == WINDOW for r in sizes):
        own = _common(_positions(items.where(F.size("item") >= WINDOW).select("item_key", F.inline(_blocks("item"))), BLOCK, SPAN))
        seeds = _seeds(own, enumerate(MASKS)).select("item_key", (F.col("begin") + F.col("pos")).alias("item_at"), "mask", "seed", "common")
        n_bytes = len(MASKS) * n_tokens * SEED_BYTES
        places = _common(_positions(blocks, BLOCK, SPAN)).join(sized(seeds.select("common").distinct(), n_bytes), "common", "left_semi")
        hits = _seeds(places, enumerate(MASKS)).drop("common").join(sized(seeds.drop("common"), n_bytes), ["mask", "seed"])
    else:
        hits = None
    if short:
        own = _positions(laid.where(F.size("w") < WINDOW).withColumn("n", F.size("w")), 1, span)
        seeds = _seeds(own, [(i, m) for i, m, _ in short]).where(F.col("n") == F.floor(F.col("mask") / 100))
        seeds = seeds.select("item_key", F.lit(0).alias("item_at"), "mask", "seed")
        more = _seeds(_positions(blocks, BLOCK, span), [(i, m) for i, m, _ in short])
        more = more.join(sized(seeds, n_tokens * SEED_BYTES), ["mask", "seed"])
        hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        hits = blocks.where("false").select("*", *[F.lit(0).alias(c) for c in ("pos", "mask", "item_at")], F.lit(0).cast("long").alias("item_key"))
    # the tokens around the hit, from `left` before it; the item is fetched afterwards
    left = F.least(F.col("lead") + F.col("pos"), F.lit(REACH))
    around = F.slice("w", F.col("lead") + F.col("pos") - left + 1, left + SPAN + REACH)
    hits = hits.select("doc_id", "item_key", "item_at", (F.col("begin") + F.col("pos")).alias("at"), left.alias("left"), around.alias("w"))
    hits = hits.join(sized(items, n_tokens * TOKEN_BYTES), "item_key")
    # token k of the item lies beside token shift + k of w
    shift = F.col("left") - F.col("item_at")
    first = F.greatest(F.lit(0), F.col("item_at") - REACH, -shift)
    last = F.least(F.size("item"), F.col("item_at") + SPAN + REACH, F.size("w") - shift)
    hits = hits.select(
        "doc_id", "item_id",
        (F.col("at") - F.col("item_at") + first).alias("doc_token"),
        F.least(F.lit(WINDOW), F.size("item")).alias("window"),
        F.zip_with(
            F.slice("item", first + 1, F.greatest(last - first, F.lit(0))),
            F.slice("w", shift + first + 1, F.greatest(last - first, F.lit(0))),
            lambda a, b: F.when(a == b, 1).otherwise(0),
        ).alias("same"),
    )
    starts = F.sequence(F.lit(1), F.size("same") - F.col("window") + 1)
    windows = F.transform(
        starts,
        lambda i: F.struct(
            F.aggregate(F.slice("same", i, F.col("window")), F.lit(0), lambda a, x: a + x).alias("agreeing"),
            (-(F.col("doc_token") + i - 1)).alias("at"),
        ),
    )
    best = hits.where(F.size("same") >= F.col("window")).select("doc_id", "item_id", "window", F.array_max(windows).alias("best"))
    return (
        best.where(F.col("best.agreeing") * 100 >= F.col("window") * AGREE)
        .groupBy("doc_id", "item_id")
        .agg(F.max("window").alias("window"), F.max("best").alias("best"))
        .select("doc_id", "item_id", "window", F.col("best.agreeing").alias("agreeing"), (-F.col("best.at")).cast("long").alias("doc_token"))
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a passage of the benchmark, as find_leaks() tells.

    Documents with a null id, or with a null or empty text, stay; repeated rows stay or go together; all
    columns stay, whatever their names; an empty benchmark removes nothing.
    """
    return without(docs, find_leaks(docs, benchmark, id_col, text_col).select("doc_id"), id_col)
