"""Secrets in texts, with the parts of one credential linked. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivalry.llm.common import fresh, written

# The base patterns, the shortest value that counts, and the group that holds it.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Weak candidates: they count only beside their complement.
WEAK = {
    "ident": (
        r"""(?i)(user_?name|user_?id|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, 3,
    ),
    "endpoint": (r"(?i)(https?|ftp|postgres|mysql|redis|amqp)://([A-Za-z0-9@:._-]+)", 2, 4),
    "value": (r"[A-Za-z0-9+/_-]{16,}", 0, 16),
}
KINDS = [*BASE, *WEAK]
#: The part of a credential that each kind is, and the parts that a weak kind needs beside it.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "endpoint": "place", "value": "secret"}
NEEDS = {"ident": ["secret"], "endpoint": ["id", "secret"], "value": ["id"]}
#: Parts belong together within one scope and so many characters.
REACH = 200
#: A scope ends at a blank line.
BREAK = r"\n[\x20\t]*\n"
#: Matches of a block, and characters of one: long texts are worked on block by block.
BLOCK, CHARS = 128, (1 << 18, 1 << 12)

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once: what a lambda captures as an expression is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(sizes: Column) -> Column:
    """Prefix sums of an array of ints, a column. Blocks are summed first, so that long arrays aren't copied for each element."""
    none = F.array().cast("array<int>")

    def sums(x: Column, start: Column) -> Column:
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out"))
        return F.aggregate(x, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(BLOCK))
    totals = F.transform(starts, lambda i: F.aggregate(F.slice(sizes, i, BLOCK), F.lit(0), lambda a, v: a + v))
    ahead = F.concat(F.array(F.lit(0)), sums(totals, F.lit(0)))
    blocks = F.zip_with(starts, ahead, lambda i, at: F.when(i.isNotNull(), sums(F.slice(sizes, i, BLOCK), at)).otherwise(none))
    return F.when(F.size(sizes) > BLOCK, F.flatten(blocks)).otherwise(sums(sizes, F.lit(0)))


def _matches(text: Column, pattern: str, group: int, least: int, mixed: bool = False) -> Column:
    """Leftmost non-overlapping matches as struct(step, size, good): lengths from the end of one to the end of the next, own lengths, which count.

    The text between matches (split) and the matches themselves give the lengths. Short matches don't count;
    with mixed, neither do those without a digit, a small and a capital letter. Null without any match.
    """
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps, sizes = F.transform(F.split(text, pattern, -1), F.length), F.transform(match, F.length)
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else sizes
    good = F.transform(value, lambda n: n >= least)
    if mixed:
        good = F.zip_with(good, match, lambda g, m: g & m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]"))
    steps = F.zip_with(gaps, sizes, lambda g, n: g + F.coalesce(n, F.lit(0)))
    return F.when(text.rlike(pattern), F.struct(steps.alias("step"), sizes.alias("size"), good.alias("good")))


def with_spans(docs: DataFrame, patterns: dict[str, tuple], text: Column, keep: list[Column]) -> DataFrame:
    """keep of docs, and for each (pattern, group, least, kind, mixed) a column of that name: array<struct(start, kind, end)> in code points."""
    rows = docs.select(*keep, *[_matches(text, p, g, n, mixed).alias(k) for k, (p, g, n, _, mixed) in patterns.items()])
    names = [c for c in rows.columns if c not in patterns]
    rows = rows.select(*names, *patterns, *[F.when(F.col(k).isNotNull(), running_sums(F.col(f"{k}.step"))).alias(f"{k}_end") for k in patterns])

    def spans(k: str) -> Column:
        found = F.filter(F.arrays_zip(F.col(f"{k}_end").alias("end"), F.col(f"{k}.size").alias("size"), F.col(f"{k}.good").alias("good")), lambda x: x["good"])
        made = F.transform(found, lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(patterns[k][3]).alias("kind"), x["end"].alias("end")))
        return F.coalesce(made.cast(SPANS), F.array().cast(SPANS)).alias(k)

    return rows.select(*names, *map(spans, patterns))


def _longer(pattern: str, least: int) -> str:
    """Patterns that are one run of a class match the same runs when the shortest length is asked for at once."""
    return f"{pattern[:-1]}{{{least},}}" if pattern.endswith("]+") else pattern


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_key, base, linked) of docs: sorted base spans, and sorted weak spans whose complement is near.

    Interval join: parts of a document lie in cells of REACH characters; a weak part looks up the first and
    last start of each role in its own cell and both neighbours, so no pairs of parts are made. Scopes and
    overlaps with base spans come from windows over a document's spans in the order of their starts, with frames that only grow.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = {"access": _longer(BASE["access"][0], BASE["access"][2] - 4), "hex": _longer(BASE["hex"][0], BASE["hex"][2])}
    patterns = {k: (runs.get(k, BASE[k][0]), *BASE[k][1:], KINDS.index(k), False) for k in BASE}
    patterns |= {k: (*WEAK[k], KINDS.index(k), k == "value") for k in WEAK} | {"breaks": (BREAK, 0, 0, -1, False)}
    rows = with_spans(docs, patterns, text, [F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key")])
    rows = rows.select("doc_id", "text_key", F.array_sort(F.concat(*BASE)).alias("base"), F.concat(*WEAK).alias("weak"), "breaks")
    rows = written(rows, "secrets")
    own = W.partitionBy("doc_id", "text_key").orderBy("start")
    later = W.partitionBy("doc_id", "text_key").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, -1)
    strong, open_ = F.col("kind").between(0, len(BASE) - 1), F.col("kind") == -1
    parts = (
        rows.where(F.size("weak") > 0)
        .select("doc_id", "text_key", F.concat("base", "weak", "breaks").alias("parts")).distinct()
        .select("doc_id", "text_key", F.inline("parts"))
        .withColumn("scope", F.count(F.when(open_, 1)).over(own.rangeBetween(W.unboundedPreceding, -1)))
        .withColumn("covered", F.max(F.when(strong, F.col("end"))).over(own.rangeBetween(W.unboundedPreceding, 0)) > F.col("start"))
        .withColumn("cut", F.min(F.when(strong, F.col("start"))).over(later) < F.col("end"))
    )
    clash = F.coalesce("covered", F.lit(False)) | F.coalesce("cut", F.lit(False))
    parts = parts.where(~open_ & (strong | ~clash)).drop("covered", "cut").withColumn("cell", F.floor(F.col("start") / REACH))
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    needs = F.element_at(F.array(*[F.array(*map(F.lit, NEEDS.get(k, []))).cast("array<string>") for k in KINDS]), F.col("kind") + 1)
    key = ["doc_id", "text_key", "scope", "cell", "role"]
    cells = parts.withColumn("role", role).groupBy(*key).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    cells = cells.withColumnsRenamed({k: f"of_{k}" for k in key})
    sought = (
        parts.withColumn("role", F.explode(needs))
        .withColumn("own", F.col("cell"))
        .withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id"))
    for k in key[1:]:
        same = same & (F.col(k) == F.col(f"of_{k}"))
    near = (F.col("cell") == F.col("own")) | F.when(
        F.col("cell") < F.col("own"), F.col("last") >= F.col("start") - REACH
    ).otherwise(F.col("first") <= F.col("start") + REACH)
    linked = (
        sought.join(cells, same)
        .select("doc_id", "text_key", "role", "start", "kind", "end", near.alias("near"))
        .where("near")
        .groupBy("doc_id", "text_key", "start", "kind", "end")
        .agg(F.count_distinct("role").alias("met"))
        .where(F.col("met") == F.size(needs))
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
        .select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "linked")
    )
    return rows.join(linked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select(
        "doc_id", "text_key", "base", F.coalesce("linked", F.array().cast(SPANS)).alias("linked")
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) per input row.

    A null or empty text has no spans; in very long texts matches are summed block by block; repeated rows
    give repeated results; rows that share an id but not a text are judged apart; two kinds that start
    together are ordered as in KINDS; null ids are kept; other columns, whatever their names, are not read;
    an empty table gives no rows.
    """
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found_spans(docs, id_col, text_col).select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("base", "linked"))).alias("spans"), F.size("linked").cast("long").alias("n_linked"),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with each run of overlapping spans replaced by mask, by blocks of characters that see only the spans they meet."""

    def pieces(part: Column, begin: Column, own: Column, size: int, inner) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(part) - 1, F.lit(0)), F.lit(size))
        met = lambda i: F.filter(own, lambda s: (s["start"] < begin + i + size) & (s["end"] > begin + i))
        one = lambda i: F.struct(F.substring(part, i + 1, F.lit(size)).alias("part"), (begin + i).alias("begin"), met(i).alias("own"))
        return F.array_join(F.transform(starts, lambda i: _let(one(i), lambda x: inner(x["part"], x["begin"], x["own"]))), "")

    def small(part: Column, begin: Column, own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            lo, hi = F.greatest(s["start"] - begin, F.lit(0)), F.least(s["end"] - begin, F.length(part))
            new = F.concat(acc["out"], F.substring(part, acc["at"] + 1, lo - acc["at"]), F.when(s["start"] >= begin, F.lit(mask)).otherwise(""))
            return F.struct(hi.alias("at"), new.alias("out"))

        end = lambda acc: F.concat(acc["out"], F.substring(part, acc["at"] + 1, F.length(part)))
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)

    large = lambda part, begin, own: pieces(part, begin, own, CHARS[1], small)
    return pieces(text, F.lit(0), spans, CHARS[0], large)


def redact(docs: DataFrame, mask: str = "[REDACTED]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by mask, spans that overlap by one.

    A null or empty text stays as it is; very long texts are rewritten block by block; repeated rows are
    rewritten each; null ids are kept; all other columns stay, whatever their names; an empty table gives
    no rows.
    """
    spans = found_spans(docs, id_col, text_col).where(F.size("base") + F.size("linked") > 0)
    spans = spans.select("doc_id", "text_key", F.explode(F.concat("base", "linked")).alias("s")).select("doc_id", "text_key", "s.*").distinct()
    # spans that overlap become one: a new one starts where no earlier one reaches
    own = W.partitionBy("doc_id", "text_key").orderBy("start", "end", "kind")
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("no", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "text_key", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    d, k, all_ = fresh(docs, "span_doc"), fresh(docs, "span_key"), fresh(docs, "spans")
    spans = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")).toDF(d, k, all_)
    text = F.col(text_col)
    same = F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(k))
    new = F.when(F.col(all_).isNull(), text).otherwise(_masked(text, F.col(all_), mask))
    return docs.join(spans, same, "left").withColumn(text_col, new).select(*docs.columns)
