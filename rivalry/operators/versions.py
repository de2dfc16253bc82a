"""Versioned snapshots of a changing schedule: differences, identities, gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "fixture_key"


def snapshot_diff(
    old: DataFrame, new: DataFrame, key: str = KEY, schedule: Sequence[str] = ("d",), scores: Sequence[str] = ("score",), id_col: str = "match_id",
    ignored: Sequence[str] = (), bridged: DataFrame | None = None, established: DataFrame | None = None, spaces: tuple[str, str] | None = None,
) -> DataFrame:
    """Typed events between two snapshots (key, status, schedule, scores and other fields): (key, event, changed_fields, before_*, after_*, event_id).

    A new fixture with a score is a RESULT_CANDIDATE too, and a completed one COMPLETED. bridged holds the
    keys whose ids are known in both namespaces: there the step from spaces[0] to spaces[1] (column
    namespace) is a transition, not a conflict of ids. established holds the keys that were bridged just now.
    METADATA_CHANGED tells of any other field; ignored fields (provenance) never make an event. All
    comparisons treat nulls as equal; fields are those that both snapshots have.
    """
    fields = [c for c in new.columns if c in old.columns and c != key and c not in ignored]
    side = lambda df, name: df.select(key, F.struct(*fields).alias(name))
    j = side(old, "before").join(side(new, "after"), key, "full")
    for name, known in (("_bridged", bridged), ("_fresh", established)):
        if known is not None:
            j = j.join(known.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
        j = j.withColumn(name, F.coalesce(name, F.lit(False)) if known is not None else F.lit(False))
    was, is_ = F.col("before").isNotNull(), F.col("after").isNotNull()
    both = was & is_
    differs = lambda f: ~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}"))
    any_of = lambda names: reduce(lambda a, b: a | b, [differs(f) for f in names if f in fields], F.lit(False))
    done = lambda s: F.coalesce(F.col(f"{s}.status") == "completed", F.lit(False))
    moved = F.lit(False)
    if spaces:
        moved = both & F.col("_bridged") & F.col("before.namespace").eqNullSafe(F.lit(spaces[0])) & F.col("after.namespace").eqNullSafe(F.lit(spaces[1]))
    other_id, unknown, given = F.lit(False), F.lit(False), F.lit(False)
    if id_col in fields:
        other_id, unknown, given = both & differs(id_col) & ~moved, F.col(f"before.{id_col}").isNull(), F.col(f"after.{id_col}").isNotNull()
    scored = reduce(lambda a, b: a | b, [F.col(f"after.{f}").isNotNull() for f in scores], F.lit(False))
    kinds = F.array_compact(F.array(*[F.when(cond, name) for name, cond in {
        "NEW": ~was, "MISSING": ~is_, "SCHEDULE_CHANGED": both & any_of(schedule), "BRIDGE_ESTABLISHED": is_ & F.col("_fresh"), "NAMESPACE_TRANSITION": moved,
        "IDENTITY_LINKED": other_id & unknown & given, "IDENTITY_CONFLICT": other_id & ~(unknown & given),
        "RESULT_CANDIDATE": (~was & scored) | (both & any_of(scores) & ~done("before")), "RESULT_CORRECTED": both & any_of(scores) & done("before"),
        "COMPLETED": is_ & done("after") & ~(was & done("before")), "UNCONFIRMED": both & done("before") & ~done("after"),
    }.items()]))
    changed = F.array_join(F.array_compact(F.array(*[F.when(differs(f), f) for f in sorted(fields)])), ",")
    kinds = F.when((F.size(kinds) == 0) & (changed != ""), F.array(F.lit("METADATA_CHANGED"))).otherwise(kinds)
    rows = j.select(key, F.explode(kinds).alias("event"), changed.alias("changed_fields"), "before", "after")
    flat = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("before", "after") for f in fields]
    text = F.concat_ws("|", F.col(key).cast("string"), "event", *[F.coalesce(F.col(f"{s}.{f}").cast("string"), F.lit("~")) for s in ("before", "after") for f in fields])
    return rows.select(key, "event", "changed_fields", *flat, F.sha2(text, 256).alias("event_id"))


def carry_forward_identity(old: DataFrame, new: DataFrame, bound: Sequence[str], key: str = KEY, id_col: str = "official_id") -> DataFrame:
    """Keep a verified id where all bound fields are unchanged and no new row has claimed it."""
    used = new.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_u")).distinct()
    o = old.where(F.col(id_col).isNotNull()).join(used, F.col(id_col) == F.col("_u"), "left_anti")
    o = o.select(key, F.col(id_col).alias("_old"), *[F.col(b).alias(f"_{b}") for b in bound])
    same = F.lit(True)
    for b in bound:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return new.join(o, key, "left").withColumn(id_col, F.coalesce(id_col, F.when(same, F.col("_old")))).drop("_old", *[f"_{b}" for b in bound])


def retain_completion(old: DataFrame, new: DataFrame, same: Sequence[str], key: str = KEY) -> DataFrame:
    """A new candidate stays completed if the old row was completed with identical fields."""
    o = old.where("status = 'completed'").select(key, *[F.col(s).alias(f"_{s}") for s in same], F.lit(True).alias("_done"))
    ok = F.coalesce("_done", F.lit(False)) & (F.col("status") == "candidate")
    for s in same:
        ok = ok & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return new.join(o, key, "left").withColumn("status", F.when(ok, "completed").otherwise(F.col("status"))).drop("_done", *[f"_{s}" for s in same])


def id_bridge(rows: DataFrame, a: str, b: str, key: str = KEY) -> DataFrame:
    """Two id namespaces per fixture: LINKED, CONFLICT (an id with several partners), PARTIAL or NONE; the operational id prefers a."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    bad_a = both.groupBy(a).agg(F.count_distinct(b).alias("_ka"))
    bad_b = both.groupBy(b).agg(F.count_distinct(a).alias("_kb"))
    j = rows.join(bad_a, a, "left").join(bad_b, b, "left")
    have = F.col(a).isNotNull() & F.col(b).isNotNull()
    conflict = have & ((F.col("_ka") > 1) | (F.col("_kb") > 1))
    status = F.when(conflict, "CONFLICT").when(have, "LINKED").when(F.col(a).isNotNull() | F.col(b).isNotNull(), "PARTIAL").otherwise("NONE")
    return j.select(key, a, b, status.alias("status"), F.when(~conflict, F.coalesce(a, b)).alias("operational_id"))


def apply_evidence(rows: DataFrame, evidence: DataFrame, key: str = KEY) -> DataFrame:
    """A candidate becomes completed where the evidence agrees in date and score; a disagreement is a conflict."""
    e = evidence.select(key, F.col("d").alias("_d"), F.col("score").alias("_s"), F.lit(True).alias("_e"))
    j = rows.join(e, key, "left")
    agree = F.col("d").eqNullSafe(F.col("_d")) & F.col("score").eqNullSafe(F.col("_s"))
    cand = (F.col("status") == "candidate") & F.coalesce("_e", F.lit(False))
    return j.withColumns({
        "conflict": cand & ~agree, "status": F.when(cand & agree, "completed").otherwise(F.col("status")),
    }).drop("_d", "_s", "_e")


def publish_gate(events: DataFrame, forbidden: Sequence[str], observed: Column, newest: Column, complete: Column) -> DataFrame:
    """One row: HOLD with the reasons, or PUBLISH."""
    n = events.agg(F.count("*").alias("events"), F.count(F.when(F.col("event").isin(*forbidden), 1)).alias("forbidden"))
    reasons = F.array_compact(F.array(F.when(F.col("forbidden") > 0, "forbidden_event"), F.when(observed <= newest, "stale"), F.when(~complete, "coverage")))
    return n.select("events", "forbidden", F.array_join(reasons, ",").alias("reasons"), F.when(F.size(reasons) > 0, "HOLD").otherwise("PUBLISH").alias("status"))


def latest_published(revisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """revisions (revision, seq, status): the newest accepted one."""
    ok = revisions.where("status = 'PUBLISHED'")
    return ok.groupBy(*by).agg(F.max_by("revision", "seq").alias("revision"), F.max("seq").alias("seq"))


def version_history(rows: DataFrame, doc: str, seq: str, digest: str) -> DataFrame:
    """Observations of each document in order, joined as seq:digest, and how many different contents there were."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(digest).alias("h")))), lambda x: F.concat_ws(":", x["s"].cast("string"), x["h"].cast("string")))
    return rows.groupBy(doc).agg(F.array_join(seen, ",").alias("history"), F.count("*").alias("n"), F.count_distinct(digest).alias("versions"))


def evidence_timing_class(published: Column, retrieved: Column, updated: Column, start: Column) -> Column:
    return (
        F.when(start.isNull() | retrieved.isNull(), "UNKNOWN").when((retrieved < start) & (updated.isNull() | (updated < start)), "BEFORE_START")
        .when(retrieved < start, "UPDATED_LATER").when(published.isNotNull() & (published < start), "PUBLISHED_BEFORE_RETRIEVED_AFTER").otherwise("AFTER_START")
    )


def logical_state_merge(states: DataFrame) -> DataFrame:
    """states (season, d, kind BASE|SUPPLEMENT|FULL, members array): a base and a supplement of one date with disjoint members are FULL."""
    base, sup = (states.where(F.col("kind") == k).select("season", "d", F.col("members").alias(k.lower())) for k in ("BASE", "SUPPLEMENT"))
    full = states.where("kind = 'FULL'").select("season", "d", F.lit("FULL").alias("state"), F.size("members").alias("n"))
    j = base.join(sup, ["season", "d"], "full")
    state = (
        F.when(F.col("base").isNull(), "SUPPLEMENT_ONLY").when(F.col("supplement").isNull(), "BASE_ONLY")
        .when(F.arrays_overlap("base", "supplement"), "CONFLICT").otherwise("FULL")
    )
    none = F.array().cast("array<bigint>")
    return full.union(j.select("season", "d", state, F.size(F.array_union(F.coalesce("base", none), F.coalesce("supplement", none)))))


def profile_classify(rows: DataFrame, keys: Sequence[str], name: str, kinds: dict[str, Sequence[str]]) -> DataFrame:
    """Which kind has exactly the names that a key has; UNKNOWN otherwise."""
    got = rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names"))
    out = F.lit("UNKNOWN")
    for k, names in kinds.items():
        out = F.when(F.col("names") == ",".join(sorted(names)), k).otherwise(out)
    return got.withColumn("kind", out)


def snapshot_registry_audit(manifest: DataFrame, raw: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """manifest (key, n_rows) against rows counted in raw and processed: OK, COUNT_DIFFERS, MISSING_*, ORPHAN."""
    c = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    j = manifest.join(c(raw, "raw"), key, "full").join(c(processed, "done"), key, "full")
    status = (
        F.when(F.col("n_rows").isNull(), "ORPHAN").when(F.col("raw").isNull(), "MISSING_RAW").when(F.col("done").isNull(), "MISSING_PROCESSED")
        .when((F.col("raw") != F.col("n_rows")) | (F.col("done") != F.col("n_rows")), "COUNT_DIFFERS").otherwise("OK")
    )
    return j.withColumn("status", status)


def dependent_gate(events: DataFrame, predicted: DataFrame, bound: DataFrame, key: str = KEY) -> DataFrame:
    """Changed fixtures that have predictions but no complete binding."""
    return events.select(key).distinct().join(predicted.select(key).distinct(), key, "left_semi").join(bound.select(key), key, "left_anti")


def source_state_class(previous: Column, current: Column) -> Column:
    return F.when(previous.isNull() | current.isNull(), "UNKNOWN").when(current > previous, "ADVANCED").when(current == previous, "UNCHANGED").otherwise("REGRESSED")
