"""Expectations: each function returns the violations as rows; an empty result means that the data holds what is asked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivalry.core.asof import ID, appearances
from rivalry.functions.scalar import c


def violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(keys.., rule) for each rule whose condition is true; one scan for all rules."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(*keys, F.explode(found).alias("rule"))


def unequal(a, b) -> Column:
    return ~c(a).eqNullSafe(c(b))


def _repeated(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df with a flag for rows whose (non-null) keys occur more than once; only the repeated keys are joined back."""
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    many = df.where(full).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias(name))
    return df.join(many, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def expect_contests(contests: DataFrame) -> DataFrame:
    """Blank ids, missing dates, negative or missing scores, results that differ from scores, equal sides, repeated ids and natural keys.

    Keys with a null aren't compared.
    """
    rows = contests.select(ID, "d", "home", "away", "home_score", "away_score", "result")
    counted = _repeated(_repeated(rows, [ID], "_same_id"), ["d", "home", "away"], "_same_key")
    sign = F.signum((F.col("home_score") - F.col("away_score")).cast("double")) + 1
    return violations(counted, [ID], {
        "blank_id": F.col(ID).isNull(), "missing_date": F.col("d").isNull(),
        "bad_score": F.coalesce((F.col("home_score") < 0) | (F.col("away_score") < 0), F.lit(True)),
        "result_differs": unequal(F.col("result").cast("double"), sign), "same_sides": F.col("home").eqNullSafe(F.col("away")),
        "duplicate_id": F.col("_same_id"), "duplicate_key": F.col("_same_key"),
    })


def expect_no_same_day_dup(contests: DataFrame) -> DataFrame:
    return appearances(contests).groupBy("e", "d").agg(F.count("*").alias("n")).where("n > 1")


def expect_alias_intervals(aliases: DataFrame) -> DataFrame:
    """Reversed intervals, intervals of one (source, name) that overlap an earlier one, entities with several canonical names
    (column canonical_name) and external ids (column external_id) of one source with several entities, where there are such columns."""
    lo = F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))
    hi = F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    w = W.partitionBy("source", "source_name").orderBy(lo, hi, "entity_id").rowsBetween(W.unboundedPreceding, -1)
    rows = aliases.withColumns({"_lo": lo, "_hi": hi, "_before": F.max(hi).over(w)})
    rules = {"reversed": F.col("_lo") > F.col("_hi"), "overlap": F.col("_lo") <= F.col("_before")}
    for rule, keys, value in (("canonical_differs", ["entity_id"], "canonical_name"), ("external_shared", ["source", "external_id"], "entity_id")):
        if value in aliases.columns and keys[-1] in aliases.columns:
            odd = aliases.groupBy(*keys).agg(F.count_distinct(value).alias("_k")).where("_k > 1").select(*keys, F.lit(True).alias(f"_{rule}"))
            rows = rows.join(odd, keys, "left")
            rules[rule] = F.coalesce(f"_{rule}", F.lit(False))
    return violations(rows, ["source", "source_name", "entity_id"], rules)


def expect_round_robin(contests: DataFrame, scope: Sequence[str], round_: str | None = None) -> DataFrame:
    """What keeps a scope from being a double round robin: (scope.., problem, subject, n).

    MISSING: an entity hosts n others too few; REPEATED: it hosts n of them more than once. With round_:
    ROUND_SIZE, a round has n contests where half the entities are due; ROUND_APPEARANCES, an entity plays n
    rounds not exactly once. Counts for each entity and round; no pairs are made.
    """
    sides = appearances(contests, [*scope, *([round_] if round_ else [])])
    entities = sides.select(*scope, "e").distinct()
    sizes = entities.groupBy(*scope).agg(F.count("*").alias("_all"))
    hosted = contests.groupBy(*scope, F.col("home").alias("e"), "away").agg(F.count("*").alias("_n"))
    hosted = hosted.groupBy(*scope, "e").agg(F.count("*").alias("_met"), F.count(F.when(F.col("_n") > 1, 1)).alias("_more"))
    each = entities.join(hosted, [*scope, "e"], "left").join(F.broadcast(sizes), list(scope))
    lacks = F.col("_all") - 1 - F.coalesce("_met", F.lit(0))
    out = [(each, "MISSING", F.col("e"), lacks), (each, "REPEATED", F.col("e"), F.coalesce("_more", F.lit(0)))]
    if round_:
        size = contests.groupBy(*scope, round_).agg(F.count("*").alias("_k")).join(F.broadcast(sizes), list(scope))
        played = sides.groupBy(*scope, "e", round_).agg(F.count("*").alias("_k"))
        rounds = contests.groupBy(*scope).agg(F.count_distinct(round_).alias("_rounds"))
        played = played.groupBy(*scope, "e").agg(F.count(F.when(F.col("_k") == 1, 1)).alias("_once")).join(F.broadcast(rounds), list(scope))
        wrong = F.when(F.col("_k") != F.floor(F.col("_all") / 2), F.col("_k")).otherwise(0)
        out += [(size, "ROUND_SIZE", F.col(round_), wrong), (played, "ROUND_APPEARANCES", F.col("e"), F.col("_rounds") - F.col("_once"))]
    rows = [df.select(*scope, F.lit(p).alias("problem"), s.cast("string").alias("subject"), n.cast("long").alias("n")).where("n <> 0") for df, p, s, n in out]
    return reduce(DataFrame.union, rows)


def expect_events(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Missing fields, unknown kinds, minutes out of range, halves that don't fit, sides out of domain, repeated ids."""
    rows = events.withColumn("_n", F.count("*").over(W.partitionBy("event_id")))
    return violations(rows, ["event_id"], {
        "missing_contest": F.col(ID).isNull(), "unknown_kind": ~F.coalesce(F.col("event_type").isin(*kinds), F.lit(False)),
        "minute_range": F.coalesce((F.col("minute") < 1) | (F.col("minute") > 120), F.lit(True)),
        "half_differs": (F.col("minute") > 45) != (F.col("half") == 1), "bad_side": ~F.coalesce(F.col("side").isin("home", "away"), F.lit(False)),
        "duplicate_id": F.col("_n") > 1,
    })


def expect_score_reconciles(contests: DataFrame, events: DataFrame, exceptions: Sequence[int] = ()) -> DataFrame:
    """Contests whose goal events per side differ from the score."""
    of = lambda s: F.count(F.when((F.col("event_type") == "GOAL") & (F.col("side") == s), 1))
    goals = events.groupBy(ID).agg(of("home").alias("home_events"), of("away").alias("away_events"))
    rows = contests.select(ID, "home_score", "away_score").join(goals, ID, "left").fillna(0, ["home_events", "away_events"])
    bad = (F.col("home_events") != F.col("home_score")) | (F.col("away_events") != F.col("away_score"))
    return rows.where(bad & ~F.col(ID).isin(*exceptions)) if exceptions else rows.where(bad)


def expect_no_ambiguous_order(events: DataFrame, first: str = "SUBSTITUTION", second: str = "RED_CARD") -> DataFrame:
    """Entities with both kinds at one instant of a contest."""
    at = [ID, "e", "half", "minute", "added"]
    of = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return events.groupBy(*at).agg(of(first).alias("n_first"), of(second).alias("n_second")).where("n_first > 0 and n_second > 0")


def expect_features(features: DataFrame, targets: DataFrame, counts: Mapping[str, str]) -> DataFrame:
    """counts: rate column -> count column. A rate is null exactly where its count is 0, and every target has one row."""
    rows = targets.select(ID).join(features.withColumn("_there", F.lit(1)), ID, "left").withColumn("_n", F.count("*").over(W.partitionBy(ID)))
    rules = {f"{r}_null_rule": F.col("_there").isNotNull() & ((F.coalesce(n, F.lit(0)) == 0) != F.col(r).isNull()) for r, n in counts.items()}
    return violations(rows, [ID], rules | {"missing": F.col("_there").isNull(), "duplicate": F.col("_n") > 1})


def recount_history(contests: DataFrame) -> DataFrame:
    """For each contest, pair history counted without windows: earlier, same-date and later contests of the pair."""
    pair = lambda p: [F.least("home", "away").alias(f"{p}l"), F.greatest("home", "away").alias(f"{p}h")]
    a = contests.select(ID, "d", *pair("a"))
    b = contests.groupBy(*pair("b"), F.col("d").alias("bd")).agg(F.count("*").alias("n"))
    j = a.join(b, (F.col("al") == F.col("bl")) & (F.col("ah") == F.col("bh")))
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return j.groupBy(ID).agg(of(F.col("bd") < F.col("d")).alias("earlier"), (of(F.col("bd") == F.col("d")) - 1).alias("same_date"), of(F.col("bd") > F.col("d")).alias("later"))


def expect_stats_season(contests: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """Contests without statistics, statistics without contest, and values that aren't whole numbers of 0 or more."""
    rows = contests.select(ID, F.lit(1).alias("_c")).join(stats.withColumn("_s", F.lit(1)), ID, "full")
    rules = {f"bad_{n}": F.col("_s").isNotNull() & F.coalesce(~F.col(n).cast("string").rlike(r"^\d+$"), F.lit(True)) for n in names}
    return violations(rows, [ID], {"no_statistics": F.col("_s").isNull(), "no_contest": F.col("_c").isNull()} | rules)


def expect_identity_frame(rows: DataFrame, key: str, local: str, foreign: str, kind: str) -> DataFrame:
    """Exactly the id that the identity type names is given."""
    is_local = F.col(kind) == "local"
    return violations(rows, [key], {
        "unknown_type": ~F.coalesce(F.col(kind).isin("local", "foreign"), F.lit(False)),
        "local_id": is_local != F.col(local).isNotNull(), "foreign_id": is_local != F.col(foreign).isNull(),
    })


def expect_probabilities(rows: DataFrame, key: str, probs: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    total = sum((F.col(p) for p in probs[1:]), F.col(probs[0]))
    bad = lambda x: F.coalesce(F.isnan(x) | (x < 0) | (x > 1), F.lit(True))
    outside = bad(F.col(probs[0]))
    for p in probs[1:]:
        outside = outside | bad(F.col(p))
    return violations(rows, [key], {"out_of_range": outside, "sum": F.coalesce(F.abs(total - 1) > tolerance, F.lit(True))})


def expect_fold_contract(rows: DataFrame, classes: int = 3) -> DataFrame:
    """rows (fold, role train|valid, contest_id, d, result): training ends before validation, no shared ids, all classes trained."""
    of = lambda role, x: F.when(F.col("role") == role, x)
    per = rows.groupBy("fold").agg(
        F.max(of("train", F.col("d"))).alias("_t"), F.min(of("valid", F.col("d"))).alias("_v"),
        F.count_distinct(of("train", F.col("result"))).alias("_k"),
    )
    shared = rows.groupBy("fold", ID).agg(F.count_distinct("role").alias("r")).where("r > 1").groupBy("fold").agg(F.count("*").alias("_s"))
    per = per.join(shared, "fold", "left")
    return violations(per, ["fold"], {
        "no_rows": F.col("_t").isNull() | F.col("_v").isNull(), "overlap": F.col("_t") >= F.col("_v"),
        "shared_ids": F.col("_s").isNotNull(), "missing_class": F.col("_k") < classes,
    })


def expect_metrics_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Metrics that differ by more than tolerance, or that only one table has."""
    j = a.join(b.withColumnsRenamed({v: f"_{v}" for v in values}), list(keys), "full")
    near = lambda v: (F.col(v).eqNullSafe(F.col(f"_{v}"))) | (F.abs(F.col(v) - F.col(f"_{v}")) <= tolerance)
    return violations(j, list(keys), {v: ~F.coalesce(near(v), F.lit(False)) for v in values})


def expect_feature_inputs(events: DataFrame, contests: DataFrame) -> DataFrame:
    """Repeated ids, sides out of domain, minutes out of range, and contests that aren't known."""
    known = contests.select(ID).distinct().withColumn("_k", F.lit(1))
    rows = events.join(known, ID, "left").withColumn("_n", F.count("*").over(W.partitionBy("event_id")))
    return violations(rows, ["event_id"], {
        "duplicate_id": F.col("_n") > 1, "unknown_contest": F.col("_k").isNull(),
        "bad_side": ~F.coalesce(F.col("side").isin("home", "away"), F.lit(False)),
        "minute_range": ~F.coalesce(F.col("minute").between(0, 120), F.lit(False)),
    })


def expect_rest_consistent(given: DataFrame, recomputed: DataFrame, columns: Sequence[str]) -> DataFrame:
    j = given.join(recomputed.withColumnsRenamed({x: f"_{x}" for x in columns}), ID, "left")
    return violations(j, [ID], {x: unequal(x, f"_{x}") for x in columns})


def expect_live_inputs(schedule: DataFrame, completed: DataFrame, statuses: Sequence[str], key: str = "fixture_key") -> DataFrame:
    """Status domain, unique keys, dates, scores exactly of completed rows, and a completed file that is the completed subset."""
    rows = schedule.withColumn("_n", F.count("*").over(W.partitionBy(key)))
    rules = violations(rows, [key], {
        "duplicate": F.col("_n") > 1, "status": ~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "date": F.col("d").isNull(),
        "score": (F.col("status") == "completed") & F.col("score").isNull(), "early_score": (F.col("status") == "scheduled") & F.col("score").isNotNull(),
    })
    done = schedule.where("status = 'completed'").select(key)
    gone = done.join(completed, key, "left_anti").select(key, F.lit("missing_in_completed").alias("rule"))
    extra = completed.select(key).join(done, key, "left_anti").select(key, F.lit("not_completed").alias("rule"))
    return rules.union(gone).union(extra)


def expect_bindings(bindings: DataFrame, columns: Sequence[str], unique: Sequence[str]) -> DataFrame:
    """Blank cells and repeated values of each unique key."""
    rows = bindings.withColumns({f"_{u}": F.count("*").over(W.partitionBy(u)) for u in unique})
    return violations(
        rows, [unique[0]],
        {f"blank_{x}": F.coalesce(F.trim(F.col(x).cast("string")) == "", F.lit(True)) for x in columns}
        | {f"duplicate_{u}": (F.col(f"_{u}") > 1) & F.col(u).isNotNull() for u in unique},
    )


def expect_rebuilt(given: DataFrame, rebuilt: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Derived columns that differ from their recomputation, or rows that only one side has."""
    j = given.withColumn("_g", F.lit(1)).join(rebuilt.withColumnsRenamed({x: f"_{x}" for x in columns}).withColumn("_r", F.lit(1)), key, "full")
    both = F.col("_g").isNotNull() & F.col("_r").isNotNull()
    return violations(j, [key], {"missing": ~both} | {x: both & unequal(x, f"_{x}") for x in columns})
