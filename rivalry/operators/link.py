"""Joins that link records: aliases, identities, notices, predictions and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivalry.core.asof import ID, appearances
from rivalry.functions.scalar import name_key


#: Days before all dates: that of rows without one, and the start of aliases that are open to the past.
UNDATED, PAST = -(1 << 40), 1 - (1 << 40)


def _held(aliases: DataFrame) -> DataFrame:
    """(source, source_name, code, at, change): the days on which an entity begins (1) or ceases (-1) to hold a name, its spans merged.

    code numbers the entities of a name, for sums. A name without any bound holds on rows without a date, too.
    """
    name = ["source", "source_name"]
    begin = F.when(F.col("valid_from").isNull() & F.col("valid_to").isNull(), UNDATED).otherwise(F.coalesce(F.unix_date("valid_from"), F.lit(PAST)))
    spans = aliases.where("entity_id IS NOT NULL").select(*name, "entity_id", begin.alias("at"), (F.unix_date("valid_to") + 1).cast("long").alias("end"))
    spans = spans.where("end IS NULL OR at < end").withColumn("end", F.coalesce("end", F.lit(1 << 40)))
    w = W.partitionBy(*name, "entity_id").orderBy("at", "end")
    spans = spans.withColumn("reach", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("code", F.dense_rank().over(W.partitionBy(*name).orderBy("entity_id")).cast("long"))
    # what lies beyond the earlier spans; the parts of an entity are disjoint
    spans = spans.withColumn("at", F.greatest("at", "reach")).where("at < end")
    ends = F.inline(F.array(F.struct("at", F.lit(1).alias("change")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("change"))))
    return spans.select(*name, "entity_id", "code", ends)


def resolve_alias_asof(rows: DataFrame, aliases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows (keys.., source, source_name, d nullable) -> entity_id and OK, UNKNOWN or AMBIGUOUS.

    An alias holds from valid_from to valid_to, both inclusive and open where null; a bounded one needs a date. Each distinct (source,
    name, date) is looked up once, in running sums over the days on which entities begin and cease to hold the name: no row meets all
    aliases of its name.
    """
    name = ["source", "source_name"]
    rows = rows.select(*keys, *name, F.coalesce(F.unix_date("d").cast("long"), F.lit(UNDATED)).alias("_at"))
    held = _held(aliases)
    points = held.select(*name, "at", "change", (F.col("change") * F.col("code")).alias("codes"), F.lit(False).alias("asked"))
    asked = rows.where("source IS NOT NULL AND source_name IS NOT NULL").select(*name, F.col("_at").alias("at")).distinct()
    points = points.union(asked.select("*", F.lit(0), F.lit(0).cast("long"), F.lit(True)))
    points = points.groupBy(*name, "at").agg(F.sum("change").alias("n"), F.sum("codes").alias("code"), F.max("asked").alias("asked"))
    w = W.partitionBy(*name).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    state = points.withColumns({"n": F.sum("n").over(w), "code": F.sum("code").over(w)}).where("asked AND n > 0")
    known = held.select(*name, "code", "entity_id").distinct()
    state = state.withColumn("code", F.when(F.col("n") == 1, F.col("code"))).join(known, [*name, "code"], "left")
    state = state.select(*name, F.col("at").alias("_at"), "n", F.col("entity_id").alias("one"))
    found = rows.join(state, [*name, "_at"], "left").groupBy(*keys).agg(F.max("n").alias("n"), F.min("one").alias("one"), F.max("one").alias("other"))
    sole = (F.col("n") == 1) & (F.col("one") == F.col("other"))
    status = F.when(F.col("n").isNull(), "UNKNOWN").when(sole, "OK").otherwise("AMBIGUOUS")
    return found.select(*keys, F.when(sole, F.col("one")).alias("entity_id"), status.alias("status"))


def resolve_alias_safe(rows: DataFrame, aliases: DataFrame, given: str = "given_id") -> DataFrame:
    """Keep a given id, else the only candidate over all names, else null."""
    sole = aliases.groupBy("source_name").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("sole")).where("n = 1")
    return rows.join(sole.select("source_name", "sole"), "source_name", "left").withColumn("entity_id", F.coalesce(given, "sole")).drop("sole")


def resolve_unique_name(rows: DataFrame, master: DataFrame, name: str = "name", id_col: str = "id") -> DataFrame:
    """Link by normalised name (name_key) only where exactly one id has it. Each distinct name is normalised once."""
    keys = lambda df: df.select(F.col(name).alias("_name")).distinct().withColumn("_n", name_key(F.col("_name")))
    known = master.join(keys(master), F.col(name) == F.col("_name"))
    one = known.groupBy("_n").agg(F.count_distinct(id_col).alias("k"), F.min(id_col).alias("linked_id")).where("k = 1").drop("k")
    return rows.join(keys(rows).join(one, "_n"), F.col(name) == F.col("_name"), "left").drop("_n", "_name")


def scoped_exact_link(rows: DataFrame, master: DataFrame, scope: Sequence[str], name: str, id_col: str = "id") -> DataFrame:
    """(scope, name) -> id with EXACT, AMBIGUOUS (several ids), COLLISION (one id under several names) or UNRESOLVED.

    Adds the number of raw rows of each key beside the distinct key.
    """
    ids = master.groupBy(*scope, name).agg(F.count_distinct(id_col).alias("n_ids"), F.min(id_col).alias("one"))
    names = master.groupBy(*scope, F.col(id_col).alias("one")).agg(F.count_distinct(name).alias("n_names"))
    keys = rows.groupBy(*scope, name).agg(F.count("*").alias("n_rows"))
    out = keys.join(ids, [*scope, name], "left").join(names, [*scope, "one"], "left")
    status = (
        F.when(F.col("n_ids").isNull(), "UNRESOLVED").when(F.col("n_ids") > 1, "AMBIGUOUS").when(F.col("n_names") > 1, "COLLISION").otherwise("EXACT")
    )
    sole = F.when((F.col("n_ids") == 1) & (F.col("n_names") == 1), F.col("one"))
    return out.select(*scope, name, "n_rows", status.alias("status"), sole.alias("linked_id"))


def classify_identity_state(rows: DataFrame, id_col: str, name: str, group: str) -> DataFrame:
    """CONFLICTING_NAME, MULTI_GROUP, or OK for each id."""
    per = rows.groupBy(id_col).agg(F.count_distinct(name).alias("names"), F.count_distinct(group).alias("groups"))
    return per.withColumn("state", F.when(F.col("names") > 1, "CONFLICTING_NAME").when(F.col("groups") > 1, "MULTI_GROUP").otherwise("OK"))


def strict_join_violations(left: DataFrame, right: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Rows (key, violation) that keep left and right from being joined one to one with equal identity columns."""
    def one(df, tag):
        return df.groupBy(key).agg(F.count("*").alias(f"n_{tag}"), *[F.min(c).alias(f"{tag}_{c}") for c in same])

    both = one(left, "l").join(one(right, "r"), key, "full")
    rules = F.array(
        F.when(F.col("n_l").isNull(), "missing_left"), F.when(F.col("n_r").isNull(), "missing_right"),
        F.when(F.col("n_l") > 1, "duplicate_left"), F.when(F.col("n_r") > 1, "duplicate_right"),
        *[F.when(F.col("n_l").isNotNull() & F.col("n_r").isNotNull() & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), f"differs_{c}") for c in same],
    )
    return both.select(key, F.explode(F.array_compact(rules)).alias("violation"))


def strict_1to1_join(left: DataFrame, right: DataFrame, key: str, same: Sequence[str] = ()) -> DataFrame:
    """The join; fails if strict_join_violations has any row."""
    bad = strict_join_violations(left, right, key, same).take(3)
    if bad:
        raise ValueError(f"not one to one: {bad}")
    return left.join(right.drop(*same), key)


def xg_reference_join(xg: DataFrame, contests: DataFrame, eligible: str = "eligible") -> DataFrame:
    """Join observations to contests on (d, home, away); scope REGULATION, UNRESOLVED or UNMATCHED."""
    ref = contests.select("d", "home", "away", F.col(ID).alias("reference_id"), "home_score", "away_score")
    scope = F.when(F.col("reference_id").isNull(), "UNMATCHED").when(F.col(eligible), "REGULATION").otherwise("UNRESOLVED")
    return xg.join(ref, ["d", "home", "away"], "left").withColumn("scope", scope)


def event_identity_check(events: DataFrame, contests: DataFrame) -> DataFrame:
    """Events whose contest, date, season or side's entity differs from the contest, with the reason."""
    k = contests.select(ID, F.col("d").alias("_d"), F.col("season").alias("_s"), "home", "away")
    j = events.join(k, ID, "left")
    own = F.when(F.col("side") == "home", F.col("home")).when(F.col("side") == "away", F.col("away"))
    reason = (
        F.when(F.col("_d").isNull(), "unknown_contest").when(F.col("d") != F.col("_d"), "date").when(F.col("season") != F.col("_s"), "season")
        .when(own.isNull(), "side").when(F.col("e") != own, "entity")
    )
    return j.withColumn("reason", reason).where("reason is not null").select("event_id", ID, "reason")


def notice_target_link(notices: DataFrame, contests: DataFrame) -> DataFrame:
    """notices (notice_id, e, d, round_hint, id_hint) -> LINKED, NO_MATCH, MULTIPLE, ROUND_CONFLICT or ID_CONFLICT, with the contest."""
    rows = appearances(contests, ["round"]).select("e", "d", ID, *(["round"] if "round" in contests.columns else []))
    if "round" not in rows.columns:
        rows = rows.withColumn("round", F.lit(None).cast("int"))
    per = notices.join(rows, ["e", "d"], "left").groupBy("notice_id", "round_hint", "id_hint").agg(
        F.count(ID).alias("n"), F.min(ID).alias("one"), F.min("round").alias("its_round")
    )
    status = (
        F.when(F.col("n") == 0, "NO_MATCH").when(F.col("n") > 1, "MULTIPLE")
        .when(F.col("round_hint") != F.col("its_round"), "ROUND_CONFLICT").when(F.col("id_hint") != F.col("one"), "ID_CONFLICT").otherwise("LINKED")
    )
    return per.select("notice_id", "n", status.alias("status"), F.when(status == "LINKED", F.col("one")).alias(ID))


def previous_period_profile(contests: DataFrame, profiles: DataFrame, stats: Sequence[str], lag: int = 1) -> DataFrame:
    """Rates of each side's profile `lag` seasons before, all or nothing: null unless every statistic is there."""
    wide = profiles.groupBy("season", "e").pivot("stat", list(stats)).agg(F.max(F.col("raw_value") / F.col("basis")))
    full = F.lit(True)
    for s in stats:
        full = full & F.col(s).isNotNull()
    wide = wide.where(full).withColumn("season", F.col("season") + lag)
    out = contests.select(ID, "season", "home", "away")
    for side in ("home", "away"):
        own = wide.withColumnsRenamed({"e": side} | {s: f"{side}_{s}_rate" for s in stats})
        out = out.join(own, ["season", side], "left")
    known = lambda s: F.col(f"{s}_{stats[0]}_rate").isNotNull()
    return out.withColumn("available", known("home") & known("away")).drop("season", "home", "away")


def membership(contests: DataFrame) -> DataFrame:
    return appearances(contests).select("competition", "season", "e").distinct()


def membership_sets(contests: DataFrame, top: str) -> DataFrame:
    """member_status() of the competitions that the contests are played in."""
    return member_status(membership(contests), top)


def member_status(m: DataFrame, top: str) -> DataFrame:
    """Members of competition `top` by season: new, returning after a gap, or staying; new ones that were elsewhere the year before are promoted.

    m: distinct (competition, season, e).
    """
    mine = m.where(F.col("competition") == top)
    before = mine.select((F.col("season") + 1).alias("season"), "e").withColumn("stayed", F.lit(True))
    first = mine.groupBy("e").agg(F.min("season").alias("first"))
    other = m.where(F.col("competition") != top).select((F.col("season") + 1).alias("season"), "e").distinct().withColumn("elsewhere", F.lit(True))
    out = mine.join(before, ["season", "e"], "left").join(first, "e").join(other, ["season", "e"], "left")
    status = F.when(F.col("stayed"), "staying").when(F.col("first") == F.col("season"), "first_time").otherwise("returning")
    return out.select("season", "e", status.alias("status"), (F.col("stayed").isNull() & F.coalesce("elsewhere", F.lit(False))).alias("promoted"))


def retain_involved(contests: DataFrame, members: DataFrame) -> DataFrame:
    """Contests with at least one side in members (season, e); two broadcastable lookups, no row doubles."""
    m = members.select("season", "e").distinct()
    h = m.withColumnRenamed("e", "home").withColumn("h", F.lit(True))
    a = m.withColumnRenamed("e", "away").withColumn("a", F.lit(True))
    out = contests.join(h, ["season", "home"], "left").join(a, ["season", "away"], "left")
    return out.where("h or a").select(*contests.columns)


def bridge_candidates(contests: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Contests of which exactly one side is in left (season, e) and the other in right."""
    def tag(out, members, name):
        m = members.select("season", "e").distinct()
        for s in ("home", "away"):
            out = out.join(m.withColumnsRenamed({"e": s}).withColumn(f"{s}_{name}", F.lit(True)), ["season", s], "left")
        return out

    out = tag(tag(contests, left, "l"), right, "r")
    f = lambda x: F.coalesce(x, F.lit(False))
    cross = (f("home_l") & f("away_r") & ~f("home_r") & ~f("away_l")) | (f("home_r") & f("away_l") & ~f("home_l") & ~f("away_r"))
    safe = F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & (F.col("home") != F.col("away"))
    return out.where(cross).select(ID, "season", "home", "away", safe.alias("result_safe"))


def predictions_to_outcomes(predictions: DataFrame, bindings: DataFrame, bridge: DataFrame, outcomes: DataFrame) -> DataFrame:
    """prediction_id -> binding -> fixture_key -> contest -> result, with the hop at which it stops."""
    out = predictions.join(bindings, "prediction_id", "left").join(bridge, "fixture_key", "left").join(outcomes, ID, "left")
    status = F.when(F.col("fixture_key").isNull(), "UNBOUND").when(F.col(ID).isNull(), "NO_BRIDGE").when(F.col("result").isNull(), "NO_OUTCOME").otherwise("RESOLVED")
    return out.select("prediction_id", "fixture_key", ID, "result", status.alias("status"))


def bind_predictions(predictions: DataFrame, targets: DataFrame, model: str) -> DataFrame:
    """Binding rows of predictions (contest_id, ...) and resolved targets (contest_id, fixture_key)."""
    return predictions.join(targets, ID).select(
        F.concat_ws(":", F.lit(model), F.col(ID).cast("string")).alias("prediction_id"), "fixture_key", F.lit(model).alias("model")
    )


def binding_completeness(predictions: DataFrame, bindings: DataFrame) -> DataFrame:
    """Predictions without a binding and bindings without a prediction; the latter are allowed."""
    a = predictions.join(bindings, "prediction_id", "left_anti").select("prediction_id", F.lit("UNBOUND").alias("problem"))
    b = bindings.join(predictions, "prediction_id", "left_anti").select("prediction_id", F.lit("EXTRA").alias("problem"))
    return a.union(b)


def resolve_targets(batch: DataFrame, aliases: DataFrame, source: str) -> DataFrame:
    """batch (fixture_key, d, home_name, away_name) -> both entity ids and statuses, as of the date."""
    long = batch.select("fixture_key", "d", F.lit(source).alias("source"), F.expr("stack(2, 'home', home_name, 'away', away_name) as (side, source_name)"))
    got = resolve_alias_asof(long, aliases, ["fixture_key", "side"])
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
    return got.groupBy("fixture_key").agg(*[pick(s, c) for s in ("home", "away") for c in ("entity_id", "status")])


def already_predicted(rows: DataFrame, bindings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that aren't bound yet."""
    return rows.join(bindings.select(*keys).distinct(), list(keys), "left_anti")


def fallback_union(base: DataFrame, challenger: DataFrame, probs: Sequence[str]) -> DataFrame:
    """The challenger's probabilities where it has a row, else the baseline's; `used` tells which."""
    ch = challenger.select(ID, *[F.col(p).alias(f"c_{p}") for p in probs])
    out = base.join(ch, ID, "left")
    used = F.when(F.col(f"c_{probs[0]}").isNotNull(), "challenger").otherwise("baseline")
    return out.withColumn("used", used).withColumns({p: F.coalesce(f"c_{p}", p) for p in probs}).drop(*[f"c_{p}" for p in probs])


def align_by_id(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """Predictions of exactly the targets; fails if the id sets differ."""
    bad = strict_join_violations(predictions.select(ID), targets.select(ID), ID, []).take(3)
    if bad:
        raise ValueError(f"id sets differ: {bad}")
    return predictions


def frozen_target_select(rows: DataFrame, saved: DataFrame, same: Sequence[str]) -> DataFrame:
    """Rows of the saved ids, with whether the identity columns still agree."""
    s = saved.select(ID, *[F.col(c).alias(f"_{c}") for c in same])
    ok = F.lit(True)
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(s, ID).withColumn("identity_ok", ok).drop(*[f"_{c}" for c in same])


def dataset_compare(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed and common keys, and values that a common key gained or lost."""
    sets = lambda df, n: df.groupBy(key).agg(F.collect_set(value).alias(n))
    both = sets(old, "o").join(sets(new, "n"), key, "full")
    none = F.array().cast(dict(sets(old, "o").dtypes)["o"])
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("common")
    o, n = F.coalesce("o", none), F.coalesce("n", none)
    return both.select(key, state.alias("state"), F.size(F.array_except(n, o)).alias("gained"), F.size(F.array_except(o, n)).alias("lost"))
