"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
# the driver compares all; here one or two of each family
KEYS = [
    "form_lastn", "xg_lastn_mean", "workload_windows", "h2h_cumulative", "resolve_alias_asof", "scoped_exact_link", "bridge_candidates", "expect_contests",
    "participation_intervals", "two_leg_tie", "row_scores", "segment_metrics", "snapshot_diff", "id_bridge", "elo_replay", "training_base", "score_grid_probs",
    "read_contests_csv", "html_table_extract_job", "stream_snapshot_diff", "stream_ratings", "elo_promotion_offset", "attack_defence_replay", "training_plus_full", "calibrate_C3",
    "logit_multinomial", "rolling_compare", "competition_rating_compare", "candidate_evaluation", "poisson_goals_elo", "score_batch", "coverage_profiles",
    "entity_concentration", "promotion_segments", "expect_round_robin", "min_ordinal_promoted", "export_ratings",
]


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[key](spark, str(DATA))
    want = con.sql(entry.oracle_sql()[key])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    got = Counter(tuple(map(value, r)) for r in df.collect())
    assert got == Counter(tuple(value(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "contest_id"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
