"""Contest-shaped views over the driver's tables: the same text for Spark and, as common table expressions, for the SQL check."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents")

_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; where that isn't set a temporary one serves local runs (tests) only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="rivalry-"))
        root = _OWN[0]
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for plans that read one frame many times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


VIEWS = {
    "ranked_lines": """SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, l_discount,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn FROM {lineitem}""",
    "contests": """SELECT a.l_orderkey AS contest_id, CAST(o.o_orderdate AS DATE) AS d, year(o.o_orderdate) AS season,
  a.l_suppkey AS home, b.l_suppkey AS away, c.c_mktsegment AS competition, c.c_nationkey AS place,
  CAST(a.l_quantity AS INT) % 5 AS home_score, CAST(b.l_quantity AS INT) % 5 AS away_score,
  CASE WHEN CAST(a.l_quantity AS INT) % 5 > CAST(b.l_quantity AS INT) % 5 THEN 2
       WHEN CAST(a.l_quantity AS INT) % 5 = CAST(b.l_quantity AS INT) % 5 THEN 1 ELSE 0 END AS result
FROM {ranked_lines} a JOIN {ranked_lines} b ON a.l_orderkey = b.l_orderkey AND a.rn = 1 AND b.rn = 2
JOIN {orders} o ON o.o_orderkey = a.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey
WHERE a.l_suppkey <> b.l_suppkey""",
    "appearances": """SELECT contest_id, d, season, competition, place, home AS e, away AS opp, 'home' AS side,
  home_score AS gf, away_score AS ga, result FROM {contests}
UNION ALL SELECT contest_id, d, season, competition, place, away, home, 'away', away_score, home_score, result FROM {contests}""",
    "contests_strict": """SELECT k.* FROM {contests} k WHERE NOT EXISTS (SELECT 1 FROM {appearances} x
  WHERE x.d = k.d AND x.e = k.home AND x.contest_id < k.contest_id) AND NOT EXISTS (SELECT 1 FROM {appearances} x
  WHERE x.d = k.d AND x.e = k.away AND x.contest_id < k.contest_id)""",
    "contest_events": """SELECT l.l_orderkey * 100 + l.rn AS event_id, k.contest_id, k.d, k.season,
  CASE WHEN l.rn % 2 = 1 THEN k.home ELSE k.away END AS e, CASE WHEN l.rn % 2 = 1 THEN 'home' ELSE 'away' END AS side,
  CASE CAST(l.l_quantity AS INT) % 4 WHEN 0 THEN 'GOAL' WHEN 1 THEN 'SUBSTITUTION' WHEN 2 THEN 'YELLOW_CARD' ELSE 'RED_CARD' END AS event_type,
  1 + l.l_partkey % 90 AS minute, CASE WHEN 1 + l.l_partkey % 90 <= 45 THEN 0 ELSE 1 END AS half,
  CASE WHEN 1 + l.l_partkey % 90 IN (45, 90) THEN 1 + l.rn % 3 ELSE 0 END AS added
FROM {ranked_lines} l JOIN {contests} k ON k.contest_id = l.l_orderkey""",
    "xg_obs": """SELECT contest_id, d, competition, home, away,
  CAST(home_score AS DOUBLE) + CAST(contest_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS home_xg,
  CAST(away_score AS DOUBLE) + CAST(contest_id % 7 AS DOUBLE) / CAST(10 AS DOUBLE) AS away_xg,
  contest_id % 9 <> 0 AS eligible FROM {contests}""",
    "aliases": """SELECT s_suppkey AS entity_id, concat('N', CAST(s_suppkey % 50 AS VARCHAR(20))) AS source_name, 'a' AS source,
  CASE WHEN rn = 1 THEN CAST(NULL AS DATE) ELSE DATE '1998-01-01' END AS valid_from,
  CASE WHEN rn = 1 THEN DATE '1997-12-31' ELSE CAST(NULL AS DATE) END AS valid_to
FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 50 ORDER BY s_suppkey) AS rn FROM {supplier}) t""",
    "squads": """SELECT a.contest_id, a.d, a.season, a.e, a.e * 100 + (a.contest_id + n.n * 7) % 18 AS player, n.n < 11 AS starter,
  CASE WHEN n.n < 11 THEN 90 - (a.contest_id * n.n) % 30 WHEN n.n = 11 THEN 30 ELSE 0 END AS minutes
FROM {appearances} a CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS n(n)""",
    "schedule_rev": """SELECT r.rev, o.o_orderkey AS fixture_key,
  CASE WHEN r.rev = 2 AND o.o_orderkey % 11 = 0 THEN CAST(CAST(o.o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE)
       ELSE CAST(o.o_orderdate AS DATE) END AS d,
  CASE WHEN o.o_orderkey % 7 = 0 AND r.rev = 2 THEN 'completed' WHEN o.o_orderstatus = 'F' THEN 'completed'
       WHEN o.o_orderstatus = 'P' THEN 'candidate' ELSE 'scheduled' END AS status,
  CASE WHEN o.o_orderstatus = 'O' AND NOT (o.o_orderkey % 7 = 0 AND r.rev = 2) THEN NULL
       WHEN r.rev = 2 AND o.o_orderkey % 19 = 0 THEN o.o_custkey % 5 + 1 ELSE o.o_custkey % 5 END AS score
FROM {orders} o CROSS JOIN (VALUES (1),(2)) AS r(rev)
WHERE NOT (r.rev = 2 AND o.o_orderkey % 13 = 0) AND NOT (r.rev = 1 AND o.o_orderkey % 17 = 0)""",
    "predictions": """SELECT contest_id, season, d, home, away, result,
  CAST(1 + away % 5 AS DOUBLE) / CAST(3 + away % 5 + home % 5 + (home + away) % 3 AS DOUBLE) AS p_away,
  CAST(1 + (home + away) % 3 AS DOUBLE) / CAST(3 + away % 5 + home % 5 + (home + away) % 3 AS DOUBLE) AS p_draw,
  CAST(1 + home % 5 AS DOUBLE) / CAST(3 + away % 5 + home % 5 + (home + away) % 3 AS DOUBLE) AS p_home FROM {contests}""",
    "profiles": """SELECT season, e, s.stat, sum(CASE WHEN s.stat = 'gf' THEN gf ELSE ga END) AS raw_value, count(*) AS basis
FROM {appearances} CROSS JOIN (VALUES ('gf'),('ga')) AS s(stat) GROUP BY season, e, s.stat""",
}


#: How Spark makes views whose text would shuffle lineitem more than once, or columns that can't change their rows: lines of one order that
#: agree in number, supplier, part and quantity are the same to them.
BUILT = {
    "short_lines": """SELECT l_orderkey, l_suppkey, l_partkey, l_quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS rn FROM {lineitem}""",
    "contests": """SELECT a.l_orderkey AS contest_id, CAST(o.o_orderdate AS DATE) AS d, year(o.o_orderdate) AS season,
  home, away, c.c_mktsegment AS competition, c.c_nationkey AS place, home_score, away_score,
  CASE WHEN home_score > away_score THEN 2 WHEN home_score = away_score THEN 1 ELSE 0 END AS result
FROM (SELECT l_orderkey, max(CASE WHEN rn = 1 THEN l_suppkey END) AS home, max(CASE WHEN rn = 2 THEN l_suppkey END) AS away,
  max(CASE WHEN rn = 1 THEN CAST(l_quantity AS INT) % 5 END) AS home_score, max(CASE WHEN rn = 2 THEN CAST(l_quantity AS INT) % 5 END) AS away_score
  FROM {short_lines} WHERE rn <= 2 GROUP BY l_orderkey) a
JOIN {orders} o ON o.o_orderkey = a.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey WHERE home <> away""",
    "contest_events": VIEWS["contest_events"].replace("{ranked_lines}", "{short_lines}"),
}


def _parts(sql: str) -> list[str]:
    return [n for n in (*VIEWS, *RAW, "short_lines") if "{" + n + "}" in sql]


#: Views that a query writes when it first reads them: they join the largest tables, and most queries read them many times.
WRITTEN = ("contests", "contests_strict")


#: Bytes that a row has in a hash table of the driver for each of its bytes in a Parquet file, where ids and dates are packed into a few bits.
UNPACKED = 8


def views(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """A function from the name of a raw table or of one of VIEWS to its DataFrame, for one query.

    Spark takes a file's size for that of its rows when it chooses what to broadcast, and then collects hundreds of MB on the driver; in the
    session a file counts as UNPACKED times its size.
    """
    factor = "spark.sql.sources.fileCompressionFactor"
    spark.conf.set(factor, str(max(float(spark.conf.get(factor)), UNPACKED)))

    @cache
    def view(name: str) -> DataFrame:
        text = BUILT.get(name) or VIEWS.get(name)
        if not text:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df = spark.sql(text, **{n: view(n) for n in _parts(text)})
        return stored(df, name) if name in WRITTEN else df

    return view


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table or one of VIEWS as a DataFrame."""
    return views(spark, sf_dir)(name)


def spread(v: Callable[[str], DataFrame], name: str, source: str, *keys: str) -> DataFrame:
    """The view `name` over rows of its source that are shuffled by keys first: rows that the view makes of each one needn't be shuffled for groups with these keys."""
    rows = v(source).repartition(*keys)
    return rows.sparkSession.sql(VIEWS[name], **{source: rows})


def ctes(sql: str) -> str:
    """sql for DuckDB, with the views that it names in braces put before it as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in _parts(text):
            if n in VIEWS and n not in need:
                add(VIEWS[n])
                need.append(n)

    add(sql)
    names = {n: n for n in (*VIEWS, *RAW)}
    heads = [f"{n} AS MATERIALIZED ({VIEWS[n].format(**names)})" for n in need]
    body = sql.format(**names)
    if not heads:
        return body
    rest = body.lstrip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(heads) + ",\n" + rest[len("WITH RECURSIVE ") :]
    if rest[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(heads) + ",\n" + rest[5:]
    return "WITH " + ",\n".join(heads) + "\n" + rest


def pivot_sql(source: str, values, keep: str = "contest_id") -> str:
    picks = ", ".join(f"max(CASE WHEN side = '{s}' THEN {v} END) AS {s}_{v}" for v in values for s in ("home", "away"))
    return f"SELECT {keep}, {picks} FROM {source} GROUP BY {keep}"


def last_sql(n: int | None, aggs: dict[str, str], on: str = "b.e = a.e", base: str = "{appearances}", hist: str | None = None, keep: str = "a.side") -> str:
    """By self join: aggregates over the n latest rows b (None: all) of earlier dates for each row a."""
    hist = hist or base
    picks = ", ".join(f"{v} AS {k}" for k, v in aggs.items())
    limit = "" if n is None else f"AND k <= {n}"
    return f"""SELECT a.contest_id, {keep}, {picks} FROM {base} a LEFT JOIN (SELECT * FROM (
  SELECT a.contest_id AS aid, a.side AS aside, b.*, row_number() OVER (PARTITION BY a.contest_id, a.side ORDER BY b.d DESC, CAST(b.contest_id AS VARCHAR) DESC) AS k
  FROM {base} a JOIN {hist} b ON {on} AND b.d < a.d) x WHERE true {limit}) b
  ON b.aid = a.contest_id AND b.aside = a.side GROUP BY a.contest_id, {keep}"""


class Registry:
    """Queries and their SQL by key."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}
        #: the SQL before doubles are rounded, for SQL that builds on it
        self.raw: dict[str, str] = {}

    def add(self, key: str, build, sql: str | None = None, doubles: tuple[str, ...] | list[str] = ()) -> None:
        """build(v) gets a function from view name to DataFrame. `doubles` are rounded to six places on both sides."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(views(spark, sf_dir))
            return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in doubles}) if doubles else df

        self.queries[key] = query
        if sql:
            text = self.raw[key] = ctes(sql)
            if doubles:
                text = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in doubles)}) FROM ({text}) z"
            self.oracles[key] = text
