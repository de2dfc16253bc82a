"""SQL for DuckDB that fits models by recursion: Newton steps with the linear equations solved row by row."""

from __future__ import annotations

from collections.abc import Mapping

from rivalry.operators.logits import Candidate


def _solved(n: int, source: str, keep: str) -> str:
    """source (keep.., m: n lists of n + 1 values) with m reduced until its last column is the solution; no pivots are needed."""
    at = range(1, n + 1)
    for k in at:
        step = f"list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = {k} THEN list_transform(m[{k}], lambda x: x / m[{k}][{k}]) ELSE list_transform(range(1, {n + 2}), lambda j: m[i][j] - m[i][{k}] / m[{k}][{k}] * m[{k}][j]) END)"
        source = f"SELECT {keep}, {step} AS m FROM ({source}) y"
    return source


def logit_sql(candidates: Mapping[str, Candidate], rows: str = "fr", steps: int = 9) -> str:
    """Common table expressions that end with pr (contest_id, season, result, candidate, p_away, p_draw, p_home).

    rows: (contest_id, season, result, features.., flags..). Each season of rows that has an earlier one is a fold.
    """
    out, ends = [f"ys AS MATERIALIZED (SELECT DISTINCT season AS y FROM {rows} WHERE season > (SELECT min(season) FROM {rows}))"], []
    for c, (name, cand) in enumerate(candidates.items()):
        q = len(cand.features) + 1
        where = f"WHERE {cand.flag}" if cand.flag else ""
        moments = ", ".join(f"avg({x}) AS m{j}, coalesce(nullif(stddev_pop({x}), 0), 1) AS s{j}" for j, x in enumerate(cand.features))
        scaled = "[" + ", ".join([f"({x} - m{j}) / s{j}" for j, x in enumerate(cand.features)] + ["1.0::DOUBLE"]) + "]"
        out.append(f"fit_f{c} AS MATERIALIZED (SELECT y, {moments} FROM {rows} JOIN ys ON season < y {where} GROUP BY y)")
        out.append(f"fit_t{c} AS MATERIALIZED (SELECT f.y, result, {scaled} AS x FROM {rows} JOIN fit_f{c} f ON season < f.y {where})")
        grads = [f"sum((p{k} - (result = {k})::INT) * x[{j}])" for k in (1, 2) for j in range(1, q + 1)]
        weight = {(1, 1): "p1 * (1 - p1)", (1, 2): "-p1 * p2", (2, 2): "p2 * (1 - p2)"}
        sums = [f"{g} AS g{i}" for i, g in enumerate(grads)] + [f"sum({w} * x[{i}] * x[{j}]) AS h{a}{b}_{i}_{j}" for (a, b), w in weight.items() for i in range(1, q + 1) for j in range(i, q + 1)]

        def cell(a: int, b: int, i: int, j: int, pulled: bool) -> str:
            h = f"h{min(a, b)}{max(a, b)}_{min(i, j)}_{max(i, j)}"
            return f"{h} + {(2 if a == b else -1) / 3 / cand.c}" if i == j and pulled else h

        matrix = []
        for a in (1, 2):
            for i in range(1, q + 1):
                g = f"g{(a - 1) * q + i - 1}"
                if i < q:
                    g += f" + (2 * b[{(a - 1) * q + i}] - b[{(2 - a) * q + i}]) / {3 * cand.c}"
                matrix.append("[" + ", ".join([cell(a, b, i, j, i < q) for b in (1, 2) for j in range(1, q + 1)] + [g]) + "]")
        odds = f"SELECT t.y, i, b, result, x, exp(list_inner_product(x, b[1 : {q}])) AS e1, exp(list_inner_product(x, b[{q + 1} : {2 * q}])) AS e2 FROM fit_t{c} t JOIN fit_z{c} z ON z.y = t.y WHERE i < {steps}"
        probs = f"SELECT y, i, b, result, x, e1 / (1 + e1 + e2) AS p1, e2 / (1 + e1 + e2) AS p2 FROM ({odds}) y"
        start = f"SELECT y, i, b, [{', '.join(matrix)}] AS m FROM (SELECT y, i, b, {', '.join(sums)} FROM ({probs}) y GROUP BY y, i, b) y"
        step = f"SELECT y, i + 1, list_transform(range(1, {2 * q + 1}), lambda j: b[j] - m[j][{2 * q + 1}]) FROM ({_solved(2 * q, start, 'y, i, b')}) y"
        out.append(f"fit_z{c} AS (SELECT y, 0 AS i, [{', '.join(['0.0::DOUBLE'] * (2 * q))}] AS b FROM ys UNION ALL {step})")
        ends.append(
            f"SELECT contest_id, season, result, '{name}' AS candidate, 1 / (1 + e1 + e2) AS p_away, e1 / (1 + e1 + e2) AS p_draw, e2 / (1 + e1 + e2) AS p_home FROM (SELECT r.*, exp(list_inner_product(x, b[1 : {q}])) AS e1, exp(list_inner_product(x, b[{q + 1} : {2 * q}])) AS e2 "
            f"FROM (SELECT contest_id, season, result, {scaled} AS x FROM {rows} JOIN fit_f{c} f ON season = f.y {where}) r JOIN fit_z{c} z ON z.y = r.season AND z.i = {steps}) y"
        )
    return ",\n".join([*out, f"pr AS ({' UNION ALL '.join(ends)})"])


#: Scores of rows (season, result, p_away, p_draw, p_home) as scoring.metric_aggs has them; the first of equal probabilities is predicted.
SCORES = """count(*) AS n, avg((result = CASE WHEN p_away >= p_draw AND p_away >= p_home THEN 0 WHEN p_draw >= p_home THEN 1 ELSE 2 END)::INT) AS accuracy,
avg(-ln(greatest(2.220446049250313e-16, CASE result WHEN 0 THEN p_away WHEN 1 THEN p_draw ELSE p_home END))) AS log_loss,
avg(pow(p_away - (result = 0)::INT, 2) + pow(p_draw - (result = 1)::INT, 2) + pow(p_home - (result = 2)::INT, 2)) AS brier_score"""


def metrics_sql(source: str = "pr", by: str = "candidate") -> str:
    """Metrics by season and pooled (season null)."""
    return f"SELECT {by}, season, {SCORES} FROM {source} GROUP BY GROUPING SETS (({by}, season), ({by}))"


def deltas_sql(base: str, source: str = "pr") -> str:
    """Metrics of every other candidate less those of `base`, by season and pooled."""
    picks = ", ".join(f"c.{m} - b.{m} AS {m}_delta" for m in ("accuracy", "log_loss", "brier_score"))
    return f"SELECT c.candidate AS challenger, b.season, b.n, b.n = c.n AS same_rows, {picks} FROM ({metrics_sql(source)}) b JOIN ({metrics_sql(source)}) c ON c.season IS NOT DISTINCT FROM b.season AND b.candidate = '{base}' AND c.candidate <> '{base}'"


def poisson_sql(numeric: list[str], alpha: float = 1e-6, rounds: int = 30, weight: str = "1.0::DOUBLE") -> str:
    """Common table expressions that end with pr (.., lam), from ob (contest_id, side, season, d, e, opp, gf, numeric..).

    One round of a recursion sets the attack effects, centres them, does the same for defence, and takes a Newton step of the rest.
    weight: SQL over ob and `last`, the last date of a fold's training rows.
    """
    n = len(numeric) + 1
    xs = ["1.0", *[f"c.{x}" for x in numeric]]
    rate = " + ".join(["m.t[1]", *[f"m.t[{i + 2}] * c.{x}" for i, x in enumerate(numeric)]])
    solve = "list_reduce(list_prepend(greatest(ln((y + 1) / t), 0), list_transform(range(0, 40), lambda x: 0.0::DOUBLE)), lambda a, x: a + (y - exp(a) * t - k * a) / (exp(a) * t + k))"

    def block(name: str, own: str, other: str, effects: str, theta: str) -> str:
        return f"""{name}_s AS (SELECT c.y_ AS fold, c.{own} AS id, kp.k, sum(c.y) AS y, sum(c.w * exp({rate} + f.v)) AS t FROM cl c JOIN kp ON kp.fold = c.y_ JOIN {theta} m ON m.fold = c.y_ JOIN {effects} f ON f.fold = c.y_ AND f.id = c.{other} GROUP BY ALL),
{name}_r AS (SELECT fold, id, {solve} AS v FROM {name}_s), {name}_m AS (SELECT fold, avg(v) AS mean FROM {name}_r GROUP BY 1),
{name} AS (SELECT r.fold, id, v - mean AS v FROM {name}_r r JOIN {name}_m USING (fold)), {name}_t AS (SELECT m.fold, list_prepend(m.t[1] + mean, m.t[2:]) AS t FROM {theta} m JOIN {name}_m USING (fold))"""

    g = ", ".join(f"sum((r - y) * {x.replace('c.', '')}) AS g{i}" for i, x in enumerate(xs))
    h = ", ".join(f"sum(r * {xs[i].replace('c.', '')} * {xs[j].replace('c.', '')}) AS h{i}_{j}" for i in range(n) for j in range(i, n))
    pull = lambda i: " + k" if i else ""
    matrix = ", ".join("[" + ", ".join([f"h{min(i, j)}_{max(i, j)}{pull(i) if i == j else ''}" for j in range(n)] + [f"g{i}" + (f" + k * t[{i + 1}]" if i else "")]) + "]" for i in range(n))
    newton = _solved(n, f"SELECT fold, t, [{matrix}] AS m FROM (SELECT fold, t, k, {g}, {h} FROM (SELECT c.*, c.y_ AS fold, m.t, kp.k, c.w * exp({rate} + a.v + d.v) AS r FROM cl c JOIN kp ON kp.fold = c.y_ JOIN dd_t m ON m.fold = c.y_ JOIN aa a ON a.fold = c.y_ AND a.id = c.e JOIN dd d ON d.fold = c.y_ AND d.id = c.opp) y GROUP BY fold, t, k) y", "fold, t")
    keys = ", ".join(["y_", "e", "opp", *numeric])
    return f"""ys AS MATERIALIZED (SELECT DISTINCT season AS y_ FROM ob WHERE season > (SELECT min(season) FROM ob)), tr AS (SELECT ob.*, y_, max(d) OVER (PARTITION BY y_) AS last FROM ob JOIN ys ON season < y_),
cl AS MATERIALIZED (SELECT {keys}, sum({weight}) AS w, sum({weight} * gf) AS y FROM tr GROUP BY {keys}), kp AS MATERIALIZED (SELECT y_ AS fold, {alpha} * sum(w) AS k, ln(sum(y) / sum(w)) AS mu FROM cl GROUP BY 1),
sp AS (SELECT 0 AS i, 'm' AS kind, fold, CAST(0 AS BIGINT) AS id, 0.0::DOUBLE AS v, [mu{', 0.0' * (n - 1)}] AS t FROM kp UNION ALL SELECT DISTINCT 0, 'a', y_, CAST(e AS BIGINT), 0.0::DOUBLE, [0.0::DOUBLE] FROM cl UNION ALL SELECT DISTINCT 0, 'd', y_, CAST(opp AS BIGINT), 0.0::DOUBLE, [0.0::DOUBLE] FROM cl
UNION ALL SELECT * FROM (WITH s0 AS (SELECT * FROM sp WHERE i < {rounds}), d0 AS (SELECT * FROM s0 WHERE kind = 'd'), m0 AS (SELECT fold, t FROM s0 WHERE kind = 'm'), i0 AS (SELECT max(i) + 1 AS i FROM s0),
{block("aa", "e", "opp", "d0", "m0")}, {block("dd", "opp", "e", "aa", "aa_t")}, mm AS (SELECT fold, list_transform(range(1, {n + 1}), lambda j: t[j] - m[j][{n + 1}]) AS t FROM ({newton}) y)
SELECT i0.i, x.* FROM i0, (SELECT 'm' AS kind, fold, CAST(0 AS BIGINT) AS id, 0.0::DOUBLE AS v, t FROM mm UNION ALL SELECT 'a', fold, id, v, [0.0::DOUBLE] FROM aa UNION ALL SELECT 'd', fold, id, v, [0.0::DOUBLE] FROM dd) x) y),
z AS MATERIALIZED (SELECT * FROM sp WHERE i = {rounds}),
pr AS (SELECT c.*, exp({rate} + coalesce(a.v, 0) + coalesce(d.v, 0)) AS lam FROM ob c JOIN z m ON m.kind = 'm' AND m.fold = c.season LEFT JOIN z a ON a.kind = 'a' AND a.fold = c.season AND a.id = c.e LEFT JOIN z d ON d.kind = 'd' AND d.fold = c.season AND d.id = c.opp)"""


#: What moves with the temperature and the biases of draw and home, for away, draw and home.
_MOVES = {"tau": ("la", "ld", "lh"), "b1": ("0", "1", "0"), "b2": ("0", "0", "1")}


def chained_sql(kinds: Mapping[str, tuple[str, ...]], source: str, steps: int = 30) -> str:
    """Common table expressions that end with ch (contest_id, season, result, kind, probabilities): each season of source (contest_id,
    season, result, probabilities) by calibrators of the rows of its earlier seasons."""
    out = [f"oo AS MATERIALIZED (SELECT contest_id, season, result, ln(p_away) AS la, ln(p_draw) AS ld, ln(p_home) AS lh FROM {source})", "yo AS MATERIALIZED (SELECT DISTINCT season AS y FROM oo WHERE season > (SELECT min(season) FROM oo))"]
    ends = []
    for kind, own in kinds.items():
        n, at = len(own), {"tau": 1, "b1": 2, "b2": 3}
        mean = lambda u: f"(qa * ({u[0]}) + qd * ({u[1]}) + qh * ({u[2]}))"
        sums = [f"sum({mean(_MOVES[m])} - CASE result WHEN 0 THEN {_MOVES[m][0]} WHEN 1 THEN {_MOVES[m][1]} ELSE {_MOVES[m][2]} END) AS g{i}" for i, m in enumerate(own)]
        sums += [f"sum({mean([f'({p}) * ({q})' for p, q in zip(_MOVES[a], _MOVES[b], strict=True)])} - {mean(_MOVES[a])} * {mean(_MOVES[b])}) AS h{i}_{j}" for i, a in enumerate(own) for j, b in enumerate(own)]
        matrix = ", ".join("[" + ", ".join([f"h{i}_{j}" for j in range(n)] + [f"g{i}"]) + "]" for i in range(n))
        odds = f"SELECT z.y, i, b, result, la, ld, lh, exp(b[1] * (ld - la) + b[2]) AS ed, exp(b[1] * (lh - la) + b[3]) AS eh FROM oo JOIN cal_{kind} z ON season < z.y WHERE i < {steps}"
        probs = f"SELECT y, i, b, result, la, ld, lh, 1 / (1 + ed + eh) AS qa, ed / (1 + ed + eh) AS qd, eh / (1 + ed + eh) AS qh FROM ({odds}) y"
        solved = _solved(n, f"SELECT y, i, b, [{matrix}] AS m FROM (SELECT y, i, b, {', '.join(sums)} FROM ({probs}) y GROUP BY y, i, b) y", "y, i, b")
        new = ["b[1]", "b[2]", "b[3]"]
        for i, m in enumerate(own):
            new[at[m] - 1] = f"b[{at[m]}] - m[{i + 1}][{n + 1}]"
        new[0] = f"greatest(0, {new[0]})"
        out.append(f"cal_{kind} AS (SELECT y, 0 AS i, [1.0::DOUBLE, 0, 0] AS b FROM yo UNION ALL SELECT y, i + 1, [{', '.join(new)}] FROM ({solved}) y)")
        ends.append(f"SELECT contest_id, season, result, '{kind}' AS kind, 1 / (1 + ed + eh) AS p_away, ed / (1 + ed + eh) AS p_draw, eh / (1 + ed + eh) AS p_home FROM (SELECT oo.*, exp(b[1] * (ld - la) + b[2]) AS ed, exp(b[1] * (lh - la) + b[3]) AS eh FROM oo JOIN cal_{kind} z ON z.y = season AND i = {steps}) y")
    return ",\n".join([*out, f"ch AS ({' UNION ALL '.join(ends)})"])
