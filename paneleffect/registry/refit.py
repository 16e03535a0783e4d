"""SQL that fits boosted trees again, and walks them.

A boosted fit can be repeated exactly where every midpoint between neighbouring values of a feature is a
possible cut, that is with more bins than values: all that decides a tree are sums and counts. A tree
splits the node's rows where the squared error falls most; a leaf holds its rows' mean; the first
tree is fitted to the label, each further one to twice the residual, and weighs ``STEP``.
"""

from __future__ import annotations

from collections.abc import Mapping

from paneleffect.registry import panels as P

ITERATIONS, DEPTH, STEP = 3, 2, 0.5
#: The same for the library: small ensembles whose every cut SQL can find again.
EXACT = {"maxIter": ITERATIONS, "maxDepth": DEPTH, "stepSize": STEP, "maxBins": 1 << 17}


def _long(rows: str, features: Mapping[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT k, {f} AS f, CAST({value} AS DOUBLE) AS v FROM {rows}" for f, value in enumerate(features.values(), 1))


def _splits(n: str, nodes: str, categories: str) -> str:
    """The best cut of each node: largest fall of the squared error, then first feature and lowest cut.
    Of a category's two values the one with the smaller mean is on the left."""
    return f"""SELECT b.node, b.f, b.v, d.nv, b.gain, b.c, b.f IN ({categories}) AND b.sl / b.nl > (b.s - b.sl) / (b.c - b.nl) AS flipped FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS r FROM (
        SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (c - nl) - s * s / c AS gain FROM (
          SELECT node, f, v, SUM(sy) OVER w AS sl, SUM(cy) OVER w AS nl, SUM(sy) OVER u AS s, SUM(cy) OVER u AS c
          FROM (SELECT node, f, v, SUM(y) AS sy, COUNT(*) AS cy FROM {nodes} JOIN {n}_x USING (k) GROUP BY node, f, v)
          WINDOW w AS (PARTITION BY node, f ORDER BY v), u AS (PARTITION BY node, f)) WHERE nl < c) WHERE gain > 0) b
      JOIN {n}_d d ON d.f = b.f AND d.v = b.v WHERE b.r = 1"""


def boosted(n: str, rows: str, features: Mapping[str, str], label: str, iterations: int = ITERATIONS, depth: int = DEPTH, step: float = STEP, categorical: bool = False) -> str:
    """Tables of a fit on ``rows`` (k, and what the expressions need): ``n_nodes`` and ``n`` (k, prediction)."""
    # Those that are 0 or 1 by a condition are categories to the library, unless it scales them.
    categories = ", ".join(["0", *[str(f) for f, value in enumerate(features.values(), 1) if categorical and value.startswith("CASE")]])
    parts = [
        f"{n}_x AS MATERIALIZED ({_long(rows, features)})",
        f"{n}_d AS MATERIALIZED (SELECT f, v, LEAD(v) OVER (PARTITION BY f ORDER BY v) AS nv FROM (SELECT DISTINCT f, v FROM {n}_x))",
    ]
    nodes = []
    for t in range(iterations):
        weight = 1.0 if t == 0 else step
        target = f"CAST({label} AS DOUBLE)" if t == 0 else f"2 * (CAST({label} AS DOUBLE) - p)"
        source = rows if t == 0 else f"{rows} JOIN {n}_p{t - 1} USING (k)"
        parts.append(f"{n}_a{t}_0 AS MATERIALIZED (SELECT k, {target} AS y, CAST(1 AS BIGINT) AS node FROM {source})")
        for level in range(depth):
            a, s = f"{n}_a{t}_{level}", f"{n}_s{t}_{level}"
            parts.append(f"{s} AS MATERIALIZED ({_splits(n, f'(SELECT * FROM {a} WHERE node >= {2**level})', categories)})")
            parts.append(
                f"{n}_a{t}_{level + 1} AS MATERIALIZED (SELECT a.k, a.y, CASE WHEN s.node IS NULL THEN a.node WHEN (x.v > s.v) <> s.flipped THEN 2 * a.node + 1 ELSE 2 * a.node END AS node "
                f"FROM {a} a LEFT JOIN {s} s ON a.node = s.node LEFT JOIN {n}_x x ON x.k = a.k AND x.f = s.f)"
            )
            nodes.append(f"SELECT {t} AS tree, {weight} AS weight, node, f, (v + nv) / 2 AS cut, flipped, f IN ({categories}) AS category, NULL AS value, gain, c FROM {s}")
        parts.append(f"{n}_l{t} AS MATERIALIZED (SELECT node, AVG(y) AS value, COUNT(*) AS c FROM {n}_a{t}_{depth} GROUP BY node)")
        nodes.append(f"SELECT {t}, {weight}, node, NULL, NULL, NULL, NULL, value, NULL, c FROM {n}_l{t}")
        before = "" if t == 0 else f" JOIN {n}_p{t - 1} USING (k)"
        parts.append(f"{n}_p{t} AS MATERIALIZED (SELECT k, {'' if t == 0 else 'p + '}{weight} * value AS p FROM {n}_a{t}_{depth} JOIN {n}_l{t} USING (node){before})")
    parts.append(f"{n}_nodes AS MATERIALIZED ({' UNION ALL '.join(nodes)})")
    parts.append(f"{n} AS MATERIALIZED (SELECT k, p AS prediction FROM {n}_p{iterations - 1})")
    return ", ".join(parts)


def walked(w: str, n: str, rows: str, features: Mapping[str, str], iterations: int = ITERATIONS) -> str:
    """Table ``w`` (k, prediction): other ``rows`` sent down the trees of the fit ``n``."""
    return f"""{w}_x AS MATERIALIZED ({_long(rows, features)}),
      {w}_walk AS (SELECT k, t.tree, CAST(1 AS BIGINT) AS node FROM {rows} CROSS JOIN RANGE(0, {iterations}) t(tree)
        UNION ALL SELECT w.k, w.tree, 2 * w.node + CASE WHEN (x.v > s.cut) <> s.flipped THEN 1 ELSE 0 END
        FROM {w}_walk w JOIN {n}_nodes s ON s.tree = w.tree AND s.node = w.node AND s.f IS NOT NULL JOIN {w}_x x ON x.k = w.k AND x.f = s.f),
      {w} AS MATERIALIZED (SELECT k, ROUND(SUM(weight * value), 12) AS prediction FROM {w}_walk JOIN {n}_nodes USING (tree, node) WHERE value IS NOT NULL GROUP BY k)"""


def node_rows(n: str, features: Mapping[str, str]) -> str:
    """The node table as the library reports it."""
    names = ", ".join(f"'{f}'" for f in features)
    return f"""SELECT CAST(tree AS BIGINT) AS tree, node, ([{names}])[f] AS feature, CAST(CASE WHEN f IS NOT NULL THEN 2 * node END AS BIGINT) AS left_node,
      CAST(CASE WHEN f IS NOT NULL THEN 2 * node + 1 END AS BIGINT) AS right_node, CAST(c AS BIGINT) AS rows, CAST(weight AS DOUBLE) AS weight,
      CASE WHEN NOT category THEN ROUND(cut, 6) + 0.0 END AS threshold, CASE WHEN category THEN CASE WHEN flipped THEN '1.0' ELSE '0.0' END END AS left_values, ROUND(value, 6) + 0.0 AS value FROM {n}_nodes"""


def importance_rows(n: str, features: Mapping[str, str]) -> str:
    """Share of each feature in the fall of the squared error over all trees."""
    names = ", ".join(f"({f}, '{name}')" for f, name in enumerate(features, 1))
    return f"""SELECT name AS feature, ROUND(COALESCE(SUM(gain), 0) / (SELECT SUM(gain) FROM {n}_nodes), 6) AS importance
      FROM (VALUES {names}) v(f, name) LEFT JOIN {n}_nodes s ON s.f = v.f AND s.gain IS NOT NULL GROUP BY name"""


# --- the long chain

END = "1997-06-01"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SEGMENT = "covariate_path_a_segment"
PROPENSITY_A = {"confound_path_a_suppbal": "suppbal"}
EFFECT_A = {
    **{f"{_SEGMENT}_{s}": f"CASE WHEN segment = '{s}' THEN 1 ELSE 0 END" for s in SEGMENTS},
    "propensity_score_path_A_suggestion_count": "propensity",
    "suggestion_count_adstock": "sa",
    "percent_other_hcps_suggested_adstock": "oa",
}
PROPENSITY_B = {"confound_path_b_custbal": "custbal"}
EFFECT_B = {
    "covariate_path_b_lines": "lines",
    "propensity_score_path_B_action_count": "propensity",
    "suggestion_count_adstock": "sa",
    "action_count_adstock": "aa",
}
THEMES = ("theme_f_qualified", "theme_o_qualified")


def _carried(name: str, rows: str, keys: str, columns: Mapping[str, tuple[float, str]], rest: str) -> str:
    """``name``: the rows with geometric carry-over over the four weeks before, by calendar."""
    sums = ", ".join(f"ROUND(SUM(POWER({rate}, (x.week_end_date - y.week_end_date) / 7) * y.{column}), 12) AS {out}" for out, (rate, column) in columns.items())
    same = " AND ".join(f"x.{key} = y.{key}" for key in keys.split())
    return f"""{name}_c AS (SELECT x.k, {sums} FROM {rows} x JOIN {rows} y ON {same} AND y.week_end_date BETWEEN x.week_end_date - 28 AND x.week_end_date GROUP BY x.k),
      {name} AS MATERIALIZED (SELECT {rest}, {", ".join(columns)} FROM {rows} r JOIN {name}_c USING (k))"""


def _spillover(name: str, rows: str, by: str) -> str:
    got = "CASE WHEN suggestion_count > 0 THEN 1.0 ELSE 0.0 END"
    return f"""{name} AS MATERIALIZED (SELECT *, COALESCE((SUM({got}) OVER w - {got}) / NULLIF(COUNT(*) OVER w - 1, 0), 0) AS other
      FROM {rows} WINDOW w AS (PARTITION BY {by}))"""


_A_CARRIED = {"sa": (0.3, "suggestion_count"), "oa": (0.3, "other")}
_A_REST = "k, rep_id, customer_id, week_end_date, suggestion_count, action_count, other, segment, propensity"
_ALL_THEMES = " UNION ALL ".join(f"SELECT *, '{t}' AS theme, CASE WHEN total > 0 THEN {t} ELSE 0.0 END AS suggestion_count FROM th_all" for t in THEMES)

ROWS_A = f"""WITH RECURSIVE {P.LONG.strip()}, a0 AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER (ORDER BY rep_id, customer_id, week_end_date) AS k, rep_id, customer_id, week_end_date, suggestion_count, action_count,
    confound_path_a_suppbal AS suppbal, {_SEGMENT} AS segment, theme_f_qualified, theme_o_qualified
  FROM long WHERE suggestion_type = 'call' AND action_type = 'call' AND outcome_type = 'nbrx' AND week_end_date < DATE '{END}')"""
FIT_PROPENSITY_A = f"{ROWS_A}, {boosted('pa', 'a0', PROPENSITY_A, 'suggestion_count')}"
FIT_A = f"""{FIT_PROPENSITY_A}, a1 AS MATERIALIZED (SELECT a0.*, prediction AS propensity FROM a0 JOIN pa USING (k)),
  {_spillover('a2', 'a1', 'rep_id, week_end_date')}, {_carried('a3', 'a2', 'rep_id customer_id', _A_CARRIED, _A_REST)},
  {boosted('ea', 'a3', EFFECT_A, 'action_count')}"""
COUNTERFACTUAL_A = f"""{FIT_A}, az AS MATERIALIZED (SELECT k, rep_id, customer_id, week_end_date, segment, propensity, 0.0 AS sa, 0.0 AS oa FROM a1),
  {walked('zw', 'ea', 'az', EFFECT_A)},
  ac AS MATERIALIZED (SELECT rep_id, customer_id, week_end_date, GREATEST(prediction, 0) AS counterfactual_action_count FROM az JOIN zw USING (k))"""
_THEMED_A = f"""th_all AS (SELECT rep_id, customer_id, week_end_date, suggestion_count AS total, action_count, segment, propensity, theme_f_qualified, theme_o_qualified FROM a1),
  th0 AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (ORDER BY theme, rep_id, customer_id, week_end_date) AS k FROM ({_ALL_THEMES})),
  {_spillover('th1', 'th0', 'theme, rep_id, week_end_date')}, {_carried('th2', 'th1', 'theme rep_id customer_id', _A_CARRIED, _A_REST + ', theme')},
  {walked('tw', 'ea', 'th2', EFFECT_A)}"""
_AF = "rep_id, customer_id, week_end_date, suggestion_count, sa, other, action_count, propensity, GREATEST(prediction, 0) AS predicted_action_count"
FACTUAL_A = f"""{FIT_A}, {_THEMED_A}, af AS MATERIALIZED (
  SELECT {_AF}, 'all' AS theme FROM a3 JOIN ea USING (k) UNION ALL SELECT {_AF}, theme FROM th2 JOIN tw USING (k))"""
BOTH_A = f"""{COUNTERFACTUAL_A}, {_THEMED_A}, af AS MATERIALIZED (
  SELECT {_AF}, 'all' AS theme FROM a3 JOIN ea USING (k) UNION ALL SELECT {_AF}, theme FROM th2 JOIN tw USING (k))"""

_B_CARRIED = {"sa": (0.3, "suggestion_count"), "aa": (0.69, "action_count")}
_B_REST = "k, customer_id, week_end_date, theme, lines, propensity, outcome_count"


def _collapsed(name: str, actions: str, suggestions: str, join: str, outcome: str, theme: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY {theme}, customer_id, week_end_date) AS k, customer_id, week_end_date, {theme} AS theme,
      SUM({actions}) AS action_count, SUM({suggestions}) AS suggestion_count, SUM(outcome_count) AS outcome_count,
      MAX(confound_path_b_custbal) AS custbal, SUM(covariate_path_b_lines) AS lines
      FROM long l {join} WHERE suggestion_type = 'call' AND action_type = 'call' AND outcome_type = '{outcome}' AND l.week_end_date < DATE '{END}'
      GROUP BY customer_id, week_end_date, {theme})"""


def _path_b(o: str) -> str:
    """Both fits and all scenario frames of one outcome type; names end with the type."""
    keys = "rep_id, customer_id, week_end_date"
    scored = f"SELECT r.*, s.propensity FROM {{}} r LEFT JOIN b1{o} s ON s.customer_id = r.customer_id AND s.week_end_date = r.week_end_date"
    suggested = f"CASE f.theme {' '.join(f'''WHEN '{t}' THEN CASE WHEN l.suggestion_count > 0 THEN {t} ELSE 0.0 END''' for t in THEMES)} ELSE l.suggestion_count END"
    return f"""{_collapsed(f'b0{o}', 'action_count', 'suggestion_count', '', o, "'all'")},
      {boosted(f'pb{o}', f'b0{o}', PROPENSITY_B, 'action_count')},
      b1{o} AS MATERIALIZED (SELECT b0{o}.*, prediction AS propensity FROM b0{o} JOIN pb{o} USING (k)),
      {_carried(f'b2{o}', f'b1{o}', 'customer_id', _B_CARRIED, _B_REST)},
      {boosted(f'eb{o}', f'b2{o}', EFFECT_B, 'outcome_count')},
      {_collapsed(f'f0{o}', 'f.predicted_action_count', suggested, f'JOIN af f USING ({keys})', o, 'f.theme')}, f1{o} AS ({scored.format(f'f0{o}')}),
      {_carried(f'f2{o}', f'f1{o}', 'theme customer_id', _B_CARRIED, _B_REST)}, {walked(f'fw{o}', f'eb{o}', f'f2{o}', EFFECT_B)},
      {_collapsed(f'z0{o}', 'c.counterfactual_action_count', '0.0', f'JOIN ac c USING ({keys})', o, "'none'")}, z1{o} AS ({scored.format(f'z0{o}')}),
      {_carried(f'z2{o}', f'z1{o}', 'customer_id', _B_CARRIED, _B_REST)}, {walked(f'zw{o}', f'eb{o}', f'z2{o}', EFFECT_B)}"""


def _outcome_rows(name: str, rows: str, walk: str, column: str, rest: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT customer_id, week_end_date, '{o}' AS outcome_type, {rest}GREATEST(prediction, 0) AS {column} FROM {rows}{o} JOIN {walk}{o} USING (k)" for o in ("nbrx", "trx")
    )
    return f"{name} AS MATERIALIZED ({each})"


CHAIN = f"""{BOTH_A}, {_path_b('nbrx')}, {_path_b('trx')},
  {_outcome_rows('bf', 'f2', 'fw', 'predicted_outcome_count', 'theme, propensity, ')},
  {_outcome_rows('bc', 'z2', 'zw', 'counterfactual_outcome_count', '')}"""


# --- the wide panel: two arms a fit

HISTORY = ("lag_suggestion_total_1", "rolling4_suggestion_total", "baseline_trx_8w")
MONTHS, REPS = tuple(range(2, 13)), tuple(f"R{i}" for i in range(1, 5))
WIDE = {**{c: c for c in HISTORY}, **{f"rep_id_{r}": f"CASE WHEN rep_id = '{r}' THEN 1 ELSE 0 END" for r in reversed(REPS)}, **{f"month_{m}": f"CASE WHEN month = {m} THEN 1 ELSE 0 END" for m in reversed(MONTHS)}}
WIDE_ROWS = f"""WITH RECURSIVE {P.TOTALS.strip()}, wide AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER (ORDER BY hcp_id, rep_id, week_end_date) AS k, *, month(week_end_date) AS month,
    CASE WHEN trx % 7 = 0 THEN NULL ELSE CAST(suggestion_total > 0 AS INT) END AS treated_suggestion, CAST(action_total > 0 AS INT) AS treated_action,
    COALESCE(LAG(suggestion_total) OVER w, 0) AS lag_suggestion_total_1, COALESCE(LAG(action_total) OVER w, 0) AS lag_action_total_1,
    AVG(suggestion_total) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rolling4_suggestion_total,
    COALESCE(AVG(trx) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) AS baseline_trx_8w
  FROM totals WINDOW w AS (PARTITION BY hcp_id, rep_id ORDER BY week_end_date))"""


def arms(n: str, rows: str, features: Mapping[str, str], label: str, treatment: str) -> str:
    """Table ``n`` (k, effect): what the treated arm's trees predict above the control arm's, on every row. A missing flag is a control."""
    return f"""{n}t0 AS MATERIALIZED (SELECT * FROM {rows} WHERE {treatment} = 1), {n}c0 AS MATERIALIZED (SELECT * FROM {rows} WHERE {treatment} IS DISTINCT FROM 1),
      {boosted(n + 't', n + 't0', features, label, categorical=True)}, {boosted(n + 'c', n + 'c0', features, label, categorical=True)},
      {walked(n + 'tw', n + 't', rows, features)}, {walked(n + 'cw', n + 'c', rows, features)},
      {n} AS MATERIALIZED (SELECT t.k, ROUND(GREATEST(t.prediction - c.prediction, 0), 12) AS effect FROM {n}tw t JOIN {n}cw c USING (k))"""


ACTION_ARMS = f"{WIDE_ROWS}, {arms('ia', 'wide', WIDE, 'action_total', 'treated_suggestion')}"
_WITH_EFFECT = {**WIDE, "incremental_actions": "effect"}
OUTCOME_ARMS = f"""{ACTION_ARMS}, wide2 AS MATERIALIZED (SELECT wide.*, effect FROM wide JOIN ia USING (k)),
  {arms('ot', 'wide2', _WITH_EFFECT, 'trx', 'treated_action')}, {arms('onb', 'wide2', _WITH_EFFECT, 'nbrx', 'treated_action')}"""
OUTCOME_FEATURES = _WITH_EFFECT


# --- logistic regression by Newton's steps

def logistic(n: str, rows: str, x1: str, x2: str, label: str, steps: int = 9) -> str:
    """Tables ``n``b0, b1, ... (a, b, c): intercept and two coefficients, with a ridge weight of one on the summed loss."""
    parts = [f"{n}b0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c)"]
    for i in range(steps):
        parts.append(
            f"{n}h{i} AS MATERIALIZED (SELECT a, b, c, SUM(y - p) AS g0, SUM((y - p) * u) - b AS g1, SUM((y - p) * v) - c AS g2, SUM(q) AS h00, SUM(q * u) AS h01, SUM(q * v) AS h02, "
            f"SUM(q * u * u) + 1 AS h11, SUM(q * u * v) AS h12, SUM(q * v * v) + 1 AS h22 FROM (SELECT *, p * (1 - p) AS q FROM ("
            f"SELECT a, b, c, CAST({label} AS DOUBLE) AS y, CAST({x1} AS DOUBLE) AS u, CAST({x2} AS DOUBLE) AS v, 1 / (1 + EXP(-(a + b * {x1} + c * {x2}))) AS p FROM {rows}, {n}b{i})) GROUP BY a, b, c)"
        )
        parts.append(
            f"{n}b{i + 1} AS MATERIALIZED (SELECT a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d AS a, "
            f"b + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d AS b, "
            f"c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d AS c "
            f"FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d FROM {n}h{i}))"
        )
    parts.append(f"{n} AS MATERIALIZED (SELECT k, 1 / (1 + EXP(-(a + b * {x1} + c * {x2}))) AS p FROM {rows}, {n}b{steps})")
    return ", ".join(parts)


LOGISTIC = f"{WIDE_ROWS}, {logistic('lr', 'wide', 'suggestion_total', 'lag_action_total_1', 'treated_action')}"
