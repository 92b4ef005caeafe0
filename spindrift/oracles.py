"""DuckDB SQL for the registered queries, written from the definitions, not from the plans."""

from __future__ import annotations

import re

# Named blocks; a query lists those it needs, in order.
BLOCKS = {
    "li": """li AS (
  SELECT l_suppkey AS game_id, CASE l_returnflag WHEN 'A' THEN 'loose' WHEN 'N' THEN 'cib' WHEN 'R' THEN 'new' END AS condition,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(l_shipdate AS DATE) AS sale_date, l_extendedprice AS price FROM lineitem)""",
    "prices": """prices AS (SELECT game_id, condition, month, CAST(round(max(price) * 100) AS BIGINT) AS price_cents FROM li GROUP BY 1, 2, 3)""",
    "home": """home AS (SELECT s_suppkey AS id, r_name AS console, n_name AS platform FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "games": """games AS (
  SELECT h.id, h.console, h.platform, h.console AS region, p_name AS name, p_type AS genre, p_brand AS publisher, p_size AS list_rank,
         CAST(o_orderdate AS DATE) AS release_date, 'title-' || h.id AS slug
  FROM home h LEFT JOIN part ON p_partkey = h.id LEFT JOIN orders ON o_orderkey = h.id)""",
    "hist": """hist AS (SELECT p.game_id, h.console, p.condition, p.month, p.price_cents FROM prices p JOIN home h ON h.id = p.game_id WHERE p.price_cents > 0)""",
    "rets": """rets AS (
  SELECT a.console, a.condition, a.game_id, a.month, ln(a.price_cents) - ln(b.price_cents) AS ret
  FROM hist a JOIN hist b ON a.game_id = b.game_id AND a.condition = b.condition AND b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE))""",
    "cal": """cal AS (
  SELECT console, condition, CAST(unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM hist GROUP BY 1, 2)""",
    "idx": """idx0 AS (SELECT console, condition, month, median(ret) AS med, count(*) AS n FROM rets GROUP BY 1, 2, 3),
idx1 AS (SELECT c.console, c.condition, c.month, coalesce(i.n, 0) AS n, CASE WHEN i.n >= 5 THEN i.med END AS ret FROM cal c LEFT JOIN idx0 i USING (console, condition, month)),
idx AS (SELECT *, sum(coalesce(ret, 0)) OVER (PARTITION BY console, condition ORDER BY month) AS level FROM idx1)""",
    "panel": """panel0 AS (
  SELECT c.console, c.condition, s.game_id, c.month, ln(h.price_cents) AS logp
  FROM cal c JOIN (SELECT DISTINCT console, condition, game_id FROM hist) s USING (console, condition)
  LEFT JOIN hist h ON h.game_id = s.game_id AND h.condition = c.condition AND h.month = c.month),
panel AS (
  SELECT *, coalesce(logp, lag(logp, 1) OVER w, lag(logp, 2) OVER w) AS filled FROM panel0 WINDOW w AS (PARTITION BY game_id, condition ORDER BY month))""",
    "met": """past AS (
  SELECT *, logp - lag(logp) OVER w AS diff, logp - lag(logp, 3) OVER w AS jump,
         logp - max(logp) OVER (PARTITION BY game_id, condition ORDER BY month ROWS UNBOUNDED PRECEDING) AS fall
  FROM panel WHERE month <= DATE '2001-06-01' WINDOW w AS (PARTITION BY game_id, condition ORDER BY month)),
per AS (
  SELECT game_id, console, condition,
         max(filled) FILTER (month = DATE '2001-06-01') AS p0, max(filled) FILTER (month = DATE '2000-06-01') AS p12,
         max(filled) FILTER (month = DATE '1998-06-01') AS p36, max(filled) FILTER (month = DATE '1996-06-01') AS p60,
         min(month) FILTER (logp IS NOT NULL) AS first_month, max(month) FILTER (logp IS NOT NULL) AS last_month,
         arg_min(logp, month) AS first_logp, arg_max(logp, month) AS last_logp, count(logp) AS n_months,
         count(logp) FILTER (month >= DATE '1998-06-01') AS obs_36m,
         regr_slope(logp, (year(month) * 12 + month(month)) / 12.0::DOUBLE) FILTER (month >= DATE '1998-06-01') AS slope,
         stddev_pop(diff) FILTER (month > DATE '1998-06-01') * sqrt(12) AS vol_36m, exp(min(fall)) - 1 AS max_drawdown, max(jump) AS jump_size
  FROM past GROUP BY 1, 2, 3),
lv AS (
  SELECT console, condition, max(level) FILTER (month = DATE '2001-06-01') AS l0, max(level) FILTER (month = DATE '2000-06-01') AS l12,
         max(level) FILTER (month = DATE '1998-06-01') AS l36, max(level) FILTER (month = DATE '1996-06-01') AS l60 FROM idx GROUP BY 1, 2),
jm AS (SELECT p.game_id, p.condition, min(p.month) AS jump_month FROM past p JOIN per q ON p.game_id = q.game_id AND p.condition = q.condition AND p.jump = q.jump_size GROUP BY 1, 2),
met AS (
  SELECT p.game_id, p.console, p.condition, DATE '2001-06-01' AS "asof", p0 - p12 AS ret_12m, p0 - p36 AS ret_36m, p0 - p60 AS ret_60m,
         p0 - p12 - (l0 - l12) AS excess_12m, p0 - p36 - (l0 - l36) AS excess_36m, p0 - p60 - (l0 - l60) AS excess_60m,
         last_logp - first_logp AS ret_all, last_logp - first_logp - (b.level - a.level) AS excess_all,
         CASE WHEN obs_36m >= 12 THEN slope END AS slope_36m, vol_36m, obs_36m, n_months, first_month, last_month, max_drawdown, jump_size, jm.jump_month
  FROM per p LEFT JOIN lv USING (console, condition)
  LEFT JOIN idx a ON a.console = p.console AND a.condition = p.condition AND a.month = p.first_month
  LEFT JOIN idx b ON b.console = p.console AND b.condition = p.condition AND b.month = p.last_month
  LEFT JOIN jm ON jm.game_id = p.game_id AND jm.condition = p.condition WHERE n_months > 0)""",
    "lab": """bar AS (SELECT console, condition, quantile_cont(excess_36m, 0.8::DOUBLE) AS thr, count(excess_36m) AS many FROM met WHERE n_months >= 24 GROUP BY 1, 2),
lab AS (
  SELECT m.*, CASE WHEN m.n_months >= 24 AND m.excess_36m IS NOT NULL AND b.many >= 10 THEN CAST(m.excess_36m >= b.thr AS DOUBLE) END AS rising
  FROM met m LEFT JOIN bar b USING (console, condition))""",
    "gf": """pub AS (SELECT publisher FROM games WHERE publisher IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, publisher LIMIT 5),
span AS (SELECT console, min(release_date) AS lo, max(release_date) AS hi FROM games GROUP BY 1),
gf0 AS (
  SELECT g.*, CASE WHEN hi > lo THEN least(greatest((release_date - lo) / (hi - lo)::DOUBLE, 0), 1) END AS pos
  FROM games g LEFT JOIN span USING (console)),
gf AS (
  SELECT id AS game_id, coalesce(region, 'unknown') AS region, coalesce(platform, 'unknown') AS platform, coalesce(genre, 'unknown') AS genre,
         CASE WHEN publisher IS NULL THEN 'unknown' WHEN publisher IN (SELECT publisher FROM pub) THEN publisher ELSE 'other' END AS publisher,
         'unknown' AS developer, 'unknown' AS esrb,
         coalesce((year(release_date) // 5 * 5)::VARCHAR || '-' || (year(release_date) // 5 * 5 + 4)::VARCHAR, 'unknown') AS release_era,
         CASE WHEN pos > -0.01 AND pos <= 0.2 THEN 'early' WHEN pos > 0.2 AND pos <= 0.8 THEN 'mid' WHEN pos > 0.8 AND pos <= 1.01 THEN 'late' ELSE 'unknown' END AS lifecycle,
         CASE WHEN regexp_matches(name, '\\bred\\b') THEN 'red' WHEN regexp_matches(name, '\\bblue\\b') THEN 'blue' WHEN regexp_matches(name, '\\blarge\\b') THEN 'large'
              WHEN regexp_matches(name, '\\bnew\\b') THEN 'new' WHEN regexp_matches(name, '\\bcold\\b') THEN 'cold' WHEN regexp_matches(name, '\\bhot\\b') THEN 'hot' ELSE 'none' END AS franchise,
         CASE WHEN regexp_matches(name, '\\bring\\b') THEN 'yes' ELSE 'no' END AS kw_ring, CASE WHEN regexp_matches(name, '\\bbolt\\b') THEN 'yes' ELSE 'no' END AS kw_bolt,
         CASE WHEN regexp_matches(name, '\\bgear\\b') THEN 'yes' ELSE 'no' END AS kw_gear, CAST(year(release_date) AS BIGINT) AS release_year, pos AS lifecycle_pos
  FROM gf0)""",
}


def _price_blocks(day: str, name: str) -> str:
    return f"""{name}_at AS (
  SELECT game_id, condition, arg_max(price_cents, month) AS price FROM hist WHERE month <= DATE '{day}' AND month >= DATE '{day}' - INTERVAL 2 MONTH GROUP BY 1, 2),
{name}_r AS (
  SELECT game_id, max(price) FILTER (condition = 'cib') / max(price) FILTER (condition = 'loose')::DOUBLE AS cl, max(price) FILTER (condition = 'new') / max(price) FILTER (condition = 'cib')::DOUBLE AS nc
  FROM {name}_at GROUP BY 1),
{name} AS (
  SELECT a.game_id, a.condition,
         CASE WHEN price < 2000 THEN '<$20' WHEN price < 10000 THEN '$20-100' WHEN price < 50000 THEN '$100-500' ELSE '$500+' END AS price_bucket,
         CASE WHEN cl IS NULL THEN 'unknown' WHEN cl < 1.5 THEN '<1.5x' WHEN cl < 3 THEN '1.5-3x' ELSE '3x+' END AS cib_loose,
         CASE WHEN nc IS NULL THEN 'unknown' WHEN nc < 1.5 THEN '<1.5x' WHEN nc < 3 THEN '1.5-3x' ELSE '3x+' END AS new_cib,
         ln(price) AS log_price_start, cl AS cib_loose_ratio, nc AS new_cib_ratio
  FROM {name}_at a JOIN {name}_r USING (game_id))"""


BLOCKS["pf"] = _price_blocks("2001-06-01", "pf")
BLOCKS["ps"] = _price_blocks("1998-06-01", "ps")
BLOCKS["sf"] = """sf AS (SELECT game_id, condition, count(*) AS sales_12m FROM li WHERE sale_date > DATE '2000-06-01' AND sale_date <= DATE '2001-06-01' GROUP BY 1, 2)"""
BLOCKS["fac"] = """fac AS (
  SELECT l.game_id, l.condition, l.console, l.rising, l.excess_36m, gf.* EXCLUDE (game_id),
         coalesce(ps.price_bucket, 'unknown') AS price_bucket, coalesce(ps.cib_loose, 'unknown') AS cib_loose, coalesce(ps.new_cib, 'unknown') AS new_cib,
         ps.log_price_start, ps.cib_loose_ratio, ps.new_cib_ratio, coalesce(sf.sales_12m, 0) AS sales_12m,
         CASE WHEN coalesce(sf.sales_12m, 0) <= 0 THEN '0' WHEN sf.sales_12m <= 4 THEN '1-4' WHEN sf.sales_12m <= 14 THEN '5-14' ELSE '15+' END AS liquidity,
         (DATE '1998-06-01' - g.release_date) / 365.25::DOUBLE AS age_years
  FROM lab l LEFT JOIN gf ON gf.game_id = l.game_id LEFT JOIN ps ON ps.game_id = l.game_id AND ps.condition = l.condition
  LEFT JOIN sf ON sf.game_id = l.game_id AND sf.condition = l.condition LEFT JOIN games g ON g.id = l.game_id)"""
CATS = ["platform", "genre", "publisher", "release_era", "lifecycle", "franchise", "kw_ring", "kw_bolt", "kw_gear", "price_bucket", "cib_loose", "new_cib", "liquidity"]
BLOCKS["long"] = "long AS (" + " UNION ALL ".join(f"SELECT game_id, condition, rising, excess_36m, '{c}' AS factor, {c} AS value FROM fac" for c in CATS) + ")"
_WILSON = """(k / n::DOUBLE + 1.96 * 1.96 / 2 / n {sign} 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.96 * 1.96 / 4 / (n::DOUBLE * n))) / (1 + 1.96 * 1.96 / n)"""
LO, HI = (f"CAST({_WILSON.format(sign=s)} AS DOUBLE)" for s in "-+")
BLOCKS["lift"] = f"""base AS (SELECT condition, avg(rising) AS base, count(*) AS labelled FROM fac WHERE rising IS NOT NULL GROUP BY 1 HAVING avg(rising) > 0),
lift0 AS (SELECT condition, factor, value, count(*) AS n, sum(rising) AS k FROM long WHERE rising IS NOT NULL AND NOT (factor LIKE 'kw_%' AND value = 'no') GROUP BY 1, 2, 3 HAVING count(*) >= 5),
lift AS (SELECT l.*, base, k / n AS rate, k / n / base AS lift, {LO} / base AS lift_lo, {HI} / base AS lift_hi FROM lift0 l JOIN base USING (condition))"""
BLOCKS["ex"] = """ex AS (SELECT p.console, p.condition, p.game_id, p.month, p.logp - coalesce(i.level, 0) AS e FROM panel p LEFT JOIN idx i USING (console, condition, month))"""
BLOCKS["curve"] = """cw AS (SELECT *, (month - DATE '1996-11-01') AS days FROM ex WHERE month >= CAST((SELECT max(month) FROM hist) - INTERVAL 60 MONTH AS DATE)),
cs AS (SELECT console, condition, min(month) AS lo, max(month) AS hi FROM cw GROUP BY 1, 2),
cp AS (SELECT w.console, w.condition, w.game_id, (w.month - s.lo) / (s.hi - s.lo)::DOUBLE AS t, w.e AS y FROM cw w JOIN cs s USING (console, condition) WHERE w.e IS NOT NULL),
ck AS (SELECT console, condition, game_id FROM cp GROUP BY 1, 2, 3 HAVING count(*) >= 36),
cg AS (SELECT ck.*, CAST(r.range AS INTEGER) AS pos, r.range / 23.0::DOUBLE AS g FROM ck, range(24) r),
cl AS (SELECT g.console, g.condition, g.game_id, g.pos, g.g, max(p.t) FILTER (p.t <= g.g) AS ta, arg_max(p.y, p.t) FILTER (p.t <= g.g) AS ya,
              min(p.t) FILTER (p.t > g.g) AS tb, arg_min(p.y, p.t) FILTER (p.t > g.g) AS yb
       FROM cg g JOIN cp p USING (console, condition, game_id) GROUP BY 1, 2, 3, 4, 5),
cv AS (SELECT console, condition, game_id, pos, CASE WHEN ya IS NULL THEN yb WHEN yb IS NULL THEN ya ELSE ya + (yb - ya) * (g - ta) / (tb - ta) END AS raw FROM cl),
curve AS (SELECT console, condition, game_id, pos, raw - first_value(raw) OVER (PARTITION BY game_id, condition ORDER BY pos) AS y FROM cv)"""
BLOCKS["shape"] = """sh AS (SELECT console, condition, game_id, list(y ORDER BY pos) AS c FROM curve GROUP BY 1, 2, 3),
shape AS (
  SELECT console, condition, game_id,
    CASE WHEN abs(c[24] - c[1]) < 0.1 AND list_max(c) - list_min(c) < 0.2 THEN 'flat'
         WHEN list_position(c, list_max(c)) - 1 BETWEEN 0.15 * 24 AND 0.85 * 24 AND c[24] < list_max(c) - 0.5 * (list_max(c) - c[1]) AND list_max(c) - c[1] > 0.2 THEN 'spike & fade'
         WHEN c[24] - c[1] <= -0.1 THEN 'decliner'
         WHEN c[24] - c[1] > 0 AND (c[24] - c[17]) / nullif(c[24] - c[1], 0) > 0.6 THEN 'late surge' ELSE 'steady climber' END AS shape
  FROM sh)"""
BLOCKS["feat"] = """gap AS (SELECT console, game_id, month, max(logp) FILTER (condition = 'cib') - max(logp) FILTER (condition = 'loose') AS gap FROM panel WHERE condition IN ('cib', 'loose') GROUP BY 1, 2, 3),
f0 AS (SELECT *, e - lag(e) OVER w AS d, lag(e, 12) OVER w AS e12, lag(e, 3) OVER w AS e3, lead(e, 6) OVER w AS e6 FROM ex WINDOW w AS (PARTITION BY game_id, condition ORDER BY month)),
f1 AS (
  SELECT console, condition, game_id, month, e - e12 AS trend_12m, (e - e3) * 4 - (e - e12) AS acceleration,
         CASE WHEN count(d) OVER y >= 8 THEN stddev_samp(d) OVER y END AS volatility_12m, CASE WHEN count(e) OVER t >= 12 THEN e - max(e) OVER t END AS drawdown_24m, e6 - e AS fwd
  FROM f0 WINDOW y AS (PARTITION BY game_id, condition ORDER BY month ROWS 11 PRECEDING), t AS (PARTITION BY game_id, condition ORDER BY month ROWS 23 PRECEDING)),
feat AS (
  SELECT f.*, a.gap - b.gap AS cib_loose_change_12m FROM f1 f LEFT JOIN gap a ON a.game_id = f.game_id AND a.month = f.month
  LEFT JOIN gap b ON b.game_id = f.game_id AND b.month = CAST(f.month - INTERVAL 12 MONTH AS DATE)
  WHERE coalesce(trend_12m, acceleration, volatility_12m, drawdown_24m, fwd) IS NOT NULL)"""
BLOCKS["brk"] = """bars AS (SELECT condition, quantile_cont(fwd, 0.95::DOUBLE) AS hi, quantile_cont(fwd, 0.5::DOUBLE) AS mid FROM feat WHERE fwd IS NOT NULL GROUP BY 1),
hot AS (SELECT f.console, f.condition, f.game_id, f.month FROM feat f JOIN bars b USING (condition) WHERE f.fwd >= b.hi),
thin AS (
  SELECT console, condition, game_id, min(month) AS month FROM hot GROUP BY 1, 2, 3
  UNION ALL
  SELECT console, condition, game_id, nxt AS month FROM (
    SELECT t.console, t.condition, t.game_id, (SELECT min(h.month) FROM hot h WHERE h.game_id = t.game_id AND h.condition = t.condition AND h.month >= t.month + INTERVAL 12 MONTH) AS nxt FROM thin t) WHERE nxt IS NOT NULL),
pool AS (
  SELECT f.console, f.condition, f.game_id, f.month, row_number() OVER (PARTITION BY f.condition ORDER BY md5(f.game_id || '|' || f.condition || '|' || f.month), f.game_id, f.month) AS nth
  FROM feat f JOIN bars b USING (condition)
  WHERE f.fwd < b.mid AND NOT EXISTS (SELECT 1 FROM thin t WHERE t.game_id = f.game_id AND t.condition = f.condition AND abs(f.month - t.month) <= 372)),
brk AS (
  SELECT console, condition, game_id, month, 1 AS breakout FROM thin
  UNION ALL
  SELECT console, p.condition, game_id, month, 0 FROM pool p JOIN (SELECT condition, count(*) * 3 AS want FROM thin GROUP BY 1) w ON w.condition = p.condition WHERE nth <= want)"""
BLOCKS["sam"] = """s0 AS (
  SELECT p.*, i.level, lag(p.filled, 12) OVER w AS b, lag(i.level, 12) OVER w AS lb, lead(p.filled, 36) OVER w AS a, lead(i.level, 36) OVER w AS la
  FROM panel p LEFT JOIN idx i USING (console, condition, month) WINDOW w AS (PARTITION BY p.game_id, p.condition ORDER BY p.month)),
s1 AS (SELECT *, month AS t0, a - filled - (la - level) AS target FROM s0 WHERE month(month) = 1),
sr AS (
  SELECT h.game_id, t.t0, arg_max(price_cents, h.month) FILTER (condition = 'cib') / (arg_max(price_cents, h.month) FILTER (condition = 'loose'))::DOUBLE AS cl
  FROM hist h JOIN (SELECT DISTINCT t0 FROM s1) t ON h.month <= t.t0 AND h.month >= t.t0 - INTERVAL 2 MONTH WHERE condition IN ('cib', 'loose') GROUP BY 1, 2),
sam AS (
  SELECT s.game_id, s.console, s.condition, s.t0, s.filled AS log_price_t0, s.filled - s.b - (s.level - s.lb) AS momentum_12m, s.target, sr.cl AS cib_loose_ratio,
         (s.t0 - g.release_date) / 365.25::DOUBLE AS age_years, gf.publisher, gf.lifecycle_pos
  FROM s1 s LEFT JOIN sr ON sr.game_id = s.game_id AND sr.t0 = s.t0 LEFT JOIN gf ON gf.game_id = s.game_id LEFT JOIN games g ON g.id = s.game_id
  WHERE s.filled IS NOT NULL AND s.target IS NOT NULL)"""
BLOCKS["now"] = """now_ AS (
  SELECT game_id, arg_max(price_cents, month) FILTER (condition = 'loose') AS loose_cents, arg_max(price_cents, month) FILTER (condition = 'cib') AS cib_cents, arg_max(price_cents, month) FILTER (condition = 'new') AS new_cents FROM prices GROUP BY 1)"""

BLOCKS["pat"] = f"""it AS (SELECT condition, game_id, rising, excess_36m, factor || '=' || value AS item FROM long WHERE rising IS NOT NULL AND value <> 'unknown' AND NOT (factor LIKE 'kw_%' AND value = 'no')),
combo AS (
  SELECT condition, game_id, rising, excess_36m, [item] AS items FROM it
  UNION ALL SELECT a.condition, a.game_id, a.rising, a.excess_36m, [a.item, b.item] FROM it a JOIN it b ON a.game_id = b.game_id AND a.condition = b.condition AND a.item < b.item
  UNION ALL SELECT a.condition, a.game_id, a.rising, a.excess_36m, [a.item, b.item, c.item] FROM it a JOIN it b ON a.game_id = b.game_id AND a.condition = b.condition AND a.item < b.item
  JOIN it c ON a.game_id = c.game_id AND a.condition = c.condition AND b.item < c.item),
pcount AS (SELECT condition, items, count(*) AS n, sum(rising) AS k FROM combo GROUP BY 1, 2 HAVING count(*) >= 5),
pmeas AS (SELECT p.*, base, labelled, k / n AS confidence, k / n / base AS lift, {LO} / base AS lift_lo, {HI} / base AS lift_hi FROM pcount p JOIN base USING (condition)),
risen1 AS (SELECT * FROM pmeas WHERE len(items) = 1),
risen2 AS (SELECT p.* FROM pmeas p WHERE len(items) = 2 AND EXISTS (SELECT 1 FROM risen1 o WHERE o.condition = p.condition AND o.lift >= 1 AND list_contains(p.items, o.items[1]))),
risen3 AS (SELECT p.* FROM pmeas p WHERE len(items) = 3 AND EXISTS (SELECT 1 FROM risen2 o WHERE o.condition = p.condition AND o.lift >= 1 AND list_has_all(p.items, o.items))),
reached AS (FROM risen1 UNION ALL FROM risen2 UNION ALL FROM risen3),
pfound AS (
  SELECT g.* FROM reached g WHERE g.lift >= 1.5
  AND NOT EXISTS (SELECT 1 FROM reached o WHERE o.condition = g.condition AND len(o.items) < len(g.items) AND list_has_all(g.items, o.items) AND g.lift < o.lift + 0.1)
  AND NOT (len(g.items) > 1 AND g.lift < 0.1)),
best5 AS (
  SELECT f.condition, f.items, c.game_id, row_number() OVER (PARTITION BY f.condition, f.items ORDER BY c.excess_36m DESC NULLS LAST, c.game_id) AS nth
  FROM pfound f JOIN combo c ON c.condition = f.condition AND c.items = f.items AND c.rising = 1),
pat AS (
  SELECT f.condition, array_to_string(f.items, ' & ') AS items, CAST(len(f.items) AS INTEGER) AS size, f.n, f.k, f.n / f.labelled AS support, f.confidence, f.lift, f.lift_lo, f.lift_hi,
         coalesce((SELECT string_agg(CAST(b.game_id AS VARCHAR), ',' ORDER BY b.nth) FROM best5 b WHERE b.condition = f.condition AND b.items = f.items AND b.nth <= 5), '') AS examples
  FROM pfound f)"""
BLOCKS["match"] = re.sub(r"\bps\b", "pf", BLOCKS["fac"]).replace("fac AS", "facnow AS") + ",\n" + BLOCKS["long"].replace("long AS", "longnow AS").replace("FROM fac", "FROM facnow") + """,
rule AS (SELECT condition, items, lift_lo, row_number() OVER (PARTITION BY condition ORDER BY lift_lo DESC, items) AS nth FROM pat),
itnow AS (SELECT condition, game_id, list(factor || '=' || value) AS have FROM longnow WHERE value <> 'unknown' AND NOT (factor LIKE 'kw_%' AND value = 'no') GROUP BY 1, 2),
holds AS (SELECT i.condition, i.game_id, u.items, u.lift_lo, u.nth FROM itnow i JOIN rule u ON u.condition = i.condition AND u.lift_lo > 1 AND list_has_all(i.have, string_split(u.items, ' & '))),
match AS (
  SELECT f.condition, f.game_id, coalesce(sum(ln(h.lift_lo) ORDER BY h.nth), 0) AS pattern_score, coalesce(array_to_string(list(h.items ORDER BY h.nth) FILTER (h.nth IS NOT NULL)[1:3], ' | '), '') AS matched
  FROM facnow f LEFT JOIN holds h ON h.condition = f.condition AND h.game_id = f.game_id GROUP BY 1, 2)"""
BLOCKS["watch"] = """watch0 AS (
  SELECT m.*, coalesce((pattern_score - avg(pattern_score) OVER c) / nullif(stddev_pop(pattern_score) OVER c, 0), 0) AS score FROM match m WHERE pattern_score > 0 WINDOW c AS (PARTITION BY condition)),
watch1 AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY round(score, 9) DESC, game_id) AS nth FROM watch0),
watch AS (
  SELECT w.condition, w.game_id, g.name, f.console, (SELECT arg_max(h.price_cents, h.month) FROM hist h WHERE h.game_id = w.game_id AND h.condition = w.condition) AS price_cents, w.score, w.pattern_score,
         CAST(NULL AS DOUBLE) AS model_pred, w.matched, coalesce(f.rising, 0) = 1 AS already_rising, f.genre, f.publisher, f.region, f.platform
  FROM watch1 w JOIN facnow f ON f.condition = w.condition AND f.game_id = w.game_id LEFT JOIN games g ON g.id = w.game_id WHERE w.nth <= 50)"""
_SIGNALS = ["trend_12m", "acceleration", "volatility_12m", "drawdown_24m", "cib_loose_change_12m"]
BLOCKS["cmp"] = "tag AS (" + " UNION ALL ".join(f"SELECT f.condition, b.breakout, '{c}' AS signal, f.{c} AS x FROM brk b JOIN feat f ON f.game_id = b.game_id AND f.condition = b.condition AND f.month = b.month WHERE f.{c} IS NOT NULL" for c in _SIGNALS) + """),
rk AS (SELECT *, rank() OVER (PARTITION BY condition, signal ORDER BY x) + (count(*) OVER (PARTITION BY condition, signal, x) - 1) / 2.0::DOUBLE AS rank FROM tag),
tie AS (SELECT condition, signal, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT condition, signal, x, count(*)::DOUBLE AS t FROM tag GROUP BY 1, 2, 3) GROUP BY 1, 2),
st AS (
  SELECT condition, signal, count(*) FILTER (breakout = 1) AS n1, count(*) FILTER (breakout = 0) AS n0, avg(x) FILTER (breakout = 1) AS m1, avg(x) FILTER (breakout = 0) AS m0,
         var_samp(x) FILTER (breakout = 1) AS v1, var_samp(x) FILTER (breakout = 0) AS v0, sum(rank) FILTER (breakout = 1) AS ranks FROM rk GROUP BY 1, 2),
su AS (SELECT *, ranks - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 * n0 / 2.0::DOUBLE AS mid, (n1 + n0)::DOUBLE AS n FROM st JOIN tie USING (condition, signal) WHERE n1 >= 10 AND n0 >= 10),
cmp AS (
  SELECT condition, signal, n1 AS n_break, n0 AS n_control, m1 AS mean_break, m0 AS mean_control, coalesce((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0), 0) AS d, u,
         coalesce(greatest(abs(u - mid) - 0.5, 0) / nullif(sqrt(n1 * n0 / 12.0::DOUBLE * ((n + 1) - ties / (n * (n - 1)))), 0) * sign(u - mid), 0) AS z FROM su)"""
BLOCKS["titles"] = """titles AS (SELECT *, CASE WHEN id % 3 <> 0 THEN release_date END AS last_detail_at FROM games)"""
BLOCKS["listed"] = """listed AS (
  SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'nes' WHEN 1 THEN 'pal-nes' WHEN 2 THEN 'famicom' ELSE 'other' END AS console, 'part-' || p_partkey AS slug, p_name AS name, CAST(NULL AS VARCHAR) AS image_url,
         CAST(round(p_retailprice * 100) AS BIGINT) AS loose_cents, CASE WHEN p_size % 5 <> 0 THEN CAST(round(p_retailprice * 200) AS BIGINT) END AS cib_cents, CAST(round(p_retailprice * 300) AS BIGINT) AS new_cents FROM part)"""




def _cluster_block(k: int = 5, rounds: int = 20) -> str:
    """Farthest points, then rounds of nearest centers and means, each a table."""
    gap = "round(sum((u.y - b.c) * (u.y - b.c)), 9)"
    key = "console, condition, game_id"
    near = f"SELECT u.console, u.condition, u.game_id, b.k, {gap} AS d FROM curve u JOIN {{}} b ON b.pos = u.pos GROUP BY 1, 2, 3, 4"
    steps = [f"far0 AS (SELECT {key} FROM curve GROUP BY ALL ORDER BY {key} LIMIT 1)", f"cen0 AS (SELECT 0 AS k, pos, y AS c FROM curve JOIN far0 USING ({key}))"]
    for j in range(1, k):
        steps.append(f"far{j} AS (SELECT {key} FROM (SELECT {key}, min(d) AS d FROM ({near.format(f'cen{j - 1}')}) GROUP BY {key}) ORDER BY d DESC, {key} LIMIT 1)")
        steps.append(f"cen{j} AS (SELECT * FROM cen{j - 1} UNION ALL SELECT {j}, pos, y FROM curve JOIN far{j} USING ({key}))")
    at = f"cen{k - 1}"
    own = lambda at: f"SELECT {key}, k FROM ({near.format(at)}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY d, k) = 1"
    for j in range(rounds):
        steps.append(f"own{j} AS ({own(at)})")
        steps.append(f"mid{j} AS (SELECT c.k, c.pos, coalesce(m.c, c.c) AS c FROM {at} c LEFT JOIN (SELECT k, pos, round(avg(y), 9) AS c FROM own{j} JOIN curve USING ({key}) GROUP BY 1, 2) m USING (k, pos))")
        at = f"mid{j}"
    steps.append(f"assigned AS ({own(at)})")
    shape = BLOCKS["shape"][BLOCKS["shape"].index("CASE") : BLOCKS["shape"].index("AS shape")]
    steps.append(f"cshape AS (SELECT k, c, {shape} AS base FROM (SELECT k, list(c ORDER BY pos) AS c FROM {at} GROUP BY 1))")
    steps.append("cname AS (SELECT k, c, CASE WHEN many = 1 THEN base WHEN nth <= 3 THEN ['strong', 'moderate', 'mild'][nth] || ' ' || base ELSE base || ' #' || nth END AS shape FROM (SELECT *, count(*) OVER (PARTITION BY base) AS many, row_number() OVER (PARTITION BY base ORDER BY abs(c[24]) DESC, k) AS nth FROM cshape))")
    steps.append("csum AS (SELECT n.k AS cluster, n.shape, count(*) AS n, count(*) / (SELECT count(*) FROM assigned)::DOUBLE AS share, c[24] AS end_value FROM cname n JOIN assigned a ON a.k = n.k GROUP BY ALL)")
    return ",\n".join(steps)


BLOCKS["clusters"] = _cluster_block()
BLOCKS["profile"] = f"""cl0 AS (SELECT a.k AS cluster, l.factor, l.value FROM assigned a JOIN long l ON l.game_id = a.game_id AND l.condition = a.condition WHERE l.value IS NOT NULL),
clb AS (SELECT cluster, m / sum(m) OVER () AS base FROM (SELECT a.k AS cluster, count(*) AS m FROM assigned a JOIN fac f ON f.game_id = a.game_id AND f.condition = a.condition GROUP BY 1)),
cl1 AS (SELECT cluster, factor, value, count(*)::DOUBLE AS k FROM cl0 WHERE NOT (factor LIKE 'kw_%' AND value = 'no') GROUP BY 1, 2, 3),
cl2 AS (SELECT *, CAST(sum(k) OVER (PARTITION BY factor, value) AS BIGINT) AS n FROM cl1),
cl3 AS (SELECT c.cluster, factor, value, n, k, k / n AS rate, k / n / base AS lift, {LO} / base AS lift_lo, {HI} / base AS lift_hi FROM cl2 c JOIN clb USING (cluster) WHERE n >= 5),
prof AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY lift DESC, factor, value) AS nth FROM cl3 WHERE lift_lo > 1 QUALIFY nth <= 5)"""


def _fit_block(rounds: int = 2, rate: float = 0.3, least: int = 10, bins: int = 8) -> str:
    """Cut points, codes, then two levels of the best split of each node for every round."""
    key = "game_id, condition, t0"
    square = "CAST({0} AS DOUBLE) * CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE)".format
    steps = [
        """ms AS (SELECT game_id, condition, t0, publisher, CAST(round(target * 1000000) AS BIGINT) AS t, round(log_price_t0, 6) AS x2, round(momentum_12m, 6) AS x3, round(age_years, 6) AS x4,
  CAST(t0 + INTERVAL 12 MONTH AS DATE) <= (SELECT max(t0) FROM sam) AS own FROM sam)""",
        f"mx AS (SELECT {key}, own, 2 AS f, x2 AS x FROM ms UNION ALL SELECT {key}, own, 3, x3 FROM ms UNION ALL SELECT {key}, own, 4, x4 FROM ms)",
        "mo AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS p, count(*) OVER (PARTITION BY f) AS n, max(x) OVER (PARTITION BY f) AS most FROM mx WHERE own AND x IS NOT NULL)",
        f"mcut AS (SELECT DISTINCT f, x AS cut FROM mo, range(1, {bins + 1}) j WHERE p = j.range * (n - 1) // {bins} AND x < most)",
        f"""mc AS (SELECT {key}, 0 AS f, CASE WHEN condition IS NULL THEN '' ELSE '=' || condition END AS code FROM ms UNION ALL SELECT {key}, 1, CASE WHEN publisher IS NULL THEN '' ELSE '=' || publisher END FROM ms
  UNION ALL SELECT {key}, x.f, CASE WHEN x IS NULL THEN '000' ELSE printf('%03d', 1 + count(cut)) END FROM mx x LEFT JOIN mcut c ON c.f = x.f AND c.cut < x.x GROUP BY {key}, x.f, x)""",
        f"p0 AS (SELECT {key}, own, t, (SELECT CAST(round(CAST(sum(t) AS DOUBLE) / count(*)) AS BIGINT) FROM ms WHERE own) AS pred FROM ms)",
    ]
    for r in range(rounds):
        at = f"n{r}_0"
        steps.append(f"{at} AS (SELECT *, t - pred AS g, 1 AS node FROM p{r})")
        for level in range(2):
            steps.append(
                f"""h{r}_{level} AS (SELECT node, f, code, count(*) AS n, CAST(sum(g) AS BIGINT) AS s FROM {at} JOIN mc USING ({key}) WHERE own AND node >= {1 << level} GROUP BY 1, 2, 3),
w{r}_{level} AS (SELECT node, f, code, CASE WHEN f < 2 THEN n ELSE sum(n) OVER u END AS nl, CASE WHEN f < 2 THEN s ELSE sum(s) OVER u END AS sl, sum(n) OVER a AS na, sum(s) OVER a AS sa
  FROM h{r}_{level} WINDOW u AS (PARTITION BY node, f ORDER BY code ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, f)),
b{r}_{level} AS (SELECT node, f, code FROM (SELECT *, {square("sl", "nl")} + {square("(sa - sl)", "(na - nl)")} - {square("sa", "na")} AS gain FROM w{r}_{level} WHERE nl >= {least} AND na - nl >= {least})
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, code) = 1),
n{r}_{level + 1} AS (SELECT n.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN n.node WHEN CASE WHEN b.f < 2 THEN c.code = b.code ELSE c.code <= b.code END THEN 2 * n.node ELSE 2 * n.node + 1 END AS node
  FROM {at} n LEFT JOIN b{r}_{level} b ON b.node = n.node LEFT JOIN mc c ON c.f = b.f AND c.game_id = n.game_id AND c.condition = n.condition AND c.t0 = n.t0)"""
            )
            at = f"n{r}_{level + 1}"
        steps.append(f"v{r} AS (SELECT node, CAST(round({rate}::DOUBLE * (CAST(sum(g) AS DOUBLE) / count(*))) AS BIGINT) AS v FROM {at} WHERE own AND node > 1 GROUP BY 1)")
        steps.append(f"p{r + 1} AS (SELECT {key}, own, t, pred + coalesce(v, 0) AS pred FROM {at} LEFT JOIN v{r} USING (node))")
    return ",\n".join(steps)


BLOCKS["fit"] = _fit_block()
HIST = ["li", "prices", "home", "hist"]
INDEX = [*HIST, "rets", "cal", "idx"]
PANEL = [*INDEX, "panel"]
LAB = [*PANEL, "met", "lab"]
FAC = [*LAB, "games", "gf", "ps", "sf", "fac", "long"]
MATCH = [*FAC, "lift", "pat", "pf", "match"]


def _title_words() -> str:
    """The fixed dictionaries, in their order, as regular expressions of DuckDB."""
    from spindrift.operators.factors import FRANCHISES, KEYWORDS
    from spindrift.queries import TITLES

    text = lambda x: "'" + x.replace("'", "''") + "'"
    hit = lambda p: f"regexp_matches(name, {text('(?i)' + p)})"
    named = " ".join(f"WHEN {hit(p)} THEN {text(k)}" for k, p in FRANCHISES.items())
    flags = ", ".join(f"CASE WHEN {hit(p)} THEN 'yes' ELSE 'no' END AS kw_{k}" for k, p in KEYWORDS.items())
    return f"WITH n AS (SELECT p_partkey, [{', '.join(map(text, TITLES))}][p_partkey % {len(TITLES)} + 1] || ' ' || p_name AS name FROM part) SELECT p_partkey, CASE {named} ELSE 'none' END AS franchise, {flags} FROM n"


def sql(blocks: list[str], select: str) -> str:
    head = "WITH RECURSIVE " + ",\n".join(BLOCKS[b] for b in blocks) + "\n" if blocks else ""
    return head + select


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_MET = r("ret_12m", "ret_36m", "ret_60m", "excess_12m", "excess_36m", "excess_60m", "ret_all", "excess_all", "slope_36m", "vol_36m", "max_drawdown", "jump_size")
_GF = "region, platform, genre, publisher, developer, esrb, release_era, lifecycle, franchise, kw_ring, kw_bolt, kw_gear, release_year, round(lifecycle_pos, 6) AS lifecycle_pos"
_PF = "price_bucket, cib_loose, new_cib, " + r("log_price_start", "cib_loose_ratio", "new_cib_ratio")


def _search(order: str, cond: str, where: str = "TRUE") -> str:
    return sql(
        [*LAB, "games", "now"],
        f"""SELECT g.id, g.name, n.loose_cents, n.cib_cents, n.new_cents, round(l.excess_36m, 6) AS excess_36m FROM games g LEFT JOIN lab l ON l.game_id = g.id AND l.condition = '{cond}'
LEFT JOIN now_ n ON n.game_id = g.id WHERE {where} ORDER BY {order}, g.id LIMIT 7 OFFSET 7""",
    )


_COMPARE = """, own AS ({rows}), s0_ AS (SELECT id, min(month) AS f FROM own GROUP BY 1), st AS (SELECT max(f) AS start FROM s0_),
kept AS (SELECT own.* FROM own, st WHERE month >= start), b0 AS (SELECT id, arg_min(price_cents, month) AS c0, arg_min(level, month) AS l0 FROM kept GROUP BY 1)
SELECT k.id, name, console, month, round_even(100 * price_cents / c0::DOUBLE * exp(l0 - level), 3) AS y FROM kept k JOIN b0 USING (id)"""

_RUNS = """SELECT o_custkey AS id, o_orderkey AS number, CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' END AS error FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 ORDER BY id DESC LIMIT {n}"""
ORACLES = {
    "scan_history": sql(HIST, "SELECT * FROM hist"),
    "scan_games": sql(["home", "games"], "SELECT * FROM games"),
    "scan_sales": "SELECT l_suppkey AS game_id, l_returnflag AS condition, CAST(l_shipdate AS DATE) AS sale_date, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents, l_linestatus AS source FROM lineitem",
    "in_filter": sql(HIST, "SELECT * FROM hist WHERE condition IN ('loose', 'cib') AND console IN ('ASIA', 'EUROPE')"),
    "price_cents": "SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part",
    "clean_text": "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS name FROM part",
    "iso_date": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN CAST(date_trunc('month', o_orderdate) AS DATE)
 WHEN 3 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS "day" FROM orders""",
    "bin_cut": """SELECT p_partkey, CASE WHEN p_retailprice * 20 < 0 THEN 'unknown' WHEN p_retailprice * 20 < 2000 THEN '<$20' WHEN p_retailprice * 20 < 10000 THEN '$20-100' WHEN p_retailprice * 20 < 50000 THEN '$100-500' ELSE '$500+' END AS price,
 CASE WHEN p_size <= -1 THEN 'unknown' WHEN p_size <= 0 THEN '0' WHEN p_size <= 4 THEN '1-4' WHEN p_size <= 14 THEN '5-14' ELSE '15+' END AS size FROM part""",
    "like_search": sql(["home", "games"], "SELECT id, name FROM games WHERE contains(lower(name), 'red')"),
    "nocase_sort": sql(["home", "games"], "SELECT id, name FROM games"),
    "split_matched": "SELECT p_partkey, p_name || '/' || p_brand AS parts FROM part",
    "split_ids": "SELECT p_partkey, CASE WHEN p_size = p_partkey THEN p_size::VARCHAR ELSE p_size || ',' || p_partkey END AS ids FROM part",
    "monthly_returns": sql([*HIST, "rets"], "SELECT console, condition, game_id, month, round(ret, 6) AS ret FROM rets"),
    "console_index": sql(INDEX, f"SELECT console, condition, month, n, {r('ret', 'level')} FROM idx"),
    "dense_panel": sql(PANEL, f"SELECT console, condition, game_id, month, {r('logp', 'filled')} FROM panel"),
    "series_metrics": sql([*PANEL, "met"], f'SELECT game_id, console, condition, "asof", {_MET}, obs_36m, n_months, first_month, last_month, jump_month FROM met'),
    "label_rising": sql(LAB, f"SELECT game_id, console, condition, rising, {r('excess_36m')} FROM lab"),
    "agg_top_n": sql(["home", "games", "gf"], "SELECT publisher, count(*) AS n FROM gf GROUP BY 1"),
    "game_factors": sql(["home", "games", "gf"], f"SELECT game_id, {_GF} FROM gf"),
    "title_words": _title_words(),
    "price_at": sql([*HIST, "pf"], "SELECT * FROM pf_at"),
    "price_factors": sql([*HIST, "pf"], f"SELECT game_id, condition, {_PF} FROM pf"),
    "sales_factors": sql(["li", "sf"], "SELECT * FROM sf"),
    "build_factors": sql(FAC, f"SELECT game_id, condition, console, rising, {_GF}, {_PF}, sales_12m, liquidity, {r('excess_36m', 'age_years')} FROM fac"),
    "wilson": f"WITH x AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1) SELECT l_suppkey, n, k, round({LO}, 6) AS lo, round({HI}, 6) AS hi FROM x",
    "factor_lift": sql([*FAC, "lift"], f"SELECT condition, factor, value, n, k, {r('base', 'rate', 'lift', 'lift_lo', 'lift_hi')} FROM lift"),
    "item_matrix": sql(FAC, "SELECT condition, factor || '=' || value AS item, count(*) AS n FROM long WHERE value <> 'unknown' AND NOT (factor LIKE 'kw_%' AND value = 'no') GROUP BY 1, 2"),
    "zscore": "SELECT s_suppkey, round(coalesce((s_acctbal - avg(s_acctbal) OVER w) / nullif(stddev_pop(s_acctbal) OVER w, 0), 0), 6) AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)",
    "curve_matrix": sql([*PANEL, "ex", "curve"], "SELECT console, condition, game_id, pos, round(y, 6) AS y FROM curve"),
    "curve_shapes": sql([*PANEL, "ex", "curve", "shape"], "SELECT * FROM shape"),
    "curve_clusters": sql([*PANEL, "ex", "curve", "clusters"], "SELECT a.console, a.condition, a.game_id, a.k AS cluster, n.shape FROM assigned a JOIN cname n USING (k)"),
    "cluster_summary": sql([*PANEL, "ex", "curve", "clusters"], f"SELECT cluster, shape, n, {r('share', 'end_value')} FROM csum"),
    "cluster_profile": sql([*FAC, "ex", "curve", "clusters", "profile"], f"SELECT cluster, nth, factor, value, n, {r('k', 'rate', 'lift', 'lift_lo', 'lift_hi')} FROM prof"),
    "q_report_clusters": sql(
        [*FAC, "ex", "curve", "clusters", "profile"],
        """SELECT shape, c.n, round(share, 6) AS share, round(exp(end_value) - 1, 6) AS "end", coalesce(string_agg(p.factor || '=' || p.value || ' (' || printf('%.1f', round_even(p.lift, 1)) || '×)', '; ' ORDER BY p.nth), '') AS traits
 FROM csum c LEFT JOIN prof p ON p.cluster = c.cluster GROUP BY 1, 2, 3, 4""",
    ),
    "q_report_index": sql(INDEX, "SELECT condition, console, string_agg(CAST(month AS VARCHAR), ',' ORDER BY month) AS x, string_agg(format('{:,.1f}', round_even((exp(level) - 1) * 100, 1)), ' ' ORDER BY month) AS y FROM idx GROUP BY 1, 2"),
    "q_report_bars": sql(
        [*FAC, "lift"],
        """SELECT condition, CAST(row_number() OVER (PARTITION BY condition ORDER BY nth DESC) - 1 AS INTEGER) AS pos, factor || '=' || value AS label, round_even(l, 3) AS lift, round_even(lift_lo, 3) AS lo, round_even(lift_hi, 3) AS hi, n
 FROM (SELECT condition, factor, value, n, lift.lift AS l, lift_lo, lift_hi, row_number() OVER (PARTITION BY condition ORDER BY lift.lift DESC, factor, value) AS nth FROM lift WHERE lift_lo > 1 QUALIFY nth <= 15)""",
    ),
    "stored_upsert": """WITH s AS (SELECT DISTINCT l_suppkey AS game_id, l_returnflag AS condition, l_orderkey || '-' || l_linenumber || '-' || CAST(l_shipdate AS DATE) || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS sale_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_shipdate AS DATE) AS day FROM lineitem)
 SELECT game_id, condition, sale_id, c + CASE WHEN c % 5 = 0 AND game_id % 3 = 0 THEN 1 ELSE 0 END AS price_cents, c AS before_cents, day AS first_seen_at FROM s""",
    "stored_runs": "SELECT row_number() OVER (ORDER BY n_nationkey) AS id, n_name AS nation, CAST(n_nationkey AS BIGINT) AS ok, CASE WHEN n_nationkey % 5 = 0 THEN 'timeout' END AS error FROM nation",
    "pre_features": sql([*PANEL, "ex", "feat"], f"SELECT console, condition, game_id, month, {r('trend_12m', 'acceleration', 'volatility_12m', 'drawdown_24m', 'fwd', 'cib_loose_change_12m')} FROM feat"),
    "breakouts": sql([*PANEL, "ex", "feat", "brk"], "SELECT * FROM brk"),
    "samples": sql([*PANEL, "games", "gf", "sam"], f"SELECT game_id, console, condition, t0, publisher, {r('log_price_t0', 'momentum_12m', 'target', 'cib_loose_ratio', 'age_years', 'lifecycle_pos')} FROM sam"),
    "split_by_time": sql(
        [*PANEL, "games", "gf", "sam"],
        """, lastp AS (SELECT min(t0) AS f FROM (SELECT DISTINCT t0 FROM sam ORDER BY t0 DESC LIMIT 2))
SELECT CASE WHEN t0 >= f THEN 'test' ELSE 'train' END AS part, t0, count(*) AS n FROM sam, lastp WHERE t0 >= f OR t0 + INTERVAL 36 MONTH <= f GROUP BY 1, 2""",
    ),
    "spearman_rank": """WITH a AS (SELECT p_size, p_retailprice, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS rb FROM part) SELECT round(corr(ra, rb), 6) AS rho, round(sum(ra), 6) AS sum_ra FROM a""",
    "q_coverage": sql(
        ["li", "prices", "home", "games"],
        """SELECT console, min(platform) AS platform, min(region) AS region, count(*) AS listed, count(*) FILTER (id % 3 <> 0) AS fetched,
 count(*) FILTER (id % 3 <> 0 AND release_date < TIMESTAMP '2001-10-01 00:00:00' - INTERVAL 365 DAY) AS stale, count(*) FILTER (id % 3 = 0 OR release_date IS NULL) AS never,
 count(*) FILTER (id IN (SELECT game_id FROM prices)) AS with_history, max(release_date) AS last_list_at, max(release_date) FILTER (id % 3 <> 0) AS last_detail_at FROM games GROUP BY 1""",
    ),
    "q_facets": sql(["home", "games"], " UNION ".join(f"SELECT '{c}' AS facet, {c} AS value FROM games WHERE {c} IS NOT NULL" for c in ("console", "platform", "region", "genre"))),
    "q_search_price": _search("n.loose_cents DESC NULLS LAST", "loose"),
    "q_search_rank": _search("g.list_rank ASC NULLS LAST", "cib"),
    "q_search_name": _search("lower(g.name)", "loose", "contains(lower(g.name), 'e')"),
    "q_search_excess": _search("l.excess_36m DESC NULLS LAST", "new"),
    "q_game": sql(["li", "prices", "home", "games", "now"], "SELECT g.*, n.* EXCLUDE (game_id) FROM games g LEFT JOIN now_ n ON n.game_id = g.id WHERE g.id = 7"),
    "q_history": sql(["li", "prices"], "SELECT condition, month, price_cents FROM prices WHERE game_id = 7"),
    "q_history_table": sql(["li", "prices"], "SELECT month, max(price_cents) FILTER (condition = 'loose') AS loose, max(price_cents) FILTER (condition = 'cib') AS cib, max(price_cents) FILTER (condition = 'new') AS new FROM prices WHERE game_id = 7 GROUP BY 1"),
    "q_sales": sql(["li"], "SELECT game_id, condition, sale_date, CAST(round(price * 100) AS BIGINT) AS price_cents FROM li WHERE game_id = 7 ORDER BY sale_date DESC, condition, 4 LIMIT 60"),
    "q_game_analysis": sql([*LAB, "ex", "curve", "shape"], f"SELECT l.game_id, l.condition, {r('ret_36m', 'excess_36m')}, rising, shape FROM lab l LEFT JOIN shape s ON s.game_id = l.game_id AND s.condition = l.condition WHERE l.game_id = 7"),
    "q_rebased_index": sql(
        INDEX,
        """, o AS (SELECT condition, min(month) AS lo, max(month) AS hi, arg_min(price_cents, month) AS c FROM prices WHERE game_id = 7 GROUP BY 1), v AS (SELECT i.* FROM idx i JOIN home h ON h.console = i.console AND h.id = 7)
SELECT v.condition, v.month, round_even(o.c / 100.0::DOUBLE * exp(v.level - b.level), 2) AS y FROM v JOIN o ON o.condition = v.condition AND v.month BETWEEN o.lo AND o.hi JOIN v b ON b.condition = v.condition AND b.month = o.lo""",
    ),
    "q_console_index": sql(INDEX, "SELECT condition, month, round_even((exp(level) - 1) * 100, 1) AS y FROM idx WHERE console = 'ASIA'"),
    "q_movers": sql([*LAB, "games", "now"], f"SELECT g.id, g.name, g.console, g.genre, {r('excess_36m', 'ret_36m')}, rising, n.loose_cents AS price_cents FROM lab l JOIN games g ON g.id = l.game_id LEFT JOIN now_ n ON n.game_id = g.id WHERE l.console = 'EUROPE' AND l.condition = 'loose' AND excess_36m IS NOT NULL ORDER BY l.excess_36m DESC, g.id LIMIT 15"),
    "q_compare_raw": sql(["li", "prices", "home", "games"], "SELECT g.id, g.name, g.console, p.month, p.price_cents / 100.0::DOUBLE AS y FROM prices p JOIN games g ON g.id = p.game_id WHERE g.id IN (3, 7, 9) AND p.condition = 'loose'"),
    "q_compare_rebased": sql(["li", "prices", "home", "games"], _COMPARE.format(rows="SELECT g.id, g.name, g.console, p.month, p.price_cents, 0.0::DOUBLE AS level FROM prices p JOIN games g ON g.id = p.game_id WHERE g.id IN (3, 7, 9) AND p.condition = 'loose'")),
    "q_compare_index": sql([*INDEX, "games"], _COMPARE.format(rows="SELECT g.id, g.name, g.console, p.month, p.price_cents, i.level FROM prices p JOIN games g ON g.id = p.game_id JOIN idx i ON i.console = g.console AND i.condition = p.condition AND i.month = p.month WHERE g.id IN (3, 7, 9) AND p.condition = 'loose'")),
    "q_report_factors": sql([*FAC, "lift"], f"SELECT condition, factor, value, n, {r('lift')}, row_number() OVER (PARTITION BY condition ORDER BY lift.lift DESC, factor, value) AS nth FROM lift WHERE lift_lo > 1 QUALIFY nth <= 15"),
    "q_healthz": sql(["home", "games"], "SELECT count(*) AS games FROM games"),
    "deadlines": """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE)::TIMESTAMP AS day, CAST(o_orderkey % 24 AS INTEGER) * 60 + CAST(o_custkey % 60 AS INTEGER) AS m FROM orders)
 SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(day + to_minutes(m) + CASE WHEN m > 720 THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END, '%Y-%m-%d %H:%M') END AS ends FROM x""",
    "usd_percent": """SELECT c_custkey, '$' || format('{:,.2f}', round(c_acctbal * 100) / 100) AS usd,
 CASE WHEN round_even(c_acctbal / 10000 * 100, 0) > 0 THEN '+' WHEN round_even(c_acctbal / 10000 * 100, 0) < 0 THEN '−' ELSE '' END || CAST(abs(CAST(round_even(c_acctbal / 10000 * 100, 0) AS BIGINT)) AS VARCHAR) || '%' AS pct FROM customer""",
    "patterns": sql([*FAC, "lift", "pat"], f"SELECT condition, items, size, n, k, {r('support', 'confidence', 'lift', 'lift_lo', 'lift_hi')}, examples FROM pat"),
    "match_patterns": sql([*MATCH], f"SELECT condition, game_id, {r('pattern_score')}, matched FROM match"),
    "watchlist_pattern": sql([*MATCH, "watch"], f"SELECT condition, game_id, name, console, price_cents, {r('score', 'pattern_score')}, model_pred, matched, already_rising, genre, publisher, region, platform FROM watch"),
    "q_watchlist": sql([*MATCH, "watch"], "SELECT game_id, name, console, round(score, 6) AS score, replace(matched, ' | ', ';') AS patterns FROM watch WHERE condition = 'cib'"),
    "q_watchlist_consoles": sql([*MATCH, "watch"], "SELECT DISTINCT console FROM watch"),
    "q_report_patterns": sql([*FAC, "lift", "pat"], """, first AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY lift_lo DESC, items) AS nth FROM pat QUALIFY nth <= 20),
each AS (SELECT condition, nth, unnest(string_split(examples, ',')) AS one, unnest(range(len(string_split(examples, ',')))) AS place FROM first),
shown AS (SELECT condition, nth, string_agg(g.name || ' (' || g.console || ')', '; ' ORDER BY place) AS names FROM each JOIN games g ON CAST(g.id AS VARCHAR) = one WHERE g.name IS NOT NULL GROUP BY 1, 2)
SELECT f.condition, CAST(f.nth AS INTEGER) AS nth, items, round(f.lift, 6) AS lift, names FROM first f LEFT JOIN shown s ON s.condition = f.condition AND s.nth = f.nth"""),
    "q_report_signals": sql([*PANEL, "ex", "feat", "brk", "cmp"], "SELECT condition, signal, row_number() OVER (PARTITION BY condition ORDER BY abs(d) DESC, signal) AS nth, round(d, 6) AS d FROM cmp"),
    "q_names": sql([*FAC, "lift", "pat"], """, each AS (SELECT condition || '|' || items AS key, unnest(string_split(examples, ',')) AS one, unnest(range(len(string_split(examples, ',')))) AS nth FROM pat)
SELECT key, string_agg(g.name || ' (' || g.console || ')', '; ' ORDER BY nth) AS names FROM each JOIN games g ON CAST(g.id AS VARCHAR) = one WHERE g.name IS NOT NULL GROUP BY 1"""),
    "compare_signals": sql([*PANEL, "ex", "feat", "brk", "cmp"], f"SELECT condition, signal, n_break, n_control, {r('mean_break', 'mean_control', 'd', 'u', 'z')} FROM cmp"),
    "model_fit": sql([*PANEL, "games", "gf", "sam", "fit"], "SELECT game_id, condition, t0, round(pred / 1000000.0::DOUBLE, 6) AS prediction FROM p2"),
    "model_metrics": sql([*PANEL, "games", "gf", "sam"], """, p AS (SELECT condition, target, momentum_12m AS x FROM sam WHERE momentum_12m IS NOT NULL),
ra AS (SELECT *, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS b, avg(target) OVER () AS m FROM p),
q AS (SELECT condition, quantile_cont(target, 0.8::DOUBLE) AS qt, quantile_cont(x, 0.8::DOUBLE) AS qx FROM p GROUP BY 1 HAVING count(*) >= 25),
s AS (SELECT condition, avg((target >= qt)::DOUBLE) AS share FROM p JOIN q USING (condition) WHERE x >= qx GROUP BY 1)
SELECT round(corr(a, b), 6) AS spearman, round(1 - sum((target - x) ** 2) / sum((target - m) ** 2), 6) AS r2, round((SELECT avg(share) FROM s), 6) AS top_quintile_precision FROM ra"""),
    "list_products": sql(["listed"], "SELECT * FROM listed"),
    "chart_points": sql(["li", "prices"], "SELECT game_id, condition, month, price_cents FROM prices WHERE price_cents <> 0"),
    "sale_ids": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'ebay-' || o_orderkey ELSE 'h-' || substr(sha1(CAST(o_orderdate AS DATE) || '|' || o_orderpriority || '|' || CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) ELSE 'None' END), 1, 16) END AS sale_id FROM orders""",
    "detail_pages": """SELECT p_partkey AS game_id, p_partkey AS pc_id, p_type AS genre, CAST(DATE '1990-01-01' + CAST(p_size AS INTEGER) AS DATE) AS release_date, p_brand || ' & ' || p_name AS publisher,
 CASE WHEN p_size % 3 <> 0 THEN 'Teen' END AS esrb, CAST(p_partkey AS VARCHAR) AS upc, CAST(NULL AS VARCHAR) AS asin, CAST(round(p_retailprice * 100) AS BIGINT) AS loose_cents,
 CASE WHEN p_size % 5 <> 0 THEN CAST(round(p_retailprice * 200) AS BIGINT) END AS cib_cents, CAST(NULL AS BIGINT) AS new_cents FROM part""",
    "detail_sales": """SELECT l_partkey AS game_id, CASE l_returnflag WHEN 'A' THEN 'loose' WHEN 'N' THEN 'cib' ELSE 'new' END AS condition,
 CASE WHEN l_orderkey % 2 = 0 THEN 'ebay-' || l_orderkey || '-' || l_linenumber ELSE 'h-' || substr(sha1(CAST(l_shipdate AS DATE) || '|Lot ' || l_orderkey || CASE WHEN l_linenumber % 6 = 0 THEN ' [Shop]' ELSE '' END || '|' || CAST(round(l_extendedprice * 100) AS BIGINT)), 1, 16) END AS sale_id,
 CAST(l_shipdate AS DATE) AS sale_date, 'Lot ' || l_orderkey || CASE WHEN l_linenumber % 6 = 0 THEN ' [Shop]' ELSE '' END AS title, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
 CASE WHEN l_orderkey % 2 = 0 THEN 'ebay' WHEN l_linenumber % 2 = 0 THEN 'shop' ELSE 'private' END AS source, CASE WHEN l_linenumber % 3 <> 0 THEN '/lot/' || l_orderkey END AS url
 FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "import_sqlite": sql(["li", "prices"], "SELECT game_id, condition, month, price_cents FROM prices"),
    "migrate_backfill": """WITH x AS (SELECT p_partkey AS id, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'nes' WHEN 1 THEN 'pal-nes' WHEN 2 THEN 'jp-wii' ELSE 'other' END AS console,
 CASE WHEN p_size % 3 = 0 THEN 'kept' END AS p, CASE WHEN p_size % 6 = 0 THEN 'pal' END AS r FROM part)
 SELECT id, console, CASE WHEN console <> 'other' AND r IS NULL THEN CASE console WHEN 'jp-wii' THEN 'wii' ELSE 'nes' END ELSE p END AS platform,
 CASE WHEN console <> 'other' AND r IS NULL THEN CASE console WHEN 'nes' THEN 'ntsc-u' WHEN 'pal-nes' THEN 'pal' ELSE 'ntsc-j' END ELSE r END AS region, name, CAST(NULL AS VARCHAR) AS genre FROM x""",
    "upsert_games": sql(["home", "games", "titles", "listed"], """SELECT coalesce(l.id, g.id) AS id, CASE WHEN l.id IS NOT NULL THEN l.console ELSE g.console END AS console,
 CASE WHEN l.id IS NULL THEN g.platform WHEN l.console <> 'other' THEN 'nes' END AS platform, CASE WHEN l.id IS NULL THEN g.region WHEN l.console = 'nes' THEN 'ntsc-u' WHEN l.console = 'pal-nes' THEN 'pal' WHEN l.console = 'famicom' THEN 'ntsc-j' END AS region,
 CASE WHEN l.id IS NOT NULL THEN l.slug ELSE g.slug END AS slug, CASE WHEN l.id IS NOT NULL THEN l.name ELSE g.name END AS name, g.genre, g.publisher, g.release_date, CAST(CASE WHEN l.id IS NOT NULL THEN 1 ELSE g.list_rank END AS INTEGER) AS list_rank,
 CASE WHEN g.id IS NOT NULL THEN DATE '2001-01-01' ELSE DATE '2001-10-01' END AS first_seen_at, CASE WHEN l.id IS NOT NULL THEN DATE '2001-10-01' END AS last_list_at, g.last_detail_at FROM titles g FULL JOIN listed l ON l.id = g.id"""),
    "upsert_snapshots": sql(["listed"], """SELECT id AS game_id, DATE '2001-10-01' AS captured_on, 'list' AS source, loose_cents + CASE WHEN contains(name, 'red') THEN 100 ELSE 0 END AS loose_cents, cib_cents, new_cents FROM listed
 UNION ALL SELECT id, DATE '2001-10-02', 'list', loose_cents, cib_cents, new_cents FROM listed"""),
    "upsert_detail": sql(["home", "games", "titles"], """SELECT g.id, g.name, CASE WHEN o.c IS NOT NULL THEN o.genre ELSE g.genre END AS genre, CASE WHEN o.c IS NOT NULL THEN o.publisher ELSE g.publisher END AS publisher, CASE WHEN o.c IS NULL THEN g.release_date END AS release_date,
 CASE WHEN o.c IS NOT NULL THEN DATE '2001-10-01' ELSE g.last_detail_at END AS last_detail_at FROM titles g LEFT JOIN (SELECT o_custkey AS c, o_orderpriority AS genre, CAST(o_orderkey AS VARCHAR) AS publisher FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1) o ON o.c = g.id"""),
    "quarantine": "WITH x AS (SELECT p_partkey AS game_id, CASE WHEN p_size % 3 <> 0 THEN p_partkey + (p_size % 5 = 0)::INT END AS pc_id FROM part) SELECT game_id, pc_id, NOT (pc_id IS NOT NULL AND pc_id <> game_id) AS accepted FROM x",
    "games_due": sql(["home", "games", "titles"], "SELECT id, CAST(list_rank AS INTEGER) AS list_rank, last_detail_at FROM titles WHERE last_detail_at IS NULL OR last_detail_at < TIMESTAMP '2001-10-01 00:00:00' - INTERVAL 1500 DAY"),
    "list_fresh": "SELECT DISTINCT o_orderpriority || '-' || (o_custkey % 50) AS console FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 4 > 0 AND o_orderdate > TIMESTAMP '1995-06-01 00:00:00' - INTERVAL 200 DAY",
    "run_log": """SELECT o_custkey AS id, o_orderkey AS number, CASE WHEN o_orderstatus = 'F' THEN 'list' ELSE 'detail' END AS stage, o_orderkey % 4 AS ok, CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' END AS error FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "q_recent_runs": _RUNS.format(n=20),
    "q_last_analysis": _RUNS.format(n=1),
    "q_coverage_totals": sql(["li", "prices", "home", "games"], """SELECT CAST(count(*) AS BIGINT) AS listed, count(*) FILTER (id % 3 <> 0 AND release_date IS NOT NULL) AS fetched,
 count(*) FILTER (id % 3 <> 0 AND release_date < TIMESTAMP '2001-10-01 00:00:00' - INTERVAL 365 DAY) AS stale, count(*) FILTER (id % 3 = 0 OR release_date IS NULL) AS never,
 count(*) FILTER (id IN (SELECT game_id FROM prices)) AS with_history FROM games"""),
    "q_latest_prices": sql(["li", "prices", "listed"], """, m AS (SELECT game_id, arg_max(price_cents, month) FILTER (condition = 'loose') AS loose_cents, arg_max(price_cents, month) FILTER (condition = 'cib') AS cib_cents, arg_max(price_cents, month) FILTER (condition = 'new') AS new_cents FROM prices GROUP BY 1)
SELECT coalesce(l.id, m.game_id) AS game_id, coalesce(CASE WHEN l.id % 3 = 0 THEN l.loose_cents + 5 ELSE l.loose_cents END, m.loose_cents) AS loose_cents,
 coalesce(CASE WHEN l.id % 2 = 0 THEN l.cib_cents END, CASE WHEN l.id IS NOT NULL THEN 77 END, m.cib_cents) AS cib_cents, coalesce(l.new_cents, m.new_cents) AS new_cents FROM listed l FULL JOIN m ON m.game_id = l.id"""),
}
