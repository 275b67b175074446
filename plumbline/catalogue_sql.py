"""SQL that gives the rows of the catalogue's queries on the same tables."""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + 1.2345e-8, {digits})"


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def corr(x: str, y: str) -> str:
    return f"regr_sxy({y}, {x}) / sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x}))"


LONG = union(f"SELECT '{n}' AS \"column\", {n}::DOUBLE AS v FROM lineitem" for n in NUMS)

RAW = """CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN ' N/A ' WHEN 2 THEN '$' || p WHEN 3 THEN '  ' || p || ' ' WHEN 4 THEN p || '%'
 WHEN 5 THEN p || 'kg' WHEN 6 THEN '1,234.50' WHEN 7 THEN '-' ELSE p END"""
DIRTY = f"""SELECT o_orderkey, {RAW} AS raw FROM (
 SELECT o_orderkey, (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS p FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders))"""
TOKENS = "('', 'na', 'n/a', 'n.a.', '#n/a', '#na', 'nan', 'null', 'none', 'nil', '-', '--', '?', 'missing', 'unknown')"
GATE = r"[+-]?(NT\$|[$¥€£])?\s*[+-]?((\d{1,3}(,\d{3})+|\d+)(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*%?"
CASTED = f"""SELECT o_orderkey, raw, lower(trim(raw)) IN {TOKENS} AS token,
 CASE WHEN lower(trim(raw)) NOT IN {TOKENS} AND regexp_full_match(trim(raw), '{GATE}') THEN try_cast(regexp_replace(trim(raw), '[$,%]', '', 'g') AS DOUBLE) END AS value FROM ({DIRTY})"""

SPIKED = "SELECT CASE WHEN event_id % 97 = 0 THEN 99999.0 ELSE value END AS v FROM events"
SCALE = f"""s AS (SELECT count(*) AS n, median(v) AS med, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v),
m AS (SELECT s.*, median(abs(v - med)) AS mad, max(abs(v - med)) AS far FROM v, s GROUP BY ALL),
cand AS (SELECT v AS value, count(*) AS n, any_value(m.n) AS n_all, any_value(q1) AS q1, any_value(q3) AS q3, any_value(mad) AS mad
 FROM v, m WHERE abs(v - med) / (1.4826 * mad) > 10 GROUP BY v),
sig AS (SELECT value, n, n >= 2 AND n >= 0.002 * n_all AS repeated, abs(value) IN (999, 9999, 99999, 999999) AS pattern,
 abs(value) >= 100 * greatest(abs(q1), abs(q3), 1.4826 * mad) AS scale FROM cand),
sus AS (SELECT *, repeated::INT + pattern::INT + scale::INT >= 2 AS suspected FROM sig)"""


def moments(table: str, level: str, num: str, cat: str) -> str:
    return f"SELECT '{cat}' AS cat, '{num}' AS num, ({level})::VARCHAR AS level, count({num}) AS n, avg({num}) AS mean, regr_sxx({num}, {num}) AS m2 FROM {table} WHERE ({level}) IS NOT NULL GROUP BY ({level})"


def effects(parts: str, first: str = "cat") -> str:
    return f"""WITH m AS ({parts}),
g AS (SELECT *, sum(n * mean) OVER (PARTITION BY cat, num) / sum(n) OVER (PARTITION BY cat, num) AS grand FROM m),
e AS (SELECT cat, num, count(*) AS k, sum(n)::BIGINT AS n, min(n) AS n_min, sum(n * (mean - grand) ** 2) AS ssb, sum(m2) AS ssw FROM g GROUP BY cat, num)
SELECT cat AS {first}, num, k AS n_groups, n AS n_total, n_min, {r('greatest(0, 1 - (ssw / (n - k)) / ((ssb + ssw) / (n - 1)))')} AS eta_squared,
 {r('(ssb / (k - 1)) / (ssw / (n - k))', 4)} AS f_stat FROM e"""


def ranked(name: str) -> str:
    return f"rank() OVER (ORDER BY {name}) + (count(*) OVER (PARTITION BY {name}) - 1) / 2.0"


def spearman(source: str, names: list[str], extra: str = "") -> str:
    ranks = ", ".join(f"{ranked(n)} AS {n}" for n in names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return f"WITH x AS (SELECT {ranks} FROM ({source})) " + union(f"SELECT '{a}' AS a, '{b}' AS b, {r(corr(a, b))} AS r, count(*) AS n{extra.format(c=corr(a, b))} FROM x" for a, b in pairs)


def per_group(group: str, pairs) -> str:
    return union(
        f"SELECT '{x}' AS x, '{y}' AS y, {group} AS level, count(*) AS n, CASE WHEN count(*) >= 30 THEN {corr(x, y)} END AS corr, CASE WHEN count(*) >= 30 THEN regr_slope({y}, {x}) END AS slope FROM lineitem GROUP BY {group}"
        for x, y in pairs
    )


def spread(group: str, pairs) -> str:
    return f"SELECT x, y, count(*) AS n_groups, {r('max(corr) - min(corr)', 5)} AS spread, min(n) AS n_min FROM ({per_group(group, pairs)}) GROUP BY x, y"


def dispersion(source: str) -> str:
    return f"""WITH d AS ({source}), mid AS (SELECT level, median(v) AS mid, min(v) AS lo, max(v) AS hi FROM d GROUP BY level),
x AS (SELECT d.level, v, abs(v - mid) AS dev, lo, hi, 0.1 * (hi - lo) AS w FROM d JOIN mid USING (level))
SELECT level, count(*) AS n, {r('stddev_samp(v)', 5)} AS std, {r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 5)} AS iqr, {r('median(dev)', 5)} AS mad,
 {r('min(lo)', 5)} AS lo, {r('max(hi)', 5)} AS hi, {r('sum(dev)', 3)} AS dev_sum, {r('regr_sxx(dev, dev)', 3)} AS dev_m2,
 count(*) FILTER (WHERE v >= hi - w) AS top_edge, count(*) FILTER (WHERE v <= lo + w) AS bottom_edge FROM x GROUP BY level"""


def hist(table: str, x: str, k: str, digits: int = 3, group: str | None = None) -> str:
    keys, join = ("series, bin", "USING (series, bin)") if group else ("bin", "USING (bin)")
    grid = "CROSS JOIN (SELECT DISTINCT series FROM c)" if group else ""
    return f"""WITH e AS (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi, ({k})::BIGINT AS k FROM {table}),
w AS (SELECT *, (hi - lo) / k AS w FROM e),
c AS (SELECT {f'{group} AS series, ' if group else ''}least(greatest(floor(({x} - lo) / w), 0), k - 1)::BIGINT AS bin, count(*) AS n FROM {table}, w GROUP BY ALL),
g AS (SELECT lo, hi, k, w, unnest(range(k)) AS bin FROM w)
SELECT {keys}, {r('lo + bin * w', digits)} AS lo, {r('CASE WHEN bin = k - 1 THEN hi ELSE lo + (bin + 1) * w END', digits)} AS hi, coalesce(n, 0)::BIGINT AS n
FROM g {grid} LEFT JOIN c {join}"""


def bars(table: str, x: str, value: str, size: str, top: int) -> str:
    return f"""b AS (SELECT {x} AS category, {value} AS v FROM {table} GROUP BY {x}),
t AS (SELECT category, row_number() OVER (ORDER BY {size} DESC, category) AS rank FROM b QUALIFY rank <= {top})"""


GROUP_PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]
LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax"
PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1 :]]
FORMS = []
_P = ["l_extendedprice", "l_discount", "l_tax"]
for _i, _a in enumerate(_P):
    for _b in _P[_i + 1 :]:
        FORMS += [("product", (_a, _b), f"{_a} * {_b}"), ("sum", (_a, _b), f"{_a} + {_b}")]
    for _b in _P:
        if _a != _b:
            FORMS += [("difference", (_a, _b), f"{_a} - {_b}"), ("ratio", (_a, _b), f"{_a} / nullif({_b}, 0)"), ("discounted", (_a, _b), f"{_a} * (1 - {_b})")]
FORMS += [("triple_product", tuple(_P), " * ".join(_P))]
for _c in _P:
    _a, _b = [p for p in _P if p != _c]
    FORMS += [("discounted_product", (_a, _b, _c), f"{_a} * {_b} * (1 - {_c})")]

SQL: dict[str, str] = {
    "profile_numeric": f"""WITH l AS ({LONG}), o AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY "column") AS n FROM l),
m AS (SELECT "column", avg(v) AS mu FROM l GROUP BY 1)
SELECT "column", count(*) AS n, {r('min(v)', 5)} AS min, {r('max(v)', 5)} AS max, {r('avg(v)', 5)} AS mean, {r('median(v)', 5)} AS median, {r('stddev_samp(v)', 5)} AS std,
 {r('min(v) FILTER (WHERE i = floor((n - 1) * 0.25 + 0.5))', 5)} AS q25, {r('min(v) FILTER (WHERE i = floor((n - 1) * 0.75 + 0.5))', 5)} AS q75,
 {r('avg((v - mu) ** 3) / avg((v - mu) ** 2) ** 1.5', 4)} AS skew FROM o JOIN m USING ("column") GROUP BY "column" """,
    "profile_categorical_topk": """SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS i FROM (
 SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)) WHERE i <= 10""",
    "profile_category_lists": union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_categories, string_agg(DISTINCT {c}::VARCHAR, '|' ORDER BY {c}::VARCHAR) AS labels FROM lineitem" for c in CATS),
    "profile_datetime_frequency": f"""WITH d AS (SELECT DISTINCT o_orderdate::TIMESTAMP AS t FROM orders), g AS (SELECT t, epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t)) AS us FROM d),
x AS (SELECT min(t) AS a, max(t) AS b, count(*) AS n, median(us) / 8.64e10 AS g FROM g)
SELECT a::VARCHAR AS first, b::VARCHAR AS last, n AS n_distinct, {r('g')} AS median_gap, CASE WHEN n < 3 THEN 'unknown' WHEN g BETWEEN 0.9 AND 1.1 THEN 'daily' WHEN g BETWEEN 6.5 AND 7.5 THEN 'weekly'
 WHEN g BETWEEN 27 AND 32 THEN 'monthly' ELSE 'irregular' END AS frequency FROM x""",
    "profile_text_lengths": union(f"SELECT '{c}' AS \"column\", count(*) AS n, {r(f'avg(length({c}))')} AS mean_length, max(length({c}))::BIGINT AS max_length FROM documents" for c in ("text", "source")),
    "quality_counts": f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE raw IS NULL) AS missing, count(*) FILTER (WHERE token) AS tokens,
 count(*) FILTER (WHERE raw IS NOT NULL AND NOT token AND value IS NULL) AS invalid, count(value) AS valid, {r('count(value) / count(*)')} AS valid_ratio FROM ({CASTED})""",
    "cast_replay_numeric": f"SELECT o_orderkey, value FROM ({CASTED})",
    "cast_replay_datetime": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP::VARCHAR END AS value FROM orders",
    "robust_fences": f"""WITH v AS ({SPIKED}), {SCALE}, c AS (SELECT v FROM v WHERE v NOT IN (SELECT value FROM sus WHERE suspected)),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(*) AS nc, min(v) AS lo, max(v) AS hi FROM c),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 3 * (q3 - q1) AS a, q3 + 3 * (q3 - q1) AS b FROM q)
SELECT n, {r('med')} AS median, {r('mad')} AS mad, {r('far / (1.4826 * mad)')} AS robust_z_max, {r('f.q1')} AS q1, {r('f.q3')} AS q3, {r('iqr')} AS iqr,
 (SELECT count(*) FROM c WHERE v < a OR v > b) AS extreme_count, n - nc AS sentinel_rows, {r('greatest(lo, a)')} AS range_lo, {r('least(hi, b)')} AS range_hi FROM m, f""",
    "sentinel_candidates": f"WITH v AS ({SPIKED}), {SCALE} SELECT value::DOUBLE AS value, n, repeated, pattern, scale, suspected FROM sus",
    "scan_csv": "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY s_nationkey",
    "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 50",
    "pearson_matrix": union(f"SELECT '{a}' AS a, '{b}' AS b, {r(corr(a, b))} AS r, regr_count({a}, {b})::BIGINT AS n FROM lineitem" for a, b in PAIRS),
    "spearman_matrix": spearman("SELECT * FROM lineitem", NUMS),
    "average_rank": f"SELECT p_partkey, ({ranked('p_size')})::DOUBLE AS rank FROM part",
    "lag1_autocorr": f"WITH x AS (SELECT value AS v, lag(value) OVER (ORDER BY ts, event_id) AS b FROM events) SELECT 'value' AS num, {r(corr('b', 'v'))} AS rho, regr_count(v, b)::BIGINT AS n FROM x",
    "correlation_tests": f"""WITH x AS (SELECT *, {', '.join(f'lag({n}) OVER (ORDER BY {LINE_ORDER}) AS b_{n}' for n in NUMS)} FROM lineitem),
rho AS ({union(f"SELECT '{n}' AS num, {corr('b_' + n, n)} AS rho FROM x" for n in NUMS)}),
p AS ({union(f"SELECT '{a}' AS a, '{b}' AS b, {corr(a, b)} AS r, count(*) AS n FROM lineitem" for a, b in PAIRS)}),
e AS (SELECT p.*, CASE WHEN x.rho * y.rho > 0 THEN least(n, greatest(3, n * (1 - x.rho * y.rho) / (1 + x.rho * y.rho))) ELSE n END::DOUBLE AS ne FROM p JOIN rho x ON x.num = a JOIN rho y ON y.num = b)
SELECT a, b, {r('r', 5)} AS r, n, {r('ne', 2)} AS n_eff, {r('r * r * (ne - 2) / (1 - r * r)', 2)} AS t2 FROM e""",
    "near_duplicates": spearman("SELECT l_quantity, l_extendedprice, l_extendedprice * 1.1 + 5 AS price_usd FROM lineitem", ["l_quantity", "l_extendedprice", "price_usd"], ", abs({c}) >= 0.995 AS copy"),
    "derived_identities": "WITH x AS (SELECT *, round(l_extendedprice * (1 - l_discount), 4) AS t FROM lineitem) "
    + union(f"SELECT '{k}' AS kind, '{','.join(c)}' AS components, count({e}) AS n, count(*) FILTER (WHERE abs(({e}) - t) <= 1e-6 * abs(t) + 0.0005) AS matched FROM x" for k, c, e in FORMS),
    "decimals": union(
        f"SELECT '{n}' AS \"column\", (CASE " + " ".join(f"WHEN max(abs({n} * 1e{k} - round({n} * 1e{k}))) <= 1e-6 * 1e{k} + 1e-9 THEN {k}" for k in range(6)) + f" ELSE 6 END)::BIGINT AS decimals FROM lineitem" for n in NUMS
    ),
    "eta_squared_all": effects(union(moments("lineitem", c, n, c) for c in CATS for n in NUMS)),
    "time_effects": effects(union(moments("orders", f"date_trunc('{u}', o_orderdate)", "o_totalprice", u) for u in ("month", "year")), "unit"),
    "interaction_cells": f"SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, {r('avg(l_extendedprice)', 5)} AS mean FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5",
    "interaction_strength": f"""WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS n, avg(l_extendedprice) AS m, regr_sxx(l_extendedprice, l_extendedprice) AS m2 FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5),
x AS (SELECT *, avg(m) OVER (PARTITION BY a) AS ma, avg(m) OVER (PARTITION BY b) AS mb, avg(m) OVER () AS g, sum(n * m) OVER () / sum(n) OVER () AS w FROM c)
SELECT count(*) AS n_cells, count(DISTINCT a) AS n_a, count(DISTINCT b) AS n_b, sum(n)::BIGINT AS n_total, {r('sum(n * (m - (ma + mb - g)) ** 2) / (sum(n * (m - w) ** 2) + sum(m2))')} AS strength,
 count(*) >= 4 AND count(DISTINCT a) >= 2 AND count(DISTINCT b) >= 2 AND count(*) >= 0.7 * count(DISTINCT a) * count(DISTINCT b) AS kept FROM x""",
    "slope_by_group": f"SELECT x, y, level, n, {r('corr', 5)} AS corr, {r('slope', 4)} AS slope FROM ({per_group('l_returnflag', GROUP_PAIRS)})",
    "slope_spread": spread("l_returnflag", GROUP_PAIRS),
    "conditional_relationships": spread("l_linestatus", [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")]),
    "dispersion_stats": dispersion("SELECT event_type AS level, value AS v FROM events"),
    "bucket_edges": f"SELECT level, n, lo, hi, top_edge, bottom_edge FROM ({dispersion("SELECT CASE WHEN n_chars < 1000 THEN 'a' WHEN n_chars < 3000 THEN 'b' ELSE 'c' END AS level, n_chars::DOUBLE AS v FROM documents")})",
    "value_resolution": f"SELECT {r('min(s)')} AS resolution FROM (SELECT (v - lag(v) OVER (ORDER BY v))::DOUBLE AS s FROM (SELECT DISTINCT p_size AS v FROM part)) WHERE s > 0",
    "bh_discoveries": """WITH t AS (SELECT n_nationkey, ((n_nationkey * 7) % 25 + 1) * 0.0015::DOUBLE AS p FROM nation), k AS (SELECT *, rank() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM t)
SELECT n_nationkey, p <= (SELECT coalesce(max(p), -1) FROM k WHERE p <= 0.05 * i / m) AS discovery FROM t""",
    "group_summary": f"""SELECT o_orderpriority AS level, count(*) AS n, {r('avg(o_totalprice)', 4)} AS mean, {r('median(o_totalprice)', 4)} AS median, {r('stddev_samp(o_totalprice)', 4)} AS std,
 {r('quantile_cont(o_totalprice, 0.25)', 4)} AS q25, {r('quantile_cont(o_totalprice, 0.75)', 4)} AS q75 FROM orders GROUP BY 1""",
    "subgroup_anomalies": f"""WITH g AS (SELECT source AS level, count(*) AS n, avg(n_chars) AS mean, stddev_samp(n_chars) AS std FROM documents GROUP BY 1 HAVING count(*) >= 30),
m AS (SELECT count(*) AS k, median(mean) AS med, sqrt(sum((n - 1) * std * std) / sum(n - 1)) AS pooled FROM g), d AS (SELECT median(abs(mean - med)) AS mad FROM g, m)
SELECT level, n, {r('mean', 4)} AS mean, {r('med', 4)} AS others_median, {r('(mean - med) / (1.4826 * mad)', 4)} AS robust_z, {r('(mean - med) / pooled', 4)} AS diff_sd,
 abs((mean - med) / (1.4826 * mad)) >= 3 AND abs((mean - med) / pooled) >= 0.5 AS anomalous FROM g, m, d WHERE k >= 5 AND mad > 0 AND pooled > 0""",
    "group_time_pattern": f"SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS bucket, event_type AS level, count(*) AS n, {r('avg(value)', 5)} AS mean FROM events GROUP BY 1, 2",
    "distribution_bins": """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN c USING (bin)""",
    "distribution_summary": f"""WITH m AS (SELECT avg(o_totalprice) AS mu FROM orders), x AS (SELECT count(*)::DOUBLE AS n, {', '.join(f'quantile_cont(o_totalprice, {q}) AS p{int(q * 100):02d}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))},
 avg((o_totalprice - mu) ** 3) / avg((o_totalprice - mu) ** 2) ** 1.5 AS g, avg((o_totalprice - mu) ** 4) / avg((o_totalprice - mu) ** 2) ** 2 - 3 AS k FROM orders, m)
SELECT n::BIGINT AS n, {', '.join(f"{r(p, 4)} AS {p}" for p in ('p05', 'p25', 'p50', 'p75', 'p95'))}, {r('g', 4)} AS skewness, {r('k', 4)} AS kurtosis, {r('(g * g + 1) / (k + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))', 4)} AS bimodality FROM x""",
    "nonlinear_bins": f"""WITH x AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, least(greatest(floor(({ranked('p_size')} - 1) * 10 / count(*) OVER ()), 0), 9)::BIGINT AS bin FROM part)
SELECT 'p_retailprice' AS y, bin, {r('min(x)', 4)} AS lo, {r('max(x)', 4)} AS hi, count(*) AS n, {r('avg(y)', 4)} AS mean, {r('regr_sxx(y, y)', 2)} AS m2 FROM x GROUP BY bin""",
    "change_point_split": f"""WITH b AS (SELECT date_trunc('day', ts) AS t, avg(value) AS m FROM events GROUP BY 1),
p AS (SELECT t, count(*) OVER w AS k, sum(m) OVER w AS s1, sum(m * m) OVER w AS q1, count(*) OVER () AS b, sum(m) OVER () AS s2, sum(m * m) OVER () AS q2 FROM b WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, s1 / k AS a, (s2 - s1) / (b - k) AS z, s2 / b AS g FROM p WHERE k >= 5 AND b - k >= 5),
y AS (SELECT *, k * (a - g) ** 2 + (b - k) * (z - g) ** 2 AS btw FROM x ORDER BY btw DESC, k LIMIT 1)
SELECT k, t::TIMESTAMP::VARCHAR AS change_at, {r('a', 5)} AS before, {r('z', 5)} AS after, {r('abs(z - a) / sqrt(greatest(q2 - k * a * a - (b - k) * z * z, 0) / (b - 2))', 5)} AS effect FROM y""",
    "ks_pairs": f"""WITH s AS (SELECT event_type AS l, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 30 ORDER BY n DESC, l LIMIT 8), v AS (SELECT DISTINCT value AS v FROM events WHERE event_type IN (SELECT l FROM s)),
c AS (SELECT v, l, n, coalesce(k, 0) AS k FROM v CROSS JOIN s LEFT JOIN (SELECT value AS v, event_type AS l, count(*) AS k FROM events GROUP BY 1, 2) USING (v, l)),
f AS (SELECT v, l, n, sum(k) OVER (PARTITION BY l ORDER BY v) / n AS f FROM c)
SELECT x.l AS a, y.l AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, {r('max(abs(x.f - y.f))')} AS distance FROM f x JOIN f y ON x.v = y.v AND x.l < y.l GROUP BY 1, 2""",
    "line_month": f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP::VARCHAR AS x, {r('avg(o_totalprice)')} AS y FROM orders GROUP BY 1",
    "line_week": f"SELECT date_trunc('week', o_orderdate)::TIMESTAMP::VARCHAR AS x, {r('avg(o_totalprice)')} AS y FROM orders GROUP BY 1",
    "line_grouped": f"SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS x, event_type AS series, {r('sum(value)', 3)} AS y FROM events GROUP BY 1, 2",
    "bar_top_n": f"WITH {bars('part', 'p_name', 'count(*)', 'v', 20)} SELECT category, rank, v AS value FROM t JOIN b USING (category)",
    "bar_grouped_nulls": f"""WITH {bars('part', 'p_brand', 'avg(p_retailprice)', 'abs(v)', 10)}
SELECT category, rank, series, {r('v', 5)} AS value FROM t CROSS JOIN (SELECT DISTINCT p_type AS series FROM part) LEFT JOIN (SELECT p_brand AS category, p_type AS series, avg(p_retailprice) AS v FROM part GROUP BY 1, 2) USING (category, series)""",
    "bar_median": f"WITH {bars('orders', 'o_orderpriority', 'median(o_totalprice)', 'abs(v)', 20)} SELECT category, rank, {r('v', 5)} AS value FROM t JOIN b USING (category)",
    "histogram": hist("lineitem", "l_extendedprice", "greatest(10, least(50, floor(sqrt(count(*)))))"),
    "histogram_grouped": hist("lineitem", "l_quantity", "12", group="l_returnflag"),
    "box_groups": f"""WITH s AS (SELECT o_orderstatus AS name, count(*) AS n, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS a, q3 + 1.5 * (q3 - q1) AS b FROM s)
SELECT name, any_value(n) AS n, {r('any_value(mean)', 4)} AS mean, {r('any_value(q1)', 4)} AS q1, {r('any_value(med)', 4)} AS median, {r('any_value(q3)', 4)} AS q3, {r('any_value(a)', 4)} AS lower_fence, {r('any_value(b)', 4)} AS upper_fence,
 count(*) FILTER (WHERE o_totalprice < a OR o_totalprice > b) AS n_outliers FROM f JOIN orders ON o_orderstatus = name GROUP BY name""",
    "heatmap_matrix": f"SELECT l_returnflag AS x, l_linenumber::VARCHAR AS \"group\", {r('avg(l_quantity)', 5)} AS value FROM lineitem GROUP BY 1, 2",
    "kde_counts": """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_type AS name, least(greatest(floor((value - lo) / ((hi - lo) / 64)), 0), 63)::BIGINT AS bin, count(*) AS n FROM events, e GROUP BY 1, 2""",
    "dot_interval": f"""WITH s AS (SELECT o_orderpriority AS name, count(*) AS n, avg(o_totalprice) AS m, 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)) AS h FROM orders GROUP BY 1)
SELECT name, n, {r('m', 4)} AS mean, {r('m - h', 4)} AS lo, {r('m + h', 4)} AS hi FROM s""",
    "two_state": f"SELECT o_orderpriority AS x, o_orderstatus AS \"group\", {r('sum(o_totalprice)', 2)} AS value FROM orders GROUP BY 1, 2",
    "hexbin": """WITH e AS (SELECT min(l_quantity)::DOUBLE AS x0, max(l_quantity)::DOUBLE AS x1, min(l_extendedprice)::DOUBLE AS y0, max(l_extendedprice)::DOUBLE AS y1 FROM lineitem),
d AS (SELECT *, (x1 - x0) / 40 AS dx, (x1 - x0) / 40 * (y1 - y0) / (x1 - x0) * (2 / sqrt(3)) AS dy FROM e),
c AS (SELECT l_quantity AS x, x0, dx, floor((l_extendedprice - y0) / (dy * 0.75))::BIGINT AS row FROM lineitem, d)
SELECT floor((x - x0 - CASE WHEN row % 2 = 1 THEN dx / 2 ELSE 0 END) / dx)::BIGINT AS col, row, count(*) AS n FROM c GROUP BY 1, 2""",
    "stacked_bar_percent": f"""WITH {bars('orders', 'o_orderpriority', 'count(*)', 'v', 20)}, c AS (SELECT o_orderpriority AS category, o_orderstatus AS series, count(*) AS value FROM orders GROUP BY 1, 2),
g AS (SELECT category, rank, series, value, sum(value) OVER (PARTITION BY category) AS total FROM t CROSS JOIN (SELECT DISTINCT series FROM c) LEFT JOIN c USING (category, series))
SELECT category, rank, series, value, total::BIGINT AS total, {r('100.0::DOUBLE * value / total')} AS percent FROM g""",
    "sankey_links": """WITH x AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source, event_type AS target FROM events)
SELECT source, target, count(*) AS value FROM x WHERE source IS NOT NULL AND source <> target GROUP BY 1, 2 ORDER BY value DESC, source, target LIMIT 60""",
    "sankey_weighted": f"""SELECT source, target, {r('v', 2)} AS value FROM (SELECT strftime(o_orderdate, '%m') AS source, o_orderpriority AS target, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2 HAVING v > 0 ORDER BY v DESC, source, target LIMIT 60)""",
    "scatter_sample": "SELECT least(count(*), 10000)::BIGINT AS n FROM lineitem",
    "exact_sample": "SELECT least(count(*), 5000)::BIGINT AS n FROM lineitem",
    "stride_sample": "SELECT p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i, ceil(count(*) OVER () / 300) AS k FROM part) WHERE i % k = 0",
    "gap_flags": """WITH x AS (SELECT DISTINCT date_trunc('hour', ts) AS x, event_type AS series FROM events), k AS (SELECT *, dense_rank() OVER (ORDER BY x) AS i FROM x)
SELECT series, x::TIMESTAMP::VARCHAR AS x, coalesce(i - lag(i) OVER (PARTITION BY series ORDER BY x) > 1, false) AS gap FROM k""",
}
