"""DuckDB equivalents of the registered queries, generated from small templates."""

from __future__ import annotations

from facetry.functions.summaries import BASE


def rv(x: str) -> str:
    """``rounded`` of the queries."""
    return f"CASE WHEN isnan({x}) OR {x} IS NULL THEN NULL WHEN abs({x}) >= 1e6 THEN round({x}, 0) WHEN abs({x}) >= 100 THEN round({x}, 3) WHEN abs({x}) >= 1 THEN round({x}, 6) ELSE round({x}, 9) END + 0.0"


def out(inner: str) -> str:
    """``key, value`` rows with rounded values."""
    return f"SELECT CAST(key AS VARCHAR) AS key, {rv('value')} AS value FROM (SELECT key, CAST(value AS DOUBLE) AS value FROM ({inner}))"


def scalar(x: str, rows: str = "lineitem") -> str:
    return out(f"SELECT '' AS key, {x} AS value FROM {rows}")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: The numeric matrix in long form, and its moments by column.
LONG = "WITH base AS (SELECT row_number() OVER () AS rid, * FROM lineitem), n AS (" + " UNION ALL ".join([f"SELECT rid, '{c}' AS key, {c} AS x, l_returnflag AS y FROM base" for c in NUMERIC] + [f"SELECT rid, 'l_linestatus={v}' AS key, CAST(l_linestatus = '{v}' AS DOUBLE) AS x, l_returnflag AS y FROM base" for v in ("F", "O")]) + "), mu AS (SELECT key, avg(x) AS m, median(x) AS med, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, CAST(count(*) AS DOUBLE) AS c FROM n GROUP BY key)"


def column(x: str) -> str:
    return LONG + " " + out(f"SELECT key, {x} AS value FROM n JOIN mu USING (key) GROUP BY key")


# pairs of columns, later one first, in the order of the matrix
PAIRS = LONG + """, place AS (SELECT * FROM (VALUES ('l_quantity', 0), ('l_extendedprice', 1), ('l_discount', 2), ('l_tax', 3), ('l_linestatus=F', 4), ('l_linestatus=O', 5)) t(key, k)),
pr AS (SELECT a.key || ',' || b.key AS key, a.x - ma.m AS u, b.x - mb.m AS v FROM n a JOIN n b USING (rid) JOIN mu ma ON ma.key = a.key JOIN mu mb ON mb.key = b.key JOIN place pa ON pa.key = a.key JOIN place pb ON pb.key = b.key WHERE pa.k > pb.k)"""
CORRELATIONS = "SELECT key, abs(sum(u * v) / sqrt(sum(u * u) * sum(v * v))) AS value FROM pr GROUP BY key"

# category columns of lineitem in long form: the string column, and equal-frequency codes
def bins(table: str) -> str:
    """Rows and equal-frequency bins of a table."""
    return f"bins AS (SELECT CAST(floor(power(count(*), 1.0 / 3)) AS INT) AS k, count(*) AS n FROM {table})"


def cuts(table: str, c: str) -> str:
    """The cut points of a column, as a list in ``q_<column>``."""
    return (
        f"o_{c} AS (SELECT CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {c}) - 1 AS r FROM {table}), "
        f"q_{c} AS (SELECT list(q ORDER BY i) AS cuts FROM (SELECT i, q, lag(q) OVER (ORDER BY i) AS p FROM (SELECT i, lo.x + (hi.x - lo.x) * (place - floor(place)) AS q "
        f"FROM (SELECT i, CAST(i AS DOUBLE) / k * (n - 1) AS place FROM (SELECT k, n, unnest(range(1, k + 1)) AS i FROM bins)) "
        f"JOIN o_{c} lo ON lo.r = CAST(floor(place) AS BIGINT) JOIN o_{c} hi ON hi.r = CAST(ceil(place) AS BIGINT))) WHERE p IS NULL OR abs(q - p) > 1e-8)"
    )


def codes() -> str:
    """Long categories of lineitem with equal-frequency bins."""
    parts = [bins("lineitem"), *(cuts("lineitem", c) for c in NUMERIC)]
    longs = ["SELECT rid, 'l_linestatus' AS key, l_linestatus AS v, l_returnflag AS y FROM base"]
    longs += [f"SELECT rid, '{c}' AS key, CAST(len(list_filter(cuts, lambda z: z < {c})) AS VARCHAR) AS v, l_returnflag AS y FROM base, q_{c}" for c in NUMERIC]
    return "WITH base AS (SELECT row_number() OVER () AS rid, * FROM lineitem), " + ", ".join(parts) + ", cat AS (" + " UNION ALL ".join(longs) + "), tot AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem), cells AS (SELECT key, v, y, CAST(count(*) AS DOUBLE) AS n FROM cat GROUP BY ALL)"


CAT = codes()
ENTROPIES = """, ae AS (SELECT key, -sum(p * log2(p)) AS h FROM (SELECT key, v, sum(c.n) / any_value(t.n) AS p FROM cells c, tot t GROUP BY key, v) GROUP BY key),
ce AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT count(*) / (SELECT n FROM tot) AS p FROM lineitem GROUP BY l_returnflag)),
k AS (SELECT count(DISTINCT l_returnflag) AS ky FROM lineitem),
je AS (SELECT key, -(sum((c.n / t.n + 1e-8) * log2(c.n / t.n + 1e-8)) + (count(DISTINCT v) * any_value(ky) - count(*)) * 1e-8 * log2(1e-8)) AS h FROM cells c, tot t, k GROUP BY key),
mi AS (SELECT key, ae.h + ce.h - je.h AS i FROM ae JOIN je USING (key), ce)"""


def concentration(cells: str) -> str:
    """``key, value`` from a relation ``key, x, y, n``."""
    return f"""SELECT key, (s - own) / (1 - own) AS value FROM (
SELECT key, sum((c.n / t.n + 1e-8) * (c.n / t.n + 1e-8) / (py + kx * 1e-8)) + any_value(e) AS s
FROM {cells} c JOIN (SELECT key, y, sum(n) / (SELECT n FROM tot) AS py, count(*) AS seen FROM {cells} GROUP BY key, y) USING (key, y)
JOIN (SELECT key, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky FROM {cells} GROUP BY key) USING (key)
JOIN (SELECT key, sum((kx - seen) * 1e-16 / (py + kx * 1e-8)) AS e FROM (SELECT key, y, sum(n) / (SELECT n FROM tot) AS py, count(*) AS seen FROM {cells} GROUP BY key, y) JOIN (SELECT key, count(DISTINCT x) AS kx FROM {cells} GROUP BY key) USING (key) GROUP BY key) USING (key), tot t
GROUP BY key) JOIN (SELECT key, sum(power(px + ky * 1e-8, 2)) AS own FROM (SELECT key, x, sum(n) / (SELECT n FROM tot) AS px FROM {cells} GROUP BY key, x) JOIN (SELECT key, count(DISTINCT y) AS ky FROM {cells} GROUP BY key) USING (key) GROUP BY key) USING (key)"""


# embeddings: rows, long form, scaled rows, and all ordered pairs of them
EMB = """WITH l AS (SELECT vec_id AS i, CAST(label AS VARCHAR) AS y, unnest(range(0, 64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
b AS (SELECT j, min(v) AS lo, max(v) AS hi, avg(v) AS m FROM l GROUP BY j),
r AS (SELECT i, y, list(v ORDER BY j) AS x, list((v - lo) / (hi - lo) ORDER BY j) AS z FROM l JOIN b USING (j) GROUP BY i, y),
k AS (SELECT y, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY y), t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r)"""
RAW = EMB + ", p AS (SELECT a.i, a.y, b.i AS j, b.y AS c, list_distance(a.x, b.x) AS d FROM r a JOIN r b ON a.i <> b.i)"
SCALED = EMB + ", p AS (SELECT a.i, a.y, b.i AS j, b.y AS c, list_distance(a.z, b.z) AS d FROM r a JOIN r b ON a.i <> b.i)"
GOWER = EMB + ", p AS (SELECT a.i, a.y, b.i AS j, b.y AS c, list_sum(list_transform(list_zip(a.z, b.z), lambda q: abs(q[1] - q[2]))) / 64 AS d FROM r a JOIN r b ON a.i <> b.i)"
BY_CLASS = EMB + ", g AS (SELECT y, j, CAST(count(*) AS DOUBLE) AS n, avg(v) AS m, var_pop(v) AS s, min(v) AS lo, max(v) AS hi FROM l GROUP BY y, j), cp AS (SELECT a.y || ',' || b.y AS key, a.y AS ya, b.y AS yb, j, greatest(a.lo, b.lo) AS mm, least(a.hi, b.hi) AS mx, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi, a.n + b.n AS n FROM g a JOIN g b USING (j) WHERE CAST(a.y AS INT) < CAST(b.y AS INT))"
WEIGHT = "power(2, -2 * d / CASE WHEN 8 - d <= 0 THEN 1e-9 ELSE 8 - d END)"

ORACLES: dict[str, str] = {
    "general_attr_to_inst": scalar("5.0 / count(*)"),
    "general_cat_to_num": scalar("1.0 / 4", "(SELECT 1)"),
    "general_freq_class": out("SELECT l_returnflag AS key, count(*) / (SELECT count(*) FROM lineitem) AS value FROM lineitem GROUP BY 1"),
    "general_inst_to_attr": scalar("count(*) / 5.0"),
    "general_nr_attr": scalar("5", "(SELECT 1)"),
    "general_nr_bin": scalar("CAST(count(DISTINCT l_quantity) = 2 AS INT) + CAST(count(DISTINCT l_extendedprice) = 2 AS INT) + CAST(count(DISTINCT l_discount) = 2 AS INT) + CAST(count(DISTINCT l_tax) = 2 AS INT) + CAST(count(DISTINCT l_linestatus) = 2 AS INT)"),
    "general_nr_cat": scalar("1", "(SELECT 1)"),
    "general_nr_class": scalar("count(DISTINCT l_returnflag)"),
    "general_nr_inst": scalar("count(*)"),
    "general_nr_num": scalar("4", "(SELECT 1)"),
    "general_num_to_cat": scalar("4.0", "(SELECT 1)"),
    "statistical_cor": PAIRS + " " + out(CORRELATIONS),
    "statistical_cov": PAIRS + " " + out("SELECT key, abs(sum(u * v) / (count(*) - 1)) AS value FROM pr GROUP BY key"),
    "statistical_nr_cor_attr": PAIRS + " " + out(f"SELECT '' AS key, avg(CAST(value >= 0.5 AS INT)) AS value FROM ({CORRELATIONS})"),
    "statistical_g_mean": column("CASE WHEN min(x) < 0 THEN NULL WHEN min(x) < 1e-10 THEN 0 ELSE exp(avg(CASE WHEN x > 0 THEN ln(x) END)) END"),
    "statistical_h_mean": column("CASE WHEN min(x) < 0 THEN NULL WHEN min(x) = 0 THEN 0 ELSE count(*) / sum(CASE WHEN x <> 0 THEN 1 / x END) END"),
    "statistical_iq_range": column("any_value(q3 - q1)"),
    "statistical_kurtosis": column("avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) * power(1 - 1 / any_value(c), 2) - 3"),
    "statistical_skewness": column("avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) * power((any_value(c) - 1) / any_value(c), 1.5)"),
    "statistical_mad": column("1.4826 * median(abs(x - med))"),
    "statistical_max": column("max(x)"),
    "statistical_mean": column("avg(x)"),
    "statistical_median": column("median(x)"),
    "statistical_min": column("min(x)"),
    "statistical_nr_outliers": LONG + " " + out("SELECT '' AS key, sum(CAST(o AS INT)) AS value FROM (SELECT key, min(x) < any_value(q1 - 1.5 * (q3 - q1)) OR max(x) > any_value(q3 + 1.5 * (q3 - q1)) AS o FROM n JOIN mu USING (key) GROUP BY key)"),
    "statistical_range": column("max(x) - min(x)"),
    "statistical_sd": column("stddev_samp(x)"),
    "statistical_var": column("var_samp(x)"),
    "statistical_t_mean": LONG + ", o AS (SELECT key, x, row_number() OVER (PARTITION BY key ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY key) AS c FROM n) " + out("SELECT key, avg(x) AS value FROM o WHERE r >= CAST(floor(0.2 * c) AS INT) AND r < c - CAST(floor(0.2 * c) AS INT) GROUP BY key"),
    "statistical_sparsity": out(" UNION ALL ".join(f"SELECT '{c}' AS key, (count(*) / CAST(count(DISTINCT {c}) AS DOUBLE) - 1) / (count(*) - 1) AS value FROM lineitem" for c in [*NUMERIC, "l_linestatus"])),
    "statistical_gravity": LONG + ", f AS (SELECT l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT y FROM f ORDER BY n DESC, y LIMIT 1), b AS (SELECT y FROM f WHERE y <> (SELECT y FROM a) ORDER BY n, y LIMIT 1) " + out("SELECT '' AS key, sqrt(sum(power(u - v, 2))) AS value FROM (SELECT key, avg(CASE WHEN y = (SELECT y FROM a) THEN x END) AS u, avg(CASE WHEN y = (SELECT y FROM b) THEN x END) AS v FROM n GROUP BY key)"),
    "info_theory_attr_ent": CAT + ENTROPIES + " " + out("SELECT key, h AS value FROM ae"),
    "info_theory_class_ent": CAT + ENTROPIES + " " + out("SELECT '' AS key, h AS value FROM ce"),
    "info_theory_joint_ent": CAT + ENTROPIES + " " + out("SELECT key, h AS value FROM je"),
    "info_theory_mut_inf": CAT + ENTROPIES + " " + out("SELECT key, i AS value FROM mi"),
    "info_theory_eq_num_attr": CAT + ENTROPIES + " " + out("SELECT '' AS key, count(*) * (SELECT h FROM ce) / sum(i) AS value FROM mi"),
    "info_theory_ns_ratio": CAT + ENTROPIES + " " + out("SELECT '' AS key, ((SELECT sum(h) FROM ae) - sum(i)) / sum(i) AS value FROM mi"),
    "info_theory_class_conc": CAT + ", cc AS (SELECT key, v AS x, y, n FROM cells) " + out(concentration("cc")),
    "info_theory_attr_conc": CAT + ", cc AS (SELECT a.key || ',' || b.key AS key, a.v AS x, b.v AS y, CAST(count(*) AS DOUBLE) AS n FROM cat a JOIN cat b USING (rid) WHERE a.key <> b.key GROUP BY ALL) " + out(concentration("cc")),
    "itemset_one_itemset": CAT + " " + out("SELECT key || '=' || v AS key, sum(c.n) / any_value(t.n) AS value FROM cells c, tot t GROUP BY c.key, v"),
    "itemset_two_itemset": CAT + ", place AS (SELECT * FROM (VALUES ('l_linestatus', 0), ('l_quantity', 1), ('l_extendedprice', 2), ('l_discount', 3), ('l_tax', 4)) q(key, k)), own AS (SELECT key, v, sum(n) AS n, any_value(k) AS k FROM cells JOIN place USING (key) GROUP BY key, v), both_ AS (SELECT a.key AS ka, a.v AS va, b.key AS kb, b.v AS vb, count(*) AS n FROM cat a JOIN cat b USING (rid) JOIN place pa ON pa.key = a.key JOIN place pb ON pb.key = b.key WHERE pa.k < pb.k GROUP BY ALL) " + out("SELECT a.key || '=' || a.v || ',' || b.key || '=' || b.v AS key, (a.n + b.n - 2 * coalesce(c.n, 0)) / t.n AS value FROM own a JOIN own b ON a.k < b.k LEFT JOIN both_ c ON c.ka = a.key AND c.va = a.v AND c.kb = b.key AND c.vb = b.v, tot t"),
    "clustering_int": RAW + " " + out("SELECT '' AS key, avg(m) AS value FROM (SELECT avg(d) AS m FROM p WHERE CAST(y AS INT) < CAST(c AS INT) GROUP BY y, c)"),
    "clustering_sil": RAW + " " + out("SELECT '' AS key, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS value FROM (SELECT i, max(CASE WHEN c = y THEN m END) AS a, min(CASE WHEN c <> y THEN m END) AS b FROM (SELECT i, y, c, avg(d) AS m FROM p GROUP BY ALL) GROUP BY i)"),
    "clustering_pb": RAW + " " + out("SELECT '' AS key, corr(CAST(y = c AS INT), d) AS value FROM p"),
    "clustering_vdu": RAW + " " + out("SELECT '' AS key, min(CASE WHEN p.y <> c THEN d / (ka.n * kb.n) END) / max(CASE WHEN p.y = c THEN d END) AS value FROM p JOIN k ka ON ka.y = p.y JOIN k kb ON kb.y = p.c"),
    "clustering_vdb": EMB + ", g AS (SELECT y, list(m ORDER BY j) AS m FROM (SELECT y, j, avg(v) AS m FROM l GROUP BY y, j) GROUP BY y), s AS (SELECT y, avg(list_distance(x, m)) AS s FROM r JOIN g USING (y) GROUP BY y) " + out("SELECT '' AS key, avg(w) AS value FROM (SELECT a.y, max((sa.s + sb.s) / list_distance(a.m, b.m)) AS w FROM g a JOIN g b ON a.y <> b.y JOIN s sa ON sa.y = a.y JOIN s sb ON sb.y = b.y GROUP BY a.y)"),
    "clustering_ch": BY_CLASS + " " + out("SELECT '' AS key, sum(g.n * power(g.m - b.m, 2)) * ((SELECT n FROM t) - (SELECT count(*) FROM k)) / (sum(g.n * s) * ((SELECT count(*) FROM k) - 1)) AS value FROM g JOIN b USING (j)"),
    "clustering_nre": EMB + " " + out("SELECT '' AS key, -sum(k.n / t.n * ln(k.n / t.n)) AS value FROM k, t"),
    "clustering_sc": EMB + " " + out("SELECT '' AS key, sum(CAST(n < 15 AS INT)) AS value FROM k"),
    "concept_conceptvar": SCALED + " " + out(f"SELECT i AS key, sum(CASE WHEN y <> c THEN {WEIGHT} ELSE 0 END) / sum({WEIGHT}) AS value FROM p GROUP BY i"),
    "concept_wg_dist": SCALED + " " + out(f"SELECT i AS key, sum({WEIGHT} * d) / sum({WEIGHT}) AS value FROM p GROUP BY i"),
    "concept_impconceptvar": SCALED + " " + out("SELECT i AS key, sum(CASE WHEN y <> c THEN power(2, -greatest(1, ceil(d))) ELSE 0 END) AS value FROM p GROUP BY i"),
    "concept_cohesiveness": SCALED + " " + out("SELECT i AS key, sum(power(2, -greatest(1, ceil(d)))) AS value FROM p GROUP BY i"),
    "complexity_f1": BY_CLASS + " " + out("SELECT 'e' || j AS key, 1 / (1 + sum(g.n * power(g.m - b.m, 2)) / sum(g.n * s)) AS value FROM g JOIN b USING (j) GROUP BY j"),
    "complexity_f2": BY_CLASS + " " + out("SELECT key, product(greatest(0, mx - mm) / (hi - lo)) AS value FROM cp GROUP BY key"),
    "complexity_f3": BY_CLASS + " " + out("SELECT key, min(q) AS value FROM (SELECT key, cp.j, sum(CAST(v BETWEEN mm AND mx AS INT)) / any_value(cp.n) AS q FROM cp JOIN l ON l.j = cp.j AND (l.y = ya OR l.y = yb) GROUP BY key, cp.j) GROUP BY key"),
    "complexity_n2": GOWER + " " + out("SELECT i AS key, 1 - 1 / (1 + min(CASE WHEN y = c THEN d END) / min(CASE WHEN y <> c THEN d END)) AS value FROM p GROUP BY i"),
    "complexity_n3": GOWER + " " + out("SELECT i AS key, CAST(any_value(y) <> arg_min(c, d) AS INT) AS value FROM p GROUP BY i"),
    "complexity_lsc": GOWER + ", e AS (SELECT i, min(d) AS e FROM p WHERE y <> c GROUP BY i) " + out("SELECT '' AS key, 1 - (sum(CAST(d < e AS INT)) + any_value(t.n)) / power(any_value(t.n), 2) AS value FROM p JOIN e ON e.i = p.j, t"),
    "complexity_c1": EMB + " " + out("SELECT '' AS key, -sum(k.n / t.n * ln(k.n / t.n)) / ln(count(*)) AS value FROM k, t"),
    "complexity_c2": EMB + " " + out("SELECT '' AS key, 1 - 1 / ((count(*) - 1) / CAST(count(*) AS DOUBLE) * sum(k.n / (t.n - k.n))) AS value FROM k, t"),
    "complexity_t2": EMB + " " + out("SELECT '' AS key, 64 / n AS value FROM t"),
    "transform_discretise": f"WITH {bins('part')}, {cuts('part', 'p_size')}, {cuts('part', 'p_retailprice')} " + " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS key, CAST(len(list_filter(cuts, lambda z: z < {c})) AS VARCHAR) AS code FROM part, q_{c}" for c in ("p_size", "p_retailprice")),
    "transform_gray": "SELECT p_partkey, 'p_brand=' || b AS key, CAST(p_brand = b AS DOUBLE) AS value FROM part, (SELECT DISTINCT p_brand AS b FROM part)",
    "transform_one_hot_full": "SELECT p_partkey, 'p_brand=' || b AS key, CAST(p_brand = b AS DOUBLE) AS value FROM part, (SELECT DISTINCT p_brand AS b FROM part)",
    "transform_one_hot": "SELECT p_partkey, 'p_brand=' || b AS key, CAST(p_brand = b AS DOUBLE) AS value FROM part, (SELECT DISTINCT p_brand AS b FROM part) WHERE b <> (SELECT min(p_brand) FROM part)",
    "relative_ranks": "WITH m AS (SELECT p_brand || '.mean' AS name, round(avg(p_size), 1) AS value FROM part GROUP BY p_brand) SELECT name || '.relative' AS name, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS value FROM m",
    "streaming_moments": f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(value) AS n, {rv('avg(value)')} AS mean, {rv('stddev_samp(value)')} AS sd, {rv('min(value)')} AS min, {rv('max(value)')} AS max FROM events GROUP BY ALL",
    "streaming_class_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
# scores of a plain rule for the return flag
RULE = "WITH r AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END AS p FROM lineitem), c AS (SELECT y, count(*) AS n, sum(CAST(y = p AS INT)) AS hit FROM r GROUP BY y), s AS (SELECT p AS y, count(*) AS said FROM r GROUP BY p)"
ORACLES["score_accuracy"] = RULE + " " + out("SELECT '' AS key, sum(hit) / sum(n) AS value FROM c")
ORACLES["score_balanced_accuracy"] = RULE + " " + out("SELECT '' AS key, avg(hit / CAST(n AS DOUBLE)) AS value FROM c")
ORACLES["score_f1"] = RULE + " " + out("SELECT '' AS key, sum(n * 2.0 * hit / (n + coalesce(said, 0))) / sum(n) AS value FROM c LEFT JOIN s USING (y)")

# neighbour graph of the embeddings: the nearest 15 % of the rows, edges inside classes
EDGES = GOWER + ", nb AS (SELECT i, y, j, c, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS place FROM p), e AS (SELECT DISTINCT least(i, j) AS u, greatest(i, j) AS v FROM nb, t WHERE place <= greatest(1, CAST(round_even(t.n * 0.15, 0) AS INT)) AND y = c AND d > 0)"
ORACLES["complexity_density"] = EDGES + " " + out("SELECT '' AS key, 1 - 2.0 * (SELECT count(*) FROM e) / (t.n * (t.n - 1)) AS value FROM t")
ORACLES["complexity_cls_coef"] = EDGES + ", tri AS (SELECT count(*) AS k FROM e a JOIN e b ON b.u = a.v JOIN e c ON c.u = a.u AND c.v = b.v), deg AS (SELECT count(*) AS k FROM (SELECT u FROM e UNION ALL SELECT v FROM e) GROUP BY u) " + out("SELECT '' AS key, 1 - 3.0 * (SELECT k FROM tri) / (SELECT sum(k * (k - 1) / 2) FROM deg) AS value")

# landmarking on part: ten stratified folds by id, classes by their first row
FOLDS = """WITH cls AS (SELECT p_type AS y, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1),
o AS (SELECT y, n, sum(n) OVER (ORDER BY f) AS e FROM cls),
a AS (SELECT y, f, greatest(0, ceil((e - f) / 10.0)) - greatest(0, ceil((e - n - f) / 10.0)) AS k FROM o, (SELECT unnest(range(0, 10)) AS f)),
cum AS (SELECT y, f, sum(k) OVER (PARTITION BY y ORDER BY f) AS upto FROM a),
ranked AS (SELECT p_partkey AS id, p_type AS y, p_size, p_retailprice, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS rk FROM part),
rows_ AS (SELECT r.id, any_value(r.y) AS y, any_value(p_size) AS p_size, any_value(p_retailprice) AS p_retailprice, any_value(p_brand) AS p_brand, sum(CAST(rk >= upto AS INT)) AS fold FROM ranked r JOIN cum ON cum.y = r.y AND cum.f < 9 GROUP BY r.id),
br AS (SELECT b, row_number() OVER (ORDER BY b) + 1 AS j FROM (SELECT DISTINCT p_brand AS b FROM part)),
long AS (SELECT id, y, fold, 0 AS j, CAST(p_size AS DOUBLE) AS x FROM rows_ UNION ALL SELECT id, y, fold, 1, p_retailprice FROM rows_ UNION ALL SELECT id, y, fold, j, CAST(p_brand = b AS DOUBLE) FROM rows_, br)"""
SCORES = "SELECT CAST(fold AS VARCHAR) AS key, avg(CAST(y = said AS DOUBLE)) AS value FROM said GROUP BY fold"
ORACLES["landmarking_one_nn"] = FOLDS + ", said AS (SELECT a.id, any_value(a.fold) AS fold, any_value(a.y) AS y, arg_min(b.y, (power(a.p_size - b.p_size, 2) + power(a.p_retailprice - b.p_retailprice, 2) + CASE WHEN a.p_brand <> b.p_brand THEN 2 ELSE 0 END, b.id)) AS said FROM rows_ a JOIN rows_ b ON a.fold <> b.fold GROUP BY a.id) " + out(SCORES)
ORACLES["landmarking_naive_bayes"] = (
    FOLDS
    + """, f AS (SELECT DISTINCT fold FROM rows_), st AS (SELECT f.fold, long.y, j, avg(x) AS m, var_pop(x) AS s, count(*) AS n FROM long JOIN f ON f.fold <> long.fold GROUP BY ALL),
sm AS (SELECT fold, 1e-9 * max(s) AS s FROM (SELECT f.fold, j, var_pop(x) AS s FROM long JOIN f ON f.fold <> long.fold GROUP BY ALL) GROUP BY fold),
tr AS (SELECT f.fold, count(*) AS n FROM rows_ JOIN f ON f.fold <> rows_.fold GROUP BY f.fold),
ll AS (SELECT l.id, l.fold, any_value(l.y) AS y, st.y AS c, any_value(ln(st.n / CAST(tr.n AS DOUBLE))) - 0.5 * sum(ln(2 * pi() * (st.s + sm.s)) + power(x - m, 2) / (st.s + sm.s)) AS ll FROM long l JOIN st ON st.fold = l.fold AND st.j = l.j JOIN sm ON sm.fold = l.fold JOIN tr ON tr.fold = l.fold GROUP BY l.id, l.fold, st.y),
said AS (SELECT id, any_value(fold) AS fold, any_value(y) AS y, arg_max(c, ll) AS said FROM ll GROUP BY id) """
    + out(SCORES)
)


def stump(columns: str) -> str:
    """Scores of the best split of the training rows on the columns."""
    return (
        FOLDS
        + f""", f AS (SELECT DISTINCT fold FROM rows_), names AS (SELECT list(y ORDER BY y) AS y FROM cls),
tr AS (SELECT f.fold, long.y, j, x, list_position(names.y, long.y) AS c FROM long JOIN f ON f.fold <> long.fold, names WHERE {columns}),
g AS (SELECT fold, j, x, c, count(*) AS n FROM tr GROUP BY ALL),
val AS (SELECT fold, j, x, {", ".join(f"sum(CASE WHEN c = {k} THEN n ELSE 0 END) AS c{k}" for k in range(1, 7))} FROM g GROUP BY fold, j, x),
up AS (SELECT fold, j, x, lead(x) OVER (PARTITION BY fold, j ORDER BY x) AS nx, {", ".join(f"sum(c{k}) OVER (PARTITION BY fold, j ORDER BY x) AS l{k}, sum(c{k}) OVER (PARTITION BY fold, j) AS t{k}" for k in range(1, 7))} FROM val),
gain AS (SELECT *, ({" + ".join(f"l{k} * l{k}" for k in range(1, 7))}) / CAST({" + ".join(f"l{k}" for k in range(1, 7))} AS DOUBLE) + ({" + ".join(f"(t{k} - l{k}) * (t{k} - l{k})" for k in range(1, 7))}) / CAST({" + ".join(f"(t{k} - l{k})" for k in range(1, 7))} AS DOUBLE) AS gain FROM up WHERE nx - x > 1e-7),
best AS (SELECT *, (x + nx) / 2 AS cut, row_number() OVER (PARTITION BY fold ORDER BY round(gain, 7) DESC, j, x) AS place FROM gain),
said AS (SELECT l.id, l.fold, l.y, names.y[CASE WHEN l.x <= cut THEN list_position([{", ".join(f"l{k}" for k in range(1, 7))}], greatest({", ".join(f"l{k}" for k in range(1, 7))})) ELSE list_position([{", ".join(f"t{k} - l{k}" for k in range(1, 7))}], greatest({", ".join(f"t{k} - l{k}" for k in range(1, 7))})) END] AS said FROM best JOIN long l ON l.fold = best.fold AND l.j = best.j, names WHERE place = 1) """
        + out(SCORES)
    )


ORACLES["landmarking_best_node"] = stump("TRUE")
#: The column that the seed 0 draws of the 27.
ORACLES["landmarking_random_node"] = stump("j = 12")

for _kind, _x in (("standard", "(x - (SELECT avg({c}) FROM part)) / (SELECT stddev_pop({c}) FROM part)"), ("min_max", "(x - (SELECT min({c}) FROM part)) / (SELECT max({c}) - min({c}) FROM part)"), ("robust", "(x - (SELECT median({c}) FROM part)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM part)")):
    ORACLES[f"rescale_{_kind}"] = " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS key, {rv(_x.format(c=c))} AS value FROM (SELECT p_partkey, CAST({c} AS DOUBLE) AS x FROM part)" for c in ("p_size", "p_retailprice"))

# summaries of l_extendedprice by l_returnflag
_ROWS = "WITH r AS (SELECT l_returnflag AS name, l_extendedprice AS v FROM lineitem), m AS (SELECT name, avg(v) AS mu, min(v) AS lo, max(v) AS hi, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY name)"
_ONE = {
    "mean": "avg(v)", "sd": "stddev_samp(v)", "var": "var_samp(v)", "count": "count(v)", "iq_range": "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)",
    "kurtosis": "avg(power(v - mu, 4)) / power(avg(power(v - mu, 2)), 2) * power(1 - 1 / any_value(c), 2) - 3", "max": "max(v)", "median": "median(v)", "min": "min(v)", "range": "max(v) - min(v)",
    "skewness": "avg(power(v - mu, 3)) / power(avg(power(v - mu, 2)), 1.5) * power((any_value(c) - 1) / any_value(c), 1.5)", "sum": "sum(v)", "powersum": "sum(v * v)", "pnorm": "sqrt(sum(v * v))",
}


def _summary(name: str) -> str:
    kind = name.removeprefix("nan")
    if kind == "quantiles":
        parts = [(f"{name}.{k}", f"quantile_cont(v, {s})") for k, s in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))]
    elif kind == "histogram":
        parts = [(f"{name}.{k}", f"sum(CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) = {k} AS INT)) / any_value(c)") for k in range(10)]
    else:
        parts = [(name, _ONE[kind])]
    inner = " UNION ALL ".join(f"SELECT r.name || '.{label}' AS name, CAST({x} AS DOUBLE) AS value FROM r JOIN m USING (name) GROUP BY r.name" for label, x in parts)
    return f"{_ROWS} SELECT name, {rv('value')} AS value FROM ({inner})"


for _name in (*BASE, *(f"nan{x}" for x in BASE)):
    ORACLES[f"summary_{_name}"] = _summary(_name)
