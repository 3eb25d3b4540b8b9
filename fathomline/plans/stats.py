"""Queries of the statistical operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.operators import stats
from fathomline.plans.adapters import CANDLES, candles, read, rounded
from fathomline.plans.catalogue import register

_PANEL = f"""{CANDLES}, panel AS (
    SELECT symbol, date, close, volume, close / lag(close, 5) OVER o - 1 AS momentum, lead(close) OVER o / close - 1 AS forward, close / lag(close) OVER o - 1 AS ret
    FROM candles WINDOW o AS (PARTITION BY symbol ORDER BY date))"""


def panel(spark, sf_dir):
    o = Window.partitionBy("symbol").orderBy("date")  # daily rows of a symbol
    c = F.col("close")
    return candles(spark, sf_dir).select("symbol", "date", "close", "volume", (c / F.lag(c, 5).over(o) - 1).alias("momentum"), (F.lead(c).over(o) / c - 1).alias("forward"), (c / F.lag(c).over(o) - 1).alias("ret"))


def _ranks(x: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2)"


@register("ic_pearson", f"WITH {_PANEL} SELECT symbol, round(corr(momentum, forward), 6) AS ic, count(*) AS n FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL GROUP BY 1")
def ic_pearson(spark, sf_dir):
    p = panel(spark, sf_dir).where("momentum IS NOT NULL AND forward IS NOT NULL")
    return rounded(p.groupBy("symbol").agg(stats.pearson("momentum", "forward").alias("ic"), F.count(F.lit(1)).alias("n")))


_SPEARMAN = f"""{_PANEL}, r AS (SELECT symbol, {_ranks("momentum", "symbol")} AS a, {_ranks("forward", "symbol")} AS b FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL),
ics AS (SELECT symbol, corr(a, b) AS ic, count(*) AS n FROM r GROUP BY 1)"""


@register("ic_spearman", f"WITH {_SPEARMAN} SELECT symbol, round(ic, 6) AS ic, n FROM ics")
def ic_spearman(spark, sf_dir):
    return rounded(stats.spearman(panel(spark, sf_dir), "momentum", "forward", ["symbol"]))


@register(
    "ic_screen_fdr",
    f"""WITH {_SPEARMAN}, t AS (SELECT symbol, ic, ic * sqrt((n - 2) / (1 - ic * ic)) AS t FROM ics), x AS (SELECT *, abs(t) / sqrt(2) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(t) / sqrt(2)) AS u FROM t),
    p AS (SELECT symbol, ic, u * (0.254829592::DOUBLE + u * (-0.284496736::DOUBLE + u * (1.421413741::DOUBLE + u * (-1.453152027::DOUBLE + u * 1.061405429::DOUBLE)))) * exp(-x * x) AS p FROM x),
    z AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q, row_number() OVER (ORDER BY p) AS k FROM p)
    SELECT symbol, round(ic, 6) AS ic, round(p, 6) AS p, round(least(min(q) OVER (ORDER BY k DESC), 1), 6) AS q FROM z""",
)
def ic_screen_fdr(spark, sf_dir):
    ic = stats.spearman(panel(spark, sf_dir), "momentum", "forward", ["symbol"])
    p = ic.withColumn("p", stats.normal_p(stats.t_statistic(F.col("ic"), F.col("n"))))
    return rounded(stats.benjamini_hochberg(p).select("symbol", "ic", "p", "q"))


@register("ic_fisher_interval", f"WITH {_SPEARMAN} SELECT symbol, round(tanh(atanh(ic) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(ic) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM ics")
def ic_fisher_interval(spark, sf_dir):
    ic = stats.spearman(panel(spark, sf_dir), "momentum", "forward", ["symbol"])
    low, high = stats.fisher_interval(F.col("ic"), F.col("n"))
    return rounded(ic.select("symbol", low.alias("low"), high.alias("high")))


@register(
    "ic_cross_sectional",
    f"""WITH {_PANEL}, r AS (SELECT date, {_ranks("momentum", "date")} AS a, {_ranks("forward", "date")} AS b FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL),
    d AS (SELECT date, CASE WHEN corr(a, b) IS NULL OR isnan(corr(a, b)) THEN 0 ELSE corr(a, b) END AS ic FROM r GROUP BY 1 HAVING count(*) >= 3)
    SELECT count(*) AS dates, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 5) AS t FROM d""",
)
def ic_cross_sectional(spark, sf_dir):
    d = stats.spearman(panel(spark, sf_dir), "momentum", "forward", ["date"]).where("n >= 3")
    out = d.agg(F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"))
    return rounded(out.withColumn("t", F.round(F.col("mean_ic") / F.col("std_ic") * F.sqrt("dates"), 5)))


@register(
    "ic_rolling",
    f"""WITH {_PANEL}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1) // 100 AS win FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL),
    r AS (SELECT symbol, win, {_ranks("momentum", "symbol, win")} AS a, {_ranks("forward", "symbol, win")} AS b FROM n) SELECT symbol, win, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) = 100""",
)
def ic_rolling(spark, sf_dir):
    from fathomline.functions.windows import numbered

    p = panel(spark, sf_dir).where("momentum IS NOT NULL AND forward IS NOT NULL")
    p = numbered(p, ["symbol"], ["date"], "date", 86_400 * 365).withColumn("win", F.floor(F.col("_n") / 100))
    return rounded(stats.spearman(p, "momentum", "forward", ["symbol", "win"]).where("n = 100"))


@register(
    "mutual_information_binned",
    f"""WITH {_PANEL}, e AS (SELECT *, floor((momentum - min(momentum) OVER w) / (max(momentum) OVER w - min(momentum) OVER w) * 15) AS bx, floor((forward - min(forward) OVER w) / (max(forward) OVER w - min(forward) OVER w) * 15) AS by_
        FROM panel WHERE momentum IS NOT NULL AND forward IS NOT NULL WINDOW w AS (PARTITION BY symbol)),
    c AS (SELECT symbol, bx, by_, count(*)::DOUBLE AS c FROM e GROUP BY 1, 2, 3), m AS (SELECT *, sum(c) OVER (PARTITION BY symbol) AS n, sum(c) OVER (PARTITION BY symbol, bx) AS cx, sum(c) OVER (PARTITION BY symbol, by_) AS cy FROM c)
    SELECT symbol, round(greatest(sum(c / n * log2(c * n / (cx * cy))), 0), 6) AS mi FROM m GROUP BY 1""",
)
def mutual_information_binned(spark, sf_dir):
    return rounded(stats.mutual_information(panel(spark, sf_dir), "momentum", "forward", 16, ["symbol"]))


@register("mutual_information_ksg")
def mutual_information_ksg(spark, sf_dir):
    return rounded(stats.ksg_by_key(panel(spark, sf_dir), "momentum", "forward", "symbol"))


@register(
    "transition_matrix",
    """WITH s AS (SELECT user_id, event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), n AS (SELECT state, next, count(*) AS n FROM s WHERE next IS NOT NULL GROUP BY 1, 2)
    SELECT state, next, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS p FROM n""",
)
def transition_matrix(spark, sf_dir):
    return rounded(stats.transitions(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type"))


@register(
    "state_run_lengths",
    """WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s),
    l AS (SELECT user_id, run, event_type, count(*) AS len FROM r GROUP BY 1, 2, 3) SELECT event_type, round(avg(len), 6) AS mean_run, max(len) AS longest_run, count(*) AS runs FROM l GROUP BY 1""",
)
def state_run_lengths(spark, sf_dir):
    return rounded(stats.run_lengths(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type"))


_CELLS = "count(*) FILTER (a AND b)::DOUBLE AS n11, count(*) FILTER (a AND NOT b)::DOUBLE AS n10, count(*) FILTER (NOT a AND b)::DOUBLE AS n01, count(*) FILTER (NOT a AND NOT b)::DOUBLE AS n00"


@register(
    "contingency_lift",
    f"""WITH x AS (SELECT l_returnflag AS k, l_quantity > 25 AS a, l_discount > 0.05 AS b FROM lineitem), c AS (SELECT k, {_CELLS} FROM x GROUP BY 1)
    SELECT k AS l_returnflag, n11, n10, n01, n00, round((n11 + n10 + n01 + n00) * (n11 * n00 - n10 * n01) ** 2 / ((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)), 6) AS chi2,
           round((n11 / (n11 + n10)) / ((n11 + n01) / (n11 + n10 + n01 + n00)), 6) AS lift FROM c""",
)
def contingency_lift(spark, sf_dir):
    return rounded(stats.contingency(read(spark, sf_dir, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05, ["l_returnflag"]))


@register(
    "classification_metrics",
    f"""WITH x AS (SELECT l_returnflag AS k, l_quantity > 25 AS a, l_extendedprice > 30000 AS b FROM lineitem), c AS (SELECT k, {_CELLS} FROM x GROUP BY 1), m AS (SELECT *, n11 / (n11 + n10) AS p, n11 / (n11 + n01) AS r, (n11 + n01) / (n11 + n10 + n01 + n00) AS base FROM c)
    SELECT k AS l_returnflag, n11 AS tp, n10 AS fp, n00 AS tn, n01 AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round((n11 + n00) / (n11 + n10 + n01 + n00), 6) AS accuracy, round(base, 6) AS baseline, round(2 * p * r / (p + r), 6) AS f1, round(p / base, 6) AS lift FROM m""",
)
def classification_metrics(spark, sf_dir):
    return rounded(stats.classification(read(spark, sf_dir, "lineitem"), F.col("l_quantity") > 25, F.col("l_extendedprice") > 30000, ["l_returnflag"]))


@register(
    "partial_correlation",
    """SELECT l_returnflag, round((corr(l_extendedprice, l_discount) - corr(l_extendedprice, l_quantity) * corr(l_discount, l_quantity)) / sqrt((1 - corr(l_extendedprice, l_quantity) ** 2) * (1 - corr(l_discount, l_quantity) ** 2)), 6) AS partial FROM lineitem GROUP BY 1""",
)
def partial_correlation(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(stats.partial_correlation("l_extendedprice", "l_discount", "l_quantity").alias("partial")))


@register(
    "variance_ratio",
    f"""WITH {_PANEL}, d AS (SELECT symbol, ret, count(ret) OVER (PARTITION BY symbol) AS n, avg(ret) OVER (PARTITION BY symbol) AS mu, CASE WHEN row_number() OVER o >= 5 THEN sum(ret) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) END AS q FROM panel WHERE ret IS NOT NULL WINDOW o AS (PARTITION BY symbol ORDER BY date))
    SELECT symbol, round(sum((q - 5 * mu) ** 2) / (5 * (any_value(n) - 4) * (1 - 5 / any_value(n))) / (sum((ret - mu) ** 2) / (any_value(n) - 1)), 6) AS variance_ratio, any_value(n) AS n FROM d GROUP BY 1""",
)
def variance_ratio(spark, sf_dir):
    return rounded(stats.variance_ratio(panel(spark, sf_dir).where("ret IS NOT NULL"), 5, ["symbol"], ["date"]))


@register(
    "signal_turnover",
    f"""WITH {_PANEL}, d AS (SELECT symbol, momentum, abs(momentum - lag(momentum) OVER (PARTITION BY symbol ORDER BY date)) AS d FROM panel WHERE momentum IS NOT NULL) SELECT symbol, round(avg(d) / (2 * stddev_pop(momentum)), 6) AS turnover FROM d GROUP BY 1""",
)
def signal_turnover(spark, sf_dir):
    return rounded(stats.turnover(panel(spark, sf_dir).where("momentum IS NOT NULL"), ["symbol"], ["date"], "momentum"))


@register(
    "return_profile",
    f"""WITH {_PANEL}, m AS (SELECT symbol, ret, avg(ret) OVER (PARTITION BY symbol) AS m FROM panel WHERE ret IS NOT NULL),
    s AS (SELECT symbol, count(*)::DOUBLE AS n, any_value(m) AS mean, median(ret) AS median, stddev_samp(ret) AS std, avg((ret - m) ** 2) AS m2, avg((ret - m) ** 3) AS m3, avg((ret - m) ** 4) AS m4, quantile_cont(ret, 0.05) AS p5, quantile_cont(ret, 0.95) AS p95 FROM m GROUP BY 1)
    SELECT symbol, n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(p5, 6) AS p5, round(p95, 6) AS p95, round(m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2), 5) AS skew,
           round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6), 5) AS kurtosis, round(mean / std, 6) AS sharpe FROM s""",
)
def return_profile(spark, sf_dir):
    out = stats.moments("ret", ["symbol"], panel(spark, sf_dir).where("ret IS NOT NULL"))
    return rounded(out.withColumns({"skew": F.round("skew", 5), "kurtosis": F.round("kurtosis", 5)}))


@register(
    "kruskal_wallis",
    """WITH r AS (SELECT l_returnflag, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS r FROM lineitem), g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY 1),
    t AS (SELECT sum(n) AS n, count(*)::DOUBLE AS k, sum(s * s / n) AS q FROM g) SELECT n, k, round(12 / (n * (n + 1)) * q - 3 * (n + 1), 4) AS h, round(greatest((12 / (n * (n + 1)) * q - 3 * (n + 1) - k + 1) / (n - k), 0), 6) AS eta2 FROM t""",
)
def kruskal_wallis(spark, sf_dir):
    return rounded(stats.kruskal(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice").withColumn("h", F.round("h", 4)))


@register(
    "cluster_quality",
    """WITH l AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c, count(*) AS n FROM l GROUP BY 1, 2), g AS (SELECT i, avg(x) AS g FROM l GROUP BY 1),
    d AS (SELECT label, vec_id, sqrt(sum((x - c) ** 2)) AS d FROM l JOIN c USING (label, i) GROUP BY 1, 2), w AS (SELECT label, avg(d) AS s, sum(d * d) AS w, count(*) AS n FROM d GROUP BY 1), b AS (SELECT sum(n * (c - g) ** 2) AS b FROM c JOIN g USING (i)),
    a AS (SELECT p.label AS x, q.label AS y, sqrt(sum((p.c - q.c) ** 2)) AS a FROM c p JOIN c q ON p.i = q.i AND p.label <> q.label GROUP BY 1, 2), r AS (SELECT x, max((m.s + o.s) / a.a) AS r FROM a JOIN w m ON m.label = x JOIN w o ON o.label = y GROUP BY 1)
    SELECT round((SELECT b FROM b) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 5) AS calinski_harabasz, (SELECT round(avg(r), 5) FROM r) AS davies_bouldin FROM w""",
)
def cluster_quality(spark, sf_dir):
    return rounded(stats.cluster_scores(read(spark, sf_dir, "embeddings"), "embedding", "label"), 5)
