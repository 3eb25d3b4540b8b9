"""Preparation, panels, scans and stores that stand on the other operators."""

from __future__ import annotations

import json
import math
from hashlib import sha256
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numeric import nan_to_null, ratio
from fathomline.functions.windows import drop_halo, rows, sequenced
from fathomline.operators.algorithms import Algorithm, register
from fathomline.operators.backtest import sharpe
from fathomline.operators.stats import benjamini_hochberg, normal_p, spearman, t_statistic


@register
class Resilience(Algorithm):
    """Recoveries of depth: an event starts when depth falls by ``drop``; it has recovered when ``share`` of the fall is back.
    Averages over the events of the last ``keep`` ticks."""

    name, needs, makes, warmup = "resilience", ("depth",), ("events", "recovery_ticks", "recovered_share"), 1
    drop, share, keep, live = 0.2, 0.5, 200, 10

    def reset(self):
        super().reset()
        self._last, self._open, self._done, self._t = None, [], [], 0

    def update(self, tick):
        d, self._t = tick["depth"], self._t + 1
        for e in list(self._open):
            if d >= e[1] + self.share * (e[2] - e[1]):
                self._open.remove(e)
                self._done.append((self._t, self._t - e[0], True))
            elif self._t - e[0] >= 100:
                self._open.remove(e)
                self._done.append((self._t, 100, False))
        if self._last and d < self._last * (1 - self.drop) and len(self._open) < self.live:
            self._open.append((self._t, d, self._last))
        self._last = d
        self._done = [e for e in self._done if self._t - e[0] <= self.keep]
        n = len(self._done)
        return {"events": float(n + len(self._open)), "recovery_ticks": sum(e[1] for e in self._done) / n if n else 0.0, "recovered_share": sum(e[2] for e in self._done) / n if n else 0.0}


@register
class MediumFrequency(Algorithm):
    """Three exponential averages seeded with the first price, their crosses in bps, and Wilder's RSI and true range of bars
    of ``ticks`` ticks."""

    name, needs, makes, warmup = "medium_frequency", ("price",), ("ema_fast", "ema_slow", "cross_bps", "rsi", "atr"), 0
    fast, slow, ticks, n = 60, 300, 20, 14

    def reset(self):
        super().reset()
        self._e, self._bar, self._close, self._g, self._l, self._a, self._bars = None, [], None, 0.0, 0.0, 0.0, 0
        self._gains: list[float] = []

    def update(self, tick):
        p = tick["price"]
        self._e = [p, p] if self._e is None else [e + 2 / (n + 1) * (p - e) for e, n in zip(self._e, (self.fast, self.slow))]
        self._bar.append(p)
        if len(self._bar) == self.ticks:
            self._finish()
        rsi = 50.0 if self._g == self._l == 0 else 100.0 if self._l == 0 else 100 - 100 / (1 + self._g / self._l)
        warm = self._bars > self.n
        return {"ema_fast": self._e[0], "ema_slow": self._e[1], "cross_bps": (self._e[0] / self._e[1] - 1) * 1e4 if self._e[1] else 0.0, "rsi": rsi if warm else 50.0, "atr": self._a if warm else 0.0}

    def _finish(self):
        hi, lo, c = max(self._bar), min(self._bar), self._bar[-1]
        if self._close is not None:
            d = c - self._close
            tr = max(hi - lo, abs(hi - self._close), abs(lo - self._close))
            k = min(self._bars, self.n)
            self._g, self._l, self._a = ((v * (k - 1) + x) / k if k else x for v, x in ((self._g, max(d, 0)), (self._l, max(-d, 0)), (self._a, tr)))
        self._bars, self._close, self._bar = self._bars + 1, c, []


def prepared(df: DataFrame, columns: list[str], most_missing: float = 0.5, least_variance: float = 1e-12, sigmas: float = 5.0) -> tuple[DataFrame, list[str]]:
    """Columns with too many missing values or no variance dropped, the rest filled by their median, clipped at ``sigmas``
    deviations and standardised. The statistics are a row; two passes."""
    x = {c: nan_to_null(F.col(c).cast("double")) for c in columns}
    s = df.agg(*[F.struct(F.avg(v.isNull().cast("double")).alias("m"), F.var_pop(v).alias("v"), F.avg(v).alias("a"), F.median(v).alias("d")).alias(c) for c, v in x.items()]).first()
    good = [c for c in columns if s[c]["m"] is not None and s[c]["m"] <= most_missing and (s[c]["v"] or 0.0) > least_variance]
    out = {}
    for c in good:
        a, sd = s[c]["a"], math.sqrt(s[c]["v"])
        z = (F.coalesce(x[c], F.lit(s[c]["d"])) - a) / sd
        out[c] = F.least(F.greatest(z, F.lit(-sigmas)), F.lit(sigmas))
    return df.select([out[c].alias(c) if c in out else F.col(c) for c in df.columns if c not in columns or c in good]), good


def time_weighted(df: DataFrame, value: str, n: int, least: float = 0.8, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
    """``twa``: mean of the last n cells of a regular grid, null where fewer than the share ``least`` of them has a value."""
    k = list(keys)
    d = sequenced(df, k, list(order), order[0], n)
    w = rows(k, n - 1)
    return drop_halo(d.withColumn("twa", F.when(F.count(value).over(w) >= least * n, F.avg(value).over(w)))).drop("_n")


def account_panel(positions: DataFrame, ts: str = "ts_ms", wallet: str = "wallet") -> DataFrame:
    """Positions by coin as accounts: the account value (the same on each row) and the summed unrealised profit."""
    return positions.groupBy(ts, wallet).agg(F.min("account_value").alias("account_value"), F.sum("unrealized_pnl").alias("unrealized_pnl"), F.count(F.lit(1)).alias("coins"))


def net_positioning(positions: DataFrame, members: DataFrame, ts: str, wallet: str, as_of: int) -> DataFrame:
    """Signed position value of the members over their account value, at the latest time not after ``as_of``."""
    d = positions.where(F.col(ts) <= as_of).join(members.select(wallet).distinct(), wallet, "left_semi")
    last = d.agg(F.max(ts).alias("_t"))
    now = d.join(F.broadcast(last), F.col(ts) == F.col("_t"))
    by = now.groupBy(wallet).agg(F.sum("position_value").alias("v"), F.min("account_value").alias("a"))
    return by.agg(ratio(F.sum("v"), F.sum("a")).alias("net_positioning"), F.count(F.lit(1)).alias("wallets"))


def bimodality(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(skewness^2 + 1) / kurtosis, population moments: above 5/9 hints at two modes."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    d = F.col(value) - F.col("_m")
    s = df.join(m, keys).groupBy(*keys).agg(F.avg(d * d).alias("a"), F.avg(d * d * d).alias("b"), F.avg(d * d * d * d).alias("c"))
    skew2, kurt = F.col("b") * F.col("b") / F.pow(F.col("a"), F.lit(3)), F.col("c") / (F.col("a") * F.col("a"))
    return s.select(*keys, F.when(F.col("a") > 1e-18, (skew2 + 1) / kurt).alias("bimodality"))


def tails(df: DataFrame, features: list[str], forward: str, keys: list[str], shares: tuple[float, ...] = (0.05, 0.95)) -> DataFrame:
    """For each key, feature and tail: rows, mean forward return in bps, p of its difference from zero, and q over all tails.
    One unpivot, one table of cut points, one pass."""
    cut = F.array(*[F.lit(s) for s in shares])
    long = df.where(F.col(forward).isNotNull()).select(*keys, F.col(forward).alias("_f"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("r")).select(*keys, "_f", "r.*").where(F.col("v").isNotNull())
    cuts = long.groupBy(*keys, "feature").agg(F.percentile("v", cut).alias("_q"))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    t = long.join(F.broadcast(cuts), [*keys, "feature"]).withColumn("tail", F.when(F.col("v") <= lo, "low").when(F.col("v") >= hi, "high")).where(F.col("tail").isNotNull())
    s = t.groupBy(*keys, "feature", "tail").agg(F.count(F.lit(1)).alias("n"), F.avg("_f").alias("_a"), F.stddev_samp("_f").alias("_s"))
    s = s.withColumn("p", F.when(F.col("_s") > 0, normal_p(F.col("_a") / F.col("_s") * F.sqrt("n"))))
    return benjamini_hochberg(s.withColumn("edge_bps", F.col("_a") * 1e4).drop("_a", "_s"))


def conjunctions(df: DataFrame, conditions: dict[str, Column], forward: str, keys: list[str]) -> DataFrame:
    """Rows and mean forward return where two conditions hold together, for each pair; one pass."""
    names = list(conditions)
    aggs = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = conditions[a] & conditions[b]
            aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(both & F.col(forward).isNotNull(), 1)).alias("n"), F.avg(F.when(both, F.col(forward))).alias("mean_forward")).alias(f"{a}|{b}"))
    one = df.groupBy(*keys).agg(*aggs)
    return one.select(*keys, F.explode(F.array(*[F.col(f"`{x}`") for x in one.columns[len(keys) :]])).alias("r")).select(*keys, "r.*")


def daily_ic(df: DataFrame, x: str, y: str, day: Column, keys: list[str], least: int = 5) -> DataFrame:
    """Rank correlation for each day, and whether it is of the sign of the whole."""
    d = spearman(df.withColumn("day", day), x, y, [*keys, "day"]).where(F.col("n") >= least)
    whole = spearman(df, x, y, keys).select(*keys, F.signum("ic").alias("_s"))
    return d.join(whole, keys).withColumn("agrees", F.signum("ic") == F.col("_s")).drop("_s")


def ic_table(df: DataFrame, features: list[str], forwards: list[str], keys: list[str]) -> DataFrame:
    """Rank correlations of every feature with every forward return by key, p, and q over the whole table: one unpivot."""
    f = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features]))
    h = F.explode(F.array(*[F.struct(F.lit(c).alias("horizon"), F.col(c).alias("y")) for c in forwards]))
    long = df.select(*keys, *forwards, f.alias("f")).select(*keys, "f.*", h.alias("h")).select(*keys, "feature", "x", "h.*")
    ic = spearman(long, "x", "y", [*keys, "feature", "horizon"])
    return benjamini_hochberg(ic.withColumn("p", normal_p(t_statistic(F.col("ic"), F.col("n")))))


def purged_scores(df: DataFrame, pnl: str, number: str, keys: list[str], groups: int, test: int, embargo: int) -> DataFrame:
    """For each key and combinatorial purged split: in-sample and out-of-sample Sharpe ratios.

    A key's rows are numbered 0 .. n - 1 and cut into ``groups`` blocks; a split holds out ``test`` of them, and leaves out
    training rows within ``embargo`` rows of a held-out block. Rows meet their splits where they are and are aggregated
    before the shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    d = df.join(F.broadcast(counts), keys)  # a row for each key
    i = F.col(number)
    edge = lambda g: F.floor(F.col("_rows") * g / groups)
    own = F.size(F.filter(F.sequence(F.lit(1), F.lit(groups - 1)), lambda g: edge(g) <= i))
    picks = F.array(*[F.array(*[F.lit(g) for g in p]) for p in combinations(range(groups), test)])
    d = d.withColumn("_own", own).select(*keys, pnl, i.alias("_i"), "_own", "_rows", F.posexplode(picks).alias("split", "_pick"))
    held = F.array_contains("_pick", F.col("_own"))
    i_ = F.col("_i")
    near = F.exists("_pick", lambda g: (i_ >= edge(g) - embargo) & (i_ < edge(g + 1) + embargo))
    return d.groupBy(*keys, "split").agg(sharpe(F.when(~near, F.col(pnl))).alias("is_sharpe"), sharpe(F.when(held, F.col(pnl))).alias("oos_sharpe"))


def trailing_losses(df: DataFrame, keys: list[str], order: list, pnl: str) -> DataFrame:
    """Length of each key's last run of losses (null breaks it)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    d = df.withColumn("_k", F.row_number().over(w)).withColumn("_ok", ~F.coalesce(F.col(pnl) < 0, F.lit(False)))
    return d.groupBy(*keys).agg((F.coalesce(F.min(F.when(F.col("_ok"), F.col("_k"))), F.count(F.lit(1)) + 1) - 1).cast("long").alias("trailing_losses"))


def config_hash(config: dict) -> str:
    """First 16 hex digits of the SHA-256 of the JSON with sorted keys, ``_meta`` left out."""
    return sha256(json.dumps({k: v for k, v in config.items() if k != "_meta"}, sort_keys=True).encode()).hexdigest()[:16]


#: Which states a hypothesis may go to.
LIFECYCLE = {"proposed": {"testing", "rejected"}, "testing": {"validated", "rejected"}, "validated": {"paper", "rejected"}, "paper": {"live", "rejected"}, "live": {"retired"}, "rejected": set(), "retired": set()}


def advance(state: str, to: str) -> str:
    if to not in LIFECYCLE.get(state, set()):
        raise ValueError(f"{state} can't become {to}")
    return to


def illegal_transitions(history: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Steps of a history that the life cycle doesn't allow."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, to in LIFECYCLE.items() for b in sorted(to)])
    step = F.concat(before, F.lit(">"), F.col(state))
    return history.withColumn("step", step).where(F.col("step").isNotNull() & ~F.array_contains(allowed, F.col("step"))).select(key, order, "step")


def roster(payload: DataFrame, json: str = "payload") -> DataFrame:
    """Ranked wallets of a leaderboard payload; addresses that aren't 40 hex digits are left out."""
    rows_ = F.from_json(json, "struct<leaderboardRows: array<struct<ethAddress: string, accountValue: string, displayName: string>>>")
    d = payload.select(F.posexplode(rows_["leaderboardRows"]).alias("i", "r"))
    ok = F.lower("r.ethAddress").rlike("^0x[0-9a-f]{40}$")
    return d.where(ok).select((F.col("i") + 1).alias("rank"), F.lower("r.ethAddress").alias("wallet"), F.col("r.accountValue").try_cast("double").alias("account_value"))


def clearinghouse(payload: DataFrame, json: str = "payload") -> DataFrame:
    """Account payloads as a row for each position, and one of status ``empty`` for a flat account."""
    kind = "struct<marginSummary: struct<accountValue: string>, assetPositions: array<struct<position: struct<coin: string, szi: string, entryPx: string, positionValue: string, unrealizedPnl: string, liquidationPx: string>>>>"
    d = payload.withColumn("_p", F.from_json(json, kind))
    p = d.select(*payload.columns, F.col("_p.marginSummary.accountValue").try_cast("double").alias("account_value"), F.explode_outer("_p.assetPositions").alias("a"))
    n = lambda c: F.col(f"a.position.{c}").try_cast("double")
    return p.select(*[c for c in payload.columns if c != json], "account_value", F.col("a.position.coin").alias("coin"), n("szi").alias("size"), n("entryPx").alias("entry_price"), n("positionValue").alias("position_value"), n("unrealizedPnl").alias("unrealized_pnl"), n("liquidationPx").alias("liquidation_price"), F.when(F.col("a").isNull(), "empty").otherwise("ok").alias("status"))
