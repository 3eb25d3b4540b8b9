"""Information measures, clusters, states and panels beyond the basic statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.numeric import plogp, ratio
from fathomline.operators.stats import mutual_information, pearson, spearman


def adaptive_mi(df: DataFrame, x: str, y: str, keys: list[str], n: int) -> DataFrame:
    """Median of the binned mutual information at three bin counts around Sturges' rule for n rows."""
    k = max(3, math.ceil(math.log2(max(n, 2)) + 1))
    parts = [mutual_information(df, x, y, b, keys).withColumnRenamed("mi", f"m{i}") for i, b in enumerate((max(2, k // 2), k, 2 * k))]
    out = parts[0].join(parts[1], keys).join(parts[2], keys)
    m = F.array_sort(F.array("m0", "m1", "m2"))
    return out.select(*keys, F.get(m, F.lit(1)).alias("mi"))


def entropy_of(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Shannon entropy in bits of the joint values of ``columns``."""
    c = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    t = c.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    return t.groupBy(*keys).agg((F.sum(plogp(F.col("_c") / F.col("_n"))) / math.log(2)).alias("h"))


def conditional_mi(df: DataFrame, x: str, y: str, z: str, keys: list[str]) -> DataFrame:
    """I(x; y | z), I(x; y) and the interaction information I(x; y | z) - I(x; y) of discrete columns, by entropies."""
    h = {}
    for name, cols in {"x": [x], "y": [y], "z": [z], "xy": [x, y], "xz": [x, z], "yz": [y, z], "xyz": [x, y, z]}.items():
        h[name] = entropy_of(df, keys, cols).withColumnRenamed("h", f"_{name}")
    out = h["x"]
    for name in ("y", "z", "xy", "xz", "yz", "xyz"):
        out = out.join(h[name], keys)
    mi = F.col("_x") + F.col("_y") - F.col("_xy")
    cmi = F.col("_xz") + F.col("_yz") - F.col("_xyz") - F.col("_z")
    return out.select(*keys, F.greatest(mi, F.lit(0.0)).alias("mi"), F.greatest(cmi, F.lit(0.0)).alias("cmi"), (cmi - mi).alias("interaction"))


def linear_transfer_entropy(x: str, y: str, y_past: str) -> Column:
    """Bits that x adds to y's own past about y, Gaussian: 0.5 log2 of the ratio of residual variances, over a group."""
    a, b, c = pearson(y, y_past), pearson(y, x), pearson(x, y_past)
    full = 1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)
    return F.when((1 - a * a > 1e-12) & (full > 1e-12), 0.5 * F.log2((1 - a * a) / full)).otherwise(0.0)


def walk_forward_correlation(df: DataFrame, x: str, y: str, keys: list[str], order: list, folds: int = 5) -> DataFrame:
    """For folds 1 .. folds - 1: correlation over all rows before the fold and within it, and their ratio."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_i": i, "_c": n}).withColumn("_f", F.least(F.floor(F.col("_i") * folds / F.col("_c")), F.lit(folds - 1)))
    d = d.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("_f"), F.lit(1)), F.lit(folds - 1))))
    inside, before = F.col("_f") == F.col("fold"), F.col("_f") < F.col("fold")
    on = lambda c, v: F.when(c, F.col(v))
    out = d.groupBy(*keys, "fold").agg(pearson(on(before, x), on(before, y)).alias("is_corr"), pearson(on(inside, x), on(inside, y)).alias("oos_corr"))
    return out.withColumn("ratio", ratio("oos_corr", "is_corr"))


def expanding_ic(df: DataFrame, x: str, y: str, keys: list[str], ordered: str, ends: list[int]) -> DataFrame:
    """Rank correlation over the first n rows for each n of ``ends``; ``ordered`` numbers the rows from 0."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("end", F.explode(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e > F.col(ordered))))
    return spearman(d, x, y, [*keys, "end"]).where(F.col("n") == F.col("end"))


def breakeven_bps(df: DataFrame, keys: list[str], order: list, signal: str, forward: str) -> DataFrame:
    """Mean of sign(signal) * forward over the mean change of sign, in bps: the cost at which the signal earns nothing."""
    s = F.signum(signal)
    d = df.withColumn("_p", s * F.col(forward)).withColumn("_t", F.abs(s - F.lag(s).over(Window.partitionBy(*keys).orderBy(*order))))
    return d.groupBy(*keys).agg(ratio(F.avg("_p"), F.avg("_t")).alias("_b")).select(*keys, (F.col("_b") * 1e4).alias("breakeven_bps"))


def sign_persistence(df: DataFrame, keys: list[str], order: list, value: str, horizons: tuple[int, ...]) -> DataFrame:
    """P(same sign h rows later), for each horizon, rows of zero left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    s = F.signum(value)
    d = df.select(*keys, *[F.when((s != 0) & (F.lead(s, h).over(w) != 0), (F.lead(s, h).over(w) == s).cast("double")).alias(f"p_{h}") for h in horizons])
    return d.groupBy(*keys).agg(*[F.avg(f"p_{h}").alias(f"p_same_{h}") for h in horizons])


def rank_persistence(df: DataFrame, date: str, key: str, value: str, lags: tuple[int, ...]) -> DataFrame:
    """For each lag in dates: mean over dates of the correlation of cross-sectional ranks (ordinal, ties by key) with
    those ``lag`` rows of the key earlier."""
    r = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(date).orderBy(value, key)))
    w = Window.partitionBy(key).orderBy(date)
    r = r.select(date, F.col("_r"), *[F.lag("_r", k).over(w).alias(f"_l{k}") for k in lags])
    per = r.groupBy(date).agg(*[pearson("_r", f"_l{k}").alias(f"c{k}") for k in lags], *[F.count(f"_l{k}").alias(f"n{k}") for k in lags])
    one = per.agg(*[F.avg(F.when(F.col(f"n{k}") >= 3, F.col(f"c{k}"))).alias(f"c{k}") for k in lags])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("autocorr")) for k in lags])).alias("r")).select("r.*")


def l2_summary(snapshots: DataFrame, key: str = "symbol", least: int = 1) -> DataFrame:
    """Of snapshots in order (status ok): median and 90th percentile half-spread, median touch and depth, share seen."""
    seen = snapshots.groupBy(key).agg(F.count(F.lit(1)).alias("seen"))
    ok = snapshots.where("status = 'ok'").groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.median("half_spread_bps").alias("median_half_spread"), F.percentile("half_spread_bps", F.lit(0.9)).alias("p90_half_spread"),
        F.median("touch").alias("median_touch"), F.median("depth").alias("median_depth"),
    )
    return seen.join(ok, key, "left").where(F.coalesce("n", F.lit(0)) >= least).withColumn("ok_share", F.coalesce("n", F.lit(0)) / F.col("seen"))


def admission(summary: DataFrame, ceilings: dict[str, float], floors: dict[str, float]) -> DataFrame:
    """``failed``: every limit that a row breaks, comma-separated; ``admitted``: none."""
    checks = [F.when(F.col(c) > v, F.lit(c)) for c, v in ceilings.items()] + [F.when(F.col(c) < v, F.lit(c)) for c, v in floors.items()]
    return summary.withColumn("failed", F.concat_ws(",", *checks)).withColumn("admitted", F.col("failed") == "")


def tradability_curve(summary: DataFrame, column: str, ceilings: list[float]) -> DataFrame:
    """How many rows stay at or below each ceiling; one pass."""
    one = summary.agg(*[F.count(F.when(F.col(column) <= c, 1)).alias(f"c{i}") for i, c in enumerate(ceilings)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("ceiling"), F.col(f"c{i}").alias("admitted")) for i, c in enumerate(ceilings)])).alias("r")).select("r.*")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency counts."""
    pairs = lambda c: c * (c - 1) / 2
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("c"))
    s = n.agg(F.sum(pairs(F.col("c"))).alias("s"), F.sum("c").alias("n"))
    ra = n.groupBy(a).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("a"))
    rb = n.groupBy(b).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("b"))
    one = s.crossJoin(ra).crossJoin(rb)  # a row each
    e = F.col("a") * F.col("b") / pairs(F.col("n"))
    return one.select(ratio(F.col("s") - e, (F.col("a") + F.col("b")) / 2 - e, 1.0).alias("ari"))


def k_means(df: DataFrame, vector: str, k: int, seed: int = 1) -> DataFrame:
    """``cluster`` by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(d).transform(d).drop("_v")


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """``pc``: the first k components of the centred vectors, each direction's largest loading positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    d = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(d).transform(d)
    m = PCA(k=k, inputCol="_c", outputCol="_p").fit(d)
    load = m.pc.toArray()
    sign = [float(np.sign(load[np.abs(load[:, i]).argmax(), i]) or 1) for i in range(k)]
    p = vector_to_array("_p")
    return m.transform(d).withColumn("pc", F.array(*[p[i] * sign[i] for i in range(k)])).drop("_v", "_c", "_p")


def hmm_forward(obs: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> float:
    """Log likelihood of a sequence of symbols."""
    a, out = start * emit[:, obs[0]], 0.0
    for o in [None, *obs[1:]]:
        a = a if o is None else (a @ trans) * emit[:, o]
        s = a.sum()
        out += math.log(max(s, 1e-300))
        a = a / max(s, 1e-300)
    return out


def _first_model(states: int, symbols: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return np.full(states, 1 / states), 0.7 * np.eye(states) + 0.3 * rng.dirichlet(np.ones(states) * 5, states), rng.dirichlet(np.ones(symbols) * 5, states)


def _expected(sequences, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions of sequences under a model."""
    start, trans, emit = model
    states = len(start)
    s, t, e = np.zeros(states), np.zeros((states, states)), np.zeros(emit.shape)
    for o in sequences:
        f, b = np.zeros((len(o), states)), np.ones((len(o), states))
        for i, x in enumerate(o):
            f[i] = (start if i == 0 else f[i - 1] @ trans) * emit[:, x]
            f[i] /= max(f[i].sum(), 1e-300)
        for i in range(len(o) - 2, -1, -1):
            b[i] = trans @ (emit[:, o[i + 1]] * b[i + 1])
            b[i] /= max(b[i].sum(), 1e-300)
        g = f * b
        g /= g.sum(axis=1, keepdims=True)
        s += g[0]
        np.add.at(e.T, o, g)
        x = f[:-1, :, None] * trans * (emit[:, o[1:]].T * b[1:])[:, None, :]
        t += (x / np.maximum(x.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
    return s, t, e


def _normalised(s: np.ndarray, t: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, t, e = s + 1e-3, t + 1e-3, e + 1e-3
    return s / s.sum(), t / t.sum(axis=1, keepdims=True), e / e.sum(axis=1, keepdims=True)


def baum_welch(sequences: list[np.ndarray], states: int, symbols: int, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities fitted to sequences in memory."""
    model = _first_model(states, symbols, seed)
    for _ in range(rounds):
        model = _normalised(*_expected(sequences, model))
    return model


def fit_hmm(df: DataFrame, keys: list[str | Column], order: str, symbol: str, states: int, symbols: int, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``baum_welch`` on all rows of ``df``: a sequence for each value of ``keys``, which should bound its length.

    Expectations are summed up in each partition; each round brings the driver the sums of a model's numbers.
    """
    keys = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    pieces = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(symbol).alias("s")))).alias("p")).select(F.transform("p", lambda x: x["s"]).alias("s")).persist()
    model = _first_model(states, symbols, seed)
    sizes = [states, states * states, states * symbols]
    for _ in range(rounds):

        def sums(batches, model=model):
            total = np.zeros(sum(sizes))
            for batch in batches:
                got = _expected([np.array(x, int) for x in batch.column(0).to_pylist()], model)
                total += np.concatenate([x.ravel() for x in got])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

        rows = {r["i"]: r["x"] for r in pieces.mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
        flat = np.array([rows.get(i, 0.0) for i in range(sum(sizes))])
        s, t, e = np.split(flat, np.cumsum(sizes)[:-1])
        model = _normalised(s, t.reshape(states, states), e.reshape(states, symbols))
    pieces.unpersist()
    return model


def viterbi(obs: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        ls, lt, le = np.log(start), np.log(trans), np.log(emit)
    v, back = ls + le[:, obs[0]], []
    for o in obs[1:]:
        m = v[:, None] + lt
        back.append(m.argmax(axis=0))
        v = m.max(axis=0) + le[:, o]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def decoded_states(df: DataFrame, key: str, order: str, symbol: str, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(key, order, state): the likeliest path of each key's sequence."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf[[key, order]].assign(state=viterbi(pdf[symbol].to_numpy(int), *model))

    return df.select(key, order, symbol).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, state int")


def _episodes(t: np.ndarray, gap: int, until: int | None) -> tuple[np.ndarray, int | None]:
    """Anchors of the ascending times ``t`` that begin an episode, given when the one before ends, and when the last ends."""
    anchors, at = [], 0 if until is None else int(np.searchsorted(t, until, "right"))
    while at < len(t):
        anchors.append(int(t[at]))
        until = anchors[-1] + gap
        at = int(np.searchsorted(t, until, "right"))
    return np.array(anchors, np.int64), until


def lead_lag(entries: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Episodes of entries, each anchored at its first entry and ``gap_seconds`` long; for each key the number of episodes it
    takes part in, how often it is first (of keys at the same time, the smallest), and its mean delay.

    Times are cut into pieces of eight gaps. A piece says where the last episode ends for each time at which the one before
    it may end; the driver follows these ends from piece to piece, a few numbers each. Then every piece knows its anchors,
    and what an episode has in several pieces meets in an aggregate. An episode thus runs on over any cut.
    """
    gap, kind = gap_seconds * 1_000_000, entries.schema[key].dataType.simpleString()
    e = entries.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).withColumn("piece", F.floor(F.col("t") / (8 * gap)))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        t, piece = np.unique(pdf["t"].to_numpy(np.int64)), int(pdf["piece"].iloc[0])
        # Only ends inside the piece's first gap are possible besides none at all; equal results are one row.
        starts = [None, *t[t <= piece * 8 * gap + gap].tolist()]
        out, last = [], object()
        for s in starts:
            end = _episodes(t, gap, s)[1]
            if end != last:
                out.append((piece, s, end))
                last = end
        return pd.DataFrame(out, columns=["piece", "since", "until"])

    table: dict[int, list] = {}
    for r in e.groupBy("piece").applyInPandas(ends, "piece long, since long, until long").collect():
        table.setdefault(r["piece"], []).append((r["since"], r["until"]))
    until, before = None, []
    for piece in sorted(table):
        before.append((piece, until))
        known = sorted((s, u) for s, u in table[piece] if s is not None)
        first = next(u for s, u in table[piece] if s is None)
        if until is None or until < piece * 8 * gap:
            until = first
        else:
            reach = [u for s, u in known if s <= until]
            until = max(until, reach[-1] if reach else first)
    schema = "piece long, before long"
    given = e.join(F.broadcast(entries.sparkSession.createDataFrame(before, schema)), "piece")  # two numbers a piece

    def anchored(pdf: pd.DataFrame) -> pd.DataFrame:
        t, start = pdf["t"].to_numpy(np.int64), pdf["before"].iloc[0]
        start = None if pd.isna(start) else int(start)
        anchors, _ = _episodes(np.unique(t), gap, start)
        if start is not None:
            anchors = np.concatenate(([start - gap], anchors))
        own = anchors[np.searchsorted(anchors, t, "right") - 1]
        return pd.DataFrame({"anchor": own, "key": pdf["key"], "t": t}).groupby(["anchor", "key"], as_index=False)["t"].min()

    got = given.groupBy("piece").applyInPandas(anchored, f"anchor long, key {kind}, t long").groupBy("anchor", "key").agg(F.min("t").alias("t"))
    led = got.groupBy("anchor").agg(F.min(F.struct("t", "key")).alias("_first"))
    got = got.join(led, "anchor")
    delay = (F.col("t") - F.col("anchor")) / 1_000_000
    return got.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("episodes"), F.count(F.when(F.col("_first.key") == F.col("key"), 1)).alias("led"), F.avg(delay).alias("mean_delay_s"))


def conditional_predictability(df: DataFrame, x: str, y: str, z: str, keys: list[str], buckets: int = 3) -> DataFrame:
    """Rank correlation of x and y within each quantile bucket of z."""
    cuts = df.where(F.col(z).isNotNull()).groupBy(*keys).agg(F.percentile(z, F.array(*[F.lit(i / buckets) for i in range(1, buckets)])).alias("_q"))
    d = df.where(F.col(z).isNotNull()).join(F.broadcast(cuts), keys).withColumn("bucket", F.size(F.filter("_q", lambda q: q < F.col(z))))
    return spearman(d, x, y, [*keys, "bucket"])
