"""Operators that SQL can't express, planted signals, edge cases, readers, sinks and streams."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline import schema
from fathomline.functions import windows
from fathomline.operators import alerts, backtest, bars, discovery, execution, extras, liquidity, models, offline, price, regime, signals, stats
from fathomline.operators import algorithms as alg
from fathomline.operators import book as books
from fathomline.sources import readers, writers
from fathomline.streaming import live


@pytest.fixture(scope="module")
def tape(spark):
    rng = random.Random(1)
    rows, t = [], 0
    for i in range(3000):
        t += rng.randrange(1, 900)
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), "AB"[rng.random() < 0.2], 100 + 5 * math.sin(i / 30) + rng.random(), float(rng.randrange(1, 9)), rng.random() < 0.5))
    return spark.createDataFrame(rows, "tid long, ts timestamp, symbol string, price double, size double, is_buy boolean").cache()


def test_halo_frames_equal_whole_frames(spark, tape):
    from pyspark.sql import Window

    whole = Window.partitionBy("symbol").orderBy(windows.micros("ts")).rangeBetween(-3600 * 10**6, 0)
    want = {r.tid: r.s for r in tape.select("tid", F.sum("size").over(whole).alias("s")).collect()}
    for bucket in (1800, 3600, 20_000):
        d = windows.time_halo(tape, "ts", 3600, bucket_seconds=bucket)
        got = windows.drop_halo(d.withColumn("s", F.sum("size").over(windows.time_frame(["symbol"], "ts", 3600)))).collect()
        assert {r.tid: r.s for r in got} == want and len(got) == 3000
    by_row = Window.partitionBy("symbol").orderBy("ts", "tid").rowsBetween(-9, 3)
    want = {r.tid: r.s for r in tape.select("tid", F.sum("size").over(by_row).alias("s")).collect()}
    for bucket in (15, 100, 5000):
        d = windows.row_halo(windows.numbered(tape, ["symbol"], ["ts", "tid"], "ts"), 9, 3, bucket_rows=bucket)
        got = windows.drop_halo(d.withColumn("s", F.sum("size").over(windows.rows(["symbol"], 9, 3)))).collect()
        assert {r.tid: r.s for r in got} == want and len(got) == 3000


def test_numbers_are_gapless(tape):
    got = windows.numbered(tape, ["symbol"], ["ts", "tid"], "ts", 3600).groupBy("symbol").agg(F.count("*").alias("n"), F.min("_n").alias("a"), F.max("_n").alias("b"), F.countDistinct("_n").alias("d")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 and r.d == r.n for r in got)


def test_empty_tape(spark, tape):
    from fathomline.operators import tape as t

    none = tape.limit(0)
    assert t.flow_block(none).count() == 0 and price.trend_block(none).count() == 0 and liquidity.lambdas(none, 100).count() == 0


@pytest.mark.parametrize(("seconds", "decay"), [(3600, 0.0005), (7200, 0.02), (3600, 0.0), (40_000, 0.5), (5000, 3000.0)])
def test_hawkes_equals_its_definition(spark, tape, seconds, decay):
    from fathomline.operators import tape as t

    # Trades at one time see each other.
    both = tape.union(tape.where("tid % 7 = 0").withColumn("tid", F.col("tid") + 10_000)).union(tape.where("tid % 5 = 0").selectExpr("tid + 20000", "ts + INTERVAL 500 MICROSECONDS", "symbol", "price", "size", "is_buy"))
    rows = both.toPandas()
    at = rows.ts.astype("datetime64[us]").astype("int64").to_numpy()
    got = t.hawkes_block(both, seconds, decay=decay).toPandas().set_index("tid")
    assert len(got) == len(rows)
    for i in range(0, len(rows), 3):
        ages = (at[i] - at[(rows.symbol == rows.symbol[i]).to_numpy() & (at <= at[i]) & (at >= at[i] - seconds * 10**6)]) / 1e6
        n, row = len(ages), got.loc[rows.tid[i]]
        assert row.hawkes_mu == pytest.approx(n / seconds if n >= 2 else 0.0)
        assert row.hawkes_excitation == pytest.approx(0.5 * np.exp(-decay * ages).sum() if n >= 2 else 0.0, rel=1e-11)


def test_hawkes_forms_no_list_of_ages(tape):
    from fathomline.operators import tape as t

    plan = t.hawkes_block(tape, 3600, decay=0.0005)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan


def test_vpin_by_hand():
    size, side = np.array([5.0, 5, 5, 5]), np.array([1, 1, -1, -1])
    assert liquidity.vpin(size, side, 2) == 1.0 and liquidity.vpin(size, np.array([1, -1, 1, -1]), 2) == 0.0
    assert liquidity.vpin(np.array([]), np.array([]), 5) == 0.0


def test_hurst_orders_series():
    rng = np.random.default_rng(0)
    e = rng.standard_normal(4000)
    trend, noise = np.cumsum(np.convolve(e, np.ones(50) / 50, "same")), e
    assert price.hurst(trend) > 0.8 > price.hurst(np.cumsum(e)) > 0.4 > price.hurst(noise) and price.hurst([1, 2, 3]) == 0.5


def test_book_edges(spark):
    df = spark.createDataFrame([(1, [], []), (2, [(10.0, 1.0, 1)], []), (3, [(11.0, 1.0, 1)], [(10.0, 1.0, 1)]), (4, [(10.0, 1.0, 1)], [(10.0, 1.0, 1)]), (5, [(10.0, 0.0, 0)], [(11.0, 0.0, 0)])], f"id int, bids {books.LEVEL}, asks {books.LEVEL}")
    got = {r.id: r for r in books.flat_snapshot(books.imbalance_block(books.raw_block(df))).collect()}
    assert [got[i].status for i in range(1, 6)] == ["empty", "empty", "crossed", "locked", "ok"]
    assert got[1].raw_midprice == 0 and got[2].mid is None and got[3].spread is None and got[5].raw_microprice == 10.5 and got[5].imbalance_qty_l5 == 0


def test_as_of_is_causal(spark):
    left = spark.createDataFrame([(1, "a", dt.datetime.fromisoformat("2024-01-01 10:00")), (2, "a", dt.datetime.fromisoformat("2024-01-01 11:00")), (3, "b", dt.datetime.fromisoformat("2024-01-01 10:00")), (4, "a", dt.datetime.fromisoformat("2024-01-09"))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", dt.datetime.fromisoformat("2024-01-01 10:00"), 1.0), ("a", dt.datetime.fromisoformat("2024-01-01 10:30"), 2.0), ("b", dt.datetime.fromisoformat("2024-01-01 10:01"), 9.0)], "k string, u timestamp, v double")
    got = {r.id: r.v for r in bars.as_of(left, right, ["k"], "t", "u", ["v"], 86_400).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: None}
    assert {r.id: r.v for r in bars.as_of(left, right, ["k"], "t", "u", ["v"], 86_400, strict=True).collect()} == {1: None, 2: 2.0, 3: None, 4: None}


def test_planted_signal_is_found(spark):
    rng = np.random.default_rng(7)
    s, n = rng.standard_normal(3000), rng.standard_normal(3000)
    y = 0.15 * s + math.sqrt(1 - 0.15**2) * rng.standard_normal(3000)
    df = spark.createDataFrame(pd.DataFrame({"k": "x", "signal": s, "noise": n, "y": y}))
    found, none = (stats.spearman(df, c, "y", ["k"]).first().ic for c in ("signal", "noise"))
    assert abs(found - 0.15) < 0.05 and abs(none) < 0.05
    z = {c: stats.ksg_by_key(df, c, "y", "k", 1500, 10).first() for c in ("signal", "noise")}
    assert z["signal"].mi >= 0 and z["noise"].mi < 0.1


def test_ksg_on_a_known_value():
    rng = np.random.default_rng(0)
    r = 0.9
    x = rng.standard_normal(2000)
    y = r * x + math.sqrt(1 - r * r) * rng.standard_normal(2000)
    assert stats.ksg(x, y) == pytest.approx(-0.5 * math.log2(1 - r * r), abs=0.12) and stats.ksg(x, rng.standard_normal(2000)) < 0.08


def test_normal_p_and_fdr(spark):
    from statistics import NormalDist

    zs = [0.0, 0.5, 1.96, -3.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(stats.normal_p(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(2 * (1 - NormalDist().cdf(abs(z))), abs=1e-6) for r, z in zip(got, zs))
    p = [0.01, 0.04, 0.03, None, 0.5]
    q = {r.i: r.q for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    assert q[0] == pytest.approx(0.04) and q[1] == q[2] == pytest.approx(0.16 / 3) and q[3] is None and q[4] == 0.5


def test_mixture_separates():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (200, 2)), rng.normal(8, 1, (200, 2))])
    m = regime.fit_mixture(x, 2)
    centres = sorted((m.means * m.scale + m.mean)[:, 0])
    assert abs(centres[0]) < 0.5 and abs(centres[1] - 8) < 0.5


def test_backtest_exits():
    s, c = backtest.Strategy(stop=0.05, target=0.05, hold=3), backtest.Costs(0, 0)
    run = lambda p, e, x=None: [(t["entry"], t["exit"], t["reason"]) for t in backtest.simulate(np.array(p, float), np.array(e, bool), np.array(x or [0] * len(p), bool), s, c)]
    assert run([100, 90, 100], [1, 1, 0]) == [(0, 1, "stop")]
    assert run([100, 106, 100, 100], [1, 1, 1, 0]) == [(0, 1, "target"), (2, 3, "end")]
    assert run([100, 100, 100, 100, 100], [1, 0, 0, 0, 0]) == [(0, 3, "time")]
    assert run([100, 101, 101], [1, 0, 0], [0, 1, 0]) == [(0, 1, "signal")] and run([], []) == []
    assert backtest.simulate(np.array([100.0, 100, 100]), np.array([1, 0, 0], bool), np.array([0, 1, 0], bool), s, backtest.Costs(5, 5))[0]["pnl"] == pytest.approx(-0.002)


def test_purged_splits_and_deflated_sharpe():
    splits = backtest.purged_splits(60, 6, 2, 3)
    assert len(splits) == 15
    for train, test in splits:
        assert not set(train) & set(test) and all(min(abs(i - j) for j in test) > 3 for i in train)
    assert backtest.deflated_sharpe(0.1, 1, 1000, 0.01) > 0.99 > backtest.deflated_sharpe(0.1, 1000, 1000, 0.01)


def test_recursions(spark):
    x = np.array([1.0, 2, 3, 4])
    assert offline.ewm(x, 0.5).tolist() == [1.0, 1.5, 2.25, 3.125]
    assert offline.ewm(x, 0.5, adjust=True).tolist() == pytest.approx(pd.Series(x).ewm(alpha=0.5).mean().tolist())
    assert np.isnan(offline.wilder(x, 3)[:2]).all() and offline.wilder(x, 3)[2:].tolist() == [2.0, pytest.approx(8 / 3)]


TICKS = ["imbalance", "entropy", "count", "price", "imbalance_l1", "imbalance_l5", "imbalance_l10", "funding", "signed_volume", "vpin", "spread", "vwap_deviation", "innovation", "value", "trend", "volatility", "momentum_short", "momentum_long", "width", "pct", "effective", "realized", "to_mark", "depth"]


@pytest.mark.parametrize("name", sorted(alg.REGISTRY))
def test_algorithm_contract(name):
    rng = np.random.default_rng(1)
    a = alg.REGISTRY[name]()
    out = [a.step({c: float(abs(rng.normal()) + 0.1) for c in TICKS}) for _ in range(a.warmup + 150)]
    values = np.array([list(o.values()) for o in out])
    assert list(out[0]) == [f"alg_{name}_{m}" for m in a.makes]
    assert np.isnan(values[: a.warmup]).all() and np.isfinite(values[a.warmup :]).all()
    before = vars(a).copy()["seen"]
    assert all(math.isnan(v) for v in a.step(dict.fromkeys(TICKS, float("nan"))).values()) and a.seen == before
    with pytest.raises(TypeError):
        alg.REGISTRY[name](no_such=1)


def test_batch_equals_steps(spark, tape):
    df = tape.withColumn("value", F.col("price"))
    got = alg.run(df, [alg.Welford(), alg.ChangePoint(limit=3.0)], carry=("tid",)).where("symbol = 'A'").orderBy("tid").toPandas()
    a, b = alg.Welford(), alg.ChangePoint(limit=3.0)
    for (_, row), v in zip(got.iterrows(), tape.where("symbol = 'A'").orderBy("tid").toPandas()["price"]):
        want = {**a.step({"value": v}), **b.step({"value": v})}
        assert all(row[k] == x or (math.isnan(row[k]) and math.isnan(x)) for k, x in want.items())


def test_feature_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1_704_067_200_000_000_000 + i * 10**9, "AB"[i % 2], i, float(i)) for i in range(10)], "timestamp_ns long, symbol string, sequence_id long, raw_midprice double")
    root = str(tmp_path / "t")
    writers.write_features(df, root)
    assert readers.feature_table(spark, root, ["A"], columns=["raw_midprice"]).count() == 5
    some = readers.feature_table(spark, root, start="2024-01-01", end="2024-01-01")
    assert some.count() == 10 and {str(r.dt) for r in some.select("dt").distinct().collect()} == {"2024-01-01"}
    assert readers.feature_table(spark, root, start="2024-01-02").count() == 0
    assert readers.feature_table(spark, root, end="2023-12-31").count() == 0
    writers.write_features(df.withColumn("timestamp_ns", F.col("timestamp_ns") + 86_400 * 10**9), root)
    later = readers.feature_table(spark, root, start="2024-01-02")
    assert later.count() == 10 and all("dt=2024-01-02" in f for f in later.inputFiles())
    back = spark.read.parquet(root).where("dt = '2024-01-01'")
    assert set(schema.features().fieldNames()) <= set(back.columns) and back.where("isnan(flow_vwap)").count() == 10
    df.write.parquet(str(tmp_path / "dated" / "2024-01-02-x"))
    df.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "dated" / "2024-01-03"))
    (tmp_path / "dated" / "2024-01-03" / "broken.parquet").write_bytes(b"no parquet at all")
    t = readers.feature_table(spark, str(tmp_path / "dated"), ["A"], start="2024-01-03", columns=["extra"])
    assert t.count() == 5 and t.columns == ["timestamp_ns", "symbol", "dt", "extra"]
    v = schema.validate_columns(["timestamp_ns", "odd"], schema.features(), {"hawkes_mu"})
    assert v["unexpected"] == ["odd"] and v["missing_optional"] == ["hawkes_mu"] and "symbol" in v["missing_base"]


def test_candles_and_predictions(spark, tmp_path):
    rows = [(dt.datetime.fromisoformat("2024-01-01"), 1.0, 2.0, 0.5, 1.5, 9.0)] * 2 + [(dt.datetime.fromisoformat("2024-01-03"), 1.0, 2.0, 0.5, 1.5, 9.0)]
    for s in ("BTC", "ETH"):
        spark.createDataFrame(rows, schema.CANDLES).coalesce(1).write.parquet(str(tmp_path / f"{s}_1h.parquet"))
    p = readers.candle_panel(spark, str(tmp_path), "1h", end="2024-01-02")
    assert sorted((r.symbol, str(r.timestamp.date())) for r in p.collect()) == [("BTC", "2024-01-01"), ("ETH", "2024-01-01")]
    writers.save_predictions(spark.createDataFrame([(dt.datetime.fromisoformat("2024-01-01"), 0.5), (dt.datetime.fromisoformat("2024-01-02"), float("nan"))], "timestamp timestamp, prediction double"), str(tmp_path / "p"), "m")
    assert [r.model_name for r in readers.predictions(spark, str(tmp_path / "p")).collect()] == ["m"]


def test_messages(spark):
    b = '{"coin":"BTC","time":5,"levels":[[{"px":"10","sz":"1","n":2},{"px":"oops","sz":"1","n":2}],[{"px":"11","sz":"3","n":1}]]}'
    t = '[{"coin":"BTC","side":"B","px":"10.5","sz":"2","time":7,"tid":3},{"coin":"BTC","side":"A","px":"x","sz":"1","time":8,"tid":4}]'
    m = readers.messages(spark.createDataFrame([("l2Book", b), ("trades", t), ("other", "{}"), ("l2Book", "not json")], "channel string, data string"))
    assert [r.kind for r in m.collect()] == ["book", "trades", "unknown", "book"]
    got = readers.parse_books(m.where("kind = 'book'")).collect()
    assert got[0].symbol == "BTC" and len(got[0].bids) == 1 and got[0].asks[0].px == 11 and got[1].bids == []
    trades = readers.parse_trades(m.where("kind = 'trades'")).collect()
    assert [(r.price, r.is_buy) for r in trades] == [(10.5, True), (None, False)]


def _stream(spark, df, path, parts):
    """``df`` as a file stream, a file for each of ``parts`` steps in time."""
    pdf = df.orderBy("ts").toPandas()
    for i, piece in enumerate(np.array_split(np.arange(len(pdf)), parts)):
        spark.createDataFrame(pdf.iloc[piece], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def _drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return stream.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_stream_bars_equal_batch(spark, tape, tmp_path):
    got = _drain(live.bars(_stream(spark, tape, str(tmp_path / "in"), 3), "1 day", "1 hour"), "bars")
    want = {(r.symbol, r.bar): r for r in bars.vwap_bars(tape, 86_400).collect()}
    assert len(got) >= 4
    for r in got:
        w = want[r.symbol, int(r.bar_start.timestamp()) // 86_400]
        assert (r.open, r.high, r.low, r.close, r.volume) == (w.open, w.high, w.low, w.close, w.volume) and r.vwap == pytest.approx(w.vwap)


def test_stream_algorithm_and_cooldown_equal_batch(spark, tape, tmp_path):
    df = tape.withColumn("value", F.col("price"))
    got = {(r.symbol, r.ts): r.alg_welford_z for r in _drain(live.algorithm(_stream(spark, df, str(tmp_path / "a"), 3), alg.Welford(), "1 hour"), "welford")}
    want = {(r.symbol, r.ts): r.alg_welford_z for r in alg.run(df, [alg.Welford()]).collect()}
    assert len(got) == 3000 and all(got[k] == v or (math.isnan(v) and math.isnan(got[k])) for k, v in want.items())
    fired = alerts.rules(tape, {"big": F.col("size") >= 8}, ["symbol", "ts"]).select("symbol", "alert", "ts")
    batch = {(r.symbol, r.ts) for r in alerts.cooldown(fired, 7200).collect()}
    assert {(r.symbol, r.ts) for r in _drain(live.cooled(_stream(spark, fired, str(tmp_path / "c"), 2), 7200, "1 hour"), "cooled")} == batch


def test_hmm_recovers_states():
    rng = np.random.default_rng(2)
    states = np.repeat([0, 1, 0, 1], 100)
    obs = np.where(rng.random(400) < 0.9, states, 1 - states)
    model = discovery.baum_welch([obs], 2, 2, rounds=30, seed=1)
    path = discovery.viterbi(obs, *model)
    assert max(np.mean(path == states), np.mean(path != states)) > 0.95
    assert discovery.hmm_forward(obs, *model) > discovery.hmm_forward(obs, np.full(2, 0.5), np.full((2, 2), 0.5), np.full((2, 2), 0.5))


def test_spectrum_and_tendency():
    rng = np.random.default_rng(3)
    t = np.arange(2048)
    f, p = signals.welch(np.sin(2 * np.pi * t / 16) + 0.1 * rng.standard_normal(2048))
    assert abs(f[p.argmax()] - 1 / 16) < 0.02
    flat, lumps = rng.uniform(size=(300, 2)), np.vstack([rng.normal(0, 0.02, (150, 2)), rng.normal(1, 0.02, (150, 2))])
    assert signals.hopkins(flat) < 0.65 < signals.hopkins(lumps)


def test_null_calibration_finds_the_planted_link(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(2000)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "_n": range(2000), "x": x, "y": 0.3 * x + rng.standard_normal(2000), "u": rng.standard_normal(2000)}))
    linked, free = (signals.null_calibrated(df, "x", c, ["k"]).first() for c in ("y", "u"))
    assert linked.z > 4 and linked.p < 0.06 and abs(free.value) < 0.1


def test_execution_by_hand(spark):
    fills = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 2, 1, 11.0), ("a", 3, -1, 12.0), ("a", 4, 1, 9.0)], "k string, o int, s int, p double")
    r = execution.fifo_pairs(fills, "k", "o", "s", "p").first()
    assert (r.pairs, r.unmatched, r.pnl) == (1, 2, 2.0)
    assert execution.no_trade_band(np.array([0.1, 1.0, 1.1, 0.2]), 0.5).tolist() == [0.0, 1.0, 1.0, 0.2]
    p = spark.range(1).select(execution.digital_probability(F.lit(100.0), F.lit(100.0), F.lit(0.2), F.lit(1.0)).alias("p")).first().p
    assert p == pytest.approx(0.460172, abs=1e-5)
    z = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 2.5, 1, 0.2, 3, 5, 0])], "k string, o int, z double")
    assert [(r.entry, r.exit, r.side, r.reason) for r in execution.pairs_trades(z, "z", "k", "o").orderBy("entry").collect()] == [(1, 3, -1, "exit"), (4, 5, -1, "stop")]


def test_payloads_and_life_cycle(spark):
    a = "0x" + "Ab" * 20
    p = spark.createDataFrame([('{"leaderboardRows":[{"ethAddress":"%s","accountValue":"5.5"},{"ethAddress":"nope","accountValue":"1"}]}' % a,)], "payload string")
    assert [(r.rank, r.wallet, r.account_value) for r in extras.roster(p).collect()] == [(1, a.lower(), 5.5)]
    c = spark.createDataFrame([("w", '{"marginSummary":{"accountValue":"9"},"assetPositions":[{"position":{"coin":"BTC","szi":"-2","entryPx":"3"}}]}'), ("v", '{"marginSummary":{"accountValue":"1"},"assetPositions":[]}')], "wallet string, payload string")
    assert sorted((r.wallet, r.coin, r.size, r.status) for r in extras.clearinghouse(c).collect()) == [("v", None, None, "empty"), ("w", "BTC", -2.0, "ok")]
    assert extras.advance("proposed", "testing") == "testing"
    with pytest.raises(ValueError):
        extras.advance("proposed", "live")
    assert extras.config_hash({"b": 1, "a": 2, "_meta": 3}) == extras.config_hash({"a": 2, "b": 1}) and len(extras.config_hash({})) == 16


def test_prepared_drops_and_fills(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan"), 5.0), (2, float("nan"), float("nan"), 5.0), (3, 3.0, 1.0, 5.0), (4, 100.0, float("nan"), 5.0)], "i int, x double, gaps double, same double")
    out, good = extras.prepared(df, ["x", "gaps", "same"], sigmas=1.0)
    assert good == ["x"] and out.columns == ["i", "x"] and all(-1 <= r.x <= 1 for r in out.collect())


def test_run_length_falls_at_a_change():
    a, rng = models.RunLength(), np.random.default_rng(5)
    x = np.concatenate([rng.normal(100, 1, 150), rng.normal(120, 1, 30)])
    out = [a.step({"value": float(v)})["alg_run_length_likeliest"] for v in x]
    assert out[148] > 100 and out[165] < 25


def test_gap_finds_three_clusters():
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.1, (60, 2)) for c in (0, 3, 6)])
    g = models.gap_statistic(x, 5, 5)
    assert max(g, key=lambda r: r[1])[0] == 3


def test_selection_takes_what_informs(spark):
    rng = np.random.default_rng(7)
    a, b, c = (rng.integers(0, 2, 2000) for _ in range(3))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "y": 2 * a + b}))
    out = models.greedy_selection(df, ["a", "b", "c"], "y", 2).collect()
    assert {r.feature for r in out} == {"a", "b"} and all(abs(r.gain - 1) < 0.05 for r in out)


def test_bands_and_maker():
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * t / 100), np.sin(2 * np.pi * t / 5)
    assert np.allclose(models.band_passed(slow + fast, 0.1, 0.5), fast, atol=1e-6)
    out = models.touch_maker(np.array([100.0, 98, 100, 98, 100, 102, 100]), 0.01, every=10)
    assert out == {"fills": 3.0, "inventory": 1.0, "pnl": pytest.approx(3.0)} and models.touch_maker(np.array([]), 0.01)["pnl"] == 0


def test_fits_over_all_rows(spark):
    """Sums over partitions give what the fits in memory give."""
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 3, rng.integers(2, 30)) for _ in range(20)]
    df = spark.createDataFrame([(k, i, int(x)) for k, s in enumerate(seqs) for i, x in enumerate(s)], "k int, i int, s int").repartition(3)
    for a, b in zip(discovery.fit_hmm(df, ["k"], "i", "s", 2, 3, rounds=3), discovery.baum_welch(seqs, 2, 3, rounds=3)):
        assert np.allclose(a, b)
    x = np.vstack([rng.normal(0, 1, (200, 2)), rng.normal(8, 1, (200, 2))])
    points = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
    m = regime.fit_mixture_rows(points, ["a", "b"], 2)
    centres = sorted((m.means * m.scale + m.mean)[:, 0])
    assert abs(centres[0]) < 0.5 and abs(centres[1] - 8) < 0.5
    g = {r.k: r.gap for r in models.gap_by_rows(points.select(F.array("a", "b").alias("v")), "v", 3, 4).collect()}
    assert set(g) == {1, 2, 3} and g[2] > g[1] + 0.5


@pytest.mark.parametrize("gap", [1, 30, 600])
def test_episodes_run_on_over_cuts(spark, gap):
    rng = random.Random(gap)
    rows = sorted((rng.randrange(0, 6000) + (86_400 - 3000), rng.choice("abc")) for _ in range(300))
    got = discovery.lead_lag(spark.createDataFrame([(k, t) for t, k in rows], "k string, t long").select("k", F.timestamp_seconds("t").alias("ts")), "k", "ts", gap)
    anchor, seen, out = None, set(), {}
    for t, k in rows:
        if anchor is None or t - anchor > gap:
            anchor, seen = t, set()
        if k not in seen:
            out.setdefault(k, []).append((not seen, t - anchor))
            seen.add(k)
    assert {r.k: (r.episodes, r.led, round(r.mean_delay_s, 9)) for r in got.collect()} == {k: (len(v), sum(a for a, _ in v), round(sum(d for _, d in v) / len(v), 9)) for k, v in out.items()}
