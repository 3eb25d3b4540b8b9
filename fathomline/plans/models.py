"""Queries of selection, cluster number, spectra of pairs and maker simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import models
from fathomline.plans.adapters import candles, read, rounded
from fathomline.plans.catalogue import register
from fathomline.plans.stats import panel


@register("greedy_selection")
def greedy_selection(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.floor(F.col("l_quantity") / 10).alias("q"), F.floor(F.col("l_extendedprice") / 20000).alias("price"))
    return rounded(models.greedy_selection(d, ["l_returnflag", "l_linestatus", "l_linenumber", "q"], "price", 3))


@register("gap_statistic")
def gap_statistic(spark, sf_dir):
    return rounded(models.gap_by_rows(read(spark, sf_dir, "embeddings"), "embedding"), 4)


@register("coherence")
def coherence(spark, sf_dir):
    return rounded(models.coherence_by_key(panel(spark, sf_dir).where("ret IS NOT NULL"), "ret", "volume", "symbol", "date"))


@register("maker_simulation")
def maker_simulation(spark, sf_dir):
    return rounded(models.maker_by_key(candles(spark, sf_dir), "close", "symbol", "date", (0.01, 0.05), (0.0, 0.0002)), 4)
