"""Placed text items of pages: (page, item_idx, str, x, y, size) to lines, without overlaid copies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE_SHARE, LEAST_SIZE = 0.55, 8.0


def without_overlays(items: DataFrame, step: float = 2.0) -> DataFrame:
    """Items without those that repeat an earlier one of their page at the same place, to the step's precision."""
    at = lambda c: F.floor(F.col(c) / step + 0.5)
    w = Window.partitionBy("page", "str", at("x"), at("y")).orderBy("item_idx")
    return items.where("str != ''").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def physical_lines(items: DataFrame) -> DataFrame:
    """(page, y, text, max_size, min_x): items of a page gathered into lines from top to bottom. Items of equal index come by x, then by text.

    In item order an item joins the first line within its tolerance, else it opens one. That fold depends on the order, so it
    runs in pandas; a group is one page, which its paper bounds.
    """

    def gather(page: pd.DataFrame) -> pd.DataFrame:
        tops: list[float] = []
        of = []
        page = page.sort_values(["item_idx", "x", "str"])
        for y, size in zip(page["y"], page["size"], strict=True):
            reach = max(size, LEAST_SIZE) * LINE_SHARE
            k = next((k for k, top in enumerate(tops) if abs(top - y) <= reach), len(tops))
            if k == len(tops):
                tops.append(y)
            of.append(k)
        page = page.assign(k=of).sort_values(["x", "item_idx", "str"], kind="stable")
        each = page.groupby("k").agg(page=("page", "first"), text=("str", "sum"), max_size=("size", "max"), min_x=("x", "min")).reset_index()
        each["y"], each["text"] = each["k"].map(dict(enumerate(tops))), each["text"].str.strip()
        return each[each["text"] != ""][["page", "y", "text", "max_size", "min_x"]]

    clean = items.where("str != ''").select(F.col("page").cast("long"), "item_idx", "str", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("x", "y", "size")])
    return clean.groupBy("page").applyInPandas(gather, "page long, y double, text string, max_size double, min_x double")


def widest_gap(items: DataFrame, low: float, high: float) -> DataFrame:
    """(page, gap, middle): the widest step between neighbouring x positions whose middle lies in a band; of equals the left one."""
    before = F.lag("x").over(Window.partitionBy("page").orderBy("x", "item_idx"))
    steps = items.withColumn("__before", before).select("page", (F.col("x") - F.col("__before")).alias("gap"), ((F.col("x") + F.col("__before")) / 2).alias("middle"))
    best = F.max(F.struct("gap", (-F.col("middle")).alias("m")))
    return steps.where((F.col("middle") >= low) & (F.col("middle") <= high)).groupBy("page").agg(best.alias("b")).select("page", F.col("b.gap").alias("gap"), (-F.col("b.m")).alias("middle"))
