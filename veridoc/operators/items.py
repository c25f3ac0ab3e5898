"""OCR items and passes: cleanup, merging, agreement, visual rows, zone candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id"]


def key(text: Column) -> Column:
    return F.lower(F.trim(text))


def clean_items(items: DataFrame) -> DataFrame:
    """Blank texts go, texts are trimmed, scores clamped to [0, 1]; items are numbered by place."""
    kept = items.where(F.trim("text") != "").withColumn("text", F.trim("text")).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    w = Window.partitionBy(*PAGE).orderBy("y1", "x1", "item_idx")
    return kept.withColumn("place", F.row_number().over(w).cast("long"))


def merge_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """All items of the first pass and those of the second whose text is new on the page (the earliest of each)."""
    known = first.select(*PAGE, key(F.col("text")).alias("k")).distinct()
    new = second.withColumn("k", key(F.col("text"))).where("k <> ''").join(known, [*PAGE, "k"], "left_anti")
    w = Window.partitionBy(*PAGE, "k").orderBy("item_idx")
    new = new.withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.withColumn("pass", F.lit("primary")).unionByName(new.drop("n", "k").withColumn("pass", F.lit("verification")))


def text_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Jaccard similarity of the passes' texts on each page; 1 if both are empty.

    Pages are matched by one aggregate over both passes: each text knows the passes it is in.
    """
    tag = lambda d, bit: d.select(*PAGE, key(F.col("text")).alias("k"), F.lit(bit).alias("bit"))
    texts = tag(first, 1).unionByName(tag(second, 2)).groupBy(*PAGE, "k").agg(F.bit_or("bit").alias("in"))
    real = F.col("k") != ""
    n, both = F.sum(real.cast("long")), F.sum((real & (F.col("in") == 3)).cast("long"))
    return texts.groupBy(*PAGE).agg(F.when(n == 0, 1.0).otherwise(F.round(both / n, 3)).alias("agreement"))


def visual_rows(items: DataFrame) -> DataFrame:
    """Greedy first-fit rows: items by centre and left edge join the first row whose centre is near.

    A row keeps the centre and height of its first item, so the clustering is a fold over the page's
    items, in one expression; a page's items are bounded by what fits on a page.
    """
    height = F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    item = F.struct(((F.col("y1") + F.col("y2")) / 2).alias("c"), F.col("x1").alias("x"), F.col("item_idx").cast("long").alias("i"), height.alias("h"), F.col("text").alias("t"), F.col("score").alias("s"))
    pages = items.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("items"))
    member = "struct<x:double,i:bigint,t:string,s:double>"
    none = F.array().cast(f"array<struct<c:double,h:double,m:array<{member}>>>")

    def add(rows: Column, it: Column) -> Column:
        own = F.struct(it["x"].alias("x"), it["i"].alias("i"), it["t"].alias("t"), it["s"].alias("s"))
        fits = lambda r: F.abs(r["c"] - it["c"]) <= F.greatest(it["h"], r["h"]) * 0.65
        at = F.array_position(F.transform(rows, fits), True)
        put = F.transform(rows, lambda r, j: F.struct(r["c"].alias("c"), r["h"].alias("h"), F.when(j == at - 1, F.array_append(r["m"], own)).otherwise(r["m"]).alias("m")))
        return F.when(at > 0, put).otherwise(F.array_append(rows, F.struct(it["c"].alias("c"), it["h"].alias("h"), F.array(own).alias("m"))))

    rows = pages.select(*PAGE, F.posexplode(F.sort_array(F.aggregate("items", none, add))).alias("row_idx", "r"))
    ordered = F.sort_array(F.col("r.m"))
    return rows.select(*PAGE, F.col("row_idx").cast("long").alias("row_idx"), F.array_join(F.transform(ordered, lambda m: m["t"]), "").alias("text"),
                       F.round(F.aggregate(F.transform(ordered, lambda m: m["s"]), F.lit(0.0), lambda a, x: a + x) / F.size(ordered), 4).alias("score"))


def raw_zone_rows(rows: DataFrame, key_col: str = "doc_id", order: str = "row_idx") -> DataFrame:
    """The zone's two rows: the last that starts with P and the last that looks like data; else the last two with fillers."""
    from veridoc.functions.mrz import DATA_ROW

    t = F.regexp_replace(F.upper("text"), r"\s", "")
    n = F.length(t)
    fit = rows.withColumn("t", t).where(n.between(35, 55) & (F.length(F.regexp_replace(t, r"[^\p{L}\p{N}<]", "")) / n >= 0.95))
    pick = lambda cond: F.max(F.when(cond, F.struct(F.col(order), F.col("t"))))
    best = fit.groupBy(key_col).agg(
        pick(F.col("t").startswith("P")).alias("p"), pick(F.col("t").rlike(DATA_ROW)).alias("d"),
        F.slice(F.reverse(F.sort_array(F.collect_list(F.when(F.col("t").contains("<"), F.struct(F.col(order), F.col("t")))))), 1, 2).alias("f"),
    )
    both = F.col("p").isNotNull() & F.col("d").isNotNull() & (F.col(f"p.{order}") != F.col(f"d.{order}"))
    return best.select(key_col, F.when(both, F.array("p.t", "d.t")).otherwise(F.transform(F.reverse("f"), lambda x: x["t"])).alias("lines"))
