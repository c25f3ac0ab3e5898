"""OCR-shaped relations derived from the star-schema tables, by fixed rules.

The tables hold no scans, so these relations stand in for the output of a recogniser; each rule
is deterministic, so that the same rows can be made in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import mrz

STATES = ("CHN", "UZB", "RUS", "TUR", "KAZ", "TJK", "UTO")
TODAY = "2026-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows over all cores: the tables come in one row group each.  The shuffle also keeps the long expressions
    below from being copied into those above."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def mrz_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, line1, line2, score: a valid zone for each customer."""
    k = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("c_nationkey") % 7 + 1).cast("int"))
    base = dealt(table(spark, sf_dir, "customer"), "c_custkey").select(
        k.alias("id"), state.alias("state"), F.concat(F.lit("C"), pad(k, 8)).alias("doc"), F.concat(pad(k * 7 % 100, 2), pad(k % 12 + 1, 2), pad(k % 28 + 1, 2)).alias("birth"),
        F.concat(pad(k % 15 + 20, 2), pad(k % 12 + 1, 2), pad(k % 28 + 1, 2)).alias("expiry"), F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("<")), (k % 3 + 1).cast("int")).alias("sex"),
        F.rpad((k * 31).cast("string"), 14, "<").alias("opt"), F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ").alias("name"), ((k * 31) % 30 / 100 + 0.7).alias("score"),
    )
    cd = mrz.check_digit
    base = base.withColumn("head", F.concat("doc", cd(F.col("doc")))).withColumn("b", F.concat("birth", cd(F.col("birth")))).withColumn("e", F.concat("expiry", cd(F.col("expiry")), "opt", cd(F.col("opt"))))
    line2 = F.concat("head", "state", "b", "sex", "e", cd(F.concat("head", "b", "e")))
    return dealt(base.select("id", F.rpad(F.concat(F.lit("P<"), "state", F.lit("CUSTOMER<<N"), "name", F.lit("<ANNA")), 44, "<").alias("line1"), line2.alias("line2"), F.round("score", 3).alias("score")), "id")


def damaged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, every fifth with a zero read as O, every seventh short of fillers, every eleventh in reverse order: id, lines, score."""
    rows = mrz_rows(spark, sf_dir)
    l2 = F.when(F.col("id") % 5 == 0, F.concat(F.substring("line2", 1, 1), F.lit("O"), F.substring("line2", 3, 42))).otherwise(F.col("line2"))
    l1 = F.when(F.col("id") % 7 == 0, F.substring("line1", 1, 40)).otherwise(F.col("line1"))
    return rows.select("id", F.when(F.col("id") % 11 == 0, F.array(l2, l1)).otherwise(F.array(l1, l2)).alias("lines"), l2.alias("line2"), "score")


def ocr_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_idx, text, score, x1, y1, x2, y2: the lines of each document as a page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("item_idx", "text"))
    i = F.col("item_idx")
    return lines.select("doc_id", "item_idx", "text", F.round(((F.col("doc_id") * 31 + i * 7) % 30) / 100 + 0.7, 2).alias("score"), F.lit(10.0).alias("x1"), (i * 40.0).alias("y1"), F.lit(500.0).alias("x2"), (i * 40.0 + 30).alias("y2"))


def second_pass(items: DataFrame) -> DataFrame:
    """A verification pass: drops every ninth line and reads every fourth in capitals and anew."""
    n = F.col("doc_id") + F.col("item_idx")
    return items.where(n % 9 != 0).withColumn("text", F.when(n % 4 == 0, F.concat(F.col("text"), F.lit(" X"))).otherwise(F.col("text"))).withColumn("score", F.round(F.col("score") - 0.03, 2))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled forms: doc_id, item_idx, text, score, x1, y1, x2, y2 for each customer."""
    k = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    birth = F.concat(pad(k % 28 + 1, 2), F.lit("."), pad(k % 12 + 1, 2), F.lit("."), (k % 60 + 1950).cast("string"))
    rows = [
        (F.lit("Passport No"), 10, 10, 180, 35), (F.concat(F.lit("C"), pad(k, 8)), 220, 10, 350, 35), (F.lit("Date of birth"), 10, 60, 180, 85), (birth, 10, 95, 180, 120),
        (F.lit("Sex"), 10, 150, 60, 175), (F.when(k % 2 == 0, "M").otherwise("F"), 700, 400, 720, 425), (F.lit("Nationality: UZB"), 10, 200, 300, 225), (F.col("c_mktsegment"), 10, 300, 200, 325),
    ]
    items = F.array(*[F.struct(F.lit(i).alias("item_idx"), t.alias("text"), *[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), box)]) for i, (t, *box) in enumerate(rows)])
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").select(k.alias("doc_id"), F.explode(items).alias("i"), F.round((k % 20) / 100 + 0.75, 2).alias("score")).select("doc_id", "i.*", "score")


def vehicle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered rows of a certificate for each part: doc_id, line_no, text."""
    k = F.col("p_partkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    plate = F.concat(F.lit("1."), pad(k % 90 + 10, 2), F.lit("A"), pad(k % 900 + 100, 3), F.lit("BC"))
    model = F.concat(F.lit("2 "), F.translate(F.upper("p_brand"), "# ", ""), F.lit("X"), pad(k % 1000, 3))
    date = F.concat(F.lit("6."), pad(k % 28 + 1, 2), F.lit("."), pad(k % 12 + 1, 2), F.lit(".20"), pad(k % 20 + 5, 2))
    vin = F.concat(F.lit("VIN: "), F.translate(F.rpad(F.concat(F.lit("XW"), (k * 7919).cast("string")), 17, "Z"), "", ""))
    lines = F.array(F.lit("VEHICLE LICENSE"), plate, model, date, F.when(k % 3 == 0, vin).otherwise(F.lit("PLATE NO")), F.when(k % 4 == 0, plate).otherwise(F.lit("GRUZ")))
    return table(spark, sf_dir, "part").select(k.alias("doc_id"), F.posexplode(lines).alias("line_no", "text"))


def passport_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms with the rows of a damaged zone below."""
    # outer: else a filter on the rows' number is inferred, for which the scan computes all rows once more
    zone = damaged_rows(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode_outer("lines").alias("i", "text"))
    low = zone.select("doc_id", (F.col("i") + 8).alias("item_idx"), "text", *[F.lit(v).alias(n) if n[0] == "x" else (F.col("i") * 60.0 + v).alias(n) for n, v in (("x1", 10.0), ("y1", 900.0), ("x2", 900.0), ("y2", 930.0))], F.lit(0.9).alias("score"))
    return forms(spark, sf_dir).unionByName(low)
