"""From the recogniser's items to records: passes, zone candidates, visual fields, decision, contract.

Everything is one plan over relations keyed by doc_id, which are merged: sizes of files do not tell how many rows are made of them, and a
broadcast would send these through the driver; reading a page again (a name region, crops of the zone) is the recogniser's work, so
further passes come in as items, and only documents that need them take anything from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions import mrz
from veridoc.operators import items as passes
from veridoc.operators import reconcile, viz
from veridoc.sources.kept import kept

NAMES = ("surname_viz", "given_names_viz")


@dataclass
class Passes:
    """Items (doc_id, item_idx, text, score, x1, y1, x2, y2) of each pass; zone: those of crops, with ``crop`` as their number.

    Each pass is read several times, so one that is dear to make is better stored.
    """

    primary: DataFrame
    verification: DataFrame | None = None
    name_region: DataFrame | None = None
    zone: DataFrame | None = None
    quality: DataFrame | None = None  # doc_id, quality_status, quality_reasons


def zone_candidates(items: DataFrame, idx: int) -> tuple[DataFrame, DataFrame]:
    """The zone's two rows as normalised (id, line1, line2, score, idx), and as read (id, lines, score): one of each for a page at most.

    The score of the first is the mean over all visual rows, that of the second over its two rows.
    """
    rows = kept(passes.visual_rows(items), "rows")
    page = rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "text"))), lambda r: r["text"]).alias("ls"), F.avg("score").alias("score"))
    clean = page.select(F.col("doc_id").alias("id"), mrz.normalize_lines(F.col("ls")).alias("l"), "score").where("size(l) = 2")
    raw = passes.raw_zone_rows(rows).where("size(lines) = 2").withColumnRenamed("lines", "found")
    scored = rows.join(raw.hint("merge"), "doc_id").withColumn("t", F.regexp_replace(F.upper("text"), r"\s", "")).where(F.array_contains("found", F.col("t")))
    read = scored.groupBy("doc_id").agg(F.first("found").alias("lines"), F.avg("score").alias("score"))
    return (clean.select("id", F.get("l", F.lit(0)).alias("line1"), F.get("l", F.lit(1)).alias("line2"), "score", F.lit(idx).alias("idx")),
            read.select(F.col("doc_id").alias("id"), "lines", "score", F.lit(idx).alias("idx")))


def best_raw(read: DataFrame) -> DataFrame:
    """id, lines: the surest reading of the zone as it stands, the earlier on a tie."""
    return read.groupBy("id").agg(F.max_by("lines", F.struct("score", -F.col("idx"))).alias("lines"))


def backfill_names(fields: DataFrame, region: DataFrame) -> DataFrame:
    """Names from the region's pass, where a page lacks one of them; a surer reading replaces one that is there."""
    have = fields.where(F.col("field").isin(*NAMES)).groupBy("doc_id").agg(F.count("*").alias("n"))
    lacking = region.where(F.col("field").isin(*NAMES)).join(have.hint("merge"), "doc_id", "left").where(F.coalesce("n", F.lit(0)) < len(NAMES))
    new = lacking.select("doc_id", "field", F.struct("value", "raw", F.array_distinct(F.array_append("source", F.lit("name_region"))).alias("source"), "confidence").alias("r"))
    j = fields.join(new, ["doc_id", "field"], "full")
    take = F.col("r").isNotNull() & (F.col("confidence").isNull() | (F.col("r.confidence") > F.col("confidence")))
    return j.select("doc_id", "field", *[F.when(take, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) for c in ("value", "raw", "source", "confidence")])


def escalated(best: DataFrame, more: DataFrame) -> DataFrame:
    """The candidates of further crops, for documents without a reading whose required checks hold."""
    fine = best.where(mrz.required_valid(F.col("p.checks"))).select("id")
    return more.join(fine.hint("merge"), "id", "left_anti")


def recognize(given: Passes, today: str, hint: str = "AUTO") -> DataFrame:
    """One record for each document of the primary pass: doc_id, status, reasons, type, state, template, zone (lines, format, checks, repairs), fields (map
    of evidence), objects (the audit of every item), visual_fields (their number), provenance.
    """
    first, second = given.primary, given.verification
    docs = first.select("doc_id").distinct()
    everything = first if second is None else passes.merge_rows(first, second).drop("pass")
    place = F.row_number().over(passes.Window.partitionBy("doc_id").orderBy("y1", "x1", "item_idx"))
    everything = kept(everything.withColumn("item_idx", place - 1), "items")
    seen = kept(viz.labels(everything), "captions")

    # Visual fields: both passes, the name region, the page's layout.
    as_id = lambda d: d.withColumnRenamed("doc_id", "id")
    own = viz.extract(everything, seen) if second is None else viz.extract(first)
    conflicts = None
    if second is not None:
        merged = reconcile.merge_fields(as_id(own), as_id(viz.extract(second))).withColumnRenamed("id", "doc_id")
        conflicts = merged.where("conflict").groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list("field")).alias("conflicts"))
        own = merged.drop("conflict").select("doc_id", "field", "value", "raw", "source", "confidence")
    if given.name_region is not None:
        own = backfill_names(own, viz.extract(given.name_region))
    fields, visual = viz.visual_document(everything, kept(own, "fields"), seen)
    fields, visual = kept(fields, "fields"), kept(visual, "kinds")

    # The zone: candidates of every pass, the best reading of them.
    made = [zone_candidates(p, i) for i, p in enumerate(p for p in (first, second) if p is not None)]
    clean, read = made[0]
    for c, r in made[1:]:
        clean, read = clean.unionByName(c), read.unionByName(r)
    clean, read = kept(clean, "zones"), kept(read, "zones")
    best = kept(mrz.best_parse(clean, today), "best")
    if given.zone is not None:
        crop = given.zone.withColumn("doc_id", F.concat_ws("#", "doc_id", "crop"))  # each crop is a page of its own
        c, r = zone_candidates(crop, 9)
        back = lambda d: d.withColumn("idx", 9 + F.substring_index("id", "#", -1).cast("int")).withColumn("id", F.regexp_replace("id", "#[^#]*$", "").cast(first.schema["doc_id"].dataType))
        more = escalated(best, back(c))
        read = read.unionByName(back(r).join(more.select("id").distinct().hint("merge"), "id", "left_semi"))
        best = kept(mrz.best_parse(clean.unionByName(more), today), "best")
    raw = best_raw(read)

    rows = docs.withColumnRenamed("doc_id", "id").join(best.hint("merge"), "id", "left").join(raw.withColumnRenamed("lines", "raw_lines").hint("merge"), "id", "left").join(visual.select(F.col("doc_id").alias("id"), F.col("type").alias("visual_type"), F.col("state").alias("visual_state")).hint("merge"), "id", "left")
    unread = mrz.raw_document(F.col("raw_lines"), today)
    rows = rows.withColumn("unread", F.when(F.col("p").isNull(), unread)).withColumn("names", F.when(F.col("p").isNull(), mrz.raw_identity(mrz.clean_line(F.get("raw_lines", F.lit(0))))))
    parsed_state = reconcile.issuing_state(F.col("p.issuing_state"), F.col("visual_type"), F.col("visual_state"))
    known = F.lit(None if hint == "AUTO" else hint).cast("string")
    state = F.when(F.col("p").isNotNull(), parsed_state).otherwise(F.coalesce("unread.issuing_state", "visual_state", known))
    kind = F.when(F.col("p").isNotNull(), "TD3").otherwise(F.coalesce("unread.document_type", F.when(F.col("unread.issuing_state").isNull(), F.col("visual_type")), F.lit("unknown")))
    by = F.when(F.col("p").isNotNull(), "/generic_td3").when(F.col("unread.issuing_state").isNotNull(), "/raw_mrz").when(F.col("visual_type").isNotNull(), "/visual_id")
    rows = rows.withColumn("state", state).withColumn("type", kind).withColumn("template", F.coalesce(F.concat("state", by), F.lit("unknown")))
    rows = kept(rows, "documents")
    states = rows.select(F.col("id").alias("doc_id"), F.when(F.col("p").isNotNull(), F.col("state")).otherwise(F.coalesce("unread.issuing_state", known)).alias("state")).where("state is not null")
    fields = kept(viz.country_fields(everything, fields, states, seen), "fields")

    # The zone's fields stand; visual ones fill gaps, unequal ones give a reason.
    blank = F.lit(None).cast("boolean")
    zone = reconcile.td3_fields(rows.select("id", "p")).select("id", "field", "value", F.col("value").alias("raw"), F.array(F.lit("mrz")).alias("source"), "confidence", "checksum_valid")
    from_raw = F.filter(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value"), F.lit(c).alias("confidence")) for n, v, c in (
        *[(n, F.col(f"unread.{n}"), 0.7) for n in ("document_number", "nationality", "birth_date", "sex", "expiry_date")], *[(n, F.col(f"names.{n}"), 0.75) for n in ("surname", "given_names")])]), lambda f: f["value"].isNotNull())
    loose = rows.select("id", F.explode(from_raw).alias("f")).select("id", "f.field", "f.value", F.col("f.value").alias("raw"), F.array(F.lit("mrz"), F.lit("raw_fallback")).alias("source"), "f.confidence", blank.alias("checksum_valid"))
    zone = zone.unionByName(loose)
    seen_fields = fields.select(F.col("doc_id").alias("id"), "field", F.struct("value", "raw", "source", "confidence", blank.alias("checksum_valid")).alias("viz"))
    both = zone.select("id", "field", F.struct("value", "raw", "source", "confidence", "checksum_valid").alias("zone")).join(seen_fields, ["id", "field"], "full")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    differ = filled("zone.value") & filled("viz.value") & (F.lower("zone.value") != F.lower("viz.value"))
    final = both.select("id", "field", F.coalesce("zone", "viz").cast(reconcile.EVIDENCE).alias("f"), F.when(differ, F.concat(F.lit("MRZ_VIZ_"), F.upper("field"), F.lit("_DIFF"))).alias("reason"), F.col("viz").isNotNull().cast("int").alias("visual"))
    final = kept(final, "evidence")
    gathered = final.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "f")))).alias("fields"), F.sort_array(F.collect_list("reason")).alias("differences"), F.sum("visual").alias("visual_fields"))

    audit = viz.mapping_audit(everything, seen, final.select(F.col("id").alias("doc_id"), "field", "f.value", "f.raw"))
    objects = audit.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("item_idx").alias("index"), "text", "mapped_keys", "role", F.col("confidence_value").alias("confidence")))).alias("objects"))
    rows = rows.join(gathered.hint("merge"), "id", "left").join(objects.hint("merge"), "id", "left")
    none = F.array().cast("array<string>")
    rows = rows.join(conflicts.hint("merge"), "id", "left") if conflicts is not None else rows.withColumn("conflicts", none)
    if given.quality is not None:
        rows = rows.join(as_id(given.quality.select("doc_id", "quality_status", "quality_reasons")).hint("merge"), "id", "left")
    else:
        rows = rows.withColumn("quality_status", F.lit("ok")).withColumn("quality_reasons", none)
    rows = rows.withColumn("changes", F.coalesce(F.size("repairs"), F.lit(0))).withColumn("lines_found", F.col("raw_lines").isNotNull())
    decided = reconcile.decide(rows, hint)
    counts = lambda d, name: as_id(d.groupBy("doc_id").agg(F.count("*").alias(name)))
    rows = rows.join(decided.hint("merge"), "id").join(counts(first, "n1").hint("merge"), "id", "left")
    if second is not None:
        agreement = as_id(passes.text_agreement(first, second)).withColumnRenamed("agreement", "agree")
        rows = rows.join(counts(second, "n2").hint("merge"), "id", "left").join(agreement.hint("merge"), "id", "left")
    else:
        rows = rows.withColumn("n2", F.lit(0)).withColumn("agree", F.lit(None).cast("double"))
    zone_struct = F.struct(
        F.when(F.col("p").isNotNull(), F.array("line1", "line2")).otherwise(F.coalesce("raw_lines", none)).alias("lines"), F.when(F.col("p").isNotNull(), "TD3").when(F.col("lines_found"), "raw").alias("format"),
        F.col("p.checks").alias("checks"), F.coalesce("repairs", F.array().cast(mrz.CHANGES)).alias("repairs"))
    provenance = F.struct(F.lit(True).alias("local_processing"), F.struct(F.lit(second is not None).alias("performed"), F.coalesce("n1", F.lit(0)).cast("long").alias("primary_objects"), F.coalesce("n2", F.lit(0)).cast("long").alias("verification_objects"), F.col("agree").alias("text_agreement"), F.coalesce("conflicts", none).alias("field_conflicts")).alias("verification"))
    return rows.select(F.col("id").alias("doc_id"), "status", "reasons", "type", "state", "template", zone_struct.alias("zone"), F.coalesce("fields", F.create_map().cast(f"map<string,{reconcile.EVIDENCE}>")).alias("fields"), "objects", F.coalesce("visual_fields", F.lit(0)).alias("visual_fields"), "quality_status", provenance.alias("provenance"))


def contract(records: DataFrame) -> DataFrame:
    """The whole contract of each record."""
    return reconcile.full_contract(records.withColumnRenamed("doc_id", "id"))
