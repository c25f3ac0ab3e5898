"""Reconciliation of sources, decisions with reasons, and the record contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import mrz
from veridoc.functions.mrz import bound

# Captions that OCR glues to a name.
SERVICE = (
    r"(?iu)(?:\b|(?<=[A-Z]))(?:REGISTER(?:ED|ATION)?\s*DA(?:T|L|A)[A-Z]*|REPUBLIC\s*OF\s*(?:CHINA|[A-Z]+)|VEHICLE\s*LICEN[CS]E|ISSUE\s*DA(?:T|L)E|DATE\s*OF\s*ISSUE|"
    r"DATE\s*OF\s*BIRTH|NATIONALITY|SEX|GENDER|BEARER(?:'S)?\s*SIGNATURE|HOLDER(?:'S)?\s*SIGNATURE|SIGNATURE|ПОДПИСЬ|ДАТА\s*ВЫДАЧИ|ДАТА\s*РОЖДЕНИЯ)"
)
PERSONAL_LABELS = {"UZB": "ПИНФЛ / JSHSHIR", "TUR": "T.C. Kimlik No", "KAZ": "ИИН"}  # fixed values; any other: the next
PERSONAL_LABEL = "Персональный номер"


def td3_fields(parsed: DataFrame) -> DataFrame:
    """id and ``p`` (a parsed zone) as rows: id, field, value, checksum_valid, confidence."""
    base = F.least(F.lit(0.99), 0.70 + 0.055 * mrz.passed(F.col("p.checks")))
    keyed = {"document_number": "document_number", "birth_date": "birth_date", "expiry_date": "expiry_date", "optional_data": "optional_data"}
    names = ("document_number", "surname", "given_names", "nationality", "birth_date", "sex", "expiry_date", "optional_data")
    rows = [F.struct(F.lit(n).alias("field"), F.col(f"p.{n}").alias("value"), (F.col("p.checks")[keyed[n]] if n in keyed else F.lit(None).cast("boolean")).alias("checksum_valid")) for n in names]
    each = parsed.where("p is not null").select("id", base.alias("base"), F.explode(F.array(*rows)).alias("f")).select("id", "base", "f.*")
    return each.select("id", "field", "value", "checksum_valid", F.round(F.when(~F.col("checksum_valid"), F.least("base", F.lit(0.58))).otherwise(F.col("base")), 3).alias("confidence"))


def merge_fields(first: DataFrame, second: DataFrame, tag: str = "verification_pass") -> DataFrame:
    """Full outer join on (id, field): equal values join their sources, unequal ones conflict and the surer wins."""
    raw = "raw" in first.columns and "raw" in second.columns
    b = second.select("id", "field", *([F.col("raw").alias("r2")] if raw else []), F.col("value").alias("v2"), F.array_distinct(F.array_append("source", F.lit(tag))).alias("s2"), F.col("confidence").alias("c2"))
    j = first.join(b, ["id", "field"], "full")
    empty = F.coalesce(F.col("value"), F.lit("")) == ""
    same = F.lower(F.trim("value")) == F.lower(F.trim("v2"))
    kind = F.when(F.col("c2").isNull(), "first").when(empty, "second").when(same, "same").when(F.col("c2") > F.col("confidence"), "second_wins").otherwise("first_wins")
    j = j.withColumn("k", kind)
    two = F.col("k").isin("second", "second_wins")
    return j.select(
        "id", "field", F.when(two, F.col("v2")).otherwise(F.col("value")).alias("value"), *([F.when(two, F.col("r2")).otherwise(F.col("raw")).alias("raw")] if raw else []),
        F.when(two, F.col("s2")).when(F.col("k") == "same", F.array_distinct(F.array_append("source", F.lit(tag)))).otherwise(F.col("source")).alias("source"),
        F.when(two, F.col("c2")).when(F.col("k") == "same", F.greatest("confidence", "c2")).otherwise(F.col("confidence")).alias("confidence"), F.col("k").endswith("wins").alias("conflict"))


def field_diff(zone: DataFrame, visual: DataFrame) -> DataFrame:
    """The zone's value stands, visual ones fill gaps; unequal ones give a reason."""
    j = zone.select("id", "field", F.col("value").alias("zone")).join(visual.select("id", "field", F.col("value").alias("viz")), ["id", "field"], "full")
    differ = (F.coalesce("zone", F.lit("")) != "") & (F.coalesce("viz", F.lit("")) != "") & (F.lower("zone") != F.lower("viz"))
    return j.select("id", "field", F.coalesce("zone", "viz").alias("value"), F.when(differ, F.concat(F.lit("MRZ_VIZ_"), F.upper("field"), F.lit("_DIFF"))).alias("reason"))


def issuing_state(zone_state: Column, visual_type: Column, visual_state: Column) -> Column:
    """A supported state from a visible passport replaces an unsupported one."""
    better = ~zone_state.isin(*mrz.SUPPORTED) & (visual_type == "PASSPORT") & visual_state.isin(*mrz.SUPPORTED)
    return F.when(F.coalesce(better, F.lit(False)), visual_state).otherwise(zone_state)


def decide(rows: DataFrame, hint: str = "AUTO") -> DataFrame:
    """id, status, reasons in their fixed order.

    rows: id, p (the parsed zone or null), lines_found, changes, quality_status; and, where known, quality_reasons, conflicts (fields in which
    the passes differ), state (the reconciled issuing state) and differences (reasons from the visual fields).
    """
    none = F.array().cast("array<string>")
    given = lambda name, other: F.coalesce(F.col(name), other) if name in rows.columns else other
    c = F.col("p.checks")
    state = given("state", F.col("p.issuing_state"))
    unsupported, mismatch = ~state.isin(*mrz.SUPPORTED), F.lit(hint != "AUTO") & (state != hint)
    failed = F.transform(F.filter(F.array(*map(F.lit, mrz.CHECKS)), lambda k: ~c[k]), lambda k: F.concat(F.lit("MRZ_"), F.upper(k), F.lit("_CHECKSUM_FAILED")))
    first = F.array_compact(F.array(
        F.when(F.col("changes") > 0, "MRZ_OCR_CHECKSUM_CORRECTED"), F.when(F.col("p.issuing_state") != state, "MRZ_ISSUING_STATE_CORRECTED_FROM_VISUAL_PASSPORT"),
        F.when(unsupported, "UNSUPPORTED_ISSUING_STATE"), F.when(mismatch, "COUNTRY_HINT_MISMATCH")))
    parsed = F.col("p").isNotNull()
    unread = F.array(F.when(F.col("lines_found"), "MRZ_INVALID_FORMAT").otherwise("MRZ_NOT_FOUND"))
    ok = mrz.required_valid(c)
    status = F.when(~parsed, "retry_capture").when(ok & ~unsupported & ~mismatch, "accepted").when(~ok & (F.col("quality_status") == "retry"), "retry_capture").otherwise("review")
    before = F.concat(given("quality_reasons", none), F.transform(given("conflicts", none), lambda f: F.concat(F.lit("OCR_VERIFICATION_FIELD_DIFF_"), F.upper(f))))
    reasons = F.concat(before, F.when(parsed, F.concat(first, failed)).otherwise(unread), given("differences", none))
    return rows.select("id", status.alias("status"), F.array_distinct(reasons).alias("reasons"))


def clean_person(value: Column) -> Column:
    edge = lambda c: F.regexp_replace(c, r"^[ /:;·.\-—<]+|[ /:;·.\-—<]+$", "")
    return F.nullif(F.trim(F.regexp_replace(edge(F.regexp_replace(edge(value), SERVICE + r"[\s\S]*$", "")), r"\s+", " ")), F.lit(""))


def identity_name(zone: Column, viz: Column, zone_conf: Column, viz_conf: Column, raw_fallback: Column, boundary: Column) -> Column:
    """A name from the zone and the visual one; the first rule that applies decides."""
    service = lambda c: F.coalesce(c.rlike(SERVICE), F.lit(False))
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-ZА-ЯЁ]", "")
    odd = lambda c: F.upper(c).rlike(r"[^A-ZА-ЯЁ '\-]")

    def decided(n: Column) -> Column:
        a, b, sa, sb, ia, ib, ca, cb = (n[k] for k in ("a", "b", "sa", "sb", "ia", "ib", "ca", "cb"))
        la, lb = F.length(ca), F.length(cb)
        short = F.when(la < lb, a).otherwise(b)
        prefix = (F.least(la, lb) >= 2) & F.when(la < lb, cb.startswith(ca)).otherwise(ca.startswith(cb))
        both = (
            F.when(sa != sb, F.when(sa, b).otherwise(a)).when(ia != ib, F.when(ia, b).otherwise(a)).when((la < 2) & (lb >= 2), b).when(ca == cb, a)
            .when(prefix, short).when(F.coalesce(ca == F.concat(F.upper(boundary), cb), F.lit(False)), b)
            .when(raw_fallback & (viz_conf >= 0.75), b).when(viz_conf >= zone_conf + 0.05, b).otherwise(a)
        )
        return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b))

    clean = F.struct(clean_person(zone).alias("a"), clean_person(viz).alias("b"), service(zone).alias("sa"), service(viz).alias("sb"))
    return bound(clean, lambda n: bound(n.withField("ia", odd(n["a"])).withField("ib", odd(n["b"])).withField("ca", letters(n["a"])).withField("cb", letters(n["b"])), decided))


def passport_contract(rows: DataFrame) -> DataFrame:
    """The nested record (contract 2.0) of wide rows: id, state, type and the holder's columns."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    full = F.nullif(F.concat_ws(" ", blank(F.col("surname")), blank(F.col("given_names")), blank(F.col("patronymic"))), F.lit(""))
    return rows.select(
        "id", F.lit("2.0").alias("schema_version"),
        F.struct(F.col("type").alias("type"), blank(F.col("document_number")).alias("number"), F.col("state").alias("issuing_state"), blank(F.col("expiry_date")).alias("expiry_date")).alias("document"),
        F.struct(full.alias("full_name"), blank(F.col("surname")).alias("surname"), blank(F.col("given_names")).alias("given_names"), blank(F.col("birth_date")).alias("birth_date"), F.col("sex").alias("sex"), blank(F.col("nationality")).alias("nationality"), blank(F.col("personal_number")).alias("personal_id"), blank(F.col("tax_number")).alias("tax_id")).alias("holder"),
    )


EVIDENCE = "struct<value:string,raw:string,source:array<string>,confidence:double,checksum_valid:boolean>"
# Countries as they are shown.
COUNTRY_NAMES = {"AUTO": "Автоопределение", "CHN": "Китай", "UZB": "Узбекистан", "RUS": "Россия", "TUR": "Турция", "KAZ": "Казахстан", "TJK": "Таджикистан"}


def field_evidence(fields: Column) -> Column:
    """The fields with a value."""
    return F.map_filter(fields, lambda k, v: F.coalesce(v["value"], F.lit("")) != "")


def full_contract(rows: DataFrame) -> DataFrame:
    """The whole nested record (contract 2.0).

    rows: id, type, state, fields (map of EVIDENCE by field), objects (array of the page's items with mapped_keys).  Names are
    chosen between the zone and the visual zone; an unknown country is looked for in the nationality.
    """
    at = lambda name: F.nullif(F.trim(F.col("fields")[name]["value"]), F.lit(""))
    either = lambda *names: F.coalesce(*[at(n) for n in names])
    conf = lambda name: F.coalesce(F.col("fields")[name]["confidence"], F.lit(0.0))
    raw = lambda name: F.coalesce(F.array_contains(F.col("fields")[name]["source"], "raw_fallback"), F.lit(False))
    last = F.nullif(F.substring(F.coalesce("state", F.lit("")), -1, 1), F.lit(""))
    name = lambda zone, viz, edge: identity_name(at(zone), at(viz), conf(zone), conf(viz), raw(zone), edge)
    nat = F.upper(F.coalesce(either("nationality", "issuing_state_viz"), F.lit("")))
    guess = F.coalesce(*[F.when(nat.contains(code), code) for code in mrz.SUPPORTED])
    code = F.when(F.coalesce("state", F.lit("AUTO")).isin("", "AUTO"), guess).otherwise(F.col("state"))
    shown = F.create_map(*[F.lit(x) for row in COUNTRY_NAMES.items() for x in row])
    named = rows.select("id", "type", "fields", "objects", code.alias("code"), name("surname", "surname_viz", last).alias("surname"), name("given_names", "given_names_viz", F.lit(None).cast("string")).alias("given"), clean_person(at("patronymic")).alias("patronymic"))
    whole = F.coalesce(F.nullif(F.concat_ws(" ", "surname", "given", "patronymic"), F.lit("")), at("full_name"))
    kind = F.when(F.coalesce("type", F.lit("unknown")) != "unknown", F.col("type")).otherwise(at("document_type_viz"))
    document = F.struct(kind.alias("type"), at("document_number").alias("passport_number"), F.col("code").alias("issuing_country_code"), shown[F.col("code")].alias("issuing_country"), *[at(n).alias(n) for n in ("issue_date", "expiry_date", "issue_place", "issuing_authority", "authority_code")])
    holder = F.struct(whole.alias("full_name"), F.col("surname"), F.col("given").alias("given_names"), F.col("patronymic"), *[at(n).alias(n) for n in ("nationality", "birth_date", "birth_place", "sex")], at("personal_number").alias("personal_id"), at("tax_number").alias("tax_id"))
    return named.select("id", F.lit("2.0").alias("schema_version"), document.alias("document"), holder.alias("holder"), F.struct(at("optional_data").alias("optional_data")).alias("mrz"),
                        field_evidence(F.col("fields")).alias("field_evidence"), F.col("objects").alias("recognized_objects"), F.filter("objects", lambda o: F.size(o["mapped_keys"]) == 0).alias("unmapped_objects"))


def compact_record(contract: DataFrame) -> DataFrame:
    """The smallest payload of a whole record."""
    return contract.select("id", F.col("holder.full_name").alias("fio"), F.col("holder.birth_date").alias("birth_date"), F.col("document.issuing_country").alias("country"), F.col("document.type").alias("document_type"),
                           F.col("document.passport_number").alias("document_number"), F.coalesce("holder.tax_id", "holder.personal_id").alias("inn"))


def passport_rows(contract: DataFrame) -> DataFrame:
    """id, place, label, value: what is shown of a passport, the sex in words."""
    sex = F.when(F.col("holder.sex") == "M", "Мужской").when(F.col("holder.sex") == "F", "Женский").otherwise(F.col("holder.sex"))
    shown = [
        ("Фамилия", F.col("holder.surname")), ("Имя", F.col("holder.given_names")), ("Дата рождения", F.col("holder.birth_date")), ("Пол", sex), ("Гражданство", F.col("holder.nationality")), ("Страна выдачи", F.col("document.issuing_country_code")),
        ("Номер паспорта", F.col("document.passport_number")), ("Срок действия", F.col("document.expiry_date")), ("Персональный номер", F.coalesce("holder.personal_id", "mrz.optional_data")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), F.coalesce(v, F.lit("")).alias("value")) for i, (label, v) in enumerate(shown)])
    return contract.select("id", F.explode(rows).alias("r")).select("id", "r.*")


def vehicle_rows(records: DataFrame) -> DataFrame:
    """doc_id, segment, place, label, value: what is shown of a vehicle's record, codes beside names."""
    coded = lambda code, name: F.concat_ws(" · ", F.nullif(F.col(code), F.lit("")), F.nullif(F.col(name), F.lit("")))
    shown = [("VIN", F.col("vin")), ("Марка", coded("make_code", "make")), ("Тип", coded("type_code", "type")), ("Госномер", F.col("registration_number")), ("Дата регистрации", F.col("registration_date")), ("Модель", F.col("model"))]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), F.coalesce(v, F.lit("")).alias("value")) for i, (label, v) in enumerate(shown)])
    return records.select("doc_id", "segment", F.explode(rows).alias("r")).select("doc_id", "segment", "r.*")


def compact_contract(contract: DataFrame) -> DataFrame:
    h, d = "holder.", "document."
    return contract.select("id", F.col(h + "full_name").alias("fio"), F.col(h + "birth_date").alias("birth_date"), F.col(d + "issuing_state").alias("country"), F.col(d + "type").alias("document_type"),
                           F.col(d + "number").alias("document_number"), F.coalesce(h + "tax_id", h + "personal_id").alias("inn"))


def personal_label(country: Column) -> Column:
    out = F.lit(PERSONAL_LABEL)
    for k, v in PERSONAL_LABELS.items():
        out = F.when(country == k, v).otherwise(out)
    return out
