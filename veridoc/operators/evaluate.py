"""Evaluation: rates, percentiles, counts, accuracy, audits, samples, assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Synonyms of canonical values.
SYNONYMS = {
    "gender": {"MALE": "M", "M": "M", "男M": "M", "М": "M", "МУЖСКОЙ": "M", "FEMALE": "F", "F": "F", "女F": "F", "Ж": "F", "ЖЕНСКИЙ": "F"},
    "nationality": {"CHINESE": "CHN", "中国CHINESE": "CHN", "中国": "CHN", "UZBEKISTAN": "UZB", "UZBEK": "UZB", "OZBEKISTON": "UZB", "KYRGYZREPUBLIC": "KGZ", "KYRGYZSTAN": "KGZ"},
    "brand": {"陕汽牌": "SHAANXI", "陕汽": "SHAANXI", "豪瀚牌": "HOWO", "豪瀚": "HOWO", "中国重汽牌": "HOWO", "中国重汽": "HOWO", "解放牌": "FAW", "解放": "FAW", "东风牌": "DONGFENG", "东风": "DONGFENG", "福田牌": "FOTON", "福田": "FOTON"},
    "vehicle_type": {"СЕДЕЛЬНЫЙТЯГАЧ": "TRACTOR", "АВТОМОБИЛЬТЯГАЧ": "TRACTOR", "TRACTOR": "TRACTOR", "ГРУЗОВОЙПОЛУПРИЦЕП": "SEMITRAILER", "СПЕЦИАЛЬНЫЙПОЛУПРИЦЕП": "SEMITRAILER", "ПОЛУПРИЦЕП": "SEMITRAILER", "SEMITRAILER": "SEMITRAILER"},
}
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part * 100.0 / whole, 2))


def rates(rows: DataFrame, by: str, hit: Column, ms: str) -> DataFrame:
    """Per group and overall in one pass: count, rate, mean time; the overall row is ALL."""
    n = F.count("*")
    return rows.rollup(by).agg(n.alias("n"), percent(F.sum(hit.cast("long")), n).alias("rate"), F.round(F.avg(ms), 2).alias("mean_ms"), F.grouping(by).alias("g")).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(by)).alias(by), "n", "rate", "mean_ms")


def frequencies(rows: DataFrame, array_col: str, name: str) -> DataFrame:
    return rows.select(F.explode(array_col).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def latency(rows: DataFrame, ms: str) -> DataFrame:
    """Nearest-rank p50 and p95, interpolated median, mean and most."""
    rank = lambda p: F.expr(f"cast(percentile_disc({p}) within group (order by {ms}) as double)")
    return rows.agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.round(F.median(ms), 4).alias("median"), F.round(F.avg(ms), 4).alias("mean"), F.max(ms).alias("most"))


def coverage(rows: DataFrame, presence: str) -> DataFrame:
    """presence: map<string,boolean>.  How many rows fill each field, and the share."""
    each = rows.select(F.explode(presence).alias("field", "filled"))
    n = F.count("*")
    return each.groupBy("field").agg(F.sum(F.col("filled").cast("long")).alias("filled"), percent(F.sum(F.col("filled").cast("long")), n).alias("rate"))


def clean_text(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]", "")


def canonical_date(value: Column, today: str) -> Column:
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.upper(F.coalesce(value, F.lit(""))), F.lit("月"), F.lit(" ")), "[./]", "-"), r"\s+", " "))
    named = r"(\d{1,2})\s+([A-Z]{3})\s+(\d{4})"
    g = lambda i: F.regexp_extract(raw, named, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), g(2))
    three = F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0))
    part = lambda k: F.try_element_at(three, F.lit(k))
    join = lambda y, m, d: F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    compact = F.regexp_replace(raw, r"\D", "")
    yy = F.substring(compact, 1, 2).try_cast("int")
    six = F.concat_ws("-", F.when(yy <= int(today[2:4]) + 20, yy + 2000).otherwise(yy + 1900).cast("string"), F.substring(compact, 3, 2), F.substring(compact, 5, 2))
    return (
        F.when(month > 0, join(g(3), month.cast("string"), g(1)))
        .when((F.size(three) >= 3) & (F.length(part(-3)) == 4), join(part(-3), part(-2), part(-1)))
        .when((F.size(three) >= 3) & (F.length(part(-1)) == 4), join(part(-1), part(-2), part(-3)))
        .when(F.length(compact) == 6, six).otherwise(clean_text(value))
    )


def canonical(field: str, value: Column, today: str = "2026-01-01") -> Column:
    if field.endswith("date") or field.startswith("date"):
        return canonical_date(value, today)
    text = clean_text(value)
    names = SYNONYMS.get("nationality" if field == "issuing_state" else field)
    if not names:
        return text
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    out = F.coalesce(F.try_element_at(table, text), F.regexp_replace(text, "牌$", "") if field == "brand" else text)
    if field == "vehicle_type":
        out = F.when(value.contains("半挂牵引车"), "TRACTOR").when(value.contains("半挂车"), "SEMITRAILER").otherwise(out)
    return out


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; both empty: 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def equal(field: str, a: Column, b: Column) -> Column:
    if field != "authority":
        return a == b
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 6) & (a.contains(b) | b.contains(a)))


def compare(rows: DataFrame) -> DataFrame:
    """rows: file, section, field, expected, predicted (canonical).  Adds outcome and similarity; rows without truth go."""
    outcome = F.when(F.col("expected") == F.coalesce("predicted", F.lit("")), "exact").when(F.coalesce("predicted", F.lit("")) == "", "missing").otherwise("wrong")
    return rows.where("expected is not null").withColumn("outcome", outcome).withColumn("similarity", F.round(similarity(F.col("expected"), F.coalesce("predicted", F.lit(""))), 4))


def micro_accuracy(compared: DataFrame) -> DataFrame:
    """Exact share by section and field, by section, and overall, in one pass."""
    exact = F.sum((F.col("outcome") == "exact").cast("long"))
    sets = [[F.col("section"), F.col("field")], [F.col("section")], []]
    found = compared.groupingSets(sets, "section", "field").agg(F.count("*").alias("n"), exact.alias("exact"))
    return found.select(F.coalesce("section", F.lit("ALL")).alias("section"), F.coalesce("field", F.lit("ALL")).alias("field"), "n", "exact", F.round(F.col("exact") * 100.0 / F.col("n"), 2).alias("accuracy"))


def engine_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Over files where both engines succeeded: mean accuracy and time of each, and the change in percent."""
    j = a.where("ok").select("file", F.col("accuracy").alias("a1"), F.col("ms").alias("m1")).join(b.where("ok").select("file", F.col("accuracy").alias("a2"), F.col("ms").alias("m2")), "file")
    out = j.agg(F.count("*").alias("files"), F.avg("a1").alias("acc1"), F.avg("a2").alias("acc2"), F.avg("m1").alias("ms1"), F.avg("m2").alias("ms2"))
    change = F.when(F.col("ms1") == 0, 0.0).otherwise((F.col("ms2") - F.col("ms1")) * 100 / F.col("ms1"))
    return out.select("files", *[F.round(c, 4).alias(c) for c in ("acc1", "acc2", "ms1", "ms2")], F.round(F.col("acc2") - F.col("acc1"), 4).alias("acc_change"), F.round(change, 4).alias("ms_change_pct"))


def audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side, n: keys in both and in one only; one aggregate over both sides."""
    tag = lambda d, bit: d.select(F.col(key).alias("k"), F.lit(bit).alias("bit"))
    each = tag(a, 1).unionByName(tag(b, 2)).groupBy("k").agg(F.bit_or("bit").alias("in"))
    return each.groupBy(F.when(F.col("in") == 3, "both").when(F.col("in") == 1, "left_only").otherwise("right_only").alias("side")).agg(F.count("*").alias("n"))


def round_robin_sample(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows, taken in turn from each group, the largest hash of the key first."""
    w = Window.partitionBy(group).orderBy(F.sha2(F.col(key).cast("string"), 256).desc())
    return rows.withColumn("turn", F.row_number().over(w).cast("long")).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def resume(files: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """Files still to do: those without a successful result."""
    return files.join(done.where("ok").select(key).distinct(), key, "left_anti")


def matching(weight: list[list[float]]) -> list[int]:
    """The column of each row in a matching of the largest sum (square matrix), by shortest augmenting paths in O(n^3)."""
    n = len(weight)
    row_price, col_price, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)  # owner: the row of each column; column n starts a path
    for r in range(n):
        owner[n], at = r, n
        least, back, done = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while owner[at] != n:
            done[at], i, step, nxt = True, owner[at], float("inf"), n
            for j in range(n):
                if not done[j]:
                    cost = -weight[i][j] - row_price[i] - col_price[j]
                    if cost < least[j] - 1e-12:
                        least[j], back[j] = cost, at
                    if least[j] < step - 1e-12:
                        step, nxt = least[j], j
            for j in range(n + 1):
                if done[j]:
                    row_price[owner[j]] += step
                    col_price[j] -= step
                elif j < n:
                    least[j] -= step
            at = nxt
        while at != n:
            owner[at], at = owner[back[at]], back[at]
    out = [0] * n
    for j in range(n):
        out[owner[j]] = j
    return out


def assign(truth: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """Pairs of expected and found records of each file with the largest sum of similarities.

    Both sides: file, idx and the fields.  Gives file, expected_idx, found_idx, score; missing partners are -1.  Similarities are
    computed by one join on the file; only the matrix of one file's numbers reaches Python.
    """
    import pandas as pd

    left = truth.select("file", F.col("idx").cast("bigint").alias("i"), F.struct(*fields).alias("a"))
    right = found.select("file", F.col("idx").cast("bigint").alias("j"), F.struct(*fields).alias("b"))
    blank = lambda side, f: F.coalesce(F.col(side)[f], F.lit(""))
    score = sum((F.when(F.col("a")[f].isNull(), 0.0).otherwise(similarity(blank("a", f), blank("b", f))) for f in fields), F.lit(0.0))
    pairs = left.join(right, "file").select("file", "i", "j", score.alias("w"))
    alone = left.select("file", "i", F.lit(-1).cast("bigint").alias("j"), F.lit(0.0).alias("w")).unionByName(right.select("file", F.lit(-1).cast("bigint").alias("i"), "j", F.lit(0.0).alias("w")))

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        file = rows["file"].iloc[0]
        one, two = (sorted(rows.loc[rows[c] >= 0, c].unique().tolist()) for c in ("i", "j"))
        n = max(len(one), len(two))
        weight = [[0.0] * n for _ in range(n)]
        at, to = {v: k for k, v in enumerate(one)}, {v: k for k, v in enumerate(two)}
        for i, j, w in zip(rows["i"].tolist(), rows["j"].tolist(), rows["w"].tolist()):
            if i >= 0 and j >= 0:
                weight[at[i]][to[j]] = w
        picks = matching(weight)
        out = [(file, one[i] if i < len(one) else -1, two[j] if j < len(two) else -1, round(weight[i][j], 6)) for i, j in enumerate(picks)]
        return pd.DataFrame(out, columns=["file", "expected_idx", "found_idx", "score"])

    return pairs.unionByName(alone).groupBy("file").applyInPandas(best, "file string, expected_idx bigint, found_idx bigint, score double")


REQUIRED = ("document_number", "birth_date", "expiry_date", "composite")


def held(checks: Column, names=REQUIRED) -> Column:
    """How many of the named checks hold; none without a zone."""
    return sum((F.coalesce(checks[n], F.lit(False)).cast("int") for n in names), F.lit(0))


def image_rows(records: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """One evaluation row for each image.  records: of ``recognize``; items: of the page; runs: doc_id, file, country, processing_ms."""
    seen = items.groupBy("doc_id").agg(F.count("*").alias("detected_objects"), F.round(F.avg("score") * 100, 2).alias("ocr_mean_confidence_pct"))
    rows = runs.join(records.hint("merge"), "doc_id").join(seen.hint("merge"), "doc_id", "left")
    n = held(F.col("zone.checks"))
    conf = F.transform(F.filter(F.map_values("fields"), lambda f: F.coalesce(f["value"], F.lit("")) != ""), lambda f: f["confidence"])
    mean = F.when(F.size(conf) > 0, F.round(F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) * 100 / F.size(conf), 2)).otherwise(0.0)
    every = F.coalesce(F.size(F.map_filter("zone.checks", lambda k, v: v)) == 5, F.lit(False))
    return rows.select(
        "file", "country", "status", (F.size("zone.lines") > 0).alias("mrz_found"), n.alias("mrz_required_checks_passed"), F.lit(len(REQUIRED)).alias("mrz_required_checks_total"), F.round(n * 100.0 / len(REQUIRED), 2).alias("mrz_checksum_score_pct"),
        (n == len(REQUIRED)).alias("mrz_all_required_valid"), every.alias("mrz_all_five_checks_valid"), F.size("zone.repairs").alias("mrz_repairs"), F.coalesce("detected_objects", F.lit(0)).alias("detected_objects"), F.size(conf).alias("structured_fields"),
        F.coalesce("ocr_mean_confidence_pct", F.lit(0.0)).alias("ocr_mean_confidence_pct"), mean.alias("field_mean_confidence_pct"), "quality_status", "processing_ms", F.col("reasons").alias("reason_codes"))


PASSPORT_PRESENCE = ("surname", "given_names", "birth_date", "sex", "nationality", "document_number", "expiry_date", "optional_data")
VEHICLE_PRESENCE = ("registration_number", "make", "model", "type", "registration_date")


def page_projection(records: DataFrame, items: DataFrame, vehicles: DataFrame, vehicle_pages: DataFrame, runs: DataFrame) -> DataFrame:
    """What may leave the machine about a page: an identity without names, numbers and booleans; no text, value or file name.

    vehicles: of ``vehicle_records``; vehicle_pages: doc_id, is_vehicle; runs: doc_id, document_id (a safe id), page, processing_ms.
    """
    from veridoc.sources.ingest import passport_page

    text = items.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"), F.count("*").alias("ocr_objects"))
    cars = vehicles.groupBy("doc_id").agg(F.count("*").alias("vehicle_documents"), *[F.max(F.col(f) != "").alias(f"_v_{f}") for f in VEHICLE_PRESENCE])
    rows = runs.join(records.hint("merge"), "doc_id").join(text.hint("merge"), "doc_id", "left").join(cars.hint("merge"), "doc_id", "left").join(vehicle_pages.select("doc_id", "is_vehicle").hint("merge"), "doc_id", "left")
    has = lambda f: F.coalesce(F.col("fields")[f]["value"], F.lit("")) != ""
    zone = F.size("zone.lines") > 0
    n = F.coalesce(F.size(F.map_filter("zone.checks", lambda k, v: v)), F.lit(0))
    presence = F.struct(*[has(f).alias(f) for f in PASSPORT_PRESENCE], (F.coalesce("state", F.lit("")) != "").alias("issuing_state"))
    cars_presence = F.struct(*[F.coalesce(F.col(f"_v_{f}"), F.lit(False)).alias(f) for f in VEHICLE_PRESENCE])
    count = F.coalesce("vehicle_documents", F.lit(0))
    return rows.select(
        "document_id", "page", ((count > 0) | F.coalesce("is_vehicle", F.lit(False))).alias("vehicle_detected"), passport_page(F.coalesce("text", F.lit("")), zone).alias("passport_detected"), count.alias("vehicle_documents"),
        cars_presence.alias("vehicle_field_presence"), presence.alias("passport_field_presence"), zone.alias("mrz_found"), F.col("zone.format").alias("mrz_format"), F.greatest(n, F.lit(0)).alias("mrz_checks_passed"), (n == 5).alias("mrz_all_checks_passed"),
        F.coalesce("ocr_objects", F.lit(0)).alias("ocr_objects"), "processing_ms", "status")


def count_documents(pages: DataFrame) -> DataFrame:
    """file, documents: pages with a zone or a name, and vehicles.  pages: file, mrz_found, has_name, vehicle_documents."""
    return pages.groupBy("file").agg((F.sum((F.col("mrz_found") | F.col("has_name")).cast("long")) + F.sum("vehicle_documents")).alias("documents"))


# Names in the comparison schema, and where each engine keeps them (the first that is not blank counts).
LOCAL_PASSPORT = {
    "last_name": "holder.surname", "first_name": "holder.given_names", "patronymic": "holder.patronymic", "gender": "holder.sex", "nationality": "holder.nationality", "document_number": "document.passport_number", "issuing_state": "document.issuing_country_code",
    "date_of_birth": "holder.birth_date", "date_of_expiry": "document.expiry_date", "date_of_issue": "document.issue_date", "optional_data": "mrz.optional_data", "authority": "document.issuing_authority", "place_of_birth": "holder.birth_place",
}
LOCAL_VEHICLE = {"vin": "vin", "plate": "registration_number", "brand": "make", "model": "model", "vehicle_type": "type", "body_number": "body_number", "chassis": "chassis_number", "register_date": "registration_date"}
EXTERNAL_PASSPORT = {
    "last_name": ["lastName"], "first_name": ["firstName"], "patronymic": ["patronymic"], "gender": ["gender"], "nationality": ["nationality"], "document_number": ["documentNumber", "documentNumberOnly"], "issuing_state": ["issuingState"],
    "date_of_birth": ["dateOfBirthRu", "dateOfBirth"], "date_of_expiry": ["dateOfExpiryRu", "dateOfExpiry"], "date_of_issue": ["dateOfIssueRu", "dateOfIssue"], "optional_data": ["optionalData"], "authority": ["visualZone.fields.authority"], "place_of_birth": ["visualZone.fields.place_of_birth"],
}
EXTERNAL_VEHICLE = {"vin": ["vin"], "plate": ["plate"], "brand": ["markRaw", "markName"], "model": ["model"], "vehicle_type": ["vehicleType", "typeName"], "owner": ["owner"], "engine_no": ["engineNumber"], "body_number": ["bodyNumber"], "chassis": ["chassis"], "register_date": ["registerDate"], "issue_date": ["issueDate"]}


def local_passport(contract: DataFrame, zones: DataFrame) -> DataFrame:
    """Contracts in the comparison schema.  zones: id, lines."""
    lines = F.coalesce("lines", F.array().cast("array<string>"))
    return contract.join(zones, "id", "left").select("id", lines.alias("mrz_lines"), *[F.col(path).alias(n) for n, path in LOCAL_PASSPORT.items()])


def local_vehicle(records: DataFrame) -> DataFrame:
    none = [F.lit(None).cast("string").alias(n) for n in ("owner", "engine_no", "issue_date")]
    return records.select("doc_id", "segment", *[F.col(c).alias(n) for n, c in LOCAL_VEHICLE.items()], *none)


def external(answers: DataFrame, names: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Another engine's answers (a column ``json``) in the comparison schema: the first alternative that is not blank."""
    at = lambda path: F.nullif(F.get_json_object("json", f"$.{path}"), F.lit(""))
    cols = [F.coalesce(*[at(p) for p in paths]).alias(n) for n, paths in names.items()]
    if names is EXTERNAL_PASSPORT:
        cols.append(F.coalesce(F.from_json(F.get_json_object("json", "$.mrzLines"), "array<string>"), F.array().cast("array<string>")).alias("mrz_lines"))
    return answers.select(*keep, *cols)


def file_results(files: DataFrame, pages: DataFrame, passports: DataFrame, vehicles: DataFrame) -> DataFrame:
    """One result for each file: its passports (without empty ones) and vehicles with their pages, its number of pages and their summed time.

    pages: file, page, processing_ms; passports and vehicles: file, page and their columns of the comparison schema.
    """
    def listed(rows: DataFrame, name: str) -> DataFrame:
        own = [c for c in rows.columns if c != "file"]
        return rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("page", F.to_json(F.struct(*own)).alias("j")))).alias(name)).select("file", F.transform(name, lambda r: r["j"]).alias(name))

    values = [c for c in passports.columns if c not in ("file", "page", "mrz_lines")]
    real = F.size("mrz_lines") > 0
    for c in values:
        real = real | (F.coalesce(F.col(c), F.lit("")) != "")
    none = F.array().cast("array<string>")
    times = pages.groupBy("file").agg(F.count("*").alias("pages"), F.sum("processing_ms").alias("service_ms"))
    out = files.select("file").join(times, "file", "left").join(listed(passports.where(real), "passports"), "file", "left").join(listed(vehicles, "vehicles"), "file", "left")
    return out.select("file", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("service_ms", F.lit(0)).alias("service_ms"), F.coalesce("passports", none).alias("passports"), F.coalesce("vehicles", none).alias("vehicles"))


def compare_zones(rows: DataFrame) -> DataFrame:
    """rows: id, expected, found (lists of zone rows).  Adds exact and the mean similarity of the expected rows."""
    clean = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9<]", ""))
    each = rows.select("*", clean(F.col("expected")).alias("_a"), clean(F.col("found")).alias("_b"))
    like = F.transform("_a", lambda a, i: similarity(a, F.coalesce(F.get("_b", i), F.lit(""))))
    mean = F.when(F.size("_a") > 0, F.aggregate(like, F.lit(0.0), lambda t, x: t + x) / F.size("_a")).otherwise(1.0)
    return each.select(*rows.columns, (F.col("_a") == F.col("_b")).alias("exact"), F.round(mean, 4).alias("similarity"))


def quality_reasons(rows: DataFrame) -> DataFrame:
    """rows: id, width, height, blur, brightness, glare.  Reasons in their fixed order, and the status."""
    r = F.array_compact(F.array(
        F.when(F.least("width", "height") < 700, "LOW_RESOLUTION"), F.when(F.col("blur") < 75, "IMAGE_BLUR"), F.when(F.col("brightness") < 45, "TOO_DARK"),
        F.when(F.col("brightness") > 225, "OVEREXPOSED"), F.when(F.col("glare") > 0.09, "EXCESSIVE_GLARE")))
    return rows.select("id", r.alias("reasons"), F.when(F.size(r) > 0, "retry").otherwise("ok").alias("status"))
