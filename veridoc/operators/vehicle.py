"""Vehicle certificates: segments, numbered rows, plates, numbers, merging of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.mrz import bound

# The forms of a vehicle's number, of a Chinese plate, and of a numbered row of a certificate.
VIN = r"(?<![A-Z0-9])([A-HJ-NPR-Z0-9]{17})(?![A-Z0-9])"
PLATE = r"^([一-鿿][A-Z][A-Z0-9]{4,6}[挂学警港澳]?)$"
NUMBERED = r"^([126])[.)-]?([A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9.'/-]{3,})$"
# Titles of a Chinese vehicle license.
CHINESE_HEADER, ENGLISH_HEADER = "中华人民共和国机动车行驶证", "VEHICLELICENSEOFTHEPEOPLESREPUBLICOFCHINA"
# Markers of a vehicle document, in its text and in its letters alone.
MARKERS = ("VIN", "ТРАНСПОРТ", "РЕГИСТРАЦ", "КУЗОВ", "ШАССИ", "VEHICLE LICENSE", "PLATE NO", "REGISTER DATE", "车辆", "号牌")
COMPACT_MARKERS = ("AVTOMOTOTRANSPORTVOSITASI", "DAVLATRAQAMBELGISI", "ROYXATDANOTKAZILGANLIGI", "VEHICLELICENCE", "VEICLELICENCE", "RUSUMIMODELI", "BERILGANSANASI")
# Words for a vehicle's type and the type's code; the order decides.
TYPE_ALIASES = [
    ("ВОДНОЕ СУДНО", "100"), ("СЕДЕЛЬНЫЙ ТЯГАЧ", "307"), ("АВТОМОБИЛЬ-ТЯГАЧ", "306"), ("МИКРОАВТОБУС", "324"), ("СОЧЛЕНЕННЫЙ АВТОБУС", "323"), ("СПЕЦИАЛЬНЫЙ АВТОБУС", "322"), ("АВТОБУС", "321"),
    ("ГРУЗОВОЙ ПОЛУПРИЦЕП", "319"), ("СПЕЦИАЛЬНЫЙ ПОЛУПРИЦЕП", "320"), ("ПОЛУПРИЦЕП", "319"), ("СПЕЦИАЛЬНЫЙ ПРИЦЕП", "313"), ("ГРУЗОВОЙ ПРИЦЕП", "312"), ("КАРАВАН", "314"), ("СПЕЦИАЛЬНЫЙ ГРУЗОВОЙ", "304"),
    ("ГРУЗОПАССАЖИРСКИЙ", "305"), ("ГРУЗОВОЙ АВТОМОБИЛЬ", "303"), ("СПЕЦИАЛЬНЫЙ ЛЕГКОВОЙ", "302"), ("ЛЕГКОВОЙ АВТОМОБИЛЬ", "301"), ("КОНТЕЙНЕР", "901"), ("ВОЗДУШНОЕ СУДНО", "400"), ("重型半挂牵引车", "307"),
    ("牵引车", "307"), ("专项作业车", "304"), ("半挂车", "319"), ("挂车", "312"), ("货车", "303"), ("轿车", "301"), ("客车", "321"),
]
# Makes written in Chinese or glued to the model; a full brand table is the user's to give.
MAKE_ALIASES = [("SHACMAN", "561", "SHAANXI"), ("解放", "173", "FAW"), ("东风", "149", "DONGFENG"), ("福田", "188", "FOTON"), ("中国重汽", "261", "HOWO"), ("豪沃", "261", "HOWO"), ("陕汽", "561", "SHAANXI"), ("江淮", "294", "JAC"), ("宇通", "693", "YUTONG"), ("金龙", "331", "KING LONG"), ("比亚迪", "093", "BYD"), ("吉利", "200", "GEELY"), ("豪瀚", "261", "HOWO"), ("长城", "217", "GREAT WALL"), ("奇瑞", "121", "CHERY"), ("现代", "272", "HYUNDAI"), ("丰田", "628", "TOYOTA"), ("大众", "665", "VOLKSWAGEN")]


# The classifier of vehicle types.
TYPES = [
    ("100", "Водное судно"), ("201", "Паровоз"), ("202", "Электровоз"), ("203", "Электропоезд"), ("204", "Тепловоз"), ("205", "Дизель-поезд"), ("206", "Путевая машина"), ("207", "Вагон пассажирский"), ("208", "Вагон багажный"),
    ("209", "Вагон изотермический"), ("210", "Цистерна"), ("211", "Полувагон"), ("212", "Платформа"), ("298", "Прочий вагон"), ("301", "Легковой автомобиль общего назначения"), ("302", "Специальный легковой автомобиль"),
    ("303", "Грузовой автомобиль общего назначения"), ("304", "Специальный грузовой автомобиль"), ("305", "Грузопассажирский автомобиль"), ("306", "Автомобиль-тягач"), ("307", "Седельный тягач"), ("308", "Пассажирский прицеп до 0,75 т"),
    ("309", "Пассажирский прицеп 0,75–3,5 т"), ("310", "Пассажирский прицеп 3,5–10 т"), ("311", "Пассажирский прицеп более 10 т"), ("312", "Грузовой прицеп общего назначения"), ("313", "Специальный прицеп"), ("314", "Караван"),
    ("315", "Пассажирский полуприцеп до 0,75 т"), ("316", "Пассажирский полуприцеп 0,75–3,5 т"), ("317", "Пассажирский полуприцеп 3,5–10 т"), ("318", "Пассажирский полуприцеп более 10 т"), ("319", "Грузовой полуприцеп общего назначения"),
    ("320", "Специальный полуприцеп"), ("321", "Автобус общего назначения"), ("322", "Специальный автобус"), ("323", "Сочлененный автобус"), ("324", "Микроавтобус"), ("400", "Воздушное судно"), ("901", "Контейнер"), ("999", "Прочее транспортное средство"),
]
# Captions of the fields in running lines, and beside their values on the page.
LINE_LABELS = {
    "vin": ("VEHICLE IDENTIFICATION NUMBER", "ИДЕНТИФИКАЦИОННЫЙ НОМЕР (VIN)", "ИДЕНТИФИКАЦИОННЫЙ НОМЕР", "车辆识别代号", "车辆识别代码", "VIN"), "model": ("МОДЕЛЬ", "MODEL", "品牌型号"),
    "body_number": ("НОМЕР КУЗОВА", "BODY NO"), "chassis_number": ("НОМЕР ШАССИ", "CHASSIS NO"), "registration_number": ("ГОСУДАРСТВЕННЫЙ НОМЕР", "РЕГИСТРАЦИОННЫЙ НОМЕР", "REGISTRATION NO"),
    "registration_date": ("ДАТА РЕГИСТРАЦИИ", "DATE OF REGISTRATION", "REGISTRATION DATE"),
}
PAGE_LABELS = {
    "vin": ("VEHICLE IDENTIFICATION NUMBER", "ИДЕНТИФИКАЦИОННЫЙ НОМЕР", "车辆识别代号", "车辆识别代码", "VIN"), "registration_number": ("PLATE NO", "REGISTRATION NO", "号牌号码", "号牌"), "model": ("MODEL",),
    "registration_date": ("REGISTER DATE", "REGISTERDATE", "REGISTERDALE", "REGISTERDAIE", "REGISTRATION DATE", "注册日期"),
}
PLATE_LABEL, PLATE_REACH = "号牌号码", 5
DAY = r"20\d{2}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]20\d{2}"  # fixed value: a registration date
FIELDS = ["vin", "make_code", "make", "type_code", "type", "registration_number", "registration_date", "body_number", "chassis_number", "model"]


def vin(text: Column) -> Column:
    return F.regexp_extract(F.upper(text), VIN, 1)


def chinese_plate(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.upper(text), r"\s", ""), PLATE, 1)


def first_alias(text: Column, aliases: list[tuple]) -> Column:
    """The code of the first alias inside the text, else ''."""
    out = F.lit("")
    for name, code, *_ in reversed(aliases):
        out = F.when(F.upper(text).contains(name), code).otherwise(out)
    return out


def brand(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """The longest brand (code, name) with word edges in each text; ``brands`` is a dimension of under a thousand rows."""
    edge = F.concat(F.lit("(?<![A-ZА-Я0-9])"), F.expr(r"regexp_replace(name, '([^A-Za-z0-9А-Яа-я ])', '\\\\$1')"), F.lit("(?![A-ZА-Я0-9])"))
    dim = F.broadcast(brands.withColumn("pattern", edge))
    hits = texts.join(dim, F.upper("text").contains(F.col("name")) & F.expr("regexp_like(upper(text), pattern)"))
    best = hits.groupBy("doc_id").agg(F.min(F.struct((-F.length("name")).alias("l"), "code", "name")).alias("b"))
    return best.select("doc_id", "b.code", "b.name")


def numbered(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, number, value of rows such as 1.10A123BC."""
    compact = F.regexp_replace(F.upper("text"), r"\s+", "")
    strip = lambda c: F.regexp_replace(c, r"^[. '/\-]+|[. '/\-]+$", "")
    return lines.withColumn("c", compact).where(F.col("c").rlike(NUMBERED)).select("doc_id", "line_no", F.regexp_extract("c", NUMBERED, 1).alias("number"), strip(F.regexp_extract("c", NUMBERED, 2)).alias("value"))


def valid_registration(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^A-Z0-9]", "")).between(6, 12) & v.rlike("[A-Z]") & v.rlike(r"\d")


def valid_model(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^A-Z0-9]", "")).between(5, 32) & (F.length(F.regexp_replace(v, r"[^\p{L}]", "")) >= 2) & v.rlike(r"\d")


def numbered_records(lines: DataFrame) -> DataFrame:
    """The fullest record of each document: a valid row 1 opens one, rows 2 and 6 belong to the open one, the first of each."""
    rows = numbered(lines)
    opens = (F.col("number") == "1") & valid_registration(F.col("value"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rec", F.sum(opens.cast("int")).over(w)).where("rec > 0")
    first = lambda cond: F.min(F.when(cond, F.struct("line_no", "value")))["value"]
    date = (F.col("number") == "6") & F.col("value").rlike(r"^\d{2}[./-]\d{2}[./-]\d{4}$")
    recs = rows.groupBy("doc_id", "rec").agg(first(opens).alias("registration_number"), first((F.col("number") == "2") & valid_model(F.col("value"))).alias("model"), first(date).alias("registration_date"))
    n = F.col("model").isNotNull().cast("int") + F.col("registration_date").isNotNull().cast("int")
    best = recs.groupBy("doc_id").agg(F.min(F.struct((-n).alias("n"), (-F.coalesce(F.col("model").contains("SHACMAN").cast("int"), F.lit(0))).alias("s"), "rec", "registration_number", "model", "registration_date")).alias("b"))
    return best.select("doc_id", "b.registration_number", F.coalesce("b.model", F.lit("")).alias("model"), F.coalesce("b.registration_date", F.lit("")).alias("registration_date"))


def value_after(lines: DataFrame, *labels: str) -> DataFrame:
    """doc_id, value: the rest of the first line with a label, or the next line."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    up = F.upper(F.trim("text"))
    rows = lines.withColumn("u", up).withColumn("next", F.upper(F.trim(F.lead("text").over(w))))
    picked = F.lit(None).cast("struct<k:int,rest:string>")
    for k, label in reversed(list(enumerate(labels))):
        p = rf"(?<![A-ZА-ЯЁ0-9])\Q{label}\E(?![A-ZА-ЯЁ0-9])"
        rest = F.trim(F.regexp_replace(F.regexp_extract(F.col("u"), p + r"([\s\S]*)$", 1), "^[ :№#-]+", ""))
        picked = F.when(F.col("u").rlike(p), F.struct(F.lit(k).alias("k"), rest.alias("rest"))).otherwise(picked)
    hit = rows.withColumn("p", picked).where("p is not null").withColumn("value", F.when(F.col("p.rest") != "", F.col("p.rest")).otherwise(F.col("next"))).where("value is not null")
    return hit.groupBy("doc_id").agg(F.min(F.struct("line_no", "value"))["value"].alias("value"))


def right_of_label(items: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """doc_id, value: the nearest item right of the first label that has one."""
    marks = "|".join(rf"\Q{x}\E" for x in labels)
    c = F.col
    cy, h = (c("y1") + c("y2")) / 2, F.greatest(c("y2") - c("y1"), F.lit(1.0))
    it = items.withColumn("cx", (c("x1") + c("x2")) / 2).withColumn("cy", cy).withColumn("h", h).withColumn("is_label", F.upper("text").rlike(marks))
    lab = it.where("is_label").select("doc_id", c("item_idx").alias("li"), c("x2").alias("lx2"), c("cx").alias("lcx"), c("cy").alias("lcy"), c("h").alias("lh"))
    dy = F.abs(c("cy") - c("lcy"))
    j = lab.join(it.where("not is_label"), "doc_id").where((c("cx") > c("lcx")) & (dy <= F.greatest(F.lit(45.0), 2.5 * c("lh"))))
    d = 3 * dy + F.greatest(F.lit(0.0), c("x1") - c("lx2"))
    return j.groupBy("doc_id").agg(F.min(F.struct("li", d.alias("d"), "item_idx", F.upper(F.trim("text")).alias("value")))["value"].alias("value"))


def segments(lines: DataFrame, gap: int = 8) -> DataFrame:
    """Adds ``segment``, from 1: at two or more Chinese headers, else at two or more English ones, else halfway
    between two or more plates, else the whole page.

    An English header counts if it stands more than ``gap`` lines after the last accepted one, so it is a fold.
    Where headers split the page, lines before the first of them are dropped.
    """
    rows = lines.withColumn("_i", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1)
    english = F.regexp_replace(F.upper("text"), "[^A-Z]", "").contains(ENGLISH_HEADER)
    at = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("_i"))))
    marks = rows.groupBy("doc_id").agg(at(F.col("text").contains(CHINESE_HEADER)).alias("c"), at(english).alias("e"), at(chinese_plate(F.col("text")) != "").alias("p"))
    accepted = F.aggregate("e", F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > gap), F.array_append(acc, x)).otherwise(acc))
    middles = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda x, y: F.floor((x + y) / 2).cast("int"))
    whole = F.array(F.lit(0))
    starts = F.when(F.size("c") >= 2, F.col("c")).when(F.size("e") >= 2, F.col("e")).when(F.size("p") >= 2, F.array_distinct(F.concat(whole, middles))).otherwise(whole)
    starts = marks.withColumn("e", accepted).select(F.col("doc_id").alias("_d"), starts.alias("_s"))
    cut = rows.join(starts, F.col("doc_id").eqNullSafe(F.col("_d"))).withColumn("segment", F.size(F.filter("_s", lambda x: x <= F.col("_i"))).cast("long"))
    return cut.where("segment > 0").drop("_i", "_d", "_s")


def type_code(text: Column) -> Column:
    """The code of the first written type, else of the longest classifier name inside the text, else ''."""
    by_name = first_alias(text, [(name.upper(), code) for code, name in sorted(TYPES, key=lambda t: -len(t[1]))])
    return bound(first_alias(text, TYPE_ALIASES), lambda c: F.when(c == "", by_name).otherwise(c))


def type_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for row in TYPES for x in row])[code], F.lit(""))


def after_label(lines: Column, labels: tuple[str, ...]) -> Column:
    """What follows the first line's caption, in that line or else as the next line; '' for none."""
    def read(raw: Column, i: Column) -> Column:
        up = F.upper(F.trim(raw))
        found = []
        for label in labels:
            p = rf"(?<![A-ZА-ЯЁ0-9])\Q{label}\E(?![A-ZА-ЯЁ0-9])"
            rest = F.trim(F.regexp_replace(F.regexp_extract(up, p + r"([\s\S]*)$", 1), "^[ :№#-]+", ""))
            found.append(F.when(up.rlike(p), F.when(rest != "", rest).otherwise(F.upper(F.trim(F.get(lines, i + 1))))))
        return F.coalesce(*found)

    return F.coalesce(F.get(F.filter(F.transform(lines, read), lambda v: v.isNotNull()), F.lit(0)), F.lit(""))


RECORD = "struct<registration_number:string,model:string,registration_date:string>"


def numbered_record(lines: Column) -> Column:
    """The fullest record of numbered rows: a valid row 1 opens one, rows 2 and 6 belong to the open one, the first of
    each; without any, the first valid rows 2 and 6."""
    def read(raw: Column) -> Column:
        c = F.regexp_replace(F.upper(raw), r"\s+", "")
        return F.struct(F.regexp_extract(c, NUMBERED, 1).alias("k"), F.regexp_replace(F.regexp_extract(c, NUMBERED, 2), r"^[. '/\-]+|[. '/\-]+$", "").alias("v"))

    rows = F.filter(F.transform(lines, read), lambda r: r["k"] != "")
    opens = lambda r: (r["k"] == "1") & valid_registration(r["v"])
    is_model = lambda r: (r["k"] == "2") & valid_model(r["v"])
    is_date = lambda r: (r["k"] == "6") & r["v"].rlike(r"^\d{2}[./-]\d{2}[./-]\d{4}$")
    none = F.lit(None).cast("string")
    new = lambda a, b, c: F.struct(a.alias("registration_number"), b.alias("model"), c.alias("registration_date"))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        filled = new(last["registration_number"], F.coalesce(last["model"], F.when(is_model(r), r["v"])), F.coalesce(last["registration_date"], F.when(is_date(r), r["v"])))
        return F.when(opens(r), F.array_append(acc, new(r["v"], none, none))).when(F.size(acc) > 0, F.array_append(F.slice(acc, 1, F.size(acc) - 1), filled)).otherwise(acc)

    def best(records: Column) -> Column:
        rank = lambda r, i: F.struct((r["model"].isNotNull().cast("int") + r["registration_date"].isNotNull().cast("int")).alias("n"), F.coalesce(r["model"].contains("SHACMAN"), F.lit(False)).alias("s"), (-i).alias("i"), r.alias("r"))
        return F.array_max(F.transform(records, rank))["r"]

    first = lambda rs, test: F.get(F.filter(rs, test), F.lit(0))["v"]
    return bound(rows, lambda rs: bound(F.aggregate(rs, F.array().cast(f"array<{RECORD}>"), step), lambda recs: F.when(F.size(recs) > 0, best(recs)).otherwise(new(none, first(rs, is_model), first(rs, is_date)))))


def vehicle_fields(lines: Column, beside: dict[str, Column] | None = None, brand: Column | None = None) -> Column:
    """The fields of one certificate from its lines, '' where unknown.

    beside: values found beside captions on the page, for a page that was not split; brand: (code, name) from a
    table of brands, which goes before the makes written in Chinese or glued to the model.
    """
    beside = beside or {}

    def build(z: Column) -> Column:
        rows, text, rec = z["lines"], z["text"], z["rec"]
        filled = lambda c: F.nullif(c, F.lit(""))
        label_at = F.array_position(F.transform(rows, lambda x: x.contains(PLATE_LABEL)), True).cast("int")
        plates = F.filter(F.transform(F.slice(rows, label_at + 1, PLATE_REACH), chinese_plate), lambda p: p != "")
        by_label = F.when(label_at > 0, F.get(plates, F.lit(0)))
        own = {name: filled(after_label(rows, labels)) for name, labels in LINE_LABELS.items()}
        at_side = lambda name: filled(beside[name]) if name in beside else F.lit(None).cast("string")
        number = F.coalesce(own["registration_number"], by_label, rec["registration_number"], at_side("registration_number"), F.lit(""))
        model = F.coalesce(own["model"], rec["model"], at_side("model"), F.lit(""))
        date = F.coalesce(own["registration_date"], rec["registration_date"], at_side("registration_date"), F.lit(""))
        words = F.regexp_extract_all(F.upper(model), F.lit("([A-Z0-9.-]{2,})"), F.lit(1))
        fit = F.filter(words, lambda w: w.rlike("^[A-Z]+$") | ((F.length(w) >= 5) & w.rlike("[A-Z]") & w.rlike("[0-9]")))
        longest = F.array_max(F.transform(fit, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
        day = F.coalesce(filled(F.regexp_extract(date, DAY, 0)), filled(F.regexp_extract(text, DAY, 0)))
        glued = F.regexp_replace(text, "[^A-ZА-ЯЁ0-9]", "").contains("SHACMAN")
        make = F.when(glued, F.lit("561")).otherwise(first_alias(text, MAKE_ALIASES[1:]))
        names = F.create_map(*[F.lit(x) for code, name in {m[1]: m[2] for m in MAKE_ALIASES}.items() for x in (code, name)])
        code = F.coalesce(brand["code"], filled(make)) if brand is not None else filled(make)
        name = F.coalesce(brand["name"], names[make]) if brand is not None else names[make]
        blank = lambda c: F.coalesce(c, F.lit(""))
        kind = type_code(text)
        return F.struct(
            vin(F.coalesce(filled(vin(text)), own["vin"], at_side("vin"), F.lit(""))).alias("vin"), blank(code).alias("make_code"), blank(name).alias("make"), kind.alias("type_code"), type_name(kind).alias("type"), number.alias("registration_number"),
            F.coalesce(F.translate(day, "./", "--"), date).alias("registration_date"), blank(own["body_number"]).alias("body_number"), blank(own["chassis_number"]).alias("chassis_number"), blank(longest).alias("model"),
        )

    return bound(F.struct(lines.alias("lines"), F.upper(F.array_join(lines, "\n")).alias("text"), numbered_record(lines).alias("rec")), build)


def vehicle_score(text: Column) -> Column:
    """How many markers of a vehicle document are in the (upper-case) text or its letters alone."""
    def count(z: Column) -> Column:
        return sum((z["t"].contains(m).cast("long") for m in MARKERS), F.lit(0).cast("long")) + sum((z["c"].contains(m).cast("long") for m in COMPACT_MARKERS), F.lit(0).cast("long"))

    return bound(F.struct(text.alias("t"), F.regexp_replace(text, "[^A-ZА-ЯЁ0-9]", "").alias("c")), count)


def vehicle_records(lines: DataFrame, items: DataFrame | None = None, brands: DataFrame | None = None) -> DataFrame:
    """Every distinct certificate of each document: doc_id, segment and FIELDS.

    lines: doc_id, line_no, text; items: the page's items with their boxes, used only where the page is one segment; brands:
    code, name.  Segments without a number, a plate or the marks of a vehicle document go.
    """
    seg = segments(lines).groupBy("doc_id", "segment").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    rows = seg.select("doc_id", "segment", F.transform("ls", lambda x: x["text"]).alias("lines"))
    beside, brand_col = {}, None
    if items is not None:
        single = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").select("doc_id")
        own = items.join(single, "doc_id")
        for name, marks in PAGE_LABELS.items():
            rows = rows.join(right_of_label(own, marks).withColumnRenamed("value", f"_{name}"), "doc_id", "left")
            beside[name] = F.coalesce(F.col(f"_{name}"), F.lit(""))
    if brands is not None:
        key = F.concat_ws(":", "doc_id", "segment")
        texts = rows.select(key.alias("doc_id"), F.array_join("lines", "\n").alias("text"))
        found = brand(texts, brands).select(F.col("doc_id").alias("_key"), F.struct("code", "name").alias("_brand"))
        rows = rows.join(found, key == F.col("_key"), "left")
        brand_col = F.col("_brand")
    text = F.upper(F.array_join("lines", " "))
    rows = rows.select("doc_id", "segment", ((vehicle_score(text) >= 2) | text.rlike(VIN)).alias("marked"), vehicle_fields(F.col("lines"), beside, brand_col).alias("v"))
    kept = rows.where((F.col("v.registration_number") != "") | (F.col("v.vin") != "") | F.col("marked")).select("doc_id", "segment", "v.*")
    return merge_records(kept, [f for f in FIELDS if f not in ("registration_number", "vin")])


def merge_records(records: DataFrame, fields: list[str]) -> DataFrame:
    """Records with one identity (plate and number, not both blank) become one; later ones fill blanks."""
    blank = (F.col("registration_number") == "") & (F.col("vin") == "")
    keyed = records.withColumn("own", F.when(blank, F.col("segment")).otherwise(F.lit(-1)))
    first = lambda c: F.coalesce(F.min(F.when(F.col(c) != "", F.struct("segment", c)))[c], F.lit("")).alias(c)
    return keyed.groupBy("doc_id", "registration_number", "vin", "own").agg(F.min("segment").alias("segment"), *[first(c) for c in fields]).drop("own")


def is_vehicle(lines: DataFrame) -> DataFrame:
    """doc_id, score, is_vehicle."""
    text = F.upper(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " "))
    rows = lines.groupBy("doc_id").agg(text.alias("t")).withColumn("score", vehicle_score(F.col("t")))
    return rows.select("doc_id", "score", ((F.col("score") >= 2) | F.col("t").rlike(VIN)).alias("is_vehicle"))
