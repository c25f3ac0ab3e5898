import pytest
from pyspark.sql import functions as F

from veridoc.functions import mrz
from veridoc.operators import evaluate, items, reconcile, vehicle, viz

SPECIMEN = ("P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10")  # the ICAO 9303 specimen


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("value, digit", [("L898902C3", "6"), ("740812", "2"), ("120415", "9"), ("ZE184226B<<<<<", "1"), ("", "0")])
def test_check_digit(spark, value, digit):
    assert one(spark, mrz.check_digit(F.col("v")), v=value) == digit


def test_specimen(spark):
    p = one(spark, mrz.parse_td3(F.col("a"), F.col("b"), "2026-01-01"), a=SPECIMEN[0], b=SPECIMEN[1])
    assert (p.surname, p.given_names, p.document_number, p.birth_date, p.sex) == ("ERIKSSON", "ANNA MARIA", "L898902C3", "1974-08-12", "F")
    assert all(p.checks.values())


def test_corrupted_and_short_rows(spark):
    p = one(spark, mrz.parse_td3(F.col("a"), F.col("b"), "2026-01-01"), a=SPECIMEN[0], b="X" + SPECIMEN[1][1:])
    assert not p.checks["document_number"]
    assert one(spark, mrz.parse_td3(F.col("a"), F.col("b"), "2026-01-01"), a=SPECIMEN[0], b="short") is None


@pytest.mark.parametrize("lines", [list(SPECIMEN), list(reversed(SPECIMEN)), [SPECIMEN[0][:38], SPECIMEN[1]], ["noise", *SPECIMEN]])
def test_normalize_lines(spark, lines):
    assert one(spark, mrz.normalize_lines(F.col("v")), v=lines) == list(SPECIMEN)


def test_repair(spark):
    good = SPECIMEN[1]
    bad = good[:4] + "Z" + good[5:]  # not one of the letters that are mixed up
    rows = spark.createDataFrame([(1, good), (2, good.replace("7408122", "74O8122")), (3, bad), (4, "short")], "id int, line2 string")
    got = {r.id: (r.repaired, r.changes) for r in mrz.repair_rows(rows).collect()}
    assert got[1] == (good, 0) and got[2] == (good, 1) and got[4] == ("short", 0)
    assert got[3] == (bad, 0)


@pytest.mark.parametrize("text, iso", [("14 OCT 1990", "1990-10-14"), ("159月/SEP2035", "2035-09-15"), ("31.02.2020", None), ("1/2/1999", "1999-02-01"), ("20 0CT2011", "2011-10-20"), ("words", None)])
def test_ocr_date(spark, text, iso):
    assert one(spark, viz.ocr_date(F.col("v")), v=text) == iso


@pytest.mark.parametrize("field, text, ok", [
    ("birth_date", "01.02.1990", True), ("birth_date", "1.10569XCA", False), ("sex", "F", True), ("sex", "Fe", False), ("surname_viz", "UZB", False), ("surname_viz", "Bearer signature", False), ("surname_viz", "IVANOVA", True),
    ("personal_number", "123456789012", True), ("personal_number", "12", False), ("document_number", "AB 123", True), ("document_number", "ABC", False), ("birth_place", "1", False),
])
def test_valid_candidate(spark, field, text, ok):
    assert one(spark, viz.valid_candidate(F.lit(field), F.col("v")), v=text) is ok


def test_split_name(spark):
    assert tuple(one(spark, viz.split_name(F.col("v")), v="ZHANGWEI")) == ("ZHANG", "WEI")
    assert tuple(one(spark, viz.split_name(F.col("v")), v="Alim, Bek")) == ("ALIM", "BEK")
    assert one(spark, viz.split_name(F.col("v")), v="ZHANGW") != ("ZHANG", "W")


def test_identity_name(spark):
    def name(a, b, ca=0.9, cb=0.8):
        return one(spark, reconcile.identity_name(F.col("a"), F.col("b"), F.lit(ca), F.lit(cb), F.lit(False), F.lit("N")), a=a, b=b)

    assert name("SM1TH", "SMITH") == "SMITH" and name("SMITHXY", "SMITH") == "SMITH" and name("NWANG", "WANG") == "WANG"
    assert name("DOE", "ROE") == "DOE" and name("DOE", "ROE", cb=0.96) == "ROE" and name("LEE", "LEE SIGNATURE") == "LEE"


def test_passes(spark):
    schema = "doc_id int, item_idx int, text string, score double, x1 double, y1 double, x2 double, y2 double"
    box = (0.0, 0.0, 1.0, 1.0)
    a = spark.createDataFrame([(1, 0, "One ", 0.9, *box), (1, 1, "two", 0.9, *box)], schema)
    b = spark.createDataFrame([(1, 0, "ONE", 0.9, *box), (1, 1, "three", 0.9, *box), (1, 2, "Three", 0.8, *box), (1, 3, " ", 0.8, *box)], schema)
    assert sorted(r.text for r in items.merge_rows(a, b).collect()) == ["One ", "three", "two"]
    assert items.text_agreement(a, b).first().agreement == pytest.approx(round(1 / 3, 3))
    assert items.text_agreement(a, b).first() == items.text_agreement(b, a).first()


def test_records_are_not_mixed(spark):
    lines = ["1.10A123BC", "2 ABC12", "1.20B456CD", "2 SHACMAN77", "6.01.02.2020"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, text string")
    got = vehicle.numbered_records(rows).first()
    assert (got.registration_number, got.model, got.registration_date) == ("20B456CD", "SHACMAN77", "01.02.2020")


def test_vin_excludes_letters(spark):
    assert one(spark, vehicle.vin(F.col("v")), v="x XW8ZZZ61ZJG000001 y") == "XW8ZZZ61ZJG000001"
    assert one(spark, vehicle.vin(F.col("v")), v="IW8ZZZ61ZJG00000Q") == ""


def test_sample_takes_turns(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "g string, k int")
    got = evaluate.round_robin_sample(rows, "g", "k", 3).collect()
    assert len(got) == 3 and {r.g for r in got} == {"a", "b"}


def test_percent_of_nothing(spark):
    assert spark.range(1).select(evaluate.percent(F.lit(0), F.lit(0)).alias("x")).first()["x"] == 0.0


def test_assignment_is_optimal(spark):
    a = spark.createDataFrame([("f", 0, "AAA"), ("f", 1, "BBB")], "file string, idx int, plate string")
    b = spark.createDataFrame([("f", 0, "BBB"), ("f", 1, "AAA"), ("f", 2, "Z")], "file string, idx int, plate string")
    got = {(r.expected_idx, r.found_idx) for r in evaluate.assign(a, b, ["plate"]).collect()}
    assert got == {(0, 1), (1, 0), (-1, 2)}


def test_spatial_pairing(spark):
    schema = "doc_id int, item_idx int, text string, score double, x1 double, y1 double, x2 double, y2 double"
    page = spark.createDataFrame([(1, 0, "Date of birth", 0.9, 10.0, 10.0, 180.0, 35.0), (1, 1, "01.02.1990", 0.9, 220.0, 10.0, 350.0, 35.0), (1, 2, "ABC", 0.9, 190.0, 10.0, 210.0, 35.0)], schema)
    got = viz.nearest_value(viz.label_match(page), page).collect()
    assert [(r.field, r.value) for r in got] == [("birth_date", "01.02.1990")]


def test_vehicle_segments(spark):
    cn, en = "中华人民共和国机动车行驶证", "Vehicle License of the People's Republic of China"
    pages = {
        "chinese": ["x", cn, "a", en, "b", cn + " 2", "c"], "english": ["x", en, en, *"abcdefgh", en, "z"], "one": ["x", "y", en, "z"],
        "plates": ["京A12345", "a", "b", "c", "沪B 23456", "d"], "adjacent": ["京A12345", "沪B23456", "a"], "none": ["x", "VEHICLE LICENSE", "y"], "chinese_one": ["x", cn, "粤C12345", "a", "粤D12345"],
    }
    want = {
        "chinese": [None, 1, 1, 1, 1, 2, 2], "english": [None, *[1] * 10, 2, 2], "one": [1] * 4, "plates": [1, 1, 2, 2, 2, 2], "adjacent": [1] * 3, "none": [1] * 3, "chinese_one": [1, 1, 1, 2, 2],
    }
    rows = [(d, i, t) for d, lines in pages.items() for i, t in enumerate(lines)]
    got = {(r.doc_id, r.line_no): r.segment for r in vehicle.segments(spark.createDataFrame(rows, "doc_id string, line_no int, text string")).collect()}
    assert {d: [got.get((d, i)) for i in range(len(lines))] for d, lines in pages.items()} == want


def test_classify_by_the_marks_of_the_whole_page(spark):
    pages = {
        "PASSPORT": [["Pass port", "姓名", "CHINESE VISA"]], "VISA": [["中华人民共和国签证"], ["Chinese", "Visa"]], "TAIWAN_TRAVEL_PERMIT": [["往来台湾通行证"], ["x 往來台灣通行證"]],
        "ID_CARD": [["TURKIYE CUMHURIYETI"], ["Republic of", "Turkey"]], None: [["VISA"], ["TAIWAN"], ["IDENTITY CARD"], ["PASSPORT"], [""], [None]],
    }
    want, rows = {}, []
    for kind, found in pages.items():
        for texts in found:
            want[len(want)] = kind
            rows += [(len(want) - 1, i, t) for i, t in enumerate(texts)]
    got = dict(viz.classify(spark.createDataFrame(rows, "doc_id int, item_idx int, text string")).collect())
    assert got == {d: k for d, k in want.items() if k}


def test_fuzzy_captions_before_long_values(spark):
    rows = spark.createDataFrame([(1, 0, "Passqort number: " + "7" * 80), (1, 1, "7" * 80), (1, 2, None)], "doc_id int, item_idx int, text string")
    assert [(r.item_idx, r.field, r.alias) for r in viz.label_match_fuzzy(rows).collect()] == [(0, "document_number", "passport number")]


ITEM = "doc_id int, item_idx int, text string, score double, x1 double, y1 double, x2 double, y2 double"


def page(spark, texts, doc=1):
    """Items below one another, in reading order."""
    return spark.createDataFrame([(doc, i, t, 0.9, 10.0, 40.0 * i, 400.0, 40.0 * i + 25) for i, t in enumerate(texts)], ITEM)


def found(fields):
    return {r.field: r.value for r in fields.collect()}


def test_repair_equals_brute_force(spark):
    import itertools
    import random

    value = lambda c: 0 if c == "<" else mrz.ALPHABET.index(c)
    digit = lambda v: str(sum(value(c) * (7, 3, 1)[i % 3] for i, c in enumerate(v)) % 10)
    flip = dict(zip(mrz.LETTER_FOR + mrz.DIGIT_FOR, mrz.DIGIT_FOR + mrz.LETTER_FOR))

    def checks(row):
        return [digit("".join(row[a:b] for a, b in spans)) == row[at] for spans, at in mrz.SPANS.values()]

    def plain(row):
        held = checks(row)
        if all(held[:3]) and held[4]:
            return row, 0
        places, best = [i for i, c in enumerate(row) if c in flip][:8], None
        for mask in itertools.product((0, 1), repeat=len(places)):
            new = list(row)
            for on, i in zip(mask, places):
                new[i] = flip[new[i]] if on else new[i]
            score = 10 * sum(checks("".join(new))) - sum(mask)
            if any(mask) and (best is None or score > best[0]):
                best = (score, "".join(new), sum(mask))
        return best[1:] if best and best[0] >= 39 else (row, 0)

    rng, rows = random.Random(4), []
    for i in range(60):
        text = lambda n: "".join(rng.choice("ABOIS0123456789G8") for _ in range(n))
        doc, birth, expiry, more = text(9), "740812", "300415", text(14)
        row = doc + digit(doc) + "UTO" + birth + digit(birth) + "M" + expiry + digit(expiry) + more + digit(more)
        row = list(row + digit(row[:10] + row[13:20] + row[21:43]))
        for _ in range(rng.randint(0, 3)):
            at = rng.choice([j for j, c in enumerate(row) if c in flip])
            row[at] = flip[row[at]]
        rows.append((i, "".join(row)))
    got = {r.id: r for r in mrz.repair_rows(spark.createDataFrame(rows, "id int, line2 string")).collect()}
    for i, row in rows:
        assert (got[i].repaired, got[i].changes) == plain(row)
        assert [(c["position"], c["from"], c["to"]) for c in got[i].repairs] == [(j, a, b) for j, (a, b) in enumerate(zip(row, got[i].repaired)) if a != b]


def test_extract_inline_near_and_in_order(spark):
    box = lambda i, t, s, x, y: (1, i, t, s, float(x), float(y), float(x + 100), float(y + 25))
    rows = [box(0, "Ｎationality : UZB", 0.9, 10, 10), box(1, "SURNAME / ФАМИЛИЯ", 0.9, 10, 60), box(2, "IVANOVA", 0.8, 20, 95), box(3, "Sex", 0.9, 10, 200), box(4, "F", 0.9, 700, 420),
            box(5, "Date of birth", 0.7, 300, 10), box(6, "01.02.1990", 0.9, 410, 10), box(7, "Date of birth", 0.95, 300, 500), box(8, "03.04.1991", 0.95, 410, 500)]
    got = {r.field: (r.value, r.source[-1], r.confidence) for r in viz.extract(spark.createDataFrame(rows, ITEM)).collect()}
    assert got["nationality"][:2] == ("uzb", "viz") and got["surname_viz"][0] == "IVANOVA" and got["sex"][:2] == ("F", "reading_order")
    assert got["birth_date"][0] == "03.04.1991"  # the surer caption's


def test_layouts(spark):
    def seen(texts, fields=()):
        schema = "doc_id int, field string, value string, raw string, source array<string>, confidence double"
        have = spark.createDataFrame([(1, f, v, v, ["viz"], 0.9) for f, v in fields], schema)
        out, kinds = viz.visual_document(page(spark, texts), have)
        return found(out), [(r.type, r.state) for r in kinds.collect()]

    got, kind = seen(["PASSPORT", "姓名/Name", "ZHANGWEI", "男/M", "中国 CHINESE", "15 SEP 1980", "01 JAN 2020", "31 DEC 2029", "E12345678"])
    assert kind == [("PASSPORT", "CHN")] and (got["surname_viz"], got["given_names_viz"], got["full_name"]) == ("ZHANG", "WEI", "ZHANG WEI")
    assert (got["birth_date"], got["issue_date"], got["expiry_date"], got["document_number"], got["sex"], got["nationality"]) == ("1980-09-15", "2020-01-01", "2029-12-31", "E12345678", "M", "CHN")
    got, kind = seen(["中华人民共和国签证", "A 1234567", "A.PETROV", "05MAY1991"], [("surname_viz", "X"), ("document_number", "OLD")])
    assert kind == [("VISA", "CHN")] and got == {"document_number": "A1234567", "full_name": "A. PETROV", "birth_date": "1991-05-05"}
    got, kind = seen(["往来台湾通行证", "L12345678", "LI.MING", "1990.02.03", "2030/01/01"], [("full_name", "KEPT")])
    assert kind == [("TAIWAN_TRAVEL_PERMIT", "CHN")] and got == {"document_number": "L12345678", "full_name": "KEPT", "birth_date": "1990.02.03"}
    got, kind = seen(["TURKIYE CUMHURIYETI KIMLIK KARTI", "12345678901", "YILMAZ", "AYSE", "A12B34567", "01.02.1990", "01.02.2030"])
    assert kind == [("ID_CARD", "TUR")] and got == {"personal_number": "12345678901", "surname_viz": "YILMAZ", "given_names_viz": "AYSE", "document_number": "A12B34567", "birth_date": "01.02.1990"}
    assert seen(["nothing here"]) == ({}, [])


def test_vehicle_fields(spark):
    pages = {
        1: ["号牌号码", "caption", "京 A12345", "品牌型号 陕汽牌SX4250XC4", "车辆识别代号 LZGJLDR40AX012345", "注册日期 2019-05-06", "重型半挂牵引车"],
        2: ["VIN: XW8ZZZ61ZJG000001", "MODEL ABC", "ДАТА РЕГИСТРАЦИИ 01.02.2015", "SHACMANSX", "Микроавтобус"],
        3: ["РЕГИСТРАЦИОННЫЙ НОМЕР", "01A123BC", "ТРАНСПОРТ", "Дизель-поезд"], 4: ["no vehicle at all"],
    }
    rows = spark.createDataFrame([(d, i, t) for d, ts in pages.items() for i, t in enumerate(ts)], "doc_id int, line_no int, text string")
    got = {r.doc_id: r for r in vehicle.vehicle_records(rows).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].registration_number, got[1].model, got[1].vin, got[1].registration_date, got[1].make, got[1].type_code) == ("京A12345", "SX4250XC4", "LZGJLDR40AX012345", "2019-05-06", "SHAANXI", "307")
    assert (got[2].vin, got[2].model, got[2].registration_date, got[2].make_code, got[2].type_code, got[2].type) == ("XW8ZZZ61ZJG000001", "ABC", "01-02-2015", "561", "324", "Микроавтобус")
    assert (got[3].registration_number, got[3].type_code) == ("01A123BC", "205")
    brands = spark.createDataFrame([("9", "ABC"), ("8", "SHACMAN")], "code string, name string")
    assert {r.doc_id: r.make for r in vehicle.vehicle_records(rows, brands=brands).collect()}[2] == "ABC"
    items_ = spark.createDataFrame([(3, 0, "MODEL", 0.9, 10.0, 10.0, 60.0, 30.0), (3, 1, "KAMAZ5490", 0.9, 100.0, 10.0, 200.0, 30.0)], ITEM)
    assert {r.doc_id: r.model for r in vehicle.vehicle_records(rows, items_).collect()}[3] == "KAMAZ5490"


def test_recognize_raw_zone_and_passes(spark):
    from veridoc.operators import recognize

    broken = SPECIMEN[1][:43] + "Z"  # no flip can make its last digit hold
    first = page(spark, ["PASSPORT", "Surname", "ERIKSSON", SPECIMEN[0], broken], 1).unionByName(page(spark, ["no zone", "Sex", "F"], 2))
    second = page(spark, ["PASSPORT", "Surname", "ERIKSON", SPECIMEN[0], broken], 1)
    zone = page(spark, list(SPECIMEN), 1).withColumn("crop", F.lit(1))
    region = page(spark, ["Given names", "ANNA MARIA"], 1)
    got = {r.doc_id: r for r in recognize.recognize(recognize.Passes(first, second, region, zone), "2026-01-01").collect()}
    assert got[1].zone.lines == list(SPECIMEN) and all(got[1].zone.checks.values()) and got[1].status == "review" and "UNSUPPORTED_ISSUING_STATE" in got[1].reasons
    assert "OCR_VERIFICATION_FIELD_DIFF_SURNAME_VIZ" in got[1].reasons and got[1].fields["given_names_viz"].value == "ANNA MARIA" and "name_region" in got[1].fields["given_names_viz"].source
    assert got[2].status == "retry_capture" and got[2].reasons == ["MRZ_NOT_FOUND"] and got[2].fields["sex"].value == "F" and got[2].zone.format is None
    assert got[1].provenance.verification.primary_objects == 5 and got[1].provenance.verification.field_conflicts == ["surname_viz"]


def test_matching_is_the_best():
    import itertools
    import random

    rng = random.Random(1)
    for n in (1, 2, 3, 5, 6):
        for _ in range(20):
            w = [[round(rng.random(), 2) if rng.random() < 0.7 else 0.0 for _ in range(n)] for _ in range(n)]
            best = max(sum(w[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            picks = evaluate.matching(w)
            assert sorted(picks) == list(range(n)) and sum(w[i][j] for i, j in enumerate(picks)) == pytest.approx(best)
    assert len(evaluate.matching([[float((i * j) % 7) for j in range(60)] for i in range(60)])) == 60


def test_files_and_sinks(spark, tmp_path):
    import json

    import numpy as np

    from veridoc.sources import ingest

    root = tmp_path / "files" / "UZB"
    root.mkdir(parents=True)
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (9000).to_bytes(4, "big") + (9000).to_bytes(4, "big")
    for name, data in (("a.jpg", b"\xff\xd8\xff123"), ("b.png", png), ("c.pdf", b"plain"), ("d.txt", b"x"), ("e.jpg", b"")):  # Spark leaves empty files out
        (root / name).write_bytes(data)
    files = ingest.scan_files(spark, str(tmp_path / "files"))
    errors = {r.path.rsplit("/", 1)[1]: (r.e, r.country) for r in files.withColumn("e", ingest.input_error(F.col("content"), F.col("length"))).collect()}
    assert errors == {"a.jpg": (None, "UZB"), "b.png": ("TOO_MANY_PIXELS", "UZB"), "c.pdf": ("UNSUPPORTED_FORMAT", "UZB")}
    assert len(ingest.ordered_scan(files).collect()) == 3 and ingest.uploads(spark, [("x", b"1"), ("y", b"1"), ("z", b"2")]).count() == 2
    seen = ingest.recognize(files, lambda: lambda data: [(0, "primary", 0, str(len(data)), 0.9, 0.0, 0.0, 1.0, 1.0)] if data != b"plain" else 1 / 0)
    assert sorted((r.pass_name, r.text) for r in seen.collect())[0] == ("error", "ZeroDivisionError")
    assert ingest.first_page(seen).count() == 3 and ingest.capped_pages(seen, 1).count() == 3

    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "t.json").write_text(json.dumps([{"file": "a.jpg", "passport": {"last_name": "X", "mrz_lines": ["A"]}, "vehicles": [{"vin": "V"}]}, {"file": "none.jpg"}]))
    truth = ingest.read_truth(spark, str(tmp_path / "truth"))
    assert [r.passport.last_name for r in ingest.truth_with_files(truth, files).collect()] == ["X"]
    (tmp_path / "types.json").write_text(json.dumps([{"code": "1", "name": "N", "description": ""}]))
    assert ingest.read_dimension(spark, str(tmp_path / "types.json")).first().name == "N"

    rows = spark.createDataFrame([(1, ["a", "b"], None)], "id int, reasons array<string>, note string")
    ingest.write_json(rows, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first().value) == {"id": 1, "reasons": ["a", "b"], "note": None}
    ingest.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().reasons == "a|b"
    ingest.write_errors(rows.drop("reasons"), str(tmp_path / "errors"))
    assert next((tmp_path / "errors").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbf") and "| 1 |" in ingest.markdown_report(rows.select("id"), "T")

    image = np.arange(100 * 60, dtype=np.uint8).reshape(100, 60)
    assert ingest.resampled(image, 0.5).shape == (50, 30) and ingest.resampled(np.full((4, 4, 3), 7, np.uint8), 2.0).tolist() == np.full((8, 8, 3), 7).tolist()
    assert ingest.zone_crop(image).shape == (35, 60) and ingest.name_crop(image).shape[1] == 2200 and ingest.page_scale(700) == 2.0 and len(ingest.image_quality(image)) == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def captions_and_items(spark, path):
    """In files, which have a size that joins go by."""
    rows = [(d, i, t, 0.9, float(x), float(y), float(x + 150), float(y + 25)) for d in range(3) for i, (t, x, y) in enumerate([("Passport No", 10, 10), (f"AB {d}", 220, 10), ("Sex", 10, 60), ("F", 10, 95), ("Nationality: UZB", 10, 200)])]
    items_ = spark.createDataFrame(rows, ITEM)
    known = [(d, i, f, a) for d in range(3) for i, f, a in ((0, "document_number", "passport no"), (2, "sex", "sex"), (4, "nationality", "nationality"))]
    items_.write.parquet(f"{path}/items")
    spark.createDataFrame(known, "doc_id int, item_idx int, field string, alias string").write.parquet(f"{path}/known")
    return spark.read.parquet(f"{path}/known"), spark.read.parquet(f"{path}/items")


def test_captions_equal_a_look_at_every_alias(spark):
    import random

    rng, every = random.Random(3), [(f, a) for f, names in viz.ALIASES.items() for a in names]
    texts = [None, ""]
    for _, a in every:
        b = rng.choice(every)[1]
        texts += [a, a.upper(), f"x {a}: 1", f"({a})", f"x{a}", f"{a}x", a.replace(" ", "") + " 12", f"{a} / {b}", f"{b}-{a}", f"_{a}_"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, item_idx int, text string")
    pairs = rows.withColumn("_n", viz.norm(F.col("text"))).withColumn("_c", F.regexp_replace("_n", r"(?U)\W", "")).crossJoin(viz.aliases(spark))
    inside = F.when(F.col("cjk"), F.col("_n").startswith(F.col("alias"))).otherwise(F.expr("regexp_like(_n, pattern)"))
    joined = (F.length("compact") >= 6) & F.col("_c").startswith(F.col("compact")) & (F.length("_c") <= F.length("compact") + 14)
    tier = F.when(inside, 1).when(joined, 2)
    want = pairs.withColumn("t", tier).where("t is not null").groupBy("item_idx").agg(F.min(F.struct("field_ord", "t", -F.col("len"), "alias_ord", "field", "alias")).alias("b")).select("item_idx", "b.field", "b.alias", "b.t")
    got = viz.label_match(rows)
    assert "NestedLoop" not in plan_of(got)
    assert sorted((r.item_idx, r.field, r.alias, r.tier) for r in got.collect()) == sorted(map(tuple, want.collect()))


def test_nearest_value_sends_no_items_through_the_driver(spark, tmp_path):
    known, items_ = captions_and_items(spark, tmp_path)
    got = viz.nearest_value(known.drop("alias"), items_)
    assert "Broadcast" not in plan_of(got)
    assert sorted((r.doc_id, r.field, r.value, r.value_idx) for r in got.collect()) == [(d, f, v, i) for d in range(3) for f, v, i in (("document_number", f"AB {d}", 1), ("sex", "F", 3))]


def test_extract_sends_no_items_through_the_driver(spark, tmp_path):
    known, items_ = captions_and_items(spark, tmp_path)
    got = viz.extract(items_, known)
    assert "Broadcast" not in plan_of(got) and "Broadcast" not in plan_of(viz.reading_order(known, items_))
    assert sorted((r.doc_id, r.field, r.value) for r in got.collect()) == [(d, f, v) for d in range(3) for f, v in (("document_number", f"AB {d}"), ("nationality", "uzb"), ("sex", "F"))]


def test_fuzzy_captions_are_compared_where_letters_allow_it():
    from difflib import SequenceMatcher

    names = [(f, viz.plain_norm(a)) for f, al in viz.ALIASES.items() for a in al if len(viz.plain_norm(a)) >= 6]
    texts = ["passqort number", "", "oate of bith", "x" * 50, "дата рожцения", "姓名姓名姓名", "\U0001f600 of birth date", *[a[1:] + "z" for _, a in names]]
    for text, some in zip(texts, viz.candidates(texts, names, 0.84)):
        assert [n for n in names if SequenceMatcher(None, text, n[1]).quick_ratio() >= 0.84] == some


def test_audit_sends_no_items_through_the_driver(spark, tmp_path):
    known, items_ = captions_and_items(spark, tmp_path)
    fields = viz.nearest_value(known, items_)
    got = viz.mapping_audit(items_.unionByName(items_.limit(1).withColumn("doc_id", F.lit(None).cast("int"))), known, fields)
    assert "Broadcast" not in plan_of(got)
    want = {0: "label", 1: "value", 2: "label", 3: "unmapped", 4: "label"}  # a value of one sign is not looked for
    assert sorted((r.doc_id, r.item_idx, r.role) for r in got.where("doc_id is not null").collect()) == [(d, i, want[i]) for d in range(3) for i in range(5)]
    assert [r.role for r in got.where("doc_id is null").collect()] == ["unmapped"]  # a row without a page stays


def test_recognition_merges_pages_and_reads_rows_once(spark, tmp_path):
    """No relation of pages is sent through the driver, and both readings of the zone share one clustering into rows."""
    from veridoc.operators import recognize

    page(spark, ["PASSPORT", *SPECIMEN]).write.parquet(f"{tmp_path}/p")
    for d in recognize.zone_candidates(spark.read.parquet(f"{tmp_path}/p"), 0):
        assert "Broadcast" not in plan_of(d) and "collect_list(struct(c" not in plan_of(d).lower() and "/rows-" in d.inputFiles()[0]
