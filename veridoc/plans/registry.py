"""All queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import mrz
from veridoc.operators import evaluate, items, recognize, reconcile, vehicle, viz
from veridoc.sources import derived
from veridoc.sources.derived import TODAY, table
from veridoc.sources.kept import kept

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split("\n"))
        return f

    return keep


# --- the derived relations in SQL ---------------------------------------------------------------

A36 = mrz.ALPHABET


def ck(s: str) -> str:
    return f"cast(coalesce(list_sum(list_transform(range(1, length({s}) + 1), lambda i: greatest(instr('{A36}', substr({s}, i, 1)) - 1, 0) * ([7, 3, 1])[((i - 1) % 3) + 1])), 0) % 10 as varchar)"


def pad(x: str, n: int) -> str:
    return f"lpad(cast({x} as varchar), {n}, '0')"


K = "c_custkey"
ZONE0 = f"""z0 as (select {K} id, (['CHN','UZB','RUS','TUR','KAZ','TJK','UTO'])[c_nationkey % 7 + 1] state, 'C' || {pad(K, 8)} doc, {pad(K + ' * 7 % 100', 2)} || {pad(K + ' % 12 + 1', 2)} || {pad(K + ' % 28 + 1', 2)} birth,
 {pad(K + ' % 15 + 20', 2)} || {pad(K + ' % 12 + 1', 2)} || {pad(K + ' % 28 + 1', 2)} expiry, (['M','F','<'])[{K} % 3 + 1] sex, rpad(cast({K} * 31 as varchar), 14, '<') opt, translate(cast({K} as varchar), '0123456789', 'ABCDEFGHIJ') nm,
 round((({K} * 31) % 30) / 100.0 + 0.7, 3) score from customer)"""
ZONE = f"""{ZONE0}, z1 as (select *, doc || {ck('doc')} head, birth || {ck('birth')} b, expiry || {ck('expiry')} || opt || {ck('opt')} e from z0),
 z as (select id, rpad('P<' || state || 'CUSTOMER<<N' || nm || '<ANNA', 44, '<') line1, head || state || b || sex || e || {ck('(head || b || e)')} line2, score from z1)"""
DAMAGED = f"""{ZONE}, d0 as (select id, case when id % 7 = 0 then substr(line1, 1, 40) else line1 end l1, case when id % 5 = 0 then substr(line2, 1, 1) || 'O' || substr(line2, 3) else line2 end l2, score from z),
 d as (select id, case when id % 11 = 0 then [l2, l1] else [l1, l2] end lines, l2 line2, score from d0)"""
CHECK_PARTS = {"document_number": ("substr(l, 1, 9)", "substr(l, 10, 1)"), "birth_date": ("substr(l, 14, 6)", "substr(l, 20, 1)"), "expiry_date": ("substr(l, 22, 6)", "substr(l, 28, 1)"), "optional_data": ("substr(l, 29, 14)", "substr(l, 43, 1)"),
               "composite": ("(substr(l, 1, 10) || substr(l, 14, 7) || substr(l, 22, 22))", "substr(l, 44, 1)")}


def ok(name: str, line: str) -> str:
    v, d = (x.replace("(l,", f"({line},") for x in CHECK_PARTS[name])
    return f"({d} = {ck(v)})"


def n_ok(line: str) -> str:
    return "(" + " + ".join(f"cast({ok(k, line)} as bigint)" for k in CHECK_PARTS) + ")"


def norm_sql(lines: str) -> str:
    """Rows long enough are whole here: a short first row is filled, an exact pair is put in order."""
    a, b = f"{lines}[1]", f"{lines}[2]"
    return f"case when {a}[1] = 'P' then [rpad({a}, 44, '<'), {b}] else [rpad({b}, 44, '<'), {a}] end"


ITEMS = """i as (select doc_id, idx - 1 item_idx, ts[idx] text, round(((doc_id * 31 + (idx - 1) * 7) % 30) / 100.0 + 0.7, 2) score, 10.0 x1, (idx - 1) * 40.0 y1, 500.0 x2, (idx - 1) * 40.0 + 30 y2
 from (select doc_id, string_split(text, chr(10)) ts, unnest(range(1, len(string_split(text, chr(10))) + 1)) idx from documents))"""
SECOND = f"""{ITEMS}, s as (select doc_id, item_idx, case when (doc_id + item_idx) % 4 = 0 then text || ' X' else text end text, round(score - 0.03, 2) score, x1, y1, x2, y2 from i where (doc_id + item_idx) % 9 <> 0)"""
_FORM = [("'Passport No'", 10, 10, 180, 35), (f"'C' || {pad(K, 8)}", 220, 10, 350, 35), ("'Date of birth'", 10, 60, 180, 85),
         (f"{pad(K + ' % 28 + 1', 2)} || '.' || {pad(K + ' % 12 + 1', 2)} || '.' || cast({K} % 60 + 1950 as varchar)", 10, 95, 180, 120), ("'Sex'", 10, 150, 60, 175),
         (f"case when {K} % 2 = 0 then 'M' else 'F' end", 700, 400, 720, 425), ("'Nationality: UZB'", 10, 200, 300, 225), ("c_mktsegment", 10, 300, 200, 325)]
FORMS = "f as (" + " union all ".join(f"select {K} doc_id, {i} item_idx, {t} text, round(({K} % 20) / 100.0 + 0.75, 2) score, {a}.0 x1, {b}.0 y1, {c}.0 x2, {d}.0 y2 from customer" for i, (t, a, b, c, d) in enumerate(_FORM)) + ")"
P = "p_partkey"
_PLATE = f"'1.' || {pad(P + ' % 90 + 10', 2)} || 'A' || {pad(P + ' % 900 + 100', 3)} || 'BC'"
_VEH = ["'VEHICLE LICENSE'", _PLATE, f"'2 ' || translate(upper(p_brand), '# ', '') || 'X' || {pad(P + ' % 1000', 3)}", f"'6.' || {pad(P + ' % 28 + 1', 2)} || '.' || {pad(P + ' % 12 + 1', 2)} || '.20' || {pad(P + ' % 20 + 5', 2)}",
        f"case when {P} % 3 = 0 then 'VIN: ' || rpad('XW' || cast({P} * 7919 as varchar), 17, 'Z') else 'PLATE NO' end", f"case when {P} % 4 = 0 then {_PLATE} else 'GRUZ' end"]
LINES = "v as (" + " union all ".join(f"select {P} doc_id, {i} line_no, {t} text from part" for i, t in enumerate(_VEH)) + ")"


# --- machine-readable zone ----------------------------------------------------------------------


@query(f"with {DAMAGED} select id, regexp_replace(translate(upper(' ' || lines[1] || '«x?'), ' «‹', '<<<'), '[^A-Z0-9<]', '', 'g') line from d")
def mrz_clean_line(spark, sf_dir):
    return derived.damaged_rows(spark, sf_dir).select("id", mrz.clean_line(F.concat(F.lit(" "), F.col("lines")[0], F.lit("«x?"))).alias("line"))


@query(f"select c_custkey id, {ck('c_name')} name_digit, {ck('upper(c_mktsegment)')} segment_digit from customer")
def mrz_check_digit(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), mrz.check_digit(F.col("c_name")).alias("name_digit"), mrz.check_digit(F.upper("c_mktsegment")).alias("segment_digit"))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", mrz.parse_td3(F.col("line1"), F.col("line2"), TODAY))


DATE = lambda s, birth: (
    f"strftime(try_cast((" + (f"case when cast(substr({s},1,2) as int) <= 26 then '20' else '19' end" if birth else f"case when abs(1900 + cast(substr({s},1,2) as int) - 2026) <= abs(2000 + cast(substr({s},1,2) as int) - 2026) then '19' when abs(2000 + cast(substr({s},1,2) as int) - 2026) <= abs(2100 + cast(substr({s},1,2) as int) - 2026) then '20' else '21' end")
    + f" || substr({s},1,2) || '-' || substr({s},3,2) || '-' || substr({s},5,2)) as date), '%Y-%m-%d')"
)
PARSE = f"""p as (select id, score, line1, line2, substr(line1, 3, 3) issuing_state, trim(regexp_replace(string_split(substr(line1, 6, 39), '<<')[1], '[<]+', ' ', 'g')) surname,
 trim(regexp_replace(substr(substr(line1, 6, 39), instr(substr(line1, 6, 39), '<<') + 2), '[<]+', ' ', 'g')) given_names, regexp_replace(substr(line2, 1, 9), '<', '', 'g') document_number, {DATE('substr(line2, 14, 6)', True)} birth_date,
 case when substr(line2, 21, 1) = '<' then 'X' else substr(line2, 21, 1) end sex, {DATE('substr(line2, 22, 6)', False)} expiry_date, rtrim(substr(line2, 29, 14), '<') optional_data, {', '.join(f"{ok(k, 'line2')} ok_{k}" for k in CHECK_PARTS)} from z)"""


@query(f"with {ZONE}, {PARSE} select id, issuing_state, surname, given_names, document_number, birth_date, sex, expiry_date, optional_data, cast(ok_document_number as int) + ok_birth_date::int + ok_expiry_date::int + ok_optional_data::int + ok_composite::int checks_passed from p")
def mrz_parse_td3(spark, sf_dir):
    return _parsed(derived.mrz_rows(spark, sf_dir)).select("id", *[F.col(f"p.{c}").alias(c) for c in ("issuing_state", "surname", "given_names", "document_number", "birth_date", "sex", "expiry_date", "optional_data")], mrz.passed(F.col("p.checks")).alias("checks_passed"))


@query(f"with {ZONE0} select id, {DATE('birth', True)} birth_date, {DATE('expiry', False)} expiry_date from z0")
def mrz_dates(spark, sf_dir):
    rows = derived.mrz_rows(spark, sf_dir)
    return rows.select("id", mrz.iso_date(F.substring("line2", 14, 6), "birth", TODAY).alias("birth_date"), mrz.iso_date(F.substring("line2", 22, 6), "expiry", TODAY).alias("expiry_date"))


@query(f"with {ZONE} select id, trim(regexp_replace(line1, '[<\\s]+', ' ', 'g')) name from z")
def mrz_names(spark, sf_dir):
    return derived.mrz_rows(spark, sf_dir).select("id", mrz.clean_name(F.col("line1")).alias("name"))


@query(f"with {DAMAGED}, n as (select id, {norm_sql('lines')} l from d) select id, l[1] line1, l[2] line2 from n")
def mrz_normalize_lines(spark, sf_dir):
    return derived.damaged_rows(spark, sf_dir).select("id", mrz.normalize_lines(F.col("lines")).alias("l")).select("id", F.get("l", F.lit(0)).alias("line1"), F.get("l", F.lit(1)).alias("line2"))


_MIX = "'OIBSG01856', '01856OIBSG'"
#: Every flip of the first eight mixed-up places of a row with a failing required check, by brute force.
REPAIRED = f"""q as (select id, l2 line2, score, [i for i in range(1, 45) if contains('OIBSG01856', substr(l2, i, 1))][1:8] ps, {' and '.join(ok(k, 'l2') for k in CHECK_PARTS if k != 'optional_data')} fine from d0),
 m as (select id, line2, ps, unnest(range(1, cast(pow(2, len(ps)) as bigint))) m from q where not fine and len(ps) > 0),
 t as (select id, m, array_to_string([case when list_contains(ps, i) and (m >> (len(ps) - list_position(ps, i))) & 1 = 1 then translate(substr(line2, i, 1), {_MIX}) else substr(line2, i, 1) end for i in range(1, 45)], '') c from m),
 s as (select id, m, c, {n_ok('c')} * 10 - bit_count(m) sc from t), w as (select id, m, c, sc from s qualify row_number() over (partition by id order by sc desc, m) = 1),
 r as (select q.id, q.line2, q.score, case when sc >= 39 then c else line2 end repaired, case when sc >= 39 then cast(bit_count(m) as int) else 0 end changes from q left join w on w.id = q.id)"""


@query(f"with {DAMAGED}, {REPAIRED} select id, line2, repaired, changes, cast(len([i for i in range(1, 45) if substr(line2, i, 1) <> substr(repaired, i, 1)]) as int) logged from r")
def mrz_repair(spark, sf_dir):
    return mrz.repair_rows(derived.damaged_rows(spark, sf_dir).select("id", "line2")).withColumn("logged", F.size("repairs")).drop("repairs")


@query(f"with {ZONE} select id, 'CUSTOMER' surname, trim(regexp_replace(split_part(line1, '<<', 2), '[<]+', ' ', 'g')) given_names from z")
def mrz_raw_identity(spark, sf_dir):
    found = derived.mrz_rows(spark, sf_dir).select("id", mrz.raw_identity(F.concat(F.lit("SAMPLE<"), F.col("line1"))).alias("r"))
    return found.select("id", "r.surname", F.regexp_replace("r.given_names", " +$", "").alias("given_names"))


@query(f"with {DAMAGED}, {PARSE} select d0.id, 'TD3' document_type, issuing_state, replace(substr(l2, 1, 9), '<', '') document_number, replace(substr(l2, 11, 3), '<', '') nationality, birth_date, sex, expiry_date from d0 join p on p.id = d0.id")
def mrz_raw_document(spark, sf_dir):
    return derived.damaged_rows(spark, sf_dir).select("id", mrz.raw_document(F.col("lines"), TODAY).alias("r")).select("id", "r.*")


CONF = "least(0.99, 0.7 + 0.055 * (ok_document_number::int + ok_birth_date::int + ok_expiry_date::int + ok_optional_data::int + ok_composite::int))"


@query(f"with {DAMAGED}, z9 as (select id, score, l2 line2, line1 from d0 join (select id i, line1 from z) on i = id), {PARSE.replace('from z)', 'from z9)')} " + " union all ".join(
    f"select id, '{n}' field, {n if n != 'nationality' else 'substr(line2, 11, 3)'} \"value\", {('ok_' + n) if n in CHECK_PARTS else 'cast(null as boolean)'} checksum_valid, round({f'case when not ok_{n} then least(0.58, {CONF}) else {CONF} end' if n in CHECK_PARTS else CONF}, 3) confidence from p"
    for n in ("document_number", "surname", "given_names", "nationality", "birth_date", "sex", "expiry_date", "optional_data")))
def mrz_fields_unpivot(spark, sf_dir):
    lines = derived.mrz_rows(spark, sf_dir).select("id", "line1")
    return reconcile.td3_fields(_parsed(derived.damaged_rows(spark, sf_dir).select("id", "line2").join(lines, "id")))


def _candidates(spark, sf_dir) -> DataFrame:
    """Two candidates of each zone: as it was read, and with its first data character lost to a letter no check allows."""
    rows = derived.damaged_rows(spark, sf_dir).select("id", mrz.normalize_lines(F.col("lines")).alias("l"), "score")
    pair = rows.select("id", F.get("l", F.lit(0)).alias("line1"), F.get("l", F.lit(1)).alias("line2"), "score", F.lit(0).alias("idx"))
    worse = pair.withColumn("line2", F.concat(F.lit("Z"), F.substring("line2", 2, 43))).withColumn("score", F.col("score") - 0.2).withColumn("idx", F.lit(1))
    return pair.unionByName(worse)


_BEST = f"{DAMAGED}, {REPAIRED}"


@query(f"with {_BEST} select id, repaired line2, changes, cast({n_ok('repaired')} as int) checks_passed from r")
def mrz_best_parse(spark, sf_dir):
    """The best reading over both candidates, each as it is and repaired."""
    found = mrz.best_parse(_candidates(spark, sf_dir), TODAY)
    return found.select("id", "line2", F.size("repairs").alias("changes"), mrz.passed(F.col("p.checks")).alias("checks_passed"))


_STATE = "(['CHN','UZB','RUS','TUR','KAZ','TJK','UTO'])[c_nationkey % 7 + 1]"
_REQUIRED = " and ".join(ok(k, "repaired") for k in CHECK_PARTS if k != "optional_data")


@query(f"""with {_BEST}, x as (select r.*, {_STATE} state, {_REQUIRED} fine, id % 13 = 0 bad from r join customer on c_custkey = id) select id, case when fine and state <> 'UTO' then 'accepted' when not fine and bad then 'retry_capture' else 'review' end status,
 array_to_string([z for z in [case when bad then 'IMAGE_BLUR' end, case when changes > 0 then 'MRZ_OCR_CHECKSUM_CORRECTED' end, case when state = 'UTO' then 'UNSUPPORTED_ISSUING_STATE' end, {', '.join(f"case when not {ok(k, 'repaired')} then 'MRZ_{k.upper()}_CHECKSUM_FAILED' end" for k in CHECK_PARTS)}] if z is not null], '|') reasons from x""")
def decision_status(spark, sf_dir):
    bad = F.col("id") % 13 == 0
    rows = mrz.best_parse(_candidates(spark, sf_dir), TODAY).select("id", "p", F.size("repairs").alias("changes"), F.lit(True).alias("lines_found"), F.when(bad, "retry").otherwise("ok").alias("quality_status"), F.when(bad, F.array(F.lit("IMAGE_BLUR"))).alias("quality_reasons"))
    return reconcile.decide(rows).select("id", "status", F.array_join("reasons", "|").alias("reasons"))


@query(f"with {ZONE}, {PARSE} select case when issuing_state = 'UTO' then 'review' else 'accepted' end status, count(*) n from p group by 1")
def decision_counts(spark, sf_dir):
    rows = _parsed(derived.mrz_rows(spark, sf_dir)).select("id", "p", F.lit(0).alias("changes"), F.lit(True).alias("lines_found"), F.lit("ok").alias("quality_status"))
    return reconcile.decide(rows).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {ZONE}, {PARSE} select id, case when issuing_state = 'UTO' and id % 3 = 0 and id % 2 = 0 then 'KAZ' else issuing_state end state from p")
def issuing_state_reconcile(spark, sf_dir):
    rows = _parsed(derived.mrz_rows(spark, sf_dir))
    return rows.select("id", reconcile.issuing_state(F.col("p.issuing_state"), F.when(F.col("id") % 2 == 0, "PASSPORT").otherwise("VISA"), F.when(F.col("id") % 3 == 0, "KAZ").otherwise("XXX")).alias("state"))


# --- items and passes ---------------------------------------------------------------------------


@query(f"with {ITEMS} select doc_id, item_idx, trim(text, ' ') text, least(greatest(score * 1.3 - 0.1, 0.0), 1.0) score, row_number() over (partition by doc_id order by y1, x1, item_idx) place from i where trim(text, ' ') <> ''")
def ocr_item_cleanup(spark, sf_dir):
    found = items.clean_items(derived.ocr_items(spark, sf_dir).withColumn("score", F.col("score") * 1.3 - 0.1))
    return found.select("doc_id", F.col("item_idx").cast("long").alias("item_idx"), "text", "score", "place")


@query(f"""with {SECOND}, known as (select distinct doc_id, lower(trim(text, ' ')) k from i), new as (select s.*, lower(trim(text, ' ')) k, row_number() over (partition by doc_id, lower(trim(text, ' ')) order by item_idx) n from s where trim(text, ' ') <> '')
 select doc_id, item_idx, text, score, 'primary' pass from i union all select doc_id, item_idx, text, score, 'verification' pass from new where n = 1 and not exists (select 1 from known where known.doc_id = new.doc_id and known.k = new.k)""")
def ocr_merge_rows(spark, sf_dir):
    first = derived.ocr_items(spark, sf_dir)
    return items.merge_rows(first, derived.second_pass(first)).select("doc_id", F.col("item_idx").cast("long").alias("item_idx"), "text", "score", "pass")


@query(f"""with {SECOND}, t as (select doc_id, k, bit_or(b) m from (select doc_id, lower(trim(text, ' ')) k, 1 b from i union all select doc_id, lower(trim(text, ' ')), 2 from s) group by 1, 2)
 select doc_id, case when count(*) filter (k <> '') = 0 then 1.0 else round(count(*) filter (k <> '' and m = 3) / count(*) filter (k <> ''), 3) end agreement from t group by 1""")
def ocr_text_agreement(spark, sf_dir):
    first = derived.ocr_items(spark, sf_dir)
    return items.text_agreement(first, derived.second_pass(first))


@query(f"with {FORMS}, r as (select doc_id, item_idx, case item_idx when 0 then 0 when 1 then 0 when 2 then 1 when 3 then 2 when 4 then 3 when 6 then 4 when 7 then 5 when 5 then 6 end row_idx, text, x1, score from f) select doc_id, cast(row_idx as bigint) row_idx, string_agg(text, '' order by x1, item_idx) text, round(avg(score), 4) score from r group by 1, 2")
def ocr_visual_lines(spark, sf_dir):
    return items.visual_rows(derived.forms(spark, sf_dir))


@query()
def mrz_raw_rows(spark, sf_dir):
    rows = derived.damaged_rows(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode("lines").alias("row_idx", "text"))
    return items.raw_zone_rows(rows).select("doc_id", F.array_join("lines", "|").alias("lines"))


# --- visual zone --------------------------------------------------------------------------------

LABELS = f"{FORMS}, lab as (select doc_id, item_idx, case item_idx when 0 then 'document_number' when 2 then 'birth_date' when 4 then 'sex' when 6 then 'nationality' end field, case item_idx when 0 then 'passport no' when 2 then 'date of birth' when 4 then 'sex' when 6 then 'nationality' end alias from f where item_idx in (0, 2, 4, 6))"


@query(f"with {LABELS} select doc_id, cast(item_idx as int) item_idx, field, alias, cast(1 as bigint) tier from lab")
def label_match(spark, sf_dir):
    return viz.label_match(derived.forms(spark, sf_dir))


@query()
def label_match_fuzzy(spark, sf_dir):
    bad = derived.forms(spark, sf_dir).withColumn("text", F.replace(F.replace("text", F.lit("Passport"), F.lit("Passqort")), F.lit("birth"), F.lit("bitth")))
    return viz.label_match_fuzzy(bad)


@query(f"""with {LABELS} select doc_id, field, cast(case field when 'document_number' then 1 when 'birth_date' then 3 end as bigint) value_idx, text "value", case field when 'document_number' then 40.0 when 'birth_date' then 20.0 end distance,
 round(least(score, score * greatest(0.72, 1 - case field when 'document_number' then 40.0 else 20.0 end / 1200)), 3) confidence from (select lab.doc_id, lab.field, f.text, f.score from lab join f on lab.doc_id = f.doc_id and f.item_idx = lab.item_idx + 1 where lab.field in ('document_number', 'birth_date'))""")
def spatial_nearest(spark, sf_dir):
    forms = derived.forms(spark, sf_dir)
    return viz.nearest_value(viz.label_match(forms), forms).drop("label_idx")


@query(f"with {LABELS}, o as (select *, row_number() over (partition by doc_id order by y1, x1, item_idx) p from f) select lab.doc_id, lab.field, v.text \"value\", round(least(v.score, 0.82), 3) confidence from lab join o v on v.doc_id = lab.doc_id and v.item_idx = case lab.field when 'document_number' then 1 when 'birth_date' then 3 when 'sex' then 5 else 7 end join o l on l.doc_id = lab.doc_id and l.item_idx = lab.item_idx where v.p - l.p between 1 and 6")
def reading_order(spark, sf_dir):
    forms = derived.forms(spark, sf_dir)
    return viz.reading_order(viz.label_match(forms), forms)


@query(f"""with {LABELS}, x as (select lab.doc_id, lab.field, f.text, f.score, lab.item_idx from lab join f on f.doc_id = lab.doc_id and f.item_idx = case lab.field when 'document_number' then 1 when 'birth_date' then 3 when 'sex' then 5 else 6 end)
 select doc_id, field, case when field = 'nationality' then 'uzb' else text end "value", case when field = 'sex' then 'viz|reading_order' else 'viz' end source,
 round(case field when 'document_number' then score * (1 - 40.0 / 1200) when 'birth_date' then score * (1 - 20.0 / 1200) when 'sex' then least(score, 0.82) else score end, 3) confidence from x""")
def viz_extract(spark, sf_dir):
    return viz.extract(derived.forms(spark, sf_dir)).select("doc_id", "field", "value", F.array_join("source", "|").alias("source"), "confidence")


@query(f"""with {FORMS}, d as (select 'birth_date' field union all select 'sex' union all select 'document_number' union all select 'surname_viz' union all select 'personal_number') select f.doc_id, item_idx, field,
 case field when 'birth_date' then item_idx = 3 when 'sex' then item_idx = 5 when 'document_number' then item_idx in (1, 3) when 'surname_viz' then item_idx in (6, 7) else item_idx in (1) and false end ok from f, d""")
def candidate_validate(spark, sf_dir):
    fields = F.explode(F.array(*map(F.lit, ("birth_date", "sex", "document_number", "surname_viz", "personal_number"))))
    return derived.forms(spark, sf_dir).withColumn("field", fields).select("doc_id", "item_idx", "field", viz.valid_candidate(F.col("field"), F.col("text")).alias("ok"))


@query("select o_orderkey id, case when month(o_orderdate) < 10 and day(o_orderdate) > 9 and day(o_orderdate) % 10 = month(o_orderdate) then strftime(o_orderdate, '%Y-%m-0') || cast(day(o_orderdate) // 10 as varchar) else strftime(o_orderdate, '%Y-%m-%d') end named, strftime(o_orderdate, '%Y-%m-%d') numbered, cast(null as varchar) broken from orders")
def ocr_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), viz.ocr_date(F.upper(F.date_format("o_orderdate", "dd MMM yyyy"))).alias("named"), viz.ocr_date(F.date_format("o_orderdate", "d.M.yyyy")).alias("numbered"), viz.ocr_date(F.lit("31.02.2020")).alias("broken"))


@query("select c_custkey id, case when c_custkey % 3 = 0 then 'ALPHA' else 'ZHANG' end surname, case when c_custkey % 3 = 0 then 'BETA GAMMA' else 'WEI' || translate(cast(c_custkey as varchar), '0123456789', 'ABCDEFGHIJ') end given_names from customer")
def name_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, "Alpha , Beta  Gamma").otherwise(F.concat(F.lit("ZHANGWEI"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "ABCDEFGHIJ")))
    return c.select(F.col("c_custkey").alias("id"), viz.split_name(name).alias("n")).select("id", "n.surname", "n.given_names")


@query("select c_custkey doc_id, lpad(cast(c_custkey as varchar), 12, '7') number, round(least(0.78, 0.7 + (c_custkey % 20) / 100.0), 3) confidence from customer where c_custkey % 4 <> 0")
def personal_number(spark, sf_dir):
    k = F.col("c_custkey")
    n = F.lpad(k.cast("string"), 12, "7")
    one = F.array(F.concat(F.lit("IIN "), F.substring(n, 1, 6), F.lit(" "), F.substring(n, 7, 6)))
    two = F.array_append(one, F.lit("880000000017"))
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.round((k % 20) / 100 + 0.7, 2).alias("score"), F.explode(F.when(k % 4 == 0, two).otherwise(one)).alias("text"))
    return viz.personal_number(rows, "KAZ")


@query("select o_orderkey doc_id, case o_orderkey % 5 when 0 then 'PASSPORT' when 1 then 'VISA' when 2 then 'TAIWAN_TRAVEL_PERMIT' when 3 then 'ID_CARD' end kind from orders where o_orderkey % 5 <> 4")
def document_classify(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    words = F.when(k == 0, F.array(F.lit("Passport visa"), F.lit("姓名"))).when(k == 1, F.array(F.lit("Chinese Visa"))).when(k == 2, F.array(F.lit("往来台湾通行证"))).when(k == 3, F.array(F.lit("Republic of"), F.lit("Turkey"))).otherwise(F.array(F.lit("other visa"), F.lit("Identity Card")))
    return viz.classify(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(words).alias("item_idx", "text")))


@query(f"""with {LABELS} select f.doc_id, cast(f.item_idx as bigint) item_idx, case f.item_idx when 0 then 'document_number' when 1 then 'document_number' when 2 then 'birth_date' when 3 then 'birth_date' when 4 then 'sex' when 6 then 'nationality' else '' end mapped,
 case when f.item_idx in (0, 2, 4, 6) then 'label' when f.item_idx in (1, 3) then 'value' else 'unmapped' end role, printf('%.1f%%', f.score * 100) confidence from f""")
def mapping_audit(spark, sf_dir):
    forms = derived.forms(spark, sf_dir)
    labels = viz.label_match(forms)
    found = viz.mapping_audit(forms, labels, viz.nearest_value(labels, forms))
    return found.select("doc_id", "item_idx", F.array_join("mapped_keys", "|").alias("mapped"), "role", "confidence")


# --- reconciliation and records -----------------------------------------------------------------

_FIRST = "a as (select c_custkey id, 'surname' field, case when c_custkey % 5 = 0 then '' else c_name end \"value\", 0.8 c from customer where c_custkey % 7 <> 0)"
_SECOND = "b as (select c_custkey id, 'surname' field, case when c_custkey % 3 = 0 then upper(c_name) else c_mktsegment end \"value\", round(0.7 + (c_custkey % 20) / 100.0, 2) c from customer where c_custkey % 11 <> 0)"


def _passes(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    a = c.where(k % 7 != 0).select(k.alias("id"), F.lit("surname").alias("field"), F.when(k % 5 == 0, "").otherwise(F.col("c_name")).alias("value"), F.array(F.lit("viz")).alias("source"), F.lit(0.8).alias("confidence"))
    b = c.where(k % 11 != 0).select(k.alias("id"), F.lit("surname").alias("field"), F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.col("c_mktsegment")).alias("value"), F.array(F.lit("viz")).alias("source"), F.round((k % 20) / 100 + 0.7, 2).alias("confidence"))
    return a, b


@query(f"""with {_FIRST}, {_SECOND}, j as (select coalesce(a.id, b.id) id, coalesce(a.field, b.field) field, a."value" va, a.c ca, b."value" vb, b.c cb, b.id is null nb, coalesce(a."value", '') = '' ea, lower(trim(a."value")) = lower(trim(b."value")) same from a full join b on a.id = b.id and a.field = b.field)
 select id, field, case when nb then va when ea then vb when same then va when cb > ca then vb else va end "value", case when nb then 'viz' when ea or same or cb > ca then 'viz|verification_pass' else 'viz' end source,
 cast(case when nb then ca when ea then cb when same then greatest(ca, cb) when cb > ca then cb else ca end as double) confidence, coalesce(not nb and not ea and not same, false) conflict from j""")
def fields_merge(spark, sf_dir):
    return reconcile.merge_fields(*_passes(spark, sf_dir)).withColumn("source", F.array_join("source", "|"))


@query(f"""with {_FIRST}, {_SECOND} select coalesce(a.id, b.id) id, coalesce(a.field, b.field) field, coalesce(a."value", b."value") "value", case when coalesce(a."value", '') <> '' and coalesce(b."value", '') <> '' and lower(a."value") <> lower(b."value") then 'MRZ_VIZ_SURNAME_DIFF' end reason from a full join b on a.id = b.id and a.field = b.field""")
def mrz_viz_diff(spark, sf_dir):
    return reconcile.field_diff(*_passes(spark, sf_dir))


@query("select c_custkey id, case when c_custkey % 2 = 0 then 'ANNA MARIA' when c_custkey % 3 = 0 then 'QINGWEI' else c_mktsegment end name from customer")
def name_clean(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    raw = F.when(k % 2 == 0, " /ANNA  MARIA. Date of birth 1").when(k % 3 == 0, "QINGWEIREGISTERDATE").otherwise(F.col("c_mktsegment"))
    return c.select(k.alias("id"), reconcile.clean_person(raw).alias("name"))


@query("select c_custkey id, case c_custkey % 6 when 0 then 'LEE' when 1 then 'SMITH' when 2 then 'SMITH' when 3 then 'WANG' when 4 then 'DOE' else 'POE' end name from customer")
def identity_name(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 6
    zone = F.when(k == 0, "LEE").when(k == 1, "SM1TH").when(k == 2, "SMITHXYZ").when(k == 3, "NWANG").when(k == 4, "DOE").otherwise("ROE")
    seen = F.when(k == 0, "LEE SIGNATURE").when(k == 1, "SMITH").when(k == 2, "SMITH").when(k == 3, "WANG").when(k == 4, "ROE").otherwise("POE")
    return c.select(F.col("c_custkey").alias("id"), reconcile.identity_name(zone, seen, F.lit(0.9), F.when(k == 5, 0.96).otherwise(0.8), F.lit(False), F.lit("N")).alias("name"))


def _holders(spark, sf_dir):
    p = _parsed(derived.mrz_rows(spark, sf_dir))
    blank = F.lit(None).cast("string")
    return p.select("id", F.lit("TD3").alias("type"), F.col("p.issuing_state").alias("state"), *[F.col(f"p.{c}").alias(c) for c in ("document_number", "surname", "given_names", "birth_date", "sex", "nationality", "expiry_date")],
                    blank.alias("patronymic"), F.when(F.col("id") % 2 == 0, F.lpad(F.col("id").cast("string"), 12, "0")).alias("personal_number"), F.when(F.col("id") % 5 == 0, "T1").alias("tax_number"))


@query(f"with {ZONE}, {PARSE} select id, '2.0' schema_version, document_number number, issuing_state, expiry_date, surname || ' ' || given_names full_name, birth_date, sex from p")
def passport_contract(spark, sf_dir):
    found = reconcile.passport_contract(_holders(spark, sf_dir))
    return found.select("id", "schema_version", "document.number", "document.issuing_state", "document.expiry_date", "holder.full_name", "holder.birth_date", "holder.sex")


@query(f"with {ZONE}, {PARSE} select id, surname || ' ' || given_names fio, birth_date, issuing_state country, 'TD3' document_type, document_number, case when id % 5 = 0 then 'T1' when id % 2 = 0 then lpad(cast(id as varchar), 12, '0') end inn from p")
def compact_contract(spark, sf_dir):
    return reconcile.compact_contract(reconcile.passport_contract(_holders(spark, sf_dir)))


@query("select n_nationkey id, case n_nationkey % 4 when 0 then 'ПИНФЛ / JSHSHIR' when 1 then 'T.C. Kimlik No' when 2 then 'ИИН' else 'Персональный номер' end label from nation")
def personal_number_label(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    state = F.element_at(F.array(*map(F.lit, ("UZB", "TUR", "KAZ", "RUS"))), F.col("n_nationkey") % 4 + 1)
    return n.select(F.col("n_nationkey").alias("id"), reconcile.personal_label(state).alias("label"))


@query(f"""with {_BEST}, x as (select r.id, repaired line2, {_STATE} state from r join customer on c_custkey = id) select id doc_id, case when state = 'UTO' then 'review' else 'accepted' end status, state, id % 5 = 0 corrected, substr(line2, 1, 9) document_number,
 case when substr(line2, 21, 1) = '<' then 'X' else substr(line2, 21, 1) end <> case when id % 2 = 0 then 'M' else 'F' end sex_differs, 'TD3' "format" from x""")
def recognize_documents(spark, sf_dir):
    """The whole way from items of a page to its record."""
    found = recognize.recognize(recognize.Passes(kept(derived.passport_pages(spark, sf_dir), "pages")), TODAY)
    return found.select("doc_id", "status", "state", F.array_contains("reasons", "MRZ_OCR_CHECKSUM_CORRECTED").alias("corrected"), F.col("fields")["document_number"]["value"].alias("document_number"),
                        F.array_contains("reasons", "MRZ_VIZ_SEX_DIFF").alias("sex_differs"), F.col("zone.format").alias("format"))


def _evidence(spark, sf_dir) -> DataFrame:
    """id, type, state, fields, objects made from the valid zones."""
    p = _parsed(derived.mrz_rows(spark, sf_dir))
    names = ("document_number", "surname", "given_names", "birth_date", "sex", "nationality", "expiry_date", "optional_data")
    one = lambda v, by: F.struct(v.alias("value"), v.alias("raw"), F.array(F.lit(by)).alias("source"), F.lit(0.9).alias("confidence"), F.lit(None).cast("boolean").alias("checksum_valid")).cast(reconcile.EVIDENCE)
    more = {"surname_viz": F.concat("p.surname", F.lit(" SIGNATURE")), "patronymic": F.when(F.col("id") % 3 == 0, "OLEGOVNA"), "personal_number": F.when(F.col("id") % 2 == 0, F.col("id").cast("string")), "tax_number": F.when(F.col("id") % 5 == 0, "T1")}
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), one(F.col(f"p.{n}"), "mrz").alias("v")) for n in names], *[F.struct(F.lit(n).alias("k"), one(v, "viz").alias("v")) for n, v in more.items()])
    objects = F.array(F.struct(F.lit(1).alias("index"), F.lit("x").alias("text"), F.array(F.lit("surname")).alias("mapped_keys")), F.struct(F.lit(2).alias("index"), F.lit("y").alias("text"), F.array().cast("array<string>").alias("mapped_keys")))
    return p.select("id", F.lit("TD3").alias("type"), F.when(F.col("id") % 4 != 0, F.col("p.issuing_state")).alias("state"), F.map_from_entries(pairs).alias("fields"), objects.alias("objects"))


_FULL = f"""{ZONE}, {PARSE}, f as (select id, document_number, surname, given_names, birth_date, sex, expiry_date, optional_data, substr(line2, 11, 3) nat, case when id % 4 <> 0 then issuing_state end state,
 case when id % 3 = 0 then 'OLEGOVNA' end patr, case when id % 2 = 0 then cast(id as varchar) end pers, case when id % 5 = 0 then 'T1' end tax from p),
 g as (select *, coalesce(state, case when nat <> 'UTO' then nat end) code, concat_ws(' ', surname, given_names, patr) fio from f),
 h as (select *, case code when 'CHN' then 'Китай' when 'UZB' then 'Узбекистан' when 'RUS' then 'Россия' when 'TUR' then 'Турция' when 'KAZ' then 'Казахстан' when 'TJK' then 'Таджикистан' end country from g)"""


@query(f"with {_FULL} select id, code, country, fio, document_number number, 8 + 1 + cast(patr is not null as int) + cast(pers is not null as int) + cast(tax is not null as int) - cast(optional_data = '' as int) evidence, cast(1 as int) unmapped, optional_data optional from h")
def full_contract(spark, sf_dir):
    c = reconcile.full_contract(_evidence(spark, sf_dir))
    return c.select("id", F.col("document.issuing_country_code").alias("code"), F.col("document.issuing_country").alias("country"), F.col("holder.full_name").alias("fio"), F.col("document.passport_number").alias("number"),
                    F.size("field_evidence").alias("evidence"), F.size("unmapped_objects").alias("unmapped"), F.col("mrz.optional_data").alias("optional"))


@query(f"with {_FULL} select id, fio, birth_date, country, 'TD3' document_type, document_number, coalesce(tax, pers) inn from h")
def compact_record(spark, sf_dir):
    return reconcile.compact_record(reconcile.full_contract(_evidence(spark, sf_dir)))


@query(f"""with {_FULL}, r as (select id, unnest([{{'place': 0, 'label': 'Фамилия', 'value': surname}}, {{'place': 1, 'label': 'Имя', 'value': given_names}}, {{'place': 2, 'label': 'Дата рождения', 'value': birth_date}}, {{'place': 3, 'label': 'Пол', 'value': case sex when 'M' then 'Мужской' when 'F' then 'Женский' else sex end}},
 {{'place': 4, 'label': 'Гражданство', 'value': nat}}, {{'place': 5, 'label': 'Страна выдачи', 'value': coalesce(code, '')}}, {{'place': 6, 'label': 'Номер паспорта', 'value': document_number}}, {{'place': 7, 'label': 'Срок действия', 'value': expiry_date}}, {{'place': 8, 'label': 'Персональный номер', 'value': coalesce(pers, optional_data)}}]) r from h)
 select id, cast(r.place as int) place, r.label label, coalesce(r.value, '') "value" from r""")
def passport_rows(spark, sf_dir):
    return reconcile.passport_rows(reconcile.full_contract(_evidence(spark, sf_dir)))


# --- vehicle certificates -----------------------------------------------------------------------


@query("select p_partkey id, case when p_partkey % 2 = 0 then '京A' || lpad(cast(p_partkey % 100000 as varchar), 5, '0') else '' end plate from part")
def vehicle_plate(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 2 == 0, F.lit("京 a")).otherwise(F.lit("X京A")), F.lpad((k % 100000).cast("string"), 5, "0"))
    return table(spark, sf_dir, "part").select(k.alias("id"), vehicle.chinese_plate(text).alias("plate"))


@query(f"with {LINES} select doc_id, line_no, case when line_no = 4 and doc_id % 3 = 0 then substr(text, 6) else '' end vin from v")
def vehicle_vin(spark, sf_dir):
    return derived.vehicle_lines(spark, sf_dir).select("doc_id", "line_no", vehicle.vin(F.col("text")).alias("vin"))


@query(f"with {LINES} select doc_id, line_no, regexp_extract(replace(text, ' ', ''), '^([126])[.)-]?(.+)$', 1) number, regexp_extract(replace(text, ' ', ''), '^([126])[.)-]?(.+)$', 2) \"value\" from v where regexp_matches(text, '^[126][. ]')")
def vehicle_numbered_values(spark, sf_dir):
    return vehicle.numbered(derived.vehicle_lines(spark, sf_dir))


@query(f"with {LINES} select a.doc_id, substr(a.text, 3) registration_number, replace(substr(b.text, 3), ' ', '') model, substr(c.text, 3) registration_date from v a join v b on b.doc_id = a.doc_id and b.line_no = 2 join v c on c.doc_id = a.doc_id and c.line_no = 3 where a.line_no = 1")
def vehicle_numbered_records(spark, sf_dir):
    return vehicle.numbered_records(derived.vehicle_lines(spark, sf_dir))


@query(f"with {LINES} select a.doc_id, case when a.doc_id % 3 = 0 then substr(a.text, 6) else b.text end \"value\" from v a join v b on b.doc_id = a.doc_id and b.line_no = 5 where a.line_no = 4")
def vehicle_value_after(spark, sf_dir):
    return vehicle.value_after(derived.vehicle_lines(spark, sf_dir), "VIN", "PLATE NO")


@query(f"with {FORMS} select doc_id, upper(text) \"value\" from f where item_idx = 1")
def vehicle_right_of_label(spark, sf_dir):
    return vehicle.right_of_label(derived.forms(spark, sf_dir), ("PASSPORT NO",))


@query(f"with {LINES} select doc_id, line_no, cast(1 as bigint) segment from v")
def vehicle_segments(spark, sf_dir):
    return vehicle.segments(derived.vehicle_lines(spark, sf_dir)).select("doc_id", "line_no", "segment")


@query("""with r as (select l_orderkey doc_id, cast(l_linenumber as bigint) segment, case when l_linenumber % 2 = 0 then 'A1' else 'B2' end registration_number, '' vin, case when l_linenumber > 2 then l_shipmode else '' end model from (select *, l_returnflag l_shipmode from lineitem))
 select doc_id, registration_number, vin, min(segment) segment, coalesce((min({'s': segment, 'm': model}) filter (model <> '')).m, '') model from r group by 1, 2, 3""")
def vehicle_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    recs = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("segment"), F.when(F.col("l_linenumber") % 2 == 0, "A1").otherwise("B2").alias("registration_number"), F.lit("").alias("vin"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).otherwise("").alias("model"))
    return vehicle.merge_records(recs, ["model"])


@query(f"with {LINES} select doc_id, count(*) filter (line_no = 0) + case when doc_id % 3 = 0 then 1 else 1 end score, true is_vehicle from v group by 1")
def vehicle_detect(spark, sf_dir):
    return vehicle.is_vehicle(derived.vehicle_lines(spark, sf_dir))


@query("select p_partkey id, case p_partkey % 4 when 0 then '322' when 1 then '321' when 2 then '307' else '' end type_code, case p_partkey % 4 when 0 then '' when 1 then '149' when 2 then '561' else '' end make_code from part")
def vehicle_type_lookup(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "специальный автобус").when(k == 1, "东风 автобус").when(k == 2, "重型半挂牵引车 SHACMAN").otherwise("none")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), vehicle.first_alias(text, vehicle.TYPE_ALIASES).alias("type_code"), vehicle.first_alias(text, vehicle.MAKE_ALIASES).alias("make_code"))


@query(f"""with {LINES}, one as (select p_partkey doc_id, {_PLATE} plate, {_VEH[2]} model, {_VEH[3]} dy, {_VEH[4]} num from part)
 select doc_id, cast(1 as bigint) segment, case when doc_id % 3 = 0 then substr(num, 6) else '' end vin, substr(plate, 3) registration_number, replace(substr(dy, 3), '.', '-') registration_date, replace(substr(model, 3), ' ', '') model, '' make, '' type_code, '' body_number from one""")
def vehicle_records(spark, sf_dir):
    return vehicle.vehicle_records(derived.vehicle_lines(spark, sf_dir)).select("doc_id", "segment", "vin", "registration_number", "registration_date", "model", "make", "type_code", "body_number")


@query(f"""with {LINES}, one as (select p_partkey doc_id, {_PLATE} plate, {_VEH[2]} model, {_VEH[3]} dy, {_VEH[4]} num from part), r as (select doc_id, unnest([{{'place': 0, 'label': 'VIN', 'value': case when doc_id % 3 = 0 then substr(num, 6) else '' end}}, {{'place': 1, 'label': 'Марка', 'value': ''}}, {{'place': 2, 'label': 'Тип', 'value': ''}},
 {{'place': 3, 'label': 'Госномер', 'value': substr(plate, 3)}}, {{'place': 4, 'label': 'Дата регистрации', 'value': replace(substr(dy, 3), '.', '-')}}, {{'place': 5, 'label': 'Модель', 'value': replace(substr(model, 3), ' ', '')}}]) r from one)
 select doc_id, cast(1 as bigint) segment, cast(r.place as int) place, r.label label, r.value "value" from r""")
def vehicle_rows(spark, sf_dir):
    return reconcile.vehicle_rows(vehicle.vehicle_records(derived.vehicle_lines(spark, sf_dir)))


# --- evaluation ---------------------------------------------------------------------------------


@query("select event_id id, array_to_string(list_filter([case when least(user_id % 1500, 900) < 700 then 'LOW_RESOLUTION' end, case when value < 75 then 'IMAGE_BLUR' end, case when value % 256 < 45 then 'TOO_DARK' end, case when value % 256 > 225 then 'OVEREXPOSED' end, case when (event_id % 20) / 100.0 > 0.09 then 'EXCESSIVE_GLARE' end], lambda x: x is not null), '|') reasons from events")
def quality_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 1500).alias("width"), F.lit(900).alias("height"), F.col("value").alias("blur"), (F.col("value") % 256).alias("brightness"), ((F.col("event_id") % 20) / 100).alias("glare"))
    return evaluate.quality_reasons(e).select("id", F.array_join("reasons", "|").alias("reasons"))


@query("select coalesce(event_type, 'ALL') event_type, count(*) n, round(sum(case when user_id % 3 = 0 then 1 else 0 end) * 100.0 / count(*), 2) rate, round(avg(value), 2) mean_ms from events group by rollup(event_type)")
def eval_by_country(spark, sf_dir):
    return evaluate.rates(table(spark, sf_dir, "events"), "event_type", F.col("user_id") % 3 == 0, "value")


@query("select reason, count(*) n from (select unnest(case when user_id % 2 = 0 then ['A', event_type] else [event_type] end) reason from events) group by 1")
def reason_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("r", F.when(F.col("user_id") % 2 == 0, F.array(F.lit("A"), "event_type")).otherwise(F.array("event_type")))
    return evaluate.frequencies(e, "r", "reason")


@query("select cast(quantile_disc(value, 0.5) as double) p50, cast(quantile_disc(value, 0.95) as double) p95, round(median(value), 4) median, round(avg(value), 4) mean, max(value) most from events")
def latency_percentiles(spark, sf_dir):
    return evaluate.latency(table(spark, sf_dir, "events"), "value")


@query("select field, cast(sum(cast(f as int)) as bigint) filled, round(sum(cast(f as int)) * 100.0 / count(*), 2) rate from (select 'plate' field, p_partkey % 3 = 0 f from part union all select 'make', p_size > 10 from part) group by 1")
def field_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("m", F.create_map(F.lit("plate"), F.col("p_partkey") % 3 == 0, F.lit("make"), F.col("p_size") > 10))
    return evaluate.coverage(p, "m")


@query("select o_orderkey id, case o_orderkey % 3 when 0 then 'M' when 1 then 'F' else 'OTHER' end gender, case o_orderkey % 2 when 0 then 'UZB' else 'KGZ' end nationality, strftime(o_orderdate, '%Y-%m-%d') issue_date from orders")
def canonical_value(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(k.alias("id"), evaluate.canonical("gender", F.when(k % 3 == 0, "мужской").when(k % 3 == 1, "Female").otherwise("oth-er")).alias("gender"), evaluate.canonical("nationality", F.when(k % 2 == 0, "Uzbek ").otherwise("Kyrgyz Republic")).alias("nationality"), evaluate.canonical("issue_date", F.date_format("o_orderdate", "dd/MM/yyyy")).alias("issue_date"))


@query("select c_custkey id, round(1 - levenshtein(upper(replace(c_name, '#', '')), upper(replace(c_mktsegment, ' ', ''))) / cast(greatest(length(replace(c_name, '#', '')), length(c_mktsegment)) as double), 6) similarity from customer")
def similarity(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.round(evaluate.similarity(evaluate.clean_text(F.col("c_name")), evaluate.clean_text(F.col("c_mktsegment"))), 6).alias("similarity"))


_CMP = """c as (select cast(c_custkey as varchar) file, case when c_custkey % 2 = 0 then 'passport' else 'vehicle' end section, case when c_custkey % 3 = 0 then 'sex' else 'plate' end field, c_name expected, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then c_mktsegment else c_name end predicted from customer),
 o as (select *, case when expected = coalesce(predicted, '') then 'exact' when coalesce(predicted, '') = '' then 'missing' else 'wrong' end outcome from c)"""


def _compared(spark, sf_dir):
    k = F.col("c_custkey")
    return evaluate.compare(table(spark, sf_dir, "customer").select(k.cast("string").alias("file"), F.when(k % 2 == 0, "passport").otherwise("vehicle").alias("section"), F.when(k % 3 == 0, "sex").otherwise("plate").alias("field"), F.col("c_name").alias("expected"), F.when(k % 5 == 0, None).when(k % 7 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("predicted")))


@query(f"with {_CMP} select coalesce(section, 'ALL') section, coalesce(field, 'ALL') field, count(*) n, count(*) filter (outcome = 'exact') exact, round(count(*) filter (outcome = 'exact') * 100.0 / count(*), 2) accuracy from o group by grouping sets ((section, field), (section), ())")
def micro_accuracy(spark, sf_dir):
    return evaluate.micro_accuracy(_compared(spark, sf_dir))


@query(f"with {_CMP} select section, field, outcome, count(*) n from o where outcome <> 'exact' group by 1, 2, 3")
def missing_wrong(spark, sf_dir):
    return _compared(spark, sf_dir).where("outcome <> 'exact'").groupBy("section", "field", "outcome").agg(F.count("*").alias("n"))


_ENG = "a as (select c_custkey f, c_custkey % 4 <> 0 ok, (c_custkey % 100) * 1.0 acc, c_custkey % 977 ms from customer), b as (select c_custkey f, c_custkey % 5 <> 0 ok, (c_custkey % 90) * 1.0 acc, c_custkey % 799 ms from customer)"


@query(f"with {_ENG}, j as (select a.acc a1, b.acc a2, a.ms m1, b.ms m2 from a join b on a.f = b.f where a.ok and b.ok) select count(*) files, round(avg(a1), 4) acc1, round(avg(a2), 4) acc2, round(avg(m1), 4) ms1, round(avg(m2), 4) ms2, round(avg(a2) - avg(a1), 4) acc_change, round((avg(m2) - avg(m1)) * 100 / avg(m1), 4) ms_change_pct from j")
def engine_delta(spark, sf_dir):
    k = F.col("c_custkey")
    one = lambda n, m, t: table(spark, sf_dir, "customer").select(k.alias("file"), (k % n != 0).alias("ok"), (k % m * 1.0).alias("accuracy"), (k % t).alias("ms"))
    return evaluate.engine_delta(one(4, 100, 977), one(5, 90, 799))


@query("select case when d is not null and l is not null then 'both' when l is null then 'left_only' else 'right_only' end side, count(*) n from (select d.doc_id d, l.doc_id l from documents d full join labels l on d.doc_id = l.doc_id) group by 1")
def dataset_audit(spark, sf_dir):
    return evaluate.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("select doc_id, source, turn from (select doc_id, source, row_number() over (partition by source order by sha256(cast(doc_id as varchar)) desc) turn from documents) order by turn, source limit 50")
def stratified_sample(spark, sf_dir):
    return evaluate.round_robin_sample(table(spark, sf_dir, "documents"), "source", "doc_id", 50).select("doc_id", "source", "turn")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1)")
def resume_anti_join(spark, sf_dir):
    return evaluate.resume(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok")), "doc_id")


@query()
def vehicle_assignment(spark, sf_dir):
    k = F.col("p_partkey")
    one = table(spark, sf_dir, "part").select((k / 3).cast("int").cast("string").alias("file"), (k % 3).alias("idx"), F.col("p_brand").alias("plate"), F.col("p_name").alias("model"))
    return evaluate.assign(one, one.withColumn("idx", (F.col("idx") + 1) % 3), ["plate", "model"])


@query("select doc_id, substr(sha256(substr(text, 1, 1048576) || cast(strlen(text) as varchar)), 1, 12) safe_id from documents")
def safe_id(spark, sf_dir):
    from veridoc.sources import ingest

    return table(spark, sf_dir, "documents").select("doc_id", ingest.safe_id(F.encode("text", "utf-8"), F.octet_length("text")).alias("safe_id"))


@query("select o_orderkey doc_id, o_orderkey % 3 = 0 or o_orderkey % 4 = 0 is_passport from orders")
def passport_page_predicate(spark, sf_dir):
    from veridoc.sources import ingest

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), ingest.passport_page(F.when(k % 3 == 0, "a Passport page").otherwise("x"), k % 4 == 0).alias("is_passport"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query("""with c as (select c_custkey id, c_name a, c_mktsegment b from customer), t as (select id, [upper(a), upper(b)] e, case id % 3 when 0 then [upper(a), upper(b)] when 1 then [upper(b)] else [] end f from c),
 k as (select id, [regexp_replace(x, '[^A-Z0-9<]', '', 'g') for x in e] e, [regexp_replace(x, '[^A-Z0-9<]', '', 'g') for x in f] f from t),
 s as (select id, e = f exact, [1 - levenshtein(e[i], coalesce(f[i], '')) / cast(greatest(length(e[i]), length(coalesce(f[i], ''))) as double) for i in range(1, 3)] s from k) select id, exact, round(list_sum(s) / 2, 4) similarity from s""")
def zone_compare(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.array("c_name", "c_mktsegment").alias("expected"), F.when(k % 3 == 0, F.array("c_name", "c_mktsegment")).when(k % 3 == 1, F.array("c_mktsegment")).otherwise(none).alias("found"))
    return evaluate.compare_zones(rows).select("id", "exact", "similarity")


@query("select c_custkey id, case when c_custkey % 2 = 0 then c_name end last_name, case when c_custkey % 3 = 0 then c_name else cast(c_custkey as varchar) end document_number, c_mktsegment authority, cast(2 as int) zone_rows from customer")
def external_passport(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    answer = F.struct(F.when(k % 2 == 0, F.col("c_name")).otherwise(none).alias("lastName"), F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("documentNumber"), k.cast("string").alias("documentNumberOnly"),
                      F.array("c_name", "c_mktsegment").alias("mrzLines"), F.struct(F.struct(F.col("c_mktsegment").alias("authority")).alias("fields")).alias("visualZone"))
    found = evaluate.external(table(spark, sf_dir, "customer").select(k.alias("id"), F.to_json(answer).alias("json")), evaluate.EXTERNAL_PASSPORT, ["id"])
    return found.select("id", "last_name", "document_number", "authority", F.size("mrz_lines").alias("zone_rows"))


@query("select p_partkey id, case when p_partkey % 2 = 0 then p_brand else p_type end brand, p_name model, cast(null as varchar) vin from part")
def external_vehicle(spark, sf_dir):
    k = F.col("p_partkey")
    answer = F.struct(F.when(k % 2 == 0, F.col("p_brand")).alias("markRaw"), F.col("p_type").alias("markName"), F.col("p_name").alias("model"), F.lit("").alias("vin"))
    return evaluate.external(table(spark, sf_dir, "part").select(k.alias("id"), F.to_json(answer).alias("json")), evaluate.EXTERNAL_VEHICLE, ["id"]).select("id", "brand", "model", "vin")


@query(f"with {_FULL} select id, surname last_name, given_names first_name, patr patronymic, sex gender, code issuing_state, birth_date date_of_birth, cast(0 as int) zone_rows from h")
def local_passport(spark, sf_dir):
    rows = _evidence(spark, sf_dir)
    found = evaluate.local_passport(reconcile.full_contract(rows), rows.select("id", F.array().cast("array<string>").alias("lines")).where("false"))
    return found.select("id", "last_name", "first_name", "patronymic", "gender", "issuing_state", "date_of_birth", F.size("mrz_lines").alias("zone_rows"))


@query("""with v as (select l_orderkey file, cast(l_linenumber as int) page, l_returnflag vin from lineitem), o as (select o_orderkey file, case when o_orderkey % 3 = 0 then o_orderstatus else '' end nm from orders)
 select o.file, coalesce(n, 0) pages, cast(coalesce(ms, 0) as bigint) service_ms, cast(o.nm <> '' as int) passports, cast(coalesce(n, 0) as int) vehicles from o left join (select file, count(*) n, sum(page * 10) ms from v group by 1) c on c.file = o.file""")
def file_results(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pages = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("page"), (F.col("l_linenumber") * 10).cast("bigint").alias("processing_ms"))
    cars = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_returnflag").alias("vin"))
    own = o.select(F.col("o_orderkey").alias("file"), F.lit(1).alias("page"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise("").alias("last_name"), F.array().cast("array<string>").alias("mrz_lines"))
    found = evaluate.file_results(own.select("file"), pages, own, cars)
    return found.select("file", "pages", "service_ms", F.size("passports").alias("passports"), F.size("vehicles").alias("vehicles"))


@query("select event_type file, cast(sum(case when user_id % 2 = 0 or value > 50 then 1 else 0 end) + sum(user_id % 3) as bigint) documents from events group by 1")
def document_count(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return evaluate.count_documents(e.select(F.col("event_type").alias("file"), (F.col("user_id") % 2 == 0).alias("mrz_found"), (F.col("value") > 50).alias("has_name"), (F.col("user_id") % 3).cast("bigint").alias("vehicle_documents")))


@query(f"""with {ZONE}, x as (select z.*, {_STATE} state from z join customer on c_custkey = id) select cast(id as varchar) file, case when state = 'UTO' then 'review' else 'accepted' end status, true mrz_found, 100.0 mrz_checksum_score_pct, true mrz_all_five_checks_valid,
 cast(id % 5 = 0 as int) mrz_repairs, cast(10 as bigint) detected_objects, round((8 * round((id % 20) / 100.0 + 0.75, 2) + 1.8) * 10, 2) ocr_mean_confidence_pct from x""")
def image_rows(spark, sf_dir):
    """Evaluation rows of whole pages."""
    items_ = kept(derived.passport_pages(spark, sf_dir), "pages")  # every pass over the pages would make them anew
    found = recognize.recognize(recognize.Passes(items_), TODAY)
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").cast("string").alias("file"), F.lit("UZB").alias("country"), F.lit(7).alias("processing_ms"))
    return evaluate.image_rows(found, items_, runs).select("file", "status", "mrz_found", "mrz_checksum_score_pct", "mrz_all_five_checks_valid", "mrz_repairs", "detected_objects", "ocr_mean_confidence_pct")


@query(f"""with {ZONE}, x as (select z.*, {_STATE} state from z join customer on c_custkey = id) select 'd' || id document_id, false vehicle_detected, true passport_detected, true mrz_found, true surname, true issuing_state, rtrim(substr(line2, 29, 14), '<') <> '' optional_data, cast(10 as bigint) ocr_objects from x""")
def page_projection(spark, sf_dir):
    """What may leave the machine about whole pages."""
    items_ = kept(derived.passport_pages(spark, sf_dir), "pages")  # every pass over the pages would make them anew
    lines = items_.select("doc_id", F.col("item_idx").alias("line_no"), "text")
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("d"), "c_custkey").alias("document_id"), F.lit(1).alias("page"), F.lit(7).alias("processing_ms"))
    found = evaluate.page_projection(recognize.recognize(recognize.Passes(items_), TODAY), items_, vehicle.vehicle_records(lines), vehicle.is_vehicle(lines), runs)
    return found.select("document_id", "vehicle_detected", "passport_detected", "mrz_found", "passport_field_presence.surname", "passport_field_presence.issuing_state", "passport_field_presence.optional_data", "ocr_objects")
