"""Machine-readable zone (ICAO 9303 TD3) as Column expressions; no Python runs per row.

A check digit is a weighted sum modulo 10, so all five checks of a data row are one dot product of its
44 values with weights that hold a lane for each check.  A lane counts the check digit itself with weight -1;
the check holds when its lane is 0 modulo 10.  Changing one character adds a fixed number to each lane, so the repair
scores all flips of its places by adding numbers, and builds one row: the winner's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUPPORTED = ("CHN", "UZB", "RUS", "TUR", "KAZ", "TJK")
LETTER_FOR = "OIBSG"  # fixed values: letters that OCR mixes up with the digits below
DIGIT_FOR = "01856"
# Fixed values (ICAO 9303): the places each check covers, from 0, and the place of its digit.
SPANS = {
    "document_number": (((0, 9),), 9), "birth_date": (((13, 19),), 19), "expiry_date": (((21, 27),), 27), "optional_data": (((28, 42),), 42),
    "composite": (((0, 10), (13, 20), (21, 43)), 43),
}
CHECKS = tuple(SPANS)
DATA_ROW = r"^[A-Z0-9<]{9}[0-9O][A-Z<]{3}\d{6}[0-9O][MFX<]\d{6}"  # fixed value: what starts a data row, O for 0 allowed in check digits
LANE = 12  # bits of a lane of the dot product: 44 values of at most 9 times 9
SLOT = 8  # bits of a lane of the repair: a residue and eight changes of it, at most 9 each


def lane_weights(check: str) -> list[int]:
    """The weight of each of the 44 places in one check, modulo 10."""
    spans, digit = SPANS[check]
    out = [0] * 44
    for i, place in enumerate(p for a, b in spans for p in range(a, b)):
        out[place] = (7, 3, 1)[i % 3]
    out[digit] = 9
    return out


WEIGHTS = [lane_weights(c) for c in CHECKS]


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def last_digits(text: Column) -> Column:
    """Each character's value modulo 10, as a digit: letters count from 10, anything else as 0."""
    values = "".join(str(i % 10) for i in range(10, 36))
    return F.regexp_replace(F.translate(text, ALPHABET[10:], values), "[^0-9]", "0")


def check_digit(value: Column) -> Column:
    """Weights 7, 3, 1 over the characters, modulo 10; '0' for an empty value."""
    return (bound(last_digits(value), lambda d: weighted(d, constants([7, 3, 1]))) % 10).cast("string")


def clean_line(value: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(value), " «‹", "<<<"), "[^A-Z0-9<]", "")


def clean_name(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[<\s]+", " "))


def iso_date(yymmdd: Column, kind: str, today: str) -> Column:
    """Birth: this century unless later than this year.  Expiry: the century nearest to this year, the earlier on a tie."""
    year = int(today[:4])
    yy = F.substring(yymmdd, 1, 2).try_cast("int")
    if kind == "birth":
        full = F.when(yy <= year % 100, yy + 2000).otherwise(yy + 1900)
    else:
        near = F.array(*[F.struct(F.abs(yy + c - year).alias("d"), F.lit(k).alias("k"), (yy + c).alias("y")) for k, c in enumerate((1900, 2000, 2100))])
        full = F.array_min(near)["y"]
    iso = F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.substring(yymmdd, 3, 2), F.substring(yymmdd, 5, 2))
    return F.when(yymmdd.rlike(r"^\d{6}$"), F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))


def constants(values: list[int]) -> Column:
    """A constant array<bigint>, in one expression whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def weighted(digits: Column, weights: Column) -> Column:
    """The sum of each digit times its weight; ``weights`` are repeated as often as needed."""
    places = F.filter(F.sequence(F.lit(0), F.length(digits)), lambda i: i < F.length(digits))
    terms = F.transform(places, lambda i: (F.ascii(F.substring(digits, i + 1, F.lit(1))) - 48) * F.get(weights, i % F.size(weights)))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: a + x)


def residues(line2: Column) -> Column:
    """The lanes of all checks in one number, not yet modulo 10."""
    lanes = [sum(w[place] << (LANE * k) for k, w in enumerate(WEIGHTS)) for place in range(44)]
    return bound(last_digits(line2), lambda d: weighted(d, constants(lanes)))


def lane(total: Column, k: int) -> Column:
    return F.shiftright(total, LANE * k).bitwiseAND(F.lit((1 << LANE) - 1).cast("long")) % 10


def is_digit(line2: Column, check: str) -> Column:
    return F.substring(line2, SPANS[check][1] + 1, 1).between("0", "9")


def checks(line2: Column) -> Column:
    """map<string,boolean>: whether each check digit holds."""
    names = F.array(*[F.lit(n) for n in CHECKS])
    return bound(residues(line2), lambda r: F.map_from_arrays(names, F.array(*[F.coalesce((lane(r, k) == 0) & is_digit(line2, n), F.lit(False)) for k, n in enumerate(CHECKS)])))


def passed(c: Column) -> Column:
    return F.size(F.filter(F.map_values(c), lambda x: x))


def required_valid(c: Column) -> Column:
    """All checks but that of the optional data."""
    return F.size(F.map_filter(c, lambda k, v: ~v & (k != "optional_data"))) == 0


def parse_td3(line1: Column, line2: Column, today: str) -> Column:
    """A struct of the fields; null unless both rows have 44 characters and the first starts with P."""
    names = F.split(F.substring(line1, 6, 39), "<<", 2)
    at = lambda a, n: F.substring(line2, a + 1, n)
    parsed = F.struct(
        F.replace(F.substring(line1, 1, 2), F.lit("<"), F.lit("")).alias("document_type"), F.substring(line1, 3, 3).alias("issuing_state"), clean_name(F.get(names, F.lit(0))).alias("surname"),
        clean_name(F.coalesce(F.get(names, F.lit(1)), F.lit(""))).alias("given_names"), F.replace(at(0, 9), F.lit("<"), F.lit("")).alias("document_number"),
        at(10, 3).alias("nationality"), iso_date(at(13, 6), "birth", today).alias("birth_date"), at(13, 6).alias("birth_date_raw"),
        F.translate(at(20, 1), "<", "X").alias("sex"), iso_date(at(21, 6), "expiry", today).alias("expiry_date"), at(21, 6).alias("expiry_date_raw"),
        F.regexp_replace(at(28, 14), "<+$", "").alias("optional_data"), checks(line2).alias("checks"),
    )
    return F.when((F.length(line1) == 44) & (F.length(line2) == 44) & line1.startswith("P"), parsed)


def normalize_lines(lines: Column) -> Column:
    """The two rows of a zone, from cleaned rows of 20 characters or more; the first rule that applies decides."""
    kept = F.filter(F.transform(lines, clean_line), lambda s: F.length(s) >= 20)

    def pick(k: Column) -> Column:
        data = F.try_element_at(F.filter(k, lambda s: (F.length(s) == 44) & ~s.startswith("P")), F.lit(-1))
        short = F.try_element_at(F.filter(k, lambda s: s.startswith("P") & F.length(s).between(35, 43)), F.lit(-1))
        exact = F.filter(k, lambda s: F.length(s) == 44)
        two = F.slice(exact, F.greatest(F.size(exact) - 1, F.lit(1)), 2)
        ordered = F.when(F.get(two, F.lit(1)).startswith("P") & ~F.get(two, F.lit(0)).startswith("P"), F.reverse(two)).otherwise(two)
        whole = F.array_join(k, "")
        tail = F.substring(whole, -88, 88)
        return (
            F.when(data.isNotNull() & short.isNotNull(), F.array(F.rpad(short, 44, "<"), data))
            .when(F.size(exact) >= 2, ordered)
            .when(F.length(whole) >= 88, F.array(F.substring(tail, 1, 44), F.substring(tail, 45, 44)))
            .otherwise(F.slice(k, F.greatest(F.size(k) - 1, F.lit(1)), 2))
        )

    return bound(kept, pick)


def flip_table() -> list[int]:
    """What flipping the mixed-up character c at a place adds, at 10 * place + index of c: a change of each lane's
    residue, one more flip, and the check digits that become or stop being digits."""
    table = []
    for place in range(44):
        for c, to in zip(LETTER_FOR + DIGIT_FOR, DIGIT_FOR + LETTER_FOR):
            diff = ALPHABET.index(to) - ALPHABET.index(c)
            add = 1 << (SLOT * len(CHECKS))
            for k, n in enumerate(CHECKS):
                add += (diff * WEIGHTS[k][place] % 10) << (SLOT * k)
                if SPANS[n][1] == place:
                    add += (1 if c.isdigit() else -1) << (SLOT * len(CHECKS) + 8 + k)
            table.append(add)
    return table


CHANGES = "array<struct<position:int,from:string,to:string>>"


def repair(line2: Column, most: int = 8, least: int = 39) -> Column:
    """struct<line,changes>: the data row after the best flips of letters and digits that OCR mixes up.

    Only rows of 44 characters with a failing required check are searched, among their first ``most`` such places.
    The score is ten for each check that holds, less one for each flip, and must reach ``least``; the earlier
    subset wins a tie, the first place counting as the most significant bit.
    """
    left, right = LETTER_FOR + DIGIT_FOR, DIGIT_FOR + LETTER_FOR
    top = SLOT * len(CHECKS)
    long = lambda x: F.lit(x).cast("long")
    table = constants(flip_table())
    char = lambda p: F.substring(line2, p + 1, F.lit(1))
    places = F.slice(F.filter(F.sequence(F.lit(0), F.lit(43)), lambda p: F.instr(F.lit(left), char(p)) > 0), 1, most)

    def score(x: Column) -> Column:
        held = F.lit(0)
        for k in range(len(CHECKS)):
            fine = (F.shiftright(x, SLOT * k).bitwiseAND(long(255)) % 10 == 0) & (F.shiftright(x, top + 8 + k).bitwiseAND(long(1)) == 0)
            held = held + F.when(fine, 10).otherwise(0)
        return held - F.shiftright(x, top).bitwiseAND(long(255)).cast("int")

    def tried(z: Column) -> Column:
        at, total = z["places"], z["total"]
        start = long(0)
        for k, n in enumerate(CHECKS):
            start = start + F.shiftleft(lane(total, k), SLOT * k) + F.when(is_digit(line2, n), long(0)).otherwise(long(1 << (top + 8 + k)))
        adds = F.transform(at, lambda p: F.get(table, p * 10 + F.instr(F.lit(left), char(p)) - 1))
        sums = F.aggregate(F.reverse(adds), F.array(start), lambda acc, d: F.concat(acc, F.transform(acc, lambda x: x + d)))
        best = bound(sums, lambda v: F.array_max(F.transform(F.slice(v, 2, F.size(v)), lambda x, i: score(x) * 256 + (254 - i))))
        return bound(best, lambda b: F.when(F.shiftright(b, 8) >= least, winner(at, 255 - b.bitwiseAND(F.lit(255)))))

    def winner(at: Column, mask: Column) -> Column:
        bit = lambda j: F.pmod(F.floor(mask / F.pow(F.lit(2.0), F.size(at) - 1 - j)), F.lit(2)) == 1
        flips = F.filter(F.transform(at, lambda p, j: F.struct(p.alias("position"), char(p).alias("from"), F.translate(char(p), left, right).alias("to"), bit(j).alias("on"))), lambda c: c["on"])
        changes = F.transform(flips, lambda c: F.struct(c["position"], c["from"].alias("from"), c["to"].alias("to")))
        return bound(changes, lambda c: F.struct(F.aggregate(c, line2, lambda row, x: F.overlay(row, x["to"], x["position"] + 1, F.lit(1))).alias("line"), c.cast(CHANGES).alias("changes")))

    def searched(total: Column) -> Column:
        required = F.lit(True)
        for k, n in enumerate(CHECKS):
            if n != "optional_data":
                required = required & (lane(total, k) == 0) & is_digit(line2, n)
        state = bound(places, lambda at: F.when(~required & (F.size(at) > 0), F.struct(at.alias("places"), total.alias("total"))))
        return bound(state, lambda z: F.when(z.isNotNull(), tried(z)))

    same = F.struct(line2.alias("line"), F.array().cast(CHANGES).alias("changes"))
    return F.coalesce(F.when(F.length(line2) == 44, bound(residues(line2), searched)), same)


def repair_rows(rows: DataFrame, id_col: str = "id", line_col: str = "line2") -> DataFrame:
    """Adds ``repaired``, ``changes`` (their number) and ``repairs`` (the log) to each row, in place."""
    return rows.withColumn("_r", repair(F.col(line_col))).select(*rows.columns, F.col("_r.line").alias("repaired"), F.size("_r.changes").alias("changes"), F.col("_r.changes").alias("repairs"))


def raw_identity(line1: Column) -> Column:
    """Names of a readable first row, whether or not its checks hold; null without a separator."""
    rest = F.regexp_extract(line1, "(?:^|<)P<?[A-Z]{3}(.+)$", 1)
    names = F.split(rest, "<<", 2)
    found = F.struct(F.nullif(clean_name(F.get(names, F.lit(0))), F.lit("")).alias("surname"), F.nullif(clean_name(F.get(names, F.lit(1))), F.lit("")).alias("given_names"))
    return F.when(rest.contains("<<"), found)


def raw_document(lines: Column, today: str) -> Column:
    """The fields by their places, without a claim that any check holds: from the first row that starts with P and the
    first that looks like data; null without either."""
    rows = F.transform(lines, clean_line)

    def read(r: Column) -> Column:
        name, data = F.get(F.filter(r, lambda x: x.startswith("P")), F.lit(0)), F.get(F.filter(r, lambda x: x.rlike(DATA_ROW)), F.lit(0))
        full = lambda c: F.nullif(F.replace(c, F.lit("<"), F.lit("")), F.lit(""))
        at = lambda a, n: F.substring(data, a + 1, n)
        found = F.struct(
            F.lit("TD3").alias("document_type"), F.nullif(F.substring(name, 3, 3), F.lit("")).alias("issuing_state"), full(at(0, 9)).alias("document_number"), full(at(10, 3)).alias("nationality"),
            iso_date(at(13, 6), "birth", today).alias("birth_date"), F.translate(at(20, 1), "<", "X").alias("sex"), iso_date(at(21, 6), "expiry", today).alias("expiry_date"),
        )
        return F.when(name.isNotNull() & data.isNotNull(), found)

    return bound(rows, read)


def best_parse(candidates: DataFrame, today: str, id_col: str = "id") -> DataFrame:
    """The best reading of each document: its candidates (line1, line2, score, idx), each as it is and repaired.

    The most is won by checks that hold plus the recogniser's score; on a tie by the surer, the earlier
    candidate, and the row as it is.  One hash aggregate; candidates that do not parse are left out.
    """
    own = candidates.withColumn("_r", repair(F.col("line2")))
    as_is = F.struct(F.col("line2").alias("line2"), F.array().cast(CHANGES).alias("repairs"), F.lit(1).alias("own"))
    fixed = F.struct(F.col("_r.line").alias("line2"), F.col("_r.changes").alias("repairs"), F.lit(0).alias("own"))
    tries = F.when(F.size("_r.changes") > 0, F.array(as_is, fixed)).otherwise(F.array(as_is))
    each = own.select(id_col, "line1", "score", "idx", F.explode(tries).alias("t")).select(id_col, "line1", "score", "idx", "t.*")
    each = each.withColumn("p", parse_td3(F.col("line1"), F.col("line2"), today)).where("p is not null")
    rank = F.struct((passed(F.col("p.checks")) + F.col("score")).alias("total"), "score", (-F.col("idx")).alias("i"), "own")
    best = each.groupBy(id_col).agg(F.max_by(F.struct("line1", "line2", "repairs", "p"), rank).alias("b"))
    return best.select(id_col, "b.line1", "b.line2", "b.repairs", "b.p")
