"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is JVM expressions inside one narrow stage: no shuffle, no Python.  Offsets come from
splitting the text by the same pattern: a match starts after the pieces and matches before it,
summed in two levels so that a text with many matches costs little more than its length.

Base kinds (email, ip, card, phone) follow fixed patterns and always stay.  The method adds
``iban`` (ISO 13616, confirmed by mod 97) and ``ssn`` (three-two-four digits, in need of a
telling word within the 40 characters before it or the 40 after it, whatever else stands there).

Defined cases: a null or empty text has no spans; repeated rows give equal rows; an empty table
gives no rows; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import let

# The base patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The same leftmost matches in linear time and constant stack: no group is matched by recursion, and no
# start inside a run is tried once the run's first start has failed.
EMAIL_FAST = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_FAST = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD_FAST = r"[0-9](?:[\x20-]?[0-9])++"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
CONTEXT = {"iban": r"(?i)iban|account|bank|konto|compte|cuenta", "ssn": r"(?i)ssn|social|security|tax|id"}
WINDOW, LEAST = 40, 11  # characters of context on each side; of the shortest match that needs some
REACH = -(-WINDOW // LEAST)
BLOCK = 128
PIECE = 1024  # characters of a text cut out at once
SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.split(F.reverse(digits(m)), "")

    def worth(c: Column, i: Column) -> Column:
        v = F.ascii(c) - 48
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.transform(F.filter(d, lambda c: c != ""), worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    turned = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (acc * 10 + v - 48) % 97).otherwise((acc * 100 + v - 55) % 97)

    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def before_each(values: Column, fold) -> Column:
    """``fold`` of 0 and all values before each one, over blocks of BLOCK and then inside them."""
    zero = F.lit(0)
    return let(values, lambda v: let(
        let(
            F.transform(F.sequence(zero, F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, BLOCK), zero, fold)),
            lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, 1, b), zero, fold)),
        ),
        lambda before: F.transform(v, lambda _, i: fold(F.element_at(before, F.floor(i / BLOCK).cast("int") + 1), F.aggregate(
            F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), zero, fold))),
    ))


def plus(a: Column, b: Column) -> Column:
    return a + b


def spans(text: Column, pattern: str, kind: int, accept, likely: Column, score=None, context: str | None = None) -> Column:
    """Accepted matches of ``pattern`` as (start, kind, end, score), in code points; ``told``: whether a ``context`` word is near."""
    def build(parts: Column) -> Column:
        pieces, found = parts["pieces"], parts["found"]
        # Lengths of piece and match together, up to the last match.
        both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m))
        before = before_each(both, plus)
        told = (lambda i: near(context, pieces, found, i)) if context else (lambda i: F.lit(True))
        rows = F.transform(F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"), before.alias("b")), lambda z, i: F.struct(
            (z["b"] + F.char_length(z["p"])).alias("start"), z["m"].alias("m"), told(i).alias("told")))
        good = F.filter(rows, lambda r: accept(r["m"], r["told"]))
        value = score or (lambda r: F.lit(1.0))
        return F.transform(good, lambda r: F.struct(r["start"].alias("start"), F.lit(kind).alias("kind"), (r["start"] + F.char_length(r["m"])).alias("end"), value(r).alias("score")))

    none = F.array().cast(SPAN)
    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    made = let(parts, lambda p: F.when(F.size(p["found"]) == 0, none).otherwise(build(p).cast(SPAN)))
    return F.coalesce(F.when(likely, made), none)


def near(kind: str, pieces: Column, found: Column, i: Column) -> Column:
    """Whether a telling word lies in the WINDOW characters before match ``i`` or in those after it.

    The text around a match is put together from the matches and pieces next to it: those of a kind
    with context words have LEAST characters or more, so REACH of them fill the window.
    """
    run = lambda first, last: F.transform(F.sequence(first, last), lambda j: F.concat(F.get(pieces, j), F.get(found, j)))
    low, high, none = F.greatest(i - REACH, F.lit(0)), F.least(i + REACH, F.size(found) - 1), F.array().cast("array<string>")
    before = F.concat(F.array_join(F.when(low < i, run(low, i - 1)).otherwise(none), ""), F.get(pieces, i))
    after = F.concat(F.array_join(F.when(high > i, run(i + 1, high)).otherwise(none), ""), F.get(pieces, high + 1))
    return F.substring(before, -WINDOW, WINDOW).rlike(CONTEXT[kind]) | F.substring(after, 1, WINDOW).rlike(CONTEXT[kind])


def all_spans(text: Column) -> Column:
    """Every span of every kind, in the order of KINDS."""
    has_digit = text.rlike("[0-9]")
    small = lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255")
    n = lambda m: F.char_length(digits(m))
    return F.concat(
        spans(text, EMAIL_FAST, 0, lambda m, told: F.lit(True), text.contains("@")),
        spans(text, IP_FAST, 1, lambda m, told: F.forall(F.split(m, r"\."), small), has_digit & text.contains(".")),
        spans(text, CARD_FAST, 2, lambda m, told: n(m).between(14, 19) & luhn(m), has_digit),
        spans(text, PHONE, 3, lambda m, told: n(m).between(10, 15), has_digit & text.contains("+")),
        spans(text, IBAN, 4, lambda m, told: F.char_length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m), has_digit, lambda r: F.when(r["told"], 1.0).otherwise(0.8), "iban"),
        spans(text, SSN, 5, lambda m, told: told, has_digit & text.contains("-"), lambda r: F.lit(0.7), "ssn"),
    )


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: array of (start, kind, end, score) of every document."""
    return docs.select(F.col(id_col).alias("doc_id"), all_spans(F.col(text_col)).alias("found"))


def redacted(text: Column, threshold: float) -> Column:
    """The text with each span scored at ``threshold`` or more replaced by its kind; null where there is none."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def build(z: Column) -> Column:
        found, blocks = z["found"], z["blocks"]
        reach = before_each(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # how far the spans before go

        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
            return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), a % PIECE + 1, b - a)

        cut = lambda s, r: F.when(s["start"] < r, "").otherwise(F.concat(piece(r, s["start"]), F.element_at(names, s["kind"] + 1)))
        end = F.array_max(F.transform(found, lambda s: s["end"]))
        return let(reach, lambda r: F.concat(F.array_join(F.zip_with(found, r, cut), ""), piece(end, F.char_length(text))))

    found = F.sort_array(F.filter(all_spans(text), lambda s: s["score"] >= threshold))
    parts = let(found, lambda f: F.when(F.size(f) > 0, F.struct(f.alias("found"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("blocks"))))
    return let(parts, lambda z: F.when(z.isNotNull(), build(z)))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with every span scored at ``threshold`` or more replaced by its kind, such as <EMAIL>.

    Where spans overlap, the one that starts first goes and the rest of the other with it.
    Documents without spans stay as they are; none is dropped.  Other columns, whatever their
    names, stay; ``n_chars``, where there is one, is counted anew for changed texts.
    """
    names = docs.columns
    rows = docs.select(F.struct("*").alias("r"), redacted(F.col(text_col), threshold).alias("new"))
    at = lambda c: F.col("r").getField(c)
    out = {text_col: F.coalesce(F.col("new"), at(text_col))}
    if "n_chars" in names and text_col != "n_chars":
        out["n_chars"] = F.coalesce(F.char_length("new").cast(docs.schema["n_chars"].dataType), at("n_chars"))
    return rows.select(*[out.get(c, at(c)).alias(c) for c in names])
