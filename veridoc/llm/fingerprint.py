"""Document fingerprints from closed syncmers.

A k-mer of consecutive words is an anchor when the least hash among its inner s-mers lies at its
first or last place.  Whether a k-mer is chosen depends on its own words only, so an edit moves
no anchor outside of it, and equal stretches of two texts carry equal anchors at shifted places.
One rule holds for texts of every length.  The fingerprint lists all anchor hashes of the whole
text by place, 8 hex digits each; likeness counts matches that keep their order, each as often
as it stands in both texts.  JVM expressions only.

Defined cases: a null or empty text has an empty fingerprint; a text of fewer than k words has
one anchor over all its words; two empty fingerprints are alike (1.0), an empty one and another
are not (0.0); repeated rows give equal rows; an empty table gives no rows; extra columns are
ignored.  Words stand between white space, so a text without any is one word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import let, partitions

GAP = r"[\x20\x09-\x0D]+"
LONGS = "array<bigint>"
RANGE = 128 << 20


def chosen(hashes: Column, k: int, s: int) -> Column:
    """array<struct<pos,hash>>: the closed syncmers over unit hashes; k units, s inner units."""
    inner = k - s  # the last inner s-mer's place

    def of(h: Column) -> Column:
        mers = h if s == 1 else F.transform(F.sequence(F.lit(1), F.size(h) - (s - 1)), lambda i: F.xxhash64(F.slice(h, i, s)))
        return let(mers, lambda m: F.transform(
            F.filter(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.array_min(F.slice(m, i, inner + 1)).isin(F.element_at(m, i), F.element_at(m, i + inner))),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(h, i, k)).alias("hash")),
        ))

    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    whole = F.array(F.struct(F.lit(1).alias("pos"), F.xxhash64(hashes).alias("hash")))
    return F.when(F.size(hashes) >= k, of(hashes)).when(F.size(hashes) > 0, whole).otherwise(none)


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, GAP), ""), lambda w: F.xxhash64(w))


def anchors(text: Column, k: int = 4, s: int = 2) -> Column:
    """array<struct<pos,hash>>: the word anchors of a text, for positional matching."""
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return F.coalesce(let(word_hashes(text), lambda h: chosen(h, k, s)), none)


def sketch(text: Column, k: int = 4, s: int = 2) -> Column:
    """array<bigint>: all anchor hashes in the order of the text, folded to 32 bits."""
    return F.transform(anchors(text, k, s), lambda x: F.shiftrightunsigned(x["hash"], 32))


HIGH, LOW = 2**31, 2**31 - 1  # two numbers in one: a hash or a place above 31 bits that hold a place


def runs(values: Column, opens) -> Column:
    """array<struct<at,n>>: where each run of ``values`` starts, from 0, and its length; ``opens(value, the one before)``."""
    at = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | opens(F.get(values, i), F.get(values, i - 1)))
    return let(at, lambda v: F.transform(v, lambda x, d: F.struct(x.alias("at"), (F.coalesce(F.get(v, d + 1), F.size(values)) - x).alias("n"))))


def occurrences(marks: Column, side: int) -> Column:
    """array<struct<hash,nth,side,place>>: each anchor with how many equal ones stand before it."""
    packed = F.sort_array(F.transform(marks, lambda x, i: x * HIGH + i))
    of = lambda v, r: F.transform(F.slice(v, r["at"] + 1, r["n"]), lambda x, j: F.struct(
        F.shiftright(x, 31).alias("hash"), j.alias("nth"), F.lit(side).alias("side"), x.bitwiseAND(F.lit(LOW)).alias("place")))
    return let(packed, lambda v: F.flatten(F.transform(runs(v, lambda x, y: F.shiftright(x, 31) != F.shiftright(y, 31)), lambda r: of(v, r))))


def in_order(a: Column, b: Column) -> Column:
    """How many anchors of two texts match in one order: the nth of a hash meets the nth of the other text, and the longest
    chain of matches with rising places in both counts.

    What both texts start with matches place by place, and nothing after it matches anything in it;
    so it is counted at once, and chains are looked for in the rest alone.
    """
    zero = F.lit(0).cast("long")
    shorter = F.least(F.size(a), F.size(b))
    apart = F.array_position(F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x == y), False)
    same = F.when(apart == 0, shorter.cast("long")).otherwise(apart - 1).cast("int")
    rest = let(same, lambda n: F.struct(n.alias("n"), F.slice(a, n + 1, F.size(a)).alias("a"), F.slice(b, n + 1, F.size(b)).alias("b")))
    chain = let(rest, lambda r: r["n"].cast("long") + F.when(F.arrays_overlap(r["a"], r["b"]), chained(r["a"], r["b"])).otherwise(zero))
    return F.when(shorter == 0, zero).when(a == b, F.size(a).cast("long")).otherwise(chain)


def chained(a: Column, b: Column) -> Column:
    """The longest chain of matches between two texts.

    Matches that follow each other in both texts are one run; the fold over runs keeps only
    chain ends that no other end beats, so texts that share long stretches take one step for each.
    """
    both = F.sort_array(F.concat(occurrences(a, 0), occurrences(b, 1)))
    same = lambda x, y: (x["hash"] == y["hash"]) & (x["nth"] == y["nth"])
    pairs = let(both, lambda v: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(v) - 2), lambda i: same(F.get(v, i), F.get(v, i + 1))),
        lambda i: F.get(v, i + 1)["place"] * HIGH + F.get(v, i)["place"]))
    ranked = F.sort_array(F.transform(F.sort_array(pairs), lambda x, r: x.bitwiseAND(F.lit(LOW)) * HIGH + r))
    ranks = F.transform(ranked, lambda x: x.bitwiseAND(F.lit(LOW)))

    def longest(v: Column) -> Column:
        ends = F.array().cast("array<struct<last:bigint,n:bigint>>")

        def step(acc: Column, r: Column) -> Column:
            first = F.get(v, r["at"])
            n = F.coalesce(F.array_max(F.transform(F.filter(acc, lambda e: e["last"] < first), lambda e: e["n"])), F.lit(0)) + r["n"]
            last = first + r["n"] - 1
            return let(F.struct(last.cast("long").alias("last"), n.cast("long").alias("n")), lambda new: F.array_append(
                F.filter(acc, lambda e: (e["last"] < new["last"]) | (e["n"] > new["n"])), new))

        return F.aggregate(runs(v, lambda x, y: x != y + 1), ends, step, lambda acc: F.coalesce(F.array_max(F.transform(acc, lambda e: e["n"])), F.lit(0)))

    return let(ranks, lambda v: F.when(F.size(v) > 0, longest(v)).otherwise(F.lit(0).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Matches in order over all anchors of both texts."""
    total = F.size(a) + F.size(b)
    return let(in_order(a, b), lambda n: F.when(total == 0, F.lit(1.0)).otherwise(n / (total - n)))


def hexed(marks: Column) -> Column:
    """The anchors' digits."""
    return F.array_join(F.transform(marks, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, anchors."""
    return docs.select(F.col(id_col).alias("doc_id"), hexed(sketch(F.col(text_col))).alias("fingerprint"), anchors(F.col(text_col)).alias("anchors"))


def with_next(docs: DataFrame, order: str, text: str, made: dict[str, Column]) -> DataFrame:
    """Adds the columns ``made`` from each row, and next_<c> of these and of ``text``: those of the row after, by ``order`` descending; after the last comes the first.

    Rows are dealt into ranges of ``order`` (as many as there are shuffle partitions, more if these would get
    over RANGE bytes of text; bounds from an approximate quantile), in one shuffle; each range also gets a copy of the
    first row of the range after it, so that no range needs another.  The columns are made after the shuffle, once
    a row.  Rows of equal ``order`` stand by their text, descending; a null stands last.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**63)))
    held = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    n = max(2, partitions(spark), -(-held // RANGE))
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def bucket(value: Column) -> Column:
        """How many cuts lie below the value: first among the runs' last cuts, then inside one run."""
        if not runs:
            return F.lit(0)
        lasts = F.array(*[F.lit(r[-1]).cast("bigint") for r in runs])
        table = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in r]) for r in runs])
        full = F.size(F.filter(lasts, lambda c: c < value))
        rest = F.when(full >= len(runs), 0).otherwise(F.size(F.filter(F.get(table, full), lambda c: c < value)))
        return F.least(full * step, F.lit(len(cuts))) + rest

    # A row for each range (as many as shuffle partitions): its first row's key.
    heads = {r["b"]: r["m"] for r in docs.select(bucket(key).alias("b"), key.alias("k")).groupBy("b").agg(F.max("k").alias("m")).collect()}
    used = sorted(heads)
    goes = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}  # a range's first row is also needed by the range above it
    size = max(used, default=0) + 1
    tops = F.array(*[F.lit(heads.get(b)).cast("bigint") for b in range(size)])
    to = F.array(*[F.lit(goes.get(b, 0)) for b in range(size)])
    here = F.col("_b")
    places = F.when(F.col("_k") == F.get(tops, here), F.array(F.struct(here.alias("b"), F.lit(0).alias("halo")), F.struct(F.get(to, here).alias("b"), F.lit(1).alias("halo"))))
    rows = docs.withColumn("_k", key).withColumn("_b", bucket(F.col("_k")))
    rows = rows.withColumn("_p", F.explode(F.coalesce(places, F.array(F.struct(here.alias("b"), F.lit(0).alias("halo"))))))
    rows = rows.repartition(n, F.col("_p.b")).select("*", *[c.alias(name) for name, c in made.items()])
    w = Window.partitionBy("_p.b").orderBy(F.col("_p.halo"), F.col("_k").desc(), F.col(text).desc_nulls_last())
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in (text, *made)])
    return rows.where(F.col("_p.halo") == 0).drop("_k", "_b", "_p")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside a copy whose second half is the start of the next document's text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(base, "doc_id", "text", {"own": sketch(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    rows = rows.select("*", sketch(F.col("edited")).alias("ed"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), hexed(F.col("own")).alias("fingerprint"), hexed(F.col("ed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("ed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
