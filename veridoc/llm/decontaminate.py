"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every benchmark item gives its windows of ``n`` consecutive words (an item of fewer words is one window).  Where the windows
take at most ``limit`` bytes, sets of bits of their hashes are sent to all tasks and probed inside the row.  A text is cut into
blocks of half a window, so that each of its windows holds a whole block; only windows around a block that some benchmark window
holds are hashed and probed themselves, and the few that pass leave the row, meet the broadcast windows and
are verified word by word.  Beyond ``limit`` each window of the texts leaves its row as (document, place, hash), without the
words, for a shuffled join, and words are fetched for hits only.  JVM expressions only.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item
matches nothing; repeated rows each give their own (equal) row; an empty documents table gives
no rows, an empty benchmark leaves every document clean; extra columns are ignored, and stay
as they are in ``cut_spans``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import ascii_lower, let, small_side, stored

#: What separates words once A-Z are lower-cased, and what does before.
GAPS_LOWERED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A word of the text as it is (the complement of GAPS).
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAPS_LOWERED), ""), F.array().cast("array<string>"))


def window_hashes(words: Column, n: int) -> Column:
    """Hash of each window of ``n`` words, by its start."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    return let(
        hashes,
        lambda h: F.when(F.size(h) < n, none).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, n)))
        ),
    )


def item_windows(items: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """item_id, len, wh, window: the distinct windows of each item."""
    words = items.select(F.col(item_col).alias("item_id"), normal_words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("ws") - size + 1)
    one = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("window"))
    hashed = F.xxhash64(F.transform("window", lambda w: F.xxhash64(w)))
    return one.distinct().select("item_id", F.size("window").alias("len"), hashed.alias("wh"), "window")


LIMIT = 64 << 20  # bytes of windows that are sent to every task
BITS_EACH = 128  # bits of a set for each hash in it: one in 128 foreign ones passes, at most


def bit_set(hashes: list[int]) -> tuple[Column, int]:
    """The set as a constant array of words of 64 bits, and the mask of a bit's place."""
    size = 1 << max(12, (len(hashes) * BITS_EACH - 1).bit_length())
    words = [0] * (size >> 6)
    for h in hashes:
        at = h & (size - 1)
        words[at >> 6] |= 1 << (at & 63)
    signed = (w - (1 << 64) if w >> 63 else w for w in words)
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>"), size - 1


def held_bit(bits: Column, mask: int, h: Column) -> Column:
    at = h.bitwiseAND(F.lit(mask).cast("bigint"))
    return F.call_function("getbit", F.get(bits, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1


def half(n: int) -> int:
    """Blocks of this many words, side by side from the start of a text: every window of ``n`` words holds a whole one."""
    return (n + 1) // 2


def likely_windows(words: Column, n: int, blocks: tuple[Column, int], windows: tuple[Column, int]) -> Column:
    """(pos, h, len) of each window of ``n`` words that holds a block of the one set and is in the other."""
    b = half(n)

    def inside(h):
        starts = F.sequence(F.lit(0), F.greatest(F.floor(F.size(h) / b).cast("int") - 1, F.lit(0)))
        held = F.array_compact(F.transform(F.transform(starts, lambda m: F.xxhash64(F.slice(h, m * b + 1, b))), lambda x, m: F.when(held_bit(*blocks, x), m * b)))
        around = F.flatten(F.transform(held, lambda at: F.sequence(F.greatest(at - (b - 1), F.lit(0)), at)))
        found = F.transform(F.filter(around, lambda p: p + n <= F.size(h)), lambda p: F.struct(p.alias("pos"), F.xxhash64(F.slice(h, p + 1, n)).alias("h"), F.lit(n).alias("len")))
        return F.filter(found, lambda s: held_bit(*windows, s["h"]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), inside)


def find_hits(
    docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", limit: int = LIMIT,
) -> DataFrame:
    """doc_id, th (hash of the text), pos (0-based word), len, items: verified occurrences of windows."""
    per_item = item_windows(items, n, item_col, item_text)
    windows = stored(per_item.groupBy("len", "wh", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumnRenamed("len", "wlen"), "windows")
    held = F.octet_length(F.array_join("window", " ")) + 24 * F.col("wlen") + 16 * F.size("items") + 64
    known = windows.groupBy("wlen").agg(F.sum(held.cast("bigint")).alias("bytes")).collect()  # n rows at most
    sizes = sorted(r["wlen"] for r in known) or [n]
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), normal_words(F.col(text_col)).alias("ws"))
    verified = F.slice("ws", F.col("pos") + 1, F.col("wlen")) == F.col("window")
    out = ["doc_id", "th", "pos", F.col("wlen").alias("len"), "items"]
    if sum(r["bytes"] for r in known) <= limit:
        hashed = F.transform("window", lambda w: F.xxhash64(w))
        b = F.floor((F.col("wlen") + 1) / 2).cast("int")
        parts = windows.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("wlen") - b + 1), lambda i: F.xxhash64(F.slice(hashed, i, b)))).alias("h"))
        # 8 of the ``limit`` bytes of each window, and as many for each of its blocks, of which windows that overlap share all but one
        sets = [bit_set([r["h"] for r in rows.distinct().collect()]) for rows in (parts, windows.select(F.col("wh").alias("h")))]
        spots = F.flatten(F.array(*[likely_windows(F.col("ws"), size, *sets) for size in sizes]))
        rows = text.withColumn("spots", spots).where(F.size("spots") > 0).select("doc_id", "th", "ws", F.explode("spots").alias("s")).select("doc_id", "th", "ws", "s.*")
        return rows.join(F.broadcast(windows), (F.col("h") == F.col("wh")) & (F.col("len") == F.col("wlen"))).where(verified).select(*out)
    spots = F.flatten(F.array(*[F.transform(window_hashes(F.col("ws"), size), lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.lit(size).alias("len"))) for size in sizes]))
    rows = text.select("doc_id", "th", F.explode(spots).alias("s")).select("doc_id", "th", "s.*")
    hit = rows.join(windows, (F.col("h") == F.col("wh")) & (F.col("len") == F.col("wlen"))).select(F.col("doc_id").alias("id2"), F.col("th").alias("th2"), "pos", "wlen", "window", "items").distinct()
    return hit.join(text, (F.col("th") == F.col("th2")) & F.col("doc_id").eqNullSafe(F.col("id2"))).where(verified).select(*out)


def hit_words(spots: Column) -> Column:
    """Sorted distinct word positions under an array of (pos, len)."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(spots, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))))


def hits_by_document(found: DataFrame) -> DataFrame:
    """hit_id, hit_th, hit_words, items: a row for each text with hits, stored, and sent to every task where it is small."""
    by_doc = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "len")).alias("spots"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    rows = stored(by_doc.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), hit_words(F.col("spots")).alias("hit_words"), "items"), "hits")
    return small_side(rows, 4 * F.size("hit_words") + 16 * F.size("items") + 64)


def decontaminate(
    docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = LIMIT,
) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, hit_words, items, contaminated."""
    by_doc = hits_by_document(find_hits(docs, items, n, id_col, text_col, item_col, item_text, limit))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.size(normal_words(F.col(text_col))).cast("long").alias("n_words"))
    none = F.array().cast("array<int>")
    return base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left").select(
        "doc_id", "n_words",
        F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("hit_words", none).alias("hit_words"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        "items",
        F.col("hit_words").isNotNull().alias("contaminated"),
    )


def cut_spans(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The documents with every benchmark word cut out, in their own columns.

    The gaps between the words stay, so what is left reads as before.  A document of which no
    word is left after a cut goes; every document without a hit stays as it is, byte for byte.
    """
    by_doc = hits_by_document(find_hits(docs, items, n, id_col, text_col, limit=limit)).select("hit_id", "hit_th", "hit_words")
    own = docs.select(F.struct("*").alias("r"), F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    joined = own.join(by_doc, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    words = F.array_remove(F.split("t", GAPS), "")
    gaps = F.split("t", WORD, -1)  # one more than words; the first and the last may be empty
    keep = F.map_from_arrays("hit_words", F.transform("hit_words", lambda _: F.lit(True)))
    kept = let(keep, lambda m: F.transform(words, lambda w, i: F.when(F.map_contains_key(m, i), "").otherwise(w)))
    rebuilt = F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    cut = joined.select("r", F.when(F.col("hit_words").isNotNull(), rebuilt).alias("new")).where(F.col("new").isNull() | F.col("new").rlike(WORD))
    at = lambda c: F.col("r").getField(c)
    out = {text_col: F.coalesce("new", at(text_col))}
    if "n_chars" in docs.columns and text_col != "n_chars":
        out["n_chars"] = F.coalesce(F.char_length("new").cast(docs.schema["n_chars"].dataType), at("n_chars"))
    return cut.select(*[out.get(c, at(c)).alias(c) for c in docs.columns])
