"""N-gram Jaccard join with a token-group matrix.

A document is the set of its 5-word shingles, as 64-bit hashes.  The join is exact; it finds
every pair of sets with 100 * intersection >= 75 * union, by these steps.

1.  Order.  Shingles that are frequent (counted over all texts, block by block) come last in one
    global order, the rest by hash.  Any order is right; this one keeps common passages out of
    the prefixes.  The list of frequent shingles has at most ``FREQUENT`` entries and is broadcast.
2.  Groups.  Similar sets are put into one group: that of their least shingle, taken among the
    frequent ones if they make up half of the set.  Equal sets are one set from here on.
3.  Matrix.  A set with a partner shares with it one of the first n - ceil(3n/4) + 1 shingles of
    the order.  The matrix holds, for each such shingle, the groups whose union has it.  Its rows
    travel packed, as blocks of arrays by hash range; no row is made for each pair of documents.
4.  Bound.  For two groups, the number of matrix shingles they share bounds the intersection any two members
    can have; pairs that cannot reach the limit are dropped, and so are those whose sizes cannot.
    For the pairs left, each set of groups of at most ``SIGNED`` sets is summed up in ``PARITY`` bits: the
    parity of its shingles in each place.  Two sets differ in at least as many shingles as their bits
    differ in places, so pairs of groups without a pair of sets near enough are dropped, and no other.
5.  Opening.  Only for the groups left are whole sets gathered: each group's own (straight to their
    home, by its name), and those of its partners as queries.  Inside a group, union-find spares the comparisons between sets that are linked
    already; of two linked parts, the smaller one's sets are compared.  Groups of more than
    ``CHUNK`` sets are dealt into chunks.
6.  Components of the links between sets give the classes; a class is named by its least document.

Hashes have 64 bits: two unequal shingles meet with a chance of about 5e-20 for each compared pair.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; one of
fewer than five words has one shingle, the whole sequence; repeated rows are linked (equal
sets), and each gives a row; null ids are kept and linked with nothing; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import partitions, release, small_batches, stored
from veridoc.llm.components import EDGES, Forest, connected, contract
from veridoc.llm.textbytes import MIX_LOWER, U, blend, buffers, running, slices, span, word_bounds

N = 5
SLICE = 1 << 18
FREQUENT = 1 << 19
COUNTED = 1 << 21  # shingles counted at once, before counts meet
BLOCK = 1 << 20  # matrix rows packed at once
CHUNK = 4096
SIGNED = 16
PARITY = 2048
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
PLACE = np.array([0xD6E8FEB86659FD93, 0xA5A3564E27F8863D, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], U)


def sets_of(column: pa.Array):
    """Sorted distinct shingle hashes of each text, row by row."""
    data_all, off_all = buffers(column)
    for lo, hi in slices(off_all, SLICE):
        off = off_all[lo : hi + 1]
        data, off = data_all[off[0] : off[-1]], off - off[0]
        starts, ends = word_bounds(data, off, GAP)
        words = span(running(data, MIX_LOWER), starts, ends)
        at = np.searchsorted(starts, off)  # first word of each row
        if words.size >= N:
            m = words.size - N + 1
            shingles = np.zeros(m, U)
            for j in range(N):
                shingles += words[j : j + m] * PLACE[j]
            shingles = blend(shingles)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            n = b - a
            if n >= N:
                own = np.sort(shingles[a : b - N + 1])
                yield own[np.append(True, own[1:] != own[:-1])] if own.size > 1 else own
            elif n:
                yield blend((words[a:b] * PLACE[:n]).sum(dtype=U, keepdims=True) + U(n))
            else:
                yield words[:0]


def prefix_size(n):
    return n - (3 * n + 3) // 4 + 1


class Order:
    """The global order: frequent shingles (ascending by count) after all others."""

    def __init__(self, frequent: np.ndarray):
        self.sorted = np.sort(frequent)
        self.rank = np.argsort(frequent, kind="stable")  # place in the order, by sorted value

    def look(self, own: np.ndarray) -> tuple[np.ndarray, int]:
        """Prefix of the set, and its group."""
        n = own.size
        common = own[:0]
        rest = own
        if self.sorted.size:
            i = np.searchsorted(self.sorted, own)
            i[i == self.sorted.size] = 0
            hit = self.sorted[i] == own
            if hit.any():
                common = own[hit][np.argsort(self.rank[i[hit]], kind="stable")]
                rest = own[~hit]
        least = common.min() if common.size * 2 >= n else rest[0]
        group = int(blend(least.reshape(1))[0])  # spread again: a least hash is small
        k = prefix_size(n)
        return (rest[:k] if rest.size >= k else np.concatenate([rest, common[: k - rest.size]])), group


def set_id(own: np.ndarray) -> int:
    """Equal sets have equal ids, of 64 bits."""
    return int(blend((blend(own ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(own.size)).reshape(1))[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """At most FREQUENT shingles, the most frequent ones, ascending by their counts."""

    def run(batches):
        held, size = [], 0

        def out():
            v = np.sort(np.concatenate(held))
            cut = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            n = np.diff(np.append(cut, v.size))
            many = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(v[cut[many]].view(np.int64)), pa.array(n[many].astype(np.int64))], ["h", "n"])

        for b in batches:
            for own in sets_of(b.column(0)):
                held.append(own)
                size += own.size
                if size >= COUNTED:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
        held = []
        release()

    counts = texts.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 8")
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    return top["h"].to_numpy().astype(np.int64).view(U)[::-1]


def matrix_rows(order, buckets: int):
    """Packs (shingle, group, size) rows of the matrix by hash range of the shingle."""

    def run(batches):
        held, size, seen = [], 0, set()

        def out():
            tokens = np.concatenate([h[0] for h in held])
            counts = [h[0].size for h in held]
            groups = np.repeat(np.array([h[1] for h in held], U), counts)
            sizes = np.repeat(np.array([min(h[2], 65535) for h in held], np.uint16), counts)
            where = (tokens >> U(32)) * U(buckets) >> U(32)
            by = np.argsort(where.astype(np.int64), kind="stable")
            tokens, groups, sizes, where = tokens[by], groups[by], sizes[by], where[by]
            cut = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            end = np.append(cut[1:], where.size)
            body = [tokens[a:b].tobytes() + groups[a:b].tobytes() + sizes[a:b].tobytes() for a, b in zip(cut, end)]
            for k in range(0, len(body), 256):
                yield pa.RecordBatch.from_arrays([pa.array(where[cut[k : k + 256]].astype(np.int64)), pa.array(body[k : k + 256], pa.binary())], ["bucket", "rows"])

        for b in batches:
            for own in sets_of(b.column(0)):
                if own.size:
                    prefix, group = order.value.look(own)
                    key = set_id(own)
                    if key in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    held.append((prefix, group, own.size))
                    size += prefix.size
                    if size >= BLOCK:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()
        held = []
        release()

    return run


def bucket_pairs(key, table):
    """Groups that share a shingle, with how many they share inside one bucket."""
    release()
    parts = ([], [], [])
    for chunk in table["rows"].chunks:
        for body in chunk:
            raw = body.as_buffer()
            n = len(raw) // 18
            parts[0].append(np.frombuffer(raw, U, n))
            parts[1].append(np.frombuffer(raw, U, n, 8 * n))
            parts[2].append(np.frombuffer(raw, np.uint16, n, 16 * n))
    token, group, size = (np.concatenate(p) for p in parts)
    # Only shingles that occur twice matter.
    by = np.argsort(token)
    token = token[by]
    again = np.zeros(token.size, bool)
    again[1:] = token[1:] == token[:-1]
    again[:-1] |= again[1:]
    by, token = by[again], token[again]
    group, size = group[by], size[by].astype(np.int64)
    size[size == 65535] = -1
    by = np.lexsort((group, token))
    token, group, size = token[by], group[by], size[by]
    # One row for each shingle and group, with the least and the largest size of its sets there.
    cut = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (group[1:] != group[:-1]))) if token.size else np.zeros(0, np.int64)
    if not cut.size:
        return pa.table({"g1": pa.array([], pa.int64()), "g2": pa.array([], pa.int64()), "shared": pa.array([], pa.int64())})
    least, most = np.minimum.reduceat(size, cut), np.maximum.reduceat(size, cut)
    unknown = least < 0
    least[unknown], most[unknown] = 1, 1 << 40
    token, group = token[cut], group[cut]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    count = np.diff(np.append(first, token.size))
    g1, g2 = [], []
    step = 1
    # Pairs at distance 1, 2, ... inside each run of a shingle's groups.
    end = np.repeat(first + count, count)
    here = np.arange(token.size)
    while True:
        here = here[here + step < end[here]]
        if not here.size:
            break
        there = here + step
        fits = (4 * most[there] >= 3 * least[here]) & (4 * most[here] >= 3 * least[there])
        g1.append(group[here[fits]])
        g2.append(group[there[fits]])
        step += 1
    if not g1:
        return pa.table({"g1": pa.array([], pa.int64()), "g2": pa.array([], pa.int64()), "shared": pa.array([], pa.int64())})
    g1, g2 = np.concatenate(g1), np.concatenate(g2)
    by = np.lexsort((g2, g1))
    g1, g2 = g1[by], g2[by]
    cut = np.flatnonzero(np.append(True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))) if g1.size else np.zeros(0, np.int64)
    return pa.table({"g1": pa.array(g1[cut].view(np.int64)), "g2": pa.array(g2[cut].view(np.int64)), "shared": pa.array(np.diff(np.append(cut, g1.size)).astype(np.int64))})


def open_groups(batches):
    """Rows sorted by home, kind (0: the home's own set, 1: a query), set.  Gives a forest of the links found."""

    def links(own: list, queries: list) -> list[tuple[int, int]]:
        forest, found = Forest(), []
        n = len(own)
        sizes = np.array([s.size for _, s in own])
        tokens = np.concatenate([s for _, s in own])
        which = np.repeat(np.arange(n), sizes)
        by = np.argsort(tokens, kind="stable")
        tokens, which = tokens[by], which[by]

        def partners(s: np.ndarray) -> np.ndarray:
            """Own sets linked with ``s``."""
            a, b = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
            length = b - a
            total = int(length.sum())
            if not total:
                return np.zeros(0, np.int64)
            at = np.repeat(a - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(total)
            both = np.bincount(which[at], minlength=n)
            return np.flatnonzero(100 * both >= 75 * (sizes + s.size - both))

        def link(a, b):
            if forest.join(a, b):
                found.append((a, b))

        if n > 1:
            # Each round compares one set of every part but the largest with all; a part whose sets have
            # all been compared is complete, and two complete parts need no more.
            parts = {i: [i] for i in range(n)}  # root index -> sets not compared yet
            names = [k for k, _ in own]
            at = {k: i for i, k in enumerate(names)}
            members = {i: 1 for i in range(n)}

            def merge(i, j):
                a, b = at[forest.find(names[i])], at[forest.find(names[j])]
                if a == b:
                    return
                link(names[i], names[j])
                r = at[forest.find(names[i])]
                o = b if r == a else a
                parts[r] = parts.pop(a) + parts.pop(b) if r == a else parts.pop(b) + parts.pop(a)
                members[r] = members.pop(r) + members.pop(o)

            while len(parts) > 1:
                todo = [r for r, left in parts.items() if left]
                if len(todo) < 2:
                    break
                r = min(todo, key=lambda r: len(parts[r]))
                i = parts[r].pop()
                for j in partners(own[i][1]).tolist():
                    if j != i:
                        merge(i, j)
        for name, s in queries:
            for j in partners(s).tolist():
                link(name, own[j][0])
        return found

    def rows():
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())

    def out(pairs):
        u, v = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    home, own, queries, held = None, [], [], 0
    seen: set = set()
    for gkey, chunk, kind, key, raw in rows():
        if (gkey, chunk) != home:
            if own and (queries or len(own) > 1) and (found := links(own, queries)):
                yield out(found)
            home, own, queries, held, seen = (gkey, chunk), [], [], 0, set()
        if (kind, key) in seen:
            continue
        seen.add((kind, key))
        s = np.frombuffer(raw, U)
        if kind == 0:
            own.append((key, s))
        else:
            queries.append((key, s))
            held += s.size
            if held > 1 << 20:  # queries pass by in blocks
                if own and (found := links(own, queries)):
                    yield out(found)
                queries, held = [], 0
    if own and (queries or len(own) > 1) and (found := links(own, queries)):
        yield out(found)


def gather(order, mask, form=lambda own: own.tobytes()):
    """The sets of the documents in the mask, with their groups.  Copies stay behind: only the document that stands for a set sends it."""

    def run(batches):
        bits = mask.value
        for b in batches:
            keys, gs, raws, held = [], [], [], 0
            ids = b.column(0).to_numpy(zero_copy_only=False) & ((1 << BITS) - 1)
            asked = np.flatnonzero(bits[ids >> 3] >> (ids & 7).astype(np.uint8) & 1)
            for own in sets_of(b.column(1).take(pa.array(asked))):
                if not own.size:
                    continue
                keys.append(signed(set_id(own)))
                gs.append(signed(order.value.look(own)[1]))
                raws.append(form(own))
                held += len(raws[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(keys, pa.int64()), pa.array(raws, pa.binary())], ["g", "s", "raw"])
                    keys, gs, raws, held = [], [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(keys, pa.int64()), pa.array(raws, pa.binary())], ["g", "s", "raw"])
        release()

    return run


def parities(own: np.ndarray) -> bytes:
    """The size of a set, then for each of PARITY places whether an odd number of its shingles falls there."""
    odd = np.bincount((own >> U(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.array([own.size], np.int64).tobytes() + np.packbits(odd.astype(bool)).tobytes()


def near_enough(batches):
    """home, g, sets, a, z (lists of parities, or null): the rows of which some pair of sets may be similar.  Similar sets differ in at most a seventh of their sizes' sum."""
    for b in batches:
        keep = []
        for a, z in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            if a is None or z is None:
                keep.append(True)
                continue
            x, y = (np.frombuffer(b"".join(side), np.uint8).reshape(len(side), -1) for side in (a, z))
            n, m = (np.ascontiguousarray(side[:, :8]).view(np.int64)[:, 0] for side in (x, y))
            apart = np.bitwise_count(x[:, None, 8:] ^ y[None, :, 8:]).sum(axis=2, dtype=np.int64)
            keep.append(bool((7 * apart <= n[:, None] + m[None, :]).any()))
        yield pa.RecordBatch.from_arrays(list(b.columns[:3]), ["home", "g", "sets"]).filter(pa.array(keep, pa.bool_()))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash and class_id (one value for each class; null for an empty set or no id) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    order = spark.sparkContext.broadcast(Order(frequent_shingles(texts)))

    def describe(batches):
        for b in batches:
            n, ids, groups = [], [], []
            for own in sets_of(b.column(1)):
                n.append(own.size)
                ids.append(signed(set_id(own)) if own.size else None)
                groups.append(signed(order.value.look(own)[1]) if own.size else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(groups, pa.int64())], ["doc_id", "text_hash", "n", "s", "g"])
        release()

    described = stored(texts.mapInArrow(describe, "doc_id bigint, text_hash bigint, n bigint, s bigint, g bigint"), "sets")
    classes = stored(described.where("s is not null and doc_id is not null").groupBy("s").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("g").alias("g")), "classes")
    groups = stored(classes.groupBy("g").agg(F.count("*").alias("sets"), F.min("n").alias("least"), F.max("n").alias("most")), "groups")

    # The matrix, and pairs of groups that share enough of it.
    total = described.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(spark), int(total * 0.3 * 18 / (4 << 20)) + 1)
    packed = texts.select("text").mapInArrow(matrix_rows(order, buckets), "bucket bigint, rows binary")
    pairs = packed.groupBy("bucket").applyInArrow(bucket_pairs, "g1 bigint, g2 bigint, shared bigint").groupBy("g1", "g2").agg(F.sum("shared").alias("shared"))
    a = groups.select(F.col("g").alias("g1"), F.col("sets").alias("k1"), F.col("least").alias("a1"), F.col("most").alias("b1"))
    z = groups.select(F.col("g").alias("g2"), F.col("sets").alias("k2"), F.col("least").alias("a2"), F.col("most").alias("b2"))
    beyond = lambda n: n - (n - F.floor((3 * n + 3) / 4) + 1)  # noqa: E731  shingles after the prefix
    need = F.ceil((F.col("a1") + F.col("a2")) * 3 / 7)
    fits = (4 * F.col("b1") >= 3 * F.col("a2")) & (4 * F.col("b2") >= 3 * F.col("a1")) & (F.col("shared") >= need - F.greatest(beyond(F.col("b1")), beyond(F.col("b2"))))
    kept = pairs.join(a, "g1").join(z, "g2").where(fits)
    swap = F.col("k1") > F.col("k2")  # the group with more sets is the home
    kept = stored(kept.select(F.when(swap, F.col("g1")).otherwise(F.col("g2")).alias("home"), F.when(swap, F.col("g2")).otherwise(F.col("g1")).alias("g"), F.greatest("k1", "k2").alias("sets")), "pairs")

    # Pairs of small groups must also have sets near enough by their parities.
    few = groups.where(F.col("sets") <= SIGNED).join(kept.select("g").union(kept.select("home")).distinct(), "g").select("g", "sets")
    few = stored(few, "small-groups")
    mask = bitmap(classes.join(few.select("g"), "g").select("rep"))
    signs = texts.where("doc_id is not null").mapInArrow(gather(order, mask, parities), "g bigint, s bigint, raw binary")
    signs = signs.join(few, "g").groupBy("g").agg(F.collect_set("raw").alias("signs"), F.first("sets").alias("sets")).where(F.size("signs") == F.col("sets")).select("g", "signs")
    near = kept.join(signs.select(F.col("g").alias("home"), F.col("signs").alias("a")), "home", "left").join(signs.withColumnRenamed("signs", "z"), "g", "left")
    kept = stored(near.select("home", "g", "sets", "a", "z").mapInArrow(near_enough, "home bigint, g bigint, sets bigint"), "close-pairs")

    # Where each group's sets go: home and, as queries, to partners; chunk by chunk.
    chunks = lambda k: F.ceil(F.col(k) / CHUNK).cast("int")
    open_at = kept.select(F.col("home").alias("g")).union(groups.where("sets > 1").select("g")).distinct()
    homes = stored(groups.join(open_at, "g").select("g", chunks("sets").alias("chunks")), "homes")
    dealt = homes.where("chunks > 1").select("g", F.col("g").alias("home"), "chunks", F.lit(0).alias("kind"))
    routes = stored(dealt.unionByName(kept.select("g", "home", chunks("sets").alias("chunks"), F.lit(1).alias("kind"))), "routes")
    stay = bitmap(classes.join(homes.where("chunks = 1").select("g"), "g").select("rep"))
    go = bitmap(classes.join(routes.select("g").distinct(), "g").select("rep"))
    known = texts.where("doc_id is not null")
    own = known.mapInArrow(gather(order, stay), "g bigint, s bigint, raw binary").select(F.col("g").alias("home"), F.lit(0).alias("chunk"), F.lit(0).alias("kind"), "s", "raw")
    whole = known.mapInArrow(gather(order, go), "g bigint, s bigint, raw binary")
    own_chunk = F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int")
    here = F.struct(own_chunk.alias("chunk"), F.lit(0).alias("kind"))
    later = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (F.col("kind") == 1) | (j > own_chunk))
    places = F.concat(F.when(F.col("kind") == 0, F.array(here)).otherwise(F.array().cast("array<struct<chunk:int,kind:int>>")), F.transform(later, lambda j: F.struct(j.alias("chunk"), F.lit(1).alias("kind"))))
    far = whole.join(routes, "g").withColumn("p", F.explode(places)).select("home", F.col("p.chunk").alias("chunk"), F.col("p.kind").alias("kind"), "s", "raw")
    found = own.unionByName(far).repartition(partitions(spark), "home", "chunk").sortWithinPartitions("home", "chunk", "kind", "s").mapInArrow(lambda batches: contract(open_groups(batches)), EDGES)
    roots = connected(found, contracted=True)
    named = classes.select("s", "rep").join(roots, F.col("s") == F.col("node"), "left").select("s", "rep", F.coalesce("root", "s").alias("class_id"))
    least = named.groupBy("class_id").agg(F.min("rep").alias("root"))
    named = named.join(least, "class_id").select(F.col("s").alias("s_"), "class_id", "root")
    has_id = F.col("doc_id").isNotNull()
    return described.join(named, F.col("s") == F.col("s_"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(has_id, F.coalesce("root", "doc_id")).alias("component_id"), "text_hash", F.when(has_id, F.col("class_id")).alias("class_id"))


BITS = 26


def bitmap(ids: DataFrame):
    """A broadcast bit for the low BITS bits of each id: 2**BITS bits (8 MB) whatever the number of ids; a shared bit only sends a set in vain."""
    top = (1 << (BITS - 6)) - 1
    words = ids.select(F.expr(f"shiftright(rep, 6) & {top}").alias("w"), F.expr("shiftleft(1L, cast(rep & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out.view(np.uint8))
