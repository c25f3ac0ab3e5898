"""Suffix-array deduplication: bytes under strings of ``LENGTH`` bytes that also start elsewhere.

Strings of ``NOTICE`` bytes (about fifty words) are found by the same arrays and reported, not removed.

1.  Keys.  Each string of NOTICE bytes has a key, the least hash among its inner strings of ``INNER``
    bytes; equal strings have equal keys, and so have equal longer ones.  Along a text the key is the same for
    long runs of starts.  The runs are grouped by key; a key with one run, whose least inner string lies in
    one place, holds no repeated string.  All others are wanted.
2.  Contexts.  The bytes under a wanted run, with what LENGTH bytes from its last start reach, are its
    context.  Runs with equal contexts are repeated from end to end, so they are marked at once, and
    one of them stands for all; runs that are equal inside one block never leave it.
3.  Shards.  Contexts are dealt to shards by key, so that all starts of a string meet; a key with more than
    ``shard`` bytes has several shards, each a group of rows of its own.  Each shard's suffix array is made
    by Larsson-Sadakane refinement in numpy (groups of equal prefixes, doubled each time; only groups not yet single are sorted again), its common prefixes by Kasai's recurrence, run in
    lanes.  Neighbours with LENGTH (or NOTICE) bytes in common are one string.
4.  Merging.  The shards of one key write their strings as sorted 64-bit fingerprints, dealt by ranges of the
    fingerprint; each range is one group of rows, in which strings left alone in their own shard
    are looked up by binary search in the merged ones.
5.  Marked starts are united for each document, and the bytes between are kept.

No task holds more than a bucket, a shard or a range, whatever share of the rows one key has: buckets of runs beyond
``hot`` rows are dealt again by key and context, and all their runs are wanted.

Defined cases: null counts as empty; texts shorter than LENGTH keep all bytes; matches never
cross documents; repeated rows are copies of each other and each gives a row; an empty table
gives no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import partitions, small_batches, stored
from veridoc.llm.textbytes import U, blend, buffers, powers, running, slices

LENGTH = 400
NOTICE = 256
INNER = 64
WINDOW = NOTICE - INNER + 1
SLICE = 1 << 19
PIECE = 1 << 22  # a longer text is read in pieces that overlap by LENGTH - 1 bytes
SHARD = 1 << 20
BLOCK = 1 << 17  # runs packed at once
BUCKET = 16 << 20  # bytes of runs in a bucket, about
HOT = 1 << 21  # runs in a bucket that is dealt again
PLACE_BITS = 24
RUN = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<i4"), ("size", "<i4"), ("weight", "<i4"), ("self", "u1")])
LONE = np.dtype([("print", "<u8"), ("doc", "<i8"), ("place", "<i8"), ("alone", "u1")])
MARK = "doc bigint, level int, a bigint, b bigint"  # starts a to b - 1 of repeated strings; level 0: of NOTICE bytes, 1: of LENGTH

def grams(sums: np.ndarray, length: int) -> np.ndarray:
    """Hash of the string of ``length`` bytes at every start."""
    _, q = powers(sums.size)
    m = sums.size - length
    return blend((sums[length:] - sums[:m]) * q[:m])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    n = x.size - w + 1
    pad = -x.size % w
    grid = np.append(x, np.full(pad, np.iinfo(np.uint64).max, U)).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs_of(column: pa.Array, docs: np.ndarray) -> np.ndarray:
    """All runs of equal keys, as RUN rows."""
    data_all, off_all = buffers(column)
    out = []

    def read(data, off, rows, base, last=None):
        """off: bounds of the rows inside data; base: place of the first byte in its text; last: starts from here on are left to others."""
        if data.size < NOTICE:
            return
        sums = running(data)
        h = grams(sums, INNER)
        place = np.arange(h.size, dtype=U)
        least = window_min((h >> U(PLACE_BITS) << U(PLACE_BITS)) | place, WINDOW)
        key = least >> U(PLACE_BITS)
        here = np.arange(least.size)
        row = np.searchsorted(off, here, "right") - 1
        valid = here + NOTICE <= off[row + 1]
        if last is not None:
            valid &= here < last
        fresh = np.ones(least.size, bool)
        fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(valid)
        if not at.size:
            return
        head = np.flatnonzero(fresh[at] | np.append(True, np.diff(at) > 1))
        start = at[head]
        n = np.diff(np.append(head, at.size))
        moved = np.append(False, (least[1:] != least[:-1]) & (key[1:] == key[:-1]))
        moves = np.add.reduceat(moved[at].astype(np.int64), head) - moved[start]
        _, q = powers(sums.size)
        end = np.minimum(start + n - 1 + LENGTH, off[row[start] + 1])
        r = np.zeros(start.size, RUN)
        r["key"], r["ctx"] = key[start], blend((sums[end] - sums[start]) * q[start]) ^ blend(n.astype(U))
        r["doc"], r["start"], r["n"], r["size"] = docs[rows[row[start]]], start - off[row[start]] + base, n, end - start
        r["weight"], r["self"] = 1, moves > 0
        out.append(r)

    for lo, hi in slices(off_all, SLICE):
        off = off_all[lo : hi + 1]
        size = int(off[-1] - off[0])
        if hi - lo == 1 and size > PIECE:
            for a in range(0, size, PIECE):
                data = data_all[off[0] + a : min(off[-1], off[0] + a + PIECE + LENGTH - 1)]
                read(data, np.array([0, data.size]), np.array([lo]), a, PIECE)
        else:
            read(data_all[off[0] : off[-1]], off - off[0], np.arange(lo, hi), 0)
    return np.concatenate(out) if out else np.zeros(0, RUN)


def marks(doc, level, a, b) -> dict[str, pa.Array]:
    return {"doc": pa.array(doc, pa.int64()), "level": pa.array(np.full(len(a), level), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}


def whole(r: np.ndarray) -> pa.Table:
    """Marks of runs that are repeated from end to end."""
    hard = np.clip(r["size"].astype(np.int64) - LENGTH + 1, 0, r["n"])
    some = hard > 0
    return pa.concat_tables([
        pa.table(marks(r["doc"], 0, r["start"], r["start"] + r["n"])),
        pa.table(marks(r["doc"][some], 1, r["start"][some], r["start"][some] + hard[some])),
    ])


def by_context(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs sorted by key and context, and whether each is the first of its context; the first carries the weight of all."""
    r = r[np.lexsort((r["start"], r["doc"], r["ctx"], r["key"]))]
    first = np.ones(r.size, bool)
    first[1:] = (r["key"][1:] != r["key"][:-1]) | (r["ctx"][1:] != r["ctx"][:-1])
    if r.size:
        head = np.flatnonzero(first)
        r["weight"][head] = np.minimum(np.add.reduceat(r["weight"].astype(np.int64), head), 1 << 30)
        r["self"][head] = np.maximum.reduceat(r["self"], head)
    return r, first


PACKED = f"bucket bigint, sub int, n bigint, rows binary, {MARK}"


def packed(r: np.ndarray, where: np.ndarray, sub: np.ndarray | None = None):
    """Batches of PACKED: the runs by bucket (and part of it), without marks."""
    sub = np.zeros(r.size, np.int64) if sub is None else sub
    by = np.lexsort((sub, where))
    r, where, sub = r[by], where[by].astype(np.int64), sub[by]
    cut = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (sub[1:] != sub[:-1]))) if r.size else np.zeros(0, np.int64)
    end = np.append(cut[1:], where.size)
    for k in range(0, cut.size, 4096):
        lo, hi = cut[k : k + 4096], end[k : k + 4096]
        none = pa.nulls(lo.size, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(where[lo]), pa.array(sub[lo].astype(np.int32)), pa.array(hi - lo), pa.array([r[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary()), none, pa.nulls(lo.size, pa.int32()), none, none],
            ["bucket", "sub", "n", "rows", "doc", "level", "a", "b"])


def sent(table: pa.Table):
    """Batches of PACKED: marks alone."""
    for b in table.to_batches(max_chunksize=1 << 16):
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(b.num_rows, pa.int32()), none, pa.nulls(b.num_rows, pa.binary()), *b.columns], ["bucket", "sub", "n", "rows", "doc", "level", "a", "b"])


def pack_runs(buckets: int):
    """Packs the runs by range of their key; of runs equal in one block one goes on, the others are marked."""

    def run(batches):
        held, size = [], 0

        def out():
            r, first = by_context(np.concatenate(held))
            yield from sent(whole(r[~first]))
            r = r[first]
            yield from packed(r, (blend(r["key"]) >> U(32)) * U(buckets) >> U(32))

        for b in batches:
            r = runs_of(b.column(1), b.column(0).to_numpy(zero_copy_only=False))
            if r.size:
                held.append(r)
                size += r.size
            if size >= BLOCK:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return run


def split_buckets(parts: int):
    """Deals the runs of hot buckets by key and context: (bucket, n, rows) to PACKED."""

    def run(batches):
        for b in batches:
            for bucket, total, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                r = np.frombuffer(body.as_buffer(), RUN)
                subs = U(-(-total // parts))
                yield from packed(r, np.full(r.size, bucket), ((blend(r["key"] ^ blend(r["ctx"])) >> U(32)) * subs >> U(32)).astype(np.int64))

    return run


WANTED = f"{MARK}, n bigint, weight bigint, grp bigint, shard int, shards int"


def wanted_runs(shard: int, hot: bool):
    """Marks of the runs whose context is there twice (level 0 or 1), and the runs that supply contexts (level -1)."""

    def run(key, table):
        r = np.concatenate([np.frombuffer(body.as_buffer(), RUN) for chunk in table["rows"].chunks for body in chunk])
        r, first = by_context(r)
        one = r[first]
        fresh = np.append(True, one["key"][1:] != one["key"][:-1])
        group = np.cumsum(fresh) - 1
        if hot:  # the rest of each key is elsewhere
            wanted = np.ones(one.size, bool)
            shards = np.full(one.size, max(2, -(-int(table["total"][0].as_py()) * (LENGTH + 100) // shard)))
            grp = np.full(one.size, key[0].as_py())
        else:
            wanted = ((np.bincount(group) > 1) | (np.bincount(group, weights=(one["self"] > 0) | (one["weight"] > 1)) > 0))[group]
            total = np.bincount(group, weights=one["size"])[group]
            shards = np.maximum(1, np.ceil(total / shard)).astype(np.int64)
            grp = one["key"].astype(np.int64) + (1 << 41)  # keys have 40 bits: apart from the numbers of buckets
        twice = np.repeat(one["weight"] > 1, np.diff(np.append(np.flatnonzero(first), r.size))) if r.size else first
        done = whole(r[twice])
        lead = (blend(one["ctx"] ^ U(0x9E3779B97F4A7C15)) % np.maximum(shards, 1).astype(U)).astype(np.int32)
        # A key whose only context is repeated as a whole needs no suffix array, unless it repeats inside.
        lonely = (np.bincount(group)[group] == 1) & (one["self"] == 0) if not hot else np.zeros(one.size, bool)
        ask = wanted & ~lonely
        none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
        n = done.num_rows
        done = pa.table([*done.columns, none(n), none(n), none(n), none(n, pa.int32()), none(n, pa.int32())], names=[f.split()[0] for f in WANTED.split(", ")])
        q = one[ask]
        asked = pa.table({
            "doc": pa.array(q["doc"]), "level": pa.array(np.full(q.size, -1, np.int32)), "a": pa.array(q["start"]), "b": pa.array(q["start"] + q["size"]), "n": pa.array(q["n"].astype(np.int64)),
            "weight": pa.array(q["weight"].astype(np.int64)), "grp": pa.array(grp[ask]), "shard": pa.array(lead[ask]), "shards": pa.array(shards[ask].astype(np.int32)),
        })
        return pa.concat_tables([done, asked])

    return run


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the 8 bytes from each place.

    Larsson-Sadakane: a suffix's group is the place of the last of all suffixes with the same prefix; sorting those
    of a group by the group of the suffix h bytes further doubles the prefix.  Groups of one are done.
    """
    n = text.size
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text.astype(U) + U(1)
    words = np.zeros(n + 1, U)
    for j in range(8):
        words[:n] = (words[:n] << U(8)) | (wide[j : n + j] & U(255))
    sa = np.argsort(words[:n], kind="stable").astype(np.int64)
    w = words[sa]
    last = np.flatnonzero(np.append(w[1:] != w[:-1], True))
    group = np.empty(n + 1, np.int64)
    group[n] = -1
    sizes = np.diff(np.append(-1, last))
    group[sa] = np.repeat(last, sizes)
    h = 8
    todo = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in sa of groups not single
    while todo.size:
        s = sa[todo]
        g = group[s]
        order = np.argsort((g.astype(U) << U(32)) | (group[np.minimum(s + h, n)] + 1).astype(U), kind="stable")
        s, g = s[order], g[order]
        nxt = group[np.minimum(s + h, n)]
        sa[todo] = s
        ends = np.append((g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1]), True)
        last = np.flatnonzero(ends)
        sizes = np.diff(np.append(-1, last))
        group[s] = np.repeat(todo[last], sizes)
        todo = todo[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa, words


def common_prefixes(text: np.ndarray, sa: np.ndarray, words: np.ndarray, depth: int, lane: int = 256) -> np.ndarray:
    """Bytes in common with the suffix before, at most ``depth``, by place in the suffix array.

    Kasai: going along the text, the number falls by one at most from a place to the next.  The
    text is cut into lanes that go along in step; each lane starts from nothing.
    """
    n = text.size
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    before = np.append(-1, sa[:-1])
    out = np.zeros(n, np.int64)
    starts = np.arange(0, n, lane)
    h = np.zeros(starts.size, np.int64)
    for t in range(lane):
        p = starts + t
        if p[-1] >= n:
            p, h = p[:-1], h[:-1]
            starts = starts[:-1]
            if not p.size:
                break
        r = rank[p]
        q = before[r]
        h = np.maximum(h - 1, 0)
        h[q < 0] = 0
        live = np.flatnonzero((q >= 0) & (h < depth))
        while live.size:
            a, b = p[live] + h[live], q[live] + h[live]
            x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
            whole = (x == 0) & (a < n) & (b < n)
            part = live[~whole]
            if part.size:
                y = x[~whole]
                bits = np.zeros(part.size, np.int64)
                for k in range(1, 8):
                    bits += (y >> U(64 - 8 * k)) == 0
                h[part] += bits
            live = live[whole]
            h[live] += 8
            live = live[h[live] < depth]
        h = np.minimum(h, depth)
        out[r] = h
    return out


def shard_strings(text: np.ndarray, sizes: np.ndarray, own: np.ndarray, weights: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length: the starts (of the first ``own`` of each context, as far as the length fits) whose string is there twice.

    ``text`` is all contexts after one another, ``sizes`` their bytes; a context of weight 2 or more stands for several.
    """
    sa, words = suffix_array(text)
    lcp = common_prefixes(text, sa, words, max(lengths))
    which = np.repeat(np.arange(sizes.size), sizes)
    inside = np.arange(text.size) - (np.cumsum(sizes) - sizes)[which]
    out = []
    for length in lengths:
        starts = inside < np.minimum(own, sizes - length + 1)[which]  # the rest of a context is only read
        string = np.cumsum(lcp < length) - 1
        total = np.bincount(string, weights=np.where(starts, weights[which], 0)[sa])
        twice = np.zeros(text.size, bool)
        twice[sa] = total[string] > 1
        out.append((starts, twice & starts))
    return out


MATCHED = f"{MARK}, grp bigint, part int, rows binary"


def match_contexts(shard: int):
    """Rows sorted by group and shard: (grp, shard, shards, doc, start, n, weight, raw).  Marks, and for groups of several shards
    their strings' fingerprints by range, as LONE rows (in ``level`` 0 or 1)."""

    def work(rows, grp, shards):
        docs, starts, own, weights = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        raws = [r[4] for r in rows]
        sizes = np.array([x.size for x in raws])
        text = np.concatenate(raws)
        base = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(sizes.size), sizes)
        for level, (there, twice) in enumerate(shard_strings(text, sizes, own, weights, (NOTICE, LENGTH))):
            mask = twice & (weights == 1)[which]  # the others are marked already
            head = np.zeros(text.size, bool)
            head[base] = True
            up = np.flatnonzero(mask & (head | ~np.append(False, mask[:-1])))
            down = np.flatnonzero(mask & np.append(head[1:] | ~mask[1:], True)) + 1
            if up.size:
                w = which[up]
                found = pa.table(marks(docs[w], level, up - base[w] + starts[w], down - base[w] + starts[w]))
                for b in found.to_batches():
                    none = pa.nulls(b.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([*b.columns, none, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], ["doc", "level", "a", "b", "grp", "part", "rows"])
            if shards > 1:
                sums, at = running(text), np.flatnonzero(there)
                _, q = powers(sums.size)
                out = np.zeros(at.size, LONE)
                out["print"] = blend((sums[at + (NOTICE, LENGTH)[level]] - sums[at]) * q[at])
                out["doc"], out["place"], out["alone"] = docs[which[at]], at - base[which[at]] + starts[which[at]], ~twice[at]
                out = out[np.argsort(out["print"], kind="stable")]
                out = out[np.append(True, out["print"][1:] != out["print"][:-1])] if out.size else out
                part = ((out["print"] >> U(32)) * U(shards) >> U(32)).astype(np.int64)
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if out.size else np.zeros(0, np.int64)
                if cut.size:
                    none = pa.nulls(cut.size, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        none, pa.array(np.full(cut.size, level, np.int32)), none, none, pa.array(np.full(cut.size, grp)), pa.array(part[cut].astype(np.int32)),
                        pa.array([out[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], out.size))], pa.binary()),
                    ], ["doc", "level", "a", "b", "grp", "part", "rows"])

    def run(batches):
        held, size, last, before = [], 0, None, None
        for b in batches:
            for grp, part, shards, doc, start, n, weight, raw in zip(*(c.to_pylist() for c in b.columns[:7]), b.column(7)):
                if (grp, part, shards) != last:
                    if held and (size >= shard or last[2] > 1 or shards > 1):
                        yield from work(held, last[0], last[2])
                        held, size = [], 0
                    last, before = (grp, part, shards), None
                if (doc, start) == before:  # a repeated row
                    continue
                before = (doc, start)
                held.append((doc, start, n, weight, np.frombuffer(raw.as_buffer(), np.uint8)))
                size += held[-1][4].size
        if held:
            yield from work(held, last[0], last[2])

    return run


def merge_shards(key, table):
    """One range of one group's fingerprints: those alone in their shard that another shard has too."""
    shards = [np.frombuffer(body.as_buffer(), LONE) for chunk in table["rows"].chunks for body in chunk]
    merged = np.sort(np.concatenate([s["print"] for s in shards]))
    docs, places = [], []
    for s in shards:
        lone = s[s["alone"] > 0]
        again = np.searchsorted(merged, lone["print"], "right") - np.searchsorted(merged, lone["print"], "left") > 1
        docs.append(lone["doc"][again])
        places.append(lone["place"][again])
    place = np.concatenate(places)
    return pa.table(marks(np.concatenate(docs), key[2].as_py(), place, place + 1))


def united(bounds: list[dict], length: int) -> np.ndarray:
    """The bytes under the marked starts as rows (start, end), ascending and apart."""
    if not bounds:
        return np.zeros((0, 2), np.int64)
    own = np.array(sorted((m["a"], m["b"] - 1 + length) for m in bounds), np.int64)
    reach = np.maximum.accumulate(own[:, 1])
    first = np.append(True, own[1:, 0] > reach[:-1])
    return np.stack([own[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(own) - 1)]], 1)


SPANS = "array<struct<start:bigint,end:bigint>>"
CUT = f"doc_id bigint, n_bytes bigint, kept binary, removed {SPANS}, repeated {SPANS}"


def cut_out(batches):
    """(doc_id, text, marks): what is left of each text, and the spans."""
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def spans(each):
        flat = np.concatenate(each) if each else np.zeros((0, 2), np.int64)
        off = np.append(0, np.cumsum([len(x) for x in each]))
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(pair)))

    for b in batches:
        data, off = buffers(b.column(1))
        kept, removed, repeated = [], [], []
        for i, found in enumerate(b.column(2).to_pylist()):
            own = data[off[i] : off[i + 1]]
            removed.append(united([m for m in found or () if m["level"] == 1], LENGTH))
            repeated.append(united([m for m in found or () if m["level"] == 0], NOTICE))
            if len(removed[-1]):
                ends = np.append(0, removed[-1][:, 1])
                kept.append(b"".join(own[x:y].tobytes() for x, y in zip(ends, np.append(removed[-1][:, 0], own.size))))
            else:
                kept.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(kept, pa.binary()), spans(removed), spans(repeated)], ["doc_id", "n_bytes", "kept", "removed", "repeated"])


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc, doc_id, text), and for each with repeated strings (doc, marks)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)).alias("doc"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    long = rows.where(F.octet_length("text") >= NOTICE)
    total = long.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = max(partitions(spark), int(total / 90 * RUN.itemsize / BUCKET) + 1)
    runs = stored(long.select("doc", "text").mapInArrow(pack_runs(buckets), PACKED), "runs")
    parts = [runs.where("rows is null").select("doc", "level", "a", "b")]
    sizes = runs.where("rows is not null").groupBy("bucket").agg(F.sum("n").alias("total"))
    over = sizes.where(F.col("total") > hot)
    body = runs.where("rows is not null").select("bucket", "n", "rows")
    if over.isEmpty():
        wanted = body.select("bucket", "rows").groupBy("bucket").applyInArrow(wanted_runs(shard, False), WANTED)
    else:
        many = F.broadcast(over.withColumnRenamed("bucket", "b"))  # a row for each ``hot`` runs at most
        cold = body.join(many, F.col("bucket") == F.col("b"), "left_anti").select("bucket", "rows").groupBy("bucket").applyInArrow(wanted_runs(shard, False), WANTED)
        dealt = body.join(many, F.col("bucket") == F.col("b")).select("bucket", "total", "rows").mapInArrow(split_buckets(max(1, hot // 4)), PACKED).select("bucket", "sub", "rows")
        dealt = dealt.join(many, F.col("bucket") == F.col("b")).select("bucket", "sub", "rows", "total")
        wanted = cold.unionByName(dealt.groupBy("bucket", "sub").applyInArrow(wanted_runs(shard, True), WANTED))
    wanted = stored(wanted, "wanted")
    parts.append(wanted.where("level >= 0").select("doc", "level", "a", "b"))
    asked = wanted.where("level < 0").groupBy("doc").agg(F.collect_list(F.struct("grp", "shard", "shards", F.col("a").alias("start"), F.col("b").alias("end"), "n", "weight")).alias("asked"))

    def cut(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            out, held = [], 0
            for i, (doc, asked_) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                for a in asked_:
                    out.append((a["grp"], a["shard"], a["shards"], doc, a["start"], a["n"], a["weight"], data[off[i] + a["start"] : off[i] + a["end"]].tobytes()))
                    held += len(out[-1][-1])
                    if held > 2 << 20:
                        yield rows_of(out)
                        out, held = [], 0
            if out:
                yield rows_of(out)

    names = ["grp", "shard", "shards", "doc", "start", "n", "weight", "raw"]

    def rows_of(out):
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    contexts = long.select("doc", "text").join(asked, "doc").select("doc", "text", "asked").mapInArrow(cut, "grp bigint, shard int, shards int, doc bigint, start bigint, n bigint, weight bigint, raw binary")
    matched = contexts.repartition(partitions(spark), "grp", "shard").sortWithinPartitions("grp", "shard", "doc", "start").mapInArrow(match_contexts(shard), MATCHED)
    matched = stored(matched, "matched")
    parts.append(matched.where("rows is null").select("doc", "level", "a", "b"))
    parts.append(matched.where("rows is not null").select("grp", "part", "level", "rows").groupBy("grp", "part", "level").applyInArrow(merge_shards, MARK))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return rows, found.groupBy("doc").agg(F.collect_list(F.struct("level", "a", "b")).alias("marks"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), removed and repeated (spans of bytes) of every document."""
    rows, found = repeated_starts(docs, id_col, text_col, shard, hot)
    return rows.join(found, "doc", "left").select("doc_id", "text", "marks").mapInArrow(cut_out, CUT)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated (bytes under strings of NOTICE bytes that also start elsewhere) of every document."""
    width = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs, id_col, text_col, shard, hot).select(
        "doc_id", "n_bytes", width("removed").alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), width("repeated").alias("n_repeated"))
