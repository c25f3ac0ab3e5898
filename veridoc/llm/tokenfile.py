"""Token-id output: an adaptive context-mixing range coder over independent blocks.

File format.  A token file is a Parquet file in the shared folder whose rows are frames, in
ascending order of documents.  A frame is one binary value:

    header   magic "VTF3", ids (u32), blocks (u32), block length (u32), documents (u32), bytes of the start (u32)
    table    document ids (i64 each), their numbers of ids (u32 each)
    start    deflated: ids (u32), each id's frequency (u32), what follows it most often (u16), how sure that is (u8),
             first weights (u16)
    blocks   crc32 of the block's ids (u32 each), words of code (u32 each), then the code words (u32)
    crc32    of everything before it (u32)

Each block of ``BLOCK`` ids is coded on its own: its models are reset to the frame's start.  Three
predictions of the next id are mixed into one distribution over all ids: order 2 (the id that in the
block last followed the two before), order 1 (the id that in the frame most often follows the one
before) and order 0 (the frame's frequencies).  The weights are chosen by a small context (whether
orders 2 and 1 agree, whether order 2 has seen its context, how sure order 1 is) and move after each
id towards the share that each prediction had in the probability of what came.  A range coder with a 64-bit range and carries codes the id in one step
and gives 32-bit words.  All blocks of a frame are coded in step, one numpy lane for each.

Parquet's commit protocol makes the writing safe against lost executors and repeated tasks.

Defined cases: a null text counts as empty, so its document has the end id alone; a null id
stands first; repeated ids stand by a hash of their text, then by it; an empty table gives no frames and no rows;
extra columns are ignored; ids must be below 65536.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np

MAGIC = b"VTF3"
BLOCK = 4096
LANES = 1024
O2_BITS = 11
#: Frequencies of order 0 sum to 1 << FREQ; weights are kept in 16 bits and used in MIX bits.
FREQ, MIX, RATE = 19, 10, 5
#: A range is shared out in 1 << TOTAL parts; below 1 << WORD a word of code is settled.
TOTAL, WORD = FREQ + MIX, 32
FINE = 16 - MIX
IDS = 1 << 16
SETS = 16
STEPS = 16  # of all lanes that are prepared at once when encoding
SURE = (1 / 32, 1 / 8, 1 / 2)  # shares of an id's most frequent successor that part the levels of sureness
U = np.uint64


class Start:
    """What every block of a frame begins with."""

    def __init__(self, freq: np.ndarray, follows: np.ndarray, sure: np.ndarray, weights: np.ndarray):
        self.freq, self.follows, self.sure, self.weights = freq.astype(np.int32), follows, sure, weights
        self.cum = (np.cumsum(freq) - freq).astype(np.int32)

    @classmethod
    def of(cls, ids: np.ndarray) -> Start:
        """ids: all ids of the frame in order, below 65536, one at least."""
        count = sum(np.bincount(ids[at : at + (1 << 18)], minlength=IDS) for at in range(0, ids.size, 1 << 18))
        freq = (count > 0) + count * ((1 << FREQ) - np.count_nonzero(count)) // ids.size
        freq[count.argmax()] += (1 << FREQ) - freq.sum()
        pairs = ids[:-1].astype(np.uint32) << np.uint32(16) | ids[1:]
        pairs.sort()
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: pairs.size]).astype(np.int32)
        times, before = np.diff(np.append(first, np.int32(pairs.size))), (pairs[first] >> np.uint32(16)).astype(np.uint16)
        most = np.zeros(IDS, np.int32)
        np.maximum.at(most, before, times)
        best = np.flatnonzero(times == most[before])[::-1]  # of ties the least id, which is written last
        follows = np.zeros(IDS, np.uint16)
        follows[before[best]] = pairs[first[best]].astype(np.uint16)
        return cls(freq, follows, np.searchsorted(SURE, most / np.maximum(count, 1), "right").astype(np.uint8), np.zeros((2, SETS), np.uint16))

    def packed(self) -> bytes:
        n = int(np.flatnonzero(self.freq)[-1]) + 1
        return zlib.compress(struct.pack("<I", n) + b"".join(a[:n].astype(k).tobytes() for a, k in ((self.freq, "<u4"), (self.follows, "<u2"), (self.sure, "u1"))) + self.weights.astype("<u2").tobytes())

    @classmethod
    def unpacked(cls, raw: bytes) -> Start:
        raw, at, found = zlib.decompress(raw), 4, []
        n = struct.unpack_from("<I", raw)[0]
        for kind, wide in (("<u4", np.int64), ("<u2", np.uint16), ("u1", np.uint8)):
            full = np.zeros(IDS, wide)
            full[:n] = np.frombuffer(raw, kind, n, at)
            at += n * np.dtype(kind).itemsize
            found.append(full)
        return cls(*found, np.frombuffer(raw, "<u2", 2 * SETS, at).reshape(2, SETS))

    def context(self, p: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The weights' context.  p: the predictions of orders 2 and 1."""
        a, b = p
        return self.sure.take(before, mode="clip") | (a == b).view(np.uint8) << np.uint8(2) | (a == 0).view(np.uint8) << np.uint8(3)


def slots(before: np.ndarray, before2: np.ndarray) -> np.ndarray:
    """Slots of the predictions after these ids (all uint16, products wrap)."""
    found = before * np.uint16(40503)
    found += before2 * np.uint16(30011)
    found >>= np.uint16(4)
    found &= np.uint16((1 << O2_BITS) - 1)
    return found


class Memory:
    """The ids that last followed two others, in all lanes."""

    def __init__(self, lanes: int):
        self.last, self.base = np.zeros(lanes << O2_BITS, np.uint16), np.arange(lanes) << O2_BITS


class Mixer:
    """Weights of all lanes, and what share of 1 << TOTAL each prediction gets.  All intervals lie below 1 << TOTAL, so 32 bits do."""

    def __init__(self, start: Start, lanes: int):
        self.start, self.base = start, np.arange(lanes) * SETS
        self.weights = np.tile(start.weights.astype(np.int32), (1, lanes))

    def mix(self, context: np.ndarray, part: np.ndarray, rest: np.ndarray) -> None:
        """Writes the shares of orders 2 and 1, and how often the frame's frequencies count."""
        self.cell = self.base + context
        self.kept = self.weights.take(self.cell, axis=1, mode="clip")
        np.right_shift(self.kept, FINE, out=part)
        np.subtract(1 << MIX, part[0], out=rest)
        rest -= part[1]
        part <<= FREQ

    def find(self, p: np.ndarray, part: np.ndarray, rest: np.ndarray, value: np.ndarray, inverse: np.ndarray, x: np.ndarray) -> None:
        """The ids whose intervals hold ``value``, written to ``x``.

        What orders 2 and 1 add stands where the interval of their id begins.  It is taken out of ``value``, first that of
        order 2, and order 0 is left.
        """
        (a, b), (u, v) = p, part
        first, second = rest * self.start.cum.take(p, mode="clip")
        first += v * (b < a)
        for begin, share in ((first, u), (second, v)):
            np.subtract(value, begin, out=begin)
            np.maximum(begin, 0, out=begin)
            np.minimum(begin, share, out=begin)
            value -= begin
        np.take(inverse, (value / rest).astype(np.int32), out=x, mode="clip")

    def learn(self, hit: np.ndarray, width: np.ndarray) -> None:
        """Each weight moves towards its part (``hit``) in the coded interval; order 0 keeps 1 in 64 at least.

        Doubles hold these integers exactly, and IEEE division and product are the same everywhere.
        """
        part = (hit * (float(63 << 10) / width)).astype(np.int32)
        part -= self.kept
        part >>= RATE
        part += self.kept
        np.maximum(part, 1 << FINE, out=part)
        for row, new in zip(self.weights, part):
            row[self.cell] = new


def predictions(start: Start, columns: np.ndarray):
    """Predictions (2, ids, lanes) and contexts of all ids.  columns: two ids 0, then the ids, a lane in each column."""
    n, lanes = columns.shape[0] - 2, columns.shape[1]
    m, found, context = Memory(lanes), np.empty((2, n, lanes), np.uint16), np.empty((n, lanes), np.uint8)
    for lo in range(0, n, STEPS):
        hi = min(lo + STEPS, n)
        before = columns[lo + 1 : hi + 1]
        for t, slot in enumerate(slots(before, columns[lo:hi]), lo):
            place = m.base + slot
            np.take(m.last, place, out=found[0, t], mode="clip")
            m.last[place] = columns[t + 2]
        np.take(start.follows, before, out=found[1, lo:hi], mode="clip")
        context[lo:hi] = start.context(found[:, lo:hi], before)
    return found, context


def first_weights(found: np.ndarray, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each context's share of right predictions over the frame; predictions that agree share alike."""
    held = np.zeros(4 * SETS)
    for t in range(0, len(ids), 256):
        hits = (found[:, t : t + 256] == ids[t : t + 256]).view(np.uint8)
        held += np.bincount((context[t : t + 256] << np.uint8(2) | hits[0] << np.uint8(1) | hits[1]).reshape(-1), minlength=4 * SETS)
    none, second, first, both = held.reshape(SETS, 4).T
    shares = np.stack([first + both / 2, second + both / 2]) / np.maximum(none + second + first + both, 1)
    return np.maximum(shares * (63 << 10), 1 << FINE).astype(np.uint16)


def encode_blocks(ids: np.ndarray, start: Start) -> list[np.ndarray]:
    """ids: (blocks, length).  The code words of each block; sets the first weights."""
    lanes, n = ids.shape
    columns = np.zeros((n + 2, lanes), np.uint16)  # two ids 0 before the first
    columns[2:] = ids.T
    found, context = predictions(start, columns)
    start.weights = first_weights(found, context, columns[2:])
    m = Mixer(start, lanes)
    low, size = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    out = np.zeros((lanes, n + 3), np.uint32)
    flat, fill = out.reshape(-1), np.arange(lanes) * out.shape[1]
    starts = fill.copy()
    parts, rests, widths = np.empty((STEPS, 2, lanes), np.int32), np.empty((STEPS, lanes), np.int32), np.empty((STEPS, lanes), np.int32)
    for lo in range(0, n, STEPS):
        x = columns[lo + 2 : min(lo + STEPS, n) + 2]
        p = found[:, lo : lo + STEPS].swapaxes(0, 1)
        right, freq = p == x[:, None], start.freq.take(x, mode="clip")
        for t in range(len(x)):
            m.mix(context[lo + t], parts[t], rests[t])
            hit, width = parts[t] * right[t], widths[t]
            np.multiply(rests[t], freq[t], out=width)
            width += hit[0]
            width += hit[1]
            m.learn(hit, width)
        below = parts[: len(x)] * (p < x[:, None])
        begins = (rests[: len(x)] * start.cum.take(x, mode="clip") + below[:, 0] + below[:, 1]).astype(U)
        for begin, width in zip(begins, widths.astype(U)):
            size >>= U(TOTAL)
            begin *= size
            low += begin
            over = low < begin
            if over.any():  # a carry into the words already settled
                to = fill[over] - 1
                while to.size:
                    flat[to] += np.uint32(1)
                    to = to[flat[to] == 0] - 1
            size *= width
            todo = np.flatnonzero(size < U(1 << WORD))
            if todo.size:
                a, to = low[todo], fill[todo]
                flat[to] = a >> U(WORD)
                fill[todo] = to + 1
                low[todo] = a << U(WORD)
                size[todo] <<= U(WORD)
    flat[fill], flat[fill + 1] = low >> U(WORD), low & U((1 << WORD) - 1)
    return [flat[a:b] for a, b in zip(starts, fill + 2)]


def decode_blocks(codes: list[np.ndarray], n: int, start: Start) -> np.ndarray:
    """The ids of each block, (blocks, n)."""
    lanes = len(codes)
    flat = np.concatenate([*codes, np.zeros(2, np.uint32)]).astype(U)
    at = np.concatenate([[0], np.cumsum([c.size for c in codes])[:-1]]).astype(np.int64)
    m, memory = Mixer(start, lanes), Memory(lanes)
    inverse = np.repeat(np.arange(IDS, dtype=np.uint16), start.freq)
    size, code = np.full(lanes, (1 << 64) - 1, U), (flat[at] << U(WORD)) | flat[at + 1]  # code: what lies above low
    at += 2
    columns = np.zeros((n + 2, lanes), np.uint16)
    last = flat.size - 1
    p, part, rest = np.empty((2, lanes), np.uint16), np.empty((2, lanes), np.int32), np.empty(lanes, np.int32)
    for t in range(n):
        before, x = columns[t + 1], columns[t + 2]
        place = memory.base + slots(before, columns[t])
        np.take(memory.last, place, out=p[0], mode="clip")
        np.take(start.follows, before, out=p[1], mode="clip")
        m.mix(start.context(p, before), part, rest)
        size >>= U(TOTAL)
        m.find(p, part, rest, (code // size).astype(np.int32), inverse, x)
        below, hit = part * (p < x), part * (p == x)
        begin = rest * start.cum.take(x, mode="clip")
        begin += below[0]
        begin += below[1]
        width = rest * start.freq.take(x, mode="clip")
        width += hit[0]
        width += hit[1]
        code -= size * begin.astype(U)
        size *= width.astype(U)
        todo = np.flatnonzero(size < U(1 << WORD))
        if todo.size:
            to = at[todo]
            code[todo] = (code[todo] << U(WORD)) | flat[np.minimum(to, last)]
            size[todo] <<= U(WORD)
            at[todo] = to + 1
        m.learn(hit, width)
        memory.last[place] = x
    return np.ascontiguousarray(columns[2:].T)


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One frame.  ids: all ids of the documents, one document after another, below 65536."""
    n = ids.size
    blocks = -(-n // block)
    padded = np.zeros(blocks * block, np.uint16)
    padded[:n] = ids
    padded[n:] = padded[n - 1 : n]
    grid = padded.reshape(blocks, block)
    codes, start = [], b""
    if blocks:
        model = Start.of(padded)
        codes = encode_blocks(grid, model)
        start = model.packed()
    crcs = np.array([zlib.crc32(g.astype("<u4").tobytes()) for g in grid], "<u4")
    body = b"".join([
        MAGIC, struct.pack("<IIIII", n, blocks, block, len(doc_ids), len(start)), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), start,
        crcs.tobytes(), np.array([c.size for c in codes], "<u4").tobytes(), *[c.astype("<u4").tobytes() for c in codes],
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, counts, ids; raises ValueError if a checksum fails."""
    if frame[:4] != MAGIC or zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("not a whole token frame")
    n, blocks, block, docs, held = struct.unpack_from("<IIIII", frame, 4)
    at = 24
    take = lambda kind, k: np.frombuffer(frame, kind, k, at)
    doc_ids = take("<i8", docs)
    at += 8 * docs
    counts = take("<u4", docs)
    at += 4 * docs
    start = frame[at : at + held]
    at += held
    crcs = take("<u4", blocks)
    at += 4 * blocks
    sizes = take("<u4", blocks)
    at += 4 * blocks
    words = np.frombuffer(frame, "<u4", int(sizes.sum()), at)
    grid = decode_blocks(np.split(words, np.cumsum(sizes)[:-1]), block, Start.unpacked(start)) if blocks else np.zeros((0, 0), np.uint16)
    for k in range(blocks):
        if zlib.crc32(grid[k].astype("<u4").tobytes()) != crcs[k]:
            raise ValueError(f"block {k} fails its checksum")
    return doc_ids, counts, grid.reshape(-1)[:n]


# --- Spark ------------------------------------------------------------------------------------

NO_ID = -(2**63)
SLICE_BYTES = 24 << 20  # of texts encoded at a time; a longer text goes alone
WORDS = 50_000  # of distinct words in one call of the library
KNOWN = 500_000  # words kept from slice to slice, besides one slice's own
_LIBRARY: dict = {}


#: A word is marks, letters, marks, if it can be: three parts that the vocabulary's patterns cut apart in any case (so no
#: apostrophe is a mark).  The letters are ranges that hold nothing else in any version of Unicode.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = r"\A[a-z\x{DF}-\x{F6}\x{F8}-\x{24F}\x{3AC}-\x{3CE}\x{430}-\x{481}\x{48A}-\x{527}]+\z"


def parted(words):
    """Three parts of each word, one word after another, which share the words' bytes; an odd word is its own second part."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(words):
        return words
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    bare = pc.ascii_rtrim(words, characters=MARKS)
    core = pc.ascii_ltrim(bare, characters=MARKS)
    plain = pc.match_substring_regex(core, LETTERS).to_numpy(zero_copy_only=False)
    size, kept, inner = (pc.binary_length(x).to_numpy() for x in (words, bare, core))
    cuts = np.empty(3 * len(words) + 1, np.int32)
    cuts[0:-1:3], cuts[1::3], cuts[2::3], cuts[-1] = at[:-1], at[:-1] + (kept - inner) * plain, at[1:] - (size - kept) * plain, at[-1]
    return pa.StringArray.from_buffers(3 * len(words), pa.py_buffer(cuts), words.buffers()[2])


class Library:
    """The tokenizers library; it encodes each new part of the words of some MB of texts once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        from veridoc.llm import bpe

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = Tokenizer(self.tokenizer.model)  # for normalised letters, each run of which is one piece
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        v = bpe.vocabulary(path)[0]
        self.piece = v.pattern
        self.ends = np.array([s.endswith(v.suffix) for s in v.strings])
        self.known, self.runs = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.marks = None

    def whole(self, text: str, tokenizer=None) -> np.ndarray:
        from veridoc.llm import bpe

        encode = (tokenizer or self.tokenizer).encode_batch_fast
        return np.concatenate([np.zeros(0, np.uint32), *[np.array(encode([part], add_special_tokens=False)[0].ids, np.uint32) for part in bpe.portions(text)]])

    def strange(self, text: str) -> bool:
        """Whether NFC may not be what the library makes of the text."""
        from veridoc.llm import bpe

        if self.marks is None:
            self.marks = bpe.unknown_marks(self.tokenizer.normalizer.normalize_str)
        return not self.marks.isdisjoint(text)

    def fresh(self, words, tokenizer, pieces: np.ndarray):
        """Ids of all words, which have so many pieces, and how many ids each has: the ids that end a piece tell."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), WORDS):
            some, n = words.slice(lo, WORDS), pieces[lo : lo + WORDS]
            ids = self.whole(pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py(), tokenizer)
            ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            if ends.size == n.sum() + 1:
                sizes.append(np.diff(ends[np.concatenate([[0], np.cumsum(n)])]))
                found.append(ids)
            else:  # the library cuts some word in another way
                apart = [self.whole(w) for w in some.to_pylist()]
                sizes.append(np.array([x.size for x in apart], np.int64))
                found += apart
        return np.concatenate(found), np.concatenate(sizes)

    def parts(self, parts):
        """The runs of ids of distinct parts.

        Parts of former slices are known; when these are more than KNOWN, those of this slice replace them.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        from veridoc.llm import bpe

        at = pc.index_in(parts, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        plain = pc.match_substring_regex(parts.take(pa.array(new)), LETTERS).to_numpy(zero_copy_only=False)
        for places, tokenizer in ((new[plain], self.letters), (new[~plain], self.tokenizer)):
            at[places] = len(self.known) + np.arange(places.size)
            some = parts.take(pa.array(places))
            pieces = np.ones(places.size, np.int64) if tokenizer is self.letters else pc.count_substring_regex(some, self.piece).to_numpy()
            self.known = pa.concat_arrays([self.known, some])
            self.runs = pa.concat_arrays([self.runs, bpe.runs(*self.fresh(some, tokenizer, pieces))])
        found = self.runs.take(pa.array(at))
        if len(self.known) > KNOWN:
            self.known, self.runs = parts, found
        return found

    def words(self, words):
        """The runs of ids of distinct words."""
        import pyarrow.compute as pc

        from veridoc.llm import bpe

        coded = pc.dictionary_encode(parted(words))
        ids, ends = bpe.opened(self.parts(coded.dictionary).take(coded.indices))
        return bpe.runs(ids, np.diff(ends[::3]))

    def encode(self, texts: list):
        from veridoc.llm import bpe

        return bpe.encode_texts(texts, self.words, self.whole, self.strange)


def library(path: str) -> Library:
    if path not in _LIBRARY:
        _LIBRARY[path] = Library(path)
    return _LIBRARY[path]


def slices(batches):
    """Ids and texts of Arrow batches, regrouped to about SLICE_BYTES of texts."""
    import pyarrow.compute as pc

    ids, texts, held = [], [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (held + np.cumsum(sizes)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part, prepend=0)) + 1).tolist()]  # after each text that fills a slice
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
            ids.append(batch.column(0)[lo:hi].fill_null(NO_ID).to_numpy(zero_copy_only=False))
            texts += batch.column(1)[lo:hi].to_pylist()
            if hi in cuts[1:]:
                yield np.concatenate(ids), texts
                ids, texts = [], []
        held = (held + int(sizes.sum())) % SLICE_BYTES
    if texts:
        yield np.concatenate(ids), texts


def write_frames(docs, path: str, end_id: int, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """Encodes the documents in ascending order and returns the stored frames: shard, seq, n_ids, frame.

    Documents are dealt by ranges of their id (repeated ids by a hash of their text, so that the
    sample of the ranges holds no texts), sorted inside each range, and cut into frames of about
    LANES * BLOCK ids.  Without ``parts`` adaptive execution sizes the ranges, in their order.
    """
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    from veridoc.llm.common import release, small_batches, stored

    small_batches(docs.sparkSession)

    def run(batches):
        release()
        encode = library(path).encode
        shard, seq = TaskContext.get().partitionId(), 0
        ids, counts, parts, size = [], [], [], 0

        def frame():
            body = pack(np.concatenate(ids), np.concatenate(counts), np.concatenate(parts))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([size], pa.int64()), "frame": pa.array([body], pa.binary())})

        for keys, texts in slices(batches):
            raw, n = encode(texts)
            ids.append(keys)
            counts.append(n + 1)
            parts.append(np.insert(raw, np.cumsum(n), end_id))
            size += parts[-1].size
            if size >= LANES * BLOCK:
                yield frame()
                seq += 1
                ids, counts, parts, size = [], [], [], 0
        if ids:
            yield frame()
        ids = parts = None
        release()

    rows = (
        docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").withColumn("key", F.xxhash64("text"))
        .repartitionByRange(*([parts] if parts else []), "doc_id", "key").sortWithinPartitions("doc_id", "key", "text").select("doc_id", "text")
    )
    return stored(rows.mapInArrow(run, "shard int, seq int, n_ids bigint, frame binary"), "tokens")


def read_frames(frames):
    """Reads stored frames back: doc_id, start, n_tokens, ids_crc32 of every document."""
    import pyarrow as pa
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from veridoc.llm import bpe
    from veridoc.llm.common import release

    totals = frames.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each written part
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = frames.select("shard", "seq", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")).alias("frame_start"))
    starts = inside.join(before, "shard").select("shard", "seq", (F.col("shard_start") + F.col("frame_start")).alias("start"))
    rows = frames.select("shard", "seq", "frame").join(starts, ["shard", "seq"]).select("start", "frame")

    def run(batches):
        _LIBRARY.clear()  # of a worker that has written before
        bpe._VOCABULARIES.clear()
        release()
        for batch in batches:
            for start, frame in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, counts, tokens = unpack(frame.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                data = memoryview(tokens.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * (e - int(c)) : 4 * e]) for c, e in zip(counts, ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(start + ends - counts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])
            release()

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
