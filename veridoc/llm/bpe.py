"""BPE encoding and decoding of the public word vocabulary.

Encoding keeps the symbols of a word in a doubly linked list and its mergeable pairs in a
priority queue of merge ranks; entries whose symbols have changed meanwhile are skipped as
stale.  Decoding concatenates vocabulary strings.  Normalisation, splitting and added tokens
follow the vocabulary file.  Words recur, so each worker keeps the ids of recent words in two
bounded generations.

Defined cases: a null text counts as empty and gives no ids; repeated rows give equal rows; an
empty table gives no rows; texts of any length are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from veridoc.llm.common import release, small_batches

#: White space of the vocabulary's patterns: str.split() without U+001C to U+001F.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Vocabulary:
    """Strings, ids and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*ids.values(), *self.added.values()]) + 1)
        for s, i in [*ids.items(), *self.added.items()]:
            self.strings[i] = s
        self.first = [ids[c] for c in byte_symbols()]
        self.last = [ids[c + self.suffix] for c in byte_symbols()]
        #: pair (first id << 32 | second id) -> merge rank; rank -> id of what the pair becomes
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [ids[a + b] for a, b in model["merges"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.pieces = regex.compile(self.pattern).findall
        self.recent_pieces = Recent(lambda piece: array("I", self.merge(piece)).tobytes(), 60_000)
        self.added_split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw = piece.encode()
        ids = [self.first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        find, made = self.ranks.get, self.made
        # An entry is rank << 32 | place of the pair's first symbol.
        queue = [m << 32 | i for i in range(n - 1) if (m := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] < 0 or find(ids[i] << 32 | ids[j]) != entry >> 32:
                continue  # stale
            ids[i] = new = made[entry >> 32]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := find(new << 32 | ids[k])) is not None:
                    push(queue, m << 32 | i)
            h = before[i]
            if h >= 0 and (m := find(ids[h] << 32 | new)) is not None:
                push(queue, m << 32 | h)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """Ids, as bytes, of a normalised stretch without white space."""
        pieces = self.pieces(word)
        if len(pieces) == 1:  # kept as a word, so not once more as a piece
            return array("I", self.merge(pieces[0])).tobytes()
        return b"".join([self.recent_pieces[piece] for piece in pieces])

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


class Recent(dict):
    """What ``of`` makes of a word, kept for two generations of at most ``size`` words each."""

    def __init__(self, of, size: int):
        super().__init__()
        self.of, self.size, self.old = of, size, {}

    def __missing__(self, word: str):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            found = self.of(word)
        self[word] = found
        return found


def normal(text: str) -> str:
    """NFC, then lower case, character by character as the vocabulary's normaliser does."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split(text: str) -> list[str]:
    return [w for w in SPACE.split(text) if w] if ODD_SPACE.search(text) else text.split()


PORTION = 1 << 16  # characters of a text whose words are held at once; cut at spaces, which no rule of the normaliser reaches across


def portions(text: str):
    at = 0
    while at < len(text):
        to = text.find(" ", at + PORTION)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def encode_bytes(text: str, v: Vocabulary, recent: Recent) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if "<|" not in text:
        return b"".join([b"".join(map(recent.__getitem__, split(normal(part)))) for part in portions(text)])
    ids = lambda part: array("I", [v.added[part]]).tobytes() if part in v.added else b"".join(map(recent.__getitem__, split(normal(part))))
    return b"".join(map(ids, v.added_split(text)))


def unknown_marks(normalize) -> frozenset:
    """Characters that NFC moves or composes and the library's normaliser, of an older Unicode, leaves where they are."""
    found = set()
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        pair = "".join(chr(int(x, 16)) for x in parts) if len(parts) == 2 and parts[0][0] != "<" else ""
        for text in (["\u0345" + c] if unicodedata.combining(c) else []) + ([pair] if pair else []):
            if normalize(text) != normal(text):
                found.add(text[-1])
    return frozenset(found)


def runs(ids, sizes) -> pa.LargeBinaryArray:
    """Runs of ids (numpy, u32), one after another, as an Arrow array of their bytes."""
    import numpy as np

    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(4 * np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])), pa.py_buffer(ids)])


def opened(found: pa.LargeBinaryArray):
    """The ids of all runs, and where each run begins and the last ends."""
    import numpy as np

    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset) // 4 if len(found) else np.zeros(1, np.int64)
    ids = np.frombuffer(found.buffers()[2], np.uint32, ends[-1]) if ends[-1] else np.zeros(0, np.uint32)
    return ids, ends


def encode_texts(texts: list, of_words, whole, strange):
    """Ids of all texts, one after another (numpy, u32), and each text's number of ids (int64).

    ``of_words`` encodes the distinct words of all texts together: an Arrow array of normalised
    words gives their runs of ids.
    ``whole`` encodes the texts that may hold added tokens, odd white space, or characters that
    would be changed again if a normalised word were normalised anew, and texts not in NFC that
    ``strange`` says are put there in another way by the library.
    """
    import numpy as np
    import pyarrow.compute as pc

    plain, apart = [], {}
    for k, text in enumerate(texts):
        text = text or ""
        low = normal(text)
        if "<|" in text or any(c in text for c in ODD_SPACES) or not (text.isascii() or unicodedata.is_normalized("NFC", low) and (unicodedata.is_normalized("NFC", text) or not strange(text))):
            apart[k], low = whole(text), ""
        plain.append(low)
    found = pc.utf8_split_whitespace(pa.array(plain, pa.string()))  # cuts where str.split() does
    coded = pc.dictionary_encode(found.values)
    ids, ends = opened(of_words(coded.dictionary).take(coded.indices))
    cuts = ends[found.offsets.to_numpy()]
    counts = np.diff(cuts)
    if apart:
        parts = [apart.get(k, ids[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]
        ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    return ids, counts


_VOCABULARIES: dict[str, tuple[Vocabulary, Recent]] = {}


def vocabulary(path: str) -> tuple[Vocabulary, Recent]:
    """The vocabulary, and what it makes of words; two generations of 300,000 words are kept."""
    if path not in _VOCABULARIES:
        v = Vocabulary(path)
        _VOCABULARIES[path] = (v, Recent(v.word, 300_000))
    return _VOCABULARIES[path]


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        v, recent = vocabulary(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                raw = encode_bytes(text or "", v, recent)
                ids = array("I", raw)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, DIGEST)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """The documents in their own columns, with their ids (array<int>) and the text decoded from these."""
    import numpy as np
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded_col, T.StringType())])
    names = schema.names

    def run(batches):
        release()
        v = Vocabulary(path)  # the task's own: idle workers, of which an executor may have several, then hold none
        recent = Recent(v.word, 50_000)
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                b = batch.slice(lo, 250)
                raws = [encode_bytes(t or "", v, recent) for t in b.column(at).to_pylist()]
                ends = np.cumsum([0, *(len(r) // 4 for r in raws)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), np.int32)))
                decoded = pa.array([v.decode(array("I", r)) for r in raws], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, ids, decoded], names)
        v = recent = None
        release()

    return docs.mapInArrow(run, schema)
