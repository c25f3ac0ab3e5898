"""Operators against brute force on small tables with the awkward cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.llm import bpe, decontaminate, fingerprint, html_main, ngram_join, pii, quality, suffix_dedup, tokenfile, url_filter
from veridoc.llm.components import connected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"word{i * i % 97}" for i in range(160))
TEXTS = [
    None, "", " \n\t ", "one", "One  two THREE", "one two three", BASE, BASE, BASE.upper(), BASE + " a b c", "x y " + BASE[:700], "é ß Ünï 字 " * 30, "ab" * 700, "q" * 399, "q" * 400, "q" * 401,
    "mail a.b@c-d.org or _x@y.z, 10.0.0.256 10.1.2.3 card 4111 1111 1111 1111 tel +49 (30) 1234-5678 end", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", BASE * 40,
]
DOCS = [(i, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1.0) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, pos string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))


def test_ngram_join(docs, empty):
    sets = {i: shingles(t) for i, t in DOCS}
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = {(i, len(s), root(i)) for i, s in sets.items()}
    assert {tuple(r)[:3] for r in ngram_join.similar_sets(docs).collect()} == want
    assert ngram_join.similar_sets(empty).count() == 0


@pytest.mark.parametrize("signed, chunk", [(16, 4096), (1, 4096), (16, 3)])
def test_ngram_join_edited_texts(spark, monkeypatch, signed, chunk):
    monkeypatch.setattr(ngram_join, "SIGNED", signed)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng, texts = np.random.default_rng(5), []
    passage = [f"p{i}" for i in range(30)]
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(20, 200)))]
        for _ in range(int(rng.integers(1, 7))):
            one = list(words)
            for at in rng.integers(0, len(one), int(rng.integers(0, 1 + len(one) // 16))):
                one[at] = f"e{rng.integers(0, 9)}"
            texts.append(" ".join(passage + one if i % 3 == 0 else one))
    sets = dict(enumerate(map(shingles, texts)))
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {tuple(r)[:3] for r in ngram_join.similar_sets(rows).collect()} == {(i, len(s), root(i)) for i, s in sets.items()}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (200, 200)], "u bigint, v bigint")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[101] == 100


def covered(texts, length):
    """For each text, whether each byte lies under a string of ``length`` bytes that also starts elsewhere."""
    count = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    for b in texts:
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                m[p : p + length] = b"\1" * length
        yield m


def dedup_rows(docs):
    texts = [(t or "").encode() for _, t in docs]
    want = set()
    for (i, _), b, m, soft in zip(docs, texts, covered(texts, 400), covered(texts, 256)):
        kept = bytes(x for x, y in zip(b, m) if not y)
        want.add((i, len(b), sum(m), sum(1 for j in range(len(m)) if m[j] and not (j and m[j - 1])), hashlib.sha256(kept).hexdigest(), sum(soft)))
    return want


@pytest.mark.parametrize("shard, hot", [(1 << 20, 1 << 21), (2000, 1 << 21), (2000, 1)])
def test_suffix_dedup(docs, empty, shard, hot):
    assert {tuple(r) for r in suffix_dedup.dedup_report(docs, shard=shard, hot=hot).collect()} == dedup_rows(DOCS)
    assert suffix_dedup.dedup_report(empty).count() == 0


@pytest.mark.parametrize("shard, hot", [(1 << 20, 1 << 21), (3000, 1 << 21), (3000, 20)])
def test_suffix_dedup_common_passage(spark, shard, hot):
    """A passage in most texts, of 300 to 500 bytes, and cut-off copies: many contexts of one key, over many shards."""
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i * i % 977}x" for i in range(90))
    texts = []
    for i in range(60):
        a, b = (" ".join(f"w{x}" for x in rng.integers(0, 500, int(rng.integers(0, 60)))) for _ in range(2))
        texts.append(a + passage[: int(rng.integers(300, len(passage)))] + b if i % 4 else a + b + texts[-1][:260] if texts else a)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {tuple(r) for r in suffix_dedup.dedup_report(df, shard=shard, hot=hot).collect()} == dedup_rows(rows)


def test_suffix_dedup_pieces(spark):
    """Texts longer than a piece: repeated strings across the border of two pieces."""
    word = " ".join(f"q{i * i % 4999}" for i in range(1_000_000))
    half = suffix_dedup.PIECE
    text = word[: half + 5000]
    rows = spark.createDataFrame([(1, text), (2, "x" + text[half - 300 : half + 300] + "y"), (3, "z" + text[half : half + 450])], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_removed, r.n_repeated) for r in suffix_dedup.dedup_report(rows.where("doc_id > 1").unionAll(rows.where("doc_id = 1"))).collect()}
    assert got[2] == (600, 600) and got[3] == (450, 450)


def test_suffix_array_and_common_prefixes():
    text = np.frombuffer(b"banana bandana banana", np.uint8)
    sa, words = suffix_dedup.suffix_array(text)
    raw = text.tobytes()
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = suffix_dedup.common_prefixes(text, sa, words, 400, lane=4)
    for k in range(1, len(raw)):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_library(docs, empty, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = set()
    for i, text in DOCS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in bpe.round_trip(docs, path).collect()} == want
    assert bpe.round_trip(empty, path).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>X<|ENDOFTEXT|>", "it's I'LL a\x1cb\x85c", "ΣΑΣ İ̧ ﬁ é", "12 3٣ 字字😀​z"])
def test_bpe_edges(path, text):
    from tokenizers import Tokenizer

    v, recent = bpe.vocabulary(path)
    t = Tokenizer.from_file(path)
    want = t.encode(text, add_special_tokens=False).ids
    assert list(bpe.array("I", bpe.encode_bytes(text, v, recent))) == want
    ids, counts = tokenfile.library(path).encode(["a", text, None, text])
    assert counts.tolist() == [1, len(want), 0, len(want)] and ids.tolist() == [*t.encode("a").ids, *want, *want]


@pytest.mark.parametrize("portion", [1, 7, 1 << 16])
def test_bpe_portions(monkeypatch, path, portion):
    import random
    from array import array

    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "PORTION", portion)
    library, rng = Tokenizer.from_file(path), random.Random(portion)
    library.no_truncation()
    v = bpe.Vocabulary(path)
    recent = bpe.Recent(v.word, 50)
    for n in (0, 1, 9, 64, 700):
        text = "".join(rng.choice(["word", " ", "  ", "\u03a3\u03c2 ", "e\u0301", " \u0301", "\n", "\u0130x ", "a,b! ", "\u5b57", "\u00a0"]) for _ in range(n))
        assert array("I", bpe.encode_bytes(text, v, recent)).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files(docs, empty, path):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(path), 0, set()
    for i, text in DOCS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in tokenfile.read_frames(tokenfile.write_frames(docs, path, 2, 3)).collect()} == want
    assert tokenfile.read_frames(tokenfile.write_frames(empty, path, 2, 3)).count() == 0


@pytest.mark.parametrize("known, words", [(0, 1), (3, 2), (1000, 1000)])
def test_token_file_words(monkeypatch, path, known, words):
    monkeypatch.setattr(tokenfile, "KNOWN", known)
    monkeypatch.setattr(tokenfile, "WORDS", words)
    encoder = tokenfile.Library(path)
    for texts in (["", None], ["It's a-b 12", " it's  a-b\u00fc 字12字 q"], TEXTS, ["a-b 12 x"], TEXTS):
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        ids, counts = encoder.encode(texts)
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_token_file_parts(path):
    """Words that differ in marks alone cost the library one call; every letter and mark that is cut without it is cut as it does."""
    import random

    encoder, rng = tokenfile.Library(path), random.Random(3)
    encoder.encode(["tionnth tionnth, (tionnth). \"tionnth\" Tionnth?!", "tionnth's 'll a-b,"])
    known = encoder.known.to_pylist()
    assert len(set(known)) == len(known) and [w for w in known if "tionnth" in w] == ["tionnth", "tionnth's"] and "a-b," in known
    ranges = re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", tokenfile.LETTERS)
    letters = [chr(c) for a, b in ranges for c in range(int(a, 16), int(b, 16) + 1)]
    assert len(letters) > 600
    signs = [*tokenfile.MARKS, "'", "'s", "'ll", "a", "Z", "1", "\u00d7", "\u0301", "\u0482", "\u5b57", "\u00aa", "\u200d", "\u0130"]
    texts = [" ".join(f"a{x}b, {x}. ({x}" for x in letters), " ".join(f"a{x}b {x} x{x} {x}x {x}{x}" for x in signs)]
    texts += [" ".join("".join(rng.choice([*signs, "word", "\u00e9"]) for _ in range(rng.randrange(1, 7))) for _ in range(400)) for _ in range(20)]
    ids, counts = encoder.encode(texts)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("portion", [1, 5, 1 << 16])
def test_token_file_new_marks(monkeypatch, path, portion):
    """Marks that Python reorders or composes across and the library, of an older Unicode, does not know."""
    monkeypatch.setattr(bpe, "PORTION", portion)
    encoder = tokenfile.Library(path)
    assert encoder.strange("a\u0d3c") and not encoder.strange("e\u0301\u0323\u3099")
    texts = ["x \u0301\u0d3c y", "a\u1df7\u0301", "\u0898\u0323\u0307", "e\u0301 \u00e9", "a <|endoftext|> b  'll <|endoftext|>c\x1cd \n e\u0301"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = encoder.encode(texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("limit", [1, 3, 7, 1000])
def test_token_file_slices(monkeypatch, limit):
    import pyarrow as pa

    monkeypatch.setattr(tokenfile, "SLICE_BYTES", limit)
    texts = [None, "", "abc", "x" * 20, "", "de", "f", None, "ghi"]
    batches = [pa.record_batch([pa.array(range(a, b), pa.int64()), pa.array(texts[a:b], pa.string())], ["doc_id", "text"]) for a, b in ((0, 3), (3, 3), (3, 4), (4, 9))]
    found = list(tokenfile.slices(batches))
    assert [t for _, part in found for t in part] == texts and [i for ids, _ in found for i in ids] == list(range(9))
    assert all(sum(len(t or "") for t in part[:-1]) <= limit for _, part in found)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 65535).astype(np.uint32)
    for same in (np.zeros(n, np.uint32), np.full(n, 65535, np.uint32), np.resize(np.arange(4, dtype=np.uint32), n)):
        assert (tokenfile.unpack(tokenfile.pack(np.array([7]), np.array([n]), same))[2] == same).all()
    frame = tokenfile.pack(np.array([7]), np.array([n]), ids)
    assert (tokenfile.unpack(frame)[2] == ids).all()
    if n:
        broken = bytearray(frame)
        broken[len(frame) // 2] ^= 1
        with pytest.raises(ValueError):
            tokenfile.unpack(bytes(broken))


def test_token_coder_mixes(path):
    """On the ids of documents: fewer bits an id than the static order-0 entropy, and than deflate on 16-bit ids."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = tokenfile.library(path).encode(texts)[0]
    frame = tokenfile.pack(np.array([1]), np.array([ids.size]), ids)
    assert (tokenfile.unpack(frame)[2] == ids).all()
    share = np.bincount(ids)[np.unique(ids)] / ids.size
    bits = 8 * len(frame) / ids.size
    assert bits < -(share * np.log2(share)).sum() and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / ids.size


@pytest.mark.parametrize("block", [1, 5, 64])
def test_token_coder_blocks(block):
    """Blocks of any length, with ids at both ends of their range, and predictions that agree by chance."""
    rng = np.random.default_rng(block)
    for high, n in ((1, 7), (2, 300), (5, 1000), (65_536, 1000)):
        ids = np.append(rng.integers(0, high, n), [0, 65_535] if high > 5 else [0]).astype(np.uint32)
        assert (tokenfile.unpack(tokenfile.pack(np.array([1]), np.array([ids.size]), ids, block))[2] == ids).all()


@pytest.mark.parametrize("steps", [1, 7, 100])
def test_token_coder_steps(monkeypatch, steps):
    """How many ids are prepared at once changes no byte of a frame."""
    ids = np.random.default_rng(steps).zipf(1.2, 3000).clip(0, 65535).astype(np.uint32)
    want = tokenfile.pack(np.array([1]), np.array([ids.size]), ids, 50)
    monkeypatch.setattr(tokenfile, "STEPS", steps)
    assert tokenfile.pack(np.array([1]), np.array([ids.size]), ids, 50) == want and (tokenfile.unpack(want)[2] == ids).all()


def test_quality(spark, docs, empty):
    good = [(i, " ".join(f"plain{(i * 7 + k * k) % 50} words." for k in range(40)), 1) for i in range(300)]
    bad = [(i, " ".join(f"NOISE{k % 3}!!" for k in range(40)), 0) for i in range(300, 400)]
    rows = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    model = quality.train(rows, rows)
    scored = quality.score(rows, model).join(rows, "doc_id").where(quality.held_out("doc_id")).collect()
    assert len(scored) > 40 and all((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in scored)
    assert {r.doc_id for r in quality.score(docs, model).collect()} == {i for i, _ in DOCS}
    assert all(r.score == 0.5 for r in quality.score(docs, quality.train(docs, rows.where("false"))).collect())
    assert quality.keep_good(empty, model).count() == 0


def test_quality_held_out_labels(spark):
    """On the labelled documents that learning never sees: area under the ROC curve, by ranks, ties counted half, and accuracy."""
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    model = quality.train(table("documents"), table("labels"))
    rows = quality.score(table("documents"), model).join(table("labels"), "doc_id").where(quality.held_out("doc_id")).select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows) / len(rows)
    print(len(good), len(bad), area, right)
    assert area > 0.95 and right > 0.95


def test_html_held_out_pages():
    import random

    rng, weights = random.Random(123), html_main.trained()
    exact = 0
    for _ in range(150):
        source, content = html_main.sample_page(rng)
        exact += set(html_main.extract([source], *weights)[0].split("\n\n")) - {""} == content
    assert exact >= 140


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p>", ""), ("<article><h1>A &amp;amp b</h1><p>One<br>two <b>th</b>ree words here and there.<p>More &lt;x&gt; text, enough of it to read.</article><footer>&copy; f</footer>", "A &amp b\n\nOne two three words here and there.\n\nMore <x> text, enough of it to read."),
    ("<article><script>var a='<p>no</p>';</script><p>Long enough sentence in an article element.</p><!-- <p>x</p> --></article>", "Long enough sentence in an article element."),
])
def test_html_cases(html, text):
    assert html_main.extract([html], *html_main.trained()) == [text]


STORY = "<body><article><h1>A title here</h1><p>Some long text that is content, as one can see here.</p>"
KEPT = "A title here\n\nSome long text that is content, as one can see here."


@pytest.mark.parametrize("rest, text", [
    ('<div class="abc', ""), ("<p", ""), ("<p>x <b", "x"), ("<p title='o'neil'>More words in this part.", "More words in this part."), ("<p title='a > b'>More words in this part.", "More words in this part."),
    ('<p "a>More words in this part.', "More words in this part."), ("</ bogus><p>More words in this part.", "More words in this part."), ("<p>a < b and c > d, as they say.", "a < b and c > d, as they say."),
    ("<p>\u0130\u0130\u0130 and so on.</p><script>var a = '</p>'</SCRIPT ><p>More words in this part.", "\u0130\u0130\u0130 and so on.\n\nMore words in this part."),
    ('<table><tr><td data-label="Price">12 coins, and more words here.</td></tr></table>', "12 coins, and more words here."), ("<!--><p>More words in this part.", "More words in this part."),
])
def test_html_odd_markup(rest, text):
    assert html_main.extract([STORY + rest], *html_main.trained()) == [KEPT + ("\n\n" + text if text else "")]


def test_html_deep_and_long_pages():
    import time

    hard = ["<div>" * 20_000 + "x", "<ul>" + "<div>" * 5000 + "<li>x</li>" * 5000, "<button>" * 50_000, "<a b='" * 100_000 + '"', '<a b="' * 100_000, "<!--" * 100_000, "<x =" * 100_000, STORY + "<p>word " * 100_000]
    began = time.time()
    found = html_main.extract(hard, *html_main.trained())
    assert time.time() - began < 30 and found[-1].startswith(KEPT)
    assert list(html_main.portions([5, html_main.SLICE_CHARS, 7, 7])) == [(0, 1), (1, 2), (2, 4)] and list(html_main.portions([])) == []


def test_main_text(spark):
    page = STORY + "</article><footer>&copy; somebody</footer>"
    rows = [(1, "u", page, "a", 0), (1, "u", page, "a", 0), (2, None, None, None, 1), (None, "v", "", "b", 2), (3, "w", page + "<p>" * 5, "c", 3)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    want = [(None, "v", "", 0), (1, "u", KEPT, len(KEPT)), (1, "u", KEPT, len(KEPT)), (2, None, "", 0), (3, "w", KEPT, len(KEPT))]
    assert sorted(map(tuple, html_main.main_text(table).collect()), key=lambda r: r[0] or 0) == want
    none = html_main.main_text(table.where("false"))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/1?x", "https://m.example.org/en/12#t", "http://example.org/en/2", "http://example.com/fr/9", "ftp://x.com/de/", "http://notexample.net", None, "no url", "http://org", "http://xorg/", "http://a.org:80/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")

    def judge(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = re.split(r"[#]", u.split("://", 1)[1])[0]
        m = re.match(r"([^/?]*)([^?]*)", rest)
        host, path_ = m[1].translate(LOWER), m[2]
        fits = [(h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path_.startswith(p)]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path_, best and best[0] + best[1], best[2] if best else "allow"

    want = {(i, *judge(u)) for i, u in enumerate(urls)}
    assert {tuple(r) for r in url_filter.filter_urls(rows).collect()} == want
    assert {tuple(r) for r in url_filter.filter_urls(rows, ship=0).collect()} == want


def test_decontaminate(spark, docs, empty):
    bench = [(1, " ".join(BASE.split()[20:45])), (2, "One, two THREE"), (3, None), (4, "..."), (5, "absent words only"), (5, "absent words only")]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in bench:
        w = word.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(i)
    want = set()
    for i, t in DOCS:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        want.add((i, len(w), len(hit), len(found), bool(hit)))
    for limit in (decontaminate.LIMIT, 0):  # with the set of bits, and by a shuffled join
        got = decontaminate.decontaminate(docs, items, limit=limit).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
        assert {tuple(r) for r in got} == want
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, items.where("false")).collect())
    clashing = docs.select("doc_id", "text", F.lit("a").alias("th"), F.lit("b").alias("hit_words"), F.lit("c").alias("r"), F.lit("d").alias("new"))
    assert all(tuple(r)[2:] == ("a", "b", "c", "d") for r in decontaminate.cut_spans(clashing, items).collect())
    kept = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, items).collect()}
    assert all(kept[i] == t for i, t in DOCS if (i, False) in {(w[0], w[4]) for w in want}) and 5 not in kept


@pytest.mark.parametrize("n", [1, 2, 5, 10])
def test_decontaminate_windows_at_every_place(spark, n):
    """Items of all lengths stand at all places of texts of a few words that recur often."""
    import random

    rng = random.Random(n)
    some = lambda k: [rng.choice("abcdefg") for _ in range(k)]
    bench = [some(k) for k in [*range(1, 14)] * 2]
    texts = [some(rng.randint(0, 14)) + rng.choice(bench) + some(rng.randint(0, 14)) for _ in range(200)]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bench) if len(w) > n // 2], "item_id bigint, text string")
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    wins = {tuple(w[k : k + min(n, len(w))]) for w in bench if len(w) > n // 2 for k in range(max(1, len(w) - n + 1))}
    want = {}
    for i, w in enumerate(texts):
        want[i] = sorted({p for size in range(1, n + 1) for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in wins for p in range(k, k + size)})
    for limit in (decontaminate.LIMIT, 0):
        assert {r.doc_id: r.hit_words for r in decontaminate.decontaminate(rows, items, n=n, limit=limit).collect()} == want


def test_pii(docs, empty):
    base = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, m):
        d = re.sub(r"\D", "", m)
        return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15

    got = {r.doc_id: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r.found] for r in pii.find_pii(docs).collect()}
    for i, t in DOCS:
        want = [(k, m.start(), m.end()) for k, p in base for m in re.finditer(p, t or "") if ok(k, m.group())]
        assert [s for s in got[i] if s[0] in ("email", "ip", "card", "phone")] == want
    assert [s[0] for s in got[17]] == ["iban"] and [s[0] for s in got[18]] == ["ssn"]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[18] == "ssn <SSN>" and "@" not in clean[16] and clean[6] == BASE
    assert pii.find_pii(empty).count() == 0


def test_pii_many_matches(spark):
    text = " ".join(f"u{i}@h{i}.io" for i in range(700))
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().found
    assert [(s["start"], s["end"]) for s in got] == [m.span() for m in re.finditer(r"\S+", text)]


def test_pii_context_is_the_whole_text_around(spark):
    far = "." * 41
    texts = {
        "SSN: 123-45-6789, 987-65-4321, 555-44-3333": [0, 1, 2], "123-45-6789 (SSN)": [0], "é字 123-45-6789 987-65-4321 ssn é": [0, 1], "123-45-6789": [],
        f"ssn{far}123-45-6789{far}ssn": [], "ssn " + "1" * 36 + "-123-45-6789": [], f"123-45-6789{far}tax 987-65-4321": [1],
        "tax " + " ".join(["123-45-6789"] * 6) + f" {far}": [0, 1, 2, 3], "123-45-6789 " * 6 + "tax": [2, 3, 4, 5],
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.found if s["kind"] == 5] for r in pii.find_pii(rows).collect()}
    for i, (t, want) in enumerate(texts.items()):
        at = [m.span() for m in re.finditer(pii.SSN, t)]
        assert got[i] == [at[k] for k in want], t
    assert pii.redact(rows.where("doc_id = 0")).first().text == "SSN: <SSN>, <SSN>, <SSN>"


def test_fingerprint(docs, empty):
    got = {r.doc_id: r for r in fingerprint.edit_report(docs).collect()}
    order = sorted(((i, t or "") for i, t in DOCS), reverse=True)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[6].fingerprint == got[7].fingerprint and got[7].near_next == 1.0 and got[0].fingerprint == ""
    assert fingerprint.edit_report(empty).count() == 0


def likenesses(spark, pairs):
    rows = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>")
    found = rows.select("i", fingerprint.sketch(F.col("p.a")).alias("a"), fingerprint.sketch(F.col("p.b")).alias("b"))
    return [r.n for r in found.select("i", fingerprint.likeness(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()]


def test_fingerprint_keeps_every_anchor(spark):
    make = lambda name, n: [f"{name}{i}" for i in range(n)]
    passage, a, b = make("p", 100), make("a", 4900), make("b", 4900)
    changed = [w if i != 2500 else "other" for i, w in enumerate(a)]
    pairs = [(a[:2000] + passage + a[2000:], b[:900] + passage + b[900:]), (a, changed), (a, a)]
    shared, edited, same = likenesses(spark, [tuple(map(" ".join, p)) for p in pairs])
    assert 0.005 < shared < 0.02 and 0.99 < edited < 1.0 and same == 1.0


def test_fingerprint_short_and_long(spark):
    text = [f"letters{i * i}" for i in range(60)]
    sizes = [(47, 48), (46, 47), (48, 49), (20, 20), (20, 21)]
    got = likenesses(spark, [(" ".join(text[:m]), " ".join(text[:n])) for m, n in sizes])
    assert min(got) > 0.9 and got[3] == 1.0


def plain_anchors(text, k=4, s=2):
    """The closed syncmers of a text, by their definition."""
    import struct

    import xxhash

    def all_of(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed=h)
        return h

    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if len(words) < k:
        return [all_of(words) >> 32] if words else []
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    mers = [signed(all_of(words[i : i + s])) for i in range(len(words) - s + 1)]
    inner = k - s
    return [all_of(words[i : i + k]) >> 32 for i in range(len(words) - k + 1) if min(mers[i : i + inner + 1]) in (mers[i], mers[i + inner])]


def plain_likeness(a, b):
    places, seen, to = defaultdict(list), Counter(), []
    for j, v in enumerate(b):
        places[v].append(j)
    for v in a:
        seen[v] += 1
        if seen[v] <= len(places[v]):
            to.append(places[v][seen[v] - 1])
    best = []
    for t in to:
        best.append(1 + max((n for n, u in zip(best, to) if u < t), default=0))
    n = max(best, default=0)
    return n / (len(a) + len(b) - n) if a or b else 1.0


def test_fingerprint_equals_plain(spark, docs):
    rng = np.random.default_rng(8)
    noise = [" ".join(f"n{x}" for x in rng.integers(0, 12, n)) for n in (3, 4, 5, 30, 60, 90)]
    rows = DOCS + [(100 + i, t) for i, t in enumerate(noise)] + [(200, BASE[300:] + " " + BASE[:300])]
    got = {r.doc_id: r for r in fingerprint.edit_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    hexes = lambda marks: "".join(f"{v:08X}" for v in marks)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        own, ed, after = (plain_anchors(x) for x in (t, t[: len(t) - half] + nxt[:half], nxt))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (hexes(own), hexes(ed))
        assert got[i].near_edited == pytest.approx(plain_likeness(own, ed)) and got[i].near_next == pytest.approx(plain_likeness(own, after))


def test_fingerprint_matches_in_order(spark):
    a, b, c = ([f"{name}{i}" for i in range(300)] for name in "abc")
    noise = [f"w{i * i % 17}" for i in range(400)]
    pairs = [(a + b + c, c + b + a), (a + b, b + a), (a, a * 10), (a + b + c, a + c), (noise, noise), (noise, noise[:100] + noise[200:] + noise[100:200])]
    swapped, two, many, less, same, moved = likenesses(spark, [tuple(map(" ".join, p)) for p in pairs])
    assert 0.15 < swapped < 0.25 and 0.28 < two < 0.38 and 0.07 < many < 0.13 and 0.6 < less < 0.7 and same == 1.0 and moved < 0.9

    gen = np.random.default_rng(5)
    for m, n, words in ((40, 40, 6), (60, 50, 30), (1, 5, 2)):
        x, y = (gen.integers(0, words, k).tolist() for k in (m, n))
        places = defaultdict(list)
        for j, v in enumerate(y):
            places[v].append(j)
        seen, to = Counter(), []
        for v in x:
            seen[v] += 1
            if seen[v] <= len(places[v]):
                to.append(places[v][seen[v] - 1])
        best = []
        for k, t in enumerate(to):
            best.append(1 + max((best[i] for i in range(k) if to[i] < t), default=0))
        row = spark.createDataFrame([(x, y)], "x array<bigint>, y array<bigint>")
        assert row.select(fingerprint.in_order(F.col("x"), F.col("y")).alias("n")).first().n == max(best, default=0)


def test_ngram_join_one_id_of_several_texts(spark):
    """Rows of one id are judged by their own texts."""
    other = " ".join(f"z{i}" for i in range(50))
    rows = spark.createDataFrame([(3, BASE), (5, BASE + " a"), (5, other), (5, other), (5, "")], "doc_id bigint, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_sets(rows).collect()]
    assert sorted(got) == [(3, 97, 3), (5, 0, 5), (5, 46, 5), (5, 46, 5), (5, 98, 3)]


def test_repeated_rows(spark, path):
    rows = spark.createDataFrame([(1, BASE), (1, BASE), (None, BASE), (2, "other text entirely")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.similar_sets(rows).collect()) == [(0, 0), (1, 1), (1, 1), (2, 2)]
    assert [r.n_removed for r in suffix_dedup.dedup_report(rows).collect() if r.doc_id == 1] == [len(BASE)] * 2
    assert tokenfile.read_frames(tokenfile.write_frames(rows, path, 2, 2)).count() == 4
    assert fingerprint.edit_report(rows).count() == 4 and pii.find_pii(rows).count() == 4


def test_pipeline(spark, tmp_path, path):
    import __spark_entry__

    good = [(i, " ".join(f"plain{(i * 7 + k * k) % 90} text{(i * k) % 71}." for k in range(40)), "en", "s", 1) for i in range(200)]
    bad = [(1000 + i, " ".join(f"NOISE{k % 3}!!" for k in range(40)), "en", "s", 1) for i in range(60)]
    more = [(500, good[3][1], "en", "s", 1), (501, good[4][1] + " mail me@here.org", "en", "s", 1)]
    spark.createDataFrame(good + bad + more, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in good + bad], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(good[5][1].split()[:15]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()}
    assert not any(i >= 1000 for i in got) and 500 not in got and 3 in got and 501 not in got
    assert good[5][1].split()[0] not in got[5].text.split()[:3]
    v, recent = bpe.vocabulary(path)
    assert got[7].text == good[7][1] and list(got[7].token_ids) == list(bpe.array("I", bpe.encode_bytes(good[7][1], v, recent))) and got[7].decoded == v.decode(got[7].token_ids)


@pytest.mark.parametrize("text, kinds", [
    ("1" * 1_000_000, []), ("1-" * 400_000 + "1", []), ("a@b" + ".a" * 400_000, ["email"]), ("1.1.1." * 150_000, ["ip"]), ("7" * 500_000 + ".5", []), ("+1" * 300_000, []), ("+" + "1 (" * 300_000, []),
    ("GB82 " * 200_000, []), ("x " * 300_000 + "me@here.org", ["email"]),
])
def test_pii_long_runs(spark, text, kinds):
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert {pii.KINDS[s["kind"]] for s in pii.find_pii(rows).first().found} == set(kinds)
    clean = pii.redact(rows).first().text
    assert (clean == text) == (not kinds) and (kinds != ["email"] or clean.endswith("<EMAIL>"))


def test_redact_keeps_all_else(spark):
    rng = np.random.default_rng(3)
    words = ["é字", "plain", "a@b.de", "4111 1111 1111 1111", "10.2.3.4", "+49 30 12345678", "😀", "x@y.z.w"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), n)) for n in (0, 1, 5, 300, 3000)]
    rows = spark.createDataFrame([(i, t, 7, "f", "n") for i, t in enumerate(texts)], "doc_id int, text string, n_chars int, _found string, _new string")
    found = {r.doc_id: r.found for r in pii.find_pii(rows).collect()}
    for r in pii.redact(rows).collect():
        at, out, t = 0, "", texts[r.doc_id]
        for s in sorted(found[r.doc_id], key=lambda s: (s["start"], s["kind"], s["end"])):
            if s["start"] >= at:
                out += t[at : s["start"]] + f"<{pii.KINDS[s['kind']].upper()}>"
            at = max(at, s["end"])
        assert r.text == out + t[at:] and (r._found, r._new) == ("f", "n") and r.n_chars == (len(r.text) if found[r.doc_id] else 7)


def test_pipeline_stages_on_awkward_rows(spark, docs, empty, path):
    """Nulls, empty and repeated rows, rows of one id with several texts, columns with the stages' own names, empty tables."""
    import corpus_pipeline

    rows = [(i, t) for i, t in DOCS] + [(6, BASE), (6, "another text of the same id, with words enough"), (None, BASE), (None, None)]
    names = ["r", "new", "id", "th", "stays", "hit_words", "found", "class_id", "text_hash", "own_id"]
    wide = spark.createDataFrame([(*r, *names) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, wide, "")
    assert got.columns == wide.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    sets = [shingles(t) for _, t in rows]
    alike = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if rows[a][0] is not None and rows[b][0] is not None and alike(sets[a], sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    want = []
    for g in sorted(set(group)):
        own = [rows[k] for k in range(len(rows)) if group[k] == g]
        want.append(own[0][0] if own[0][0] is None else min(i for i, _ in own))
    assert sorted(map(str, want)) == sorted(str(i) for i, _ in kept) and (6, "another text of the same id, with words enough") in kept
    assert all(tuple(r)[2:] == tuple(names) for r in got.collect())
    clean = corpus_pipeline.personal_data(spark, wide, "")
    assert clean.columns == wide.columns and clean.count() == len(rows)
    last = corpus_pipeline.token_ids(spark, wide, "")
    assert last.count() == len(rows) and [r.token_ids for r in last.where("text is null").collect()] == [[], []]
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.personal_data, corpus_pipeline.token_ids):
        assert stage(spark, empty, "").count() == 0


def test_pipeline_gives_memory_back(spark, docs, monkeypatch):
    """Between stages the JVMs collect their garbage, workers keep no tables, and the links are found and contracted in one worker."""
    import corpus_pipeline
    from veridoc.llm import common, components, textbytes

    def full_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    for _, stage in corpus_pipeline.STAGES[3:]:
        before = full_collections()
        stage(spark, docs, "")
        assert full_collections() > before
    textbytes.powers(10)
    common.release()
    assert not textbytes._powers
    plans = []

    def stored(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return common.stored(df, name)

    monkeypatch.setattr(components, "stored", stored)
    ngram_join.similar_sets(docs)
    assert plans[0][0] == "edges" and plans[0][1].split("RepartitionByExpression")[0].count("MapInArrow") == 1
