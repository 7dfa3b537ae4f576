"""The operators' kernels without Spark."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from llm import ann, bpe, html_text, line_dedup, near_dedup, tiff, toxicity, url_filter

LIB = Library.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
LIB.no_padding()
LIB.no_truncation()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdehinorst' S1é中.!<|>", max_size=80)))
def test_bpe_as_library(text):
    tok = bpe.tokenizer(bpe.word_vocabulary())
    want = LIB.encode(text, add_special_tokens=False).ids
    assert tok.encode(text) == want
    assert tok.decode(want) == LIB.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("first", [0, 0x8000, 0x10000, 0x18000, 0x20000, 0x28000, 0x30000, 0x38000, 0xE0000])
def test_bpe_of_every_letter(first):
    tok = bpe.tokenizer(bpe.word_vocabulary())
    texts = [s + chr(c) for c in range(first, first + 0x8000) if not 0xD800 <= c < 0xE000 for s in ":a"]
    for text, want in zip(texts, LIB.encode_batch(texts, add_special_tokens=False)):
        assert tok.encode(text) == want.ids, ascii(text)


def test_bpe_worker_keeps_nothing_after_a_task(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 6)
    tok = bpe.tokenizer(bpe.word_vocabulary())
    texts = ["one two, three: it's", "two 2two three-four one", "five six seven eight nine ten one two it's", None] * 3
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    run, held = bpe._encode(bpe.word_vocabulary(), True)(iter([batch])), []
    for out in run:
        held.append(len(tok.cache) + len(tok.before))
        assert out.column("ids").to_pylist() == [LIB.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 0 < held[0] <= 6
    assert not tok.cache and not tok.before and not tok.automaton.known


def test_bpe_worker_encodes_a_task_s_words_once(monkeypatch):
    """A quarter of a million words, said again: as many as a task of some thousand documents has."""
    tok = bpe.tokenizer(bpe.word_vocabulary())
    tok.forget()
    called = []
    monkeypatch.setattr(tok.automaton, "encode", lambda word: called.append(word) or [25])
    texts = [" ".join(f"{a}{b}{c}{d}x{k}" for a in "abcde" for b in "abcde" for c in "abcdefgh" for d in "abcde").translate(str.maketrans("0123456789", "qrstuvwyzp")) for k in range(250)]
    for text in texts * 2:
        tok.pieces(text)
    tok.forget()
    assert len(called) == len(set(called)) == 250_000


@pytest.mark.parametrize("text", ["", " ", "hi<|endoftext|>there", "aaaaaaaaaaaaaaaa", "ΑΣ σΣ", "\x1ca\x85b", "it's we'll 2026", "mississippi" * 40])
def test_bpe_cases(text):
    assert bpe.tokenizer(bpe.word_vocabulary()).encode(text) == LIB.encode(text, add_special_tokens=False).ids


def plain_set(text, width):
    words = text.encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB c\t\n é\x0b", max_size=60), st.text(alphabet="aB c\t\n é\x0b", max_size=60))
def test_shingles(a, b):
    x, y = near_dedup.shingle_set(a.encode(), 4), near_dedup.shingle_set(b.encode(), 4)
    p, q = plain_set(a, 4), plain_set(b, 4)
    assert len(x) == len(p) and len(np.intersect1d(x, y)) == len(p & q)


def glob_ok(host, path, rule):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="neto.xrg", max_size=12), st.sampled_from(["", "/", "/en/", "/en", "/fr/x/a.net/"])), max_size=8))
def test_shift_and(urls):
    rules = [*url_filter.RULES, url_filter.Rule("xn.net", "/" + "a" * 70, "block")]
    got = url_filter.ShiftAnd([r.glob for r in rules]).match([f".{h}{p}".encode() for h, p in urls])
    assert got.tolist() == [[glob_ok(h, p, r) for r in rules] for h, p in urls]


def lzw(data):
    """A plain LZW packer, for the reader's sake."""
    table, width, codes, w = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b""
    n = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        codes.append((table[w], width))
        table[w + c] = n
        n += 1
        if n in (512, 1024, 2048):
            width += 1
        if n == 4094:
            codes.append((256, width))
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        w = c
    if w:
        codes.append((table[w], width))
        n += 1
        if n in (512, 1024, 2048):
            width += 1
    codes.append((257, width))
    bits = "".join(format(c, f"0{b}b") for c, b in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80"


def file_of(order, pages):
    """Pages of (fields, blocks, tag of places, tag of sizes)."""
    import struct

    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for fields, blocks, at_tag, size_tag in pages:
        places = []
        for b in blocks:
            places.append(len(out))
            out += b
        arrays = {**fields, at_tag: places, size_tag: [len(b) for b in blocks]}
        spot = {}
        for tag, v in arrays.items():
            if len(v) > 1:
                spot[tag] = len(out)
                out += struct.pack(f"{order}{len(v)}I", *v)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(arrays))
        for tag in sorted(arrays):
            v = arrays[tag]
            out += struct.pack(order + "HHII", tag, 4, len(v), spot.get(tag, v[0]))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("code,pack", [(1, bytes), (8, zlib.compress), (32773, packbits), (5, lzw)])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_strips_and_tiles(order, code, pack, predictor):
    rng = np.random.RandomState(1)
    image = (rng.randint(0, 6, (50, 70)) * 40).astype(np.uint8)
    diff = lambda a: a if predictor == 1 else np.concatenate((a[:, :1], a[:, 1:] - a[:, :-1]), axis=1)
    strips = [pack(diff(image[y : y + 16]).tobytes()) for y in range(0, 50, 16)]
    wide = np.zeros((64, 96), np.uint8)
    wide[:50, :70] = image
    tiles = [pack(diff(wide[y : y + 32, x : x + 32]).tobytes()) for y in (0, 32) for x in (0, 32, 64)]
    base = {256: [70], 257: [50], 258: [8], 259: [code], 277: [1], 317: [predictor]}
    data = file_of(order, [({**base, 278: [16]}, strips, 273, 279), ({**base, 322: [32], 323: [32]}, tiles, 324, 325)])
    pages = tiff.read_pages(data)
    assert len(pages) == 2 and all(p["pixels"] == image.tobytes() for p in pages)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000))
def test_tiff_round_trip(data):
    data = data.ljust(-(-len(data) // 64) * 64, b"\0")
    (page,) = tiff.read_pages(tiff.write_page(data, 64, strip_rows=8))
    assert page["pixels"] == data


@pytest.mark.parametrize("data", [b"", b"II", b"II*\0\x08\0\0\0", b"PK" * 50, b"MM\0*\0\0\0\x08\xff\xff"])
def test_tiff_broken(data):
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(data)) or (_ for _ in ()).throw(tiff.TiffError("no page"))


def test_chi_square_and_search():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3) and ann.chi_square_quantile(0.99, 8) == pytest.approx(20.09, abs=1e-2)
    rng = np.random.RandomState(0)
    v = rng.standard_normal((3000, 16))
    low = v @ ann.directions(16)
    tree, hit = ann.Tree(low), 0
    for q in range(40):
        best = ann.Best(10)
        ann.search(tree, v, np.arange(3000), v[q], low[q], q, best, ann.chi_square_quantile(ann.SURE, ann.DIMS))
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({i for _, i in best.found} & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.97 * 400


def test_line_units():
    import xxhash

    text = "One two three four five.\nshort\nSix  seven, eight nine ten; tail"
    start, end, digests = line_dedup.units(text, 5)
    assert [text[a:b] for a, b in zip(start, end)] == ["One two three four five.\n", "short\nSix  seven, eight nine ten;", "Six  seven, eight nine ten;"]
    assert digests[2] == xxhash.xxh3_128_digest(b"six seven eight nine ten") and len(set(digests)) == 3
    spans = line_dedup.merged(text, [(int(start[0]), int(end[0])), (5, 9)])
    assert spans == [(0, 25)] and line_dedup.cut(text, spans) == text[25:] and line_dedup.merged("a b\nc", [(2, 4)]) == [(2, 3)]
    assert [len(x) for x in line_dedup.units("...", 1)] == [0, 0, 0] and line_dedup.units("", 1)[2] == []


def test_html():
    page = '<html><body><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="ad">Buy this thing now.</div><article><h1>Title &amp; more</h1><p><b>First   para.<br><p>Second para is here, and it has many more words in it.</article><section id="comments"><h2>Comments</h2><p>I think so.</p></section><footer>&copy; someone</footer><script>var p="</p>"</script></body></html>'
    got = html_text.main_texts([page, "", None, "<p", "<<<>>&&&", page[:200]], html_text.model())
    assert got[0] == "Title & more\nFirst para.\nSecond para is here, and it has many more words in it." and got[1] == got[2] == ""


def test_toxicity_learns():
    rng = np.random.RandomState(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    texts, y = [], []
    for i in range(400):
        w = list(rng.choice(words, 30))
        if i % 4 == 0:
            w[rng.randint(30)] = "zorkness"
        texts.append(" ".join(w))
        y.append(i % 4 == 0)
    f = [np.unique(toxicity.features(t)) for t in texts]
    pos, neg = np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS)
    for a, b in zip(f[:300], y[:300]):
        (pos if b else neg)[a] += 1
    ratio = toxicity.log_ratio(pos, neg, sum(y[:300]), 300 - sum(y[:300]))
    keep = np.flatnonzero((pos + neg >= toxicity.MIN_TEXTS) & (np.abs(ratio) >= toxicity.MIN_RATIO))
    place = np.full(1 << toxicity.BITS, -1)
    place[keep] = np.arange(len(keep))
    w, b = toxicity.fit([place[a][place[a] >= 0] for a in f[:300]], np.array(y[:300]), ratio[keep])
    full = np.zeros(1 << toxicity.BITS)
    full[keep] = w
    got = [toxicity.score_text(t, full, b) >= 0.3 for t in texts[300:]]
    assert got == y[300:]
