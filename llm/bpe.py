"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens.  It
starts as one state with a loop for each base symbol.  The gadget of a merge
(a, b) -> c sends every a-arc to a copy of its target without the b-arc, and adds,
wherever an a-arc leaves, a c-arc to where b would have led.  A word has exactly one
path whose arc labels spell it, and that path is its BPE encoding.  All arcs of a
token share one target, so a state is what may follow a token; copies keep a link to
what they copy, and arcs are worked out when first used and stay in the table.

Encoding walks a word's prefixes by table look-ups: the last token of a prefix is the
one whose arc leaves the state that the shorter prefix reached.  Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bound_batches, give_back, table, with_field

NEVER = 1 << 60
#: Stands for the end of a word in the scan; no byte's symbol.
END = "\n"
#: Words and runs whose encoding a worker keeps while a task runs; beyond it the half that was used last stays.
CACHE_WORDS = 600_000
#: Arcs that the table of a worker keeps while a task runs; beyond it the table starts anew.
TABLE_ARCS = 300_000
#: What the tokenizer's patterns call white space (Unicode White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Letters and numbers of Unicode versions after the one that the tokenizer's patterns know; there they are none.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-10FFFF"
)
LATER = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in LATER.split())
#: Capitals that the tokenizer lower-cases and Python's Unicode version may not know.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


class Automaton:
    """Token automaton of a merge list over token strings."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.labels = {i: t for t, i in vocab.items()}
        self.vocab = vocab
        self.parent, self.born, self.cut = [0], [-1], [{}]
        self.alone = [False]
        n = max(vocab.values()) + 1
        self.target = [0] * n
        self.made = [-1] * n
        self.left = [-1] * n
        self.known: dict[int, bool] = {}
        composed = {a + b for a, b in merges}
        self.usable = {t: i for t, i in vocab.items() if t not in composed}
        sys.setrecursionlimit(max(10_000, sys.getrecursionlimit()))
        for at, (a, b) in enumerate(merges):
            self._gadget(at, vocab[a], vocab[b], vocab[a + b], a + b)
        cut = len(suffix)
        finder = ahocorasick.Automaton()
        for t, i in self.usable.items():
            shown = t[: len(t) - cut] + END if t.endswith(suffix) else t
            finder.add_word(shown, (len(shown), i))
        finder.make_automaton()
        self.scan = finder.iter

    def _gadget(self, at: int, a: int, b: int, c: int, text: str) -> None:
        q = self.target[a]
        self.made[c] = NEVER
        if not self._arc(q, b, at - 1):
            return  # no word ever holds a and b side by side at this point
        if self.made[c] != NEVER:
            return
        r = self.target[b]
        self.alone[r] = False
        if q and self.alone[q] and a != b:
            self.cut[q][b] = at
        else:
            self.parent.append(q)
            self.born.append(at)
            self.cut.append({b: at})
            self.alone.append(True)
            self.target[a] = len(self.parent) - 1
        self.target[c] = r
        self.made[c], self.left[c] = at, a
        self.usable[text] = c

    def _arc(self, state: int, token: int, at: int) -> bool:
        """Whether ``token`` leaves ``state`` once the gadgets up to ``at`` are in."""
        while True:
            made = self.made[token]
            if made > at or self.cut[state].get(token, NEVER) <= at:
                return False
            if state == 0:
                return True
            if made < self.born[state]:
                state, at = self.parent[state], self.born[state]
            else:
                token, at = self.left[token], made

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` in an encoding."""
        key = self.target[before] << 20 | token
        out = self.known.get(key)
        if out is None:
            if len(self.known) >= TABLE_ARCS:
                self.known.clear()
            out = self.known[key] = self._arc(self.target[before], token, NEVER - 1)
        return out

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word, given as one character for each byte.

        ``scan`` gives the tokens that end at each place.  One path only spells a
        prefix, so the first token whose arc leaves the state of the prefix before
        it is the prefix's last; the word's path is then read backwards.
        """
        n = len(word)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        target, known = self.target, self.known
        for end, (size, token) in self.scan(word + END):
            begin = end + 1 - size
            if end != n:
                end += 1
                if end == n:
                    continue  # the last symbol of a word is another one than inside
            if last[end] >= 0:
                continue
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                fits = known.get(target[before] << 20 | token)
                if fits is None:
                    fits = self.follows(before, token)
                if not fits:
                    continue
            last[end], start[end] = token, begin
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """The word-level BPE tokenizer of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.bytes = byte_symbols()
        white = f"[{WHITE}]"
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        split = split.replace("\\s", WHITE)
        self.split = regex.compile(split, regex.V1).findall
        self.later = regex.compile(f"[{LATER}]").search
        self.split_later = regex.compile(split.replace("\\p{L}", f"[\\p{{L}}--[{LATER}]]").replace("\\p{N}", f"[\\p{{N}}--[{LATER}]]"), regex.V1).findall
        self.capital = regex.compile(f"[{''.join(map(chr, CAPITALS))}]").search
        self.white = regex.compile(f"{white}+")
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split
        self.control = regex.compile("[\x1c-\x1f]").search  # str.split takes these for white space
        #: Of words and of runs, as a run of one word is that word; ``before`` is the older half.
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.before: dict[str, tuple[int, str, str]] = {}

    def chunks(self, text: str) -> list[str]:
        """Normalised runs without white space of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.capital(text):
                text = text.translate(CAPITALS)
        text = text.lower()
        if self.control(text):
            return [c for c in self.white.split(text) if c]
        return text.split()

    def find(self, chunk: str) -> list[str]:
        """Words of a run without white space."""
        return self.split(chunk) if chunk.isascii() or not self.later(chunk) else self.split_later(chunk)

    def keep(self, key: str, value: tuple[int, str, str]) -> tuple[int, str, str]:
        """Store the encoding of a word or run."""
        if len(self.cache) >= CACHE_WORDS // 2:
            self.before = self.cache.copy()
            self.cache.clear()
        self.cache[key] = value
        return value

    def forget(self) -> None:
        """Give back what was kept while a task ran: the worker lives on, beside those of other stages."""
        self.cache.clear()
        self.before.clear()
        self.automaton.known.clear()

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of tokens, ids and labels of a run without white space that ``cache`` doesn't hold."""
        got = self.before.get(chunk)
        if got is None:
            found = self.find(chunk)
            if len(found) == 1:
                return self.word(found[0])
            words = [self.cache.get(w) or self.word(w) for w in found]
            got = (sum([w[0] for w in words]), " ".join([w[1] for w in words]), " ".join([w[2] for w in words]))
        return self.keep(chunk, got)

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of tokens, ids and labels of one word that ``cache`` doesn't hold."""
        got = self.before.get(word)
        if got is None:
            ids = self.automaton.encode(word if word.isalnum() and word.isascii() else "".join([self.bytes[b] for b in word.encode("utf-8")]))
            got = (len(ids), " ".join(map(str, ids)), " ".join([self.labels[i] for i in ids]))
        return self.keep(word, got)

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """Of each run and special token, in order: number of tokens, ids, labels."""
        out = []
        chunk, cache = self.chunk, self.cache
        for part in self.cut(text) if "<|" in text else (text,):
            if part in self.special:
                out.append((1, str(self.special[part]), part))
            elif part:
                out += [cache.get(c) or chunk(c) for c in self.chunks(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The arc labels joined by one space, as a tokenizer without decoder has it."""
        return " ".join(self.labels[i] for i in ids if i in self.labels)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One compiled tokenizer for each worker process."""
    return Tokenizer(path)


def _encode(path: str, lists: bool):
    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = tok.pieces(text or "")
                joined = " ".join([p[1] for p in found])
                n.append(sum([p[0] for p in found]))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(" ".join([p[2] for p in found]).encode("utf-8")).hexdigest())
                if lists:
                    ids.append([int(i) for i in joined.split()])
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if lists:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        tok.forget()
        give_back()

    return run


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, with ``with_ids`` also ids.

    ``vocabulary`` is the path of the tokenizer file on every machine.  Null and empty
    texts have no token; repeated rows and null ids pass through; an empty table gives
    an empty result; other columns are not read.  No shuffle.
    """
    bound_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_encode(vocabulary, with_ids), schema)


def decode_ids(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with decoded: the labels of the ids joined by one space; null for null."""

    def run(batches):
        tok = tokenizer(vocabulary)
        for batch in batches:
            out = [None if x is None else tok.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield batch.append_column("decoded", pa.array(out, pa.string()))

    kept = df.drop("decoded")
    return kept.mapInArrow(run, with_field(kept.schema, "decoded", T.StringType()))


def word_vocabulary() -> str:
    """Path of the public word BPE file."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return encode_documents(table(spark, sf_dir, "documents"), word_vocabulary())
