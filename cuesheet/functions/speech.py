"""Scripts for speech synthesis: cleaned, written as read, cut into pieces with pauses.

Marks in a script: ``<行|hang2>`` a reading, ``<停|0.5>`` a pause, ``<重|词>`` stress.  While
text is rewritten each mark is one private character, so no rule sees into it.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import read_numbers

# Marks, what goes, what is said for a symbol, marks of the two scripts.
MARK = r"<([^<>|]{1,8})\|([^<>]{1,40})>"
PAUSE_TAGS, STRESS_TAGS = ("停", "pause"), ("重", "强调", "emph")
PAUSE_MARK = r"<(?:停|pause)\|([\d.]+)>"
NOTES = ("（）", "()", "【】", "[]", "{}", "〔〕")
EMOJI = "[\U0001f000-\U0001faff☀-➿\U0001f900-\U0001f9ff️‍⭐⭕⏩-⏺]"
LAUGH = r"([哈呵嘿嘻啊呜])\1{3,}"
SYMBOLS = {"&": "和", "×": "乘", "÷": "除以", "±": "正负", "≈": "约", "→": "，", "←": "，", "+": "加", "=": "等于", "@": "艾特", "#": "", "*": "", "~": "，", "～": "，", "|": "，", "_": " ", "^": ""}
SYMBOLS_LATIN = {"&": " and ", "@": " at ", "#": "", "*": "", "~": ", ", "～": ", ", "|": ", ", "_": " ", "^": "", "→": ", ", "←": ", ", "=": " equals ", "×": " times ", "≈": " about "}
FULL_WIDTH = {",": "，", ".": "。", "?": "？", "!": "！", ";": "；", ":": "：", "(": "（", ")": "）"}
HALF_WIDTH = {"，": ",", "。": ".", "？": "?", "！": "!", "；": ";", "：": ":", "（": "(", "）": ")", "、": ",", "‘": "'", "’": "'", "“": "", "”": "", '"': "", "《": "", "》": "", "「": "", "」": ""}
QUOTES = "“”\"‘’《》「」『』"
CJK_LANGS = ("zh", "yue", "ja", "ko")

_MARK, _PAUSE = re.compile(MARK), re.compile(PAUSE_MARK)
_PRIVATE = 0xE000


def is_cjk_lang(lang: str | None) -> bool:
    """Chinese, Cantonese, Japanese, Korean; none told means Chinese."""
    return (lang or "zh").lower().split("-")[0] in CJK_LANGS


def behind_marks(text: str, rewrite) -> str:
    """``rewrite`` of ``text`` with its marks hidden behind a private character each."""
    marks: list[str] = []

    def hide(m: re.Match) -> str:
        marks.append(m.group())
        return chr(_PRIVATE + len(marks) - 1)

    hidden = rewrite(_MARK.sub(hide, text))
    return hidden.translate({_PRIVATE + k: m for k, m in enumerate(marks)})


def _rules(*rules: tuple[str, str]):
    """One function of rewriting rules, applied in order."""
    ready = [(re.compile(p, re.M), to) for p, to in rules]

    def run(text: str) -> str:
        for pattern, to in ready:
            text = pattern.sub(to, text)
        return text

    return run


_links = _rules((r"https?://\S+|www\.\S+", ""), (r"\[([^\[\]]+)\]\([^()]+\)", r"\1"), (r"^\s{0,3}(#{1,6}|>|[-*+]|\d+[.)])\s+", ""), (r"\*\*|__|`", ""))
_notes = _rules(*[(f"{re.escape(o)}[^{re.escape(o + c)}]*{re.escape(c)}", "") for o, c in NOTES], ("「注[^「注」]*」", ""))
_noise = _rules((EMOJI, ""), (LAUGH, r"\1\1\1"))
_wide = _rules(
    *[(f"(?<![A-Za-z0-9]){re.escape(a)}|{re.escape(a)}(?![A-Za-z0-9])", b) for a, b in FULL_WIDTH.items()],
    (f"[{QUOTES}]", ""), ("[，、]{2,}", "，"), ("([。！？；…])[。！？；…，、]+", r"\1"), ("([，：])[，：]+", r"\1"), (r"[ \t]+", " "), ("(?<=[一-鿿，。！？；：、]) (?=[一-鿿])", ""),
)
_spaced = _rules(
    (r"\.{3,}|…+", "…"), (r"\s+([,.!?;:])", r"\1"), (r"([,!?;:])(?=[^\s\d])", r"\1 "), (r"(?<![\d.])\.(?=[A-Za-z])", ". "), ("([,;:])[,;:]+", r"\1"), ("([.!?])[,.;:]+", r"\1"),
    (r"…\s*", "... "), (r"[ \t]+", " "), (r"^[^\S\n]+|[^\S\n]+$", ""),
)
_dots = _rules((r"\.\.\.", "…"), ("……", "…"), ("。。", "。"))


def clean(text: str, notes: bool = True) -> str:
    """Compatibility forms, without links, Markdown, notes in brackets (unless kept), emoji, long laughter."""
    hide_notes = _notes if notes else str
    return behind_marks(unicodedata.normalize("NFKC", text), lambda t: _noise(hide_notes(_links(t))))


def normalize_symbols(text: str) -> str:
    """Symbols as they are read in Chinese."""
    return behind_marks(text, lambda t: t.translate(str.maketrans(SYMBOLS)))


def normalize_punct(text: str) -> str:
    """Full-width marks, but not between ASCII letters or digits; no quotes, no runs."""
    return _wide(_dots(text)).strip()


def normalize_latin(text: str) -> str:
    """Half-width marks, properly spaced; numbers stay digits."""
    return behind_marks(text, lambda t: _spaced(t.translate(str.maketrans(SYMBOLS_LATIN)).translate(str.maketrans(HALF_WIDTH)))).strip()


def normalize(text: str, notes: bool = True, lang: str | None = "zh") -> str:
    """A script as it is to be spoken; marks stay."""
    text = clean(text, notes)
    if not is_cjk_lang(lang):
        return normalize_latin(text)
    return normalize_punct(normalize_symbols(behind_marks(text, read_numbers)))


def to_engine(text: str, readings: bool = True) -> tuple[str, list[str]]:
    """What the engine gets, and the stressed words; with ``readings`` a Pinyin mark stays, in capitals."""
    stressed: list[str] = []

    def said(m: re.Match) -> str:
        tag, value = m.groups()
        if tag in STRESS_TAGS:
            stressed.append(value)
            return value
        if tag in PAUSE_TAGS:
            return ""
        if readings and re.fullmatch(r"[a-zA-ZüÜv]+[1-5]", value.strip()):
            return f"<{tag}|{value.strip().upper().replace('Ü', 'V')}>"
        return tag

    return _MARK.sub(said, text).strip(), stressed


def plain_length(text: str) -> int:
    """Characters to be spoken: no marks, spaces or clause marks."""
    return len(re.sub(r"[\s，。！？：；、…—]", "", _MARK.sub(lambda m: m[2] if m[1] == "重" else m[1], text)))


@dataclass(frozen=True)
class Script:
    """How a script ends sentences and clauses, and which pieces are long or short."""

    ends: str
    clauses: str
    sentence: str
    clause: str
    stop: str
    comma: str
    joiner: str
    long: float
    size: object
    short: object

    def sentences(self, part: str) -> list[str]:
        return [x.strip() for x in re.findall(self.sentence, part) if x.strip()]

    def pieces(self, sentence: str, most: float) -> list[str]:
        """A long sentence at its clauses, as full as ``most`` allows."""
        if self.size(sentence) <= most:
            return [sentence]
        out = [""]
        for c in re.findall(self.clause, sentence):
            if out[-1] and self.size(out[-1] + c) > most:
                out.append("")
            out[-1] += c
        return [x.strip() if self.joiner == " " else x for x in out if x.strip()]

    def closed(self, piece: str, last: bool) -> str:
        return piece if piece[-1] in self.ends + self.clauses else piece + (self.stop if last else self.comma)


CJK_SCRIPT = Script("。！？；…", "，、：—", "[^。！？；…]+[。！？；…]*", "[^，、：—]+[，、：—]?", "。", "，", "", 1.0, plain_length, plain_length)
LATIN_SCRIPT = Script(".!?;", ",:;—", r"(?:(?![.!?;]\s+\S).)+(?:[.!?;](?=\s+\S))?", r"[^,:;—]+[,:;—]?\s*", ".", ",", " ", 2.5, len, lambda t: len(t.split()))


def split_segments(text: str, lang: str | None = "zh", most: int = 60, least: int = 4, comma: float = 0.25, sentence: float = 0.45, paragraph: float = 0.8) -> list[dict]:
    """Pieces (text, tts_text, pause_after, emphasis, paragraph_end) of a script.

    Sentences are pieces, long ones are cut at clauses, short ones join the one before in
    their paragraph; a pause that is marked is kept and, in CJK, nothing joins across it.
    """
    cjk = is_cjk_lang(lang)
    script = CJK_SCRIPT if cjk else LATIN_SCRIPT
    short = least if cjk else 3
    paragraphs = [p.strip() for p in text.split("\n") if p.strip()]
    out: list[dict] = []
    for number, para in enumerate(paragraphs):
        told: list[list] = []  # [sentence, marked pause]
        for k, part in enumerate(_PAUSE.split(para)):
            if k % 2 == 0:
                told += [[x, None] for x in script.sentences(part)]
            elif told:
                told[-1] = [told[-1][0] if told[-1][0][-1] in script.ends + script.clauses else told[-1][0] + script.comma, float(part)]
        for spoken, marked in told:
            pieces = script.pieces(spoken, int(most * script.long))
            for k, piece in enumerate(pieces):
                last = k == len(pieces) - 1
                pause = comma if not last else sentence if marked is None else marked
                out.append({"text": script.closed(piece, last), "pause_after": pause, "paragraph_end": False, "_held": cjk and last and marked is not None})
        if out:
            out[-1]["paragraph_end"] = True
            if number < len(paragraphs) - 1:
                out[-1]["pause_after"] = max(out[-1]["pause_after"], paragraph)
    joined: list[dict] = []
    for piece in out:
        before = joined[-1] if joined else None
        if before and script.short(piece["text"]) < short and not before["paragraph_end"] and not before["_held"]:
            glue = script.joiner or ("" if before["text"][-1] in script.ends + script.clauses else script.comma)
            joined[-1] = piece | {"text": before["text"] + glue + piece["text"]}
        else:
            joined.append(piece)
    if cjk and len(joined) > 1 and plain_length(joined[0]["text"]) < least and not joined[0]["_held"]:
        joined[:2] = [joined[1] | {"text": joined[0]["text"] + joined[1]["text"]}]
    for piece in joined:
        del piece["_held"]
        piece["tts_text"], piece["emphasis"] = to_engine(piece["text"])
    return joined


SEGMENT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("tts_text", T.StringType()), T.StructField("pause_after", T.DoubleType()), T.StructField("emphasis", T.ArrayType(T.StringType())), T.StructField("paragraph_end", T.BooleanType())]
)


def _mapped(f, kind, *columns: Column) -> Column:
    """``f`` of the columns' values, null where the first is null."""
    run = F.pandas_udf(lambda *s: pd.Series([None if v[0] is None else f(*v) for v in zip(*s)], dtype=object), kind)
    return run(*columns)


def spoken(text: Column, lang: Column, notes: bool = True) -> Column:
    """``normalize`` of a column; a null text stays null."""
    return _mapped(lambda t, la: normalize(t, notes, la), T.StringType(), text, lang)


def segments(text: Column, lang: Column) -> Column:
    """``split_segments`` of a normalised column, as an array."""
    return _mapped(split_segments, T.ArrayType(SEGMENT), text, lang)


def prepare(text: Column, lang: Column, notes: bool = True) -> Column:
    """text and segments of a raw column, in one pass through Python."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT))])

    def run(t: pd.Series, la: pd.Series) -> pd.DataFrame:
        done = [None if x is None else normalize(x, notes, y) for x, y in zip(t, la)]
        return pd.DataFrame({"text": pd.Series(done, dtype=object), "segments": pd.Series([None if x is None else split_segments(x, y) for x, y in zip(done, la)], dtype=object)})

    return F.pandas_udf(run, kind)(text, lang)
