"""Readers: a table (doc_id, text) to lines (doc_id, line_no, start, end, tokens, translation).

Line formats are split and parsed by built-in expressions and tokenized by one Arrow UDF;
word formats give their chunks by a regular expression, and one UDF spreads a chunk's time
over the units in it.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import split_units, strip_tags, text_format, tokenize, unit_weight
from ..functions.time import parse_ts
from ..operators.timing import shift
from ..schema import TOKENS, from_json
from .writers import krc_open

CHUNKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))
COLUMNS = ["doc_id", "line_no", "start", "end", "tokens", "translation"]
STAMP = r"(?:\d+:)?\d+:\d+[.,]\d+"


def spread_chunks(chunks) -> list[dict]:
    """Tokens of timed chunks; units in one chunk share its time by weight."""
    out: list[dict] = []
    for c in chunks:
        text = c["text"] or ""
        if out and text.startswith(" "):
            out[-1]["space_after"] = True
        units = split_units(text)
        if not units:
            continue
        weights = [unit_weight(u) for u, _ in units]
        at, start, end = 0.0, c["start"], c["end"]
        span = (max(end, start) - start) / sum(weights)
        for (u, space), w in zip(units, weights):
            one = len(units) == 1
            out.append({"text": u, "start": start if one else start + at * span, "end": end if one else start + (at + w) * span, "confidence": 1.0, "space_after": space})
            at += w
        if text.endswith(" "):
            out[-1]["space_after"] = True
    if out:
        out[-1]["space_after"] = False
    return out


spread = F.pandas_udf(lambda s: s.map(lambda c: None if c is None else spread_chunks(c)), TOKENS)


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "^﻿", "")


def _number(df: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return df.where(F.size("tokens") > 0).withColumn("line_no", n).select(*COLUMNS)


def _rows(df: DataFrame, splitter: str = "\n") -> DataFrame:
    return df.select("doc_id", F.posexplode(F.split(_clean(F.col("text")), splitter)).alias("pos", "row"))


def _inline(first: str | None, start: float, end: float) -> list | None:
    """Chunks of a cue's first row by its inline stamps."""
    if first is None:
        return None
    parts = re.split(r"<((?:\d+:)?\d+:\d+\.\d+)>", first)
    bare = [re.sub(r"<[^>]+>|\{[^}]*\}", "", p) for p in parts[::2]]
    at = [start] + [sum(float(x) * 60**k for k, x in enumerate(reversed(s.split(":")))) for s in parts[1::2]]
    return [{"text": t, "start": a, "end": b} for t, a, b in zip(bare, at, [*at[1:], end])]


inline_chunks = F.pandas_udf(lambda f, a, b: pd.Series([_inline(*x) for x in zip(f, a, b)]), CHUNKS)


def read_srt(df: DataFrame) -> DataFrame:
    """SRT and WebVTT: the first row of a cue is text, more rows are its translation."""
    blocks = _rows(df, r"\n[ \t]*\n")
    rows = F.filter(F.split("row", "\n"), lambda r: F.trim(r) != "")
    arrow = f"({STAMP})\\s*-->\\s*({STAMP})"
    b = blocks.withColumn("rows", rows).withColumn("at", F.array_position(F.transform("rows", lambda r: r.rlike(arrow)), True))
    b = b.where((F.col("at") > 0) & (F.size("rows") > F.col("at")))
    head = F.element_at("rows", F.col("at").cast("int"))
    body = F.slice("rows", F.col("at").cast("int") + 1, F.size("rows"))
    b = b.select("doc_id", "pos", parse_ts(F.regexp_extract(head, arrow, 1)).alias("start"), parse_ts(F.regexp_extract(head, arrow, 2)).alias("end"), body.alias("body"))
    first = F.element_at("body", 1)
    timed = first.rlike(r"<(?:\d+:)?\d+:\d+\.\d+>")
    b = b.withColumn("words", spread(inline_chunks(F.when(timed, first), "start", "end"))).withColumn("plain", tokenize(strip_tags(first)))
    more = F.when(F.size("body") > 1, strip_tags(F.array_join(F.slice("body", F.lit(2), F.size("body")), " ")))
    return _number(b.select("doc_id", "pos", "start", "end", F.when(timed, F.col("words")).otherwise(F.col("plain")).alias("tokens"), more.alias("translation")))


def read_sbv(df: DataFrame) -> DataFrame:
    blocks = _rows(df, r"\n[ \t]*\n").withColumn("rows", F.split(F.trim("row"), "\n"))
    b = blocks.where((F.size("rows") > 1) & F.col("rows")[0].contains(","))
    times = F.split(b["rows"][0], ",", 2)
    more = F.when(F.size("rows") > 2, F.array_join(F.slice("rows", F.lit(3), F.size("rows")), " "))
    return _number(b.select("doc_id", "pos", parse_ts(times[0]).alias("start"), parse_ts(times[1]).alias("end"), tokenize(F.col("rows")[1]).alias("tokens"), more.alias("translation")))


def read_txt(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return _number(_rows(df).select("doc_id", "pos", none.alias("start"), none.alias("end"), tokenize(F.trim("row")).alias("tokens"), F.lit(None).cast("string").alias("translation")))


def _chunked(df: DataFrame, words: str, text: int, start: int, length: int, relative: bool) -> DataFrame:
    """Lines ``[start,length]...`` whose words a regular expression finds."""
    r = _rows(df).withColumn("row", F.trim("row")).where(F.col("row").rlike(r"^\[\d+,\d+\]"))
    s = F.regexp_extract("row", r"^\[(\d+),(\d+)\](.*)$", 1).cast("double") / 1000
    d = F.regexp_extract("row", r"^\[(\d+),(\d+)\](.*)$", 2).cast("double") / 1000
    r = r.withColumn("start", s).withColumn("end", s + d).withColumn("row", F.regexp_extract("row", r"^\[(\d+),(\d+)\](.*)$", 3))
    get = lambda k: F.regexp_extract_all("row", F.lit(words), k)
    zipped = F.arrays_zip(get(text).alias("t"), get(start).alias("a"), get(length).alias("d"))
    base = F.col("start") if relative else F.lit(0.0)
    chunks = F.transform(zipped, lambda z: F.struct(z["t"].alias("text"), (base + z["a"].cast("double") / 1000).alias("start"), (base + (z["a"].cast("double") + z["d"].cast("double")) / 1000).alias("end")))
    return r.withColumn("tokens", spread(chunks.cast(CHUNKS))).withColumn("translation", F.lit(None).cast("string"))


def read_qrc(df: DataFrame) -> DataFrame:
    wrapped = F.regexp_extract("text", r'(?s)LyricContent="(.*?)"\s*/>', 1)
    plain = wrapped
    for a, b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#10;", "\n"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return _number(_chunked(df.withColumn("text", F.when(wrapped != "", plain).otherwise(F.col("text"))), r"(.*?)\((\d+),(\d+)\)", 1, 2, 3, False))


def read_yrc(df: DataFrame) -> DataFrame:
    return _number(_chunked(df, r"\((\d+),(\d+),-?\d+\)([^(]*)", 3, 1, 2, False))


def read_krc(df: DataFrame) -> DataFrame:
    """Plain KRC with its translations."""
    lines = _number(_chunked(df, r"<(-?\d+),(\d+),\d+>([^<]*)", 3, 1, 2, True)).drop("translation")
    form = "struct<content: array<struct<type: int, lyricContent: array<array<string>>>>>"
    code = F.regexp_extract("text", r"(?m)^\[language:([^\]]*)\]", 1)
    content = F.from_json(F.decode(F.try_to_binary(code, F.lit("base64")), "UTF-8"), form)["content"]
    tr = F.element_at(F.filter(content, lambda c: c["type"] == 1), -1)["lyricContent"]
    held = df.select("doc_id", F.when(F.size(F.filter(content, lambda c: c["type"] == 1)) > 0, tr).alias("tr"))
    joined = lines.join(held, "doc_id", "left")
    return joined.withColumn("translation", F.nullif(F.get(F.get("tr", F.col("line_no")), F.lit(0)), F.lit(""))).select(*COLUMNS)


def read_krc_encrypted(df: DataFrame) -> DataFrame:
    unseal = F.pandas_udf(lambda s: s.map(lambda d: krc_open(bytes(d))), T.StringType())
    return read_krc(df.select("doc_id", unseal("data").alias("text")))


LRC_STAMP = r"\[(\d+:\d+(?:[.:]\d+)?)\]"


def _word_chunks(row: str | None, start: float) -> list | None:
    """Chunks of a row with stamps between its words; an empty last one gives the end."""
    if row is None:
        return None
    parts = re.split(r"[<\[](\d+:\d+(?:[.:]\d+)?)[>\]]", row)
    seconds = lambda s: (lambda m, x: int(m) * 60 + float(x.replace(":", ".")))(*s.split(":", 1))
    pairs = [(parts[0], start)] if parts[0].strip() else []
    pairs += [(t, seconds(s)) for s, t in zip(parts[1::2], parts[2::2])]
    end = None
    if pairs and not pairs[-1][0].strip():
        end = pairs.pop()[1]
    ends = [b for _, b in pairs[1:]] + [end if end is not None else (pairs[-1][1] + 0.5 if pairs else start)]
    return [{"text": t, "start": a, "end": e} for (t, a), e in zip(pairs, ends)]


word_chunks = F.pandas_udf(lambda r, a: pd.Series([_word_chunks(*x) for x in zip(r, a)]), CHUNKS)


def read_lrc(df: DataFrame, translated: bool = True) -> DataFrame:
    """Plain, compressed, enhanced and bracket-word LRC.

    A stamp that repeats makes its text the translation, or, where the texts are known to
    have none (``translated`` false), a line of its own; an empty line closes the one
    before; else a line lasts to the next, 8 s at most, and the last 5 s.  A positive
    offset makes everything earlier.
    """
    raw = _rows(df).withColumn("row", F.trim("row"))
    offset = raw.groupBy("doc_id").agg(F.max(F.nullif(F.regexp_extract("row", r"(?i)^\[offset:\s*(-?\d+)\]$", 1), F.lit("")).cast("double") / 1000).alias("offset"))
    lead = F.regexp_extract("row", rf"^((?:{LRC_STAMP})+)", 1)
    r = raw.withColumn("lead", lead).where("lead <> ''").withColumn("rest", F.substr("row", F.length("lead") + 1))
    stamps = F.regexp_extract_all("lead", F.lit(LRC_STAMP), 1)
    by_word = (F.size(stamps) == 1) & F.col("rest").rlike(LRC_STAMP)
    r = r.select("doc_id", "pos", "rest", by_word.alias("by_word"), F.posexplode(stamps).alias("k", "stamp")).withColumn("start", parse_ts(F.col("stamp")))
    worded = F.col("by_word") | F.col("rest").rlike(r"<\d+:\d+(?:[.:]\d+)?>")
    r = r.withColumn("words", word_chunks(F.when(worded, F.col("rest")), "start"))
    r = r.withColumn("tokens", F.when(worded, spread("words")).otherwise(tokenize(F.trim("rest")))).withColumn("last", F.when(worded, F.element_at("words", -1)["end"]))
    w = Window.partitionBy("doc_id").orderBy("start", "pos", "k")
    filled = F.size("tokens") > 0
    r = r.withColumn("n", F.row_number().over(w)).withColumn("filled", filled)
    again = F.col("filled") & (F.abs(F.col("start") - F.lag(F.when(F.col("filled"), F.col("start")), 1).over(w)) < 1e-3)
    r = r.withColumn("again", F.coalesce(again, F.lit(False)) if translated else F.lit(False))
    said = F.when(F.lead("again").over(w), F.trim(F.lead("rest").over(w)))
    nxt = F.lead("start").over(w)
    closed = F.when(F.lead("filled").over(w) == F.lit(False), nxt)
    r = r.withColumn("translation", said).withColumn("closed", F.coalesce(closed, F.when(F.col("translation").isNotNull() & (F.lead("filled", 2).over(w) == F.lit(False)), F.lead("start", 2).over(w))))
    lines = r.where(F.col("filled") & ~F.col("again")).withColumn("pos", F.col("n"))
    nxt = F.lead("start").over(Window.partitionBy("doc_id").orderBy("n"))
    lines = lines.withColumn("end", F.coalesce("last", "closed", F.when(nxt.isNotNull(), F.least(nxt, F.col("start") + 8.0)), F.col("start") + 5.0))
    lines = lines.join(offset, "doc_id", "left").withColumn("off", F.coalesce("offset", F.lit(0.0)))
    moved = lambda t: F.greatest(F.lit(0.0), t - F.col("off"))
    tokens = F.transform("tokens", lambda t: F.struct(t["text"].alias("text"), F.when(t["start"].isNotNull(), moved(t["start"])).alias("start"), F.when(t["end"].isNotNull(), moved(t["end"])).alias("end"), t["confidence"].alias("confidence"), t["space_after"].alias("space_after")))
    return _number(lines.withColumn("tokens", tokens).withColumn("start", moved(F.col("start"))).withColumn("end", moved(F.col("end"))))


LINES_OF_TEXT = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("chunks", CHUNKS), T.StructField("translation", T.StringType())]))


def _clock(s: str) -> float:
    return sum(float(x) * 60**k for k, x in enumerate(reversed(s.rstrip("s").split(":"))))


def _ttml(text: str) -> list:
    out = []
    for p in ET.fromstring(text.encode()).iter():
        if p.tag.rpartition("}")[2] != "p" or "begin" not in p.attrib:
            continue
        start, end = _clock(p.attrib["begin"]), _clock(p.attrib["end"])
        chunks, tr = [], None
        for s in p:
            role = next((v for k, v in s.attrib.items() if k.endswith("role")), "")
            if role == "x-translation":
                tr = "".join(s.itertext())
            elif "begin" in s.attrib:
                chunks.append({"text": "".join(s.itertext()) + (" " if (s.tail or "").startswith(" ") else ""), "start": _clock(s.attrib["begin"]), "end": _clock(s.attrib["end"])})
        if not chunks and (p.text or "").strip():
            chunks = [{"text": p.text.strip(), "start": start, "end": end}]
        out.append({"start": start, "end": end, "chunks": chunks, "translation": tr})
    return out


def _ass(text: str) -> list:
    out, names, shown = [], [], None
    for row in text.replace("\r\n", "\n").split("\n"):
        if row.startswith("Format:") and "Text" in row:
            names = [x.strip().lower() for x in row[7:].split(",")]
        if not row.startswith("Dialogue:") or not names:
            continue
        e = dict(zip(names, row[9:].split(",", len(names) - 1)))
        start, end, body = _clock(e["start"].strip()), _clock(e["end"]), e["text"]
        bare = re.sub(r"\{[^}]*\}", "", body).replace("\\N", " ")
        if "trans" in e["style"].lower() and out and out[-1]["translation"] is None and abs(shown - start) < 0.05:
            out[-1]["translation"] = bare
            continue
        chunks, at = [], start
        parts = re.split(r"\{[^}]*?\\k[fo]?(\d+)[^}]*\}", body)
        for cs, piece in zip(parts[1::2], parts[2::2]):
            chunks.append({"text": re.sub(r"\{[^}]*\}", "", piece), "start": at, "end": at + int(cs) / 100})
            at += int(cs) / 100
        shown = start
        said = [c for c in chunks if c["text"]] or [{"text": bare, "start": start, "end": end}]
        out.append({"start": said[0]["start"], "end": end, "chunks": said, "translation": None})
    return out


def _parsed(df: DataFrame, parse) -> DataFrame:
    """By a parser of whole documents, for formats with mixed content."""
    run = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else parse(t)), LINES_OF_TEXT)
    lines = df.select("doc_id", F.posexplode(run("text")).alias("pos", "x"))
    return _number(lines.select("doc_id", "pos", "x.start", "x.end", spread("x.chunks").alias("tokens"), "x.translation"))


def read_ttml(df: DataFrame) -> DataFrame:
    return _parsed(df, _ttml)


def read_ass(df: DataFrame) -> DataFrame:
    return _parsed(df, _ass)


def read_json(df: DataFrame) -> DataFrame:
    """Lines of the lossless form; a text that is no JSON gives none."""
    docs = from_json(df, "text")
    lines = docs.select("doc_id", F.posexplode("lines").alias("line_no", "l"))
    return _number(lines.select("doc_id", F.col("line_no").alias("pos"), "l.start", "l.end", "l.tokens", "l.translation"))


READERS = {"json": read_json, "srt": read_srt, "vtt": read_srt, "sbv": read_sbv, "txt": read_txt, "lrc": read_lrc, "lrc-enhanced": read_lrc, "lrc-word": read_lrc, "vtt-karaoke": read_srt, "qrc": read_qrc, "yrc": read_yrc, "krc": read_krc, "ass": read_ass, "ttml": read_ttml}
#: File extensions and their formats.
EXTENSIONS = {"srt": "srt", "vtt": "vtt", "ass": "ass", "ssa": "ass", "lrc": "lrc", "qrc": "qrc", "krc": "krc", "yrc": "yrc", "ttml": "ttml", "xml": "ttml", "sbv": "sbv", "txt": "txt", "json": "json"}


def guess_format(path: Column) -> Column:
    """Format of a path's extension; null for others."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def read(df: DataFrame, fmt: str | None = None) -> DataFrame:
    """Lines of (doc_id, text); without ``fmt`` each text's format is told from its look."""
    if fmt:
        if fmt not in READERS:
            raise ValueError(f"no reader for {fmt!r}; one of {', '.join(READERS)}")
        return READERS[fmt](df)
    told = df.withColumn("_fmt", text_format(F.col("text")))
    out = None
    for name in dict.fromkeys(EXTENSIONS.values()):
        reader = READERS.get(name)
        if reader is None:
            continue
        part = reader(told.where(F.col("_fmt") == name).select("doc_id", "text"))
        out = part if out is None else out.unionByName(part)
    return out


def read_files(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Lines of the files at ``path``, which is read by Spark; doc_id is the file's path."""
    files = spark.read.format("binaryFile").load(path)
    sealed = F.pandas_udf(lambda s: s.map(lambda d: krc_open(bytes(d)) if d[:4] == b"krc1" else bytes(d).decode("utf-8-sig", "replace")), T.StringType())
    return read(files.select(F.col("path").alias("doc_id"), sealed("content").alias("text")), fmt)
