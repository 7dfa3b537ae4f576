"""Writers: lines (doc_id, line_no, start, end, tokens, translation) to one text a document.

A writer is a column expression for a line; a document is its lines joined in order.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from base64 import b64encode
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.style import KARAOKE, StyleConfig, ass_head, make_style, syllable_tags
from ..functions.text import is_cjk
from ..functions.time import millis, ts_ass, ts_lrc, ts_sbv, ts_srt, ts_vtt
from ..operators.layout import LAYOUTS, Layout

TOOL = "cuesheet"


def shown(tokens: Column, each) -> Column:
    """``each(token, shown text)`` of every token joined, spaces as the tokens have them."""
    n = F.size(tokens)
    text = lambda t, i: F.concat(t["text"], F.when(t["space_after"] & (i < n - 1), " ").otherwise(""))
    return F.array_join(F.transform(tokens, lambda t, i: each(t, text(t, i))), "")


def line_text(tokens: Column) -> Column:
    return shown(tokens, lambda t, s: s)


def _body() -> Column:
    return F.concat_ws("\n", line_text(F.col("tokens")), F.nullif(F.col("translation"), F.lit("")))


def _document(lines: DataFrame, row: Column, joiner: str, head: str = "", tail: str = "") -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("line_no", row.alias("row"))))
    text = F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["row"]), joiner), F.lit(tail))
    return lines.groupBy("doc_id").agg(text.alias("text"))


def _cues(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.size("tokens") > 0))


def _timed(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("start").isNotNull() & (F.size("tokens") > 0))


def _by_doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def write_srt(lines: DataFrame) -> DataFrame:
    cues = _cues(lines).withColumn("n", F.row_number().over(_by_doc()))
    row = F.concat(F.col("n").cast("string"), F.lit("\n"), ts_srt(F.col("start")), F.lit(" --> "), ts_srt(F.col("end")), F.lit("\n"), _body(), F.lit("\n"))
    return _document(cues, row, "\n")


def write_vtt(lines: DataFrame) -> DataFrame:
    row = F.concat(ts_vtt(F.col("start")), F.lit(" --> "), ts_vtt(F.col("end")), F.lit("\n"), _body(), F.lit("\n"))
    return _document(_cues(lines), row, "\n", "WEBVTT\n\n")


def write_vtt_karaoke(lines: DataFrame, past: str = "#FFD700", future: str = "#FFFFFF") -> DataFrame:
    n = F.size("tokens")
    parts = F.transform("tokens", lambda t, i: F.concat(F.when((i > 0) & t["start"].isNotNull(), F.concat(F.lit("<"), ts_vtt(t["start"]), F.lit(">"))).otherwise(""), F.lit("<c>"), t["text"], F.when(t["space_after"] & (i < n - 1), " ").otherwise(""), F.lit("</c>")))
    body = F.concat_ws("\n", F.array_join(parts, ""), F.nullif(F.col("translation"), F.lit("")))
    row = F.concat(ts_vtt(F.col("start")), F.lit(" --> "), ts_vtt(F.col("end")), F.lit("\n"), body, F.lit("\n"))
    return _document(_cues(lines), row, "\n", f"WEBVTT\n\nSTYLE\n::cue(:past) {{ color: {past}; }}\n::cue(:future) {{ color: {future}; }}\n\n")


def write_srt_karaoke(lines: DataFrame, color: str = "#FFD700") -> DataFrame:
    """A cue for each token, what was sung so far in colour."""
    t = _cues(lines).select("doc_id", "line_no", "end", "tokens", "translation", F.posexplode("tokens").alias("tok_no", "t"))
    until = F.coalesce(F.get("tokens", F.col("tok_no") + 1)["start"], F.when(F.col("tok_no") + 1 == F.size("tokens"), F.col("end")))
    text = F.transform("tokens", lambda x, i: F.concat(x["text"], F.when(x["space_after"] & (i < F.size("tokens") - 1), " ").otherwise("")))
    t = t.withColumn("until", until).withColumn("parts", text).where(F.col("t.start").isNotNull() & (F.col("until") > F.col("t.start")))
    sung = F.array_join(F.slice("parts", F.lit(1), F.col("tok_no") + 1), "")
    rest = F.array_join(F.slice("parts", F.col("tok_no") + 2, F.size("parts")), "")
    body = F.concat_ws("\n", F.concat(F.lit(f'<font color="{color}">'), sung, F.lit("</font>"), rest), F.nullif(F.col("translation"), F.lit("")))
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "tok_no")))
    row = F.concat(F.col("n").cast("string"), F.lit("\n"), ts_srt(F.col("t.start")), F.lit(" --> "), ts_srt(F.col("until")), F.lit("\n"), body, F.lit("\n"))
    return _document(t.select("doc_id", F.col("n").alias("line_no"), row.alias("row")), F.col("row"), "\n")


def write_sbv(lines: DataFrame) -> DataFrame:
    row = F.concat(ts_sbv(F.col("start")), F.lit(","), ts_sbv(F.col("end")), F.lit("\n"), _body(), F.lit("\n"))
    return _document(_cues(lines), row, "\n")


def write_txt(lines: DataFrame) -> DataFrame:
    return _document(lines, _body(), "\n", tail="\n")


def write_lrc(lines: DataFrame, clear: float = 2.0, ms: bool = False) -> DataFrame:
    """Line stamps; an empty stamp clears the screen before a pause of ``clear`` s."""
    nxt = F.lead("start").over(_by_doc())
    stamp = lambda t: F.concat(F.lit("["), ts_lrc(t, ms), F.lit("]"))
    timed = _timed(lines).withColumn("gone", F.when(F.col("end").isNotNull() & F.coalesce(nxt - F.col("end") >= clear, nxt.isNull()), stamp(F.col("end"))))
    again = F.concat(stamp(F.col("start")), F.nullif(F.col("translation"), F.lit("")))
    row = F.concat_ws("\n", F.concat(stamp(F.col("start")), line_text(F.col("tokens"))), again, F.col("gone"))
    return _document(timed, row, "\n", f"[by:{TOOL}]\n", "\n")


def write_lrc_enhanced(lines: DataFrame, ms: bool = False) -> DataFrame:
    inner = shown(F.col("tokens"), lambda t, s: F.concat(F.lit("<"), ts_lrc(t["start"], ms), F.lit(">"), s))
    row = F.concat(F.lit("["), ts_lrc(F.col("start"), ms), F.lit("]"), inner, F.lit("<"), ts_lrc(F.col("end"), ms), F.lit(">"))
    return _document(_timed(lines), row, "\n", f"[by:{TOOL}]\n", "\n")


def write_lrc_word(lines: DataFrame, ms: bool = False) -> DataFrame:
    inner = shown(F.col("tokens"), lambda t, s: F.concat(F.lit("["), ts_lrc(t["start"], ms), F.lit("]"), s))
    return _document(_timed(lines), F.concat(inner, F.lit("["), ts_lrc(F.col("end"), ms), F.lit("]")), "\n", f"[by:{TOOL}]\n", "\n")


def _span(tokens_row: Column) -> Column:
    s, e = millis(F.col("start")), millis(F.col("end"))
    return F.concat(F.lit("["), s.cast("string"), F.lit(","), (e - s).cast("string"), F.lit("]"), tokens_row)


def _length(t: Column) -> Column:
    return F.greatest(F.lit(0), millis(t["end"]) - millis(t["start"])).cast("string")


def write_qrc(lines: DataFrame) -> DataFrame:
    row = shown(F.col("tokens"), lambda t, s: F.concat(s, F.lit("("), millis(t["start"]).cast("string"), F.lit(","), _length(t), F.lit(")")))
    return _document(_timed(lines), _span(row), "\n", tail="\n")


def write_yrc(lines: DataFrame) -> DataFrame:
    row = shown(F.col("tokens"), lambda t, s: F.concat(F.lit("("), millis(t["start"]).cast("string"), F.lit(","), _length(t), F.lit(",0)"), s))
    return _document(_timed(lines), _span(row), "\n", tail="\n")


def write_krc(lines: DataFrame) -> DataFrame:
    """Word times relative to the line; translations in a base64 payload."""
    row = shown(F.col("tokens"), lambda t, s: F.concat(F.lit("<"), (millis(t["start"]) - millis(F.col("start"))).cast("string"), F.lit(","), _length(t), F.lit(",0>"), s))
    rows = F.array_sort(F.collect_list(F.struct("line_no", _span(row).alias("row"), F.coalesce("translation", F.lit("")).alias("tr"))))
    payload = F.pandas_udf(lambda s: s.map(lambda x: b64encode(json.dumps({"content": [{"language": 0, "type": 1, "lyricContent": [[t] for t in x]}], "version": 1}, ensure_ascii=False).encode()).decode()), T.StringType())
    docs = _timed(lines).groupBy("doc_id").agg(rows.alias("rows"))
    trs = F.transform("rows", lambda r: r["tr"])
    head = F.concat(F.lit("[id:$00000000]\n[offset:0]\n"), F.when(F.exists(trs, lambda t: t != ""), F.concat(F.lit("[language:"), payload(trs), F.lit("]\n"))).otherwise(""))
    return docs.select("doc_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n")).alias("text"))


#: Fixed value of the format.
KRC_KEY = bytes([64, 71, 97, 119, 94, 50, 116, 71, 81, 54, 49, 45, 206, 210, 110, 105])


def _masked(data: bytes) -> bytes:
    return bytes(a ^ b for a, b in zip(data, KRC_KEY * (len(data) // 16 + 1)))


def krc_seal(text: str) -> bytes:
    return b"krc1" + _masked(zlib.compress(("﻿" + text).encode("utf-8")))


def krc_open(data: bytes) -> str:
    if data[:4] != b"krc1":
        raise ValueError("no sealed KRC file")
    return zlib.decompress(_masked(data[4:])).decode("utf-8").lstrip("﻿")


def write_krc_encrypted(lines: DataFrame) -> DataFrame:
    seal = F.pandas_udf(lambda s: s.map(krc_seal), T.BinaryType())
    return write_krc(lines).select("doc_id", seal("text").alias("data"))


def write_ass(lines: DataFrame, style: StyleConfig | str = "karaoke", layout: Layout | None = None, bilingual: bool = True, title: str = TOOL, adapt: bool = True) -> DataFrame:
    """Dialogue events; a karaoke clock in whole centiseconds that never drifts, and syllable effects.

    A line shows up to the style's lead before it is sung, but not before the line before
    ends, and stays up to its lead after, but not into the next line.  ``breaks``, where
    lines have them, are rows; ``speaker`` is the event's name.
    """
    style = make_style(style) if isinstance(style, str) else style
    layout = layout or LAYOUTS["landscape"]
    style = style.adapt_to_layout(layout) if adapt else style
    e, clock = style.effect, KARAOKE.get(style.effect.karaoke, "")
    cues = _cues(lines)
    for name, kind in (("speaker", "string"), ("breaks", "array<int>")):
        cues = cues if name in cues.columns else cues.withColumn(name, F.lit(None).cast(kind))
    free = F.coalesce(F.lag("end").over(_by_doc()), F.lit(0.0)) if e.lead_in_ms and clock else F.lit(0.0)
    gone, after = F.col("end") + e.lead_out_ms / 1000, F.lead("start").over(_by_doc())
    cues = cues.withColumns({"show": F.least("start", F.greatest(free, F.col("start") - e.lead_in_ms / 1000)), "hide": F.when(after.isNull(), gone).otherwise(F.least(gone, F.greatest("end", after)))})
    safe = lambda s: F.replace(F.translate(s, "\\{}", "＼｛｝"), F.lit("\n"), F.lit("\\N"))
    n, show = F.size("tokens"), F.col("show")
    since = lambda t, unit: F.bround((t - show) * unit, 0).cast("long")

    def told(t, i):
        """What a token shows, and its start, end and the next one's start."""
        a = F.coalesce(t["start"], show)
        b = F.coalesce(t["end"], a)
        nxt = F.coalesce(F.get("tokens", i + 1)["start"], b)
        row_ends = F.coalesce(F.array_contains("breaks", i), F.lit(False)) & (i < n - 1)
        text = F.concat(t["text"], F.when(row_ends, "\n").when(t["space_after"] & (i < n - 1), " ").otherwise(""))
        return F.struct(safe(text).alias("text"), since(a, 100).alias("a"), since(F.least(b, nxt), 100).alias("b"), syllable_tags(style, since(a, 1000), since(b, 1000)).alias("tags"))

    def step(acc, x):
        gap = F.greatest(F.lit(0).cast("long"), x["a"] - acc["at"])
        start = acc["at"] + gap
        end = F.greatest(start, x["b"])
        wait = F.when(gap > 0, F.concat(F.lit(f"{{{clock}"), gap.cast("string"), F.lit("}"))).otherwise("") if clock else F.lit("")
        lit = F.concat(F.lit(clock), (end - start).cast("string")) if clock else F.lit("")
        return F.struct(end.alias("at"), F.concat(acc["out"], wait, F.lit("{"), lit, x["tags"], F.lit("}"), x["text"]).alias("out"))

    if clock or e.syllable != "none":
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
        body = F.aggregate(F.transform("tokens", told), start, step)["out"]
    else:
        body = F.array_join(F.transform(F.transform("tokens", told), lambda x: x["text"]), "")
    fade = f"{{\\fad({e.fade_in_ms},{e.fade_out_ms})}}" if e.fade_in_ms or e.fade_out_ms else ""
    event = lambda name, who, text: F.concat(F.lit("Dialogue: 0,"), ts_ass(show), F.lit(","), ts_ass(F.col("hide")), F.lit(f",{name},"), who, F.lit(f",0,0,0,,{fade}"), text)
    other = F.when(F.nullif(F.col("translation"), F.lit("")).isNotNull() & bilingual, event("Translation", F.lit(""), safe(F.col("translation"))))
    row = F.concat_ws("\n", event("Default", F.coalesce("speaker", F.lit("")), body), other)
    return _document(cues, row, "\n", ass_head(style, layout, title), "\n")


def write_ttml(lines: DataFrame, words: bool = True) -> DataFrame:
    esc = lambda s: F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    span = lambda t, s: F.concat(F.lit('<span begin="'), ts_vtt(t["start"]), F.lit('" end="'), ts_vtt(t["end"]), F.lit('">'), esc(t["text"]), F.lit("</span>"), F.when(s.endswith(" "), " ").otherwise(""))
    inner = shown(F.col("tokens"), span) if words else esc(line_text(F.col("tokens")))
    tr = F.when(F.nullif(F.col("translation"), F.lit("")).isNotNull(), F.concat(F.lit('<span ttm:role="x-translation">'), esc(F.col("translation")), F.lit("</span>"))).otherwise("")
    row = F.concat(F.lit('<p begin="'), ts_vtt(F.col("start")), F.lit('" end="'), ts_vtt(F.col("end")), F.lit('">'), inner, tr, F.lit("</p>"))
    head = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata"><body><div>\n'
    return _document(_cues(lines), row, "\n", head, "\n</div></body></tt>\n")


def _minutes(t: Column) -> Column:
    """mm:ss, with hours where there are some; dashes for no time."""
    whole = F.floor(F.greatest(F.lit(0.0), t)).cast("long")
    short = F.format_string("%02d:%02d", F.floor(whole / 60) % 60, whole % 60)
    return F.when(t.isNull(), "--:--").when(whole >= 3600, F.concat(F.format_string("%02d:", F.floor(whole / 3600)), short)).otherwise(short)


# Fixed values of transcripts: marks that end a line, pauses that end a sentence and a paragraph, its longest text.
ENDED = "，。！？；：、,.!?;:…—）)」』”"
SENTENCE_PAUSE, PARAGRAPH_PAUSE, PARAGRAPH_CHARS = 0.8, 2.0, 300
UNTITLED = "Transcript"


def paragraphs(lines: DataFrame, pause: float = PARAGRAPH_PAUSE, most: int = PARAGRAPH_CHARS) -> DataFrame:
    """(doc_id, par_no, speaker, start, end, text, first_line, last_line) of a document's lines.

    A paragraph ends where the speaker changes, at a long pause, or once its text is long;
    CJK lines without a final mark get one by the pause that follows.  Lines without
    tokens don't count.
    """
    base = lines.where(F.size("tokens") > 0).withColumn("text", F.trim(line_text(F.col("tokens"))))
    base = base.select("doc_id", "line_no", "start", "end", "text", F.col("speaker") if "speaker" in lines.columns else F.lit(None).cast("string").alias("speaker"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no").astype(object).where(lambda x: x.notna(), None)
        rows: list[dict] = []
        for r in pdf.to_dict("records"):
            p = rows[-1] if rows else None
            gap = r["start"] - p["end"] if p and r["start"] is not None and p["end"] is not None else 0.0
            if p is None or p["speaker"] != r["speaker"] or gap >= pause or len(p["text"]) >= most:
                rows.append({"doc_id": r["doc_id"], "par_no": len(rows), "speaker": r["speaker"], "start": r["start"], "end": r["end"], "text": r["text"], "first_line": r["line_no"], "last_line": r["line_no"]})
                continue
            said = p["text"]
            if said and r["text"] and is_cjk(said[-1]) and said[-1] not in ENDED:
                said += "。" if gap >= SENTENCE_PAUSE else "，"
            space = said and r["text"] and not is_cjk(said[-1]) and not is_cjk(r["text"][0])
            p["text"] = said + " " * bool(space) + r["text"]
            p["last_line"] = r["line_no"]
            p["end"] = p["end"] if r["end"] is None else r["end"]
        return pd.DataFrame(rows, columns=["doc_id", "par_no", "speaker", "start", "end", "text", "first_line", "last_line"])

    kinds = dict(base.dtypes)
    return base.groupBy("doc_id").applyInPandas(run, f"doc_id {kinds['doc_id']}, par_no int, speaker string, start double, end double, text string, first_line {kinds['line_no']}, last_line {kinds['line_no']}")


def write_transcript(lines: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Markdown: a title, how long it is, and paragraphs with who speaks and when.

    ``metadata`` (doc_id, title, speakers) is optional; a document without a title is a
    transcript.
    """
    p = paragraphs(lines)
    who = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("**"), F.col("speaker"), F.lit("**  "))).otherwise("")
    row = F.concat(who, F.lit("`"), _minutes(F.col("start")), F.lit("`\n\n"), F.col("text"), F.lit("\n"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par_no", row.alias("row")))), lambda r: r["row"]), "\n")
    body = p.groupBy("doc_id").agg(rows.alias("body"))
    head = lines.groupBy("doc_id").agg(F.max("end").alias("length"))
    if metadata is not None:
        head = head.join(metadata.select("doc_id", "title", "speakers"), "doc_id", "left")
    else:
        head = head.withColumns({"title": F.lit(None).cast("string"), "speakers": F.lit(None).cast("int")})
    info = F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)), F.lit("\n\n> length "), _minutes(F.coalesce("length", F.lit(0.0))), F.when(F.col("speakers") > 0, F.format_string(" · %d speakers", "speakers")).otherwise(""), F.lit("\n\n"))
    return head.join(body, "doc_id", "left").select("doc_id", F.concat(info, F.coalesce("body", F.lit(""))).alias("text"))


# The parts that every Word file has.
DOCX_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
DOCX_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
DOCX_BODY = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
_NO_XML = re.compile("[^\t\n\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def docx(markdown: str) -> bytes:
    """A Word file of a transcript's Markdown: title, note, names in bold, times small, paragraphs."""

    def run(text: str, form: str = "") -> str:
        return f'<w:r><w:rPr>{form}</w:rPr><w:t xml:space="preserve">{escape(_NO_XML.sub("", text))}</w:t></w:r>' if text else ""

    def paragraph(row: str) -> str:
        if row.startswith("# "):
            return run(row[2:], '<w:b/><w:sz w:val="32"/>')
        if row.startswith("> "):
            return run(row[2:], '<w:color w:val="667085"/>')
        head = re.fullmatch(r"(?:\*\*(.*)\*\*  )?`([\d:-]+)`", row)
        if head:
            return run(f"{head[1]}  " if head[1] else "", "<w:b/>") + run(head[2], '<w:color w:val="98A2B3"/><w:sz w:val="18"/>')
        return run(row)

    rows = "".join(f"<w:p>{paragraph(row)}</w:p>" for row in markdown.split("\n") if row)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", DOCX_TYPES), ("_rels/.rels", DOCX_RELS), ("word/document.xml", DOCX_BODY.format(rows))):
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def write_transcript_docx(lines: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """The transcript as a Word file, (doc_id, data)."""
    pack = F.pandas_udf(lambda s: s.map(docx), T.BinaryType())
    return write_transcript(lines, metadata).select("doc_id", pack("text").alias("data"))


#: Keys of a document's metadata and their LRC tags (fixed values).
LRC_TAGS = {"title": "ti", "artist": "ar", "album": "al", "author": "au", "by": "by", "lyricist": "lr"}


def with_header(texts: DataFrame, metadata: DataFrame) -> DataFrame:
    """LRC texts of ``write_lrc`` and its kin with the tags of ``metadata`` (doc_id, metadata: map)."""
    m = F.col("metadata")
    tag = lambda k, t: F.when(F.coalesce(m[k], F.lit("")) != "", F.concat(F.lit(f"[{t}:"), m[k], F.lit("]\n"))).otherwise("")
    own = F.coalesce(m["by"], F.lit("")) != ""
    head = F.concat(*[tag(k, t) for k, t in LRC_TAGS.items()], F.when(own, "").otherwise(f"[by:{TOOL}]\n"))
    bare = F.regexp_replace("text", f"^\\[by:{TOOL}\\]\n", "")
    return texts.join(metadata.select("doc_id", "metadata"), "doc_id", "left").select("doc_id", F.when(m.isNull(), F.col("text")).otherwise(F.concat(head, bare)).alias("text"))


def write_json(lines: DataFrame) -> DataFrame:
    """The lossless form: nested lines as JSON."""
    given = lambda n, kind: F.col(n) if n in lines.columns else F.lit(None).cast(kind)
    line = F.struct("start", "end", "tokens", given("translation", "string").alias("translation"), given("speaker", "string").alias("speaker"), given("breaks", "array<int>").alias("breaks"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.to_json(line).alias("l")))), lambda x: x["l"])
    text = F.concat(F.lit('{"kind":"speech","lines":['), F.array_join(ordered, ","), F.lit("]}"))
    return lines.groupBy("doc_id").agg(text.alias("text"))


WRITERS = {
    "srt": write_srt, "srt-karaoke": write_srt_karaoke, "vtt": write_vtt, "vtt-karaoke": write_vtt_karaoke, "sbv": write_sbv, "txt": write_txt, "lrc": write_lrc, "lrc-enhanced": write_lrc_enhanced,
    "lrc-word": write_lrc_word, "qrc": write_qrc, "yrc": write_yrc, "krc": write_krc, "krc-encrypted": write_krc_encrypted, "ass": write_ass, "ttml": write_ttml, "ttml-line": lambda x: write_ttml(x, False), "transcript": write_transcript, "transcript-docx": write_transcript_docx, "json": write_json,
}


def write(lines: DataFrame, fmt: str) -> DataFrame:
    """One text (or data) for each document in the named format."""
    if fmt not in WRITERS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(WRITERS)}")
    return WRITERS[fmt](lines)
