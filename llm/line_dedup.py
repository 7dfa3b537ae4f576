"""Substring duplicates by hashing normalised paragraphs.

Lines are split further into clauses, at the marks in ``MARKS`` and at line ends.  A unit
is a paragraph of clauses: it starts where a line or sentence starts and ends with the
first clause that brings it to ``LEAST_WORDS`` words, so a passage that starts and ends
in the middle of lines still holds whole units, and a short line that many documents
share is none.  Its digest is of its words alone (lower case, letters and digits).

Digests are counted globally after a partial count before the shuffle; the earliest
occurrence, by document id and place, stays and the others are cut out.  What goes is
told with its offsets in the text as it was.  Of two occurrences of a unit the later
goes, so of every clause that goes an earlier one was there, and the earliest stays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, fresh, table

#: Words of the shortest unit; a passage of twice as many holds one wherever its sentences start.
LEAST_WORDS = 25
#: Digests with more than one in so many of all repeated units are joined by broadcast: there are fewer of them than this.
HOT_SHARE = 1000

MARKS = ".!?,;:\n。！？，；：、"
ENDS = ".!?\n。！？"
CLAUSE = f"[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+".replace("\n", r"\n")
#: A letter of a script without spaces counts as a word.
WORD = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{N}]+"

_CLAUSE, _WORD, _ASCII, _END = re.compile(CLAUSE), regex.compile(WORD), re.compile("[a-z0-9]+"), re.compile(f"[{ENDS}]")


def units(text: str, least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Starts, ends and 16-byte digests of the paragraphs of ``text``."""
    plain = text.isascii()
    start, end, first, words, norms = [], [], [], [], []
    opens = True
    for m in _CLAUSE.finditer(text):
        piece = m.group()
        found = _ASCII.findall(piece.lower()) if plain else _WORD.findall(piece.lower())
        if found:
            start.append(m.start())
            end.append(m.end())
            first.append(opens)
            words.append(len(found))
            norms.append(" ".join(found).encode("utf-8", "surrogatepass"))
        opens = _END.search(piece) is not None
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int32), []
    total = np.cumsum(words)
    before = total - words
    at = np.flatnonzero(first)
    last = np.searchsorted(total, before[at] + least)
    at, last = at[last < len(total)], last[last < len(total)]
    whole = b" ".join(norms)
    stop = np.cumsum([len(n) + 1 for n in norms]) - 1
    begin = stop - [len(n) for n in norms]
    digests = [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(begin[at].tolist(), stop[last].tolist())]
    return np.array(start, np.int32)[at], np.array(end, np.int32)[last], digests


def merged(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, ascending and apart; one that starts within a line leaves the line end that it ends with."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return [(a, b if a == 0 or text[a - 1] == "\n" else a + len(text[a:b].rstrip("\n"))) for a, b in out]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without ``spans``, ascending and apart."""
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def _split(least: int):
    def run(batches):
        for batch in batches:
            ids, key = batch.column("doc_id"), batch.column("row_key")
            at, unit, digest = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    found = units(text, least)[2]
                    at.append(np.full(len(found), i, np.int32))
                    unit.append(np.arange(len(found), dtype=np.int32))
                    digest += found
            at, unit = np.concatenate(at) if at else [], np.concatenate(unit) if unit else []
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(at), key.take(at), pa.array(unit, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "row_key", "unit", "high", "low"])

    return run


def _cut_rows(least: int, numbers: str):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            text, gone = [], []
            for t, own in zip(batch.column("text").to_pylist(), batch.column(numbers).to_pylist()):
                spans = []
                if own:
                    start, end, _ = units(t, least)
                    spans = merged(t, [(int(start[k]), int(end[k])) for k in own])
                text.append(cut(t, spans) if spans else t)
                gone.append([{"start": a, "end": b} for a, b in spans])
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(text, pa.string()))
            i = batch.schema.get_field_index(numbers)
            yield batch.set_column(i, numbers, pa.array(gone, spans_type))

    return run


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS, removed: str = "removed") -> DataFrame:
    """``docs`` with repeated paragraphs cut from text, and ``removed``: array of (start, end) offsets.

    * null texts stay null, empty texts and texts of fewer than ``least`` words stay as they are;
    * ties: the smallest doc_id, then the first place, keeps the unit; rows alike in id
      and text share one fate; a null id ranks last;
    * a very long text is split and cut by one worker, which holds it and its clauses;
    * all columns stay; an own one named ``removed`` is replaced; an empty table is fine.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "lines")
    id_type = dict(docs.dtypes)["doc_id"]
    kept = docs.drop(removed)
    lines = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").mapInArrow(_split(least), f"doc_id {id_type}, row_key long, unit int, high long, low long")
    lines = scratch.keep(lines)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "unit")
    first = lines.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.keep(first)
    many = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most HOT_SHARE digests can hold that share of the units each.
    hot = F.broadcast(first.where(F.col("n") * HOT_SHARE > many).select(F.col("high").alias("hot_high"), F.col("low").alias("hot_low"), F.col("first").alias("hot_first")))
    rest = first.where(F.col("n") * HOT_SHARE <= many).select("high", "low", "first")
    told = lines.join(hot, (F.col("high") == F.col("hot_high")) & (F.col("low") == F.col("hot_low")), "left")
    # Hot rows have their answer: they take part in the second join under keys of their own, spread evenly.
    own = F.col("hot_first").isNotNull()
    told = told.select("doc_id", "row_key", "unit", "hot_first", F.when(own, F.xxhash64("doc_id", "unit")).otherwise(F.col("high")).alias("k"), F.when(own, F.lit(None)).otherwise(F.col("low")).alias("l"))
    found = told.join(rest, (F.col("k") == F.col("high")) & (F.col("l") == F.col("low")), "left")
    found = found.withColumn("first", F.coalesce("hot_first", "first")).where(F.col("first").isNotNull() & ~rank.eqNullSafe(F.col("first")))
    span_id, span_key, numbers = (fresh(kept, n) for n in ("span_id", "span_key", "numbers"))
    spans = found.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("unit")).alias(numbers))
    spans = scratch.keep(spans.select(F.col("doc_id").alias(span_id), F.col("row_key").alias(span_key), numbers))
    scratch.drop(but=1)
    out = kept.join(spans, kept["doc_id"].eqNullSafe(F.col(span_id)) & (F.xxhash64(kept["text"]) == F.col(span_key)), "left").select(*kept.columns, numbers)
    schema = ", ".join(f"`{n}` {t}" for n, t in [*kept.dtypes, (numbers, "array<struct<start:int,end:int>>")])
    done = out.mapInArrow(_cut_rows(least, numbers), schema)
    return done.withColumnRenamed(numbers, removed)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated paragraphs: text, how many passages went and their offsets."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


ORACLE = f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(text, '{CLAUSE}') AS us FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS k FROM cut),
said AS (SELECT *, regexp_extract_all(lower(u), '{WORD}') AS ws,
    coalesce(lag(regexp_matches(u, '[{ENDS}]')) OVER (PARTITION BY doc_id ORDER BY k), true) AS opens,
    coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM raw),
clause AS (
  SELECT doc_id, k, start, start + length(u) AS stop, opens, array_to_string(ws, ' ') AS norm, len(ws) AS words,
    sum(len(ws)) OVER w AS total, sum(length(array_to_string(ws, ' ')) + 1) OVER w AS edge
  FROM said WHERE len(ws) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
whole AS (SELECT doc_id, string_agg(norm, ' ' ORDER BY k) AS norm FROM clause GROUP BY doc_id),
opening AS (SELECT *, total - words + {LEAST_WORDS} AS need FROM clause WHERE opens),
unit AS (
  SELECT a.doc_id, a.start, b.stop, substring(w.norm, (a.edge - length(a.norm))::BIGINT, (b.edge - a.edge + length(a.norm))::BIGINT) AS norm
  FROM opening a ASOF JOIN clause b ON a.doc_id = b.doc_id AND b.total >= a.need JOIN whole w ON w.doc_id = a.doc_id),
later AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS gone FROM unit),
reach AS (SELECT doc_id, start, stop, max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM later WHERE gone),
island AS (SELECT *, sum(CASE WHEN so_far IS NULL OR start > so_far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS g FROM reach),
joined AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM island GROUP BY doc_id, g),
span AS (
  SELECT j.doc_id, j.start, d.text, CASE WHEN j.start = 0 OR substring(d.text, j.start, 1) = chr(10) THEN j.stop
    ELSE j.start + length(rtrim(substring(d.text, j.start + 1, j.stop - j.start), chr(10))) END AS stop
  FROM joined j JOIN documents d USING (doc_id)),
piece AS (
  SELECT *, substring(text, coalesce(lag(stop) OVER w, 0) + 1, start - coalesce(lag(stop) OVER w, 0)) AS kept
  FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
done AS (
  SELECT doc_id, string_agg(kept, '' ORDER BY start) || substring(any_value(text), max(stop) + 1) AS text,
    count(*)::BIGINT AS n_removed, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed
  FROM piece GROUP BY doc_id)
SELECT d.doc_id, coalesce(x.text, d.text, '') AS text, coalesce(x.n_removed, 0)::BIGINT AS n_removed, coalesce(x.removed, '') AS removed
FROM documents d LEFT JOIN done x USING (doc_id)
"""
