"""Schemas of timed text.  All times are seconds; null means not timed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("space_after", T.BooleanType())]
)
TOKENS = T.ArrayType(TOKEN)
LINE = T.StructType(
    [T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("tokens", TOKENS), T.StructField("translation", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("breaks", T.ArrayType(T.IntegerType()))]
)
DOCUMENT = T.StructType([T.StructField("language", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("lines", T.ArrayType(LINE))])


def flatten(docs: DataFrame) -> DataFrame:
    """Token rows (doc_id, line_no, tok_no, text, ...) of nested documents (doc_id, lines)."""
    lines = docs.select("doc_id", F.posexplode("lines").alias("line_no", "line"))
    tokens = lines.select("doc_id", "line_no", "line.speaker", F.posexplode("line.tokens").alias("tok_no", "t"))
    return tokens.select("doc_id", "line_no", "tok_no", "speaker", "t.*")


def nest(tokens: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, start, end, tokens) of token rows; the inverse of flatten."""
    token = F.struct("tok_no", "text", "start", "end", "confidence", "space_after")
    ordered = F.array_sort(F.collect_list(token))
    bare = F.transform(ordered, lambda t: F.struct(t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"), t["confidence"].alias("confidence"), t["space_after"].alias("space_after")))
    return tokens.groupBy("doc_id", "line_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), bare.alias("tokens"))


def to_json(docs: DataFrame) -> DataFrame:
    """doc_id and json of nested documents, without loss."""
    return docs.select("doc_id", F.to_json(F.struct("language", "kind", "metadata", "lines")).alias("json"))


def from_json(df: DataFrame, col: str = "json") -> DataFrame:
    """Nested documents of their JSON; missing keys become null, kind speech."""
    d = F.from_json(F.col(col), DOCUMENT)
    return df.select("doc_id", d["language"].alias("language"), F.coalesce(d["kind"], F.lit("speech")).alias("kind"), d["metadata"].alias("metadata"), F.coalesce(d["lines"], F.array().cast(T.ArrayType(LINE))).alias("lines"))


def duration(start, end):
    """Seconds of a token or line, 0 where it isn't timed."""
    return F.coalesce(F.greatest(F.lit(0.0), F.when(start.isNotNull(), end - start)), F.lit(0.0))


def timed(start, end):
    return start.isNotNull() & end.isNotNull()


def display_rows(tokens, breaks):
    """The rows that a line shows: cut after the tokens at ``breaks``, the last token's but not."""
    n = F.size(tokens)
    cut = lambda i: F.coalesce(F.array_contains(breaks, i), F.lit(False)) & (i < n - 1)
    parts = F.transform(tokens, lambda t, i: F.concat(t["text"], F.when(cut(i), "\n").when(t["space_after"] & (i < n - 1), " ").otherwise("")))
    return F.transform(F.split(F.array_join(parts, ""), "\n"), lambda x: F.trim(x))
