"""From raw texts to line durations by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_weight, lines_of, word_count


def timed_lines(docs: DataFrame, unit: float = 0.25) -> DataFrame:
    """doc_id, lang, line_no, n_tokens and duration of each line at ``unit`` s a weight."""
    lines = docs.select("doc_id", "lang", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    n = word_count(F.col("line")).cast("long")
    return lines.select("doc_id", "lang", "line_no", n.alias("n_tokens"), (line_weight(F.col("line")) * unit).alias("duration")).where("n_tokens > 0")


def by_language(docs: DataFrame) -> DataFrame:
    """Lines, tokens, mean tokens a line and the 95th percentile of duration by language.

    Lines are counted by duration before the few languages meet, so a language that holds
    most lines costs a row for each of its durations.
    """
    by_duration = timed_lines(docs).groupBy("lang", "duration").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens"))
    return by_duration.groupBy("lang").agg(
        F.sum("n").alias("n_lines"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / F.sum("n"), 6).alias("mean_tokens"), F.round(F.percentile("duration", F.lit(0.95), F.col("n")), 6).alias("p95_duration")
    )
