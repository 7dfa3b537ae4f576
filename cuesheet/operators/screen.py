"""Screening of recognised text and rule-based corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import key

# Phrases that recognisers write without hearing them.
STRONG = r"字幕(由|提供|制作|组|校对)|(中文|双语)?字幕\s*(by|:|：)|不吝点赞|点赞.{0,6}(订阅|转发|打赏)|订阅.{0,6}(频道|转发|打赏)|明镜(与|和)点点|优优独播剧场|yoyo\s*television|amara\.org|subtitles?\s+by|please\s+subscribe|请订阅"
WEAK = r"(thanks|thank you)\s+for\s+watching|谢谢(大家)?(的)?(观看|收看)|感谢(您的)?(观看|收看)|下(期|集)(再见|见)|本(期)?视频(到此结束|就到这里)"
FILLERS = {"zh": ["嗯", "呃", "额", "啊", "那个", "就是说"], "en": ["um", "uh", "erm", "uhm", "you know"]}


def looped(k: Column) -> Column:
    """A pattern of 2 to 8 characters four times or more in a row."""
    return k.rlike(r"(.{2,8}?)\1{3,}")


def screen(segments: DataFrame, keys: list[str], order: list[str], song: bool = False, voice: str | None = None) -> DataFrame:
    """segments (text, start, end) with score and action: removed from 3, flagged at 2.

    Segments whose key is empty go without notice.  ``voice`` names a column with the
    share of voiced frames.  A segment is compared with the one before it, kept or not.
    """
    text = F.trim("text")
    k = key(F.col("text"))
    s = segments.withColumn("key", k).where("key <> ''")
    before = F.lag("key").over(Window.partitionBy(*keys).orderBy(*order))
    n = F.length("key")
    span = F.greatest(F.lit(1e-3), F.col("end") - F.col("start"))
    rate = n / span
    one = lambda c: F.when(c, 1).otherwise(0)
    score = F.when(text.rlike(f"(?i){STRONG}"), 3).when(text.rlike(f"(?i){WEAK}"), 2).otherwise(0)
    score = score + one(((rate > 12) & (n > 6)) | ((span > 8) & (rate < 0.4)))
    if not song:
        score = score + 2 * one((n >= 8) & looped(F.col("key"))) + one((before == F.col("key")) & (n >= 4))
    if voice:
        v = F.col(voice)
        score = score + F.when(v < 0.05, 3).when(v < 0.2, 2).when(v < 0.35, 1).otherwise(0)
    if {"avg_logprob", "no_speech_prob"} <= set(segments.columns):
        score = score + one((F.col("avg_logprob") < -1.0) & (F.coalesce("no_speech_prob", F.lit(0.0)) > 0.5))
    s = s.withColumn("score", score)
    return s.withColumn("action", F.when(F.col("score") >= 3, "removed").when(F.col("score") == 2, "flagged").otherwise("kept"))


def apply_glossary(text: Column, glossary: dict[str, str]) -> Column:
    """Terms replaced in the glossary's order; a term between slashes is a regex."""
    for term, by in glossary.items():
        regex = len(term) > 2 and term[0] == term[-1] == "/"
        text = F.regexp_replace(text, term[1:-1], by) if regex else F.replace(text, F.lit(term), F.lit(by))
    return text


def without_fillers(words: Column, language: str = "en", extra: tuple = ()) -> Column:
    """Words of an array that are no filler by their letters."""
    fillers = [*FILLERS.get(language[:2], []), *extra]
    return F.filter(words, lambda w: ~F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_]", "").isin(fillers))
