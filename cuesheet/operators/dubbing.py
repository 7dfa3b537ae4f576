"""Plans of a dub: sentences with pauses, levels that follow the original, lengths to aim at.

Tables of sentences and takes by project; what depends on neighbours or medians is a
window or a grouped median, never a loop over a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.speech import CJK_SCRIPT, LATIN_SCRIPT, spoken, to_engine
from ..functions.syllables import CJK_LANGS, base_lang, latin_syllables
from .rank import slot

# Fixed values.
PAUSE, PAUSE_LEAST, PAUSE_MOST = 0.45, 0.1, 3.0
QUIET, CALM_LEVEL, STEP_DB = -60.0, -23.0, 6.0
EDGES_OF, EDGE, LEAST_LENGTH, SLOWEST, FASTEST = 30, 0.25, 0.2, 0.5, 2.0
ORDINARY, FAR = 0.5, 2.0
CLAUSE_CJK, CLAUSE_LATIN = CJK_SCRIPT.ends + CJK_SCRIPT.clauses + ",;:", ",:;—….!?"


def _is_cjk(lang: Column) -> Column:
    return F.coalesce(base_lang(lang).isin(*CJK_LANGS), F.lit(False)) | (base_lang(lang) == "")


def timed_segments(sentences: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """``sentences`` (text, lang, start, end) as pieces: text as spoken, tts_text, emphasis, pause_after.

    A text gets a final mark if it has none; the pause is that before the next sentence,
    within limits; sentences that are nothing once cleaned go, and count for no pause.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.lead("start").over(w) - F.col("end")
    wait = F.when(gap.isNotNull(), F.bround(F.least(F.lit(PAUSE_MOST), F.greatest(F.lit(PAUSE_LEAST), gap)), 2))
    s = sentences.withColumn("pause_after", F.coalesce(wait, F.lit(PAUSE))).withColumn("text", spoken(F.col("text"), F.col("lang"))).where("text <> ''")
    cjk = _is_cjk(F.col("lang"))
    last = F.substring("text", -1, 1)
    ended = F.when(cjk, F.lit(CJK_SCRIPT.ends + CJK_SCRIPT.clauses).contains(last)).otherwise(F.lit(LATIN_SCRIPT.ends + LATIN_SCRIPT.clauses + "…").contains(last))
    s = s.withColumn("text", F.when(ended, F.col("text")).otherwise(F.concat(F.col("text"), F.when(cjk, "。").otherwise("."))))
    engine = F.udf(lambda t: None if t is None else to_engine(t), "struct<tts_text:string,emphasis:array<string>>", useArrow=True)
    return s.withColumn("_e", engine("text")).withColumns({"tts_text": F.col("_e.tts_text"), "emphasis": F.col("_e.emphasis")}).drop("_e")


def clause_positions(text: Column, lang: Column) -> Column:
    """Where a sentence can pause: clause marks inside, as the share of what is spoken before, 0 to 1."""
    bare = F.trim(F.regexp_replace(text, r"<([^<>|]+)\|[^<>]+>", "$1"))
    sums = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0.0), lambda s, x: s + x)

    def shares(units: Column, weight, ends) -> Column:
        weights, n = F.transform(units, weight), F.size(units)
        total = sums(weights, n)
        at = F.filter(F.transform(units, lambda u, i: F.when(ends(u) & (i < n - 1), sums(weights, i + 1))), lambda x: x.isNotNull())
        return F.transform(F.filter(at, lambda x: (x > 0) & (x < total)), lambda x: F.bround(x / total, 3))

    mark = lambda c: F.lit(CLAUSE_CJK).contains(c)
    chars = F.filter(F.split(bare, ""), lambda c: c != "")
    by_char = shares(chars, lambda c: F.when(mark(c) | c.rlike(r"^\s$"), 0.0).otherwise(1.0), mark)
    core = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_']", "")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    by_word = shares(words, lambda w: F.when(core(w) == "", 0.0).otherwise(latin_syllables(core(w), base_lang(lang)).cast("double")), lambda w: F.lit(CLAUSE_LATIN).contains(F.substring(w, -1, 1)))
    return F.when(_is_cjk(lang), by_char).otherwise(by_word)


def dynamics_gains(takes: DataFrame, keys: list[str], level: str = "level", source: str = "source_level", span: float = 6.0) -> DataFrame:
    """``takes`` with gain_db: to the median take's level, plus how far the original line is from its median.

    Takes that are silent have no gain and no part in the median; a take without an
    original aims at the median.
    """
    loud = F.when(F.col(level) > QUIET, F.col(level))
    mid = takes.groupBy(*keys).agg(F.coalesce(F.median(loud), F.lit(CALM_LEVEL)).alias("_aim"), F.coalesce(F.median(source), F.lit(0.0)).alias("_ordinary"))
    limit = lambda x, most: F.greatest(F.lit(-most), F.least(F.lit(most), x))
    off = F.when(F.col(source).isNull(), 0.0).otherwise(limit(F.col(source) - F.col("_ordinary"), span))
    gain = F.when(F.col(level) > QUIET, limit(F.col("_aim") + off - F.col(level), STEP_DB + span)).otherwise(F.lit(0.0))
    return takes.join(mid, keys).withColumn("gain_db", gain).drop("_aim", "_ordinary")


def take_edges(takes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, edge): median silence around the speech of a project's last takes (duration, speech)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    full = takes.where((F.col("duration") > 0) & (F.col("speech") > 0)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= EDGES_OF)
    return full.groupBy(*keys).agg(F.median(F.col("duration") - F.col("speech")).alias("edge"))


def pace_target(lines: DataFrame, edges: DataFrame, keys: list[str], speed: float = 1.0) -> DataFrame:
    """``lines`` (start, end) with target: the length that a raw take should have, null where there is none.

    The original's length, never more than its slot, at ``speed``, and
    the usual silence around speech.
    """
    rate = max(SLOWEST, min(FASTEST, speed))
    timed = slot(lines, keys, "start", "end").withColumn("_want", F.when(F.col("end").isNotNull(), F.least(F.col("end") - F.col("start"), "slot"))).drop("slot").join(edges, keys, "left")
    return timed.withColumn("target", F.when(F.col("_want") > LEAST_LENGTH, F.bround(F.col("_want") / rate + F.coalesce("edge", F.lit(EDGE)), 3))).drop("_want", "edge")


def expressiveness(z_level: Column, z_pitch: Column, z_spread: Column) -> Column:
    """0 to 1: how far a line is from its speaker's ordinary delivery, by robust z-scores; a flat line is not."""
    parts = F.filter(F.array(z_level, z_pitch, F.greatest(F.lit(0.0), F.when(z_spread.isNotNull(), z_spread))), lambda z: z.isNotNull())
    parts = F.when(z_spread.isNull(), F.filter(F.array(z_level, z_pitch), lambda z: z.isNotNull())).otherwise(parts)
    mean = F.aggregate(parts, F.lit(0.0), lambda s, z: s + z * z) / F.greatest(F.lit(1), F.size(parts))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.sqrt(mean) - ORDINARY) / FAR)), 3)


def speaking_rate(units: Column, voiced: Column) -> Column:
    """Units a second of voiced time."""
    return units / F.greatest(F.lit(LEAST_LENGTH), voiced)
