"""Syllables and phonemes of spoken units: words, CJK characters, numbers as they are read.

Columns say what one unit weighs; ``profile`` is a table with a row for each unit of a
text, its offsets from a running sum of the pieces that the text is split into.
Without a dictionary of readings every Han character counts two phonemes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .numbers import number_to_en, read_numbers
from .text import en_syllables

# Languages, vowels, letter groups that are one sound, units of speech.
CJK_LANGS = ("zh", "yue", "ja", "ko")
VOWEL_LANGS = ("es", "it", "pt", "id", "ru", "de", "fr")
VOWELS = "[aeiouyàáâãäåèéêëìíîïòóôõöùúûüýæœ]+|[аеёиоуыэюя]+"
FRENCH_SILENT = "(?:es|e|ent)$"
GRAPHS = "tch|dge|igh|ough|augh|th|sh|ch|ph|wh|ng|ck|ee|oo|ea|ai|ay|oa|ou|ow|oi|oy|au|aw|ie|ei|ey|ue|ew"
DOUBLED = r"([b-df-hj-np-tv-z])\1"
NUMBER = r"[$¥￥€£]?\d+(?:[.,:]\d+)*%?"
HAN, KANA, HANGUL, THAI = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", "[\u3040-\u30ff\u31f0-\u31ff]", "[\uac00-\ud7af]", "[\u0e00-\u0e7f]+"
LETTERS = "A-Za-z\u00c0-\u024f\u1e00-\u1eff"
WORD = f"[{LETTERS}\u0370-\u03ff\u0400-\u04ff]+(?:['’][{LETTERS}]+)*"
UNIT = f"{NUMBER}|{HAN}|{KANA}|{HANGUL}|{THAI}|{WORD}"
SMALL_KANA, LONE_KANA = "ゃゅょぁぃぅぇぉゎャュョァィゥェォヮ", "あいうえおアイウエオんンっッー"
SILENT_HANGUL, FINALS, MEDIALS_FINALS = 11, 28, 588

_CUT = "\x01"


def base_lang(lang: Column) -> Column:
    """``pt`` of ``pt-BR`` or ``pt_BR``."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(lang, F.lit(""))), "_", "-"), "-")[0]


def latin_phonemes(word: Column) -> Column:
    """Sounds of a word in Latin script by its letter groups."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    silent = (F.length(w) > 3) & w.rlike("(?<![eiyo])e$")
    w = F.when(silent, F.regexp_replace(w, "e$", "")).otherwise(w)
    count = lambda p: F.regexp_count(w, F.lit(p))
    return F.length(F.regexp_replace(w, f"{GRAPHS}|{DOUBLED}", "#")) + count("x") + count("qu")


def latin_syllables(word: Column, lang: Column) -> Column:
    """Vowel groups by language; English by its own rules."""
    w = F.lower(word)
    spoken = F.regexp_replace(w, FRENCH_SILENT, "")
    w = F.when((lang == "fr") & (spoken != ""), spoken).otherwise(w)
    groups = F.greatest(F.lit(1), F.regexp_count(w, F.lit(VOWELS)))
    return F.when(lang == "vi", 1).when(lang.isin(*VOWEL_LANGS), groups).otherwise(en_syllables(word)).cast("double")


_HAN = re.compile("[一-鿿]")


@F.pandas_udf(T.StringType())
def _read(number: pd.Series, after: pd.Series, cjk: pd.Series) -> pd.Series:
    """A number as it is read: Han characters, or English words with spaces."""

    def one(n, nxt, han):
        if not han:
            return number_to_en(n).replace("-", " ")
        said = read_numbers(n + nxt)  # a year is told by what follows it
        return "".join(_HAN.findall(said[: -len(nxt)] if nxt and said.endswith(nxt) else said))

    return pd.Series([None if n is None else one(n, x or "", h) for n, x, h in zip(number, after, cjk)], dtype=object)


def _summed(words: Column, f) -> Column:
    return F.aggregate(F.transform(F.filter(F.split(words, " "), lambda w: w != ""), lambda w: f(w).cast("double")), F.lit(0.0), lambda s, x: s + x)


def profile(df: DataFrame, keys: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """(keys, unit_no, start, end, unit, syllables, phonemes) of each text's spoken units.

    Offsets count code points.  Null texts have no unit; a null language is none of the
    CJK ones; rows should be told apart by ``keys``, as offsets are summed by them.
    """
    base = df.select(*keys, F.col(text).alias("_text"), base_lang(F.col(lang)).alias("_lang")).where(F.col("_text").isNotNull())
    marked = F.regexp_replace(F.regexp_replace("_text", _CUT, " "), f"({UNIT})", f"{_CUT}$1{_CUT}")
    pieces = base.select(*keys, "_lang", F.posexplode(F.split(marked, _CUT)).alias("_no", "unit"))
    w = Window.partitionBy(*keys).orderBy("_no")
    end = F.sum(F.length("unit")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = pieces.withColumn("end", end).withColumn("start", F.col("end") - F.length("unit")).withColumn("_gap", F.lead("unit").over(w)).withColumn("_next", F.lead("unit", 2).over(w))
    rows = rows.withColumn("_after", F.substring(F.concat(F.coalesce("_gap", F.lit("")), F.coalesce("_next", F.lit(""))), 1, 1))
    # Units stand at odd places between what separates them.
    rows = rows.where(F.col("_no") % 2 == 1).withColumn("unit_no", F.floor(F.col("_no") / 2).cast("int"))
    u, la = F.col("unit"), F.col("_lang")
    cjk, is_ = la.isin(*CJK_LANGS), lambda p: u.rlike(f"^(?:{p})$")
    number = is_(NUMBER)
    rows = rows.withColumn("_said", _read(F.when(number, u), "_after", cjk))
    said = F.col("_said")
    han_said = F.length(said)
    rank = F.conv(F.hex(F.encode(u, "UTF-16BE")), 16, 10).cast("long") - 0xAC00
    acronym = u.rlike("^[A-Z]{2,5}$")
    own = F.when(cjk, F.lit("en")).otherwise(la)
    syllables = (
        F.when(number & cjk, han_said * F.when(la == "ja", 1.6).otherwise(1.0))
        .when(number, _summed(said, en_syllables))
        .when(is_(HAN), F.when(la == "ja", 1.7).otherwise(1.0))
        .when(is_(KANA), F.when(F.lit(SMALL_KANA).contains(u), 0.0).otherwise(1.0))
        .when(is_(HANGUL), 1.0)
        .when(is_(THAI), F.greatest(F.lit(1.0), F.length(u) / 2.6))
        .when(acronym, F.length(u) + 2.0 * F.regexp_count(u, F.lit("W")))
        .otherwise(latin_syllables(u, own))
    )
    phonemes = (
        F.when(number & cjk, han_said * 2.0)
        .when(number, _summed(said, latin_phonemes))
        .when(is_(HAN), F.when(la == "ja", 3.0).when(la.isin("zh", "yue", ""), 2.0).otherwise(2.5))
        .when(is_(KANA), F.when(F.lit(SMALL_KANA).contains(u), 0.0).when(F.lit(LONE_KANA).contains(u), 1.0).otherwise(2.0))
        .when(is_(HANGUL), 1.0 + (F.floor(rank / MEDIALS_FINALS) != SILENT_HANGUL).cast("int") + (rank % FINALS > 0).cast("int"))
        .when(is_(THAI), F.length(u) * 0.8)
        .when(acronym, F.length(u) * 2.0)
        .otherwise(latin_phonemes(u))
    )
    return rows.select(*keys, "unit_no", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "unit", syllables.cast("double").alias("syllables"), phonemes.cast("double").alias("phonemes"))


def count(units: DataFrame, keys: list[str]) -> DataFrame:
    """Syllables, one digit, and phonemes, whole, of each text."""
    return units.groupBy(*keys).agg(F.bround(F.sum("syllables"), 1).alias("syllables"), F.bround(F.sum("phonemes"), 0).cast("long").alias("phonemes"), F.count(F.lit(1)).alias("units"))


def position(units: DataFrame, keys: list[str], offset: Column) -> DataFrame:
    """Where in the spoken text, 0 to 1 by syllables, the character at ``offset`` starts; 0 without syllables."""
    total, before = F.sum("syllables"), F.sum(F.when(F.col("end") <= offset, F.col("syllables")).otherwise(0.0))
    return units.groupBy(*keys).agg(F.when(total > 0, F.bround(F.least(F.lit(1.0), before / total), 3)).otherwise(0.0).alias("position"))
