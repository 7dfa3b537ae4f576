"""From decisions on words to an edit: what goes and why, what stays, the words in the edited time.

Items are words or voiced islands: (keys, start, end, text, key, cut, island, line_no);
``cut`` is the reason for which an item goes, null where it stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cut import keeps, time_map
from .timing import merge_intervals

# What a removal is worth by its reason, reasons that may be silenced, those that are no speech.
VALUE = {"retake": 5.0, "manual": 5.0, "llm": 4.0, "repeat": 2.5, "cough": 2.0, "unrecognized": 1.2, "filler": 1.0, "breath": 0.8}
MUTABLE = ("filler", "unrecognized", "breath")
NOT_SPEECH = ("breath",)
SLACK, EDGE, PAUSE_FREE, PAUSE_WORTH, LENGTH_WORTH = 0.02, 1e-3, 0.4, 1.5, 0.8


def groups(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, group_no, cut, text, start, end, island): words in a row that go for one reason, others alone."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = lambda c: F.lag(c).over(w)
    same = F.col("cut").isNotNull() & before("cut").eqNullSafe(F.col("cut")) & ~F.col("island") & ~before("island")
    numbered = items.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.array_sort(F.collect_list(F.struct("start", "end", "text")))
    return numbered.groupBy(*keys, "group_no").agg(F.first("cut").alias("cut"), F.array_join(F.transform(texts, lambda t: t["text"]), "").alias("text"), F.min("start").alias("start"), F.max(F.struct("start", "end"))["end"].alias("end"), F.first("island").alias("island"))


def speech_spans(items: DataFrame, keys: list[str]) -> DataFrame:
    """Where the mouth is busy: every word and island, kept or not, but for breaths."""
    said = ((F.coalesce("key", F.lit("")) != "") | F.col("island")) & ~F.coalesce(F.col("cut").isin(*NOT_SPEECH), F.lit(False))
    return items.where(said).select(*keys, "start", "end")


def runs(frames: DataFrame, keys: list[str], on: Column, bridge: int, hop: float, least: float = 0.0) -> DataFrame:
    """(keys, start, end) of runs of frames (keys, i) that are ``on``, over gaps of up to ``bridge`` frames."""
    w = Window.partitionBy(*keys).orderBy("i")
    live = frames.where(on).withColumn("_new", F.when(F.col("i") - F.lag("i").over(w) <= bridge + 1, 0).otherwise(1))
    live = live.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = live.groupBy(*keys, "_run").agg((F.min("i") * hop).alias("start"), ((F.max("i") + 1) * hop).alias("end"))
    return spans.where(F.col("end") - F.col("start") >= least - 1e-9).select(*keys, "start", "end")


def removals(kept: DataFrame, items: DataFrame, duration: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, edge, reasons, text, speech, value, mutable) of what lies between kept pieces.

    ``kept`` has keys, start, end; ``duration`` keys, duration.  A removal tells the
    reasons of the words whose middle it holds, the dearest first; one without words is
    a pause, worth more the longer it is.  Words meet removals in one window, not in a
    range join: the last removal that starts before a word's middle holds it or none does.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    ends = duration.select(*keys, F.col("duration").alias("start"), F.col("duration").alias("end"), F.lit(True).alias("_last"))
    edges = kept.select(*keys, "start", "end", F.lit(False).alias("_last")).unionByName(ends)
    edges = edges.withColumn("_from", F.coalesce(F.lag("end").over(w), F.lit(0.0))).withColumn("edge", F.col("_last") | F.lag("end").over(w).isNull())
    gone = edges.where(F.col("start") - F.col("_from") > F.when(F.col("edge"), EDGE).otherwise(0.0)).select(*keys, F.col("_from").alias("start"), F.col("start").alias("end"), "edge")
    has_any = kept.select(*keys).distinct()
    gone = gone.join(has_any, keys, "left_semi")
    middle = (F.col("start") + F.col("end")) / 2
    word = F.struct("start", "end", "text", "cut", "island")
    span = F.struct("start", "end", "edge")
    words = items.where("cut is not null").select(*keys, middle.alias("_at"), F.lit(1).alias("_kind"), word.alias("_word"))
    spans = gone.select(*keys, (F.col("start") - SLACK).alias("_at"), F.lit(0).alias("_kind"), span.alias("_span"))
    both = spans.unionByName(words, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_in", F.last("_span", True).over(order)).where((F.col("_kind") == 0) | (F.col("_at") <= F.col("_in.end") + SLACK))
    told = held.groupBy(*keys, F.col("_in.start").alias("start"), F.col("_in.end").alias("end"), F.col("_in.edge").alias("edge")).agg(F.array_sort(F.collect_list("_word")).alias("_words"))
    worth = F.create_map(*[F.lit(x) for pair in VALUE.items() for x in pair])
    value = lambda r: F.coalesce(F.try_element_at(worth, r), F.lit(1.0))
    found = F.array_distinct(F.transform("_words", lambda x: x["cut"]))
    ranked = F.transform(F.array_sort(F.transform(found, lambda r: F.struct((-value(r)).alias("v"), r.alias("r")))), lambda s: s["r"])
    length, none = F.col("end") - F.col("start"), F.size("_words") == 0
    spoken = F.array_join(F.transform(F.filter("_words", lambda x: ~x["island"]), lambda x: x["text"]), "")
    speech = F.aggregate(F.filter("_words", lambda x: ~x["cut"].isin(*NOT_SPEECH)), F.lit(0.0), lambda s, x: s + x["end"] - x["start"])
    best = F.when(none, 1.0 + PAUSE_WORTH * F.greatest(F.lit(0.0), length - PAUSE_FREE)).otherwise(F.array_max(F.transform(found, value)))
    mutable = ~none & F.forall(found, lambda r: r.isin(*MUTABLE))
    text = F.when(spoken != "", spoken).when(none, "(pause)").otherwise("(voice)")
    reasons = F.when(none, F.array(F.lit("pause"))).otherwise(ranked)
    return told.select(*keys, "start", "end", "edge", reasons.alias("reasons"), text.alias("text"), F.bround(speech, 3).alias("speech"), F.bround(best + LENGTH_WORTH * length, 3).alias("value"), mutable.alias("mutable"))


def may_mute(gone: DataFrame, longest: float = 0.45, on: bool = True) -> DataFrame:
    """``gone`` with mutable only where a short sound inside may be silenced instead of cut."""
    return gone.withColumn("mutable", F.col("mutable") & ~F.col("edge") & (F.col("speech") <= longest) & F.lit(on))


def final_keeps(gone: DataFrame, duration: DataFrame, keys: list[str]) -> DataFrame:
    """Kept pieces (keys, start, end, fill, keep_no, edited) once each removal's mode is decided.

    Removals (start, end, fill, edge, mode) that are cut, and those at an edge, go; a
    piece's fill is the room tone after it, none after the last.
    """
    cut = gone.where((F.col("mode") == "cut") | F.col("edge"))
    spans = cut.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.max("fill").alias("fill"))
    merged = merge_intervals(spans, keys).select(*keys, F.col("start").alias("end"))
    fills = spans.select(*keys, F.col("start").alias("end"), "fill").join(merged, [*keys, "end"])
    pieces = keeps(spans, keys, duration, EDGE).join(fills, [*keys, "end"], "left")
    last = F.lead("start").over(Window.partitionBy(*keys).orderBy("start")).isNull()
    return pieces.withColumn("fill", F.when(last, 0.0).otherwise(F.coalesce("fill", F.lit(0.0))))


def edited_words(items: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Words that stay, at their times in the edit: (keys, line_no, text, start, end).

    A word with one end in a cut takes the other's time; one with both goes.
    """
    words = items.where(F.col("cut").isNull() & ~F.col("island")).withColumn("_no", F.monotonically_increasing_id())
    points = words.select(*keys, "_no", "line_no", "text", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("t")), F.struct(F.lit(1).alias("side"), F.col("end").alias("t")))).alias("p"))
    points = points.select(*keys, "_no", "line_no", "text", "p.side", "p.t")
    mapped = time_map(points, kept, keys)
    both = mapped.groupBy(*keys, "_no", "line_no", "text").agg(F.max(F.when(F.col("side") == 0, F.col("mapped"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("mapped"))).alias("b"))
    start, end = F.coalesce("a", "b"), F.coalesce("b", "a")
    return both.where(start.isNotNull()).select(*keys, "line_no", "text", start.alias("start"), F.greatest(start, end).alias("end"))


def frame_time(frames: Column, rate: Column, scale: Column) -> Column:
    """``frames`` at rate / scale frames a second as an exact fraction of seconds, such as 1001/24000s."""
    top, bottom = frames.cast("long") * scale, rate.cast("long")
    # Euclid: 64-bit numbers are through in 90 steps.
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b")))
    pair = F.struct(F.abs(top).cast("long").alias("a"), bottom.alias("b"))
    by = F.greatest(F.lit(1).cast("long"), F.aggregate(F.sequence(F.lit(1), F.lit(90)), pair, step)["a"])
    up, down = F.floor(top / by), F.floor(bottom / by)
    return F.when(down == 1, F.concat(up.cast("string"), F.lit("s"))).otherwise(F.concat(up.cast("string"), F.lit("/"), down.cast("string"), F.lit("s")))


def clock(t: Column) -> Column:
    """mm:ss.cc of a report."""
    cs = F.bround(t * 100, 0).cast("long")
    return F.format_string("%02d:%02d.%02d", F.floor(cs / 6000), F.floor(cs / 100) % 60, cs % 100)


def report(stats: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): a Markdown report of stats (keys, duration, output) and the groups that go."""
    gone = grouped.where("cut is not null")
    rows = F.array_sort(F.collect_list(F.struct("start", F.concat(F.lit("- ["), clock(F.col("start")), F.lit("] "), F.col("cut"), F.lit(": "), F.col("text")).alias("row"))))
    by = gone.groupBy(*keys, "cut").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("s"))
    counts = F.array_sort(F.collect_list(F.format_string("- %s: %d, %.1f s", "cut", "n", "s")))
    summed = by.groupBy(*keys).agg(counts.alias("counts"))
    listed = gone.groupBy(*keys).agg(F.transform(rows, lambda r: r["row"]).alias("rows"))
    lost = F.col("duration") - F.col("output")
    head = F.concat(F.lit("# Cut\n\n"), F.format_string("%.1f s to %.1f s, %.1f s less, %.0f%%\n", "duration", "output", lost, F.when(F.col("duration") > 0, lost * 100 / F.col("duration")).otherwise(0.0)))
    empty = F.array().cast("array<string>")
    out = stats.join(summed, keys, "left").join(listed, keys, "left")
    return out.select(*keys, F.concat_ws("\n", head, F.array_join(F.coalesce("counts", empty), "\n"), F.lit("\n## What goes\n"), F.array_join(F.coalesce("rows", empty), "\n"), F.lit("")).alias("text"))
