"""From decisions to an edit: small documents, and many of them against loops."""

import random

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import cut, edit

ITEM = "d int, line_no int, start double, end double, text string, key string, cut string, island boolean"


def made(seed, docs=30):
    r = random.Random(seed)
    rows, spans = [], []
    for d in range(docs):
        t = 0.3
        for k in range(r.randint(1, 14)):
            t += r.choice([0.05, 0.4, 1.2])
            length = r.choice([0.2, 0.4])
            island = r.random() < 0.15
            rows.append((d, k // 4, round(t, 3), round(t + length, 3), f"w{k} ", "" if island else f"w{k}", r.choice([None, None, "filler", "repeat", "breath"]), island))
            t += length
        spans.append((d, round(t + 1.0, 3)))
    return rows, spans


def kept_by_hand(items, end):
    """Maximal pieces around words that stay: from 0.05 before to 0.05 after each."""
    out = []
    for _, _, a, b, _, _, why, _ in sorted(items, key=lambda x: x[2]):
        if why is None:
            a, b = round(max(0.0, a - 0.05), 3), round(min(end, b + 0.05), 3)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def test_removals_against_loops(spark):
    rows, spans = made(5)
    items, length = spark.createDataFrame(rows, ITEM), dict(spans)
    kept = [(d, a, b) for d, end in spans for a, b in kept_by_hand([x for x in rows if x[0] == d], end)]
    got = {}
    for r in edit.removals(spark.createDataFrame(kept, "d int, start double, end double"), items, spark.createDataFrame(spans, "d int, duration double"), ["d"]).collect():
        got[r["d"], round(r["start"], 4), round(r["end"], 4)] = (r["edge"], r["reasons"], r["text"], r["speech"], r["value"], r["mutable"])
    want = {}
    for d, end in spans:
        mine = [(a, b) for x, a, b in kept if x == d]
        edges = ([(0.0, mine[0][0], True)] if mine and mine[0][0] > 1e-3 else []) + [(a[1], b[0], False) for a, b in zip(mine, mine[1:])] + ([(mine[-1][1], end, True)] if mine and end - mine[-1][1] > 1e-3 else [])
        for a, b, edge in edges:
            held = sorted((x for x in rows if x[0] == d and x[6] and a - 0.02 <= (x[2] + x[3]) / 2 <= b + 0.02), key=lambda x: x[2])
            why = sorted({x[6] for x in held}, key=lambda w: -edit.VALUE[w]) or ["pause"]
            spoken = "".join(x[4] for x in held if not x[7])
            speech = round(sum(x[3] - x[2] for x in held if x[6] != "breath"), 3)
            worth = max(edit.VALUE[w] for w in why) if held else 1 + 1.5 * max(0.0, b - a - 0.4)
            want[d, round(a, 4), round(b, 4)] = (edge, why, spoken or ("(voice)" if held else "(pause)"), pytest.approx(speech, abs=2e-3), pytest.approx(worth + 0.8 * (b - a), abs=2e-3), bool(held) and set(why) <= set(edit.MUTABLE))
    assert got == want and len(got) > 40
    muted = edit.may_mute(edit.removals(spark.createDataFrame(kept, "d int, start double, end double"), items, spark.createDataFrame(spans, "d int, duration double"), ["d"])).where("mutable").collect()
    assert all(not r["edge"] and r["speech"] <= 0.45 for r in muted) and length


def test_keeps_words_and_groups(spark):
    gone = spark.createDataFrame([(1, 0.0, 0.5, 0.0, True, "keep"), (1, 2.0, 3.0, 0.2, False, "cut"), (1, 5.0, 5.5, 0.1, False, "mute"), (1, 8.0, 10.0, 0.0, True, "cut")], "d int, start double, end double, fill double, edge boolean, mode string")
    length = spark.createDataFrame([(1, 10.0), (2, 4.0)], "d int, duration double")
    kept = edit.final_keeps(gone, length, ["d"])
    got = [tuple(r) for r in kept.select("d", "start", "end", "fill", "edited").orderBy("d", "start").collect()]
    assert got == [(1, 0.5, 2.0, 0.2, 0.0), (1, 3.0, 8.0, 0.0, 1.5), (2, 0.0, 4.0, 0.0, 0.0)]
    items = spark.createDataFrame([(1, 0, 0.6, 1.0, "a", "a", None, False), (1, 0, 1.8, 2.4, "b", "b", None, False), (1, 0, 2.1, 2.9, "c", "c", None, False), (1, 1, 3.5, 4.0, "d", "d", None, False), (1, 1, 4.0, 4.5, "e", "e", "filler", False), (1, 1, 4.6, 4.9, "f", "f", "filler", False), (1, 1, 5.0, 5.1, "x", "", "filler", True)], ITEM)
    words = [tuple(r) for r in edit.edited_words(items, kept, ["d"]).select("line_no", "text", F.round("start", 6), F.round("end", 6)).orderBy("start").collect()]
    assert words == [(0, "a", 0.1, 0.5), (0, "b", 1.3, 1.3), (1, "d", 2.0, 2.5)]
    grouped = edit.groups(items, ["d"])
    assert [tuple(r) for r in grouped.where("cut is not null").select("text", "start", "end", "island").orderBy("start").collect()] == [("ef", 4.0, 4.9, False), ("x", 5.0, 5.1, True)] and grouped.count() == 6
    assert edit.speech_spans(items, ["d"]).count() == 7
    text = edit.report(spark.createDataFrame([(1, 10.0, 6.5), (2, 0.0, 0.0)], "d int, duration double, output double"), grouped, ["d"]).orderBy("d").collect()
    assert "10.0 s to 6.5 s, 3.5 s less, 35%" in text[0]["text"] and "- filler: 2, 1.0 s" in text[0]["text"] and "- [00:04.00] filler: ef" in text[0]["text"] and text[1]["text"].startswith("# Cut")


def test_runs_and_frame_times(spark):
    frames = spark.createDataFrame([(1, i) for i in (2, 3, 5, 9, 10, 20)], "d int, i int")
    got = [(r["start"], r["end"]) for r in edit.runs(frames, ["d"], F.lit(True), 1, 0.1, 0.2).orderBy("start").collect()]
    assert got == [(pytest.approx(0.2), pytest.approx(0.6)), (pytest.approx(0.9), pytest.approx(1.1))]
    from fractions import Fraction

    cases = [(0, 25, 1), (50, 25, 1), (7, 30000, 1001), (24000, 24000, 1001), (1, 60, 1), (123456, 30000, 1001)]
    df = spark.createDataFrame(cases, "n long, rate long, scale long")
    for (n, rate, scale), r in zip(cases, df.select("n", edit.frame_time(F.col("n"), F.col("rate"), F.col("scale")).alias("t")).collect()):
        f = Fraction(n * scale, rate)
        assert r["t"] == (f"{f.numerator}s" if f.denominator == 1 else f"{f.numerator}/{f.denominator}s")
    e = spark.createDataFrame([], ITEM)
    assert edit.groups(e, ["d"]).count() == 0 and cut.keeps(e.select("d", "start", "end"), ["d"], spark.createDataFrame([], "d int, duration double")).count() == 0
