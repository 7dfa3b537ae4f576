"""Plans of a dub on small projects, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.operators import dubbing


def test_segments(spark):
    rows = [(1, 1, "第1句，好", "zh", 0.0, 1.0), (1, 2, "<重|快>走！", "zh", 1.5, 2.0), (1, 3, "（注）", "zh", 9.0, 9.5), (2, 1, "Well, ok", "en", None, None), (2, 2, None, "en", 3.0, 4.0)]
    got = [tuple(r) for r in dubbing.timed_segments(spark.createDataFrame(rows, "p int, id int, text string, lang string, start double, end double"), ["p"]).select("p", "id", "text", "tts_text", "emphasis", "pause_after").orderBy("p", "id").collect()]
    assert got == [(1, 1, "第一句，好。", "第一句，好。", [], 0.5), (1, 2, "<重|快>走！", "快走！", ["快"], 3.0), (2, 1, "Well, ok.", "Well, ok.", [], 0.45)]


def test_clauses(spark):
    df = spark.createDataFrame([("So, we paint it; done.", "en"), ("今天，我们<行|xing2>。", "zh"), ("no marks", "en"), ("", "en"), (None, "en"), ("mia casa, si", "es-MX")], "t string, la string")
    got = [r[0] for r in df.select(dubbing.clause_positions(F.col("t"), F.col("la"))).collect()]
    assert got == [[0.2, 0.8], [0.4], [], [], None, [pytest.approx(0.75)]]


def test_levels_and_lengths(spark):
    r = np.random.default_rng(2)
    rows = [(p, i, float(x), None if r.random() < 0.2 else float(y)) for p in (1, 2) for i, (x, y) in enumerate(zip(r.normal(-20, 5, 15), r.normal(-25, 8, 15)))] + [(1, 99, -80.0, -20.0), (3, 0, -70.0, None)]
    got = {(x["p"], x["id"]): x["gain_db"] for x in dubbing.dynamics_gains(spark.createDataFrame(rows, "p int, id int, level double, source_level double"), ["p"]).collect()}
    for p in (1, 2, 3):
        mine = [x for x in rows if x[0] == p]
        aim = np.median([x[2] for x in mine if x[2] > -60] or [-23])
        mid = np.median([x[3] for x in mine if x[3] is not None] or [0])
        for _, i, level, src in mine:
            off = 0 if src is None else np.clip(src - mid, -6, 6)
            assert got[p, i] == pytest.approx(0 if level <= -60 else np.clip(aim + off - level, -12, 12))
    takes = spark.createDataFrame([(1, k, 2.0 + (k % 7) / 10, 1.8) for k in range(50)] + [(2, 0, 0.0, 0.0)], "p int, k int, duration double, speech double")
    edges = dubbing.take_edges(takes, ["p"], ["k"])
    edge = float(np.median([2.0 + (k % 7) / 10 - 1.8 for k in range(20, 50)]))
    assert [(x["p"], x["edge"]) for x in edges.collect()] == [(1, pytest.approx(edge))]
    lines = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 1.5, 1.6), (1, 3, 5.0, 7.0), (2, 1, 0.0, 1.0), (2, 2, None, None)], "p int, id int, start double, end double")
    want = {(x["p"], x["id"]): x["target"] for x in dubbing.pace_target(lines, edges, ["p"], speed=1.25).collect()}
    assert want == {(1, 1): pytest.approx(1.42 / 1.25 + edge, abs=1e-3), (1, 2): None, (1, 3): pytest.approx(1.6 + edge, abs=1e-3), (2, 1): pytest.approx(0.8 + 0.25), (2, 2): None}


def test_expressiveness(spark):
    df = spark.createDataFrame([(0.0, 0.0, -5.0), (3.0, 4.0, 0.0), (None, None, None), (None, 2.5, None), (9.0, 9.0, 9.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(dubbing.expressiveness(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [0.0, pytest.approx((np.sqrt(25 / 3) - 0.5) / 2, abs=1e-3) if np.sqrt(25 / 3) < 2.5 else 1.0, 0.0, 1.0, 1.0]
    assert spark.range(1).select(dubbing.speaking_rate(F.lit(10), F.lit(0.1))).first()[0] == pytest.approx(50)
