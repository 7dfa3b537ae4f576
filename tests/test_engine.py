"""Formats and operators on small tables, and the catalog against DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuesheet.catalog import ORACLE, QUERIES
from cuesheet.functions import style
from cuesheet.functions.time import parse_ts, ts_ass, ts_lrc, ts_srt
from cuesheet import schema
from cuesheet.operators import align, cut, rank, timing
from cuesheet.operators.layout import get_layout
from cuesheet.operators.speakers import upgma
from cuesheet.sources import readers, writers
from cuesheet.streaming import sessions

SF = "/root/testdata/sf0.001"
SOME = ["flagship", "token_counts", "time_stamps", "parse_stamps", "write_srt", "write_lrc", "qrc_round_trip", "split_by_pauses", "merge_intervals", "place_on_timeline", "keeps_from_removals", "time_map", "hallucination_screen", "first_appearance_names", "take_score_rank", "fill_missing_islands"]


def rows(pdf):
    pdf = pdf.convert_dtypes()
    return sorted(tuple("~" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_catalog(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE[name]).df())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


LRC = "[ar:Someone]\n[offset:-250]\n[00:10.50]雨夜\n[00:04.00][00:20.00]燈火\n[00:10.50]a rainy night\n"


def test_lrc(spark):
    got = readers.read(spark.createDataFrame([(1, LRC)], "doc_id long, text string"), "lrc").orderBy("line_no").collect()
    assert ["".join(t["text"] for t in r["tokens"]) for r in got] == ["燈火", "雨夜", "燈火"]
    assert [r["start"] for r in got] == [4.25, 10.75, 20.25] and got[1]["translation"] == "a rainy night" and got[1]["end"] == 18.75 and got[2]["end"] == 25.25


def filled_by_hand(rows, unit=0.25):
    """(start, end) of rows (start, end, weight), run by run."""
    out = [[a, b] for a, b, _ in rows]
    open_ = [k for k, (a, b, _) in enumerate(rows) if a is None or b is None]
    runs = []
    for k in open_:
        if runs and runs[-1][-1] == k - 1:
            runs[-1].append(k)
        else:
            runs.append([k])
    for run in runs:
        weights = [rows[k][2] for k in run]
        left = rows[run[0] - 1] if run[0] else None
        right = rows[run[-1] + 1] if run[-1] + 1 < len(rows) else None
        need = sum(weights) * unit
        low = left[1] if left else max(0.0, right[0] - need) if right else 0.0
        high = max(low, right[0]) if right else low + need
        if left and right and high - low < 1e-3:
            low = max(left[0], low - 0.04 * len(run))
            out[run[0] - 1][1] = low
        done = 0.0
        for k, x in zip(run, weights):
            out[k] = [low + (high - low) * done / sum(weights), low + (high - low) * (done + x) / sum(weights)]
            done += x
    return out


def pushed_by_hand(rows, least=0.02):
    out, reached = [], 0.0
    for a, b in rows:
        if a is None or b is None:
            out.append((a, b))
            continue
        a = max(a, reached)
        reached = b = max(b, a + least)
        out.append((a, b))
    return out


def test_times_against_loops(spark):
    """Missing times and times that go back, many small documents, also runs without room."""
    rng = np.random.RandomState(3)
    docs, table = {}, []
    for d in range(60):
        at, rows = 0.0, []
        for k in range(rng.randint(1, 12)):
            at += float(rng.choice([0.0, 0.0, 0.3, 1.0]))
            length = float(rng.choice([0.05, 0.5]))
            timed = rng.rand() < 0.6
            rows.append((at if timed else None, at + length if timed else None, float(rng.randint(1, 4))))
            at += length * timed
        docs[d] = rows
        table += [(d, k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(table, "doc int, k int, start double, end double, weight double").repartition(5)
    near = lambda got, want: all((x is None and y is None) or x == pytest.approx(y, abs=1e-9) for p, q in zip(got, want) for x, y in zip(p, q))
    for op, by_hand in ((lambda: timing.fill_missing(df, ["doc"], ["k"]), filled_by_hand), (lambda: timing.enforce_monotonic(df, ["doc"], ["k"]), lambda rows: pushed_by_hand([r[:2] for r in rows]))):
        got = {}
        for r in op().orderBy("doc", "k").collect():
            got.setdefault(r["doc"], []).append((r["start"], r["end"]))
        assert set(got) == set(docs) and all(near(got[d], by_hand(docs[d])) for d in docs)


def test_retakes(spark):
    rows = [(1, 0, 0.0, 2.0, "weshallstartnow"), (1, 1, 2.5, 4.0, "weshallstartnou"), (1, 2, 5.0, 6.0, "other"), (1, 3, 20.0, 21.0, "other"), (2, 0, 0.0, 1.0, "abc"), (2, 1, 1.0, 2.0, "abc"), (3, 0, 0.0, 1.0, None)]
    got = cut.retakes(spark.createDataFrame(rows, "doc int, line_no int, start double, end double, key string"), ["doc"]).collect()
    assert {(r["doc"], r["line_no"]) for r in got if r["is_retake"]} == {(1, 0)} and len(got) == 7


def test_srt_and_sniffing(spark):
    srt = "1\n00:00:05,000 --> 00:00:07,000\nMind the step\nattention à la marche\n"
    df = spark.createDataFrame([(1, srt), (2, LRC), (3, "plain\n\ntext"), (4, ""), (5, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): r for r in readers.read(df).collect()}
    assert got[1, 0]["start"] == 5 and got[1, 0]["translation"] == "attention à la marche" and (3, 1) in got and not any(k[0] in (4, 5) for k in got)
    with pytest.raises(ValueError):
        writers.write(df, "nothing")


@pytest.mark.parametrize("fmt", ["json", "srt", "vtt", "sbv", "lrc", "lrc-enhanced", "lrc-word", "qrc", "yrc", "krc", "ass", "ttml", "vtt-karaoke"])
def test_round_trip(spark, fmt):
    token = "array<struct<text:string,start:double,end:double,confidence:double,space_after:boolean>>"
    lines = spark.createDataFrame([(1, 0, 1.0, 2.0, [("Hello", 1.0, 1.5, 1.0, True), ("world", 1.5, 2.0, 1.0, False)], None, None), (1, 1, 4.0, 5.0, [("你", 4.0, 4.4, 1.0, False), ("好", 4.4, 5.0, 1.0, False)], None, None)], f"doc_id long, line_no int, start double, end double, tokens {token}, translation string, speaker string")
    got = readers.read(writers.write(lines, fmt), fmt).orderBy("line_no").collect()
    assert [[t["text"] for t in r["tokens"]] for r in got] == [["Hello", "world"], ["你", "好"]]
    assert [r["start"] for r in got] == pytest.approx([1, 4], abs=0.011)
    if fmt not in ("srt", "vtt", "sbv", "lrc"):
        assert [t["start"] for r in got for t in r["tokens"]] == pytest.approx([1, 1.5, 4, 4.4], abs=0.011)


def test_json_is_told_and_read(spark):
    token = "array<struct<text:string,start:double,end:double,confidence:double,space_after:boolean>>"
    lines = spark.createDataFrame([(1, 0, 1.0, 2.0, [("Rain", 1.0, 2.0, 1.0, False)], "pluie", "A")], f"doc_id int, line_no int, start double, end double, tokens {token}, translation string, speaker string")
    got = readers.read(writers.write(lines, "json").unionByName(spark.createDataFrame([(2, "{no json \"lines\"")], "doc_id int, text string"))).collect()
    assert [(r["doc_id"], r["tokens"][0]["text"], r["translation"], r["start"]) for r in got] == [(1, "Rain", "pluie", 1.0)]


def test_styles_and_effects(spark):
    assert style.ass_color("#10203040") == "&HBF302010" and style.ass_color("&h00ff00&") == "&H00FF00" and style.ass_color_tag("#FFD34D") == "&H4DD3FF&"
    with pytest.raises(ValueError):
        style.make_style("none such")
    with pytest.raises(ValueError):
        style.make_style("box", {"main": {"weight": 1}})
    wide = style.make_style("neon", {"main": {"fontsize": 80}}).adapt_to_layout(get_layout("1080x1920"))
    assert wide.main.fontsize == 64 and wide.translation.fontsize == 35 and wide.main.margin_v == 420 and wide.translation.margin_v == 376 and wide.effect.syllable == "glow" and style.style_to_dict(wide)["main"]["name"] == "Default"
    assert get_layout("square", font_size=40, units=30, max_lines=3).max_units == 30 and get_layout("640x360").font_size == 21
    token = "array<struct<text:string,start:double,end:double,confidence:double,space_after:boolean>>"
    lines = spark.createDataFrame([(1, 0, 1.0, 2.0, [("a{b}", 1.0, 1.2, 1.0, True), ("c", 1.5, 2.0, 1.0, False)], "x\ny", "Al", [0]), (1, 1, 2.1, 3.0, [("d", 2.1, 3.0, 1.0, False)], None, None, None)], f"doc_id int, line_no int, start double, end double, tokens {token}, translation string, speaker string, breaks array<int>")
    rows = lambda **k: [r for r in writers.write_ass(lines, **k).first()["text"].split("\n") if r.startswith("Dialogue")]
    assert rows(style="default") == ["Dialogue: 0,0:00:01.00,0:00:02.00,Default,Al,0,0,0,,a｛b｝\\Nc", "Dialogue: 0,0:00:01.00,0:00:02.00,Translation,,0,0,0,,x\\Ny", "Dialogue: 0,0:00:02.10,0:00:03.00,Default,,0,0,0,,d"]
    assert rows(bilingual=False)[0] == "Dialogue: 0,0:00:00.40,0:00:02.10,Default,Al,0,0,0,,{\\fad(150,150)}{\\kf60}{\\kf20}a｛b｝\\N{\\kf30}{\\kf50}c"
    for name, tag in (("karaoke-pop", "{\\k20\\fscx100\\fscy100\\t(500,580,\\fscx118\\fscy118)\\t(580,740,\\fscx100\\fscy100)}a"), ("bounce", "{\\k20\\fscy100\\t(300,390,\\fscy130)\\t(390,530,\\fscy100)}a"), ("neon", "{\\kf20\\3c&HFFB700&\\blur0.6\\t(500,560,\\3c&HFFE500&\\blur8)\\t(700,950,\\3c&HFFB700&\\blur0.6)}a"), ("typewriter", "{\\alpha&HFF&\\t(0,1,\\alpha&H00&)}a")):
        assert tag in rows(style=name)[0]


def test_transcripts(spark):
    token = lambda s: [(s, 0.0, 1.0, 1.0, False)]
    rows = [(1, 0, 0.0, 1.0, token("雨停"), "A"), (1, 1, 1.2, 2.0, token("了"), "A"), (1, 2, 3.0, 3.5, token("ok."), "A"), (1, 3, 4.0, 5.0, token("yes"), "B"), (1, 4, 9.0, 3700.0, token("so"), "B"), (2, 0, None, None, token("x"), None), (2, 1, 1.0, 2.0, [], None)]
    lines = spark.createDataFrame([(*r[:5], None, r[5]) for r in rows], "doc_id int, line_no int, start double, end double, tokens array<struct<text:string,start:double,end:double,confidence:double,space_after:boolean>>, translation string, speaker string")
    got = [tuple(r) for r in writers.paragraphs(lines).select("doc_id", "par_no", "speaker", "text", "end").orderBy("doc_id", "par_no").collect()]
    assert got == [(1, 0, "A", "雨停，了。 ok.", 3.5), (1, 1, "B", "yes", 5.0), (1, 2, "B", "so", 3700.0), (2, 0, None, "x", None)]
    meta = spark.createDataFrame([(1, "T", 2)], "doc_id int, title string, speakers int")
    text = {r["doc_id"]: r["text"] for r in writers.write_transcript(lines, meta).collect()}
    assert text[1] == "# T\n\n> length 01:01:40 · 2 speakers\n\n**A**  `00:00`\n\n雨停，了。 ok.\n\n**B**  `00:04`\n\nyes\n\n**B**  `00:09`\n\nso\n" and text[2].startswith("# Transcript\n\n> length 00:02\n\n`--:--`\n\nx")
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    files = {r["doc_id"]: zipfile.ZipFile(io.BytesIO(r["data"])) for r in writers.write(lines, "transcript-docx").collect()}
    said = [["".join(t.itertext()) for t in ET.fromstring(f.read("word/document.xml")).iter() if t.tag.endswith("}p")] for f in (files[1], files[2])]
    assert said[0][2:4] == ["A  00:00", "雨停，了。 ok."] and said[1] == ["Transcript", "length 00:02", "--:--", "x"] and files[1].testzip() is None
    head = spark.createDataFrame([(1, {"title": "Rain", "artist": "Me", "other": "-"})], "doc_id int, metadata map<string,string>")
    lrc = {r["doc_id"]: r["text"] for r in writers.with_header(writers.write_lrc(lines), head).collect()}
    assert lrc[1].startswith("[ti:Rain]\n[ar:Me]\n[by:cuesheet]\n[00:00.00]雨停")


def test_issues_and_report(spark):
    ref = spark.createDataFrame([(1, k, w, w, k // 3, k * 1.0, k + 0.5) for k, w in enumerate("we go home to eat rice".split())] + [(2, 0, "a", "a", 0, None, None)], "doc_id int, g_no int, text string, norm string, line_no int, start double, end double")
    hyp = spark.createDataFrame([(1, k, w, w, 10.0 + k, 10.5 + k) for k, w in enumerate("well we go hume eat rice now".split())] + [(2, 0, "a", "a", 0.0, 1.0)], "doc_id int, g_no int, text string, norm string, start double, end double")
    ops = align.align_ops(ref, hyp)
    told = align.issues(ops, ref, hyp)
    got = [(r["kind"], r["script"], r["heard"], r["start"], r["end"], r["line_no"], r["severity"]) for r in told.orderBy("op_no").collect()]
    assert got == [("extra", "", "well", 10.0, 10.5, 0, "high"), ("substitution", "hometo", "hume", 13.0, 13.5, 0, "high"), ("extra", "", "now", 16.0, 16.5, 1, "high")]
    text = {r["doc_id"]: r["text"] for r in align.issue_report(told, align.error_rate(ops, "doc_id")).collect()}
    assert "66.67%, 3 differences (3 significant)" in text[1] and "! [00:00:13.000] line 1 substitution: script 「hometo」 heard 「hume」" in text[1] and "0.00%, 0 differences" in text[2]


def test_lines_as_shown(spark):
    token = "array<struct<text:string,start:double,end:double,confidence:double,space_after:boolean>>"
    df = spark.createDataFrame([([("a", 0.0, 1.0, 1.0, True), ("b", 1.0, 2.0, 1.0, True), ("c", 2.0, 3.0, 1.0, False)], [0, 2], 1.0, None), ([], None, 2.0, 1.0)], f"t {token}, b array<int>, start double, end double")
    got = df.select(schema.display_rows(F.col("t"), F.col("b")).alias("r"), schema.duration(F.col("start"), F.col("end")).alias("d"), schema.timed(F.col("start"), F.col("end")).alias("ok")).collect()
    assert [tuple(r) for r in got] == [(["a", "b c"], 0.0, False), ([""], 0.0, True)]


def test_stamps(spark):
    r = spark.range(1).select(ts_srt(F.lit(3661.0015)).alias("a"), ts_ass(F.lit(-1.0)).alias("b"), ts_lrc(F.lit(6000.0)).alias("c"), parse_ts(F.lit("1:00:01.5")).alias("d"), parse_ts(F.lit("x")).alias("e")).first()
    assert tuple(r) == ("01:01:01,002", "0:00:00.00", "100:00.00", 3601.5, None)
    none = spark.createDataFrame([(1, None, 2.0), (1, 4.0, 5.0)], "k int, start double, end double")
    assert [tuple(x) for x in timing.shift(none, -3).select("start", "end").collect()] == [(None, 0.0), (1.0, 2.0)] and none.select(ts_srt(F.col("start")).alias("t")).first()["t"] == "00:00:00,000"
    slots = rank.slot(spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 3.0), (1, 2.1, 4.0)], "k int, start double, end double"), ["k"], "start", "end").orderBy("start").collect()
    assert [round(x["slot"], 6) for x in slots] == [1.92, 0.2, 2.9]


def test_frame_plan(spark):
    shots = spark.createDataFrame([(1, 0, 10, 0, 0), (1, 10, 20, 30, 4)], "k int, o0 long, o1 long, off long, fade int")
    got = {}
    for r in cut.frame_plan(shots, ["k"]).collect():
        got.setdefault(r["frame"], []).append((r["source"], r["weight"]))
    assert sorted(got) == list(range(20)) and sorted(got[8]) == [(8, 0.875), (38, 0.125)] and all(abs(sum(w for _, w in v) - 1) < 1e-9 for v in got.values())


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k int, start double, end double, weight double, at double")
    assert timing.merge_intervals(e, ["k"]).count() == 0 and timing.fill_missing(e, ["k"], ["at"]).count() == 0 and timing.enforce_monotonic(e, ["k"], ["at"]).count() == 0


def test_streaming_sessions(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.pause_sessions(stream, "user_id", "ts").writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    batch = sessions.pause_sessions(df, "user_id", "ts")
    assert spark.table("s").count() == batch.count() and spark.table("s").agg(F.sum("n")).first()[0] == df.count()


def test_frame_plan_of_every_order(spark, duck):
    got = QUERIES["frame_plan"](spark, SF).groupBy("l_orderkey").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.round(F.sum("weight"), 3).alias("frames")).toPandas()
    want = duck.execute("SELECT l_orderkey, 0::BIGINT AS first, sum(l_quantity::BIGINT + 8)::BIGINT - 1 AS last, sum(l_quantity::BIGINT + 8)::DOUBLE AS frames FROM lineitem GROUP BY ALL").df()
    assert rows(got) == rows(want)


def test_every_turn_meets_the_next(spark, duck):
    pairs = rows(duck.execute("SELECT conv_id AS doc_id, turn FROM conversations QUALIFY lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL").df())
    rate = QUERIES["align_error_rate"](spark, SF).toPandas()
    assert rows(rate[["doc_id", "turn"]]) == pairs
    timed = QUERIES["transfer_times"](spark, SF).groupBy("doc_id", "turn").count().toPandas()
    assert rows(timed[["doc_id", "turn"]]) == pairs
    assert set(map(tuple, QUERIES["diff_report_issues"](spark, SF).select("doc_id", "turn").distinct().collect())) == {(r.doc_id, r.turn) for r in rate.itertuples() if r.error_rate > 0}


def test_embedding_queries_read_every_vector(spark, duck):
    """All vectors in clusters of their document."""
    ids = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").df()
    v = np.stack(ids["embedding"].tolist()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = QUERIES["cluster_upgma"](spark, SF).toPandas().sort_values("vec_id")
    assert got["vec_id"].tolist() == ids["vec_id"].tolist() and got.groupby("doc").size().max() <= 60
    for _, part in got.groupby("doc"):
        assert part["cluster"].tolist() == upgma(v[part["vec_id"]], 0.45).tolist()
