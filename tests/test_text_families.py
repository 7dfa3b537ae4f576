"""Numbers in words, speech scripts, syllables, sentences and recognised tokens."""

import random

import pytest
from pyspark.sql import functions as F

from cuesheet.catalog import ORACLE, QUERIES
from cuesheet.functions import numbers, speech, syllables
from cuesheet.operators import recognition, sentences

SF = "/root/testdata/sf0.001"


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def count_en(words):
    """The number that English words say."""
    small = {w: k for k, w in enumerate(numbers.ONES)} | {w: 10 * k + 20 for k, w in enumerate(numbers.TENS)}
    scale = {name: size for size, name in numbers.SCALES}
    total = group = 0
    for w in words.replace("-", " ").split():
        if w in scale:
            total, group = total + group * scale[w], 0
        elif w == "hundred":
            group *= 100
        else:
            group += small[w]
    return total + group


def count_cn(said):
    """The number that Chinese characters say."""
    total = section = digit = 0
    for c in said.replace("万亿", "兆").replace("两", "二"):
        if c in numbers.DIGITS:
            digit = numbers.DIGITS.index(c)
        elif c in "十百千":
            section += (digit or 1) * 10 ** ("十百千".index(c) + 1)
            digit = 0
        else:
            total = total + (section + digit) * {"万": 10**4, "亿": 10**8, "兆": 10**12}[c]
            section = digit = 0
    return total + section + digit


def test_numbers_say_themselves(spark):
    random.seed(4)
    values = sorted({0, 7, 10, 15, 20, 100, 108, 110, 1000, 1006, 1050, 2000, 2200, 10_000, 20_002, 100_400, 10**8, 10**8 + 1, 10**12, 3 * 10**12 + 5} | {random.randrange(10 ** random.randint(1, 14)) for _ in range(300)})
    df = spark.createDataFrame([(v,) for v in values], "n long")
    for n, en, cn, plain in df.select("n", numbers.en_integer(F.col("n")), numbers.cn_integer(F.col("n")), numbers.cn_integer(F.col("n"), False)).collect():
        assert count_en(en) == count_cn(cn) == count_cn(plain) == n and "零零" not in cn and "两" not in plain and (n == 0 or not cn.endswith("零"))
        assert en == numbers.int_to_en(n) and cn == numbers.int_to_cn(n) and plain == numbers.int_to_cn(n, False)
    assert numbers.int_to_cn(-14) == "负十四" and numbers.int_to_cn(2200) == "两千二百" and numbers.int_to_en(-14) == "minus fourteen" and numbers.num_to_cn("-0.50") == "负零点五零" and numbers.num_to_cn("0012") == "零零一二"


@pytest.mark.parametrize("text, said", [
    ("于2031/7/9到", "于二零三一年七月九日到"), ("1998年", "一九九八年"), ("7:05见, 12:00:30", "七点零五分见, 十二点三十秒"), ("€2.5", "二点五欧元"), ("-4%", "百分之负四"), ("7k粉", "七千粉"),
    ("-12度", "零下十二度"), ("021-66668888", "零二一，六六六六八八八八"), ("6~8", "六到八"), ("2/5", "五分之二"), ("9kg", "九公斤"), ("15912340000", "一五九一二三四零零零零"), ("V3.1", "V三点一"), ("H2O和B12", "H2O和B12"), ("88,000", "八万八千"),
])
def test_reading(text, said):
    assert numbers.read_numbers(text) == said


@pytest.mark.parametrize("token, said", [("1994", "nineteen ninety-four"), ("1906", "nineteen oh six"), ("2000", "two thousand"), ("12.05%", "twelve point zero five percent"), ("£30", "thirty pounds"), ("7:15", "seven fifteen"), ("8,400", "eight thousand four hundred"), ("x1", "x1")])
def test_reading_english(token, said):
    assert numbers.number_to_en(token) == said


def test_scripts():
    assert speech.normalize("## 第2课\n* 看https://a.b/c 这里（略）！！嘻嘻嘻嘻嘻") == "第二课\n看这里！嘻嘻嘻"
    assert speech.normalize("<行|hang2>业3&5，“好”", True) == "<行|hang2>业三和五，好"
    assert speech.normalize("Wait…so ,yes！ A=B", lang="en") == "Wait... so, yes! A equals B"
    assert speech.to_engine("<重|快>跑<停|1>去<行|xing2>") == ("快跑去<行|XING2>", ["快"]) and speech.to_engine("<行|xing2>", False) == ("行", [])
    got = speech.split_segments("先停一下<停|0.7>再说吧。好。\n第二段话在这里")
    assert [(s["text"], s["pause_after"], s["paragraph_end"]) for s in got] == [("先停一下，", 0.7, False), ("再说吧。好。", 0.8, True), ("第二段话在这里。", 0.45, True)]
    long_ = speech.split_segments("一二三四五六七八，" * 20)
    assert len(long_) > 1 and all(speech.plain_length(s["text"]) <= 60 for s in long_) and "".join(s["text"] for s in long_) == "一二三四五六七八，" * 20
    en = speech.split_segments("Mind the gap. Ok then. " + "over the hills, " * 15 + "home", "en")
    assert [s["text"] for s in en][0] == "Mind the gap. Ok then." and all(len(s["text"]) <= 150 for s in en) and en[-1]["text"].endswith("home.")
    assert speech.split_segments("") == [] and speech.split_segments("  \n ", "en") == []


def test_prepare_of_a_table(spark):
    df = spark.createDataFrame([(1, "有3只", "zh"), (2, None, "zh"), (3, "", "en"), (4, "one…two", None)], "k int, t string, la string")
    got = {r["k"]: r["p"] for r in df.select("k", speech.prepare(F.col("t"), F.col("la")).alias("p")).collect()}
    assert got[1]["text"] == "有三只" and got[1]["segments"][0]["text"] == "有三只。" and got[2]["text"] is None and got[2]["segments"] is None and got[3]["segments"] == [] and len(got[4]["segments"]) == 1
    assert [r[0] for r in df.select(speech.spoken(F.col("t"), F.col("la"))).collect()] == ["有三只", None, "", "one…two"]


def test_profile(spark):
    df = spark.createDataFrame([(1, "A USB cable, $3!", "en"), (2, "2031年见", "zh"), (3, "ちょっと", "ja"), (4, "한강", "ko"), (5, None, "en"), (6, "...", "en"), (7, "les amies", "fr-CA"), (8, "東京", "ja"), (9, "ไทยแลนด์", "th")], "k int, text string, lang string")
    units = syllables.profile(df, ["k"])
    got = {}
    for r in units.orderBy("k", "unit_no").collect():
        got.setdefault(r["k"], []).append((r["unit"], r["start"], r["end"], round(r["syllables"], 2), round(r["phonemes"], 2)))
    text = {r["k"]: r["text"] for r in df.collect()}
    assert all(text[k][a:b] == u for k, us in got.items() for u, a, b, *_ in us) and set(got) == {1, 2, 3, 4, 7, 8, 9}
    assert [(u, s) for u, _, _, s, _ in got[1]] == [("A", 1), ("USB", 3), ("cable", 2), ("$3", 3)]
    assert got[2][0][3:] == (4, 8) and [s for *_, s, _ in got[3]] == [1, 0, 1, 1] and [p for *_, p in got[4]] == [3, 3] and got[8][0][3:] == (1.7, 3.0)
    assert {r["k"]: r["syllables"] for r in syllables.count(units, ["k"]).collect()}[1] == 9
    at = {r["k"]: r["position"] for r in syllables.position(units, ["k"], F.lit(5)).collect()}
    assert at[1] == pytest.approx(4 / 9, abs=1e-3) and at[2] == pytest.approx(5 / 6, abs=1e-3)


def test_sentences_of_text(spark):
    df = spark.createDataFrame([(1, "One. Two v1.5 here? Yes\n\n\"Third.\" End", "en"), (2, "一。二！？三", "zh-TW"), (3, None, "en"), (4, " \n", "zh"), (5, "no lang. Ok", None)], "k int, t string, la string")
    got = {r[0]: r[1] for r in df.select("k", sentences.from_text(F.col("t"), F.col("la"))).collect()}
    assert got == {1: ["One.", "Two v1.5 here?", "Yes", '"Third." End'], 2: ["一。", "二！？", "三"], 3: None, 4: [], 5: ["no lang.", "Ok"]}


LINES = "doc_id int, line_no int, text string, start double, end double, speaker string, tokens array<struct<text:string,start:double,end:double,confidence:double,space_after:boolean>>, times array<struct<offset:int,start:double>>"


def test_joined_lines(spark):
    rows = [(1, 0, " we went", 0.0, 1.0, "a", None, [(1, 0.0)]), (1, 1, "to town!", 1.2, 2.0, "a", None, [(0, 1.2), (3, 1.6)]), (1, 2, "then", 2.1, 3.0, "a", None, []), (1, 3, "home", 3.1, 4.0, "b", None, None), (1, 4, " ", 4.0, 5.0, "b", None, []), (1, 5, "late", 20.0, 21.0, "b", None, []), (2, 0, "你", 0.0, 1.0, None, None, []), (2, 1, "好", 1.1, 2.0, None, None, [(0, 1.1)])]
    got = rows_of(sentences.joined_lines(spark.createDataFrame(rows, LINES)).drop("times"), "doc_id", "id")
    assert got == [(1, 1, "we went to town!", 0.0, 2.0, "a"), (1, 2, "then", 2.1, 3.0, "a"), (1, 3, "home", 3.1, 4.0, "b"), (1, 4, "late", 20.0, 21.0, "b"), (2, 1, "你好", 0.0, 2.0, None)]
    times = {(r["doc_id"], r["id"]): [tuple(t) for t in r["times"]] for r in sentences.joined_lines(spark.createDataFrame(rows, LINES)).collect()}
    assert times[1, 1] == [(0, 0.0), (8, 1.2), (11, 1.6)] and times[2, 1] == [(1, 1.1)]


def test_timeline_and_resegment(spark):
    own = [("alpha", 0.0, 0.4, 1.0, True), ("beta.", 0.5, 0.9, 1.0, False)]
    rows = [(1, 0, "alpha beta.", 0.0, 1.0, "x", own, []), (1, 1, "one two three", 1.0, 2.0, "x", None, []), (1, 2, "one two three four.", 2.0, 3.0, "x", None, []), (1, 3, None, 3.0, 4.0, "x", None, []), (1, 4, "Mr. Fox left.", 9.0, 10.0, "x", None, []), (1, 5, "Bye.", 10.1, 10.5, "y", None, [])]
    words = sentences.timeline(spark.createDataFrame(rows, LINES))
    got = rows_of(words.select("text", "start", "end", "space"), "start")
    assert [g[0] for g in got] == ["alpha", "beta.", "one", "two", "three", "four.", "Mr.", "Fox", "left.", "Bye."] and got[1][1:3] == (0.5, 0.9) and got[5][1:3] == (2.0, 3.0) and got[2][1:3] == (1.0, 1.333)
    assert [g[3] for g in got] == [True] * 9 + [False]
    out = rows_of(sentences.resegment(words).select("id", "text", "speaker"), "id")
    assert out == [(1, "alpha beta. one two three four.", "x"), (2, "Mr. Fox left.", "x"), (3, "Bye.", "y")]
    bare = [(2, k, f"w{k}", k * 1.0, k + (0.2 if k % 4 == 3 else 0.9), None, None, []) for k in range(12)]
    by_pause = rows_of(sentences.resegment(sentences.timeline(spark.createDataFrame(bare, LINES))).select("id", "n_words"), "id")
    assert [n for _, n in by_pause] == [4, 4, 4]


def brute_halves(start, end, clause, most, units, base=0):
    n = len(start)
    if n < 4 or (end[-1] - start[0] <= most and n <= units):
        return []
    at = [k + 1 for k in range(1, n - 2) if clause[k]]
    pauses = sorted((start[k + 1] - end[k], k + 1) for k in range(1, n - 2))
    cut = min(at, key=lambda k: abs(k - n / 2)) if at else pauses[-1][1] if pauses and pauses[-1][0] >= 0.15 else n // 2
    return sorted([base + cut, *brute_halves(start[:cut], end[:cut], clause[:cut], most, units, base), *brute_halves(start[cut:], end[cut:], clause[cut:], most, units, base + cut)])


def test_halves():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 60)
        start = [k + r.random() * 0.3 for k in range(n)]
        end = [s + r.random() * 0.7 for s in start]
        clause = [r.random() < 0.1 for _ in range(n)]
        most, units = r.choice([3.0, 8.0, 100.0]), r.choice([5, 20])
        assert sentences.halves(start, end, clause, most, units) == brute_halves(start, end, clause, most, units)


def test_recognition(spark):
    words = spark.createDataFrame([(1, 0, 0, " Hello", 0.0, 0.4, 0.9), (1, 0, 1, " 你好", 0.4, 0.8, 0.5), (1, 0, 2, "...", 0.8, 0.9, 0.4), (1, 1, 0, "end", 1.0, 1.5, 1.0)], "doc_id int, seg_no int, word_no int, text string, start double, end double, prob double")
    tokens = recognition.segment_tokens(words, ["doc_id", "seg_no"])
    got = rows_of(tokens.select("seg_no", "tok_no", "text", "start", "end", F.round("confidence", 3), "space_after"), "seg_no", "tok_no")
    assert got == [(0, 0, "Hello", 0.0, 0.4, 0.9, True), (0, 1, "你", 0.4, pytest.approx(0.6), 0.4, False), (0, 2, "好", pytest.approx(0.6), 0.8, 0.4, False), (0, 3, "...", 0.8, 0.9, 0.4, False), (1, 0, "end", 1.0, 1.5, 1.0, False)]
    stream = rows_of(recognition.transcript_tokens(tokens, "doc_id").select("g_no", "space_after"), "g_no")
    assert stream == [(0, True), (1, False), (2, False), (3, True), (4, False)]
    lines = rows_of(recognition.to_lines(tokens, "doc_id").select("line_no", "start", "end", F.size("tokens")), "line_no")
    assert lines == [(0, 0.0, 0.9, 4), (1, 1.0, 1.5, 1)]
    spread = rows_of(recognition.spread_segments(spark.createDataFrame([(1, "ab, table", 1.0, 2.5)], "k int, text string, start double, end double"), ["k"]).select("text", "start", "end"), "start")
    assert spread == [("ab,", 1.0, 1.5), ("table", 1.5, 2.5)]


def test_recognition_json_and_stamps(spark):
    js = '{"language":"en","duration":3.0,"text":"a b c","words":[{"word":"a","start":0.1,"end":0.4},{"word":"b","start":0.5,"end":0.9},{"word":"好","start":1.2,"end":1.4},{"word":"d","start":9.0,"end":9.5}],"segments":[{"start":0,"end":1,"text":"a b"},{"start":1,"end":2,"text":"c"}]}'
    df = spark.createDataFrame([(1, js), (2, "no json"), (3, None), (4, '{"duration":2,"text":"x","words":[{"word":"x","start":0,"end":1}]}')], "k int, json string")
    got = rows_of(recognition.verbose_words(df, "k").select("k", "seg_no", "word_no", "text"), "k", "word_no")
    assert got == [(1, 0, 0, "a"), (1, 0, 1, " b"), (1, 1, 2, "好"), (1, 1, 3, " d"), (4, 0, 0, "x")]
    st = spark.createDataFrame([(1, "hi 你", [(0, 500), (600, 900)]), (2, "hi 你 x", [(0, 900)]), (3, "hi", [])], "k int, text string, stamps array<struct<from:long,to:long>>")
    got = rows_of(recognition.stamped_words(st, ["k"]).select("k", "text", "start", "end", "prob"), "k", "start")
    assert got[:2] == [(1, "hi ", 0.0, 0.5, 1.0), (1, "你", 0.6, 0.9, 1.0)] and [g[1:] for g in got[2:]] == [("hi", 0.0, pytest.approx(0.3), 0.5), ("你", pytest.approx(0.3), pytest.approx(0.6), 0.5), ("x", pytest.approx(0.6), pytest.approx(0.9), 0.5)]


def test_anchors(spark):
    df = spark.createDataFrame([("Today Ms Poe met 12 people from New York, not The end. Oslo",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(sentences.heuristic_anchors(F.col("t"))).collect()]
    assert [tuple(a) for a in got[0]] == [("Today Ms Poe", 0), ("12", 17), ("New York", 32), ("Oslo", 55)] and got[1] == [] and got[2] is None


@pytest.mark.parametrize("name", ["numbers_in_words", "sentence_split", "timeline_words", "recognised_tokens"])
def test_catalog(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in "orders documents conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = QUERIES[name](spark, SF).toPandas(), c.execute(ORACLE[name]).df()
    assert sorted(map(str, a[sorted(a)].itertuples(index=False, name=None))) == sorted(map(str, b[sorted(b)].itertuples(index=False, name=None)))
