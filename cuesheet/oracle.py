"""DuckDB SQL with the same rows as the catalog's queries."""

from __future__ import annotations

from .functions.numbers import DIGITS, GROUPS, LIANG, ONES, PLACES, SCALES, SHORTEN, TENS
from .functions.text import CREDIT, VOWELS, WORD
from .functions.style import ass_head, make_style
from .operators.layout import LAYOUTS
from .operators.screen import STRONG, WEAK

HOUR = 3_600_000_000
ASS_HEAD = ass_head(make_style("karaoke").adapt_to_layout(LAYOUTS["landscape"]), LAYOUTS["landscape"], "cuesheet")
TRACKS = """tracks AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS start, epoch_us(ts) + floor(abs(value) * 1000000)::BIGINT + 1 AS "end" FROM events)"""
CUES = (
    TRACKS
    + """, raw AS (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) - 1 AS line_no,
    floor((start - min(start) OVER (PARTITION BY user_id)) / 1000)::BIGINT AS a, floor(abs(value) * 10)::BIGINT + 2 AS d FROM tracks),
cues AS (SELECT *, a + floor(d / 2)::BIGINT AS m, a + d AS b, event_type || ' ' || event_id AS line FROM raw)"""
)
LINES = """lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line_no
  FROM (SELECT doc_id, trim(x) AS line, k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)) WHERE line <> '')"""


def clock(ms: str, form: str = "%02d:%02d:%02d,%03d") -> str:
    """SQL of a stamp with hours from whole milliseconds."""
    return f"printf('{form}', ({ms} // 3600000), ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


def stamp(cs: str) -> str:
    """SQL of an LRC stamp from whole centiseconds."""
    return f"printf('%02d:%02d.%02d', {cs} // 6000, ({cs} // 100) % 60, {cs} % 100)"


def cs(ms: str) -> str:
    return f"round_even({ms} / 1000.0::DOUBLE * 100, 0)::BIGINT"


def in_english(n: str) -> str:
    """SQL of a whole number above 0 in words."""
    word = lambda words, k: f"list_extract({list(words)}, ({k}) + 1)"

    def group(x: str) -> str:
        low = f"CASE WHEN {x} % 100 < 20 THEN {word(ONES, f'{x} % 100')} ELSE {word(['', '', *TENS], f'{x} % 100 // 10')} || CASE WHEN {x} % 10 > 0 THEN '-' || {word(ONES, f'{x} % 10')} ELSE '' END END"
        return f"concat_ws(' ', CASE WHEN {x} >= 100 THEN {word(ONES, f'{x} // 100')} || ' hundred' END, CASE WHEN {x} % 100 > 0 THEN {low} END)"

    parts = [f"CASE WHEN {n} // {d} % 1000 > 0 THEN {group(f'({n} // {d} % 1000)')} || ' {name}' END" for d, name in SCALES]
    return f"CASE WHEN {n} = 0 THEN 'zero' ELSE concat_ws(' ', {', '.join(parts)}, CASE WHEN {n} % 1000 > 0 THEN {group(f'({n} % 1000)')} END) END"


def in_chinese(n: str, liang: bool) -> str:
    """SQL of a whole number in Chinese: every digit with its unit, then the rewriting rules."""
    k = f"(length({n}::VARCHAR) - i)"
    said = f"list_reduce(list_transform(range(1, length({n}::VARCHAR) + 1), lambda i: translate(substring({n}::VARCHAR, i, 1), '0123456789', '{DIGITS}') || list_extract({list(PLACES)}, {k} % 4 + 1) || CASE WHEN {k} % 4 = 0 THEN list_extract({list(GROUPS)}, {k} // 4 + 1) ELSE '' END), lambda a, b: a || b)"
    for pattern, to in (*SHORTEN, *(LIANG if liang else ())):
        said = f"regexp_replace({said}, '{pattern}', '{to}', 'g')"
    return said


def written(row: str, joiner: str = "chr(10)", head: str = "", tail: str = "", source: str = "cues") -> str:
    text = f"'{head}' || string_agg({row}, {joiner} ORDER BY line_no) || {tail or chr(39) * 2}"
    return f"WITH {CUES}, texts AS (SELECT user_id, {text} AS text FROM {source} GROUP BY user_id) SELECT user_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM texts"


SPAN = "'[' || a || ',' || d || ']'"
NL = "chr(10)"
BY = "[by:cuesheet]\n"
GONE = f"CASE WHEN nxt IS NULL OR nxt / 1000.0::DOUBLE - b / 1000.0::DOUBLE >= 2.0 THEN chr(10) || '[' || {stamp(cs('b'))} || ']' ELSE '' END"

def _vtt(ms: str) -> str:
    return clock(ms, "%02d:%02d:%02d.%03d")


#: Cues as the ASS writer shows them: from, until, and the karaoke clock of their two tokens.
ASS_CUES = """, shown AS (SELECT *, a / 1000.0::DOUBLE AS s, b / 1000.0::DOUBLE AS e, m / 1000.0::DOUBLE AS h FROM cues),
around AS (SELECT *, lag(e) OVER w AS e0, lead(s) OVER w AS s1 FROM shown WINDOW w AS (PARTITION BY user_id ORDER BY line_no)),
timed AS (SELECT *, least(s, greatest(coalesce(e0, 0.0::DOUBLE), s - 0.6::DOUBLE)) AS from_t, CASE WHEN s1 IS NULL THEN e + 0.3::DOUBLE ELSE least(e + 0.3::DOUBLE, greatest(e, s1)) END AS until_t FROM around),
clocked AS (SELECT *, round_even((s - from_t) * 100, 0)::BIGINT AS k0, round_even((h - from_t) * 100, 0)::BIGINT AS k1, round_even((e - from_t) * 100, 0)::BIGINT AS k2 FROM timed)"""


def ass_stamp(t: str) -> str:
    cs = f"round_even({t} * 100, 0)::BIGINT"
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100)"


SQL: dict[str, str] = {
    "flagship": f"""WITH {LINES}, words AS (
  SELECT doc_id, line_no, list_transform(regexp_extract_all(line, '{WORD.replace("'", "''")}'), lambda w: regexp_replace(lower(w), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')) AS ks FROM lines),
weights AS (SELECT doc_id, line_no, len(ks) AS n_tokens, 0.25 * list_sum(list_transform(ks, lambda k: CASE WHEN k = '' THEN 0.3 WHEN regexp_matches(k, '^[0-9]+$') THEN greatest(1.0, length(k) * 0.9)
    ELSE greatest(1, len(regexp_extract_all(k, '[{VOWELS}]+')) - CASE WHEN suffix(k, 'e') AND NOT suffix(k, 'le') AND NOT suffix(k, 'ee') AND len(regexp_extract_all(k, '[{VOWELS}]+')) > 1 THEN 1 ELSE 0 END)::DOUBLE END)) AS duration FROM words WHERE len(ks) > 0)
SELECT lang, count(*)::BIGINT AS n_lines, sum(n_tokens)::BIGINT AS n_tokens, round(avg(n_tokens), 6) AS mean_tokens, round(quantile_cont(duration, 0.95), 6) AS p95_duration FROM weights JOIN documents USING (doc_id) GROUP BY lang""",
    "lines_from_text": f"WITH {LINES} SELECT doc_id, line_no::BIGINT AS line_no, line FROM lines",
    "token_counts": f"""WITH {LINES}, n AS (SELECT doc_id, count(*)::BIGINT AS n_lines, sum(len(regexp_extract_all(line, '{WORD.replace("'", "''")}')))::BIGINT AS n_tokens FROM lines GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_tokens, 0)::BIGINT AS n_tokens FROM documents LEFT JOIN n USING (doc_id)""",
    "tokenize_units": f"""SELECT item_id, len(regexp_extract_all(text, '{WORD.replace("'", "''")}'))::BIGINT AS n_tokens FROM benchmark""",
    "syllable_weight_sum": f"""WITH w AS (SELECT item_id, regexp_replace(lower(unnest(regexp_extract_all(text, '{WORD.replace("'", "''")}'))), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g') AS k FROM benchmark),
g AS (SELECT *, len(regexp_extract_all(k, '[{VOWELS}]+')) AS n FROM w)
SELECT item_id, count(*)::BIGINT AS n, round(sum(CASE WHEN k = '' THEN 0.3 WHEN regexp_matches(k, '^[0-9]+$') THEN greatest(1.0, length(k) * 0.9)
  ELSE greatest(1, n - CASE WHEN suffix(k, 'e') AND n > 1 AND NOT suffix(k, 'le') AND NOT suffix(k, 'ee') THEN 1 ELSE 0 END)::DOUBLE END), 6) AS weight FROM g GROUP BY item_id""",
    "syllables_en": r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS word FROM benchmark),
a AS (SELECT word, regexp_replace(lower(word), '[^a-z]', '', 'g') AS k FROM w WHERE word <> ''),
b AS (SELECT *, regexp_replace(regexp_replace(k, '(?:[^laeiouysxzcgh]es|[^laeiouytd]ed|[^aeiouy]e)$', ''), '^y', '') AS s FROM a)
SELECT word, (CASE WHEN k = '' THEN 0 WHEN length(k) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(s, '[aeiouy]{1,2}')) + len(regexp_extract_all(s, 'ia|io|eat|eo|ua|uo|iet'))
  + CASE WHEN regexp_matches(k, '[^aeiouy]le$') THEN 1 ELSE 0 END) END)::BIGINT AS syllables FROM b""",
    "guess_language": r"""WITH n AS (SELECT doc_id, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS latin, length(text) - length(regexp_replace(text, '[\x{3040}-\x{30FF}]', '', 'g')) AS kana,
  length(text) - length(regexp_replace(text, '[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}]', '', 'g')) AS hangul, length(text) - length(regexp_replace(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]', '', 'g')) AS han FROM documents)
SELECT doc_id, CASE WHEN han + kana + hangul = 0 THEN CASE WHEN latin >= 20 THEN 'en' END WHEN kana >= 0.1 * (han + kana + hangul) THEN 'ja' WHEN hangul >= 0.3 * (han + kana + hangul) THEN 'ko'
  WHEN han >= greatest(kana, hangul) AND han * 2 >= latin / 4 THEN 'zh' END AS guess FROM n""",
    "credit_lines": f"""WITH {LINES} SELECT doc_id, line_no::BIGINT AS line_no, line FROM lines WHERE regexp_matches(line, '{CREDIT}')
  OR (line_no <= 1 AND regexp_matches(line, '\\s-|-\\s') AND trim(split_part(line, '-', 1)) <> '' AND trim(substr(line, instr(line, '-') + 1)) <> '')""",
    "strip_tags": r"WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '\{[^}]*\}', '', 'g'), '<[^>]+>', '', 'g') AS x FROM pages) SELECT page_id, length(x)::BIGINT AS n_chars, md5(x) AS digest FROM s",
    "clean_links": r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', '', 'g'), '\[([^\[\]]+)\]\([^()]+\)', '\1', 'g'), '(?m)^\s{0,3}(#{1,6}|>|[-*+]|\d+[.)])\s+', '', 'g'), '\*\*|__|`', '', 'g') AS x FROM documents)
SELECT doc_id, length(x)::BIGINT AS n_chars, md5(x) AS digest FROM s""",
    "text_widths": "SELECT item_id, length(text)::BIGINT AS width FROM benchmark",
    "time_stamps": f"""WITH v AS (SELECT event_id, round_even(abs(value) * 97.31::DOUBLE * 1000, 0)::BIGINT AS ms, round_even(abs(value) * 97.31::DOUBLE * 100, 0)::BIGINT AS cs FROM events)
SELECT event_id, {clock('ms')} AS srt, {clock('ms', '%02d:%02d:%02d.%03d')} AS vtt, {clock('ms', '%d:%02d:%02d.%03d')} AS sbv, printf('%d:%02d:%02d.%02d', cs // 360000, (cs // 6000) % 60, (cs // 100) % 60, cs % 100) AS ass,
  {stamp('cs')} AS lrc, printf('%02d:%02d.%03d', ms // 60000, (ms // 1000) % 60, ms % 1000) AS lrc_ms FROM v""",
    "parse_stamps": """SELECT event_id, round_even(abs(value) * 97.31::DOUBLE * 1000, 0)::BIGINT AS srt_ms, round_even(abs(value) * 97.31::DOUBLE * 100, 0)::BIGINT * 10 AS ass_ms, round_even(abs(value) * 97.31::DOUBLE * 100, 0)::BIGINT * 10 AS lrc_ms FROM events""",
    "write_srt": written(f"(line_no + 1) || {NL} || {clock('a')} || ' --> ' || {clock('b')} || {NL} || line || {NL}"),
    "write_vtt": written(f"{clock('a', '%02d:%02d:%02d.%03d')} || ' --> ' || {clock('b', '%02d:%02d:%02d.%03d')} || {NL} || line || {NL}", head="WEBVTT\n\n"),
    "write_sbv": written(f"{clock('a', '%d:%02d:%02d.%03d')} || ',' || {clock('b', '%d:%02d:%02d.%03d')} || {NL} || line || {NL}"),
    "write_txt": written("line", tail=NL),
    "write_lrc": written(f"'[' || {stamp(cs('a'))} || ']' || line || {GONE}", head=BY, tail=NL, source="(SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY line_no) AS nxt FROM cues)"),
    "write_lrc_enhanced": written(f"'[' || {stamp(cs('a'))} || ']<' || {stamp(cs('a'))} || '>' || event_type || ' <' || {stamp(cs('m'))} || '>' || event_id || '<' || {stamp(cs('b'))} || '>'", head=BY, tail=NL),
    "write_lrc_word": written(f"'[' || {stamp(cs('a'))} || ']' || event_type || ' [' || {stamp(cs('m'))} || ']' || event_id || '[' || {stamp(cs('b'))} || ']'", head=BY, tail=NL),
    "write_qrc": written(f"{SPAN} || event_type || ' (' || a || ',' || (m - a) || ')' || event_id || '(' || m || ',' || (b - m) || ')'", tail=NL),
    "write_yrc": written(f"{SPAN} || '(' || a || ',' || (m - a) || ',0)' || event_type || ' (' || m || ',' || (b - m) || ',0)' || event_id", tail=NL),
    "write_krc": written(f"{SPAN} || '<0,' || (m - a) || ',0>' || event_type || ' <' || (m - a) || ',' || (b - m) || ',0>' || event_id", head="[id:$00000000]\n[offset:0]\n", tail=NL),
    "krc_sealed_round_trip": "SELECT user_id, count(*)::BIGINT AS n_lines FROM events GROUP BY user_id",
    "json_round_trip": "SELECT user_id, count(*)::BIGINT AS n_lines, (2 * count(*))::BIGINT AS n_tokens FROM events GROUP BY user_id",
    "sniff_formats": "SELECT f AS written, f AS told, (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS n FROM (SELECT unnest(['srt', 'vtt', 'sbv', 'lrc', 'qrc', 'yrc', 'krc', 'ass']) AS f)",
    "update_bounds": f'WITH {TRACKS} SELECT user_id, min(start) AS start, max("end") AS "end" FROM tracks GROUP BY user_id',
    "shift_times": f'WITH {TRACKS}, z AS (SELECT event_id, start, "end", min(start) OVER (PARTITION BY user_id) AS zero FROM tracks) SELECT event_id, greatest(0, start - zero - {3 * HOUR})::BIGINT AS start, greatest(0, "end" - zero - {3 * HOUR})::BIGINT AS "end" FROM z',
    "split_by_pauses": f"""WITH {TRACKS}, g AS (SELECT *, CASE WHEN start - lag("end") OVER w >= {6 * HOUR} THEN 1 ELSE 0 END AS new FROM tracks WINDOW w AS (PARTITION BY user_id ORDER BY start, "end")),
p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM g)
SELECT user_id, part, min(start) AS start, max("end") AS "end", count(*)::BIGINT AS n FROM p GROUP BY user_id, part""",
    "interpolate_weights": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS done FROM lineitem)
SELECT l_orderkey, l_linenumber, round(100 * (done - q) / total, 6) AS start, round(100 * done / total, 6) AS "end" FROM x""",
    "numbers_in_words": f"""WITH x AS (SELECT o_orderkey, o_orderkey * 7919 AS n FROM orders)
SELECT o_orderkey, {in_english('n')} AS en, {in_chinese('n', True)} AS cn, {in_chinese('n', False)} AS cn_plain, translate(o_orderkey::VARCHAR, '0123456789', '{DIGITS}') AS digits FROM x""",
    "sentence_split": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS a FROM documents),
m AS (SELECT doc_id, a, string_split(regexp_replace(trim(line), '([.!?…;])\\s+(["''“‘(]?[A-Z0-9À-ɏ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM l WHERE trim(line) <> ''),
s AS (SELECT doc_id, a, trim(unnest(ss)) AS s, generate_subscripts(ss, 1) AS b FROM m)
SELECT doc_id, count(*)::BIGINT AS n, max(length(s))::BIGINT AS longest, md5(string_agg(s, '|' ORDER BY a, b)) AS digest FROM s WHERE s <> '' GROUP BY doc_id""",
    "timeline_words": """WITH w AS (SELECT conv_id, turn, (turn * 10)::DOUBLE AS a, turn * 10 + least(10.0, length(text) / 12.0::DOUBLE) AS b, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations WHERE trim(text) <> '')
SELECT conv_id AS doc_id, sum(n)::BIGINT AS n, min(a) AS start, round_even(max(b), 3) AS "end", (sum(n) - 1)::BIGINT AS spaces FROM w GROUP BY conv_id""",
    "recognised_tokens": """WITH w AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations)
SELECT conv_id, turn, n * 0.25::DOUBLE AS "end", round(n * 0.25::DOUBLE, 6) AS length, (n - 1)::BIGINT AS spaces FROM w WHERE n > 0""",
    "write_vtt_karaoke": written(f"""{_vtt('a')} || ' --> ' || {_vtt('b')} || chr(10) || '<c>' || event_type || ' </c><' || {_vtt('m')} || '><c>' || event_id || '</c>' || chr(10)""", head="WEBVTT' || chr(10) || chr(10) || 'STYLE' || chr(10) || '::cue(:past) { color: #FFD700; }' || chr(10) || '::cue(:future) { color: #FFFFFF; }' || chr(10) || chr(10) || '"),
    "write_srt_karaoke": f"""WITH {CUES}, two AS (SELECT user_id, line_no * 2 + 1 AS n, {clock('a')} || ' --> ' || {clock('m')} || chr(10) || '<font color="#FFD700">' || event_type || ' </font>' || event_id || chr(10) AS row FROM cues UNION ALL
  SELECT user_id, line_no * 2 + 2, {clock('m')} || ' --> ' || {clock('b')} || chr(10) || '<font color="#FFD700">' || line || '</font>' || chr(10) FROM cues),
texts AS (SELECT user_id, string_agg(n || chr(10) || row, chr(10) ORDER BY n) AS text FROM two GROUP BY user_id) SELECT user_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM texts""",
    "write_ttml": written(f"""'<p begin="' || {_vtt('a')} || '" end="' || {_vtt('b')} || '"><span begin="' || {_vtt('a')} || '" end="' || {_vtt('m')} || '">' || event_type || '</span> <span begin="' || {_vtt('m')} || '" end="' || {_vtt('b')} || '">' || event_id || '</span></p>'""", head='<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata"><body><div>\' || chr(10) || \'', tail="chr(10) || '</div></body></tt>' || chr(10)"),
    "write_ttml_line": written(f"""'<p begin="' || {_vtt('a')} || '" end="' || {_vtt('b')} || '">' || line || '</p>'""", head='<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata"><body><div>\' || chr(10) || \'', tail="chr(10) || '</div></body></tt>' || chr(10)"),
    "write_ass": f"""WITH {CUES}{ASS_CUES}, rows AS (SELECT user_id, line_no, 'Dialogue: 0,' || {ass_stamp('from_t')} || ',' || {ass_stamp('until_t')} || ',Default,' || event_type || ',0,0,0,,{{\\fad(150,150)}}' ||
  CASE WHEN k0 > 0 THEN '{{\\kf' || k0 || '}}' ELSE '' END || '{{\\kf' || (k1 - k0) || '}}' || event_type || ' {{\\kf' || (k2 - k1) || '}}' || event_id AS row FROM clocked),
texts AS (SELECT user_id, '{ASS_HEAD}' || string_agg(row, chr(10) ORDER BY line_no) || chr(10) AS text FROM rows GROUP BY user_id) SELECT user_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM texts""",
    "clean_punct_subtitle": r"""SELECT conv_id, turn, rtrim(regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '([0-9])([,，、;；])([0-9])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), '\s*[,，、;；]\s*', '  ', 'g'), chr(1) || '  ' || chr(1), ','), chr(1), ''), '([^0-9]|^|[0-9])[.。]([^0-9]|$)', '\1 \2', 'g')) AS text FROM conversations""",
    "frame_plan": """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_quantity::BIGINT + 8 AS n FROM lineitem),
o AS (SELECT *, sum(n) OVER w AS o1, row_number() OVER w AS k FROM q WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)),
s AS (SELECT l_orderkey, o1 - n AS o0, o1, l_linenumber * 10 AS off, CASE WHEN k > 1 THEN 4 ELSE 0 END AS fade FROM o),
n AS (SELECT *, coalesce(lead(fade) OVER (PARTITION BY l_orderkey ORDER BY o0), 0) AS next FROM s),
b AS (SELECT *, o0 - fade // 2 AS f0, o1 + (next + 1) // 2 AS f1 FROM n), f AS (SELECT *, unnest(range(f0::BIGINT, f1::BIGINT)) AS frame FROM b),
w AS (SELECT *, CASE WHEN fade > 0 AND frame < f0 + fade THEN (frame - f0 + 0.5::DOUBLE) / fade WHEN next > 0 AND frame >= f1 - next THEN 1 - (frame - (f1 - next) + 0.5::DOUBLE) / next ELSE 1.0 END AS weight FROM f)
SELECT l_orderkey, frame, count(*)::BIGINT AS n, round(sum(weight), 6) AS weight, sum(frame + off)::BIGINT AS source_sum FROM w GROUP BY l_orderkey, frame""",
    "merge_small_clusters": """WITH e AS (SELECT CASE WHEN vec_id % 97 = 0 THEN label + 100 ELSE label END AS label, embedding FROM embeddings),
x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM e), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i),
c AS (SELECT label, list(x ORDER BY i) AS center FROM m GROUP BY label), t AS (SELECT label, count(*) AS w FROM e GROUP BY label),
p AS (SELECT a.label, b.label AS large, row_number() OVER (PARTITION BY a.label ORDER BY list_cosine_similarity(ca.center, cb.center) DESC, b.label) AS r
  FROM t a JOIN c ca USING (label) CROSS JOIN t b JOIN c cb ON cb.label = b.label WHERE a.w < 6 AND b.w >= 6)
SELECT t.label, coalesce(p.large, t.label) AS "to" FROM t LEFT JOIN p ON p.label = t.label AND p.r = 1""",
    "cut_groups": f"""WITH {TRACKS}, i AS (SELECT user_id, event_id, (start - 1700000000000000) / 1e6 AS s, ("end" - 1700000000000000) / 1e6 AS e, CASE event_type WHEN 'error' THEN 'filler' WHEN 'purchase' THEN 'repeat' END AS cut FROM tracks),
n AS (SELECT *, CASE WHEN cut IS NOT NULL AND lag(cut) OVER w IS NOT DISTINCT FROM cut THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM n)
SELECT user_id, group_no, any_value(cut) AS cut, string_agg(event_id || ' ', '' ORDER BY s, e) AS text, round(min(s), 6) AS start FROM g GROUP BY user_id, group_no""",
    "edit_removals": f"""WITH {TRACKS}, i AS (SELECT user_id, event_id, (start - 1700000000000000) / 1e6 AS s, ("end" - 1700000000000000) / 1e6 AS e, CASE event_type WHEN 'error' THEN 'filler' WHEN 'purchase' THEN 'repeat' END AS cut FROM tracks),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE cut IS NULL),
l AS (SELECT *, sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r),
kept AS (SELECT user_id, min(s) AS s, max(e) AS e FROM l GROUP BY user_id, k),
d AS (SELECT user_id, max(e) + 60 AS d FROM i GROUP BY user_id),
x AS (SELECT user_id, s, e, false AS last FROM kept UNION ALL SELECT user_id, d, d, true FROM d WHERE user_id IN (SELECT user_id FROM kept)),
f AS (SELECT user_id, coalesce(lag(e) OVER w, 0.0) AS a, s AS b, last OR lag(e) OVER w IS NULL AS edge FROM x WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
gone AS (SELECT * FROM f WHERE b - a > CASE WHEN edge THEN 1e-3 ELSE 0 END),
j AS (SELECT g.user_id, g.a, g.b, g.edge, i.event_id, i.cut, i.s, i.e FROM gone g LEFT JOIN i ON i.user_id = g.user_id AND i.cut IS NOT NULL AND (i.s + i.e) / 2 BETWEEN g.a - 0.02 AND g.b + 0.02)
SELECT user_id, round(a, 6) AS start, edge, CASE WHEN count(cut) = 0 THEN 'pause' ELSE string_agg(DISTINCT cut, ',' ORDER BY cut DESC) END AS reasons, CASE WHEN count(cut) = 0 THEN '(pause)' ELSE string_agg(event_id || ' ', '' ORDER BY s, e) END AS text,
  count(cut) > 0 AND NOT edge AND count(*) FILTER (WHERE cut = 'repeat') = 0 AND round_even(sum(e - s), 3) <= 100 AS mutable FROM j GROUP BY user_id, a, b, edge""",
    "syllable_alignment": f"""WITH l AS (SELECT item_id, regexp_extract_all(text, '{WORD.replace("'", "''")}') AS ws FROM benchmark),
w AS (SELECT item_id, generate_subscripts(ws, 1) - 1 AS g_no, regexp_replace(lower(unnest(ws)), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g') AS k FROM l),
g AS (SELECT *, len(regexp_extract_all(k, '[{VOWELS}]+')) AS n FROM w),
x AS (SELECT item_id, g_no, CASE WHEN k = '' THEN 0.3 WHEN regexp_matches(k, '^[0-9]+$') THEN greatest(1.0, length(k) * 0.9)
  ELSE greatest(1, n - CASE WHEN suffix(k, 'e') AND n > 1 AND NOT suffix(k, 'le') AND NOT suffix(k, 'ee') THEN 1 ELSE 0 END)::DOUBLE END AS weight FROM g),
f AS (SELECT *, greatest(8, round(weight * 17))::BIGINT AS length FROM x)
SELECT item_id, g_no::INT AS g_no, round((20 + sum(length) OVER (PARTITION BY item_id ORDER BY g_no) - length) * 0.01::DOUBLE, 3) AS start FROM f""",
    "ass_round_trip": f"""WITH {CUES}{ASS_CUES}
SELECT user_id, count(*)::BIGINT AS n_lines, sum(round_even(from_t * 100, 0)::BIGINT + greatest(k0, 0))::BIGINT AS start_sum, sum(round_even(until_t * 100, 0)::BIGINT)::BIGINT AS end_sum, (2 * count(*))::BIGINT AS n_tokens FROM clocked GROUP BY user_id""",
    "lrc_round_trip": f"""WITH {CUES}, n AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY line_no) AS na, len(regexp_extract_all(line, '{WORD.replace("'", "''")}')) AS words FROM cues)
SELECT user_id, count(*)::BIGINT AS n_lines, sum({cs('a')})::BIGINT AS start_sum, sum(CASE WHEN na IS NULL OR na - b >= 2000 THEN {cs('b')} ELSE least({cs('na')}, {cs('a')} + 800) END)::BIGINT AS end_sum, sum(words)::BIGINT AS n_tokens FROM n GROUP BY user_id""",
    "lrc_enhanced_round_trip": f"""WITH {CUES}, n AS (SELECT *, len(regexp_extract_all(line, '{WORD.replace("'", "''")}')) AS words FROM cues)
SELECT user_id, count(*)::BIGINT AS n_lines, sum({cs('a')})::BIGINT AS start_sum, sum({cs('b')})::BIGINT AS end_sum, sum(words)::BIGINT AS n_tokens FROM n GROUP BY user_id""",
    "fill_missing_islands": f"""WITH {TRACKS}, h AS (SELECT event_id, user_id, start AS t0, CASE WHEN event_type <> 'purchase' THEN (start - 1700000000000000) / 1e6 END AS start, CASE WHEN event_type <> 'purchase' THEN ("end" - 1700000000000000) / 1e6 END AS "end" FROM tracks),
r AS (SELECT *, start IS NOT NULL AS timed, count(start) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) AS run,
  last_value("end" IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(start IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM h),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run, timed) AS total, row_number() OVER (PARTITION BY user_id, run, timed ORDER BY t0, event_id) AS done FROM r),
q AS (SELECT *, last_value(CASE WHEN timed THEN start END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_start,
  coalesce(NOT timed AND after - before < 1e-3, false) AS tight FROM n),
l AS (SELECT *, CASE WHEN tight THEN greatest(before_start, before - total * 0.04) ELSE coalesce(before, greatest(0.0, after - total * 0.25), 0.0) END AS low FROM q),
b AS (SELECT *, CASE WHEN after IS NULL THEN low + total * 0.25 WHEN tight THEN greatest(before, after) ELSE greatest(low, after) END - low AS span,
  lead(CASE WHEN tight THEN low END) OVER (PARTITION BY user_id ORDER BY t0, event_id) AS taken FROM l)
SELECT event_id, round(CASE WHEN timed THEN start ELSE low + span * (done - 1) / total END, 7) AS start, round(CASE WHEN timed THEN coalesce(taken, "end") ELSE low + span * done / total END, 7) AS "end" FROM b""",
    "enforce_monotonic": f"""WITH RECURSIVE {TRACKS}, o AS (SELECT event_id, user_id, (start - 1700000000000000) / 1e6 AS s, ("end" - 1700000000000000) / 1e6 AS e, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS k FROM tracks),
p AS (SELECT event_id, user_id, k, greatest(s, 0.0::DOUBLE) AS a, greatest(e, greatest(s, 0.0::DOUBLE) + 0.02) AS b FROM o WHERE k = 1 UNION ALL
  SELECT o.event_id, o.user_id, o.k, greatest(o.s, p.b), greatest(o.e, greatest(o.s, p.b) + 0.02) FROM p JOIN o ON o.user_id = p.user_id AND o.k = p.k + 1)
SELECT event_id, round(a, 6) AS start, round(b, 6) AS "end" FROM p""",
    "merge_intervals": f"""WITH {TRACKS}, r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tracks),
i AS (SELECT *, sum(CASE WHEN start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(start) AS start, max("end") AS "end", count(*)::BIGINT AS n FROM i GROUP BY user_id, island""",
    "place_on_timeline": f"""WITH RECURSIVE {TRACKS}, o AS (SELECT event_id, user_id, start, ("end" - start) * 400 AS length, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS k FROM tracks),
p AS (SELECT event_id, user_id, k, start, start AS spot, start + length AS cur FROM o WHERE k = 1 UNION ALL
  SELECT o.event_id, o.user_id, o.k, o.start, greatest(o.start, p.cur + 80000), greatest(o.start, p.cur + 80000) + o.length FROM p JOIN o ON o.user_id = p.user_id AND o.k = p.k + 1)
SELECT event_id, spot::BIGINT AS "at", (spot - start)::BIGINT AS late FROM p""",
    "density_violations": f"""WITH {TRACKS}, c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {12 * HOUR - 1} FOLLOWING) AS n_window FROM tracks) SELECT event_id, n_window::BIGINT AS n_window FROM c WHERE n_window > 3""",
    "hallucination_screen": f"""WITH s AS (SELECT conv_id, turn, trim(text) AS text, length(regexp_replace(lower(text), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')) AS n, greatest(0.001, least(10.0, length(text) / 12.0)) AS raw, (turn * 10)::DOUBLE AS start FROM conversations),
e AS (SELECT *, greatest(0.001, (start + raw) - start) AS span FROM s WHERE n > 0),
p AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i){STRONG}') THEN 3 WHEN regexp_matches(text, '(?i){WEAK}') THEN 2 ELSE 0 END + CASE WHEN (n / span > 12 AND n > 6) OR (span > 8 AND n / span < 0.4) THEN 1 ELSE 0 END AS score FROM e)
SELECT conv_id, turn, score::BIGINT AS score, CASE WHEN score >= 3 THEN 'removed' WHEN score = 2 THEN 'flagged' ELSE 'kept' END AS action FROM p""",
    "duplicate_of_previous": r"""WITH k AS (SELECT conv_id, turn, regexp_replace(lower(text), '[\p{P}\p{S}\s]+', '', 'g') AS k FROM conversations)
SELECT conv_id, turn, coalesce(k = lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AND length(k) >= 4, false) AS repeated FROM k""",
    "glossary_replace": "SELECT conv_id, turn, regexp_replace(replace(replace(text, 'the', 'THE'), 'ing', 'in'''), '[0-9]+', '#', 'g') AS text FROM conversations",
    "remove_fillers": r"""SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ' '), lambda w: regexp_replace(lower(w), '[^\p{L}\p{N}_]', '', 'g') NOT IN ('um', 'uh', 'erm', 'uhm', 'you know', 'the', 'of', 'is')), ' ') AS text FROM conversations""",
    "speaker_turns": """WITH c AS (SELECT *, CASE WHEN role = 'assistant' THEN 'a' ELSE 'b' END AS who FROM conversations), n AS (SELECT *, CASE WHEN lag(who) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM who THEN 0 ELSE 1 END AS new FROM c),
t AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM n)
SELECT conv_id, turn_no, min(who) AS who, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM t GROUP BY conv_id, turn_no""",
    "layout_units": "SELECT * FROM (VALUES ('landscape', 50::BIGINT, 'landscape'), ('portrait', 28::BIGINT, 'portrait'), ('square', 30::BIGINT, 'square')) v(name, max_units, orientation)",
    "pick_peaks": f"""WITH {TRACKS}, h AS (SELECT start // {HOUR} AS i, count(*)::DOUBLE AS x FROM tracks GROUP BY 1),
c AS (SELECT i, x, max(x) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS high, avg(x) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mean FROM h),
p AS (SELECT * FROM c WHERE x = high AND x >= mean + 2.0 AND x > 0), g AS (SELECT *, i - lag(i) OVER (ORDER BY i) AS gap FROM p) SELECT i::BIGINT AS i, x FROM g WHERE gap IS NULL OR gap > 3""",
    "active_segments": f"""WITH {TRACKS}, h AS (SELECT start // {HOUR} AS i, count(*) AS x FROM tracks GROUP BY 1), l AS (SELECT i, CASE WHEN i - lag(i) OVER (ORDER BY i) - 1 < 2 THEN 0 ELSE 1 END AS new FROM h WHERE x > 13),
r AS (SELECT i, sum(new) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT min(i)::BIGINT AS first, (max(i) + 1)::BIGINT AS last FROM r GROUP BY run HAVING max(i) + 1 - min(i) >= 2""",
    "normalize_curve": f"""WITH {TRACKS}, h AS (SELECT start // {HOUR} AS i, count(*)::DOUBLE AS x FROM tracks GROUP BY 1) SELECT i::BIGINT AS i, round(least(1.5, x / (SELECT quantile_cont(x, 0.97) FROM h)) / 1.5, 6) AS norm FROM h""",
    "cosine_similarity": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS center FROM m GROUP BY label)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], center), 4) + 0.0::DOUBLE AS sim FROM embeddings JOIN c USING (label)""",
    "label_centroids": "WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i::BIGINT AS i, round(avg(x), 5) AS x FROM x GROUP BY label, i",
    "nearest_labelled": f"""WITH {TRACKS}, x AS (SELECT e.event_id, p.event_id AS near_id, abs(p.start - e.start) AS away, p.start AS p_start FROM tracks e LEFT JOIN tracks p ON p.user_id = e.user_id AND p.event_type = 'purchase' WHERE e.event_type = 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY away, p_start, near_id DESC) AS k FROM x) SELECT event_id, near_id FROM r WHERE k = 1""",
    "first_appearance_names": f"WITH {TRACKS}, f AS (SELECT user_id, event_type, min(start) AS first FROM tracks GROUP BY 1, 2) SELECT user_id, event_type, 'S' || row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) AS name FROM f",
    "robust_z": """WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS mid FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, mid, greatest(0.01, 1.4826 * median(abs(l_extendedprice - mid))) AS scale FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1, 2)
SELECT l_suppkey, count(*)::BIGINT AS n, round(max((l_extendedprice - mid) / scale), 4) AS most, round(min((l_extendedprice - mid) / scale), 4) AS least FROM lineitem JOIN s USING (l_suppkey) GROUP BY l_suppkey""",
    "mad_disagreement": f"""WITH g AS (SELECT l_suppkey, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / {24 * HOUR}.0::DOUBLE AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT l_suppkey, median(lag) AS mid, count(*)::BIGINT AS n FROM g GROUP BY 1)
SELECT l_suppkey, n, CASE WHEN n >= 3 THEN round(median(abs(lag - mid)), 4) END AS disagreement FROM g JOIN m USING (l_suppkey) GROUP BY l_suppkey, n""",
    "take_score_rank": """WITH s AS (SELECT l_orderkey, l_linenumber, round(l_discount * 4.0::DOUBLE + CASE WHEN l_discount > 0.15::DOUBLE THEN 10.0::DOUBLE ELSE 0 END + (1.0::DOUBLE - (1 - l_tax)) * 2.0::DOUBLE + l_quantity / 6.0::DOUBLE + greatest(0.0::DOUBLE, l_quantity / 10 / 3.0::DOUBLE - 1.15::DOUBLE) * 5.0::DOUBLE, 4) AS total FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY total, l_linenumber) AS rank FROM s) SELECT l_orderkey, l_linenumber, total, rank FROM r WHERE rank <= 3""",
    "finalists_topk": "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) SELECT * FROM r WHERE rank <= 2",
    "pair_segments": """WITH b AS (SELECT l_orderkey, l_linenumber AS b_line, l_partkey AS b_part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS k FROM lineitem WHERE l_linenumber > 1)
SELECT a.l_orderkey, a.l_partkey AS a_part, b.b_line::BIGINT AS b_line, b.b_part FROM lineitem a JOIN b USING (l_orderkey) WHERE a.l_linenumber = 1 AND k = 1""",
    "blind_test_tally": """WITH x AS (SELECT doc_id % 7 AS k, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS a, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS b, count(*) FILTER (WHERE quality = toxic) AS same FROM labels GROUP BY 1)
SELECT k, a::BIGINT AS a, b::BIGINT AS b, same::BIGINT AS same, CASE WHEN a + b = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(a, b) + 1), lambda j: exp(lgamma(a + b + 1) - lgamma(j + 1) - lgamma(a + b - j + 1) - (a + b) * ln(2))))), 4) END AS p FROM x""",
    "slot_and_fit": f"""WITH {TRACKS}, s AS (SELECT event_id, user_id, start / 3.6e9 AS start, "end" / 3.6e9 AS "end", abs(value) AS v FROM tracks),
n AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start, "end") AS nxt FROM s),
l AS (SELECT *, CASE WHEN nxt IS NULL THEN "end" - start + 1.0 ELSE greatest(0.2, nxt - start - 0.08) END AS slot FROM n)
SELECT event_id, round(slot, 4) AS slot, round(CASE WHEN slot > 0 AND v > slot THEN least(1.15, v / slot) WHEN v * 1.3 > 0 AND v < v * 1.3 * 0.85 THEN greatest(0.9, v / (v * 1.3)) ELSE 1.0 END, 4) AS fit FROM l""",
    "iso_budget": f"""WITH c AS (SELECT conv_id, turn, len(regexp_extract_all(text, '{WORD.replace("'", "''")}')) AS n, (turn * 10)::DOUBLE AS s, (turn * 10 + least(10.0, length(text) / 12.0))::DOUBLE AS e FROM conversations),
b AS (SELECT *, e - s > 0 AND (e - s) * 5.0::DOUBLE < n * 1.3::DOUBLE AS by_time FROM c),
g AS (SELECT *, greatest(1, round_even(CASE WHEN by_time THEN (e - s) * 5.0::DOUBLE ELSE n * 1.3::DOUBLE END, 0)::BIGINT) AS target FROM b), k AS (SELECT *, greatest(1, round_even(target * 0.1::DOUBLE, 0)::BIGINT) AS slack FROM g)
SELECT conv_id, turn, target::BIGINT AS target, greatest(1, target - slack)::BIGINT AS lo, (target + slack)::BIGINT AS hi, CASE WHEN by_time THEN 'time' ELSE 'ratio' END AS "by" FROM k""",
}

_CUT = f"""{TRACKS}, z AS (SELECT *, min(start) OVER (PARTITION BY user_id) AS zero FROM tracks),
rem AS (SELECT event_id, user_id, event_type, start - zero AS start, "end" - zero + {HOUR} AS "end" FROM z),
span AS (SELECT user_id, max("end") + {HOUR} AS duration FROM rem GROUP BY user_id),
reach AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM rem WHERE event_type = 'error'),
isl AS (SELECT *, sum(CASE WHEN start > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM reach),
cuts AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM isl GROUP BY user_id, i UNION ALL SELECT user_id, duration, duration FROM span),
gaps AS (SELECT user_id, coalesce(lag("end") OVER (PARTITION BY user_id ORDER BY start, "end"), 0) AS start, start AS "end" FROM cuts),
kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) AS keep_no, coalesce(sum("end" - start) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS edited FROM gaps WHERE "end" > start)"""
SQL["keeps_from_removals"] = f'WITH {_CUT} SELECT user_id, keep_no, start, "end", edited FROM kept'
SQL["time_map"] = f"""WITH {_CUT} SELECT p.event_id, (k.edited + p.start - k.start)::BIGINT AS mapped FROM rem p LEFT JOIN kept k ON k.user_id = p.user_id AND k.start <= p.start AND p.start <= k."end"
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY k.start DESC) = 1"""
for _f in ("srt", "vtt", "sbv", "qrc", "yrc", "krc", "ttml"):
    SQL[f"{_f}_round_trip"] = f"WITH {CUES} SELECT user_id, sum(len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+')))::BIGINT AS n_tokens, count(*)::BIGINT AS n_lines, sum(a)::BIGINT AS start_sum, sum(b)::BIGINT AS end_sum FROM cues GROUP BY user_id"
