"""DuckDB SQL of queries that need more than a line or two of it."""

from __future__ import annotations

from captionlake.plans.speech import _DURATIONS, _FALLBACK, _FIVE, _HYP, _PAIRS
from captionlake.plans.tables import duck

ORACLES: dict[str, str] = {}

# --- readers ---------------------------------------------------------------------------------------------------------------

ORACLES["s1_tokens_of"] = duck(
    "segments",
    """, seg AS (SELECT w.project_id, w.word_idx // 8 AS segment_idx, list_reduce(list(w.score ORDER BY w.word_idx), lambda a, b: a + b) / count(*) AS mean FROM words w GROUP BY ALL),
kept AS (SELECT s.* FROM segments s JOIN seg USING (project_id, segment_idx) WHERE NOT (no_speech_prob > 0.5 AND avg_logprob < -0.25) AND mean >= 0.35),
tok AS (SELECT w.*, k.segment_idx, avg_logprob, no_speech_prob, row_number() OVER (PARTITION BY w.project_id ORDER BY word_idx) - 1 AS token_idx, word_idx % 8 AS place
 FROM words w JOIN kept k ON k.project_id = w.project_id AND k.segment_idx = w.word_idx // 8)
SELECT project_id, token_idx, ' ' || text AS text, round(start, 6) AS start, round("end", 6) AS "end", round(score, 6) AS raw_confidence, avg_logprob AS segment_logprob, no_speech_prob AS no_speech,
 place = 0 AND token_idx > 0 AS segment_break FROM tok""",
)
ORACLES["s10_load_projects"] = duck("words", f""", {_FIVE} SELECT project_id, 0 AS style_keys, CAST(caption_idx AS INT) AS place, round(start, 6) AS start, round("end", 6) AS "end", text FROM cap""")
ORACLES["s11_ground_truth"] = duck(
    "candidate_words",
    """, c AS (SELECT project_id, length(string_agg(text, ' ' ORDER BY word_idx)) AS candidate_chars FROM candidate_words GROUP BY project_id)
SELECT project_id AS file, 'en' AS language, CAST(candidate_chars AS INT) AS candidate_chars, word_idx, text, round(start, 6) AS start, round("end", 6) AS "end" FROM words JOIN c USING (project_id)""",
)

# --- ASS ---------------------------------------------------------------------------------------------------------------------


def _ass_time(x: str) -> str:
    return f"""CAST(floor({x}/3600)::BIGINT AS VARCHAR) || ':' || lpad(CAST(floor({x}/60)::BIGINT % 60 AS VARCHAR),2,'0') || ':' || lpad(CAST(floor({x})::BIGINT % 60 AS VARCHAR),2,'0') || '.' ||
 lpad(CAST(floor(({x} % 1) * 100)::BIGINT AS VARCHAR),2,'0')"""


_ESCAPED = r"replace(replace(replace(replace(replace(text, '\', '／'), '{', '（'), '}', '）'), chr(13), ''), chr(10), '\N')"
_POP = r"\fscx65\fscy65\t(0,136,\fscx108\fscy108)\t(136,220,\fscx100\fscy100)}"
_GAP = "CASE WHEN word_pos > 0 THEN ' ' ELSE '' END"


def _dialogue(end: str, body: str) -> str:
    return f"""'Dialogue: 0,' || {_ass_time("start")} || ',' || {_ass_time(end)} || ',Default,,0,0,0,,' || {body}"""


_KARAOKE = rf"""k AS (SELECT project_id, caption_idx, string_agg({_GAP} || '{{\kf' || CAST(greatest(1, floor(("end" - start) * 100 + 0.5)::BIGINT) AS VARCHAR) || '}}' || {_ESCAPED}, '' ORDER BY word_pos) AS body FROM five GROUP BY ALL),
kl AS (SELECT project_id, caption_idx, 0 AS line_idx, {_dialogue('"end"', "body")} AS line FROM cap JOIN k USING (project_id, caption_idx))"""
ORACLES["s8_ass_sentence"] = duck("words", rf""", {_FIVE} SELECT project_id, caption_idx, 0 AS line_idx, {_dialogue('"end"', rf"'{{\fad(40,70){_POP}' || {_ESCAPED}")} AS line FROM cap""")
ORACLES["s8_ass_word"] = duck("words", rf""", {_FIVE} SELECT project_id, caption_idx, word_pos AS line_idx, {_dialogue('"end"', rf"'{{\fad(40,70){_POP}{{\c&H0038FFB8}}' || {_ESCAPED}")} AS line FROM five""")
ORACLES["s8_ass_karaoke"] = duck("words", f", {_FIVE}, {_KARAOKE} SELECT * FROM kl")
ORACLES["s8_ass_progressive"] = duck(
    "words",
    rf""", {_FIVE}, g AS (SELECT f.*, c."end" AS caption_end, {_GAP} AS gap, lead(f.start) OVER w AS next, coalesce(string_agg({_GAP} || {_ESCAPED.replace("(text,", "(f.text,")}, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior
 FROM five f JOIN cap c USING (project_id, caption_idx) WINDOW w AS (PARTITION BY f.project_id, f.caption_idx ORDER BY f.word_pos)),
h AS (SELECT *, CASE WHEN next > start THEN next ELSE greatest("end", caption_end) END AS stop FROM g)
SELECT project_id, caption_idx, word_pos AS line_idx, {_dialogue("stop", rf"prior || gap || '{{\c&H0038FFB8}}{{{_POP}' || {_ESCAPED} || '{{\fscx100\fscy100\alpha&H00&}}{{\c&H00FFFFFF}}'")} AS line FROM h""",
)
_HEAD = [
    "[Script Info]", "ScriptType: v4.00+", "PlayResX: 1920", "PlayResY: 1080", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "[V4+ Styles]",
    "Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding",
    "Style: Default,Leelawadee UI,108,&H00FFFFFF,&H00FFFFFF,&H00000000,&H70000000,-1,0,0,0,100,100,0,0,1,4,2,2,96,96,130,1", "[Events]", "Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text",
]
ORACLES["s9_to_ass_document"] = duck("words", f", {_FIVE}, {_KARAOKE} SELECT project_id, '" + "' || chr(10) || '".join(_HEAD) + "' || chr(10) || string_agg(line, chr(10) ORDER BY caption_idx) AS ass FROM kl GROUP BY project_id")

# --- speech ------------------------------------------------------------------------------------------------------------------

ORACLES["a13_speech_regions_for_project"] = duck(
    "regions segments silences",
    f""", {_FALLBACK}, s AS (SELECT project_id, segment_idx, greatest(0.0, start - 0.08) AS a, "end" + 0.08 AS b FROM segments WHERE NOT (no_speech_prob > 0.5 AND avg_logprob < -0.25) AND "end" > start AND project_id % 3 = 1),
m AS (SELECT *, max(b) OVER (PARTITION BY project_id ORDER BY segment_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM s),
i AS (SELECT *, sum(CASE WHEN a > u + 0.06 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY segment_idx) AS island FROM m),
merged AS (SELECT project_id, min(segment_idx) AS region_idx, arg_min(a, segment_idx) AS start, max(b) AS "end" FROM i GROUP BY project_id, island),
found AS (SELECT project_id, region_idx, start, "end" FROM regions WHERE project_id % 3 = 0 UNION ALL SELECT * FROM merged UNION ALL
 SELECT * FROM fb WHERE project_id % 3 <> 0 AND project_id NOT IN (SELECT project_id FROM merged))
SELECT project_id, region_idx, round(start + project_id % 2 * 0.5, 6) AS start, round("end" + project_id % 2 * 0.5, 6) AS "end" FROM found""",
)
ORACLES["j7_snap_words_to_silence"] = duck(
    "silences",
    """, q AS (SELECT w.project_id, w.word_idx, list({'q': s.start, 'r': s."end"} ORDER BY s.start, s."end") AS quiet FROM words w JOIN silences s ON s.project_id = w.project_id AND w."end" > s.start AND w.start < s."end" AND s."end" > s.start
 GROUP BY ALL),
f AS (WITH RECURSIVE step AS (SELECT w.project_id, w.word_idx, w.start AS a, w."end" AS b, w.start AS a0, w."end" AS b0, quiet, 1 AS i, false AS hidden FROM words w LEFT JOIN q USING (project_id, word_idx) WHERE w."end" > w.start
 UNION ALL SELECT project_id, word_idx, CASE WHEN r <= a OR inside OR k >= b THEN a WHEN head OR around AND NOT l THEN r ELSE a END, CASE WHEN r <= a OR inside OR k >= b THEN b WHEN tail OR around AND l THEN k ELSE b END,
  a0, b0, quiet, CASE WHEN r > a AND (inside OR k >= b OR around AND l) THEN 1000000 ELSE i + 1 END, r > a AND k < b AND inside
  FROM (SELECT *, quiet[i].q AS k, quiet[i].r AS r, a >= quiet[i].q AND b <= quiet[i].r AS inside, a >= quiet[i].q AND a < quiet[i].r AND b > quiet[i].r AS head, a < quiet[i].q AND b > quiet[i].q AND b <= quiet[i].r AS tail,
   a < quiet[i].q AND b > quiet[i].r AS around, quiet[i].q - a >= b - quiet[i].r AS l FROM step WHERE i <= len(quiet)))
 SELECT * FROM step WHERE quiet IS NULL OR i > len(quiet))
SELECT project_id, word_idx, round(a, 6) AS start, round(b, 6) AS "end" FROM f WHERE NOT hidden AND b - a >= 0.015 AND NOT (b0 - a0 > 0.25 AND b - a < 0.08)""",
)
ORACLES["j2_align_words_to_regions"] = duck(
    "regions",
    f""", {_PAIRS}, best AS (SELECT p.*, w.text, w.score, row_number() OVER (PARTITION BY p.project_id, p.word_idx ORDER BY o DESC, rs, region_idx) AS k FROM p JOIN words w USING (project_id, word_idx)),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY word_idx) AS i FROM best WHERE k = 1 AND o / greatest(0.001, "end" - start) >= 0.45),
f AS (WITH RECURSIVE fold AS (SELECT project_id, CAST(0 AS BIGINT) AS i, CAST(0.0 AS DOUBLE) AS before, CAST(NULL AS BIGINT) AS word_idx, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS e FROM (SELECT DISTINCT project_id FROM b)
 UNION ALL SELECT project_id, i, CASE WHEN e2 - s >= 0.04 THEN e2 ELSE before END, CASE WHEN e2 - s >= 0.04 THEN word_idx END, s, e2
  FROM (SELECT x.project_id, x.i, fold.before, x.word_idx, greatest(x.start, x.rs, fold.before) AS s,
    CASE WHEN least(x."end", x.re) - greatest(x.start, x.rs, fold.before) < 0.04 THEN least(x.re, greatest(x.start, x.rs, fold.before) + 0.04) ELSE least(x."end", x.re) END AS e2
   FROM fold JOIN b x ON x.project_id = fold.project_id AND x.i = fold.i + 1))
 SELECT * FROM fold WHERE word_idx IS NOT NULL),
z AS (SELECT b.project_id, b.word_idx, b.text, b.score, b.region_idx, f.s, f.e, abs(f.s - b.start) > 0.02 OR abs(f.e - b."end") > 0.02 AS moved, f.e - f.s < 0.09 AS short FROM f JOIN b USING (project_id, word_idx))
SELECT project_id, word_idx, text, round(s, 6) AS start, round(e, 6) AS "end", round(greatest(0.0, score - CASE WHEN moved THEN 0.12 ELSE 0.0 END - CASE WHEN short THEN 0.08 ELSE 0.0 END), 6) AS score,
 score < 0.65 OR moved OR short AS needs_review, CASE WHEN score < 0.65 OR moved OR short THEN 'pending' ELSE 'approved' END AS review_status, region_idx FROM z
UNION ALL SELECT project_id, word_idx, text, round(start, 6), round("end", 6), round(score, 6), score < 0.65, CASE WHEN score < 0.65 THEN 'pending' ELSE 'approved' END, NULL FROM words WHERE project_id NOT IN (SELECT project_id FROM regions)""",
)


def _side(name: str, table: str) -> str:
    return f"""{name} AS (SELECT r.project_id, r.region_idx, count(w.word_idx) AS n, avg(w.score) AS score, CASE WHEN count(w.word_idx) = 0 THEN 2 * (r."end" - r.start) ELSE
 greatest(0.0, greatest(r.start, min(w.start)) - r.start) + greatest(0.0, r."end" - least(r."end", max(w."end"))) END AS edges FROM regions r LEFT JOIN {table} w ON w.project_id = r.project_id AND w."end" > r.start AND w.start < r."end"
 GROUP BY r.project_id, r.region_idx, r.start, r."end")"""


_WINS = f"""{_HYP}, {_HYP.replace("hyp AS", "cyp AS").replace("JOIN words w", "JOIN candidate_words w")}, {_side("a", "words")}, {_side("b", "candidate_words")},
x AS (SELECT project_id, region_idx, a.n AS na, b.n AS nb, a.score AS sa, b.score AS sb, round(a.edges - b.edges, 9) AS edge, length(cyp.hypothesis) - length(hyp.hypothesis) AS gain, hyp.hypothesis <> '' AND hyp.hypothesis = cyp.hypothesis AS same
 FROM a JOIN b USING (project_id, region_idx) JOIN hyp USING (project_id, region_idx) JOIN cyp USING (project_id, region_idx)),
wins AS (SELECT project_id, region_idx, nb > 0 AND (na = 0 OR same AND edge >= 0.3 OR gain >= 3 OR gain >= 2 AND edge >= 0.12 OR gain >= 1 AND edge >= 0.3) AND (sa IS NULL OR sb IS NULL OR sb >= sa - 0.18) AS wins FROM x)"""
ORACLES["p3_retry_wins"] = duck("candidate_words regions", f", {_WINS} SELECT * FROM wins")

# --- words of this corpus: letters and digits with marks behind them, which a dictionary segmentation leaves whole ---------------------

ORACLES["c1_word_segments"] = duck("words", f", {_FIVE} SELECT project_id, caption_idx, word_pos, text, word_pos > 0 AS space_before FROM five")
ORACLES["w1_tokens_to_words"] = duck(
    "words",
    """, t AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY word_idx) AS i, greatest(start + 0.02, "end") AS stop, greatest(0.0, least(1.0, score * 0.78 + least(1.0, exp(-0.2)) * 0.22 - 0.1 * 0.35)) AS review FROM words),
m AS (SELECT *, 0.04 * i + greatest(0.0, max(greatest(start + 0.04, stop) - 0.04 * i) OVER (PARTITION BY project_id ORDER BY word_idx)) AS e FROM t)
SELECT project_id, word_idx, text, round(greatest(start, coalesce(lag(e) OVER (PARTITION BY project_id ORDER BY word_idx), 0.0)), 6) AS start, round(e, 6) AS "end", round(score, 6) AS raw_confidence,
 round(review, 6) AS review_score, review < 0.65 AS needs_review, CASE WHEN review < 0.65 THEN 'pending' ELSE 'approved' END AS review_status, word_idx > 0 AS space_before, false AS phrase_break FROM m""",
)

# --- names, geometry, filters, moods ---------------------------------------------------------------------------------------------

ORACLES["c6_repair_filename"] = "SELECT doc_id, text AS repaired, text AS name FROM documents"


def _even(x: str) -> str:
    return f"greatest(2.0, floor(({x}) / 2 + 0.5) * 2)"


def _place(x: str, most: str) -> str:
    return f"greatest(0.0, least({most}, floor(({x}) / 2) * 2))"


ORACLES["c7_crop_geometry"] = f"""WITH a AS (SELECT o_orderkey AS k, CAST(o_orderkey % 1900 + 40 AS DOUBLE) AS w, CAST(o_custkey % 1060 + 40 AS DOUBLE) AS h FROM orders),
b AS (SELECT *, ['original', 'free', '9:16', '1:1', '4:5', '16:9'][k % 6 + 1] AS aspect, [NULL, NULL, 9 / 16, 1.0, 4 / 5, 16 / 9][k % 6 + 1]::DOUBLE AS ratio, least(100, k % 101)::DOUBLE AS px, least(100, k % 97)::DOUBLE AS py,
 CASE WHEN k % 60 + k % 50 > 90 THEN 90 / (k % 60 + k % 50) ELSE 1.0 END AS sx FROM a),
c AS (SELECT *, (k % 60) * sx AS l, (k % 50) * sx AS r, (k % 20)::DOUBLE AS t, (k % 10)::DOUBLE AS u, w / h > ratio AS wide FROM b),
d AS (SELECT *, least({_even("w")}, CASE WHEN wide THEN {_even(_even("h") + " * ratio")} ELSE {_even("w")} END) AS cw, least({_even("h")}, CASE WHEN wide THEN {_even("h")} ELSE {_even(_even("w") + " / ratio")} END) AS ch FROM c),
e AS (SELECT *, greatest(0.0, w - cw) AS dx, greatest(0.0, h - ch) AS dy, {_place("w * l / 100", "w - 2")} AS fx, {_place("h * t / 100", "h - 2")} AS fy FROM d),
f AS (SELECT *, {_place("dx * px / 100", "dx")} AS cx, {_place("dy * py / 100", "dy")} AS cy, greatest(2.0, greatest(fx + 2, {_place("w * (100 - r) / 100", "w")}) - fx) AS fw, greatest(2.0, greatest(fy + 2, {_place("h * (100 - u) / 100", "h")}) - fy) AS fh FROM e),
g AS (SELECT k, w, h, aspect, CASE aspect WHEN 'original' THEN w WHEN 'free' THEN fw ELSE cw END AS ow, CASE aspect WHEN 'original' THEN h WHEN 'free' THEN fh ELSE ch END AS oh,
 CASE aspect WHEN 'original' THEN 0.0 WHEN 'free' THEN fx ELSE cx END AS ox, CASE aspect WHEN 'original' THEN 0.0 WHEN 'free' THEN fy ELSE cy END AS oy FROM f)
SELECT k AS video_id, aspect <> 'original' AND (ow <> w OR oh <> h OR aspect = 'free' AND (ox > 0 OR oy > 0)) AS active, CAST(ow AS BIGINT) AS width, CAST(oh AS BIGINT) AS height, CAST(ox AS BIGINT) AS x, CAST(oy AS BIGINT) AS y FROM g"""
ORACLES["c13_atempo_chain"] = duck(
    "takes",
    """, v AS (SELECT *, greatest(0, ceil(log2(actual_duration)) - 1)::INT AS up, greatest(0, ceil(-log2(actual_duration)) - 1)::INT AS down FROM takes)
SELECT clip_id, take_index, repeat('atempo=2,', up) || repeat('atempo=0.5,', down) || printf('atempo=%.5f', actual_duration / pow(2.0, up) * pow(2.0, down)) AS filter FROM v""",
)
ORACLES["c15_emotion_category"] = duck("words", "SELECT project_id, word_idx, ['playful', 'surprised', 'serious', 'angry', 'sad', 'normal'][word_idx % 6 + 1] AS mood FROM words")
ORACLES["c11_apply_pronunciations"] = duck(
    "words",
    f""", {_FIVE}, r0 AS (SELECT project_id, word_idx, text, row_number() OVER (PARTITION BY project_id ORDER BY word_idx) AS k FROM words WHERE NOT regexp_matches(text, '[=→]') AND trim(text) <> ''),
r AS (SELECT project_id, list(text || chr(1) || reverse(text) ORDER BY k) AS rules FROM r0 WHERE k <= 100 GROUP BY project_id)
SELECT project_id, caption_idx, list_reduce(list_prepend(text, coalesce(rules, [])), lambda acc, x: regexp_replace(acc, regexp_escape(split_part(x, chr(1), 1)), replace(split_part(x, chr(1), 2), chr(92), chr(92) || chr(92)), 'gi')) AS spoken
 FROM cap LEFT JOIN r USING (project_id)""",
)
