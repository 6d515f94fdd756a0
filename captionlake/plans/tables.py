"""Subtitle tables that Spark derives from the driver's tables; DUCK holds the same as DuckDB SQL (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WORDS = """
WITH t AS (SELECT conv_id, turn, posexplode(filter(split(regexp_replace(text,'[ \\n\\r\\t]+',' '),' '), x -> x <> '')) AS (p, w) FROM {conversations}),
n AS (SELECT conv_id AS project_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn,p)-1 AS BIGINT) AS i, w AS text FROM t)
SELECT project_id, i AS word_idx, text, (400*i + 350*(i div 6))/1000.0D AS start,
  (400*i + 350*(i div 6) + 180 + (length(text)*37 + i*53) % 200)/1000.0D AS `end`, ((i*37+project_id*11)%100)/100.0D AS score FROM n"""

_SPARK = {
    "words": _WORDS,
    "regions": """SELECT project_id, CAST(floor(word_idx/12) AS BIGINT) AS region_idx, greatest(0.0D, round(min(start)-0.08,3)) AS start,
  max(CASE WHEN word_idx % 12 < 9 THEN `end` END) AS `end` FROM {words} GROUP BY project_id, CAST(floor(word_idx/12) AS BIGINT)""",
    "candidate_words": """SELECT project_id, word_idx, CASE WHEN (word_idx+project_id)%17=0 THEN reverse(text) ELSE text END AS text, round(start+0.02D,3) AS start,
  round(`end`+0.02D,3) AS `end`, ((word_idx*53+project_id*7)%100)/100.0D AS score FROM {words} WHERE (word_idx*7+project_id)%13<>0""",
    "segments": """SELECT project_id, CAST(floor(word_idx/8) AS BIGINT) AS segment_idx, min(start) AS start, max(`end`) AS `end`,
  ((CAST(floor(word_idx/8) AS BIGINT)*29+project_id)%100)/100.0D AS no_speech_prob, -((CAST(floor(word_idx/8) AS BIGINT)*17)%150)/100.0D AS avg_logprob
  FROM {words} GROUP BY project_id, CAST(floor(word_idx/8) AS BIGINT)""",
    "silences": """SELECT project_id, word_idx AS silence_idx, round(`end`-0.05D,3) AS start, round(`end`+0.15D,3) AS `end` FROM {words}
  WHERE word_idx%6=5 OR (word_idx+project_id)%11=0""",
    "clips": """SELECT user_id AS project_id, event_id AS clip_id, round(rn*3.0D+(event_id%10)/10.0D,3) AS start_time,
  round(rn*3.0D+(event_id%10)/10.0D+1.0D+(event_id%37)/10.0D,3) AS end_time, event_id%23 AS voice_style_id,
  CASE WHEN event_id%9=0 THEN 'queued' ELSE 'ready' END AS status
  FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {events} WHERE event_type='click') e""",
    "takes": """SELECT l_orderkey AS clip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice) AS take_index,
  l_quantity/10.0D AS actual_duration FROM {lineitem}""",
    "jobs": """SELECT o_orderkey AS job_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'complete' END AS status,
  o_orderdate AS created_at, concat('{{"wordsPerCaption":',CAST(o_orderkey%15 AS VARCHAR(20)),'}}') AS options_json FROM {orders}""",
    "samples": """SELECT event_type AS project_id, row_number() OVER (PARTITION BY event_type ORDER BY ts,event_id)-1 AS sample_idx, (value-50.0D)/500.0D AS sample FROM {events}""",
    "uploads": """SELECT o_custkey AS upload_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderpriority AS name, o_orderkey AS file_id FROM {orders}""",
}
_BASE = {"conversations", "events", "lineitem", "orders", "customer", "part", "documents", "nation", "supplier"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's own."""
    if name in _BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _SPARK[name]
    needs = [n for n in (*_BASE, *_SPARK) if "{" + n + "}" in sql.replace("{{", "")]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in needs})


_DUCK = {
    "words": r"""t0 AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text,'[ \n\r\t]+',' ','g'),' '), lambda x: x <> '') l FROM conversations),
e0 AS (SELECT conv_id, turn, unnest(l) w, generate_subscripts(l,1) p FROM t0),
n0 AS (SELECT conv_id AS project_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn,p)-1 AS i, w AS text FROM e0),
words AS (SELECT project_id, i AS word_idx, text, (400*i + 350*(i//6))/1000.0::DOUBLE AS start,
  (400*i + 350*(i//6) + 180 + (length(text)*37 + i*53) % 200)/1000.0::DOUBLE AS "end", ((i*37+project_id*11)%100)/100.0::DOUBLE AS score FROM n0)""",
    "regions": """regions AS (SELECT project_id, CAST(floor(word_idx/12) AS BIGINT) AS region_idx, greatest(0.0::DOUBLE, round(min(start)-0.08,3)) AS start,
  max(CASE WHEN word_idx % 12 < 9 THEN "end" END) AS "end" FROM words GROUP BY project_id, CAST(floor(word_idx/12) AS BIGINT))""",
    "candidate_words": """candidate_words AS (SELECT project_id, word_idx, CASE WHEN (word_idx+project_id)%17=0 THEN reverse(text) ELSE text END AS text, round(start+0.02::DOUBLE,3) AS start,
  round("end"+0.02::DOUBLE,3) AS "end", ((word_idx*53+project_id*7)%100)/100.0::DOUBLE AS score FROM words WHERE (word_idx*7+project_id)%13<>0)""",
    "segments": """segments AS (SELECT project_id, CAST(floor(word_idx/8) AS BIGINT) AS segment_idx, min(start) AS start, max("end") AS "end",
  ((CAST(floor(word_idx/8) AS BIGINT)*29+project_id)%100)/100.0::DOUBLE AS no_speech_prob, -((CAST(floor(word_idx/8) AS BIGINT)*17)%150)/100.0::DOUBLE AS avg_logprob
  FROM words GROUP BY project_id, CAST(floor(word_idx/8) AS BIGINT))""",
    "silences": """silences AS (SELECT project_id, word_idx AS silence_idx, round("end"-0.05::DOUBLE,3) AS start, round("end"+0.15::DOUBLE,3) AS "end" FROM words
  WHERE word_idx%6=5 OR (word_idx+project_id)%11=0)""",
    "clips": """clips AS (SELECT user_id AS project_id, event_id AS clip_id, round(rn*3.0::DOUBLE+(event_id%10)/10.0::DOUBLE,3) AS start_time,
  round(rn*3.0::DOUBLE+(event_id%10)/10.0::DOUBLE+1.0::DOUBLE+(event_id%37)/10.0::DOUBLE,3) AS end_time, event_id%23 AS voice_style_id,
  CASE WHEN event_id%9=0 THEN 'queued' ELSE 'ready' END AS status
  FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type='click') e)""",
    "takes": """takes AS (SELECT l_orderkey AS clip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice) AS take_index,
  l_quantity/10.0::DOUBLE AS actual_duration FROM lineitem)""",
    "jobs": """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'complete' END AS status,
  o_orderdate AS created_at, concat('{"wordsPerCaption":',CAST(o_orderkey%15 AS VARCHAR),'}') AS options_json FROM orders)""",
    "samples": """samples AS (SELECT event_type AS project_id, row_number() OVER (PARTITION BY event_type ORDER BY ts,event_id)-1 AS sample_idx, (value-50.0::DOUBLE)/500.0::DOUBLE AS sample FROM events)""",
    "uploads": """uploads AS (SELECT o_custkey AS upload_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderpriority AS name, o_orderkey AS file_id FROM orders)""",
}
_ON_WORDS = {"regions", "candidate_words", "segments", "silences"}


def duck(names: str, select: str) -> str:
    """DuckDB SQL: the named derived tables as common table expressions, then ``select`` (which may add more, as ', x AS (...)')."""
    wanted = names.split()
    if _ON_WORDS & {*wanted} and "words" not in wanted:
        wanted = ["words", *wanted]
    wanted.sort(key=lambda n: n != "words")
    return "WITH " + ",\n".join(_DUCK[n] for n in wanted) + "\n" + select
