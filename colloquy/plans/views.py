"""Domain views over the driver's tables, for Spark and, as SQL, for the oracle.

Each view is a row-wise projection of a whole table: conversations become
segments, words and diarization turns, events become long feeds per user. The
source prose has no question marks or cue phrases, so these are added by
expressions of the keys. All times are whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import WS

# Four conversations make one episode; a turn's list position keeps 2**36 room.
SEGMENT_SQL = """
  SELECT episode_id, seg_idx, conv_id, turn, role, speaker_raw, speaker, speaker_id, text, confidence,
         start_ms, start_ms + 400 * n_words AS end_ms
  FROM (
    SELECT *, {n_words} AS n_words FROM (
      SELECT *, CASE WHEN (conv_id * 3 + turn * 11) % 17 = 0 THEN '  '
                     WHEN k = 7 THEN 'Okay!'
                     ELSE cue || body || mark END AS text
      FROM (
        SELECT conv_id, turn, role, text AS body,
          {episode} AS episode_id,
          (conv_id % 4) * 68719476736 + turn AS seg_idx,
          30000 + (conv_id % 4) * 200000 + turn * 20000 + (conv_id * 7919 + turn * 104729) % 5000 AS start_ms,
          CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker_raw,
          CASE role WHEN 'user' THEN 'Speaker 1' WHEN 'assistant' THEN 'Speaker 2' ELSE 'Unknown' END AS speaker,
          CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker_id,
          CAST((conv_id * 31 + turn * 17) % 100 AS DOUBLE) / 100 AS confidence,
          (conv_id * 5 + turn * 3) % 16 AS k,
          CASE WHEN (role = 'user' AND {episode} % 3 = 0) OR (conv_id + turn * 7) % 4 = 0 THEN '?' ELSE '' END AS mark,
          CASE (conv_id * 5 + turn * 3) % 16
            WHEN 4 THEN 'What do you think, ' WHEN 5 THEN 'Tell me, '
            ELSE CASE WHEN {episode} % 2 = 1 THEN '' ELSE
              CASE (conv_id * 5 + turn * 3) % 16
                WHEN 0 THEN 'Welcome back to the show. ' WHEN 1 THEN 'Thanks for having me. '
                WHEN 2 THEN 'Please like and subscribe! ' WHEN 3 THEN 'This part is brought to you by a sponsor. '
                WHEN 6 THEN 'I subscribed to that. ' WHEN 8 THEN 'In today''s episode, we spoke to a host. '
                ELSE '' END END END AS cue
        FROM conversations) a) b) c
"""

TURN_SQL = """
  SELECT {episode} AS episode_id, (conv_id % 4) * 68719476736 + turn AS turn_idx,
    CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker,
    (conv_id % 4) * 200000 + turn * 20000 + (conv_id * 7919 + turn * 104729) % 60001 AS start_ms,
    (conv_id % 4) * 200000 + turn * 20000 + (conv_id * 7919 + turn * 104729) % 60001
      + CASE WHEN (conv_id + turn * 5) % 6 = 0 THEN 200 ELSE 400 * {n_words} END AS end_ms
  FROM conversations
"""

WORD_SQL = """
  SELECT episode_id, seg_idx * 16777216 + pos AS word_idx, pos,
    CASE WHEN pos % 13 = 5 THEN NULL ELSE speaker_id END AS speaker,
    start_ms + 400 * pos + 700 * {seven} + 900 * {ten} AS start_ms,
    start_ms + 400 * pos + 700 * {seven} + 900 * {ten} + 300 AS end_ms,
    token
  FROM ({exploded}) w
"""

FEED_SQL = """
  SELECT user_id AS episode_id, event_id AS idx, event_type,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'SPEAKER_00'
         WHEN event_type = 'purchase' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker,
    t AS start_ms, t + d AS end_ms, event_id % 7 AS e7,
    CASE event_id % 5 WHEN 0 THEN 'noise' WHEN 1 THEN 'male' WHEN 2 THEN 'male' ELSE 'female' END AS gender,
    CASE WHEN event_id % 7 <> 0 THEN CAST(100 + event_id * 37 % 160 AS DOUBLE) END AS median_hz
  FROM (SELECT *, {micros} AS t, CAST({round_value} AS BIGINT) AS d FROM events) x
"""

_SPARK_WORDS = f"size(filter(split({{}}, r'(?U){WS}+'), x -> x <> ''))"
_DUCK_WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"


def _spark_sql(spark: SparkSession, template: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(template, **tables)


# Setting by table: how many partitions to deal its rows to. A row group is not split, so
# a table with fewer row groups than cores keeps cores idle. Off unless set.
SPREAD = "spark.colloquy.spread."


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    spread = spark.conf.get(SPREAD + name, None)
    return rows.repartition(int(spread)) if spread else rows


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments_of(table(spark, sf, "conversations"))


def segments_of(conversations: DataFrame) -> DataFrame:
    query = SEGMENT_SQL.format(n_words=_SPARK_WORDS.format("text"), episode="conv_id div 4")
    query = query.replace("FROM conversations", "FROM {conversations}")
    return conversations.sparkSession.sql(query, conversations=conversations).withColumn(
        "end_ms", F.col("end_ms").cast("bigint")
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    query = TURN_SQL.format(n_words=_SPARK_WORDS.format("text"), episode="conv_id div 4")
    query = query.replace("FROM conversations", "FROM {conversations}")
    return spark.sql(query, conversations=table(spark, sf, "conversations")).withColumn(
        "end_ms", F.col("end_ms").cast("bigint")
    )


def words_of(segs: DataFrame) -> DataFrame:
    exploded = segs.selectExpr(
        "episode_id", "seg_idx", "speaker_id", "start_ms",
        f"posexplode(filter(split(text, r'(?U){WS}+'), x -> x <> '')) AS (pos, token)",
    )
    query = WORD_SQL.replace("({exploded})", "{exploded}").replace("{seven}", "(pos div 7)").replace("{ten}", "(pos div 10)")
    return segs.sparkSession.sql(query, exploded=exploded)


def words(spark: SparkSession, sf: str) -> DataFrame:
    return words_of(segments(spark, sf))


def feed(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    origin = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
    micros = f"timestampdiff(MICROSECOND, {origin}, CAST(ts AS TIMESTAMP_NTZ)) div 600000"
    query = FEED_SQL.format(micros=micros, round_value="round(value * 1000)").replace("FROM events", "FROM {events}")
    return spark.sql(query, events=events)


# --- the same views for the oracle --------------------------------------------
SEG = "seg AS (" + SEGMENT_SQL.format(n_words=_DUCK_WORDS.format("text"), episode="(conv_id // 4)") + ")"
TURN = "turn AS (" + TURN_SQL.format(n_words=_DUCK_WORDS.format("text"), episode="(conv_id // 4)") + ")"
WORD = (
    SEG + ",\nword AS ("
    + WORD_SQL.format(
        seven="(pos // 7)", ten="(pos // 10)",
        exploded="SELECT episode_id, seg_idx, speaker_id, start_ms, toks[i] AS token, i - 1 AS pos FROM ("
        r"SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS toks FROM seg) q, "
        "range(1, len(toks) + 1) r(i)",
    )
    + ")"
)
FEED = (
    "feed AS ("
    + FEED_SQL.format(
        micros="(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 600000", round_value="round(value * 1000)"
    )
    + ")"
)


def rr(num: str, den: str, places: int) -> str:
    """Oracle form of `round_ratio`."""
    scale = 10**places
    return (
        f"coalesce(((({2 * scale}::HUGEINT * ({num}) + ({den})) // (2 * nullif(({den})::HUGEINT, 0))))::DOUBLE / {scale}, 0.0)"
    )


def pct(num: str, den: str) -> str:
    """Oracle form of `percent_text`."""
    q = f"((({num}) * 1000) // ({den}))"
    twice = f"((({num}) * 1000 - {q} * ({den})) * 2)"
    n = f"({q} + CASE WHEN {twice} > ({den}) OR ({twice} = ({den}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"(({n} // 10)::VARCHAR || '.' || ({n} % 10)::VARCHAR || '%')"


def wc(text: str) -> str:
    """Oracle form of `word_count`."""
    return f"len(list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> ''))"


def clock(ms: str) -> str:
    """Oracle form of `fmt_hms_ms_from_ms`."""
    return f"format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', ({ms}) // 3600000, ({ms}) // 60000 % 60, ({ms}) // 1000 % 60, ({ms}) % 1000)"
