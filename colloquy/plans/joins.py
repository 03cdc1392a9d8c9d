"""Queries for the interval joins, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import intervals, lookups, ranking, setops
from colloquy.plans import views as V
from colloquy.plans.registry import query
from colloquy.plans.views import FEED, SEG, TURN, WORD

BEST_TURN = """pair AS (
      SELECT s.episode_id, s.seg_idx, t.speaker, t.turn_idx, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS ov
      FROM seg s JOIN turn t ON s.episode_id = t.episode_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, seg_idx ORDER BY ov DESC, turn_idx) AS rn
      FROM pair WHERE ov > 0) x WHERE rn = 1)"""


@query(
    "j01_assign_speaker",
    f"""WITH {SEG}, {TURN}, {BEST_TURN}
    SELECT s.episode_id, s.seg_idx, CASE WHEN b.ov >= 100 THEN b.speaker ELSE 'Unknown' END AS assigned,
      coalesce(b.ov, 0)::BIGINT AS overlap_ms
    FROM seg s LEFT JOIN best b ON b.episode_id = s.episode_id AND b.seg_idx = s.seg_idx""",
)
def j01(spark, sf):
    return intervals.assign_speaker(V.segments(spark, sf), V.turns(spark, sf)).select(
        "episode_id", "seg_idx", "assigned", "overlap_ms"
    )


REGION = """region AS (SELECT episode_id, start_ms + 5000 AS start_ms, end_ms + 9000 AS end_ms, gender FROM feed)"""
OVERLAPS = f"""{REGION}, ovs AS (
      SELECT s.episode_id, s.speaker,
        sum(CASE WHEN r.gender = 'male' THEN least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) ELSE 0 END)::BIGINT AS male_ms,
        sum(CASE WHEN r.gender = 'female' THEN least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) ELSE 0 END)::BIGINT AS female_ms
      FROM feed s JOIN region r ON s.episode_id = r.episode_id AND s.start_ms < r.end_ms AND r.start_ms < s.end_ms
      WHERE r.gender IN ('male', 'female') GROUP BY 1, 2)"""


def regions(spark, sf):
    return V.feed(spark, sf).select(
        "episode_id", (F.col("start_ms") + 5000).alias("start_ms"), (F.col("end_ms") + 9000).alias("end_ms"), "gender"
    )


def feed_segments(spark, sf):
    return V.feed(spark, sf).withColumnRenamed("idx", "seg_idx")


def feed_turns(spark, sf):
    return V.feed(spark, sf).select("episode_id", F.col("idx").alias("turn_idx"), "start_ms", "end_ms", "speaker")


@query("j02_gender_overlap", f"WITH {FEED}, {OVERLAPS} SELECT * FROM ovs")
def j02(spark, sf):
    return intervals.gender_overlap(V.feed(spark, sf), regions(spark, sf))


@query(
    "j03_assign_word_speakers",
    f"""WITH {WORD}, {TURN}, w AS (SELECT episode_id, word_idx, start_ms, end_ms FROM word),
    tot AS (SELECT w.episode_id, w.word_idx, t.speaker, sum(least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms)) AS ov,
        min(t.turn_idx) AS f
      FROM w JOIN turn t ON w.episode_id = t.episode_id AND w.start_ms < t.end_ms AND t.start_ms < w.end_ms GROUP BY 1, 2, 3),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, word_idx ORDER BY ov DESC, f) AS rn FROM tot) x WHERE rn = 1)
    SELECT w.episode_id, w.word_idx, coalesce(b.speaker, 'Unknown') AS assigned, coalesce(b.ov, 0)::BIGINT AS overlap_ms
    FROM w LEFT JOIN best b ON b.episode_id = w.episode_id AND b.word_idx = w.word_idx""",
)
def j03(spark, sf):
    w = V.words(spark, sf).select("episode_id", "word_idx", "start_ms", "end_ms")
    return intervals.assign_word_speakers(w, V.turns(spark, sf)).select(
        "episode_id", "word_idx", "assigned", "overlap_ms"
    )


MAPPING = """dur AS (SELECT episode_id, speaker, sum(greatest(0, end_ms - start_ms)) AS ms, min(turn_idx) AS f,
      arg_min(start_ms, turn_idx) AS st FROM turn GROUP BY 1, 2),
    top2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ms DESC, f) AS r FROM dur) x WHERE r <= 2),
    mapping AS (SELECT episode_id, speaker, ms::BIGINT AS total_ms,
      'Speaker ' || row_number() OVER (PARTITION BY episode_id ORDER BY st, r) AS label FROM top2)"""


@query(
    "j04_map_speakers",
    f"""WITH {SEG}, {TURN}, {MAPPING}
    SELECT s.episode_id, s.seg_idx, coalesce(m.label, 'Unknown') AS mapped FROM seg s
    LEFT JOIN mapping m ON m.episode_id = s.episode_id AND m.speaker = s.speaker_raw""",
)
def j04(spark, sf):
    mapping = ranking.speaker_mapping(V.turns(spark, sf))
    return lookups.map_speakers(V.segments(spark, sf), mapping).select("episode_id", "seg_idx", "mapped")


GENDERED = f"""gendered AS (SELECT episode_id, speaker, male_ms, female_ms, male_ms + female_ms AS total,
      greatest(male_ms, female_ms) AS best FROM ovs),
    gender AS (SELECT *, CASE WHEN best::DOUBLE / total >= 0.6 THEN CASE WHEN male_ms >= female_ms THEN 'male' ELSE 'female' END
      ELSE 'unknown' END AS g, {V.rr('best', 'total', 4)} AS conf FROM gendered)"""


@query(
    "j05_apply_gender",
    f"""WITH {FEED}, {OVERLAPS}, {GENDERED}
    SELECT f.episode_id, f.idx AS seg_idx, coalesce(g.g, 'unknown') AS gender, coalesce(g.conf, 0.0) AS gender_confidence
    FROM feed f LEFT JOIN gender g ON g.episode_id = f.episode_id AND g.speaker = f.speaker""",
)
def j05(spark, sf):
    genders = intervals.speaker_gender(intervals.gender_overlap(V.feed(spark, sf), regions(spark, sf)))
    return lookups.apply_gender(feed_segments(spark, sf).drop("gender"), genders).select(
        "episode_id", "seg_idx", "gender", "gender_confidence"
    )


@query(
    "j06_apply_host",
    f"""WITH {SEG}, h AS (SELECT episode_id, arg_max(speaker, seg_idx) AS host FROM seg WHERE speaker <> 'Unknown' GROUP BY 1)
    SELECT s.episode_id, s.seg_idx, CASE WHEN s.speaker = h.host THEN 'Host'
      WHEN s.speaker = CASE WHEN h.host = 'Speaker 2' THEN 'Speaker 1' ELSE 'Speaker 2' END THEN 'Guest' ELSE 'Unknown' END AS speaker,
      nullif(s.speaker, 'Unknown') AS speaker_original
    FROM seg s LEFT JOIN h ON h.episode_id = s.episode_id""",
)
def j06(spark, sf):
    s = V.segments(spark, sf)
    hosts = s.filter("speaker <> 'Unknown'").groupBy("episode_id").agg(F.max_by("speaker", "seg_idx").alias("host"))
    return lookups.apply_host(s, hosts).select("episode_id", "seg_idx", "speaker", "speaker_original")


MAP_REPLY = (
    "CASE WHEN episode_id % 3 = 2 THEN '' ELSE '{\"mapping\":{\"0\":\"HOST\",\"1\":\"GUEST\"},"
    "\"reasoning_brief\":{\"0\":\"asks ' || episode_id || '\"},\"confidence\":{\"1\":0.75}}' END"
)


def map_replies(spark, sf):
    from colloquy.operators.roles import mapping_replies

    episodes = V.segments(spark, sf).select("episode_id").distinct()
    return mapping_replies(episodes.withColumn("reply", F.expr(MAP_REPLY)))


@query(
    "j07_apply_model_labels",
    f"""WITH {SEG} SELECT episode_id, seg_idx, confidence AS original_confidence,
      CASE WHEN episode_id % 3 = 2 OR speaker_id = 2 THEN 'UNKNOWN' WHEN speaker_id = 0 THEN 'HOST' ELSE 'GUEST' END AS role,
      CASE WHEN episode_id % 3 = 2 OR speaker_id > 0 THEN 'No reasoning provided' ELSE 'asks ' || episode_id END AS reasoning,
      CASE WHEN episode_id % 3 <> 2 AND speaker_id = 1 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM seg""",
)
def j07(spark, sf):
    out = lookups.apply_model_labels(V.segments(spark, sf), map_replies(spark, sf))
    return out.select("episode_id", "seg_idx", "original_confidence", "role", "reasoning", "confidence")


TOP_FEED = """fdur AS (SELECT episode_id, speaker, sum(greatest(0, end_ms - start_ms))::BIGINT AS total_ms, min(idx) AS f FROM feed GROUP BY 1, 2),
    ftop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY total_ms DESC, f) AS rank FROM fdur) x WHERE rank <= 2)"""


@query(
    "j08_keep_top_speakers",
    f"""WITH {FEED}, {TOP_FEED} SELECT f.episode_id, f.idx AS seg_idx, f.speaker FROM feed f
    JOIN ftop t ON t.episode_id = f.episode_id AND t.speaker = f.speaker""",
)
def j08(spark, sf):
    rows = feed_segments(spark, sf)
    return lookups.keep_top_speakers(rows, ranking.top_speakers(rows)).select("episode_id", "seg_idx", "speaker")


def _inputs_outputs(spark, sf):
    docs = V.documents(spark, sf)
    inputs = docs.select(F.concat(F.lit("ep"), "doc_id").alias("stem"))
    done = V.table(spark, sf, "labels")
    outputs = done.select(F.concat(F.lit("ep"), "doc_id").alias("stem"), F.lit("json").alias("kind")).unionByName(
        done.filter("quality = 1").select(F.concat(F.lit("ep"), "doc_id").alias("stem"), F.lit("txt").alias("kind"))
    )
    return inputs, outputs


@query(
    "j09_skip_processed",
    """SELECT 'ep' || doc_id AS stem FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)""",
)
def j09(spark, sf):
    inputs, outputs = _inputs_outputs(spark, sf)
    return lookups.skip_processed(inputs, outputs, required=2)


_EXT = "CASE doc_id % 7 WHEN 0 THEN '.flac' WHEN 1 THEN '.mp3' WHEN 2 THEN '.mp4' WHEN 3 THEN '.wav' WHEN 4 THEN '.xyz' ELSE '.ogg' END"


@query(
    "j10_pair_media",
    f"""WITH m AS (SELECT doc_id, '/m/ep' || doc_id || {_EXT} AS path, {_EXT} AS ext FROM documents
      UNION ALL SELECT doc_id, '/m/ep' || doc_id || '.m4a', '.m4a' FROM labels),
    ranked AS (SELECT *, list_position(['.wav', '.mp3', '.mp4', '.m4a', '.flac', '.ogg'], ext) AS r FROM m),
    best AS (SELECT doc_id, arg_min(path, r) AS path FROM ranked WHERE r IS NOT NULL AND r > 0 GROUP BY 1)
    SELECT 'ep' || d.doc_id AS stem, b.path AS media_path, CASE WHEN b.path IS NULL THEN 'No matching media file' END AS error
    FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id""",
)
def j10(spark, sf):
    docs, extra = V.documents(spark, sf), V.table(spark, sf, "labels")

    def media(df, ext):
        stem = F.concat(F.lit("ep"), "doc_id")
        return df.select(stem.alias("stem"), F.concat(F.lit("/m/"), stem, ext).alias("path"), ext.alias("ext"))

    files = media(docs, F.expr(_EXT)).unionByName(media(extra, F.lit(".m4a")))
    return lookups.pair_media(docs.select(F.concat(F.lit("ep"), "doc_id").alias("stem")), files)


_CANDIDATE = "CASE WHEN episode_id % 3 = 0 THEN 'Speaker 9' ELSE 'Speaker ' || (1 + episode_id % 2) END"
SAMPLES = """early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) AS pos FROM seg) x WHERE pos <= 250),
    sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, speaker ORDER BY seg_idx) AS rn,
      trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM early WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') y WHERE rn <= 14),
    samples AS (SELECT *, CASE WHEN length(flat) > 220 THEN left(flat, 219) || chr(8230) ELSE flat END AS sample FROM sampled)"""


@query(
    "j11_accept_candidate",
    f"""WITH {SEG}, {SAMPLES}, c AS (SELECT DISTINCT episode_id, {_CANDIDATE} AS speaker FROM seg)
    SELECT c.episode_id, c.speaker FROM c WHERE EXISTS
      (SELECT 1 FROM samples s WHERE s.episode_id = c.episode_id AND s.speaker = c.speaker)""",
)
def j11(spark, sf):
    s = V.segments(spark, sf)
    candidates = s.select("episode_id").distinct().withColumn("speaker", F.expr(_CANDIDATE))
    return lookups.accept_candidate(candidates, ranking.first_n_per_speaker(s))


# --- set operations ------------------------------------------------------------


@query(
    "set01_union_formats",
    f"""WITH {SEG}, {TURN} SELECT episode_id, start_ms, end_ms, speaker, text FROM seg
    UNION ALL SELECT episode_id, start_ms, end_ms, speaker, NULL FROM turn""",
)
def set01(spark, sf):
    s = V.segments(spark, sf).select("episode_id", "start_ms", "end_ms", "speaker", "text")
    t = V.turns(spark, sf).select("episode_id", "start_ms", "end_ms", "speaker")
    return setops.union_formats(s, t)


@query(
    "set02_union_routed",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'copied' ELSE 'translated' END AS origin
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def set02(spark, sf):
    docs, done = V.documents(spark, sf).select("doc_id"), V.table(spark, sf, "labels").select("doc_id")
    translated = setops.intersection(docs, done, ["doc_id"]).withColumn("origin", F.lit("translated"))
    copied = setops.difference(docs, done, ["doc_id"]).withColumn("origin", F.lit("copied"))
    return setops.union_formats(translated, copied)


@query("set03_distinct", f"WITH {SEG} SELECT DISTINCT episode_id, speaker FROM seg")
def set03(spark, sf):
    return setops.distinct_keys(V.segments(spark, sf), "episode_id", "speaker")


@query("set04_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set04(spark, sf):
    docs, done = V.documents(spark, sf).select("doc_id"), V.table(spark, sf, "labels")
    return setops.difference(docs, done, ["doc_id"])


@query("set05_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set05(spark, sf):
    docs, done = V.documents(spark, sf), V.table(spark, sf, "labels")
    return setops.intersection(docs, done, ["doc_id"])
