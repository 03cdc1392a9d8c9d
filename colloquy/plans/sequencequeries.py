"""Queries for the order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import folds, sequences, textops
from colloquy.plans import views as V
from colloquy.plans.aggregates import EVEN
from colloquy.plans.joins import feed_segments, feed_turns
from colloquy.plans.registry import query
from colloquy.plans.views import FEED, SEG, TURN, WORD

ISLANDS = """lagged AS (SELECT *, lag(speaker) OVER w AS ps, lag(end_ms) OVER w AS pe FROM word WHERE speaker IS NOT NULL
      WINDOW w AS (PARTITION BY episode_id ORDER BY word_idx)),
    marked AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> speaker OR start_ms - pe > 800 THEN 1 ELSE 0 END)
      OVER (PARTITION BY episode_id ORDER BY word_idx) AS island FROM lagged)"""


@query(
    "seq01_words_to_segments",
    f"""WITH {WORD}, {ISLANDS} SELECT episode_id, min(word_idx) AS head_idx, min(speaker) AS speaker, arg_min(start_ms, word_idx) AS start_ms,
      arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_tokens, trim(string_agg(token, ' ' ORDER BY word_idx)) AS text
    FROM marked GROUP BY episode_id, island""",
)
def seq01(spark, sf):
    return sequences.words_to_segments(V.words(spark, sf))


@query(
    "seq01_words_to_segments_drop_blank",
    f"""WITH {WORD}, blank AS (SELECT * REPLACE (CASE WHEN word_idx % 3 = 0 THEN '' ELSE token END AS token) FROM word),
    {ISLANDS.replace("FROM word", "FROM blank")} SELECT episode_id, min(word_idx) AS head_idx, min(speaker) AS speaker, arg_min(start_ms, word_idx) AS start_ms,
      arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_tokens, trim(string_agg(token, ' ' ORDER BY word_idx)) AS text
    FROM marked GROUP BY episode_id, island HAVING trim(string_agg(token, ' ' ORDER BY word_idx)) <> ''""",
)
def seq01_drop_blank(spark, sf):
    words = V.words(spark, sf).withColumn("token", F.when(F.col("word_idx") % 3 == 0, "").otherwise(F.col("token")))
    return sequences.words_to_segments(words, drop_blank=True)


def _merged(source: str, idx: str, minimum: int) -> str:
    return f"""h AS (SELECT *, sum(CASE WHEN end_ms - start_ms >= {minimum} THEN 1 ELSE 0 END) OVER w AS raw_island
      FROM {source} WINDOW w AS (PARTITION BY episode_id ORDER BY {idx}))
    SELECT h.episode_id, min({idx}) AS turn_idx, arg_min(start_ms, {idx}) AS start_ms, arg_max(end_ms, {idx}) AS end_ms,
      arg_min(speaker, {idx}) AS speaker, count(*) AS n_merged FROM h GROUP BY h.episode_id, raw_island"""


@query("seq02_merge_short_turns", f"WITH {TURN}, {_merged('turn', 'turn_idx', 300)}")
def seq02(spark, sf):
    return sequences.merge_short_turns(V.turns(spark, sf))


@query("seq02_merge_short_turns_feed", f"WITH {FEED}, {_merged('feed', 'idx', 20000)}")
def seq02_feed(spark, sf):
    return sequences.merge_short_turns(feed_turns(spark, sf), 20000)


@query(
    "seq03_chunk_words",
    f"""WITH {WORD}, w AS (SELECT episode_id, coalesce(speaker, 0) AS speaker, start_ms, end_ms, token, word_idx FROM word),
    n AS (SELECT *, row_number() OVER (PARTITION BY episode_id, speaker ORDER BY start_ms, word_idx) AS rn FROM w)
    SELECT episode_id, speaker, (rn - 1) // 12 AS chunk, arg_min(start_ms, rn) AS start_ms, arg_max(end_ms, rn) AS end_ms,
      string_agg(token, ' ' ORDER BY rn) AS text FROM n GROUP BY 1, 2, 3""",
)
def seq03(spark, sf):
    return sequences.chunk_words(V.words(spark, sf))


_LABELS = ("SPEAKER_00", "SPEAKER_01", "SPEAKER_02")


def _votes(label: str) -> str:
    return "(" + " + ".join(f"coalesce(({c} = '{label}')::INT, 0)" for c in ("r.p1", "r.p2", "r.p3", "s.n1", "s.n2", "s.n3")) + ")"


_NEIGHBOURS = "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in ("r.p1", "r.p2", "r.p3", "s.n1", "s.n2", "s.n3")) + ")"
_SMOOTHED = (
    "CASE WHEN s.rn = s.n - 1 THEN s.speaker "
    + " ".join(f"WHEN s.speaker <> '{lab}' AND {_votes(lab)} >= {_NEIGHBOURS} * 0.75 THEN '{lab}'" for lab in _LABELS)
    + " ELSE s.speaker END"
)


@query(
    "seq04_smooth_turns",
    f"""WITH RECURSIVE {FEED}, s AS (SELECT episode_id, idx, speaker, row_number() OVER w - 1 AS rn, lead(speaker, 1) OVER w AS n1,
        lead(speaker, 2) OVER w AS n2, lead(speaker, 3) OVER w AS n3, count(*) OVER (PARTITION BY episode_id) AS n
      FROM feed WINDOW w AS (PARTITION BY episode_id ORDER BY idx)),
    r AS (SELECT episode_id, idx, rn, speaker AS p1, NULL::VARCHAR AS p2, NULL::VARCHAR AS p3 FROM s WHERE rn = 0
      UNION ALL SELECT s.episode_id, s.idx, s.rn, {_SMOOTHED}, r.p1, r.p2 FROM r JOIN s ON s.episode_id = r.episode_id AND s.rn = r.rn + 1)
    SELECT r.episode_id, r.idx AS turn_idx, s.speaker, r.p1 AS smoothed FROM r JOIN s ON s.episode_id = r.episode_id AND s.idx = r.idx""",
)
def seq04(spark, sf):
    out = folds.smooth_turns(feed_turns(spark, sf))
    return out.select("episode_id", "turn_idx", "speaker", "smoothed")


@query(
    "seq05_fix_overlap",
    f"""WITH {SEG} SELECT episode_id, seg_idx, greatest(start_ms, lag(end_ms) OVER (PARTITION BY episode_id ORDER BY seg_idx)) AS start_ms, end_ms FROM seg""",
)
def seq05(spark, sf):
    return sequences.fix_overlap(V.segments(spark, sf)).select("episode_id", "seg_idx", "start_ms", "end_ms")


@query(
    "seq06_fix_flicker",
    f"""WITH RECURSIVE {FEED}, s AS (SELECT episode_id, idx, speaker, row_number() OVER (PARTITION BY episode_id ORDER BY idx) - 1 AS rn FROM feed),
    r AS (SELECT episode_id, idx, rn, speaker AS one, NULL::VARCHAR AS two FROM s WHERE rn = 0
      UNION ALL SELECT s.episode_id, s.idx, s.rn, CASE WHEN s.speaker = r.two AND s.speaker <> r.one THEN r.one ELSE s.speaker END, r.one
      FROM r JOIN s ON s.episode_id = r.episode_id AND s.rn = r.rn + 1)
    SELECT episode_id, idx AS seg_idx, one AS fixed FROM r""",
)
def seq06(spark, sf):
    return folds.fix_flicker(feed_segments(spark, sf)).select("episode_id", "seg_idx", "fixed")


@query(
    "seq07_adaptive_gap",
    f"""WITH {FEED}, g AS (SELECT episode_id, start_ms - lag(end_ms) OVER (PARTITION BY episode_id ORDER BY idx) AS gap FROM feed),
    l AS (SELECT episode_id, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS g FROM g GROUP BY 1)
    SELECT episode_id, CASE WHEN len(g) IS NULL OR len(g) = 0 THEN 0.8::DOUBLE ELSE greatest(300.0::DOUBLE, g[len(g) // 2 + 1]
      + 0.5::DOUBLE * (g[3 * len(g) // 4 + 1] - g[len(g) // 4 + 1])) / 1000 END AS gap_s FROM l""",
)
def seq07(spark, sf):
    return sequences.adaptive_gap(feed_segments(spark, sf))


@query(
    "seq08_first_appearance",
    f"WITH {FEED} SELECT episode_id, speaker, arg_min(start_ms, idx) AS first_start_ms, min(idx) AS first_idx FROM feed GROUP BY 1, 2",
)
def seq08(spark, sf):
    return sequences.first_appearance(feed_turns(spark, sf))


@query(
    "seq09_first_last_speaker",
    f"WITH {SEG} SELECT episode_id, arg_min(speaker, seg_idx) AS first_speaker, arg_max(speaker, seg_idx) AS last_speaker FROM seg GROUP BY 1",
)
def seq09(spark, sf):
    return sequences.first_last_speaker(V.segments(spark, sf))


LINE_LIST = "CASE WHEN ends_with(text, chr(10)) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END"


CHUNKS_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, list_transform({LINE_LIST}, lambda x: regexp_replace(x, '\\s+$', '')) AS lines FROM documents),
    r AS (SELECT doc_id, lines, 0 AS i, []::VARCHAR[] AS chunks, []::VARCHAR[] AS held, 0::BIGINT AS size FROM l
      UNION ALL SELECT doc_id, lines, i + 1,
        CASE WHEN length(lines[i + 1]) > 1200 THEN list_concat(CASE WHEN len(held) > 0 THEN list_append(chunks, array_to_string(held, chr(10))) ELSE chunks END,
            list_transform(range(0, (length(lines[i + 1]) - 1) // 1200 + 1), lambda k: substr(lines[i + 1], k * 1200 + 1, 1200)))
          WHEN size + length(lines[i + 1]) + 1 <= 1200 THEN chunks
          ELSE CASE WHEN len(held) > 0 THEN list_append(chunks, array_to_string(held, chr(10))) ELSE chunks END END,
        CASE WHEN length(lines[i + 1]) > 1200 THEN []::VARCHAR[] WHEN size + length(lines[i + 1]) + 1 <= 1200 THEN list_append(held, lines[i + 1])
          ELSE [lines[i + 1]] END,
        CASE WHEN length(lines[i + 1]) > 1200 THEN 0 WHEN size + length(lines[i + 1]) + 1 <= 1200 THEN size + length(lines[i + 1]) + 1
          ELSE length(lines[i + 1]) + 1 END
      FROM r WHERE i < len(lines)),
    done AS (SELECT doc_id, CASE WHEN len(held) > 0 THEN list_append(chunks, array_to_string(held, chr(10))) ELSE chunks END AS chunks FROM r WHERE i = len(lines))
    SELECT doc_id, (k - 1)::INTEGER AS chunk_idx, chunks[k] AS chunk FROM done, range(1, len(chunks) + 1) t(k)"""


@query("seq10_chunk_lines", CHUNKS_SQL)
def seq10(spark, sf):
    return folds.chunk_lines(V.documents(spark, sf).select("doc_id", "text"))


@query("seq10_chunk_parts", CHUNKS_SQL)
def seq10_parts(spark, sf):
    """The same chunks from documents that come in parts of eight lines."""
    lines = sequences.split_lines(V.documents(spark, sf).select("doc_id", "text"))
    parts = textops.reassemble_text(lines, "doc_id", "line_idx", "line", part_bits=3)
    # the lines hold an empty last one only if a break of its own followed it
    closed = F.when(F.col("part") == F.col("n_parts") - 1, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return folds.chunk_parts(parts.select("doc_id", F.col("part").alias("offset"), closed.alias("text")))


@query("seq11_even_sample", f"WITH {FEED}, {EVEN} SELECT episode_id, speaker, idx FROM picked")
def seq11(spark, sf):
    return sequences.even_sample(V.feed(spark, sf), order="idx").select("episode_id", "speaker", "idx")


@query(
    "seq12_line_index",
    f"""WITH l AS (SELECT doc_id, {LINE_LIST} AS lines FROM documents)
    SELECT doc_id, (k - 1)::INTEGER AS line_idx, lines[k] AS line FROM l, range(1, len(lines) + 1) t(k)""",
)
def seq12(spark, sf):
    return sequences.split_lines(V.documents(spark, sf).select("doc_id", "text"))
