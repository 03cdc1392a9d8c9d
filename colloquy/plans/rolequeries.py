"""Queries for role inference and label provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import lexicons
from colloquy.operators import intervals, lookups, ranking, roles, stats
from colloquy.operators.blocks import join_on
from colloquy.plans import views as V
from colloquy.plans.aggregates import SCORES
from colloquy.plans.joins import BEST_TURN, MAPPING, SAMPLES
from colloquy.plans.registry import query
from colloquy.plans.scalars import IS_QUESTION, PLAIN, REPLY, TRIMMED, _or, host_score_sql
from colloquy.plans.views import SEG, TURN, pct
from colloquy.session import scratch_path


def category_sql(variant: str) -> str:
    rules = lexicons.DETECTION_VARIANTS[variant]
    text = PLAIN if rules["strip_punct"] else "lower(text)"
    cases = " ".join(
        f"WHEN regexp_matches({text}, '{_or([p.lower() for p in phrases])}') THEN {i}" for i, (_, phrases) in enumerate(rules["order"])
    )
    return f"CASE {cases} END"


def hits_sql(variant: str) -> str:
    names = [f"'{n}'" for n, _ in lexicons.DETECTION_VARIANTS[variant]["order"]]
    return f"""hit AS (SELECT *, [{', '.join(names)}][cat + 1] AS category FROM (
        SELECT *, min(cat) OVER (PARTITION BY episode_id) AS best FROM (SELECT *, {category_sql(variant)} AS cat FROM seg) x) y WHERE cat = best)"""


def cascade_sql(variant: str, order: str, min_share: float, lead: int, asker_is_host: bool, versus: bool, dominance: bool = False) -> str:
    """The rule cascade as one SQL statement, with one row per episode."""
    other = lambda e: f"CASE WHEN {e} = 'Speaker 2' THEN 'Speaker 1' ELSE 'Speaker 2' END"
    unit = {
        "youtube_cta": "subscribe/like mentions" if dominance else "mentions", "host_phrases": "phrases",
        "guest_phrases": "phrases, inverted", "sponsor": "ad segments" if dominance else "segments", "intro_outro": "segments",
    }
    label = "CASE category " + " ".join(
        f"WHEN '{k}' THEN '{'sponsor_detection' if dominance and k == 'sponsor' else k} (' || hits || ' {u})'" for k, u in unit.items()
    ) + " END"
    asker = "qt.speaker" if asker_is_host else other("qt.speaker")
    counted = "' vs ' || q_other || ', '" if versus else "' asked, '"
    q_ok = f"q_total >= 5 AND q_max::DOUBLE / q_total > {min_share} AND q_max - q_other >= {lead}"
    k_ok = "k.votes > 0"
    keyword = f"({k_ok}, k.host, k.conf, k.method, k.category)"
    question = (
        f"({q_ok}, {asker}, q_max::DOUBLE / q_total, 'questions (' || q_max || {counted} || {pct('q_max', 'q_total')} || ')', 'questions')"
    )
    first, second = (keyword, question) if order == "keywords" else (question, keyword)
    rules = [first, second] if order != "dominance" else [keyword]
    rules.append("(first_s = last_s, first_s, 0.7::DOUBLE, 'speaks_first_and_last', 'fallback')")
    opener = "speaks_first"
    if dominance:
        opener = "speaks_first (fallback)"
        rules.append(
            f"(ms_total > 0 AND d_ms::DOUBLE / ms_total > 0.6, d_s, d_ms::DOUBLE / ms_total, 'dominant_speaker (' || {pct('d_ms', 'ms_total')} || ')', 'fallback')"
        )
    rules.append(f"(first_s IS NOT NULL, first_s, 0.5::DOUBLE, '{opener}', 'fallback')")
    rules.append("(true, 'Speaker 1', 0.5::DOUBLE, 'default', 'fallback')")
    split = [r[1:-1] for r in rules]

    def column(i: int) -> str:
        cases = []
        for r in split:
            parts, depth, buf, quoted = [], 0, "", False
            for ch in r:
                quoted = quoted != (ch == "'")
                depth += (ch in "([") - (ch in ")]") if not quoted else 0
                if ch == "," and depth == 0 and not quoted:
                    parts.append(buf)
                    buf = ""
                else:
                    buf += ch
            parts.append(buf)
            cases.append(f"WHEN {parts[0]} THEN {parts[i]}")
        return "CASE " + " ".join(cases) + " END"

    return f"""{hits_sql(variant)},
    vote AS (SELECT episode_id, speaker, category, count(*) AS n, min(seg_idx) AS f FROM hit WHERE speaker <> 'Unknown' GROUP BY 1, 2, 3),
    tally AS (SELECT episode_id, category, count(*) AS hits, count(*) FILTER (WHERE speaker <> 'Unknown') AS votes FROM hit GROUP BY 1, 2),
    winner AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, f) AS r FROM vote) x WHERE r = 1),
    k AS (SELECT t.episode_id, t.category, t.hits, t.votes, CASE WHEN t.category = 'guest_phrases' THEN {other('w.speaker')} ELSE w.speaker END AS host,
        CASE t.category WHEN 'youtube_cta' THEN least(0.95::DOUBLE, w.n::DOUBLE / t.votes + 0.2::DOUBLE)
          WHEN 'host_phrases' THEN least(0.95::DOUBLE, w.n::DOUBLE / t.votes + 0.25::DOUBLE)
          WHEN 'guest_phrases' THEN least(0.90::DOUBLE, w.n::DOUBLE / t.votes + 0.15::DOUBLE) ELSE w.n::DOUBLE / t.votes END AS conf,
        {label.replace('category', 't.category').replace('hits', 't.hits')} AS method
      FROM tally t LEFT JOIN winner w ON w.episode_id = t.episode_id),
    q AS (SELECT episode_id, speaker, count(*) AS n, min(seg_idx) AS f FROM seg WHERE speaker <> 'Unknown' AND {TRIMMED} <> '' AND {IS_QUESTION} GROUP BY 1, 2),
    qr AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY episode_id) AS total FROM q),
    qt AS (SELECT * FROM qr WHERE r = 1),
    qo AS (SELECT episode_id, arg_min(n, f) AS n FROM qr WHERE r > 1 GROUP BY 1),
    known AS (SELECT episode_id, arg_min(speaker, seg_idx) AS first_s, arg_max(speaker, seg_idx) AS last_s FROM seg WHERE speaker <> 'Unknown' GROUP BY 1),
    d AS (SELECT episode_id, speaker, sum(end_ms - start_ms) AS ms, min(seg_idx) AS f FROM seg WHERE speaker <> 'Unknown' GROUP BY 1, 2),
    dr AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ms DESC, f) AS r, sum(ms) OVER (PARTITION BY episode_id) AS total FROM d),
    facts AS (SELECT e.episode_id, coalesce(qt.n, 0) AS q_max, coalesce(qt.total, 0)::BIGINT AS q_total, coalesce(qo.n, 0) AS q_other,
        first_s, last_s, dr.speaker AS d_s, dr.ms AS d_ms, dr.total AS ms_total
      FROM (SELECT DISTINCT episode_id FROM seg) e LEFT JOIN qt ON qt.episode_id = e.episode_id LEFT JOIN qo ON qo.episode_id = e.episode_id
      LEFT JOIN known ON known.episode_id = e.episode_id LEFT JOIN dr ON dr.episode_id = e.episode_id AND dr.r = 1),
    host AS (SELECT f.episode_id, {column(1)} AS host, {column(2)} AS confidence, {column(3)} AS method, {column(4)} AS detection_type
      FROM facts f LEFT JOIN k ON k.episode_id = f.episode_id LEFT JOIN qt ON qt.episode_id = f.episode_id),
    verdict AS (SELECT episode_id, host, {other('host')} AS guest, confidence, method, detection_type FROM host)"""


def _register_classify(variant: str) -> None:
    @query(
        f"rl01_classify_segments_{variant}",
        f"WITH {SEG}, {hits_sql(variant)} SELECT episode_id, seg_idx, speaker, category FROM hit",
    )
    def classify(spark, sf):
        return roles.classify_segments(V.segments(spark, sf), variant).select("episode_id", "seg_idx", "speaker", "category")


for _variant in lexicons.DETECTION_VARIANTS:
    _register_classify(_variant)


@query(
    "ag09_keyword_votes",
    f"""WITH {SEG}, {hits_sql('v5')}, v AS (SELECT episode_id, speaker, count(*) AS votes FROM hit WHERE speaker <> 'Unknown' GROUP BY 1, 2)
    SELECT *, votes::DOUBLE / (sum(votes) OVER (PARTITION BY episode_id))::DOUBLE AS share FROM v""",
)
def ag09(spark, sf):
    return stats.keyword_votes(roles.classify_segments(V.segments(spark, sf)))


def _register_keywords_first(variant: str) -> None:
    @query(
        f"rl02_identify_host_keywords_first_{variant}",
        f"WITH {SEG}, {cascade_sql(variant, 'keywords', 0.55, 5, True, True)} SELECT * FROM verdict",
    )
    def identify(spark, sf):
        return roles.identify_host_keywords_first(V.segments(spark, sf), variant)


def _register_questions_first(variant: str, interview: bool) -> None:
    style = "interview" if interview else "conversation"
    lead = 5 if variant == "v3" else 0

    @query(
        f"rl03_identify_host_questions_first_{variant}_{style}",
        f"WITH {SEG}, {cascade_sql(variant, 'questions', 0.6, lead, interview, variant == 'v3')} SELECT * FROM verdict",
    )
    def identify(spark, sf):
        return roles.identify_host_questions_first(V.segments(spark, sf), variant, interview)


def _register_dominance(variant: str) -> None:
    @query(
        f"rl04_identify_host_dominance_{variant}",
        f"WITH {SEG}, {cascade_sql(variant, 'dominance', 0.6, 0, True, True, dominance=True)} SELECT * FROM verdict",
    )
    def identify(spark, sf):
        return roles.identify_host_dominance(V.segments(spark, sf), variant)


for _variant in ("v4", "v5"):
    _register_keywords_first(_variant)
for _variant in ("v2", "v3", "combined"):
    for _interview in (False, True):
        _register_questions_first(_variant, _interview)
for _variant in ("v1", "with_gender"):
    _register_dominance(_variant)


def _map_roles_sql(mode: str) -> str:
    rule = {
        "time": "true", "first": "fa <= fb",
        "heuristic": "CASE WHEN abs(coalesce(sa, 0) - coalesce(sb, 0)) >= 2.5 THEN coalesce(sa, 0) > coalesce(sb, 0) ELSE true END",
    }[mode]
    return f"""WITH {SEG}, {TURN}, d AS (SELECT episode_id, speaker, sum(greatest(0, end_ms - start_ms)) AS ms, min(turn_idx) AS f,
        arg_min(start_ms, turn_idx) AS st FROM turn GROUP BY 1, 2),
      t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ms DESC, f) AS r FROM d) x WHERE r <= 2),
      sc AS (SELECT episode_id, speaker_raw, sum({host_score_sql('text')}) AS score FROM seg GROUP BY 1, 2),
      p AS (SELECT a.episode_id, a.speaker AS a, b.speaker AS b, a.st AS fa, b.st AS fb, x.score AS sa, y.score AS sb
        FROM (SELECT * FROM t WHERE r = 1) a LEFT JOIN (SELECT * FROM t WHERE r = 2) b ON a.episode_id = b.episode_id
        LEFT JOIN sc x ON x.episode_id = a.episode_id AND x.speaker_raw = a.speaker
        LEFT JOIN sc y ON y.episode_id = b.episode_id AND y.speaker_raw = b.speaker),
      v AS (SELECT *, (b IS NULL OR {rule}) AS a_hosts FROM p)
      SELECT t.episode_id, t.speaker, CASE WHEN v.a_hosts = (t.r = 1) THEN 'Host' ELSE 'Guest' END AS label
      FROM t JOIN v ON v.episode_id = t.episode_id"""


def _register_map_roles(mode: str) -> None:
    @query(f"rl05_map_roles_{mode}", _map_roles_sql(mode))
    def map_roles(spark, sf):
        return roles.map_roles(V.turns(spark, sf), V.segments(spark, sf), mode)


for _mode in ("time", "first", "heuristic"):
    _register_map_roles(_mode)


@query(
    "rl06_host_by_time",
    f"""WITH {SEG}, d AS (SELECT episode_id, speaker, sum(end_ms - start_ms) AS ms, min(seg_idx) AS f FROM seg GROUP BY 1, 2)
    SELECT episode_id, speaker, CASE WHEN row_number() OVER (PARTITION BY episode_id ORDER BY ms DESC, f) = 1 THEN 'HOST' ELSE 'GUEST' END AS role FROM d""",
)
def rl06(spark, sf):
    return roles.host_by_time(V.segments(spark, sf))


_SCORED = f"""{SAMPLES}, {SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, first_idx) AS r FROM scores)"""


@query(
    "rl07_host_by_score",
    f"WITH {SEG}, {_SCORED} SELECT episode_id, speaker, CASE WHEN r = 1 THEN 'HOST' ELSE 'GUEST' END AS role FROM ranked",
)
def rl07(spark, sf):
    return roles.host_by_score(V.segments(spark, sf))


_SCORED_ASR = _SCORED.replace("ORDER BY score DESC", "ORDER BY score_asr DESC")


@query(
    "rl07_host_by_score_asr",
    f"WITH {SEG}, {_SCORED_ASR} SELECT episode_id, speaker, CASE WHEN r = 1 THEN 'HOST' ELSE 'GUEST' END AS role FROM ranked",
)
def rl07_asr(spark, sf):
    return roles.host_by_score(V.segments(spark, sf), asr=True)


# One response per episode; its form and the host it names follow from the id.
_NAMED = "'Speaker ' || (episode_id * 3 % 4)"
_RESPONSE_OBJ = "'{\"host_speaker_raw\": \"' || " + _NAMED + " || '\"}'"


def responses(spark, sf):
    """Raw chat responses, the reply text being fenced, in prose, plain, empty or broken."""
    content = REPLY.replace("{obj}", _RESPONSE_OBJ).replace("{{", "{").replace("turn %", "episode_id %")
    envelope = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.expr(content).alias("content")).alias("message"))).alias("choices"))
    )
    return V.segments(spark, sf).select("episode_id").distinct().withColumn("response", envelope)


def _resolved_sql(scored: str) -> str:
    return f"""WITH {SEG}, {scored}, c AS (SELECT DISTINCT episode_id, CASE WHEN episode_id % 5 < 3 THEN {_NAMED} END AS named FROM seg),
    h AS (SELECT r.episode_id, max(CASE WHEN r.speaker = c.named THEN c.named END) AS accepted, max(CASE WHEN r.r = 1 THEN r.speaker END) AS scored
      FROM ranked r JOIN c ON c.episode_id = r.episode_id GROUP BY 1)
    SELECT r.episode_id, r.speaker, CASE WHEN r.speaker = coalesce(h.accepted, h.scored) THEN 'HOST' ELSE 'GUEST' END AS role,
      CASE WHEN h.accepted IS NULL THEN 'score' ELSE 'model' END AS source FROM ranked r JOIN h ON h.episode_id = r.episode_id"""


@query("rl08_resolve_roles", _resolved_sql(_SCORED))
def rl08(spark, sf):
    return roles.resolve_roles(responses(spark, sf), V.segments(spark, sf))


@query("rl08_resolve_roles_asr", _resolved_sql(_SCORED_ASR))
def rl08_asr(spark, sf):
    return roles.resolve_roles(responses(spark, sf), V.segments(spark, sf), asr=True)


@query(
    "rl02_identify_host_forced",
    f"""WITH {SEG}, s AS (SELECT episode_id, array_agg(DISTINCT speaker) FILTER (speaker IN ('Speaker 1', 'Speaker 2')) AS known FROM seg GROUP BY 1)
    SELECT episode_id, 'Speaker 2' AS host, 'manual_override' AS method FROM s""",
)
def rl02_forced(spark, sf):
    """A host named by hand overrides all rules."""
    found = roles.identify_host_keywords_first(V.segments(spark, sf), "v5", force_host="Speaker 2")
    return found.select("episode_id", "host", "method")


_PAIR = (
    "CASE episode_id % 4 WHEN 0 THEN '{\"host_speaker\":\"Speaker 2\",\"guest_speaker\":\"Speaker 1\"}' "
    "WHEN 1 THEN '```json{\"host_speaker\":\"Speaker 1\",\"guest_speaker\":\"Speaker 1\"}```' "
    "WHEN 2 THEN 'I think {\"host_speaker\":\"Speaker 1\",\"guest_speaker\":\"Unknown\"}' ELSE '' END"
)


@query(
    "rl09_roles_from_pair_reply",
    f"""WITH {SEG}, d AS (SELECT episode_id, speaker, sum(greatest(0, end_ms - start_ms)) AS ms, min(seg_idx) AS f FROM seg GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ms DESC, f) AS r, count(*) OVER (PARTITION BY episode_id) AS n FROM d)
    SELECT episode_id, speaker, CASE episode_id % 4
      WHEN 0 THEN CASE speaker WHEN 'Speaker 2' THEN 'HOST' WHEN 'Speaker 1' THEN 'GUEST' ELSE 'UNKNOWN' END
      WHEN 1 THEN CASE WHEN n < 2 THEN CASE WHEN speaker = 'Speaker 1' THEN 'GUEST' ELSE 'UNKNOWN' END
        WHEN r = 1 THEN 'HOST' WHEN r = 2 THEN 'GUEST' ELSE 'UNKNOWN' END
      WHEN 2 THEN CASE speaker WHEN 'Speaker 1' THEN 'HOST' WHEN 'Unknown' THEN 'GUEST' ELSE 'UNKNOWN' END
      ELSE 'UNKNOWN' END AS role FROM r""",
)
def rl09(spark, sf):
    s = V.segments(spark, sf)
    replies = s.select("episode_id").distinct().withColumn("reply", F.expr(_PAIR))
    return roles.roles_from_pair_reply(replies, s)


@query(
    "rl10_label_provenance",
    f"""WITH {SEG}, {cascade_sql('v5', 'keywords', 0.55, 5, True, True)}
    SELECT episode_id, host AS host_speaker, guest AS guest_speaker, confidence, method, detection_type FROM verdict""",
)
def rl10(spark, sf):
    hosts = roles.identify_host_keywords_first(V.segments(spark, sf), "v5")
    return roles.label_provenance(hosts).select("episode_id", "host_identification.*")


@query(
    "rl11_labeled_transcript",
    f"""WITH {SEG}, {cascade_sql('v5', 'keywords', 0.55, 5, True, True)}
    SELECT s.episode_id, s.seg_idx, CASE WHEN s.speaker = v.host THEN 'Host' WHEN s.speaker = v.guest THEN 'Guest' ELSE 'Unknown' END AS speaker,
      v.method FROM seg s JOIN verdict v ON v.episode_id = s.episode_id""",
)
def rl11(spark, sf):
    """Segments to Host/Guest transcript in one plan, method attached."""
    s = V.segments(spark, sf)
    hosts = roles.identify_host_keywords_first(s, "v5")
    return lookups.apply_host(s, hosts, carry=["method"]).select("episode_id", "seg_idx", "speaker", "method")


@query(
    "rl12_diarized_to_roles",
    f"""WITH {SEG.replace("seg AS (", "raw AS (", 1)}, {TURN}, {BEST_TURN.replace("FROM seg s", "FROM raw s")}, {MAPPING},
    seg AS (SELECT r.* EXCLUDE (speaker), coalesce(m.label, 'Unknown') AS speaker FROM raw r
      LEFT JOIN best b ON b.episode_id = r.episode_id AND b.seg_idx = r.seg_idx AND b.ov >= 100
      LEFT JOIN mapping m ON m.episode_id = r.episode_id AND m.speaker = b.speaker),
    {cascade_sql('combined', 'questions', 0.6, 0, True, False)}
    SELECT v.*, count_if(s.speaker = v.host)::BIGINT AS host_segments, count_if(s.speaker = v.guest)::BIGINT AS guest_segments,
      count_if(s.speaker NOT IN (v.host, v.guest))::BIGINT AS unknown_segments
    FROM verdict v JOIN seg s ON s.episode_id = v.episode_id GROUP BY ALL""",
)
def rl12(spark, sf):
    """Turns and segments to mapped speakers, host and counts per episode."""
    s, t = V.segments(spark, sf), V.turns(spark, sf)
    assigned = intervals.assign_speaker(s.drop("speaker"), t)
    mapped = lookups.map_speakers(assigned, ranking.speaker_mapping(t), on="assigned").withColumnRenamed("mapped", "speaker")
    # the rules and the counts both read it: written once, it is not joined again
    path = scratch_path(spark, "mapped")
    mapped.write.parquet(path)
    mapped = spark.read.schema(mapped.schema).parquet(path)
    hosts = roles.identify_host_questions_first(mapped, "combined", interview_style=True)
    return join_on(stats.category_counts(lookups.apply_host(mapped, hosts)), hosts, ["episode_id"])
