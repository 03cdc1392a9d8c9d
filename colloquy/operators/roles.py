"""Who is the host: rule cascades over keyword, question and position evidence.

Evidence is counted per (episode, speaker) with mergeable aggregates; only these
few rows per episode reach the second grouping, where the rules are tried in
order and the first that yields a host wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import lexicons
from colloquy.functions.labels import other_speaker
from colloquy.functions.numeric import percent_text
from colloquy.functions.replies import MAPPING, PAIR, parse_model_json, reply_content
from colloquy.functions.text import contains_keywords, contains_keywords_nopunct, is_question_segment, strip_ws
from colloquy.operators import ranking, stats
from colloquy.operators.blocks import join_on
from colloquy.operators.filters import UNKNOWN_LABELS
from colloquy.session import scratch_path

# Boost and ceiling of the vote share, and the wording of the method text.
_CATEGORY_RULES = {
    "youtube_cta": (0.2, 0.95, "youtube_cta", "mentions"),
    "host_phrases": (0.25, 0.95, "host_phrases", "phrases"),
    "guest_phrases": (0.15, 0.90, "guest_phrases", "phrases, inverted"),
    "sponsor": (0.0, 1.0, "sponsor", "segments"),
    "intro_outro": (0.0, 1.0, "intro_outro", "segments"),
}
_DOMINANCE_RULES = {
    **_CATEGORY_RULES,
    "youtube_cta": (0.2, 0.95, "youtube_cta", "subscribe/like mentions"),
    "sponsor": (0.0, 1.0, "sponsor_detection", "ad segments"),
}


def category(text: str | Column, variant: str = "v5") -> Column:
    """The first matching category of a segment, NULL when none matches."""
    rules = lexicons.DETECTION_VARIANTS[variant]
    match = contains_keywords_nopunct if rules["strip_punct"] else contains_keywords
    out = F.lit(None).cast("string")
    for name, phrases in reversed(rules["order"]):
        out = F.when(match(text, phrases), F.lit(name)).otherwise(out)
    return out


def classify_segments(segments: DataFrame, variant: str = "v5") -> DataFrame:
    """Segments of each episode's best category, with that category.

    Matching the phrases costs most, so the matched segments are written once, to
    the shared scratch folder, and the best category is found and applied there.
    """
    names = [name for name, _ in lexicons.DETECTION_VARIANTS[variant]["order"]]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category"))
    hits = (
        segments.withColumn("category", category("text", variant))
        .filter(F.col("category").isNotNull())
        .withColumn("__rank", rank)
    )
    path = scratch_path(segments.sparkSession, "hits")
    hits.write.parquet(path)
    hits = segments.sparkSession.read.schema(hits.schema).parquet(path)
    best = hits.groupBy("episode_id").agg(F.min("__rank").alias("__rank"))
    return join_on(hits, best, ["episode_id", "__rank"], "left_semi", ["__rank"]).drop("__rank")


def _known(speaker: str = "speaker") -> Column:
    return ~F.coalesce(F.col(speaker), F.lit("Unknown")).isin(*UNKNOWN_LABELS)


def _evidence(segments: DataFrame, variant: str) -> DataFrame:
    """One row per (episode, speaker): counts and first positions of all evidence."""
    names = [name for name, _ in lexicons.DETECTION_VARIANTS[variant]["order"]]
    asked = (strip_ws("text") != "") & is_question_segment("text")
    marked = segments.select(
        "episode_id",
        F.coalesce("speaker", F.lit("Unknown")).alias("speaker"),
        "seg_idx",
        (F.col("end_ms") - F.col("start_ms")).alias("ms"),
        category("text", variant).alias("cat"),
        asked.alias("asked"),
    )
    per_category = []
    for name in names:
        hit = F.col("cat") == name
        per_category += [
            F.count_if(hit).alias(f"n_{name}"),
            F.min(F.when(hit, F.col("seg_idx"))).alias(f"f_{name}"),
        ]
    return marked.groupBy("episode_id", "speaker").agg(
        *per_category,
        F.count_if("asked").alias("q"),
        F.min(F.when(F.col("asked"), F.col("seg_idx"))).alias("f_q"),
        F.sum("ms").alias("ms"),
        F.min("seg_idx").alias("first_idx"),
        F.max("seg_idx").alias("last_idx"),
    )


def _episode_evidence(segments: DataFrame, variant: str) -> DataFrame:
    names = [name for name, _ in lexicons.DETECTION_VARIANTS[variant]["order"]]
    known = _known()
    aggs = []
    for name in names:
        n, f = F.col(f"n_{name}"), F.col(f"f_{name}")
        voted = known & (n > 0)
        aggs += [
            F.sum(n).alias(f"hits_{name}"),
            F.sum(F.when(known, n).otherwise(0)).alias(f"votes_{name}"),
            F.max_by("speaker", F.when(voted, F.struct(n, -f))).alias(f"top_{name}"),
            F.max(F.when(voted, n)).alias(f"lead_{name}"),
        ]
    asks = known & (F.col("q") > 0)
    aggs += [
        F.sum(F.when(known, F.col("q")).otherwise(0)).alias("q_total"),
        F.max(F.when(asks, F.col("q"))).alias("q_max"),
        F.max_by("speaker", F.when(asks, F.struct(F.col("q"), -F.col("f_q")))).alias("q_top"),
        *[F.max(F.when(F.col("ask_rank") == i, F.struct("speaker", "q"))).alias(f"asker_{i}") for i in (1, 2)],
        F.min_by("speaker", F.when(known, F.col("first_idx"))).alias("first_speaker"),
        F.max_by("speaker", F.when(known, F.col("last_idx"))).alias("last_speaker"),
        F.sum(F.when(known, F.col("ms")).otherwise(0)).alias("ms_total"),
        F.max_by("speaker", F.when(known, F.struct(F.col("ms"), -F.col("first_idx")))).alias("ms_top"),
        F.max(F.when(known, F.col("ms"))).alias("ms_max"),
    ]
    # The lead is measured against the first asker other than the winner, who is
    # among the first two.
    in_order = Window.partitionBy("episode_id").orderBy(F.when(asks, F.col("f_q")).asc_nulls_last())
    ranked = _evidence(segments, variant).withColumn("ask_rank", F.when(asks, F.row_number().over(in_order)))
    other = F.when(F.col("asker_1.speaker") == F.col("q_top"), F.col("asker_2.q")).otherwise(F.col("asker_1.q"))
    return ranked.groupBy("episode_id").agg(*aggs).withColumn("q_other", F.coalesce(other, F.lit(0)))


def _verdict(host: Column, confidence: Column, method: Column, detection: Column) -> Column:
    return F.struct(
        host.alias("host"), confidence.cast("double").alias("confidence"),
        method.alias("method"), detection.alias("detection_type"),
    )


def _by_keywords(variant: str, wording: dict) -> Column:
    """Verdict of the episode's best category; NULL if only Unknown speakers hit it."""
    out = F.lit(None)
    for name, _ in reversed(lexicons.DETECTION_VARIANTS[variant]["order"]):
        boost, ceiling, label, unit = wording[name]
        hits, votes, top = F.col(f"hits_{name}"), F.col(f"votes_{name}"), F.col(f"top_{name}")
        share = F.col(f"lead_{name}") / F.nullif(votes, F.lit(0))
        confidence = F.least(F.lit(ceiling), share + boost) if boost else share
        host = other_speaker(top) if name == "guest_phrases" else top
        method = F.concat(F.lit(f"{label} ("), hits.cast("string"), F.lit(f" {unit})"))
        verdict = F.when(votes > 0, _verdict(host, confidence, method, F.lit(name)))
        out = F.when(hits > 0, verdict).otherwise(out)
    return out


def _by_questions(min_share: float, min_lead: int, asker_is_host: bool, versus: bool) -> Column:
    total, most, other = F.col("q_total"), F.col("q_max"), F.col("q_other")
    ratio = most / F.nullif(total, F.lit(0))
    host = F.col("q_top") if asker_is_host else other_speaker("q_top")
    percent = percent_text(most, F.nullif(total, F.lit(0)))
    wording = [F.lit(" vs "), other.cast("string"), F.lit(", ")] if versus else [F.lit(" asked, ")]
    method = F.concat(F.lit("questions ("), most.cast("string"), *wording, percent, F.lit(")"))
    holds = (total >= 5) & (ratio > min_share) & (most - other >= min_lead)
    return F.when(holds, _verdict(host, ratio, method, F.lit("questions")))


def _fallback(dominance: bool = False) -> Column:
    first, last = F.col("first_speaker"), F.col("last_speaker")
    kind = F.lit("fallback")
    both = F.when(
        first.isNotNull() & (first == last), _verdict(first, F.lit(0.7), F.lit("speaks_first_and_last"), kind)
    )
    rules = [both]
    opener = "speaks_first"
    if dominance:
        opener = "speaks_first (fallback)"
        total, most = F.col("ms_total"), F.col("ms_max")
        ratio = most / F.nullif(total, F.lit(0))
        method = F.concat(F.lit("dominant_speaker ("), percent_text(most, F.nullif(total, F.lit(0))), F.lit(")"))
        rules.append(F.when((total > 0) & (ratio > 0.6), _verdict(F.col("ms_top"), ratio, method, kind)))
    rules.append(F.when(first.isNotNull(), _verdict(first, F.lit(0.5), F.lit(opener), kind)))
    rules.append(_verdict(F.lit("Speaker 1"), F.lit(0.5), F.lit("default"), kind))
    return F.coalesce(*rules)


def _decide(evidence: DataFrame, rules: list[Column], force_host: str | None) -> DataFrame:
    if force_host:
        rules = [_verdict(F.lit(force_host), F.lit(1.0), F.lit("manual_override"), F.lit("manual"))]
    chosen = evidence.select("episode_id", F.coalesce(*rules).alias("v"))
    return chosen.select(
        "episode_id", "v.host", other_speaker("v.host").alias("guest"),
        "v.confidence", "v.method", "v.detection_type",
    )


def identify_host_keywords_first(
    segments: DataFrame, variant: str = "v5", force_host: str | None = None
) -> DataFrame:
    """Keywords, then questions (the asker is the host), then position."""
    rules = [_by_keywords(variant, _CATEGORY_RULES), _by_questions(0.55, 5, True, True), _fallback()]
    return _decide(_episode_evidence(segments, variant), rules, force_host)


def identify_host_questions_first(
    segments: DataFrame, variant: str = "v3", interview_style: bool = False, force_host: str | None = None
) -> DataFrame:
    """Questions, then keywords, then position.

    In an interview the asker is the host; otherwise the other speaker is.
    Variant v3 also wants a lead of five questions.
    """
    lead = 5 if variant == "v3" else 0
    rules = [
        _by_questions(0.6, lead, interview_style, variant == "v3"),
        _by_keywords(variant, _CATEGORY_RULES),
        _fallback(),
    ]
    return _decide(_episode_evidence(segments, variant), rules, force_host)


def identify_host_dominance(segments: DataFrame, variant: str = "v1") -> DataFrame:
    """Keyword votes, then first and last, then a talk share above 0.6, then first."""
    rules = [_by_keywords(variant, _DOMINANCE_RULES), _fallback(dominance=True)]
    return _decide(_episode_evidence(segments, variant), rules, None)


def label_provenance(hosts: DataFrame) -> DataFrame:
    """Identification as one struct per episode, for the labelled document."""
    return hosts.select(
        "episode_id",
        F.struct(
            F.col("host").alias("host_speaker"), F.col("guest").alias("guest_speaker"), "confidence", "method", "detection_type"
        ).alias("host_identification"),
    )


def map_roles(turns: DataFrame, segments: DataFrame, mode: str = "heuristic", min_gap: float = 2.5) -> DataFrame:
    """Host and Guest among the two longest speakers of the turns.

    Modes: `time` longest, `first` earliest, `heuristic` by segment score with
    `time` as the fallback when the scores are close. A lone speaker is Host.
    """
    top = ranking.top_speakers(turns, 2, "turn_idx")
    first = turns.groupBy("episode_id", "speaker").agg(F.min_by("start_ms", "turn_idx").alias("first_ms"))
    scored = join_on(top, first, ["episode_id", "speaker"])
    if mode == "heuristic":
        scored = join_on(scored, stats.host_score(segments), ["episode_id", "speaker"], "left").fillna({"score": 0.0})
    else:
        scored = scored.withColumn("score", F.lit(0.0))
    a, b = F.col("rank") == 1, F.col("rank") == 2

    def pick(flag: Column, name: str) -> Column:
        return F.max(F.when(flag, F.col(name)))

    pair = scored.groupBy("episode_id").agg(
        pick(a, "speaker").alias("a"), pick(b, "speaker").alias("b"),
        pick(a, "first_ms").alias("fa"), pick(b, "first_ms").alias("fb"),
        pick(a, "score").alias("sa"), pick(b, "score").alias("sb"),
    )
    if mode == "time":
        a_hosts = F.lit(True)
    elif mode == "first":
        a_hosts = F.col("fa") <= F.col("fb")
    else:
        a_hosts = F.when(F.abs(F.col("sa") - F.col("sb")) >= min_gap, F.col("sa") > F.col("sb")).otherwise(True)
    a_hosts = F.col("b").isNull() | a_hosts
    label = F.when(a_hosts == (F.col("rank") == 1), "Host").otherwise("Guest")
    return join_on(scored, pair, ["episode_id"]).select("episode_id", "speaker", label.alias("label"))


def host_by_time(segments: DataFrame) -> DataFrame:
    """HOST is the speaker with most time; everyone else is GUEST."""
    per = segments.groupBy("episode_id", "speaker").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("n"), F.min("seg_idx").alias("first_idx")
    )
    return _one_host(per, "n")


def _one_host(scores: DataFrame, metric: str) -> DataFrame:
    winner = ranking.argmax_speaker(scores, metric).select("episode_id", F.col("speaker").alias("__host"))
    return join_on(scores, winner, ["episode_id"]).select(
        "episode_id", "speaker", F.when(F.col("speaker") == F.col("__host"), "HOST").otherwise("GUEST").alias("role")
    )


def host_by_score(segments: DataFrame, asr: bool = False, speaker: str = "speaker") -> DataFrame:
    """Roles of the sampled speakers by the early-snippet score; exactly one HOST.

    Speakers that were never sampled are not listed; lookups default to GUEST.
    """
    samples = ranking.first_n_per_speaker(segments, speaker=speaker)
    return _one_host(stats.heuristic_host_score(samples, asr), "score")


def resolve_roles(responses: DataFrame, segments: DataFrame, asr: bool = False) -> DataFrame:
    """Roles from a model response if it names a sampled speaker, else by score.

    `responses(episode_id, response)` holds the raw chat response, or no row.
    """
    samples = ranking.first_n_per_speaker(segments)
    scores = stats.heuristic_host_score(samples, asr)
    fallback = ranking.argmax_speaker(scores, "score").select("episode_id", F.col("speaker").alias("by_score"))
    named = responses.select(
        "episode_id",
        F.get_json_object(parse_model_json(reply_content("response")), "$.host_speaker_raw").alias("candidate"),
    )
    accepted = join_on(scores, named, ["episode_id"]).filter(F.col("speaker") == F.col("candidate")).select(
        "episode_id", "candidate"
    )
    host = join_on(fallback, accepted, ["episode_id"], "left").select(
        "episode_id", F.coalesce("candidate", "by_score").alias("__host"),
        F.when(F.col("candidate").isNotNull(), "model").otherwise("score").alias("source"),
    )
    return join_on(scores, host, ["episode_id"]).select(
        "episode_id", "speaker",
        F.when(F.col("speaker") == F.col("__host"), "HOST").otherwise("GUEST").alias("role"), "source",
    )


def roles_from_pair_reply(replies: DataFrame, segments: DataFrame) -> DataFrame:
    """Roles from a reply that names a host and a guest.

    When both names are the same, the two longest speakers take the roles.
    """
    pair = replies.select("episode_id", F.from_json(parse_model_json("reply"), PAIR).alias("p")).select(
        "episode_id", "p.host_speaker", "p.guest_speaker"
    )
    top = ranking.top_speakers(segments, 2).groupBy("episode_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("speaker"))).alias("t1"),
        F.max(F.when(F.col("rank") == 2, F.col("speaker"))).alias("t2"),
    )
    same = (F.col("host_speaker") == F.col("guest_speaker")) & F.col("t2").isNotNull()
    named = join_on(pair, top, ["episode_id"]).select(
        "episode_id",
        F.when(same, F.col("t1")).otherwise(F.col("host_speaker")).alias("h"),
        F.when(same, F.col("t2")).otherwise(F.col("guest_speaker")).alias("g"),
    )
    speakers = segments.select("episode_id", "speaker").distinct()
    role = F.when(F.col("speaker") == F.col("g"), "GUEST").when(F.col("speaker") == F.col("h"), "HOST")
    return join_on(speakers, named, ["episode_id"], "left").select(
        "episode_id", "speaker", F.coalesce(role, F.lit("UNKNOWN")).alias("role")
    )


def mapping_replies(replies: DataFrame) -> DataFrame:
    """Maps of role, reasoning and confidence by speaker id, from reply texts."""
    return replies.select("episode_id", F.from_json(parse_model_json("reply"), MAPPING).alias("m")).select(
        "episode_id", "m.mapping", "m.reasoning_brief", "m.confidence"
    )


def normalize_assignments(replies: DataFrame) -> DataFrame:
    """Rows (episode, speaker, role, confidence) from `assignments` lists.

    Roles outside the known four become unknown, a bad confidence 0.0; of
    repeated speakers the last entry counts.
    """
    schema = "struct<assignments:array<struct<speaker:string,role:string,confidence:string>>>"
    rows = replies.select(
        "episode_id", F.from_json(parse_model_json("reply"), schema).alias("r")
    ).select("episode_id", F.posexplode("r.assignments").alias("pos", "a"))
    role = F.lower(F.btrim(F.coalesce("a.role", F.lit(""))))
    tidy = rows.select(
        "episode_id", "pos",
        F.btrim(F.coalesce("a.speaker", F.lit(""))).alias("speaker"),
        F.when(role.isin("host", "cohost", "guest", "unknown"), role).otherwise("unknown").alias("role"),
        F.coalesce(F.col("a.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
    ).filter(F.col("speaker") != "")
    return tidy.groupBy("episode_id", "speaker").agg(
        F.max_by("role", "pos").alias("role"), F.max_by("confidence", "pos").alias("confidence")
    )
