"""Speaker labels, file-name rules, line parsing and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.numeric import _col
from colloquy.functions.text import strip_ws
from colloquy.functions.timefmt import fmt_hms, fmt_hms_ms_from_ms, fmt_ms

# --- fixed values: transcript line grammars -----------------------------------
LINE_RANGE = (
    r"^\s*(\[\d{2}:\d{2}:\d{2}\.\d{3}\s*-\s*\d{2}:\d{2}:\d{2}\.\d{3}\])\s*"
    r"([A-Za-z0-9_ .-]{1,64})\s*:\s*(.*)$"
)
LINE_MINUTE = r"^\s*(\[\d{2,}:\d{2}\])\s*([A-Za-z0-9_ .-]{1,64})\s*:\s*(.*)$"
LINE_CLOCK = r"^\s*(\[\d{2}:\d{2}:\d{2}\])\s*([A-Za-z0-9_ .-]{1,64})\s*:\s*(.*)$"
LINE_GRAMMARS = {"range": LINE_RANGE, "minute": LINE_MINUTE, "clock": LINE_CLOCK}
LINE_SPEAKER_ID = r"^(\[.*?\]\s*)(Speaker\s+\d+)(:\s*)(.*)$"
ROLE_SUFFIX = r"(?i)^(.*)\s+\((HOST|CO-HOST|GUEST|UNKNOWN)\)\s*$"

# --- fixed values: media types by extension -----------------------------------
MEDIA_TYPES = {
    ".wav": "audio/x-wav", ".mp3": "audio/mpeg", ".mp4": "video/mp4", ".m4a": "audio/mp4",
    ".aac": "audio/aac", ".flac": "audio/flac", ".ogg": "audio/ogg", ".opus": "audio/opus",
    ".webm": "video/webm", ".aif": "audio/x-aiff", ".aiff": "audio/x-aiff", ".wma": "audio/x-ms-wma",
}


def speaker_label(speaker_id: Column | str, base: int = 1) -> Column:
    return F.concat(F.lit("Speaker "), (_col(speaker_id) + base).cast("string"))


def title_case(text: Column) -> Column:
    """Upper case for a letter after a non-letter, lower case for the others."""
    chars = F.split(text, "")
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when((i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c)),
        ),
        "",
    )


def pretty_speaker(label: Column | str) -> Column:
    """`SPEAKER_07` to `Speaker 8`; other labels in title case."""
    label = _col(label)
    number = F.regexp_extract(label, r"^SPEAKER_(?:.*_)?(\d+)$", 1)
    return (
        F.when(F.coalesce(label, F.lit("")) == "", "Speaker Unknown")
        .when(number != "", F.concat(F.lit("Speaker "), (number.try_cast("bigint") + 1).cast("string")))
        .otherwise(title_case(F.replace(label, F.lit("_"), F.lit(" "))))
    )


def resolve_speaker(*candidates: Column | str, skip_empty: bool = False) -> Column:
    """First usable label among the candidates, else `UNKNOWN`."""
    cols = [_col(c) for c in candidates]
    if skip_empty:
        cols = [F.nullif(c, F.lit("")) for c in cols]
    return F.coalesce(*cols, F.lit("UNKNOWN"))


def video_id(url: Column | str) -> Column:
    u = F.btrim(_col(url))

    def after(marker: str, stop: str) -> Column:
        return F.substring_index(F.substring_index(u, marker, -1), stop, 1)

    return (
        F.when(u.contains("watch?v="), after("watch?v=", "&"))
        .when(u.contains("youtu.be/"), after("youtu.be/", "?"))
        .when(u.contains("youtube.com/embed/"), after("youtube.com/embed/", "?"))
        .otherwise(u)
    )


def episode_number(stem: Column | str) -> Column:
    """The number in `Episode07_...`; NULL when there is none."""
    head = F.split_part(_col(stem), F.lit("_"), F.lit(1))
    return F.btrim(F.replace(head, F.lit("Episode"), F.lit(""))).try_cast("int")


def output_name(path: Column | str, rule: str) -> Column:
    path = _col(path)
    if rule == "diarized":
        return F.regexp_replace(path, r"\.deepgram\.json$", ".diarized.txt")
    if rule == "cleaned":
        return F.replace(path, F.lit("_raw"), F.lit("_cleaned"))
    if rule == "questions":
        return F.replace(path, F.lit(".txt"), F.lit("_questions_v2.txt"))
    raise ValueError(f"unknown output name rule {rule!r}")


def guess_media_type(path: Column | str) -> Column:
    extension = F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.lit("application/octet-stream"))


def parse_transcript_line(line: Column | str, grammar: str = "range") -> Column:
    """Struct(ts, speaker, utt) of a transcript line; NULL when it does not match."""
    line = _col(line)
    pattern = LINE_GRAMMARS[grammar]
    return F.when(
        line.rlike(pattern) & (F.btrim(F.regexp_extract(line, pattern, 2)) != ""),
        F.struct(
            F.regexp_extract(line, pattern, 1).alias("ts"),
            F.btrim(F.regexp_extract(line, pattern, 2)).alias("speaker"),
            F.regexp_extract(line, pattern, 3).alias("utt"),
        ),
    )


def strip_role_tag(label: Column | str) -> Column:
    label = _col(label)
    return F.when(label.rlike(ROLE_SUFFIX), F.btrim(F.regexp_extract(label, ROLE_SUFFIX, 1))).otherwise(label)


def role_tag(role: Column | str) -> Column:
    r = F.lower(F.coalesce(_col(role), F.lit("unknown")))
    return F.when(r == "host", "HOST").when(r == "cohost", "CO-HOST").when(r == "guest", "GUEST").otherwise("UNKNOWN")


def rewrite_line(line: Column | str, role: Column | str, style: str = "suffix") -> Column:
    """Put a role tag into a line: `Speaker 1 (HOST): …` or `HOST (Speaker 1): …`."""
    line, role = _col(line), _col(role)
    if style == "suffix":
        parsed = parse_transcript_line(line)
        return F.coalesce(
            F.concat(
                parsed["ts"], F.lit(" "), strip_role_tag(parsed["speaker"]),
                F.lit(" ("), role_tag(role), F.lit("): "), parsed["utt"],
            ),
            line,
        )
    stripped = F.btrim(line)
    part = [F.regexp_extract(stripped, LINE_SPEAKER_ID, i) for i in range(1, 5)]
    tagged = F.concat(part[0], role, F.lit(" ("), part[1], F.lit(")"), part[2], part[3])
    known = F.coalesce(role, F.lit("UNKNOWN")) != "UNKNOWN"
    return F.when(stripped.rlike(LINE_SPEAKER_ID) & known, tagged).otherwise(line)


def render_line(
    label: Column | str,
    text: Column | str,
    start_ms: Column | str,
    end_ms: Column | str | None = None,
    gender: Column | str | None = None,
    style: str = "range",
) -> Column:
    """One transcript line; NULL for blank text, so a filter drops it.

    Styles: `range` `[a - b] L: t`, `minute` `[MM:SS] L: t`, `clock` `[HH:MM:SS] L: t`.
    With `gender`, known genders follow the label in parentheses.
    """
    start = _col(start_ms)
    stamp = {
        "range": lambda: F.concat(fmt_hms_ms_from_ms(start), F.lit(" - "), fmt_hms_ms_from_ms(_col(end_ms))),
        "minute": lambda: fmt_ms(start / 1000),
        "clock": lambda: fmt_hms(start / 1000),
    }[style]()
    name = _col(label)
    if gender is not None:
        g = F.coalesce(_col(gender), F.lit(""))
        name = F.when(g.isin("", "unknown"), name).otherwise(F.concat(name, F.lit(" ("), g, F.lit(")")))
    body = strip_ws(_col(text))
    return F.when(body != "", F.concat(F.lit("["), stamp, F.lit("] "), name, F.lit(": "), body))


def append_gender_to_line(line: Column | str, gender: Column | str) -> Column:
    """`[MM:SS] Label: t` to `[MM:SS] Label (gender): t`."""
    line, gender = _col(line), _col(gender)
    parsed = parse_transcript_line(line, "minute")
    known = ~F.coalesce(gender, F.lit("")).isin("", "unknown")
    tagged = F.concat(parsed["ts"], F.lit(" "), parsed["speaker"], F.lit(" ("), gender, F.lit("): "), parsed["utt"])
    return F.when(known & parsed.isNotNull(), tagged).otherwise(line)


def other_speaker(label: Column | str) -> Column:
    """The other one of Speaker 1 and Speaker 2."""
    return F.when(_col(label) == "Speaker 2", "Speaker 1").otherwise("Speaker 2")


def relabel_host_guest(speaker: Column | str, host: Column | str) -> Column:
    """Struct(speaker, speaker_original): Host, Guest or Unknown."""
    speaker, host = _col(speaker), _col(host)
    label = F.when(speaker == host, "Host").when(speaker == other_speaker(host), "Guest").otherwise("Unknown")
    return F.struct(label.alias("speaker"), F.when(label != "Unknown", speaker).alias("speaker_original"))


def add_role_to_words(words: Column | str, role: Column | str) -> Column:
    role = _col(role)
    return F.transform(_col(words), lambda w: w.withField("speaker_role", role))


def role_columns(speaker: Column | str, role: Column | str) -> Column:
    """Struct(role, speaker_role_label); the bare speaker when the role is unknown."""
    role = F.coalesce(_col(role), F.lit("UNKNOWN"))
    speaker = _col(speaker)
    text = F.when(role == "UNKNOWN", speaker).otherwise(F.concat(role, F.lit(" ("), speaker, F.lit(")")))
    return F.struct(role.alias("role"), text.alias("speaker_role_label"))


def classify_pitch(hz: Column | str) -> Column:
    hz = _col(hz)
    return (
        F.when(hz.isNull(), "unknown").when(hz < 165, "male").when(hz > 180, "female").otherwise("ambiguous")
    )


def api_query_params(flags: dict[str, Column]) -> Column:
    """Map of the flags that are set; empty text and NULL are left out."""
    pairs = [x for name, value in flags.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _k, v: v.isNotNull() & (v != ""))
