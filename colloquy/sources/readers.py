"""Readers: documents and text files to rows with their list position.

Every reader takes a folder (or glob) with one document per file, the episode
being named by the file. `layout="table"` reads the same documents from a
Parquet table of raw documents (`schemas.RAW_DOCUMENT`), the form to use when
there are too many episodes for one file each; a long episode is then stored as
several parts, and `offset` keeps list positions right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.functions.labels import speaker_label
from colloquy.functions.text import line_list, strip_ws
from colloquy.functions.timefmt import to_ms
from colloquy.operators.blocks import with_rank, with_row_number
from colloquy.operators.filters import drop_empty_text
from colloquy.operators.sequences import chunk_words
from colloquy.session import read_back

_SUFFIXES = r"(_raw)?(\.(deepgram|sentences|whisperx|labeled|final|diarized))*\.(json|txt)$"


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, _SUFFIXES, "")


def raw_documents(spark: SparkSession, path: str, layout: str = "files", glob: str = "*") -> DataFrame:
    """Documents as (name, episode_id, offset, value)."""
    if layout == "table":
        return spark.read.schema(schemas.RAW_DOCUMENT).parquet(path)
    # file names come percent-encoded, but a plus sign stands for itself
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return (
        spark.read.option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select(
            name.alias("name"),
            _stem(name).alias("episode_id"),
            F.lit(0).cast("bigint").alias("offset"),
            F.make_valid_utf8("value").alias("value"),
        )
    )


def _items(raw: DataFrame, schema: str, items: str, index: str) -> DataFrame:
    """Explode a document's list; NULL and missing lists give no rows."""
    doc = raw.select("episode_id", "offset", F.from_json("value", schema).alias("doc"))
    return doc.select("episode_id", "offset", F.posexplode(F.expr(items)).alias("__pos", "i")).select(
        "episode_id", (F.col("offset") + F.col("__pos")).cast("bigint").alias(index), "i.*"
    )


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _times() -> list[Column]:
    return [to_ms(_or_zero("start")).alias("start_ms"), to_ms(F.coalesce("end", "start", F.lit(0.0))).alias("end_ms")]


def captions_from(raw: DataFrame) -> DataFrame:
    return drop_empty_text(_items(raw, schemas.CAPTIONS, "doc", "item_idx").select("episode_id", "item_idx", "text"))


def aligned_segments_from(raw: DataFrame) -> DataFrame:
    rows = _items(raw, schemas.ALIGNED, "doc.segments", "seg_idx")
    return rows.select("episode_id", "seg_idx", *_times(), "text", "words", "speaker_raw", "speaker")


def asr_utterances_from(raw: DataFrame, keep_empty: bool = False) -> DataFrame:
    rows = _items(raw, schemas.ASR_RESPONSE, "doc.results.utterances", "seg_idx").select(
        "episode_id", "seg_idx", *_times(),
        F.coalesce("speaker", F.lit(0)).alias("speaker_id"),
        strip_ws(F.coalesce("transcript", F.lit(""))).alias("text"),
        "confidence",
    )
    return rows if keep_empty else rows.filter(F.col("text") != "")


def asr_words_from(raw: DataFrame) -> DataFrame:
    words = "get(get(doc.results.channels, 0).alternatives, 0).words"
    rows = _items(raw, schemas.ASR_RESPONSE, words, "word_idx")
    token = F.coalesce(F.nullif("punctuated_word", F.lit("")), F.nullif("word", F.lit("")), F.lit(""))
    return rows.select(
        "episode_id", "word_idx", to_ms("start").alias("start_ms"), to_ms("end").alias("end_ms"),
        "speaker", token.alias("token"),
    )


def best_transcripts_from(raw: DataFrame) -> DataFrame:
    """One row per document: the first transcript that is not empty, by the parts' offsets."""
    doc = raw.select("episode_id", "offset", F.from_json("value", schemas.ASR_RESPONSE).alias("doc"))
    best = F.nullif(F.expr("get(get(doc.results.channels, 0).alternatives, 0).transcript"), F.lit(""))
    rows = doc.select("episode_id", "offset", best.alias("transcript"))
    first = F.min_by("transcript", F.when(F.col("transcript").isNotNull(), F.col("offset")))
    return rows.groupBy("episode_id").agg(F.coalesce(first, F.lit("")).alias("transcript"))


def sentences_from(raw: DataFrame) -> DataFrame:
    rows = _items(raw, schemas.SENTENCES, "doc.segments", "seg_idx")
    sid = F.coalesce("speaker_id", F.lit(0))
    return rows.select(
        "episode_id", "seg_idx", to_ms(_or_zero("start")).alias("start_ms"), to_ms(_or_zero("end")).alias("end_ms"),
        F.coalesce("transcript", F.lit("")).alias("text"),
        F.format_string("SPEAKER_%02d", sid).alias("speaker_raw"),
        F.coalesce("speaker_label", speaker_label(sid)).alias("speaker"),
    )


def simple_diarized_from(raw: DataFrame) -> DataFrame:
    rows = _items(raw, schemas.SIMPLE, "doc.segments", "seg_idx")
    sid = F.coalesce("speaker_id", F.lit(0))
    return rows.select(
        "episode_id", "seg_idx", sid.alias("speaker_id"),
        F.coalesce("speaker_label", speaker_label(sid)).alias("speaker"),
        to_ms(_or_zero("start")).alias("start_ms"), to_ms(_or_zero("end")).alias("end_ms"),
        F.coalesce("text", F.lit("")).alias("text"), _or_zero("confidence").alias("confidence"),
        F.coalesce("gender", F.lit("unknown")).alias("gender"),
    )


def document_kind(raw: DataFrame) -> DataFrame:
    """Add `kind`: sentences or asr, by file suffix and then by structure."""
    v = F.col("value")
    # a key shows in the text unless it is escaped, and looking for it is cheaper than parsing
    shows = lambda field: v.contains(field) | v.contains("\\")
    has = lambda field: shows(field) & F.array_contains(F.json_object_keys(v), field)
    return raw.withColumn(
        "kind",
        F.when(F.col("name").endswith(".sentences.json"), "sentences")
        .when(F.col("name").endswith(".deepgram.json"), "asr")
        .when(has("segments") & v.contains("transcript"), "sentences")
        .when(has("results") & v.contains("channels"), "asr"),
    )


def any_from(raw: DataFrame) -> DataFrame:
    """Segments of either document kind in one schema; `seg_idx` is their position by start.

    Word documents are cut every twelve words per speaker. Equal starts keep the
    order of the list, or of speaker and chunk. Documents of neither kind are
    listed by `unreadable_from`. Places are counted before they are given out, so
    words and segments are parsed once and kept in the shared folder meanwhile.
    """
    kinds = document_kind(raw)
    spoken = sentences_from(kinds.filter(F.col("kind") == "sentences")).withColumnRenamed("seg_idx", "__tie")
    words = read_back(asr_words_from(kinds.filter(F.col("kind") == "asr")), "words")
    chunks = chunk_words(words).select(
        "episode_id", (F.shiftleft(F.col("speaker").cast("bigint"), 32) + F.col("chunk")).alias("__tie"),
        "start_ms", "end_ms", "text", F.format_string("SPEAKER_%02d", "speaker").alias("speaker_raw"),
        speaker_label("speaker").alias("speaker"),
    )
    found = read_back(spoken.unionByName(chunks), "segments")
    placed = with_rank(found, ["episode_id"], "start_ms", "__tie", "__rn")
    return placed.withColumn("seg_idx", F.col("__rn") - 1).drop("__rn", "__tie")


def unreadable_from(raw: DataFrame) -> DataFrame:
    return document_kind(raw).filter(F.col("kind").isNull()).select("name", F.lit("Unknown format").alias("error"))


def _reader(parse, glob: str):
    def read(spark: SparkSession, path: str, layout: str = "files", **options) -> DataFrame:
        return parse(raw_documents(spark, path, layout, glob), **options)

    return read


read_captions = _reader(captions_from, "*.json")
read_aligned_segments = _reader(aligned_segments_from, "*.json")
read_asr_utterances = _reader(asr_utterances_from, "*.json")
read_asr_words = _reader(asr_words_from, "*.json")
read_best_transcript = _reader(best_transcripts_from, "*.json")
read_sentences = _reader(sentences_from, "*.json")
read_simple_diarized = _reader(simple_diarized_from, "*.json")
read_any = _reader(any_from, "*.json")


def read_documents(spark: SparkSession, path: str, glob: str = "*.txt", layout: str = "files") -> DataFrame:
    """One row per text file: (episode, text)."""
    return raw_documents(spark, path, layout, glob).select(
        F.col("name").alias("episode"), F.col("value").alias("text")
    )


def lines_from(raw: DataFrame) -> DataFrame:
    """Lines with their position; parts of one document continue the count by offset."""
    rows = raw.select("episode_id", "offset", F.posexplode(line_list("value")).alias("__pos", "line"))
    return rows.select("episode_id", (F.col("offset") + F.col("__pos")).cast("bigint").alias("line_idx"), "line")


read_transcript_lines = _reader(lines_from, "*.txt")


def url_list_from(
    raw: DataFrame, start: int = 1, end: int | None = None, skip_comments: bool = False
) -> DataFrame:
    """Non-blank URLs with their 1-based number in the list, cut to a range."""
    rows = lines_from(raw).withColumn("url", strip_ws("line")).filter(F.col("url") != "")
    if skip_comments:
        rows = rows.filter(~F.col("url").startswith("#"))
    numbered = with_row_number(rows, ["episode_id"], "line_idx", "number")
    inside = F.col("number") >= start
    if end is not None:
        inside = inside & (F.col("number") <= end)
    return numbered.filter(inside).select(F.col("episode_id").alias("list"), "number", "url")


read_url_list = _reader(url_list_from, "*.txt")


def list_media(
    spark: SparkSession, path: str, extensions: list[str] | None = None, recursive: bool = True
) -> DataFrame:
    """Files with one of the extensions: (path, stem, ext, length). Contents are not read."""
    wanted = [e.lower() for e in (extensions or schemas.AUDIO_EXTENSIONS)]
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return (
        files.withColumn("ext", F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)))
        .filter(F.col("ext").isin(*wanted))
        .withColumn("stem", F.regexp_replace(name, r"\.[^.]+$", ""))
        .select("path", "stem", "ext", "length")
        .orderBy("path")
    )
