"""Sentences, questions, document cleaning and chunk-wise translation."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import is_question_sentence, lower_copy, normalize_text, squash_ws, strip_ws
from colloquy.operators.blocks import join_on
from colloquy.operators.filters import needs_translation
from colloquy.operators.folds import chunk_lines

# --- fixed values: abbreviations that do not end a sentence -------------------
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e"]

PART_BITS = 12
# Learned abbreviations that one array may hold.
MOST_ABBREVIATIONS = 20_000


def split_sentences(docs: DataFrame, text: str = "text", abbreviations: DataFrame | None = None) -> DataFrame:
    """Sentences with their position.

    Deviation: instead of a trained splitter this cuts after runs of `.?!` that
    are followed by white space or the end, and not after common abbreviations:
    those of the list above, or those of `learn_abbreviations`. Learned ones
    reach the tasks as one array, so more than `MOST_ABBREVIATIONS` are an error.
    """
    others = [c for c in docs.columns if c != text]
    if abbreviations is None:
        known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
        sentences = F.split(squash_ws(text), rf"(?iU)(?<=[.?!])(?<!\b(?:{known})\.) ")
        return docs.select(*others, F.posexplode(sentences).alias("sentence_idx", "sentence")).filter(F.col("sentence") != "")
    listed = abbreviations.agg(
        F.when(F.count("abbreviation") <= MOST_ABBREVIATIONS, F.collect_set("abbreviation")).otherwise(
            F.raise_error(F.lit(f"over {MOST_ABBREVIATIONS} abbreviations")).cast("array<string>")
        )
    )
    cut = docs.select(*others, F.split(squash_ws(text), "(?<=[.?!]) ").alias("__parts"), listed.scalar().alias("__listed"))
    # the few that a text has, so that each cut looks through a short array
    here = cut.withColumn("__here", F.array_intersect(F.transform("__parts", _abbreviated), "__listed"))
    marked = F.transform(
        "__parts", lambda part: F.concat(part, F.when(F.array_contains("__here", _abbreviated(part)), " ").otherwise("\n"))
    )
    sentences = F.split(F.array_join(marked, ""), "\n")
    return here.select(*others, F.posexplode(sentences).alias("sentence_idx", "sentence")).withColumn(
        "sentence", F.rtrim("sentence")
    ).filter(F.col("sentence") != "")


def _abbreviated(part: Column) -> Column:
    """The word before a single period that ends `part`, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(part, r"(?:^| )[^\p{L} ]*(\p{L}+(?:\.\p{L}+)*)\.$", 1))


def learn_abbreviations(docs: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Words that a text writes with a period of their own: (abbreviation, n_with, n_without).

    The test of Kiss and Strunk (2006) over all texts: a log-likelihood ratio of
    "a period nearly always follows" against "as often as after any word", made
    smaller for long words and for each time the word comes without a period, and
    larger for periods inside. Words are counted before the shuffle; NULL texts
    have none, repeated rows count again, without periods nothing is learned.
    """
    # equal words are counted first, so that the pattern sees each once
    words = docs.select(F.explode(F.split(squash_ws(text), " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    parts = words.select(
        F.lower(F.regexp_extract("w", r"^[^\p{L}]*(\p{L}+(?:\.\p{L}+)*)(?:\.|[^\p{L}.]*)$", 1)).alias("abbreviation"),
        F.col("w").endswith(".").alias("dot"), "n",
    )
    counted = parts.where(F.col("abbreviation") != "").groupBy("abbreviation").agg(
        F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("n_with"),
        F.sum(F.when(F.col("dot"), 0).otherwise(F.col("n"))).alias("n_without"),
    )
    share = counted.agg((F.sum("n_with") + 1) / (F.sum("n_with") + F.sum("n_without") + 2))
    rated = counted.where(F.col("n_with") > 0).withColumn("__p", share.scalar())
    k, m, p = F.col("n_with"), F.col("n_without"), F.col("__p")
    ratio = 2 * (k * F.log(F.lit(0.99)) + m * F.log(F.lit(0.01)) - k * F.log(p) - m * F.log(1 - p))
    letters = F.length(F.replace("abbreviation", F.lit("."), F.lit("")))
    inside = F.length("abbreviation") - letters
    score = ratio * F.exp(-letters) * (inside + 1) * F.pow(letters, -m)
    return rated.where(score >= threshold).select("abbreviation", "n_with", "n_without")


def extract_questions(docs: DataFrame, text: str = "text", abbreviations: DataFrame | None = None) -> DataFrame:
    return split_sentences(docs, text, abbreviations).filter(is_question_sentence("sentence"))


def normalize_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the cleaned text and its lower-case copy."""
    return docs.withColumn("clean", normalize_text(text)).withColumn("clean_lower", lower_copy("clean"))


def reassemble_text(
    pieces: DataFrame, key: str = "episode_id", order: str = "seg_idx", text: str = "text", part_bits: int = PART_BITS
) -> DataFrame:
    """Ordered pieces joined by newlines, as (key, part, text, n_parts, n_pieces).

    A part covers 2**part_bits positions, so a very long document stays in
    several bounded rows; their texts joined by newlines are the document.
    `n_parts` and `n_pieces` are those of the whole document.
    """
    in_order = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    parts = pieces.withColumn("part", F.shiftright(F.col(order), part_bits))
    texts = parts.groupBy(key, "part").agg(F.array_join(F.transform(in_order, lambda x: x["t"]), "\n").alias("text"))
    return join_on(texts, part_totals(parts, key), [key])


def part_totals(parts: DataFrame, key: str) -> DataFrame:
    """Number of parts and of rows per document; counted per part first."""
    sizes = parts.groupBy(key, "part").agg(F.count(F.lit(1)).alias("__n"))
    return sizes.groupBy(key).agg(F.count(F.lit(1)).alias("n_parts"), F.sum("__n").alias("n_pieces"))


def identity_provider() -> Callable[[pd.Series], pd.Series]:
    return lambda texts: texts


def attempted(
    translate: Callable[[pd.Series], pd.Series], chunks: pd.Series, attempts: int = 1, pause_s: float = 1.0
) -> tuple[pd.Series, pd.Series]:
    """Translations and errors; if the call fails, each chunk on its own, up to `attempts` times.

    Before the nth repetition of a chunk's call this waits 2^(n-1) times
    `pause_s`, and between 0.2 and 0.9 of it more, so that tasks do not call in step.
    """
    if len(chunks) > 1:
        try:
            return translate(chunks), pd.Series([None] * len(chunks), index=chunks.index, dtype=object)
        except Exception:
            single = [attempted(translate, chunks.iloc[i : i + 1], attempts, pause_s) for i in range(len(chunks))]
            return pd.concat([s[0] for s in single]), pd.concat([s[1] for s in single])
    said = None
    for n in range(attempts):
        if n:
            time.sleep(pause_s * (2 ** (n - 1) + random.uniform(0.2, 0.9)))
        try:
            return translate(chunks), pd.Series([None] * len(chunks), index=chunks.index, dtype=object)
        except Exception as error:
            said = f"{type(error).__name__}: {error}"
    return pd.Series([None], index=chunks.index, dtype=object), pd.Series([said], index=chunks.index)


def translate_chunks(
    chunks: DataFrame,
    provider: Callable[[], Callable[[pd.Series], pd.Series]],
    finished: str,
    attempts: int = 1,
    pause_s: float = 1.0,
    parallel_calls: int | None = None,
) -> DataFrame:
    """Add `translated` and `error` to rows with a `chunk`; calls are made for new chunks only, and once for equal ones.

    `finished` is a folder in shared storage with the translations by the SHA-256
    of the chunk, and is made if absent. What it lacks is called for and written
    in one job before this returns: a lost executor costs the calls of its
    running tasks, a second run none. Failed chunks are not kept, so that a later
    run asks again; they have a NULL translation and say why. Two runs at a time
    on one folder may call twice for a chunk; the rows agree in all but the words.
    """
    spark = chunks.sparkSession
    kind = "digest string, chunk string, translated string, error string"
    # the folder exists from the first run on, be it without rows
    spark.createDataFrame([], kind).write.mode("append").parquet(finished)
    digested = chunks.withColumn("__digest", F.sha2("chunk", 256))
    known = spark.read.schema(kind).parquet(finished).where(F.col("error").isNull())
    asked = digested.where(F.col("chunk").isNotNull()).groupBy(F.col("__digest").alias("digest")).agg(F.min("chunk").alias("chunk"))
    missing = asked.join(known.select("digest"), "digest", "left_anti")
    if parallel_calls:
        missing = missing.repartition(parallel_calls)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translate = provider()
        for batch in batches:
            done, errors = attempted(translate, batch["chunk"], attempts, pause_s)
            yield batch.assign(translated=done, error=errors)

    missing.mapInPandas(run, kind).write.mode("append").parquet(finished)
    # a success is the newest word on a chunk; of failures any one
    now = spark.read.schema(kind).parquet(finished).groupBy("digest").agg(
        F.min("translated").alias("translated"), F.min("error").alias("__error")
    )
    out = digested.join(now.withColumnRenamed("digest", "__digest"), "__digest", "left")
    error = F.when(F.col("translated").isNull(), F.col("__error"))
    return out.withColumn("error", error).drop("__digest", "__error")


def translate_documents(
    docs: DataFrame,
    provider: Callable[[], Callable[[pd.Series], pd.Series]] = identity_provider,
    key: str = "doc_id",
    max_len: int = 1200,
    parallel_calls: int | None = None,
    attempts: int = 1,
    pause_s: float = 1.0,
    finished: str | None = None,
) -> DataFrame:
    """Translate documents that need it; copy the others unchanged.

    `provider()` is called once per partition and returns a function from a
    series of chunks to a series of the same length. `parallel_calls` bounds how
    many partitions call it at a time. A call that fails is made again for each
    of its chunks, so one bad chunk costs no other its translation, and up to
    `attempts` times for each, with growing pauses from `pause_s` seconds on. A
    failed or unchanged chunk keeps its text and counts as a fallback; `errors`
    lists what the failed ones said. With a folder `finished`, the calls are made
    at once and kept there, see `translate_chunks`; without, they run with the plan.
    """
    routed = needs_translation(docs.select(key, "text"))
    chunks = chunk_lines(routed.filter(F.col("route") == "translate").drop("route"), max_len).withColumn(
        "chunk", strip_ws("chunk")
    )
    if finished:
        found = translate_chunks(chunks, provider, finished, attempts, pause_s, parallel_calls)
        translated = found.withColumn("translated", F.coalesce("translated", "chunk"))
    else:
        if parallel_calls:
            chunks = chunks.repartition(parallel_calls)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            translate = provider()
            for batch in batches:
                done, errors = attempted(translate, batch["chunk"], attempts, pause_s)
                yield batch.assign(translated=done.where(done.notna(), batch["chunk"]), error=errors)

        key_type = docs.schema[key].dataType.simpleString()
        translated = chunks.mapInPandas(
            run, f"{key} {key_type}, chunk_idx int, chunk string, translated string, error string"
        )
    in_order = F.sort_array(F.collect_list(F.struct("chunk_idx", "translated")))
    unchanged = (strip_ws("translated") == F.col("chunk")) & (F.col("chunk") != "")
    rebuilt = translated.groupBy(key).agg(
        F.array_join(F.transform(in_order, lambda x: x["translated"]), "\n").alias("text"),
        F.count_if(unchanged).alias("n_fallback"),
        F.array_sort(F.collect_set("error")).alias("errors"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.lit("translate").alias("route"),
    )
    copied = routed.filter(F.col("route") == "copy").select(
        key, "text", F.lit(0).cast("bigint").alias("n_fallback"), F.array().cast("array<string>").alias("errors"),
        F.lit(0).cast("bigint").alias("n_chunks"), "route",
    )
    return rebuilt.unionByName(copied)
