"""Queries for sentences, questions, cleaning and translation."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import textops
from colloquy.plans import views as V
from colloquy.plans.registry import query
from colloquy.plans.scalars import DEVANAGARI, MIXED_SQL, NORMALIZED_SQL, is_question_sentence_sql, messy, mixed_language

# Questions and abbreviations do not occur in the prose, so a few are put in front.
_ASKING = "CASE doc_id % 3 WHEN 0 THEN 'Dr. Who knows? ' WHEN 1 THEN 'Tell me what it is. Ok... ' ELSE '' END || text"

SENTENCES = f"""d AS (SELECT doc_id, regexp_replace({_ASKING}, '[\\r\\n]+', ' ', 'g') AS t FROM documents),
    m AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(a.replace('.', chr(92) + '.') for a in textops.ABBREVIATIONS)})\\.',
      '\\1\\2' || chr(1), 'g'), '([.?!]+)\\s+', '\\1' || chr(10), 'g') AS t FROM d),
    p AS (SELECT doc_id, string_split(t, chr(10)) AS parts FROM m),
    sent AS (SELECT doc_id, (k - 1)::INTEGER AS sentence_idx, trim(regexp_replace(replace(parts[k], chr(1), '.'), '\\s+', ' ', 'g')) AS sentence
      FROM p, range(1, len(parts) + 1) r(k))"""


def asking(spark, sf):
    return V.documents(spark, sf).select("doc_id", F.expr(_ASKING).alias("text"))


@query("tx01_split_sentences", f"WITH {SENTENCES} SELECT * FROM sent WHERE sentence <> ''")
def tx01(spark, sf):
    return textops.split_sentences(asking(spark, sf))


# The text as one line, the counts of words with and without a period, and those that pass the test.
LEARNED = f"""d AS (SELECT doc_id, trim(regexp_replace({_ASKING}, '\\s+', ' ', 'g')) AS t FROM documents),
    w AS (SELECT unnest(string_split(t, ' ')) AS w FROM d),
    a AS (SELECT lower(regexp_extract(w, '^[^\\p{{L}}]*(\\p{{L}}+(?:\\.\\p{{L}}+)*)(?:\\.|[^\\p{{L}}.]*)$', 1)) AS abbreviation,
      ends_with(w, '.') AS dot FROM w),
    c AS (SELECT abbreviation, count_if(dot)::BIGINT AS n_with, count_if(NOT dot)::BIGINT AS n_without FROM a WHERE abbreviation <> '' GROUP BY 1),
    s AS (SELECT (sum(n_with) + 1)::DOUBLE / (sum(n_with) + sum(n_without) + 2)::DOUBLE AS p FROM c),
    learned AS (SELECT abbreviation, n_with, n_without FROM c, s WHERE n_with > 0
      AND 2 * (n_with * ln(0.99::DOUBLE) + n_without * ln(0.01::DOUBLE) - n_with * ln(p) - n_without * ln(1 - p))
        * exp(-length(replace(abbreviation, '.', ''))) * (1 + length(abbreviation) - length(replace(abbreviation, '.', '')))
        * pow(length(replace(abbreviation, '.', ''))::DOUBLE, -n_without::DOUBLE) >= 0.3::DOUBLE)"""


@query("tx01_learned_abbreviations", f"WITH {LEARNED} SELECT * FROM learned")
def tx01_learned(spark, sf):
    return textops.learn_abbreviations(asking(spark, sf))


@query(
    "tx01_learned_sentences",
    f"""WITH {LEARNED}, known AS (SELECT coalesce(list(abbreviation), []) AS known FROM learned),
    p AS (SELECT doc_id, list_transform(string_split(regexp_replace(t, '([.?!]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: x ||
      CASE WHEN list_contains(known, lower(regexp_extract(x, '(?:^| )[^\\p{{L}} ]*(\\p{{L}}+(?:\\.\\p{{L}}+)*)\\.$', 1))) THEN ' ' ELSE chr(10) END) AS parts
      FROM d, known),
    q AS (SELECT doc_id, string_split(array_to_string(parts, ''), chr(10)) AS parts FROM p)
    SELECT doc_id, (k - 1)::INTEGER AS sentence_idx, rtrim(parts[k], ' ') AS sentence FROM q, range(1, len(parts) + 1) r(k) WHERE trim(parts[k]) <> ''""",
)
def tx01_learned_sentences(spark, sf):
    docs = asking(spark, sf)
    return textops.split_sentences(docs, abbreviations=textops.learn_abbreviations(docs))


@query(
    "tx02_extract_questions",
    f"WITH {SENTENCES} SELECT * FROM sent WHERE sentence <> '' AND {is_question_sentence_sql('sentence')}",
)
def tx02(spark, sf):
    return textops.extract_questions(asking(spark, sf))


@query(
    "tx03_question_rate",
    f"""WITH {SENTENCES} SELECT doc_id, count(*) AS n_sentences, count_if({is_question_sentence_sql('sentence')})::BIGINT AS n_questions,
      {V.rr(f"count_if({is_question_sentence_sql('sentence')})", 'count(*)', 4)} AS question_rate FROM sent WHERE sentence <> '' GROUP BY 1""",
)
def tx03(spark, sf):
    from colloquy.functions.numeric import round_ratio
    from colloquy.functions.text import is_question_sentence

    asked = F.count_if(is_question_sentence("sentence"))
    return textops.split_sentences(asking(spark, sf)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), asked.alias("n_questions"),
        round_ratio(asked, F.count(F.lit(1)), 4).alias("question_rate"),
    )


@query("tx04_normalize_documents", f"WITH {NORMALIZED_SQL} SELECT doc_id, clean, lower(clean) AS clean_lower FROM norm")
def tx04(spark, sf):
    return textops.normalize_documents(messy(spark, sf)).select("doc_id", "clean", "clean_lower")


@query(
    "tx05_translate_documents",
    f"""WITH {MIXED_SQL} SELECT doc_id, CASE WHEN regexp_matches(text, {DEVANAGARI}) THEN 'translate' ELSE 'copy' END AS route,
      regexp_replace(text, '\\s+', '', 'g') AS letters FROM mixed WHERE regexp_replace(text, '\\s+', '', 'g') <> ''""",
)
def tx05(spark, sf):
    """With the identity provider all but white space must come back unchanged."""
    out = textops.translate_documents(mixed_language(spark, sf))
    return out.select("doc_id", "route", F.regexp_replace("text", r"\s+", "").alias("letters"))


def _upper_or_fail():
    """A provider that turns text to upper case and fails for a whole call if a chunk has a lone x."""

    def translate(chunks):
        if chunks.str.contains(r"(?:^|\s)[xX](?:\s|$)").any():
            raise ValueError("cannot translate")
        return chunks.str.upper()

    return translate


# Short documents of one chunk each, so that SQL needs no chunk rule.
SHORT_SQL = """short AS (SELECT conv_id * 100000 + turn AS doc_id, CASE WHEN conv_id % 2 = 0 THEN 'अ ' ELSE '' END
  || CASE turn % 3 WHEN 0 THEN 'x ' WHEN 1 THEN '' ELSE '42 ' END || role AS text FROM conversations)"""


@query(
    "tx05_failing_provider",
    f"""WITH {SHORT_SQL}, t AS (SELECT *, contains(text, 'अ') AS asked, contains(text, 'x ') AS bad FROM short)
    SELECT doc_id, CASE WHEN asked THEN 'translate' ELSE 'copy' END AS route,
      CASE WHEN asked AND NOT bad THEN upper(text) ELSE text END AS text,
      (asked AND bad)::INTEGER::BIGINT AS n_fallback, asked::INTEGER::BIGINT AS n_chunks,
      CASE WHEN asked AND bad THEN 'ValueError: cannot translate' END AS error FROM t""",
)
def tx05_failing(spark, sf):
    docs = V.table(spark, sf, "conversations").selectExpr(
        "conv_id * 100000 + turn AS doc_id",
        "CASE WHEN conv_id % 2 = 0 THEN 'अ ' ELSE '' END || CASE turn % 3 WHEN 0 THEN 'x ' WHEN 1 THEN '' ELSE '42 ' END || role AS text",
    )
    out = textops.translate_documents(docs, _upper_or_fail)
    return out.select("doc_id", "route", "text", "n_fallback", "n_chunks", F.get("errors", F.lit(0)).alias("error"))
