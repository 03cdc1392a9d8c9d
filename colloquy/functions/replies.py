"""Reading model replies that may or may not hold JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.numeric import _col, let


def reply_content(response: Column | str) -> Column:
    """Message text of a chat response, else its plain text, else empty."""
    response = _col(response)
    return F.coalesce(
        F.nullif(F.get_json_object(response, "$.choices[0].message.content"), F.lit("")),
        F.nullif(F.get_json_object(response, "$.choices[0].text"), F.lit("")),
        F.lit(""),
    )


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull() & (text != ""), text)


def _unfenced(raw: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(raw, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", "")
    return F.when(raw.startswith("```"), F.btrim(bare)).otherwise(raw)


def parse_model_json(reply: Column | str) -> Column:
    """The JSON object in a reply as text, NULL when there is none.

    Code fences are removed first; if the rest is not JSON, the span from the
    first `{` to the last `}` is tried.
    """
    trimmed = F.btrim(F.coalesce(_col(reply), F.lit("")))
    return let(
        trimmed,
        lambda raw: let(
            _unfenced(raw),
            lambda text: F.coalesce(_valid(text), _valid(F.regexp_extract(text, r"(?s)\{.*\}", 0))),
        ),
    )


PAIR = "struct<host_speaker:string,guest_speaker:string,confidence:double,evidence:array<string>>"
MAPPING = "struct<mapping:map<string,string>,reasoning_brief:map<string,string>,confidence:map<string,double>>"
