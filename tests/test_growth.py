"""What may not grow with the rows: values of a state, texts held by Python, steps made twice."""

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from colloquy.functions import text
from colloquy.sources import readers, writers
from colloquy.streaming import live

FIELDS = ["word_idx", "speaker", "start_ms", "end_ms", "token"]


class _Held(list):
    """A list state and its handle, counting the values that go in."""

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return None

    def registerTimer(self, at):
        self.timer = at

    def appendList(self, values):
        self.extend(values)


def test_words_wait_in_few_values():
    """State is read and written by the value: the words of a frame wait as one, in their order."""
    rows = [(i % 7 > 0, i, "a", 1000 * i, 1000 * i + 300, f"t{i}") for i in range(500)]
    held, segments = _Held(), live._GapSegments(800)
    segments.init(held)
    list(segments.handleInputRows((False, 1), iter([live.pd.DataFrame(rows, columns=["whole", *FIELDS])] * 2), None))
    assert len(held) == 2 and held.timer == 499_001
    whole = [r[1:] for r in rows if r[0]]
    assert list(live._unpacked(iter(held)).itertuples(index=False, name=None)) == whole * 2


def test_packed_words_come_back(monkeypatch):
    monkeypatch.setattr(live, "PACKED_ROWS", 3)
    words = live._unpacked(iter([]))
    assert len(words) == 0 and list(words.columns) == live.WAITING.names
    words = live.pd.DataFrame([(i, "s", i, i + 1, "é" * i) for i in range(7)], columns=live.WAITING.names)
    pieces = live._packed(words)
    assert len(pieces) == 3
    live.pd.testing.assert_frame_equal(live._unpacked(iter(pieces)), words)


def test_texts_become_python_strings_in_small_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "NFKC_ROWS", 2)
    assert text._nfkc.func(pa.array(["ﬁ", None, "e\u0301", "", "①"])).to_pylist() == ["fi", None, "é", "", "1"]
    assert text._nfkc.func(pa.array([], pa.string())).to_pylist() == []

    @F.arrow_udf(StringType())
    def batch_rows(ids: pa.Array) -> pa.Array:
        return pa.array([f"N{len(ids)}"] * len(ids))

    before = spark.conf.get(writers.ARROW_ROWS)
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), batch_rows("id").alias("clean"))
    writers.write_clean_pair(rows, str(tmp_path))
    seen = [r.text for r in spark.read.parquet(f"{tmp_path}/clean").collect()]
    assert len(seen) == 3000 and max(int(s[1:]) for s in seen) <= writers.TEXT_ROWS
    assert spark.read.parquet(f"{tmp_path}/lower").where("text like 'n%'").count() == 3000
    assert spark.conf.get(writers.ARROW_ROWS) == before


def test_any_document_is_parsed_once_for_each_kind(spark):
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(value):
        parsed.add(1)
        return value

    spoken = json.dumps({"segments": [{"speaker_id": 1, "start": 2, "end": 3, "transcript": "s"}]})
    words = [{"word": f"w{i}", "start": i, "end": i + 1, "speaker": 0} for i in range(14)]
    heard = json.dumps({"results": {"channels": [{"alternatives": [{"words": words}]}]}})
    docs = [("a", spoken), ("b", heard), ("c", spoken.replace("segments", "seg\\u006dents")), ("d", '{"other": 1}'), ("a", heard), ("e", None)]
    raw = spark.createDataFrame([(f"{n}.json", n, 0, v) for n, v in docs], "name string, episode_id string, offset bigint, value string")
    raw = raw.withColumn("value", read.asNondeterministic()("value"))
    got = sorted((r.episode_id, r.seg_idx, r.start_ms, r.end_ms, r.text, r.speaker) for r in readers.any_from(raw).collect())
    long, short = " ".join(f"w{i}" for i in range(12)), "w12 w13"
    assert got == [
        ("a", 0, 0, 12000, long, "Speaker 1"), ("a", 1, 2000, 3000, "s", "Speaker 2"), ("a", 2, 12000, 14000, short, "Speaker 1"),
        ("b", 0, 0, 12000, long, "Speaker 1"), ("b", 1, 12000, 14000, short, "Speaker 1"), ("c", 0, 2000, 3000, "s", "Speaker 2"),
    ]
    assert parsed.value <= 2 * len(docs)
