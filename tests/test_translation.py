"""Calls to a translation provider: repeated with pauses, and never twice for a finished chunk."""

import os
import zlib

from colloquy.operators import textops


def counting(folder, failures):
    """A provider that fails `failures` times per chunk and leaves a mark for every call."""

    def provider():
        def translate(chunks):
            for chunk in chunks:
                path = os.path.join(folder, str(zlib.crc32(chunk.encode())))
                with open(path, "a+") as marks:
                    marks.write("x")
                    marks.seek(0)
                    if len(marks.read()) <= failures:
                        raise ConnectionError("busy")
            return chunks.str.upper()

        return translate

    return provider


def documents(spark):
    rows = [(i, f"न one {i}\ntwo") for i in range(6)] + [(6, "न one 0\ntwo"), (None, "न none"), (7, "english"), (8, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def results(df):
    return {r.doc_id: (r.text, r.n_fallback, r.errors) for r in df.collect()}


def test_calls_are_repeated(spark, tmp_path):
    provider = counting(str(tmp_path), 2)
    docs = documents(spark).coalesce(1)
    got = results(textops.translate_documents(docs, provider, attempts=4, pause_s=0.0))
    assert all(n == 0 and not e for _, n, e in got.values())
    assert got[3][0] == "न ONE 3\nTWO" and got[None][0] == "न NONE" and got[7][0] == "english"


def test_attempts_are_bounded(spark, tmp_path):
    got = results(textops.translate_documents(documents(spark).coalesce(1), counting(str(tmp_path), 9), attempts=2, pause_s=0.0))
    assert got[3] == ("न one 3\ntwo", 1, ["ConnectionError: busy"])


def test_second_run_makes_no_call(spark, tmp_path):
    marks, finished = tmp_path / "marks", str(tmp_path / "finished")
    marks.mkdir()

    def calls():
        return {p.name: p.read_text() for p in marks.iterdir()}

    first = results(textops.translate_documents(documents(spark), counting(str(marks), 0), finished=finished))
    made = calls()
    # documents 0 and 6 have equal chunks
    assert len(made) == 7 and set(made.values()) == {"x"}
    again = results(textops.translate_documents(documents(spark), counting(str(marks), 0), finished=finished))
    assert again == first and calls() == made
    assert first == results(textops.translate_documents(documents(spark), counting(str(marks), 0)))


def test_failed_chunks_are_asked_for_again(spark, tmp_path):
    marks, finished = tmp_path / "marks", str(tmp_path / "finished")
    marks.mkdir()
    docs = documents(spark).where("doc_id = 3")
    failed = results(textops.translate_documents(docs, counting(str(marks), 1), finished=finished))
    assert failed[3] == ("न one 3\ntwo", 1, ["ConnectionError: busy"])
    assert results(textops.translate_documents(docs, counting(str(marks), 1), finished=finished))[3][1:] == (0, [])


def test_empty_table(spark, tmp_path):
    empty = documents(spark).limit(0)
    assert textops.translate_documents(empty, finished=str(tmp_path / "finished")).count() == 0
