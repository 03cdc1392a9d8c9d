import random
import pytest
from colloquy.operators import folds

def whole(text, max_len):
    """Greedy packing of a text's lines, line by line."""
    out, held, size = [], [], 0
    for line in (x.rstrip() for x in text.splitlines()):
        if len(line) > max_len or size + len(line) + 1 > max_len:
            out += ["\n".join(held)] if held else []
            held, size = [], 0
        if len(line) > max_len:
            out += [line[i : i + max_len] for i in range(0, len(line), max_len)]
        else:
            held.append(line)
            size += len(line) + 1
    return out + (["\n".join(held)] if held else [])

def test_parts(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for doc in [None, *range(60)]:
        lines = ["x" * rnd.choice([0, 0, 1, 2, 3, 9, 10, 11, 25]) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 40))]
        cuts = sorted(rnd.sample(range(1, len(lines)), min(len(lines) - 1, rnd.randrange(4)))) if len(lines) > 1 else []
        for a, b in zip([0, *cuts], [*cuts, len(lines)]):
            rows.append((doc, a, "\n".join(lines[a:b])))
        want[doc] = whole("\n".join(lines), 10)
    df = spark.createDataFrame(rows, "doc_id bigint, offset bigint, text string").repartition(5)
    got = {}
    for r in folds.chunk_parts(df, max_len=10).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_idx, r.chunk))
    for doc in want:
        assert [c for _, c in got.get(doc, [])] == want[doc], doc
        assert [i for i, _ in got.get(doc, [])] == list(range(len(want[doc]))), doc
