"""Token counts by a byte-level BPE tokenizer compiled to a deterministic transducer.

The transducer of a piece: a state stands for everything that later bytes can
ask about a prefix: the open starts (positions from which some token may still
go on), the last token before each, and how many tokens more or fewer were used
up to it. Reading a byte leads to one next state and emits by how much the token
count changes. States and transitions are made when first met, so only what the
corpus needs is compiled, and the tables start anew at a fixed size.

The transducer of a text adds what is open of the split pattern: a run of
letters, numbers, other characters or white space, or an apostrophe that may
become a contraction. Its states are plain tuples, equal in every process.

A long text is read in chunks, by several tasks. A chunk's map is a table: for
each state that is live at its first character, the state after it and the
tokens emitted between. Maps compose, associatively, so a scan in two levels
joins the chunks of a text. Behind a blank between two other characters every
state is the first one, so most tables have one entry and end alike.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bpe import MergeRules
from colloquy.llm.runtime import batches, once_per_process, picked
from colloquy.llm.segments import Memo, byte_characters, plain_pieces, units
from colloquy.llm.wordtable import UnitTable, grouped

# Transitions kept; beyond, compilation starts anew.
MOST_TRANSITIONS = 200_000
# Characters of a chunk; longer texts are counted by the maps of their chunks.
CHUNK = 1 << 14
# Characters before a chunk that are read to find the states live at its start.
BEFORE = 512
# Maps of a text that the first level of the scan joins, as a power of two.
SCAN_BITS = 8
# Nothing of a piece is open.
CLOSED = ("", 0)


class CountTransducer:
    """Counts the tokens of one piece by reading its bytes once."""

    def __init__(self, rules: MergeRules):
        self.rules = rules
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first, which has read nothing."""
        # a state: ((place in the trie, token before it or None, tokens up to it relative to now), ...), longest first
        start = ((0, None, 0),)
        self.states, self.numbers, self.moves = [start], {start: 0}, {}

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        rules, last, used = self.rules, None, 0
        going = []
        for node, before, tokens in self.states[state]:
            node = rules.child.get(node << 8 | byte)
            if node is None:
                continue
            going.append((node, before, tokens))
            token = rules.ends[node]
            if last is None and token >= 0:
                if rules.reachable(token) if before is None else rules.compatible(before, token):
                    last, used = token, tokens + 1
        if last is None:
            raise ValueError(f"byte {byte} has no token")
        # places from which no token goes on are no part of the state
        after = tuple((n, b, t - used) for n, b, t in going if n in rules.inner) + ((0, last, 0),)
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
        self.moves[state << 8 | byte] = move = (number, used)
        return move

    def number(self, state: tuple) -> int:
        """The number of a state given as a tuple, from this or another process."""
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def read(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after `data`, and the tokens emitted."""
        total = 0
        moves = self.moves.get
        for byte in data:
            move = moves(state << 8 | byte) or self._compile(state, byte)
            state = move[0]
            total += move[1]
        return state, total

    def count(self, piece: bytes) -> int:
        if len(self.moves) >= MOST_TRANSITIONS:
            self.reset()
        return self.read(0, piece)[1]


class ChunkMap(NamedTuple):
    """What reading a chunk does to the states that are live at its start.

    `table` holds for each of them the state after `head` and the tokens emitted
    in it. With `reset`, a safe cut ends the head: the state after it is the
    first one, and the rest of the chunk emits `count` and ends in `last`
    whatever came before. The head itself is kept, so that a state missing from
    the table can still be looked up by reading.
    """

    table: dict[tuple, tuple[tuple, int]]
    head: str
    reset: bool
    count: int
    last: tuple


class TokenCounter:
    """Counts as the tokenizer library gives them for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        chars = byte_characters()
        special = {t["content"] for t in spec["added_tokens"]}
        ids = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        pairs = {}
        for order, pair in enumerate(model["merges"]):
            a, b = (bytes(chars[c] for c in t) for t in (pair if isinstance(pair, list) else pair.split(" ")))
            pairs[ids[a], ids[b]] = order
        self.transducer = CountTransducer(MergeRules(ids, lambda a, b: pairs.get((a, b))))
        # --- fixed value: the split pattern of byte-level tokenizers ------------
        self.split = regex.compile(
            r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        ).findall
        # longest first: of two that start alike the library takes the longer one
        names = sorted(special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, names))).split if names else None
        self.span = regex.compile("|".join(map(regex.escape, names))).finditer if names else lambda text: ()
        kind = {c: regex.compile(p).match for c, p in (("S", r"\s"), ("L", r"\p{L}"), ("N", r"\p{N}"))}
        self.kind = Memo(lambda char: next((c for c, match in kind.items() if match(char)), "O"))
        self.pieces = Memo(lambda piece: self.transducer.count(piece.encode()))
        self.table = UnitTable(
            lambda found: [array("I", [self.count(unit)]) for unit in found], True, lambda text: array("I", [self.count(text)])
        )

    def unit(self, unit: str) -> int:
        return sum(map(self.pieces, plain_pieces(unit) or self.split(unit)))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, by units from the table."""
        found, n = self.table.encode(texts)
        return np.bincount(np.repeat(np.arange(len(texts)), n), weights=found, minlength=len(texts)).astype(np.int64)

    def _closed(self, text: str) -> int:
        return sum(map(self.unit, units(text))) if text else 0

    def count(self, text: str) -> int:
        """Tokens of a text that starts and ends with nothing open."""
        if not text:
            return 0
        if self.specials is None:
            return self._closed(text)
        parts = self.specials(text)
        return len(parts) - 1 + sum(map(self._closed, parts))

    def read(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state after `text` and the tokens emitted, character by character.

        Every prefix is counted as if the text ended there, so nothing is added
        at the end. A special string closes what is open.
        """
        if len(self.transducer.moves) >= MOST_TRANSITIONS:
            self.transducer.reset()
        mode, *held = state
        number = self.transducer.number
        state = (mode, *(number(h) if isinstance(h, tuple) else h for h in held))
        total = 0
        for i, part in enumerate(self.specials(text) if self.specials else [text]):
            if i:
                state, total = CLOSED, total + 1
            for char in part:
                state, emitted = self._step(state, char)
                total += emitted
        mode, place, *rest = state
        return (mode, self.transducer.states[place] if mode else 0, *rest), total

    def _step(self, state: tuple, char: str) -> tuple[tuple, int]:
        mode, place, *rest = state
        kind, data, read = self.kind(char), char.encode(), self.transducer.read
        if mode == kind != "S":
            place, n = read(place, data)
            return (mode, place), n
        before = 0
        if mode == "S":
            last, added = rest
            if kind == "S":
                place, n = read(place, data)
                return ("S", place, char, n), n
            # the run's last character leaves it: a blank goes to what follows, another stands alone
            before = -added
            place, n = read(0, last.encode())
            if last == " ":
                place, m = read(place, data)
                return (kind, place), before + n + m
            before += n
        elif mode == "'":
            if char in "stmd":
                return CLOSED, self.transducer.count(b"'" + data) - rest[0]
            if char in "rvl":
                place, n = read(0, data)
                return ("'" + char, place, rest[0] + n), n
            if kind == "O":
                place, n = read(place, data)
                return ("O", place), n
        elif mode[:1] == "'":
            # letters after an apostrophe: a contraction, or a run of letters of its own
            if mode + char in ("'re", "'ve", "'ll"):
                return CLOSED, self.transducer.count((mode + char).encode()) - rest[0]
            if kind == "L":
                place, n = read(place, data)
                return ("L", place), n
        place, n = read(0, data)
        if char == "'":
            return ("'", place, n), before + n
        if kind == "S":
            return ("S", place, char, n), before + n
        return (kind, place), before + n

    @staticmethod
    def _cut(text: str, at: int, step: int) -> int:
        """The nearest blank between two characters that are no white space; -1 if there is none."""
        while True:
            at = text.find(" ", at + 1) if step > 0 else text.rfind(" ", 0, max(at, 0))
            if at <= 0:
                return -1
            if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
                return at

    def chunks(self, text: str) -> Iterator[tuple[str, str]]:
        """The chunks of a text, each with what is read before it; no cut lies inside a special string."""
        spans = [m.span() for m in self.span(text)]
        begins = [a for a, _ in spans]

        def outside(at: int, end: int) -> int:
            i = bisect_left(begins, at) - 1
            return spans[i][end] if i >= 0 and spans[i][1] > at else at

        cuts = [*sorted({outside(at, 0) for at in range(0, len(text), CHUNK)}), len(text)]
        for a, b in zip(cuts, cuts[1:]):
            yield text[outside(max(0, a - BEFORE), 1) : a], text[a:b]

    def live(self, before: str, first: bool) -> set[tuple]:
        """States that may be live behind `before`: one if a safe cut is in it, else those of several starts."""
        if first:
            return {CLOSED}
        cut = self._cut(before, len(before), -1)
        starts = [cut] if cut >= 0 else [0, len(before) // 3, len(before) * 2 // 3]
        return {self.read(CLOSED, before[at:])[0] for at in starts}

    def chunk_maps(self, chunks: list[tuple[set[tuple], str]]) -> list[ChunkMap]:
        """The maps of chunks given with their live states; what lies between safe cuts goes through the table."""
        made, bodies = [], []
        for live, text in chunks:
            at, end = self._cut(text, 0, 1), self._cut(text, len(text), -1)
            head = text[:at] if at >= 0 else text
            table = {state: self.read(state, head) for state in live}
            last, n = self.read(CLOSED, text[end:]) if at >= 0 else (CLOSED, 0)
            made.append(ChunkMap(table, head, at >= 0, n, last))
            # a letter before the first cut, so that its blank is no blank at a text's start
            bodies.append("x" + text[at:end] if at >= 0 else "")
        one = self.count("x")
        return [m._replace(count=m.count + n - one) if m.reset else m for m, n in zip(made, self.counts(bodies).tolist())]

    def applied(self, map_: ChunkMap, state: tuple) -> tuple[tuple, int]:
        """The state after a chunk that begins in `state`, and the tokens emitted."""
        after, n = map_.table.get(state) or self.read(state, map_.head)
        return (map_.last, n + map_.count) if map_.reset else (after, n)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks together."""
        if a.reset:
            last, n = self.applied(b, a.last)
            return a._replace(count=a.count + n, last=last)
        table = {}
        for state, (middle, n) in a.table.items():
            after, m = b.table.get(middle) or self.read(middle, b.head)
            table[state] = (after, n + m)
        return ChunkMap(table, a.head + b.head, b.reset, b.count, b.last)


def packed(map_: ChunkMap) -> str:
    return json.dumps([list(map_.table.items()), *map_[1:]])


def unpacked(text: str) -> ChunkMap:
    def tuples(value):
        return tuple(map(tuples, value)) if isinstance(value, list) else value

    table, head, reset, count, last = json.loads(text)
    return ChunkMap({tuples(k): tuples(v) for k, v in table}, head, reset, count, tuples(last))


def _long_counts(long: DataFrame, counter: Callable[[], TokenCounter]) -> DataFrame:
    """Tokens of each different text of `long` (`digest`, `text`) by its chunks: `digest`, `n_tokens`.

    Chunks are rows, dealt out by text and number, and equal ones of copies are
    read once. Tasks hand on maps only: the whole text never meets in one task
    again, unless it has no safe cut.
    """

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("chunk", pa.int64()), ("before", pa.string()), ("body", pa.string())])
        tokens = counter()
        rows = (
            (digest, i, *chunk)
            for part in parts
            for digest, text in zip(part.column(0).to_pylist(), part.column(1))
            for i, chunk in enumerate(tokens.chunks(text.as_py()))
        )
        yield from batches(rows, schema, 3)

    map_schema = pa.schema([("digest", pa.binary()), ("chunk", pa.int64()), ("map", pa.string())])

    def tabulate(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter()

        def rows() -> Iterator[tuple]:
            for part in parts:
                for at in range(0, part.num_rows, 64):
                    some = part.slice(at, 64).to_pylist()
                    maps = tokens.chunk_maps([(tokens.live(r["before"], r["chunk"] == 0), r["body"]) for r in some])
                    for r, map_ in zip(some, maps):
                        yield r["digest"], r["chunk"], packed(map_)

        yield from batches(rows(), map_schema, 2)

    def scan(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One map for each run of neighbouring maps of one block of a text."""
        tokens = counter()

        def rows() -> Iterator[tuple]:
            held = None
            for r in (r for part in parts for r in part.to_pylist()):
                place, map_ = (r["digest"], r["chunk"] >> SCAN_BITS), unpacked(r["map"])
                if held and held[0] == place:
                    held = place, tokens.compose(held[1], map_)
                    continue
                if held:
                    yield *held[0], packed(held[1])
                held = place, map_
            if held:
                yield *held[0], packed(held[1])

        yield from batches(rows(), map_schema, 2)

    def total(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
        tokens = counter()

        def rows() -> Iterator[tuple]:
            digest, state, n = None, CLOSED, 0
            for r in (r for part in parts for r in part.to_pylist()):
                if digest is not None and digest != r["digest"]:
                    yield digest, n
                if digest != r["digest"]:
                    digest, state, n = r["digest"], CLOSED, 0
                state, more = tokens.applied(unpacked(r["map"]), state)
                n += more
            if digest is not None:
                yield digest, n

        yield from batches(rows(), schema)

    maps_type = "digest binary, chunk long, map string"
    cuts = long.mapInArrow(cut, "digest binary, chunk long, before string, body string")
    maps = cuts.dropDuplicates(["digest", "chunk"]).mapInArrow(tabulate, maps_type)
    block = F.shiftright("chunk", SCAN_BITS)
    joined = maps.repartition("digest", block).sortWithinPartitions("digest", "chunk").mapInArrow(scan, maps_type)
    return joined.repartition("digest").sortWithinPartitions("digest", "chunk").mapInArrow(total, "digest binary, n_tokens long")


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token count of every whole text: `doc_id`, `n_bytes` (UTF-8), `n_tokens`, `over_limit` (n_tokens > limit).

    One output row per input row; repeated rows come out repeated, a null text
    counts as empty (0 bytes, 0 tokens), other columns are left out. Texts of up
    to `CHUNK` characters are counted where they are read, without a shuffle.
    Longer ones, of any length, are cut into chunks that several tasks read; their
    maps are joined, and the counts go back to the rows by the text's digest.
    `tokenizer` is the path of a byte-level BPE file on every machine; strings of
    special tokens inside a text count as one token each.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def counter() -> TokenCounter:
        return once_per_process(("counter", tokenizer), lambda: TokenCounter(tokenizer))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter()

        def rows() -> Iterator[tuple]:
            for part in parts:
                for keys, texts in grouped(part):
                    for key, text, n in zip(keys, texts, tokens.counts(texts).tolist()):
                        yield key, len(text.encode()), n

        yield from batches(rows(), schema)

    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    far = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    short = rows.where(~far).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    long = rows.where(far).withColumn("digest", F.unhex(F.sha2("text", 256)))
    counts = _long_counts(long.select("digest", "text"), counter)
    known = long.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(counts, "digest")
    return short.unionByName(known.drop("digest")).withColumn("over_limit", F.col("n_tokens") > limit)
