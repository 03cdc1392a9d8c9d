"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is one last token that can end its encoding.
A token can follow another if encoding the two together gives these two again;
an encoding is the only chain of such neighbours. So a table with the last token
of every prefix is filled from left to right, and

* the encoding is read off backwards from the last entry,
* more bytes only add entries (exact appends),
* an edit touches the piece it lies in and no entry before it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from colloquy.llm.runtime import batches, once_per_process, picked
from colloquy.llm.segments import Memo, plain_pieces, units
from colloquy.llm.wordtable import UnitTable, grouped

# Pairs of tokens whose compatibility is remembered; beyond 87,381 entries a dict takes twice the memory.
MOST_PAIRS = 85_000
# Steps of prefix tables that are remembered.
MOST_MOVES = 300_000
# Pieces that are remembered besides the units of the table.
MOST_PIECES = 40_000
# The table of units has so many bits of slots: half as many as other operators'.
TABLE_BITS = 20
# Characters encoded at a time, and bytes of ids handed back at a time: workers share an executor's memory.
GROUP, OUT_BYTES = 1 << 16, 1 << 20
# Bits of a token id and of a place in the trie.
TOKEN_BITS, NODE_BITS = 20, 24
TOKENS, NODES = (1 << TOKEN_BITS) - 1, (1 << NODE_BITS) - 1
# Stands for no token before: the largest id, which is never given.
NO_TOKEN = TOKENS


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one `base64 rank` per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeRules:
    """Which neighbours merge, and in which order: the smaller the rank, the earlier."""

    def __init__(self, tokens: dict[bytes, int], rank: Callable[[int, int], float | None] | None = None):
        self.ids = tokens
        self.size = {i: len(t) for t, i in tokens.items()}
        self.text = {i: t for t, i in tokens.items()}
        # a trie of all tokens: child of (node, byte), and the token that ends at a node
        self.child: dict[int, int] = {}
        self.ends = [-1]
        for data, token in tokens.items():
            node = 0
            for byte in data:
                node = self.child.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = token
        self.inner = {key >> 8 for key in self.child}
        if len(self.ends) > NODES or max(tokens.values(), default=0) >= NO_TOKEN:
            raise ValueError("the vocabulary is too large")
        ids, text = self.ids, self.text
        # Rank files merge any two neighbours that make up a token, in order of its id.
        self.rank = rank or (lambda a, b: ids.get(text[a] + text[b]))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[bool, int], list[tuple[int, float]]] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[tuple[int, tuple[int, int] | None, float]]:
        """Plain merging of a short byte string: tokens, each with its halves and the rank that joined them."""
        parts = [(self.ids[data[i : i + 1]], None, -inf) for i in range(len(data))]
        while len(parts) > 1:
            best, at = inf, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i][0], parts[i + 1][0])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            a, b = parts[at][0], parts[at + 1][0]
            parts[at : at + 2] = [(self.ids[self.text[a] + self.text[b]], (a, b), best)]
        return parts

    def halves(self, token: int) -> tuple[int, int, float] | None:
        """The two tokens that the last merge of `token` joined, and its rank; None for a single byte.

        A token that its own bytes don't merge into has an empty answer.
        """
        if token not in self._halves:
            parts = self.merged(self.text[token])
            whole = len(parts) == 1 and parts[0][0] == token
            self._halves[token] = (*parts[0][1], parts[0][2]) if whole and parts[0][1] else None if whole else ()
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return self.halves(token) != ()

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Tokens that lie at the right or left edge while `token` is made, each with the rank that ends it."""
        key = (right, token)
        if key not in self._spines:
            spine, node, until = [], token, inf
            while True:
                spine.append((node, until))
                parts = self.halves(node)
                if not parts:
                    break
                node, until = parts[right], parts[2]
            self._spines[key] = spine
        return self._spines[key]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of `a` and `b` together are encoded as these two.

        Both sides merge on their own unless some token at the right edge of `a`
        and one at the left edge of `b`, there at the same time, merge first. On
        equal ranks the left one of two merges comes first.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = True
            lefts = self._spine(b, False)
            for x, x_until in self._spine(a, True):
                for y, y_until in lefts:
                    r = self.rank(x, y)
                    if r is not None and r < x_until and r <= y_until:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known


class Columns:
    """The steps of the prefix table, remembered.

    What the next entry depends on, a column, are the starts from which a token
    may still go on: the token before and the place in the trie, packed in one
    number, the longest first, and all of them in one byte string, which takes a
    third of a tuple's memory. The same columns come again in many pieces. A move
    is the next column and the last token there, packed alike.
    """

    def __init__(self, rules: MergeRules):
        self.rules = rules
        self.reset()

    def reset(self) -> None:
        start = array("Q", [NO_TOKEN << NODE_BITS]).tobytes()
        self.columns, self.numbers, self.moves = [start], {start: 0}, {}

    def step(self, column: int, byte: int) -> int:
        """The move from a column by one more byte."""
        rules, last, going = self.rules, -1, array("Q")
        for start in memoryview(self.columns[column]).cast("Q"):
            node = rules.child.get((start & NODES) << 8 | byte)
            if node is None:
                continue
            before = start >> NODE_BITS
            if node in rules.inner:
                going.append(before << NODE_BITS | node)
            if last < 0 and (token := rules.ends[node]) >= 0:
                if rules.reachable(token) if before == NO_TOKEN else rules.compatible(before, token):
                    last = token
        if last < 0:
            raise ValueError(f"byte {byte} has no token")
        going.append(last << NODE_BITS)
        after = going.tobytes()
        number = self.numbers.setdefault(after, len(self.columns))
        if number == len(self.columns):
            self.columns.append(after)
        self.moves[column << 8 | byte] = move = number << TOKEN_BITS | last
        return move


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, columns: Columns, data: bytes = b""):
        self.columns, self.data, self.last, self.column = columns, b"", [], [0]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Add bytes at the end; the entries there are stay as they are."""
        known, step, column, last, at = self.columns.moves.get, self.columns.step, self.column, self.last, self.column[-1]
        for byte in more:
            move = known(at << 8 | byte) or step(at, byte)
            at = move >> TOKEN_BITS
            column.append(at)
            last.append(move & TOKENS)
        self.data += more
        return self

    def edit(self, start: int, stop: int, new: bytes) -> PrefixTable:
        """Replace bytes start..stop; only entries from `start` on are computed anew."""
        tail, self.data = self.data[stop:], self.data[:start]
        del self.last[start:], self.column[start + 1 :]
        return self.append(new + tail)

    def tokens(self) -> list[int]:
        out, last, size, end = [], self.last, self.columns.rules.size, len(self.last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out


class Codec:
    """Texts to token ids and back, as a rank file and a split pattern define them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rules = MergeRules(ranks)
        self.columns = Columns(self.rules)
        self.split = regex.compile(pattern).findall
        self.pieces = Memo(lambda piece: array("I", self.piece(piece.encode())), MOST_PIECES)
        self.table = UnitTable(lambda found: list(map(self.unit, found)), True, self.whole, TABLE_BITS)
        self.bytes_of = [self.rules.text.get(i, b"") for i in range(max(ranks.values(), default=-1) + 1)]

    def unit(self, unit: str) -> array:
        found = plain_pieces(unit) or self.split(unit)
        if len(found) == 1:
            return self.pieces(found[0])
        return array("I", chain.from_iterable(map(self.pieces, found)))

    def whole(self, text: str) -> array:
        """Ids of a text unit by unit."""
        return array("I", chain.from_iterable(map(self.unit, units(text))))

    def piece(self, data: bytes) -> list[int]:
        whole = self.rules.ids.get(data)
        if whole is not None:
            return [whole]
        if len(self.columns.moves) >= MOST_MOVES:
            self.columns.reset()
        return PrefixTable(self.columns, data).tokens()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, n = self.table.encode(texts)
        ends = np.cumsum(n).tolist()
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends], ends)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class EditableText:
    """A text whose ids follow appends and edits without encoding it all again."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec = codec
        self.units = units(text)
        self.ids = [codec.unit(u) for u in self.units]

    @property
    def text(self) -> str:
        return "".join(self.units)

    def encoded(self) -> bytes:
        return np.array(list(chain.from_iterable(self.ids)), "<u4").tobytes()

    def append(self, more: str) -> None:
        end = sum(map(len, self.units))
        self.edit(end, end, more)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters start..stop; returns how many units were encoded anew."""
        first, before = 0, 0
        while first < len(self.units) - 1 and before + len(self.units[first]) < start:
            before += len(self.units[first])
            first += 1
        last, upto = first, before + len(self.units[first])
        while last < len(self.units) - 1 and upto <= stop:
            last += 1
            upto += len(self.units[last])
        old = "".join(self.units[first : last + 1])
        changed = units(old[: start - before] + new + old[stop - before :])
        self.units[first : last + 1] = changed
        self.ids[first : last + 1] = [self.codec.unit(u) for u in changed]
        return len(changed)


def encode_documents(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False
) -> DataFrame:
    """Ids of every whole text: `doc_id`, `ids` (little-endian unsigned 32-bit), `n_tokens`, and `decoded` bytes on request.

    One output row per input row, without a shuffle; repeated rows come out
    repeated, a null text counts as empty (no ids), other columns are left out.
    `ranks` is the path of the rank file on every machine. Words are remembered
    in a bounded memo; one text may have as many bytes as a Spark string.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())] + [("decoded", pa.binary())] * decode
    )

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once_per_process(("codec", ranks, pattern), lambda: Codec(read_ranks(ranks), pattern))

        def rows() -> Iterator[tuple]:
            for part in parts:
                for keys, texts in grouped(part, GROUP):
                    for key, ids in zip(keys, codec.encode(texts)):
                        row = (key, ids, len(ids) // 4)
                        yield (*row, codec.decode(ids)) if decode else row

        yield from batches(rows(), schema, sized=1, most=OUT_BYTES)

    out = "doc_id long, ids binary, n_tokens long" + ", decoded binary" * decode
    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(run, out)
