"""Values of words in a hash table of numpy arrays, looked up for whole batches of texts at a time."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from colloquy.llm.segments import MARKS, byte_characters

# Longest word, in bytes, that the table holds; the last byte of a key has its length and what precedes it.
LONGEST = 23
SLOT_BITS = 21
# Words after which the table starts anew; smaller tables hold as great a share of their slots.
MOST_WORDS = (1 << SLOT_BITS) * 5 // 8
# Longer words, and pieces of words, that are remembered apart from the table.
MOST_LONGER = 40_000
MOST_PIECES = 150_000
POOL = 1 << 21
# Characters of texts that are looked up at a time.
GROUP = 1 << 20

_U = np.uint64
_MIX = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
# For each length the bytes of a key that belong to the word.
_MASKS = np.array(
    [[(1 << 8 * min(max(n - 8 * i, 0), 8)) - 1 for i in range(3)] for n in range(LONGEST + 1)], np.uint64
)
# White space other than blank and line break, and the bytes with which it may begin.
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_BYTES = np.array([b < 32 and b != 10 or b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
BEFORE = ("", " ", "\n")


class UnitTable:
    """Values of the units of texts: arrays of numbers, remembered by the unit's bytes, so the table is exact.

    Without `joined`, blanks and line breaks are cuts that belong to no unit. With
    it a unit takes in the single blank or line break before it, which is right
    for patterns that join a blank to what follows; a text with other white space
    goes to `whole` in one piece. The table starts anew after a fixed number of
    words, so its memory is bounded.
    """

    def __init__(
        self,
        values: Callable[[list[str]], list[array]],
        joined: bool = False,
        whole: Callable[[str], array] | None = None,
        slot_bits: int | None = None,
    ):
        self.values, self.joined, self.whole, self.slot_bits = values, joined, whole, slot_bits or SLOT_BITS
        self.longer: dict[tuple[int, bytes], array] = {}
        self.reset()

    def reset(self) -> None:
        # three words of key, then where the values lie: offset and number
        self.table = np.zeros((1 << self.slot_bits, 4), _U)
        self.pool = np.zeros(POOL, np.uint32)
        self.used = self.words = 0

    def _pooled(self, found: list[array]) -> tuple[np.ndarray, np.ndarray]:
        """Put values at the pool's end; offsets and numbers."""
        counts = np.array([len(f) for f in found], np.int64)
        total = int(counts.sum())
        while self.used + total > len(self.pool):
            # new pages take memory only once they are written
            held, self.pool = self.pool, np.zeros(2 * len(self.pool), np.uint32)
            self.pool[: len(held)] = held
        self.pool[self.used : self.used + total] = np.frombuffer(b"".join(f.tobytes() for f in found), np.uint32)
        return np.cumsum(counts) - counts + self.used, counts

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] ^ (keys[:, 1] * _MIX[0])) * _MIX[1] ^ keys[:, 2] * _MIX[2]
        h ^= h >> _U(32)
        return (h * _MIX[0] >> _U(64 - self.slot_bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key's values as in the table; 0 for unknown keys."""
        out = np.zeros(len(keys), _U)
        slot = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            there = self.table[slot]
            wanted = keys[waiting]
            same = (there[:, 2] == wanted[:, 2]) & (there[:, 0] == wanted[:, 0]) & (there[:, 1] == wanted[:, 1])
            out[waiting[same]] = there[same, 3]
            going = ~same & (there[:, 2] != 0)
            waiting, slot = waiting[going], (slot[going] + 1) % len(self.table)
        return out

    def _insert(self, keys: np.ndarray, places: np.ndarray) -> None:
        rows = np.concatenate((keys, places[:, None]), 1)
        slot = self._slot(keys)
        while len(rows):
            free = self.table[slot, 2] == 0
            self.table[slot[free]] = rows[free]
            # of several rows for one slot the last one got it
            going = (self.table[slot] != rows).any(axis=1)
            rows, slot = rows[going], (slot[going] + 1) % len(self.table)
        self.words += len(keys)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All values of the texts end to end, and the number of values of each."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data = [text.encode() for text in texts]
        sizes = np.array([len(d) for d in data], np.int64)
        joined = b" ".join([*data, bytes(24)])
        n = len(joined) - 24
        letters = np.frombuffer(joined, np.uint8)
        # each text ends with a blank
        ends = np.flatnonzero((letters[:n] == 32) | (letters[:n] == 10))
        starts = np.concatenate(([0], ends[:-1] + 1))
        sized = ends - starts
        bounds = np.cumsum(sizes + 1)
        of = np.searchsorted(bounds, starts, "right")
        before = np.zeros(len(starts), np.int64)
        odd = np.zeros(0, np.int64)
        if self.joined:
            before[1:] = 1 + (letters[ends[:-1]] == 10)
            before[np.searchsorted(starts, bounds - sizes - 1)] = 0
            odd = self._odd(texts, letters[:n], of, sized, sizes, bounds)
        real = sized > 0
        if len(odd):
            real &= ~np.isin(of, odd)
        starts, sized, of, before = starts[real], sized[real], of[real], before[real]
        offset, count = self._looked_up(joined, letters, n, starts, sized, before)
        if len(odd):
            # their values lie behind the others' until the next batch
            self.used, kept = self.spare, self.used
            places = self._pooled([self.whole(texts[i]) for i in odd.tolist()])
            self.used = kept
            of = np.concatenate((of, odd))
            order = np.argsort(of, kind="stable")
            of = of[order]
            offset, count = (np.concatenate(pair)[order] for pair in zip((offset, count), places))
        total = np.cumsum(count)
        at = np.repeat(offset - total + count, count) + np.arange(total[-1] if len(total) else 0)
        return self.pool[at], np.bincount(of, weights=count, minlength=len(texts)).astype(np.int64)

    @staticmethod
    def _odd(texts: list[str], letters: np.ndarray, of: np.ndarray, sized: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts with white space at an end, in a run, or of another kind than blank and line break."""
        gaps = np.unique(of[sized == 0])
        maybe = np.unique(np.searchsorted(bounds, np.flatnonzero(_ODD_BYTES[letters]), "right"))
        other = [i for i in maybe.tolist() if _ODD.search(texts[i])]
        return np.union1d(gaps[sizes[gaps] > 0], np.array(other, np.int64))

    def _looked_up(
        self, joined: bytes, letters: np.ndarray, n: int, starts: np.ndarray, sized: np.ndarray, before: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Offset and number of the values of each unit."""
        short = np.flatnonzero(sized <= LONGEST)
        keys = np.lib.stride_tricks.as_strided(letters, (n, 24), (1, 1))[starts[short]].view(_U) & _MASKS[sized[short]]
        keys[:, 2] |= (sized[short] + 32 * before[short]).astype(_U) << _U(56)
        if self.words > min(MOST_WORDS, len(self.table) * 5 // 8):
            self.reset()
        places = np.zeros(len(starts), _U)
        found = self._find(keys)
        unknown = np.flatnonzero(found == 0)
        if len(unknown):
            at = short[unknown]
            units = self._units(joined, starts[at], sized[at], before[at])
            first = {unit: i for i, unit in enumerate(units)}
            offset, count = self._pooled(self.values([BEFORE[b] + w.decode() for b, w in first]))
            self.used += int(count.sum())
            # one more than the number of values, so that no place is 0
            made = offset.astype(_U) << _U(24) | (count + 1).astype(_U)
            if self.words + len(first) <= len(self.table) * 7 // 8:
                self._insert(keys[unknown[np.fromiter(first.values(), np.int64, len(first))]], made)
                found[unknown] = self._find(keys[unknown])
            else:
                # more than the table takes, as a long text may have: for this batch alone, then the table starts anew
                rank = {unit: i for i, unit in enumerate(first)}
                found[unknown] = made[[rank[unit] for unit in units]]
                self.words = len(self.table)
        places[short] = found
        offset, count = (places >> _U(24)).astype(np.int64), (places & _U(0xFFFFFF)).astype(np.int64) - 1
        far = np.flatnonzero(sized > LONGEST)
        self.spare = self.used
        if len(far):
            units = self._units(joined, starts[far], sized[far], before[far])
            if len(self.longer) > MOST_LONGER:
                self.longer.clear()
            new = [u for u in dict.fromkeys(units) if u not in self.longer]
            fresh = dict(zip(new, self.values([BEFORE[b] + w.decode() for b, w in new])))
            offset[far], count[far] = self._pooled([fresh[u] if u in fresh else self.longer[u] for u in units])
            self.spare += int(count[far].sum())
            self.longer.update((u, v) for u, v in fresh.items() if len(u[1]) <= 4 * LONGEST)
        return offset, count

    @staticmethod
    def _units(joined: bytes, starts: np.ndarray, sized: np.ndarray, before: np.ndarray) -> list[tuple[int, bytes]]:
        return [(b, joined[s:e]) for b, s, e in zip(before.tolist(), starts.tolist(), (starts + sized).tolist())]


def grouped(part: pa.RecordBatch, most: int | None = None) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch (null texts as empty) in groups that end with the text that reaches `most` characters."""
    most = most or GROUP
    keys: list = []
    texts: list[str] = []
    size = 0
    for key, text in zip(part.column(0).to_pylist(), part.column(1)):
        keys.append(key)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def plain_parts(word: str) -> tuple[str, ...]:
    """A Latin-1 word in lower case and the mark after it; anything else as it is."""
    body, mark = (word[:-1], word[-1]) if word[-1:] in MARKS else (word, "")
    if body.isalpha() and max(body) <= "\xff":
        return (body.lower(), mark) if mark else (body.lower(),)
    return (word,)


class WordCodec:
    """Ids of texts by a tokenizer that drops white space, so that every blank and line break is a cut.

    The library encodes words, in lower case and without a mark at the end where
    that makes no difference to it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        normal, split = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        steps = {s["type"] for s in normal.get("normalizers", [normal]) + split.get("pretokenizers", [split]) if s}
        # a tokenizer with these steps has lower case itself and splits marks from letters
        self.lower = steps == {"NFC", "Replace", "Lowercase", "Split", "ByteLevel"}
        self.letters = {byte: char for char, byte in byte_characters().items()}
        self.pieces: dict[str, array] = {}
        self.table = UnitTable(self._values)

    def _values(self, words: list[str]) -> list[array]:
        """Ids of distinct words, from the pieces that are known and the library."""
        cut = [plain_parts(w) for w in words] if self.lower else [(w,) for w in words]
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        known = self.pieces
        new = [p for p in set(chain.from_iterable(cut)) if p not in known]
        if self.lower:
            # lower-case letters are one piece to the tokenizer, which goes straight to its model
            model, rest = self.tokenizer.model.tokenize, []
            for piece in new:
                if piece.isalpha() and max(piece) <= "\xff":
                    letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                    known[piece] = array("I", [token.id for token in model(letters)])
                else:
                    rest.append(piece)
            new = rest
        for piece, made in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[piece] = array("I", made.ids)
        return [known[c[0]] if len(c) == 1 else known[c[0]] + known[c[1]] for c in cut]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and the number of ids of each."""
        return self.table.encode(texts)
