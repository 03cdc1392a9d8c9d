"""Quality rules: plain text rules, then a calibrated logistic regression over hashed n-grams.

The features of a text are the shares of its hashed character trigrams and of
its hashed words and word pairs. A model is a weight for each hash value, so a
text is scored by looking up and averaging weights, batch by batch, in numpy.
It is fitted on a bounded sample of the labelled rows; a part of the sample that
the fit doesn't see calibrates the scores to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.runtime import forget, once_per_process, picked

# Hash values of character n-grams and of word n-grams.
BUCKETS = 1 << 15
# Characters that are analysed at a time; bounds the memory of a task.
BLOCK = 1 << 20
WINDOW = 5
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"

_U = np.uint64
_ODD = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_BASE, _INVERSE = _U(0x2545F4914F6CDD1D), _U(pow(0x2545F4914F6CDD1D, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _ODD[0]
    h = (h ^ (h >> _U(29))) * _ODD[1]
    return h ^ (h >> _U(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Analysed:
    """N-grams of some texts laid end to end; `*_at` has the number of the text each belongs to."""

    chars: np.ndarray
    chars_at: np.ndarray
    words: np.ndarray
    words_at: np.ndarray


def analyse(texts: list[str]) -> Analysed:
    """Hashed trigrams and 64-bit word hashes; n-grams don't cross from one text to the next."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    ends = np.cumsum([len(t) for t in texts])
    at = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    c = codes.astype(_U)
    if n >= 3:
        tri = (c[:-2] * _ODD[0] + c[1:-1] * _ODD[1] + c[2:] * _ODD[2]) * _ODD[3] >> _U(64 - 15)
        inside = at[:-2] == at[2:]
        chars, chars_at = tri[inside].astype(np.int64), at[:-2][inside]
    else:
        chars = chars_at = np.zeros(0, np.int64)
    letter = (codes != 32) & ((codes < 9) | (codes > 13))
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[ends] = True
    before = np.concatenate(([False], letter[:-1])) if n else letter
    after = np.concatenate((letter[1:], [False])) if n else letter
    starts = np.flatnonzero(letter & (~before | edge[:n]))
    stops = np.flatnonzero(letter & (~after | edge[1 : n + 1])) + 1
    sums = np.concatenate(([_U(0)], np.cumsum((c + _ODD[4]) * _powers(_BASE, n), dtype=_U)))
    words = _mixed((sums[stops] - sums[starts]) * _powers(_INVERSE, n)[starts] + (stops - starts).astype(_U))
    return Analysed(chars, chars_at, words, at[starts] if n else starts)


def repeated_words(words: np.ndarray, at: np.ndarray, texts: int) -> np.ndarray:
    """Per text, how many words lie in a window of five words that the text has twice or more."""
    if len(words) <= WINDOW:
        return np.zeros(texts, np.int64)
    m = len(words) - WINDOW + 1
    key = _mixed(at[:m].astype(_U) + _ODD[1])
    for k in range(WINDOW):
        key += words[k : k + m] * _ODD[k]
    key = _mixed(key)
    whole = at[:m] == at[WINDOW - 1 :]
    found = np.sort(key[whole])
    twice = np.unique(found[1:][found[1:] == found[:-1]])
    if not len(twice):
        return np.zeros(texts, np.int64)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = np.flatnonzero((twice[place] == key) & whole)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + WINDOW, -1)
    return np.bincount(at[np.cumsum(covered[:-1]) > 0], minlength=texts)


def word_grams(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash values of words and word pairs, after those of the character trigrams."""
    pair = _mixed(words[:-1] * _ODD[2] + words[1:])[at[:-1] == at[1:]] if len(words) else words
    both = np.concatenate((words, pair)) >> _U(64 - 15)
    return both.astype(np.int64) + BUCKETS, np.concatenate((at, at[:-1][at[:-1] == at[1:]]) if len(words) else (at, at))


@dataclass
class Model:
    """Weights per hash value, the bias, and the line that turns scores into calibrated log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -500, 500)))


def _mean(values: np.ndarray, at: np.ndarray, texts: int) -> np.ndarray:
    n = np.bincount(at, minlength=texts)
    return np.bincount(at, weights=values, minlength=texts) / np.maximum(n, 1)


def pieces(text: str) -> list[str]:
    """A long text in blocks, cut at white space only; a longer word makes a longer block."""
    out, at = [], 0
    while len(text) - at > BLOCK:
        end = max(text.rfind(s, at + 1, at + BLOCK) for s in SPACES)
        if end < 0:
            end = min((i for i in (text.find(s, at + BLOCK) for s in SPACES) if i >= 0), default=len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _grams(texts: list[str]) -> tuple[Analysed, np.ndarray, np.ndarray]:
    found = analyse(texts)
    return found, *word_grams(found.words, found.words_at)


def judged(texts: list[str], model: Model | None) -> Iterator[tuple[int, int, float | None]]:
    """Per text: number of words, words in repeated windows, score."""
    held: list[str] = []
    size = 0

    def flush() -> Iterator[tuple[int, int, float | None]]:
        found, grams, grams_at = _grams(held)
        n = len(held)
        counts, repeats = np.bincount(found.words_at, minlength=n), repeated_words(found.words, found.words_at, n)
        scores: list = [None] * n
        if model:
            scores = (
                model.bias
                + _mean(model.weights[found.chars], found.chars_at, n)
                + _mean(model.weights[grams], grams_at, n)
            ).tolist()
        yield from zip(counts.tolist(), repeats.tolist(), scores)

    for text in texts:
        if held and size + len(text) > BLOCK:
            yield from flush()
            held, size = [], 0
        if len(text) > BLOCK:
            yield _long(text, model)
        else:
            held.append(text)
            size += len(text)
    if held:
        yield from flush()


def _piecewise(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words, trigrams and word n-grams of a text, block by block; those across a cut come with the block after it."""
    at, last = 0, np.zeros(0, _U)
    for piece in pieces(text):
        found, grams, _ = _grams([piece])
        chars = found.chars
        if at:
            chars = np.concatenate((chars, analyse([text[max(0, at - 2) : at] + piece[:2]]).chars))
            pair = word_grams(np.concatenate((last, found.words[:1])), np.zeros(len(last) + len(found.words[:1]), np.int64))[0]
            grams = np.concatenate((grams, pair[2:]))
        last = found.words[-1:] if len(found.words) else last
        at += len(piece)
        yield found.words, chars, grams


def _long(text: str, model: Model | None) -> tuple[int, int, float | None]:
    words, sums = [], np.zeros(4)
    for found, chars, grams in _piecewise(text):
        words.append(found)
        if model:
            sums += model.weights[chars].sum(), len(chars), model.weights[grams].sum(), len(grams)
    every = np.concatenate(words)
    score = model.bias + sums[0] / max(sums[1], 1) + sums[2] / max(sums[3], 1) if model else None
    return len(every), int(repeated_words(every, np.zeros(len(every), np.int64), 1)[0]), score


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of one text: hash values, and their shares among the n-grams of their kind."""
    total = np.zeros(2 * BUCKETS)
    for _, chars, grams in _piecewise(text):
        total += np.bincount(np.concatenate((chars, grams)), minlength=2 * BUCKETS)
    for half in (total[:BUCKETS], total[BUCKETS:]):
        half /= max(half.sum(), 1)
    where = np.flatnonzero(total)
    return where.astype(np.int32), total[where].astype(np.float32)


def fit(labels: np.ndarray, features: list[tuple[np.ndarray, np.ndarray]], held_out: float = 0.3) -> Model | None:
    """Logistic regression by L-BFGS with a quadratic penalty, then a line fitted to the held-out rows.

    None if either part lacks one of the classes.
    """
    cut = int(len(labels) * (1 - held_out))
    for part in (labels[:cut], labels[cut:]):
        if len(part) == 0 or part.min() == part.max():
            return None
    scale, penalty = 30.0, 1e-4
    def table(part: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols, vals = (np.concatenate([f[i] for f in part]) for i in (0, 1))
        return cols, vals * np.float32(scale), np.repeat(np.arange(len(part), dtype=np.int32), [len(f[0]) for f in part])

    (cols, vals, rows), y = table(features[:cut]), labels[:cut].astype(float)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = w[-1] + np.bincount(rows, weights=w[cols] * vals, minlength=cut)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        off = (p - y) / cut
        slope = np.append(np.bincount(cols, weights=off[rows] * vals, minlength=2 * BUCKETS), off.sum())
        slope[:-1] += penalty * w[:-1]
        return float(np.mean(np.logaddexp(0, z) - y * z) + penalty / 2 * (w[:-1] @ w[:-1])), slope

    w = minimised(loss, np.zeros(2 * BUCKETS + 1))
    cols, vals, rows = table(features[cut:])
    score = w[-1] + np.bincount(rows, weights=w[cols] * vals, minlength=len(labels) - cut)
    slope, offset = calibrated(score, labels[cut:].astype(float))
    return Model(w[:-1] * scale, float(w[-1]), slope, offset)


def minimised(loss, w: np.ndarray, rounds: int = 60, memory: int = 8, least: float = 1e-7) -> np.ndarray:
    """A smooth convex function's minimum by limited-memory BFGS with step halving."""
    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, back = slope.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (y @ s)
            q -= a * y
            back.append(a)
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(back)):
            q += (a - (y @ q) / (y @ s)) * s
        size = 1.0
        for _ in range(25):
            new = w - size * q
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * (slope @ q):
                break
            size /= 2
        else:
            break
        if (new_slope - slope) @ (new - w) > 1e-12:
            steps = [*steps, (new - w, new_slope - slope)][-memory:]
        done = value - new_value < least
        w, value, slope = new, new_value, new_slope
        if done:
            break
    return w


def calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds that fit `y` best, on targets kept off 0 and 1.

    The kept-off targets give a finite best line even for scores that separate
    the classes; each step has to lower the loss, so it cannot run away.
    """
    good = y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    middle, spread = score.mean(), max(float(score.std()), 1e-9)
    x = (score - middle) / spread

    def loss(line: np.ndarray) -> tuple[float, np.ndarray]:
        z = line[0] * x + line[1]
        off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        return float(np.mean(np.logaddexp(0, z) - target * z)), np.array([np.mean(off * x), np.mean(off)])

    slope, offset = minimised(loss, np.array([1.0, 0.0]), rounds=200, least=1e-12)
    return float(slope / spread), float(offset - slope * middle / spread)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int, id_col: str, text_col: str, label_col: str
) -> DataFrame:
    """A bounded sample of labelled texts: `label`, `text`; the same rows at every run.

    Rows come in the order of a hash of the id. Several labels of a document
    count as the worst of them. At most `max_rows` rows, none over `max_chars`
    characters, so the sample has a fixed size bound.
    """
    known = (
        picked(labels, doc_id=id_col, label=label_col)
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    )
    # about four times the rows wanted lie below this place, so that few go to the task that sorts them
    last = 2**63 - 1
    below = min(last, last * 4 * max_rows // max(1, known.count()))
    judged_ids = known.where(F.col("place") <= F.lit(below)).orderBy("place", "doc_id").limit(max_rows).drop("place")
    texts = picked(docs, doc_id=id_col, text=text_col).where(F.length("text") <= max_chars)
    # `judged_ids` has max_rows rows of two numbers at most
    return (
        texts.join(F.broadcast(judged_ids), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(max_rows)
        .select("label", "text")
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 3000,
    max_chars: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model | None:
    """The model for `docs` from a bounded sample of labelled rows; None without rows of both classes.

    Texts that a base rule fails by its defaults are no part of the fit, since
    the model never decides on them.
    `max_rows` and `max_chars` bound the sample, which one task fits on; only the
    weights come to the driver.
    """
    sample = labelled_sample(docs, labels, max_rows, max_chars, id_col, text_col, label_col)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        answers, features = [], []
        for part in parts:
            texts = part.column(1).to_pylist()
            for label, text, (n, repeats, _) in zip(part.column(0).to_pylist(), texts, judged(texts, None)):
                if not base_failed(n, repeats):
                    answers.append(label)
                    features.append(shares(text))
        model = fit(np.array(answers), features)
        if model:
            yield pa.RecordBatch.from_pydict(
                {
                    "weights": [model.weights.astype("<f4").tobytes()], "bias": [model.bias], "slope": [model.slope],
                    "offset": [model.offset],
                }
            )

    found = sample.coalesce(1).mapInArrow(run, "weights binary, bias double, slope double, offset double").first()
    return found and Model(np.frombuffer(found.weights, "<f4"), found.bias, found.slope, found.offset)


def base_failed(words: int, repeats: int, min_words: int = 10, max_repeat_percent: int = 20) -> bool:
    return words < min_words or 100 * repeats > max_repeat_percent * words


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = pa.struct(
    [(n, pa.int64()) for n in NUMBERS] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())]
)
VERDICT_DDL = ", ".join(f"{n} long" for n in NUMBERS) + ", base_failed boolean, kept boolean, probability double"


def verdict(
    text: Column, model: Model | None, threshold: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20
) -> Column:
    """Statistics and verdict of a text as a struct, computed in Arrow batches.

    `base_failed`: fewer than `min_words` words, or over `max_repeat_percent` of
    the words in windows of five that come again. `kept`: no base rule failed and
    the calibrated probability of good quality is `threshold` or more; without a
    model the base rules decide and `probability` is null. A null text has no
    words and fails.
    """

    def judge(part: pa.Array) -> pa.Array:
        once_per_process(("quality",), lambda: True)
        rows = []
        for at in range(0, len(part), 1024):
            texts = [t or "" for t in part.slice(at, 1024).to_pylist()]
            for t, (n, repeats, score) in zip(texts, judged(texts, model)):
                lines = [line for line in t.split("\n") if line.strip(SPACES)]
                failed = base_failed(n, repeats, min_words, max_repeat_percent)
                p = None if score is None else float(model.probability(np.float64(score)))
                rows.append(
                    (
                        n, len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)),
                        repeats, failed, not failed and (p is None or p >= threshold), p,
                    )
                )
        columns = zip(*rows) if rows else [()] * len(VERDICT)
        return pa.StructArray.from_arrays(
            [pa.array(values, type=field.type) for values, field in zip(columns, VERDICT)], fields=list(VERDICT)
        )

    # the annotations are looked up by name, which functions that travel by value lack
    judge.__annotations__ = {"part": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, VERDICT_DDL)(text)


def apply_rules(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = (), **limits
) -> DataFrame:
    """`doc_id` and the fields of `verdict` for every whole text, without a shuffle.

    Repeated rows are judged alike; an empty table gives an empty result. `keep`
    names further input columns to pass on as `in_<name>`; the others are left out.
    """
    source = picked(docs, doc_id=id_col, text=text_col, **{f"in_{c}": c for c in keep})
    return source.select(
        "doc_id", verdict(F.col("text"), model, **limits).alias("verdict"), *(f"in_{c}" for c in keep)
    ).select("doc_id", "verdict.*", *(f"in_{c}" for c in keep))
