"""N-gram Jaccard join: documents linked by the similarity of their word shingle sets.

A set that is similar enough to another one lacks at most a few members of it:
its slack. So under any global order of the shingles, linked sets share one of
their first slack + 1 members, the prefix. Filters of several orders are
intersected before anything is verified:

* the order of the hashes looks at the smallest hashes of every set, half as many
  again as the prefix. A set with more than its slack of them to itself is linked
  with nothing; that leaves few sets.
* of these, three orders by frequency, with different hashes among equally
  frequent shingles: those that one set alone has come first and the most common
  ones last. Candidates share a prefix member under each of the three.

Equal sets are one. No pairs leave a task: sets that share a prefix member meet
in the group of that member's hub, the least of the sets that have it in their
prefix, and a group hands back links that connect what it found linked. Large
groups are cut into chunks that meet pairwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.components import connected
from colloquy.llm.runtime import forget, picked, written

SHINGLE = 5
PERCENT = 80
# Rows of a batch that goes to Python with whole texts.
TEXT_ROWS = 1000
# Bytes of a text that are cut into words at a time, about.
BLOCK = 1 << 20
# Shingles that a bucket, and a batch of sets, holds about.
PER_BUCKET = 2_000_000
PER_BATCH = 1_000_000
# Entry of a shingle that several sets of its batch have.
SEVERAL = 0xFFFF
# Sets of a batch whose smallest hashes are sent together.
MOST_SETS = 10_000
# Shingles of a group's chunk, about.
PER_CHUNK = 1_000_000

_U = np.uint64
_ODD = [_U(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ (h >> _U(31)) ^ _U(salt)) * _ODD[1]
    h = (h ^ (h >> _U(29))) * _ODD[2]
    return h ^ (h >> _U(32))


def word_hashes(text: bytes, block: int | None = None) -> np.ndarray:
    """Hashes of the words of a text with A to Z in lower case, cut block by block at white space."""
    block, at, found, hash_of = block or BLOCK, 0, [], xxhash.xxh3_64_intdigest
    while at < len(text):
        gap = _SPACE.search(text, at + block)
        end = gap.start() if gap else len(text)
        found.append(np.array([hash_of(w) for w in text[at:end].lower().split()], _U))
        at = end
    return np.concatenate(found) if found else np.zeros(0, _U)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of the whole sequence if it is shorter."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    m = len(words) - size + 1
    total = np.full(m, size, _U)
    for k in range(size):
        total += _mixed(words[k : k + m], k + 1) * _ODD[k % len(_ODD)]
    return np.unique(_mixed(total))


def slack(n, percent: int = PERCENT):
    """How many members a set of `n` may have that a linked set lacks."""
    return n - (percent * n + 99) // 100


def probes(n, percent: int = PERCENT):
    """How many of its smallest hashes a set of `n` sends."""
    return np.minimum(n, (3 * (slack(n, percent) + 1) + 1) // 2)


def _signed(found: np.ndarray) -> np.ndarray:
    return found.astype(_U).view(np.int64)


def document_sets(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """`doc_id`, `mark` (a hash of the text), `n`, `key` (a hash of the set; null without words), `smallest` hashes."""
    names = ["doc_id", "mark", "n", "key", "smallest"]

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            rows = []
            for text in part.column(2):
                found = shingle_set(text.as_py() or b"", size)
                n = len(found)
                key = int(_mixed(found, 7).sum(dtype=_U).view(np.int64)) if n else None
                rows.append((n, key, found[: probes(n, percent)].tobytes()))
            columns = zip(*rows) if rows else [()] * 3
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=names)

    text = F.col(f"`{text_col}`")
    source = picked(docs, doc_id=F.col(f"`{id_col}`").cast("long"), mark=F.xxhash64(text), text=text.cast("binary"))
    return source.mapInArrow(run, "doc_id long, mark long, n long, key long, smallest binary")


def _buckets(df: DataFrame, entries: int) -> int:
    """As many buckets as bound the entries of each, at least one per shuffle partition."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // PER_BUCKET))


def _dealt(tokens: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets, and which of the tokens each has."""
    place = (_mixed(tokens, 11) % _U(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    heads = np.flatnonzero(np.diff(place[order], prepend=-1))
    for rows in np.split(order, heads[1:]) if len(order) else ():
        yield int(place[rows[0]]), rows


def _groups(parts: Iterable[pa.RecordBatch], by: int = 0) -> Iterator[tuple[int, list[list]]]:
    """Consecutive rows with the same value in column `by`, from batch to batch."""
    value, held = None, []
    for part in parts:
        for row in zip(*(c.to_pylist() for c in part.columns)):
            if held and row[by] != value:
                yield value, held
                held = []
            value = row[by]
            held.append(row)
    if held:
        yield value, held


def open_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`key` of the sets that may be linked: no more than their slack of the smallest hashes are theirs alone.

    A batch sends each shingle once, with the set that has it or a note that
    several have it, so that a shingle of very many sets comes once per batch.
    """
    total = sets.agg(F.sum(F.length("smallest"))).first()[0] or 0
    buckets = _buckets(sets, total // 8)

    def deal(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            for at in range(0, part.num_rows, MOST_SETS):
                rows = dealt(*(c.slice(at, MOST_SETS) for c in part.columns))
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                        names=["bucket", "keys", "needs", "counts", "places", "tokens"],
                    )

    def dealt(n: pa.Array, key: pa.Array, smallest: pa.Array) -> list[tuple]:
        keys, first = np.unique(key.to_numpy(zero_copy_only=False), return_index=True)
        found = [np.frombuffer(smallest[int(i)].as_py(), _U) for i in first]
        if not found:
            return []
        sent = np.array([len(f) for f in found])
        needs = (sent - slack(n.to_numpy(zero_copy_only=False)[first], percent)).astype("<u4")
        tokens, owner = np.concatenate(found), np.repeat(np.arange(len(found)), sent)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        size = np.diff(np.append(heads, len(tokens)))
        own = np.bincount(owner[np.repeat(size > 1, size)], minlength=len(keys))
        tokens, places = tokens[heads], np.where(size == 1, owner[heads], SEVERAL)
        hit = np.flatnonzero(own)
        rows = [(int(keys[0] % buckets), keys[hit].tobytes(), needs[hit].tobytes(), own[hit].astype("<u4").tobytes(), b"", b"")]
        for bucket, mine in _dealt(tokens, buckets):
            used, at = np.unique(places[mine], return_inverse=True)
            real = used[used != SEVERAL]
            at = np.where(places[mine] == SEVERAL, SEVERAL, at).astype("<u2")
            rows.append((bucket, keys[real].tobytes(), needs[real].tobytes(), b"", at.tobytes(), tokens[mine].tobytes()))
        return rows

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each set shares, bucket by bucket, handed on in a row per range of keys."""
        forget()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys, needs, shared = (np.concatenate(c).astype("<i8") for c in zip(*held))
            held.clear()
            rows = [(r, keys[at].tobytes(), needs[at].tobytes(), shared[at].tobytes()) for r, at in _dealt(keys.view(_U), buckets)]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(made, names=["range", "keys", "needs", "counts"])

        for _, rows in _groups(parts):
            if sum(len(h[0]) for h in held) >= PER_BUCKET:
                yield flush()
            tokens, keys, needs, common = [], [], [], []
            for _, of, need, counts, places, found in rows:
                of, need, found = np.frombuffer(of, np.int64), np.frombuffer(need, "<u4"), np.frombuffer(found, _U)
                if counts:
                    held.append((of, need, np.frombuffer(counts, "<u4")))
                    continue
                at = np.frombuffer(places, "<u2")
                one = at != SEVERAL
                common.append(found[~one])
                tokens.append(found[one])
                keys.append(of[at[one]])
                needs.append(need[at[one]])
            if not tokens:
                continue
            tokens, keys, needs, common = (np.concatenate(a) for a in (tokens, keys, needs, common))
            order = np.lexsort((keys, tokens))
            tokens, keys, needs = tokens[order], keys[order], needs[order]
            # copies of one set in several batches are one set
            new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1]))) if len(tokens) else []
            tokens, keys, needs = tokens[new], keys[new], needs[new]
            heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else []
            size = np.diff(np.append(heads, len(tokens)))
            shared = np.repeat((size > 1) | np.isin(tokens[heads], common), size)
            where, at, n = np.unique(keys[shared], return_index=True, return_counts=True)
            if len(where):
                held.append((where, needs[shared][at], n))
        if held:
            yield flush()

    def total_of(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(parts):
            keys, needs, shared = (np.frombuffer(b"".join(r[i] for r in rows), "<i8") for i in (1, 2, 3))
            found, first, at = np.unique(keys, return_index=True, return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, at, shared)
            yield pa.RecordBatch.from_arrays([pa.array(found[sums >= needs[first]])], names=["key"])

    sent = sets.where("n > 0").select("n", "key", "smallest").mapInArrow(
        deal, "bucket int, keys binary, needs binary, counts binary, places binary, tokens binary"
    )
    shared = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        count, "range int, keys binary, needs binary, counts binary"
    )
    return shared.repartition(buckets, "range").sortWithinPartitions("range").mapInArrow(total_of, "key long")


def chosen_sets(docs: DataFrame, sets: DataFrame, keys: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """`batch`, `key`, `n`, `tokens` (all hashes) of the sets in `keys`, each once, from the text of one of its rows."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    one = sets.join(keys, "key").groupBy("key").agg(F.min(row).alias("row"))
    one = written(one.select("key", "row.*"), "chosen")
    place, text = ["unnamed", "id", "mark"], F.col(f"`{text_col}`")
    key = F.col(f"`{id_col}`").cast("long")
    texts = picked(docs, unnamed=key.isNull(), id=F.coalesce(key, F.lit(0)), mark=F.xxhash64(text), text=text.cast("binary"))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys, n, tokens = zip(*held)
            made = [pa.array([keys[0]] * len(held)), pa.array(keys), pa.array(n), pa.array(tokens, pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(made, names=["batch", "key", "n", "tokens"])

        total = 0
        for part in parts:
            for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                found = shingle_set(text.as_py(), size)
                held.append((key, len(found), found.tobytes()))
                total += len(found)
                if total >= PER_BATCH:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    # repeated rows go before the shuffle, where each task sees them
    found = texts.dropDuplicates(place).join(one, place).select("key", "text")
    return found.mapInArrow(run, "batch long, key long, n long, tokens binary")


def signatures(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`key`, `n`, `tokens` and the prefixes `p0`, `p1`, `p2` of each set under three orders by frequency.

    Members that no other set has fill a prefix first and are left out, and so
    are sets of which nothing else is left. A batch sends a shingle once with its
    count, and gets back how many sets have it in all.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = _buckets(sets, total)
    columns = ["bucket", "batch", "tokens", "counts"]

    def deal(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = (r for part in parts for r in zip(part.column(0).to_pylist(), part.column(1)))
        batch, held = None, []

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate([np.frombuffer(h, _U) for h in held]), return_counts=True)
            found = [(b, batch, tokens[at].tobytes(), counts[at].astype("<u4").tobytes()) for b, at in _dealt(tokens, buckets)]
            made = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(made, names=columns)

        for of, tokens in rows:
            if held and of != batch:
                yield flush()
                held = []
            batch = of
            held.append(tokens.as_py())
        if held:
            yield flush()

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(parts):
            tokens = [np.frombuffer(r[2], _U) for r in rows]
            every, at = np.unique(np.concatenate(tokens), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])).astype(np.int64)
            for (_, batch, _, _), found, mine in zip(rows, tokens, np.split(sums[at], np.cumsum([len(t) for t in tokens])[:-1])):
                shared = mine > 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch]), pa.array([None], pa.int64()), pa.array([0]),
                        pa.array([found[shared].tobytes()], pa.binary()), pa.array([mine[shared].astype("<u4").tobytes()], pa.binary()),
                    ],
                    names=["batch", "key", "n", "tokens", "counts"],
                )

    def sign(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for _, rows in _groups(parts):
            known = [r for r in rows if r[1] is None]
            tokens = np.concatenate([np.frombuffer(r[3], _U) for r in known] or [np.zeros(0, _U)])
            counts = np.concatenate([np.frombuffer(r[4], "<u4") for r in known] or [np.zeros(0, "<u4")]).astype(np.int64)
            tokens, first = np.unique(tokens, return_index=True)
            counts = counts[first]
            made = []
            for _, key, n, found, _ in rows:
                if key is None or not len(tokens):
                    continue
                found = np.frombuffer(found, _U)
                at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                shared = tokens[at] == found
                members, often = found[shared], counts[at[shared]]
                left = int(slack(n, percent)) + 1 - (n - len(members))
                if left <= 0 or not len(members):
                    continue
                rough = np.log2(often).astype(np.int64)
                orders = [np.lexsort((members, often))] + [np.lexsort((_mixed(members, salt), rough)) for salt in (1, 2)]
                made.append((key, n, found.tobytes(), *(_signed(members[o[:left]]) for o in orders)))
            if made:
                columns = [pa.array(c) for c in zip(*made)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "tokens", "p0", "p1", "p2"])

    sent = sets.select("batch", "tokens").mapInArrow(deal, "bucket int, batch long, tokens binary, counts binary")
    back = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        count, "batch long, key long, n long, tokens binary, counts binary"
    )
    rows = sets.select("batch", "key", "n", "tokens", F.lit(None).cast("binary").alias("counts")).unionByName(back)
    return rows.repartition("batch").sortWithinPartitions("batch").mapInArrow(
        sign, "key long, n long, tokens binary, p0 array<long>, p1 array<long>, p2 array<long>"
    )


def groups(signs: DataFrame) -> DataFrame:
    """`group`, `side`, `key`: each set in the groups of its prefix members' hubs, once for each pair of chunks."""
    posts = signs.select(F.explode("p0").alias("t"), "key", "n")
    choice = F.struct(F.xxhash64("key").alias("place"), "key")
    hubs = posts.groupBy("t").agg(F.min(choice).alias("hub"), F.count("*").alias("c")).where("c > 1")
    hubs = written(hubs.select("t", F.col("hub.key").alias("hub")), "hubs")
    members = written(posts.join(hubs, "t").select("hub", "key", "n").distinct(), "members")
    sizes = members.groupBy("hub").agg(F.ceil(F.sum("n") / PER_CHUNK).cast("int").alias("chunks"))
    sizes = written(sizes, "sizes")
    met = members.join(sizes, "hub").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    number = F.xxhash64("hub", F.least("chunk", "other"), F.greatest("chunk", "other"))
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    return met.select(number.alias("group"), side.alias("side"), "key")


class _Flat:
    """Lists of numbers laid end to end, to ask which of them have members in common with one."""

    def __init__(self, lists: list[np.ndarray], values: np.ndarray):
        self.edges = np.cumsum([0] + [len(x) for x in lists])
        self.flat = np.searchsorted(values, np.concatenate(lists))
        self.mark = np.zeros(len(values), bool)

    def common(self, i: int, lo: int, hi: int) -> np.ndarray:
        """How many members list `i` shares with each of the lists from `lo` up to `hi`."""
        mine = self.flat[self.edges[i] : self.edges[i + 1]]
        self.mark[mine] = True
        found = np.add.reduceat(self.mark[self.flat[self.edges[lo] : self.edges[hi]]], self.edges[lo:hi] - self.edges[lo], dtype=np.int64)
        self.mark[mine] = False
        return found

    def common_with(self, i: int, others: np.ndarray) -> np.ndarray:
        if not len(others):
            return others
        mine = self.flat[self.edges[i] : self.edges[i + 1]]
        self.mark[mine] = True
        found = np.array([np.count_nonzero(self.mark[self.flat[self.edges[j] : self.edges[j + 1]]]) for j in others.tolist()])
        self.mark[mine] = False
        return found


def group_links(
    keys: np.ndarray, sides: np.ndarray, tokens: list[np.ndarray], prefixes: list[list[np.ndarray]], percent: int = PERCENT
) -> tuple[list[int], list[int]]:
    """Links that connect the linked sets of a group; only between the sides 1 and 2 where there are sides.

    Candidates of a set have a similar size, are not yet connected to it and
    share a member of every prefix; the others' members are not looked at.
    """
    order = np.argsort([len(t) for t in tokens], kind="stable")
    keys, sides, tokens = keys[order], sides[order], [tokens[i] for i in order]
    n = np.array([len(t) for t in tokens])
    values = np.unique(np.concatenate(tokens))
    whole = _Flat(tokens, values)
    filters = [_Flat([p[i] for i in order], values) for p in prefixes]
    until = np.searchsorted(percent * n, 100 * n, side="right")
    label = np.arange(len(keys))
    a: list[int] = []
    b: list[int] = []
    for i in range(len(keys)):
        lo, hi = i + 1, int(until[i])
        if lo >= hi:
            continue
        open_ = label[lo:hi] != label[i]
        if sides[i]:
            open_ &= sides[lo:hi] != sides[i]
        for f in filters:
            if not open_.any():
                break
            open_ &= f.common(i, lo, hi) > 0
        near = lo + np.flatnonzero(open_)
        common = whole.common_with(i, near)
        linked = near[100 * common >= percent * (n[i] + n[near] - common)]
        # one link to each component that it meets
        found, first = np.unique(label[linked], return_index=True)
        a += [int(keys[i])] * len(found)
        b += keys[linked[first]].tolist()
        if len(found):
            label[np.isin(label, np.append(found, label[i]))] = min(int(found[0]), int(label[i]))
    return a, b


def set_links(signs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect all sets that are linked, directly or through others."""
    met = groups(signs).join(signs.drop("n"), "key").select("group", "side", "key", "tokens", "p0", "p1", "p2")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        number, held = None, []

        def flush() -> pa.RecordBatch | None:
            sides, keys, tokens, *prefixes = zip(*held)
            if len(keys) < 2:
                return None
            links = group_links(np.array(keys), np.array(sides), list(tokens), [list(p) for p in prefixes], percent)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

        for part in parts:
            group, side, key = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i in range(part.num_rows):
                if held and group[i] != number:
                    if found := flush():
                        yield found
                    held = []
                number = group[i]
                lists = [part.column(c)[i].values.to_numpy().view(_U) for c in (4, 5, 6)]
                held.append((int(side[i]), int(key[i]), np.frombuffer(part.column(3)[i].as_py(), _U), *lists))
        if held and (found := flush()):
            yield found

    return met.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def _labelled(docs: DataFrame, rows: DataFrame, least: Column, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """`key`, `label` (a key, the same for all that are connected) and `least` of the rows of each set."""
    keys = written(open_sets(rows, percent), "open")
    sets = written(chosen_sets(docs, rows, keys, size, id_col, text_col), "chosen_sets", TEXT_ROWS)
    signs = written(signatures(sets, percent), "signs")
    labels = connected(written(set_links(signs, percent), "similar", TEXT_ROWS))
    first = written(rows.where("n > 0").groupBy("key").agg(least.alias("least")), "least")
    return first.join(labels, first["key"] == labels["node"], "left").select("key", "least", F.coalesce("label", "key").alias("label"))


def kept_rows(
    docs: DataFrame, among: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Those rows of `among` (`unnamed`, `id`, `mark`) that no smaller one of their group goes with, and all without words.

    A group is a component of the links of `similar_documents` between these rows.
    """
    rows = written(document_sets(docs, size, percent, id_col, text_col), "sets", TEXT_ROWS)
    place = [F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("mark")]
    named = rows.select("doc_id", "n", "key", "smallest", *place).join(among, ["unnamed", "id", "mark"], "left_semi")
    rows = written(named, "among")
    placed = _labelled(docs, rows, F.min(F.struct("unnamed", "id", "mark")), percent, size, id_col, text_col)
    stays = placed.groupBy("label").agg(F.min("least").alias("least")).select("least.*")
    return stays.unionByName(rows.where("n = 0").select("unnamed", "id", "mark").distinct())


def similar_documents(
    docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id`, `n_shingles` (distinct runs of `size` words) and `component_id` of every document.

    Two documents are linked when their sets have `percent` in a hundred of their
    union in common; `component_id` is the smallest id that links lead to, the
    row's own included. A text of fewer words has its whole sequence as its only
    shingle; null texts and texts without words have none and are linked with
    nothing. Exact up to collisions of 64-bit hashes.

    One output row per input row: repeated rows and copies have one set, which is
    compared once. Null ids take part and count as larger than all others (a
    component of null ids alone has none). Texts of any length count whole.
    Other columns are left out; an empty table gives an empty result.
    """
    rows = written(document_sets(docs, size, percent, id_col, text_col), "sets", TEXT_ROWS)
    placed = written(_labelled(docs, rows, F.min("doc_id"), percent, size, id_col, text_col), "placed")
    lowest = written(placed.groupBy("label").agg(F.min("least").alias("component_id")), "lowest")
    component = written(placed.join(lowest, "label").select("key", "component_id"), "component")
    grouped = rows.where("n > 0").join(component, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)
