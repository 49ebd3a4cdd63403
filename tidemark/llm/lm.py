"""LM scoring: Katz backoff over words, from n-grams of any order down to unigrams.

Tokens are words (A-Z lowered), then one end for each document; a document's
first tokens have histories filled up with ``start``. On each level, counts up
to ``K`` are discounted by Good-Turing (from the counts of counts of the
training rows; where those are too sparse for it, by half a count), larger
counts by half a count, so that every history keeps mass for what it has not
seen. Backoff weights normalise exactly: for any history the probabilities of
all known tokens and of one unknown token sum to 1. A document's score is the
sum, over its tokens, of log10 p(token | history), evaluated recursively: the
discounted n-gram if it was seen, else the history's weight (1 if the history
was not seen) times the probability after the history without its oldest token,
down to the discounted unigram.

Plan, all on Spark's shuffles, with numpy inside the tasks:

1. ``unigrams``: one narrow pass, pre-aggregated per task, makes the table of
   training counts, partitioned by hash; its totals, its few hot words (those
   above a partition's share, at most 4 a partition) and its ``COMMON`` most
   frequent ones are known to all tasks afterwards; the latter are shuffled as
   two bytes instead of eight.
2. One pass over all texts shuffles postings to the token's partition, packed as
   arrays for each stretch of about ``STRETCH`` tokens and nested: token, last
   token before it, the one before that and so on, document. Hot tokens are
   spread by the token before. A partition knows all counts of its tokens and of
   the n-grams that end in them, on every level: it emits per-document partial
   sums, partial sums for each history, and the held-out n-grams that were never
   seen.
3. Histories are shuffled by the same rule, by their last token, so that a
   history meets its shorter ones; their backoff weights are computed, and met
   by the unseen n-grams. Hot histories of one token send their weights to all
   instead, as does ``start``.
4. The partial sums are shuffled back to their stretch of documents and added.

Everything between is written to the shared folder, so a lost executor costs
one stage. What reaches the driver: counts of counts, and frequent words.

Edge cases: a null or empty text is its end token alone; null ids train (their
remainder is undefined, so they are not held out) and keep a null id; rows that
repeat are scored, and counted, one by one; without training rows every token
is unknown, with probability 1 (score 0); an empty table gives an empty result;
long texts are read whole; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import written

#: counts that Good-Turing discounts
K = 5
#: tokens of a stretch of documents whose postings are packed together
STRETCH = 1_000_000
#: training tokens of a partition, about
PARTITION = 3_000_000
#: words that tasks know by a number of two bytes, with start
COMMON = 65_535
#: bytes of packed rows that a task takes at once
BATCH = "8m"
END, START = tx.U64(0x6A09E667F3BCC909), tx.U64(0xBB67AE8584CAA73B)

Stretch = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]


def packed(values: np.ndarray) -> bytes:
    """Integers in the least width that holds them, compressed byte by byte of that width; floats and names as they are."""
    kind = values.dtype.kind
    if kind == "f" or values.dtype == tx.U64:
        return kind.encode() + b"\x08" + values.tobytes()
    small = values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values.astype(np.uint8)
    wide = small.dtype.itemsize
    planes = np.ascontiguousarray(small.view(np.uint8).reshape(-1, wide).T)
    return b"z" + bytes([wide]) + len(small).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: memoryview) -> np.ndarray:
    kind, wide = chr(data[0]), data[1]
    if kind != "z":
        return np.frombuffer(data, dtype=np.dtype(f"{kind}8"), offset=2)
    n = int.from_bytes(data[2:10], "little")
    planes = pa.decompress(pa.py_buffer(data[10:]), n * wide, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(wide, n).T).view(f"u{wide}").ravel()


def bundle(*arrays: np.ndarray) -> bytes:
    parts = [packed(x) for x in arrays]
    return np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes() + b"".join(parts)


def unbundle(data: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(data, dtype=np.int64, offset=8, count=int.from_bytes(data[:8], "little"))
    at = np.cumsum([8 + sizes.nbytes, *sizes]).tolist()
    view = memoryview(data)
    return [unpacked(view[i:j]) for i, j in zip(at, at[1:])]


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    """(number, names, document offsets, held-out flags, ids): names hold the documents' words, without ends."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
    tokens, number = 0, 0

    def joined() -> Stretch:
        names = np.concatenate([h[0] for h in held])
        off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[1]) for h in held]))])
        return (TaskContext.get().partitionId() << 24) + number, names, off, np.concatenate([h[2] for h in held]), pa.concat_arrays([h[3] for h in held])

    for part in tx.slices(batches):
        buf, off = tx.flat(part.column(1))
        low = tx.LOWER[buf]
        start, end, at = tx.words(low, off, tx.WORD)
        held.append((tx.word_prints(low, start, end), at, part.column(2).to_numpy(zero_copy_only=False).astype(bool), part.column(0)))
        tokens += len(start) + part.num_rows
        if tokens >= STRETCH:
            yield joined()
            held, tokens, number = [], 0, number + 1
    if held:
        yield joined()


def sequence(names: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's tokens with its end, and the new offsets."""
    out = off + np.arange(len(off))
    tokens = np.empty(len(names) + len(off) - 1, dtype=tx.U64)
    ends = out[1:] - 1
    words = np.ones(len(tokens), dtype=bool)
    words[ends] = False
    tokens[words], tokens[ends] = names, END
    return tokens, out


def discounts(counts: dict[int, int]) -> np.ndarray:
    """Factor for each count 1..K (index 0 unused) from the counts of counts 1..K+1."""
    n = [0, *(counts.get(r, 0) for r in range(1, K + 2))]
    half = np.array([1.0, *((r - 0.5) / r for r in range(1, K + 1))])
    if not all(n[1:]):
        return half
    common = (K + 1) * n[K + 1] / n[1]
    if common >= 1:
        return half
    made = np.array([1.0, *(((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, K + 1))])
    return made if ((made[1:] > 0) & (made[1:] < 1)).all() else half


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The counts after discounting; 0 stays 0."""
    small = counts <= K
    return np.where(small, counts * factors[np.where(small, counts, 0).astype(np.int64)], counts - 0.5)


class Unigrams:
    """Totals, discounts and the most frequent tokens of the training rows."""

    def __init__(self, table: DataFrame) -> None:
        row = table.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct"),
                        *(F.sum((F.col("n") == r).cast("long")).alias(f"n{r}") for r in range(1, K + 2)),
                        F.sum((F.col("n") > K).cast("long")).alias("large")).first()
        self.tokens, self.distinct = row.tokens or 0, row.distinct
        self.parts = max(8, self.tokens // PARTITION)
        counts = {r: row[f"n{r}"] or 0 for r in range(1, K + 2)}
        self.factors = discounts(counts)
        left = sum(counts[r] * r * (1 - self.factors[r]) for r in range(1, K + 1)) + 0.5 * (row.large or 0)
        self.unknown = left / self.tokens if self.tokens else 1.0
        # a token above a quarter of a partition's share: at most 4 a partition
        hot = table.where(F.col("n") > max(1, self.tokens // (4 * self.parts))).orderBy("name").collect() if self.tokens else []
        ends = table.where(F.col("name") == int(END.view(np.int64))).first()
        self.documents = ends.n if ends else 0
        # start is a history of every document
        names = np.array([*(r.name for r in hot), START.view(np.int64)], dtype=np.int64).view(tx.U64)
        order = np.argsort(names)
        self.hot, self.hot_counts = names[order], np.array([*(r.n for r in hot), self.documents], dtype=np.float64)[order]
        # the most frequent words, by size classes of an eighth of a doubling: as many whole classes as hold no more than COMMON
        size, taken, down_to = F.floor(F.log2("n") * 8), 0, None
        for r in table.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
            taken += r["count"]
            if taken >= COMMON:
                break
            down_to = r["size"]
        top = table.where(size >= down_to).collect() if down_to is not None else []
        self.common = np.array([START.view(np.int64), *(r.name for r in sorted(top, key=lambda r: (-r.n, r.name)))], dtype=np.int64).view(tx.U64)
        self.common_order = np.argsort(self.common)

    def is_hot(self, names: np.ndarray) -> np.ndarray:
        return self.hot[np.minimum(np.searchsorted(self.hot, names), len(self.hot) - 1)] == names

    def hot_count(self, names: np.ndarray) -> np.ndarray:
        """Counts of hot names."""
        return self.hot_counts[np.searchsorted(self.hot, names)]

    def coded(self, names: np.ndarray) -> np.ndarray:
        """Numbers of the common names; the others' is one more than the last."""
        at = self.common_order[np.minimum(np.searchsorted(self.common, names, sorter=self.common_order), len(self.common) - 1)]
        return np.where(self.common[at] == names, at, len(self.common)).astype(np.uint16)

    def short(self, names: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Names as their numbers, and the names that have none; ``named`` undoes it."""
        codes = self.coded(names) if codes is None else codes
        return codes, names[codes == len(self.common)]

    def named(self, codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.uint16)
        names = self.common[np.minimum(codes, len(self.common) - 1)]
        names[codes == len(self.common)] = rest
        return names

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.factors) / max(self.tokens, 1), self.unknown)


def unigrams(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, held) -> (name, n): training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, off, held, _ in stretches(batches):
            tokens, off = sequence(names, off)
            names, n = np.unique(tokens[np.repeat(~held, np.diff(off))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["name", "n"])

    return written(rows.mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")), "unigrams")


ROW = "p int, kind string, stretch long, size int, data binary"
FIELDS = [f.split() for f in ROW.split(", ")]
ARROW = pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in FIELDS])


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of batches sorted by the key, one list for each of its values."""
    held: list[dict] = []
    for b in batches:
        for i in range(b.num_rows):
            row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)}
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def by_key(df: DataFrame, parts: int, key: str, run: Callable, schema: str = ROW) -> DataFrame:
    # p is a partition's number already; hashing it would put several in one task and none in others
    dealt = df.repartitionById(parts, key) if key == "p" else df.repartition(parts, key)
    return dealt.sortWithinPartitions(key).mapInArrow(run, schema)


def partition(names: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a name, by its high bits."""
    return ((names >> tx.U64(32)) * tx.U64(parts) >> tx.U64(32)).astype(np.int64)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of start[i], ..., start[i] + count[i] - 1."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def place(known: Unigrams, token: np.ndarray, before: np.ndarray, parts: int) -> np.ndarray:
    """Partition of the n-grams, of two tokens or more, that end in the token: a hot token's are spread by the one before it."""
    return np.where(known.is_hot(token), partition(tx.mix(before), parts), partition(token, parts))


def extended(names: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Names of n-grams with one token more, before the others."""
    return tx.mix(names + tx.mix(before))


def postings(rows: DataFrame, known: Unigrams, parts: int, order: int) -> DataFrame:
    """Packed postings to the token's partition: tokens, the tokens before them level by level, documents, times."""

    def blocks(number: int, names: np.ndarray, off: np.ndarray, held: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        tokens, off = sequence(names, off)
        n_docs = len(off) - 1
        del names
        distinct, levels, counts, doc, times = ordered(tokens, off, order)
        del tokens
        codes = known.coded(distinct)
        token = np.repeat(np.arange(len(counts[0]), dtype=np.int32), counts[0])
        where = place(known, distinct[token], distinct[levels[0]], parts).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        at = np.argsort(where, kind="stable")
        bounds, picked = [np.searchsorted(where[at], np.arange(parts + 1))], [(token[at], None)]
        del token, where
        for m, count in enumerate(counts[1:]):
            picked.append((levels[m][at], count[at]))
            below = np.concatenate([[0], np.cumsum(count[at])])
            bounds.append(below[bounds[-1]])
            at = ranges((np.cumsum(count) - count)[at], count[at])
        del levels, counts, below
        posted, times = (doc << 1 | held[doc])[at], times[at]
        del doc, at
        out = []
        for p in np.flatnonzero(np.diff(bounds[0])):
            words, per = run_lengths(picked[0][0][bounds[0][p]: bounds[0][p + 1]])
            arrays = [*known.short(distinct[words], codes[words]), per]
            for b, (before, per) in zip(bounds, picked[1:]):
                own = before[b[p]: b[p + 1]]
                arrays += [*known.short(distinct[own], codes[own]), per[b[p]: b[p + 1]]]
            s = slice(bounds[-1][p], bounds[-1][p + 1])
            out.append((p, "grams", number, n_docs, bundle(*arrays, posted[s], times[s])))
            if len(out) == 8:
                yield rows_batch(out)
                out = []
        valid = np.asarray(ids.is_valid())
        out.append((number % parts, "rows", number, n_docs, bundle(
            ids.fill_null(0).to_numpy().view(tx.U64), valid.astype(np.uint8), held.astype(np.uint8), np.diff(off))))
        yield rows_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in stretches(batches):
            yield from blocks(*stretch)

    return rows.mapInArrow(run, ROW)


def ordered(tokens: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """The stretch's distinct names (start last); of its distinct n-grams, sorted, level by level the token before (by its
    place among the names) and how many each token or n-gram of the level below has, documents last; documents and times."""
    first, before = numbered(tokens)
    distinct, start = tokens[first], len(first)
    key, size = before, [start]
    distinct = np.append(distinct, START)
    wide, deep = len(distinct).bit_length(), (len(off) - 1).bit_length()
    grams = []
    for m in range(2, order + 1):
        longer = np.empty_like(before)
        longer[1:], longer[off[:-1]] = before[:-1], start
        before = longer
        key = key.astype(tx.U64)
        key <<= tx.U64(wide)
        key |= before.astype(tx.U64)
        if m < order:
            first, own = numbered(key)
            grams.append(key[first])
            key = own
            size.append(len(first))
    assert size[-1].bit_length() + wide + deep <= 64, "a stretch is too long"
    del before, longer
    key <<= tx.U64(deep)
    key |= tx.owner(off).astype(tx.U64)
    key.sort()
    key, times = run_lengths(key)
    doc = (key & tx.U64((1 << deep) - 1)).astype(np.int32)
    key >>= tx.U64(deep)
    gram, last = run_lengths(key)
    grams.append(gram)
    counts = [np.bincount((g >> tx.U64(wide)).astype(np.int64), minlength=n) for g, n in zip(grams, size)]
    return distinct, [(g & tx.U64((1 << wide) - 1)).astype(np.int32) for g in grams], [*counts, last], doc, times.astype(np.int32)


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal neighbours: their values and lengths."""
    if not len(values):
        return values, np.empty(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.diff(np.append(at, len(values)))


def counted(known: Unigrams, parts: int, order: int) -> Callable:
    """Task of a token partition: from postings to partial sums (kinds docs, histories, unseen, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "p"):
            through = [tuple(r.values()) for r in group if r["kind"] == "rows"]
            if through:
                yield rows_batch(through)
            # one order of adding, whatever the shuffle's
            blocks = sorted((r for r in group if r["kind"] == "grams"), key=lambda r: r["stretch"])
            del group
            if blocks:
                yield from count(blocks, known, parts, order)

    return run


class Grams:
    """The distinct n-grams of a partition on each level (0: tokens), their training counts, and the blocks' postings."""

    def __init__(self, blocks: list[dict], known: Unigrams, order: int) -> None:
        parts = [unbundle(b["data"]) for b in blocks]
        blocks.clear()
        self.postings = [(p[-2], p[-1], int(p[-3].sum(dtype=np.int64)), p[-3]) for p in parts]
        joined = [known.named(*(np.concatenate([p[3 * m + k] for p in parts]) for k in (0, 1))) for m in range(order)]
        per = [np.concatenate([p[3 * m + 2] for p in parts]) for m in range(order - 1)]
        del parts
        self.words, at = np.unique(joined[0], return_inverse=True)
        name, at = joined[0], at.astype(np.int32)
        #: of each level's n-grams above the tokens: the token before, the n-gram of the level below
        self.before: list[np.ndarray] = [self.words]
        self.below: list[np.ndarray] = [np.arange(len(self.words), dtype=np.int32)]
        joined[0] = None
        for m in range(1, order):
            name, at = np.repeat(name, per[m - 1]), np.repeat(at, per[m - 1])
            for s in pieces(len(name)):
                name[s] = extended(name[s], joined[m][s])
            first, own = numbered(name)
            self.before.append(joined[m][first])
            self.below.append(at[first])
            joined[m], at = None, own
        self.top = at
        del name
        trained = np.zeros(len(self.below[-1]))
        for gram, doc, times in self.posted():
            trained += np.bincount(gram, weights=times * (doc & 1 == 0), minlength=len(trained))
        self.counts: list[np.ndarray] = [least(trained)]
        for m in range(order - 1, 0, -1):
            trained = np.bincount(self.below[m], weights=trained, minlength=len(self.below[m - 1]))
            if m == 1:
                hot = known.is_hot(self.words)
                trained[hot] = known.hot_count(self.words[hot])
            self.counts.insert(0, least(trained))

    def posted(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each block's postings: the n-gram's number, the document with its held-out bit, the times."""
        at = 0
        for doc, times, _, per in self.postings:
            yield np.repeat(self.top[at: at + len(per)], per), doc, times
            at += len(per)

    def under(self, m: int, own: np.ndarray | slice) -> list[np.ndarray]:
        """Of level m's n-grams of these numbers: the numbers on the levels 0..m."""
        chain = [own]
        for level in range(m, 0, -1):
            chain.append(self.below[level][chain[-1]])
        return chain[::-1]

    def history(self, m: int, own: np.ndarray) -> list[np.ndarray]:
        """Their histories' tokens, the last one first."""
        return [self.before[k][at] for k, at in enumerate(self.under(m, own)) if k]


def pieces(n: int) -> Iterator[slice]:
    """0..n in short slices, for work that needs several copies."""
    return (slice(i, i + (1 << 18)) for i in range(0, n, 1 << 18))


def numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct name, and the number of every name among them."""
    order = np.argsort(names)
    new = np.ones(len(names), dtype=bool)
    made = names[order]
    new[1:] = made[1:] != made[:-1]
    del made
    own = np.empty(len(names), dtype=np.int32)
    own[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], own


def least(counts: np.ndarray) -> np.ndarray:
    """Whole numbers in the least width that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def count(blocks: list[dict], known: Unigrams, parts: int, order: int) -> Iterator[pa.RecordBatch]:
    stretch_of = [(b["stretch"], b["size"]) for b in blocks]
    grams = Grams(blocks, known, order)
    counts = grams.counts
    prob = known.probability(counts[0])
    log_prob = np.log10(prob, where=prob > 0, out=np.zeros(len(prob)))

    # of each n-gram: the longest end of it that was seen (0: its token at most) and that one's count
    level, seen = np.zeros(len(counts[0]), dtype=np.int8), np.zeros(len(counts[0]), dtype=np.uint8)
    for m in range(1, order):
        own = counts[m] > 0
        level, seen = np.where(own, np.int8(m), level[grams.below[m]]), np.where(own, counts[m], seen[grams.below[m]])
    del own
    word = grams.under(order - 1, slice(None))[0]

    # document sums; the counts up to K wait for their discounts
    fixed = log_prob[word]
    fixed[level > 0] = 0.0
    large = seen > K
    fixed[large] += np.log10(seen[large] - 0.5)
    small = np.where((level > 0) & ~large, (level.astype(np.int16) - 1) * K + np.minimum(seen, K), 0).astype(np.int16)
    del seen, large
    shorter = counts[-2].astype(np.float64)  # as histories of what follows
    as_history = np.log10(shorter, where=shorter > 0, out=np.zeros(len(shorter)))[grams.below[-1]]
    as_history[grams.words[word] == END] = 0.0
    fixed -= as_history
    del shorter, as_history
    missed = counts[-1] == 0
    none = np.flatnonzero(missed).astype(np.int32)
    last = grams.before[1][grams.under(order - 1, none)[1]]
    is_hot = known.is_hot(last)
    if order > 2 and known.documents:  # a hot history's count where the recursion comes down to it; start's on all levels but the top
        down = np.flatnonzero(is_hot & (level[none] <= 1))
        fixed[none[down]] -= np.log10(known.hot_count(last[down])) * np.where(last[down] == START, order - 2, 1)
    base, is_known = np.log10(counts[0] + 1.0), counts[0] > 0
    classes = (order - 1) * K + 1
    out, unseen = [], []
    for (stretch, size), (own, doc, times) in zip(stretch_of, grams.posted()):
        doc = doc >> 1
        flag = np.zeros(size, dtype=bool)
        flag[doc] = True
        here = np.flatnonzero(flag)
        local = (np.cumsum(flag) - 1)[doc]
        total = lambda weights: np.bincount(local, weights=times * weights, minlength=len(here))
        per_class = np.bincount(local * classes + small[own], weights=times, minlength=len(here) * classes).reshape(-1, classes)[:, 1:]
        words = word[own]
        out.append((-1, "docs", stretch, size, bundle(np.diff(here, prepend=0), total(is_known[words]).astype(np.int64), per_class.T.ravel().astype(np.int64),
                                                      total(base[words]), total(fixed[own]))))
        if len(out) == 16:
            yield rows_batch(out)
            out = []
        at = np.flatnonzero(missed[own])
        unseen.append((own[at], doc[at].astype(np.int32), times[at].astype(np.int32)))
    counts_of = [np.bincount(c[(c > 0) & (c <= K + 1)].astype(np.int64), minlength=K + 2) for c in counts[1:]]
    out.append((-1, "counts", -1, 0, np.concatenate(counts_of).astype(np.int64).tobytes()))
    yield rows_batch(out)
    del base, is_known, fixed, small, word
    grams.postings, grams.top = [], None

    # n-grams of held-out rows that were never seen: to their histories; start, and a hot history of one token, are added at their stretch
    stretch = np.repeat(np.array([s for s, _ in stretch_of]), [len(u[0]) for u in unseen])
    own, doc, times = (np.concatenate(x) for x in zip(*unseen))
    del unseen
    at, level = np.searchsorted(none, own), level[own].astype(np.uint8)
    last, is_hot = last[at], is_hot[at]
    del none, missed, at
    often = np.flatnonzero(is_hot & (level == 0))
    out = []
    for s, i, j in spans(stretch[often]):
        k = often[i:j]
        out.append((-1, "unseen-often", s, 0, bundle(*known.short(last[k]), doc[k], times[k])))
    routed = np.flatnonzero((last != START) if order > 2 else ~is_hot)
    del last, is_hot
    for q, o in dealt(grams, order - 1, own[routed], known, parts):
        r = routed[o]
        values, n = run_lengths(stretch[r])
        out.append((q, "unseen", -1, 0, bundle(values.astype(tx.U64), n, doc[r], times[r], level[r],
                                               *(x for t in grams.history(order - 1, own[r]) for x in known.short(t)))))
        if len(out) == 16:
            yield rows_batch(out)
            out = []
    del own, doc, times, stretch, routed, level

    # partial sums of the histories
    for m in range(1, order):
        trained = np.flatnonzero(counts[m] > 0).astype(np.int32)
        for q, o in dealt(grams, m, trained, known, parts):
            own = trained[o]
            tokens = grams.history(m, own)
            o = np.lexsort(tokens[::-1])
            own, tokens = own[o], [t[o] for t in tokens]
            first = np.flatnonzero(np.concatenate([[True], np.any([t[1:] != t[:-1] for t in tokens], axis=0)]))
            sums = [x for c in (counts[m][own], counts[m - 1][grams.below[m][own]])
                    for x in tallied(c.astype(np.int64), first)]
            lasts, per = run_lengths(tokens[0][first])
            out.append((q, "histories", -1, m, bundle(np.concatenate(sums), *known.short(lasts), per,
                                                      *(x for t in tokens[1:] for x in known.short(t[first])))))
            if len(out) == 16:
                yield rows_batch(out)
                out = []
    if out:
        yield rows_batch(out)


def dealt(grams: Grams, m: int, own: np.ndarray, known: Unigrams, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Level m's n-grams of these numbers by the partition of their histories: which of them, in order."""
    if not len(own):
        return
    where = np.empty(len(own), dtype=np.uint16 if parts <= 1 << 16 else np.int64)
    for s in pieces(len(own)):
        tokens = grams.history(m, own[s])
        where[s] = place(known, tokens[0], tokens[1], parts) if m > 1 else partition(tokens[0], parts)
    order = np.argsort(where, kind="stable").astype(np.int32)
    for q, i, j in spans(where[order]):
        yield q, order[i:j]


def tallied(counts: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each run of counts, by its start: how many are 1, ..., K, larger, and the larger ones' sum."""
    large = counts > K
    return [np.add.reduceat(x, first) for x in (*((counts == r).astype(np.int64) for r in range(1, K + 1)),
                                               large.astype(np.int64), np.where(large, counts, 0))]


def spans(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal neighbours."""
    runs, n = run_lengths(values)
    end = np.cumsum(n)
    yield from zip(runs.tolist(), (end - n).tolist(), end.tolist())


def weights(factors: list[np.ndarray], known: Unigrams, order: int) -> Callable:
    """Task of a history partition: backoff weights, and the unseen n-grams' corrections (kinds add, often)."""

    def history(r: dict) -> tuple[np.ndarray, ...]:
        """Of a row's histories: name, last token, the next shorter one's name, count, mass left to the unseen, mass of the seen one level below."""
        m, (sums, codes, rest, per, *more) = r["size"], unbundle(r["data"])
        name = last = shorter = np.repeat(known.named(codes, rest), per)
        for k in range(m - 1):
            name, shorter = extended(name, known.named(*more[2 * k: 2 * k + 2])), name
        own, below = sums.reshape(2, K + 2, len(last))
        whole = np.arange(1, K + 1)
        left = (whole * (1 - factors[m][1:])) @ own[:K] + 0.5 * own[K]
        covered = (whole * factors[m - 1][1:]) @ below[:K] + below[K + 1] - 0.5 * below[K]
        return name, last, shorter, whole @ own[:K] + own[K + 1], left, covered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "p"):
            group.sort(key=lambda r: (r["kind"], r["size"], r["data"]))  # one order of adding, whatever the shuffle's
            names: list[np.ndarray] = []
            tokens: list[np.ndarray] = []
            correction: list[np.ndarray] = []
            out = []
            for m in range(1, order):
                made = [history(r) for r in group if r["kind"] == "histories" and r["size"] == m]
                if not made:
                    names += [np.empty(0, dtype=tx.U64)]
                    tokens += [np.empty(0)]
                    correction += [np.empty(0)]
                    continue
                columns = [list(c) for c in zip(*made)]
                del made
                taken = lambda: np.concatenate(columns.pop(0))
                own_names = taken()
                first, own = numbered(own_names)
                own_names, last, shorter = own_names[first], taken()[first], taken()[first]
                total, left, covered = (np.bincount(own, weights=taken()) for _ in range(3))
                del first, own
                of = max(known.tokens, 1)  # what the covered mass is a part of: all tokens, or the shorter history's count
                if m > 1:
                    of = np.empty(len(last))
                    hot = known.is_hot(last) if m == 2 else np.zeros(len(last), dtype=bool)
                    of[hot] = known.hot_count(last[hot])
                    of[~hot] = tokens[-1][np.searchsorted(names[-1], shorter[~hot])]
                # log10 of the weight, and of the history's count that is subtracted apart from it
                correction.append(np.log10(left / np.maximum((of - covered) / of, 1e-300)))
                names.append(own_names)
                tokens.append(total)
                often = np.flatnonzero(known.is_hot(last) if m == 1 else last == START)
                if len(often):
                    out.append((-1, "often", -1, 0, bundle(last[often], correction[-1][often])))
            unseen = [unbundle(r["data"]) for r in group if r["kind"] == "unseen"]
            del group
            if unseen:
                out += added(unseen, names, tokens, correction)
            for i in range(0, len(out), 64):
                yield rows_batch(out[i: i + 64])

    def added(unseen: list[list[np.ndarray]], names: list[np.ndarray], tokens: list[np.ndarray], correction: list[np.ndarray]) -> list[tuple]:
        stretch = np.repeat(np.concatenate([u[0] for u in unseen]), np.concatenate([u[1] for u in unseen]))
        doc, times, level = (np.concatenate([u[k] for u in unseen]) for k in (2, 3, 4))
        add = np.zeros(len(doc))
        history = None
        for m in range(1, order):
            before = known.named(*(np.concatenate([u[3 + 2 * m + k] for u in unseen]) for k in (0, 1)))
            history = before if m == 1 else extended(history, before)
            if not len(names[m - 1]):
                continue
            at = np.minimum(np.searchsorted(names[m - 1], history), len(names[m - 1]) - 1)
            found = names[m - 1][at] == history
            if m == 1:
                found &= ~known.is_hot(history)
            add += np.where(found & (level < m), correction[m - 1][at], 0.0)
            if m < order - 1:  # the top level's counts are in the document sums
                add -= np.where(found & (level <= m), np.log10(tokens[m - 1])[at], 0.0)
        stretches, at = np.unique(stretch, return_inverse=True)
        deep = tx.U64(int(doc.max()).bit_length())
        key, own = np.unique(at.astype(tx.U64) << deep | doc.astype(tx.U64), return_inverse=True)
        sums = np.bincount(own, weights=add * times)
        doc = (key & ((tx.U64(1) << deep) - tx.U64(1))).astype(np.int64)
        return [(-1, "add", int(stretches[s]), 0, bundle(doc[i:j], sums[i:j])) for s, i, j in spans((key >> deep).astype(np.int64))]

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finished(factors: list[np.ndarray], known: Unigrams, often: dict[int, float], order: int) -> Callable:
    """Task of a stretch: adds the partial sums of its documents."""
    log_small = np.concatenate([np.log10(np.arange(1, K + 1) * f[1:]) for f in factors[1:]])
    often_names = np.array(sorted(often), dtype=tx.U64)
    often_logs = np.array([often[n] for n in sorted(often)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "stretch"):
            head = next(r for r in group if r["kind"] == "rows")
            n = head["size"]
            ids, valid, held, length = unbundle(head["data"])
            length = length.astype(np.int64)
            n_known, base, score = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
            for r in sorted(group, key=lambda r: (r["kind"], r["data"])):  # one order of adding, whatever the shuffle's
                if r["kind"] == "docs":
                    skip, own_known, small, own_base, own_score = unbundle(r["data"])
                    here = np.cumsum(skip, dtype=np.int64)
                    n_known[here] += own_known.astype(np.int64)
                    base[here] += own_base
                    score[here] += own_score + log_small @ small.reshape(len(log_small), -1)
                elif r["kind"] == "add":
                    doc, own_score = unbundle(r["data"])
                    score[doc] += own_score
                elif r["kind"] == "unseen-often" and len(often_names):
                    codes, rest, doc, times = unbundle(r["data"])
                    hs = known.named(codes, rest)
                    place = np.minimum(np.searchsorted(often_names, hs), len(often_names) - 1)
                    score += np.bincount(doc, weights=np.where(often_names[place] == hs, often_logs[place], 0.0) * times, minlength=n)
            if known.documents:
                score -= np.log10(known.documents)  # every first token's history is start
            base -= length * np.log10(known.tokens + known.distinct + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.view(np.int64), mask=valid == 0), pa.array(held == 1), pa.array(length), pa.array(n_known),
                 pa.array(np.full(n, known.tokens, dtype=np.int64)), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def katz_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text",
                order: int = 2) -> DataFrame:
    """Scores of all documents by a model, of n-grams of up to ``order`` words, of those whose crc32(id) mod ``modulus`` is not ``remainder``."""
    if order < 2:
        raise ValueError("order is 2 at least")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held"))
    known = Unigrams(unigrams(rows))
    parts = known.parts
    sums = written(by_key(postings(rows, known, parts, order), parts, "p", counted(known, parts, order)), "lm-sums", by="kind", arrow_bytes=BATCH)
    tallies = sum((np.frombuffer(r.data, dtype=np.int64).reshape(order - 1, K + 2) for r in sums.where("kind = 'counts'").select("data").toLocalIterator()),
                  np.zeros((order - 1, K + 2), dtype=np.int64))
    factors = [known.factors, *(discounts({r: int(level[r]) for r in range(1, K + 2)}) for level in tallies)]
    more = written(by_key(sums.where("kind in ('histories', 'unseen')").select(*(n for n, _ in FIELDS)), parts, "p", weights(factors, known, order)),
                   "lm-weights", by="kind", arrow_bytes=BATCH)
    often: dict[int, float] = {}
    for r in more.where("kind = 'often'").select("data").collect():  # hot histories, at most 4 a partition; start's on every level
        for name, log in zip(*(x.tolist() for x in unbundle(r.data))):
            often[name] = often.get(name, 0.0) + log
    columns = [n for n, _ in FIELDS]
    last = sums.where("kind in ('rows', 'docs', 'unseen-often')").select(*columns).unionByName(more.where("kind = 'add'").select(*columns))
    return by_key(last, parts, "stretch", finished(factors, known, often, order), SCHEMA)
