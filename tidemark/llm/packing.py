"""Best-fit packing of documents into sequences of a fixed token length.

Best-fit decreasing: pieces are placed from the longest to the shortest, each
into the open bin with the least room that still takes it. A segment tree over
the remaining capacities (0 to the sequence length) finds that bin's capacity
in logarithmic time.

Pieces of one length are interchangeable, so the packing is decided on the
histogram of piece lengths alone, which has at most ``capacity`` rows however
large the corpus: equal bins are held as ranges of bin numbers, and one step
of the plan places a whole run of equal pieces. This is the same packing, up
to ties, that placing the pieces one by one gives (see the tests). The plan's
size depends on the number of distinct lengths, not on the documents.

On the cluster: one narrow pass tokenises whole texts into piece rows (written
to the shared folder), one aggregation makes the histogram, and one window
numbers the pieces of each length. A length that many documents share (groups
of copies, or one row repeated) is salted by the row's number: pieces are
numbered inside (length, salt) and the salts' offsets come from their counts. Every task then looks up its pieces' steps.

Edge cases: a null or empty text is one piece holding only the end id; a text
longer than the capacity is cut into full pieces with the shorter one first; a
special token's string in a text is that token, as the tokenizer reads it;
repeated rows are packed as often as they occur; a null id is kept; columns
other than id and text are not read; an empty table packs into nothing.
"""
from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from .store import written

CAPACITY = 2048
END_ID = 0
#: white space characters in a row beyond which the faster engine is not used
MAX_SPACES = 1_000

_encoders: dict[str, Callable[[list[str]], list[list[int]]]] = {}
_long_space = re.compile(r"\s{%d}" % MAX_SPACES)


def byte_ranks(path: str) -> tuple[dict[bytes, int], str] | None:
    """Vocabulary of a byte-level BPE file as byte strings with their ids, and
    the split pattern, if the ids from 256 on follow the order of its merges:
    then a rank-based engine gives the same ids. Else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if (spec["normalizer"], pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != (None, "ByteLevel", False, True) or any(
            model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or any(
            t[side] for t in spec["added_tokens"] for side in ("lstrip", "rstrip", "single_word")):
        return None
    # the byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for U+0100 on
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}, BYTE_LEVEL


def added_tokens(path: str) -> dict[str, int]:
    """Strings that the file takes for tokens of their own, longest first."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return {t["content"]: t["id"] for t in sorted(added, key=lambda t: -len(t["content"]))}


#: the split pattern of byte-level pre-tokenizers (a fixed value)
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Texts to the ids that the file's own engine gives, special tokens' strings
    being those tokens. The rank-based engine takes a quarter of the time: a text
    is cut at special strings, and what is between them goes through it. Texts
    with very long white space, on which its pattern engine fails, and other
    files take the file's own one."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        own = Tokenizer.from_file(path)
        ranks = byte_ranks(path)
        if ranks:
            import tiktoken
            fast = tiktoken.Encoding("file", pat_str=ranks[1], mergeable_ranks=ranks[0], special_tokens={})
            special = added_tokens(path)
            cuts = re.compile("|".join(f"({re.escape(s)})" for s in special)) if special else None

        def between(text: str) -> list[int]:
            out, at = [], 0
            for m in cuts.finditer(text):
                out += [*fast.encode_ordinary(text[at:m.start()]), special[m.group()]]
                at = m.end()
            return out + fast.encode_ordinary(text[at:])

        def run(texts: list[str]) -> list[list[int]]:
            return [own.encode_batch_fast([t], add_special_tokens=False)[0].ids if not ranks or _long_space.search(t)
                    else between(t) if cuts and cuts.search(t) else fast.encode_ordinary(t) for t in texts]

        _encoders[path] = run
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """A row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            rows: list[tuple] = []
            texts = part.column(1).fill_null("").to_pylist()
            for doc, found in zip(part.column(0).to_pylist(), encoder(tokenizer)(texts)):
                ids = np.array([*found, END_ID], dtype="<u4")
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                for n, end in enumerate(ends):
                    start = max(0, end - capacity) if n else 0
                    rows.append((doc, n, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class Capacities:
    """Segment tree over 0..capacity: which remaining capacities have open bins."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.any = [False] * (2 * self.leaves)

    def put(self, capacity: int, filled: bool) -> None:
        at = capacity + self.leaves
        self.any[at] = filled
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least this length that has an open bin."""
        at = length + self.leaves
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over (length -> pieces). Steps (length, first piece,
    first bin, pieces in a bin, place in the bin): piece number r of that length
    goes to bin ``first bin + (r - first piece) // pieces in a bin``."""
    tree, open_bins, steps, bins = Capacities(capacity), {}, [], 0

    def add(left: int, first: int, count: int) -> None:
        open_bins.setdefault(left, []).append((first, count))
        tree.put(left, True)

    for length in sorted(histogram, reverse=True):
        at, n = 0, histogram[length]
        while at < n:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                count = -(-(n - at) // each)
                add(capacity, bins, count)
                bins += count
                continue
            first, count = open_bins[room].pop()
            if not open_bins[room]:
                tree.put(room, False)
            # the bin just used is the tightest for the next equal piece too, while it has room
            each = room // length
            full = min(count, (n - at) // each)
            if full:
                steps.append((length, at, first, each, capacity - room))
                add(room - each * length, first, full)
                at += full * each
            rest = n - at
            if full < count and rest and rest < each:
                steps.append((length, at, first + full, rest, capacity - room))
                add(room - rest * length, first + full, 1)
                at, full = n, full + 1
            if full < count:
                add(room, first + full, count - full)
    return steps


def numbered(found: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, ... among the pieces of each length; ``row`` numbers the rows, with gaps."""
    salts = 1 + math.isqrt(total)  # as many pieces of one length in a group as groups, at most
    salted = found.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = W.partitionBy("length", "salt").orderBy("row")
    return (salted.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["length", "salt"])
            .withColumn("rank", F.col("before") + F.col("r")).drop("salt", "r", "before"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **names: str) -> DataFrame:
    """Each piece's row with its ``sequence_id`` and ``offset``."""
    found = written(pieces(docs, tokenizer, capacity, **names).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    steps = sorted(plan(histogram, capacity))
    table = np.array(steps, dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            step = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            after = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(step[:, 2] + after // step[:, 3]), pa.array(step[:, 4] + after % step[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return (numbered(found, sum(histogram.values())).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
            .mapInArrow(place, PIECES + ", sequence_id long, offset long"))
