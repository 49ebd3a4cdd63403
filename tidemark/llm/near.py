"""N-gram Jaccard join: MinHash banding, verified on the full n-gram sets.

Two documents are linked if the Jaccard similarity of their sets of word
5-shingles is 0.8 or more. Documents with the same set form one copy class and
are handled as one. ``BANDS`` bands of ``ROWS`` MinHash values are chosen for
recall (a pair at 0.8 shares a band with probability 1 - (1 - 0.8**8)**40 >
0.999) and against chance (at 0.4: 0.03). The classes are shuffled on their
band hashes; the members of a bucket are tied to its least member (a row each,
never the pairs), and the components of these ties are the groups in which
pairs are looked for. Within a group, every pair is verified on the full sets:
a group is split into blocks of ``BLOCK`` classes, a pair of blocks is one
task's matrix product, and what leaves the task is each class's number of
linked documents and a spanning forest of the links, so rows grow with the
members and not with the pairs. Components of the verified links are the
groups of near duplicates.

Result: a row for each document with its group's least doc_id and its number of
linked documents (copies count). Links between different texts are all found
inside a group; copies are counted without being expanded.

Edge cases: null and empty texts have no shingles and no links; a text of one
to four words has one shingle, all its words, so only copies of it link; rows
that repeat are copies of each other; null ids are kept (a group of null ids
only has a null id); texts are read whole; an empty table gives an empty
result; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .store import written

SHINGLE = 5
BANDS, ROWS = 40, 8
#: classes in a block of the verification
BLOCK = 512
#: columns of the matrices multiplied at once
COLUMNS = 4096

_SEEDS = tx.mix(np.arange(1, BANDS * ROWS + 1, dtype=tx.U64) * tx.U64(0x9E3779B97F4A7C15))
_ADD, _TIMES = (_SEEDS >> tx.U64(32)).astype(np.uint32), _SEEDS.astype(np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles, sorted, and their offsets."""
    buf, off = tx.flat(column)
    start, end, at = tx.words(buf, off, tx.WORD)
    words = tx.word_prints(buf, start, end)
    names, sat = tx.shingles(words, at, SHINGLE)
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < SHINGLE))
    own = tx.owner(sat)
    if len(short):
        names = np.concatenate([names, tx.Prints(words, 1).of(at[short], at[short + 1])])
        own = np.concatenate([own, short])
    order = np.lexsort((names, own))
    names, own = names[order], own[order]
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (own[1:] != own[:-1])
    return names[new], np.searchsorted(own[new], np.arange(len(off)))


def band_hashes(names: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents with shingles) x BANDS."""
    some = off[:-1][np.diff(off) > 0]
    x = (names >> tx.U64(32)).astype(np.uint32)
    out = np.zeros((len(some), BANDS), dtype=tx.U64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((x ^ _ADD[k]) * _TIMES[k], some)
        band = k // ROWS
        out[:, band] = tx.mix(out[:, band] + least.astype(tx.U64) + tx.U64(band + 1))
    return out


def set_id(names: np.ndarray) -> bytes:
    return hashlib.blake2b(names.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tx.slices(batches):
        names, off = shingle_sets(part.column(1))
        some = np.diff(off) > 0
        bands = iter(band_hashes(names, off).view(np.int64).tolist()) if some.any() else iter(())
        ids = [set_id(names[i:j]) if j > i else None for i, j in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays(
            [part.column(0).cast(pa.int64()), pa.array(ids, type=pa.binary()),
             pa.array([next(bands) if s else None for s in some], type=pa.list_(pa.int64())), part.column(2)], names=["doc_id", "sid", "bands", "print"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, sid, grp) -> (sid, grp, names) of the rows whose text has that set, once a task."""
    done: set[bytes] = set()
    for part in tx.slices(batches):
        part = part.filter(pa.array([want not in done for want in part.column(2).to_pylist()], type=pa.bool_()))
        names, off = shingle_sets(part.column(1))
        keep = []
        for k, want in enumerate(part.column(2).to_pylist()):
            if want not in done and set_id(names[off[k]: off[k + 1]]) == want:
                done.add(want)
                keep.append(k)
        yield pa.RecordBatch.from_arrays(
            [part.column(2).take(pa.array(keep, type=pa.int64())), part.column(3).take(pa.array(keep, type=pa.int64())),
             pa.array([names[off[k]: off[k + 1]].view(np.int64) for k in keep], type=pa.list_(pa.int64()))], names=["sid", "grp", "names"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the sets' pairwise intersections."""
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    every = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    useful = count > 1
    number = np.cumsum(useful) - 1
    keep = useful[column]
    column, own = number[column[keep]], own[keep]
    order = np.argsort(column, kind="stable")
    column, own = column[order], own[order]
    for lo in range(0, int(useful.sum()), COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        m[own[i:j], column[i:j] - lo] = 1
        out += m @ m.T
    out[np.diag_indices(len(sets))] = [len(s) for s in sets]
    return out


def linked(sets: list[np.ndarray], sides: np.ndarray, within: bool) -> np.ndarray:
    """Boolean matrix: J >= 0.8 and the pair is this task's (across the two sides unless within one block)."""
    shared = _shared(sets)
    size = np.diag(shared)
    similar = 9 * shared >= 4 * (size[:, None] + size[None, :])  # s / (a + b - s) >= 4 / 5 in whole numbers
    if not within:
        similar &= sides[:, None] != sides[None, :]
    similar[np.diag_indices(len(sets))] = False
    return similar


def forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph, by breadth."""
    left = np.ones(len(similar), dtype=bool)
    edges = []
    for root in range(len(similar)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            reach = np.flatnonzero(similar[u] & left)
            left[reach] = False
            edges += [(u, int(v)) for v in reach]
            queue += reach.tolist()
    return edges


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, i, j, side, sid, copies, names) sorted by (grp, i, j) -> (sid, links, other): links of each class
    found in this pair of blocks, and the forest's edges (links 0)."""
    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            sets = [np.array(r[6], dtype=np.int64) for r in rows]
            copies = np.array([r[5] for r in rows])
            similar = linked(sets, np.array([r[3] for r in rows]), rows[0][1] == rows[0][2])
            links = similar @ copies
            edges = forest(similar)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[k][4] for k in some] + [rows[u][4] for u, _ in edges], type=pa.binary()),
                 pa.array([int(links[k]) for k in some] + [0] * len(edges), type=pa.int64()),
                 pa.array([None] * len(some) + [rows[v][4] for _, v in edges], type=pa.binary())], names=["sid", "links", "other"])

    held: list[tuple] = []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns[:6]]
        names = b.column(6)
        for k, key in enumerate(zip(*cols)):
            if held and held[0][:3] != key[:3]:
                yield from flush(held)
                held = []
            held.append((*key, names[k].values.to_numpy()))
    yield from flush(held)


def _representatives(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, sid, grp): the rows with a class's least id and that row's text hash; rows of one id meet
    their own class only."""
    printed = texts.select("doc_id", "text", F.xxhash64("text").alias("tprint"))
    return (printed.join(wanted, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("tprint") == F.col("print")))
            .select("doc_id", "text", "sid", "grp"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, print, sid) of each row, and (sid, root, class_id, n_links) of each copy class."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(texts.select("doc_id", "text", F.xxhash64("text").alias("print"))
                     .mapInArrow(_signatures, "doc_id long, sid binary, bands array<long>, print long"), "signatures")
    classes = (signed.where("sid is not null").groupBy("sid")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first"),
                    F.count("*").alias("copies"), F.first("bands").alias("bands"))
               .select("sid", F.col("first.doc_id").alias("least"), F.col("first.print").alias("print"), "copies", "bands"))
    classes = written(classes, "classes")

    # buckets of two classes or more: each member is tied to the least
    rows = classes.select("sid", F.posexplode("bands").alias("band", "hash"))
    buckets = rows.groupBy("band", "hash").agg(F.min("sid").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = rows.join(buckets, ["band", "hash"]).select(F.col("sid").alias("u"), F.col("leader").alias("v"))
    groups = written(components(ties, "groups").select(F.col("node").alias("sid"), F.col("root").alias("grp")), "groups")

    # every pair within a group, block by block
    blocks = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    members = (groups.join(classes.select("sid", "least", "print", "copies"), "sid").join(blocks, "grp"))
    sets = (_representatives(texts, members.select("least", "print", "sid", "grp"))
            .mapInArrow(_sets, "sid binary, grp binary, names array<long>")
            .groupBy("sid").agg(F.first("names").alias("names")))
    block = F.pmod(F.xxhash64("sid"), F.col("n")).cast("int")
    paired = (members.select("sid", "grp", "copies", "n").join(sets, "sid").withColumn("own", block)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
              .select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      F.col("own").alias("side"), "sid", "copies", "names"))
    found = written(paired.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
                    .mapInArrow(_verify, "sid binary, links long, other binary"), "links")

    links = found.where("links > 0").groupBy("sid").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("sid").alias("u"), F.col("other").alias("v")), "classes")
    per_class = (classes.select("sid", "least", "copies").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
                 .withColumn("root", F.coalesce("root", "sid")).join(links, "sid", "left"))
    heads = per_class.groupBy("root").agg(F.min("least").alias("class_id"))
    answer = per_class.join(heads, "root").select("sid", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "print", "sid"), answer


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) for each document."""
    signed, answer = _classes(docs, id_col, text_col)
    return (signed.join(answer, "sid", "left")
            .select("doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, one of each group of near duplicates: that of the least id (null last),
    then of the least text hash. Rows without shingles all stay."""
    signed, answer = _classes(docs, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first")
    grouped = signed.join(answer.select("sid", "root"), "sid")
    kept = grouped.groupBy("root").agg(first).select(F.col("first.doc_id").alias("kid"), F.col("first.print").alias("kprint"))
    none = signed.where("sid is null").select(F.col("doc_id").alias("kid"), F.col("print").alias("kprint")).distinct()
    # a kept row that repeats is in the table several times; only those go through a second shuffle
    times = signed.where("sid is not null").groupBy(F.col("doc_id").alias("kid"), F.col("print").alias("kprint")).agg((F.count("*") > 1).alias("repeats"))
    k, t = kept.alias("k"), times.alias("t")
    keys = (k.join(t, F.col("k.kid").eqNullSafe(F.col("t.kid")) & (F.col("k.kprint") == F.col("t.kprint"))).select("k.kid", "k.kprint", "t.repeats")
            .unionByName(none.withColumn("repeats", F.lit(False))))
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("did"), F.xxhash64(text_col).alias("dprint"))
    found = rows.join(keys, F.col("did").eqNullSafe(F.col("kid")) & (F.col("dprint") == F.col("kprint")))
    once = found.where("repeats").groupBy("kid", "kprint").agg(F.first("row").alias("row"))
    return found.where("not repeats").select("row.*").unionByName(once.select("row.*"))
