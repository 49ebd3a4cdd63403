"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text: densities of a fixed lexicon and of a lexicon learned from
the labels (whole words, and word beginnings, which catch inflected and
compounded forms), hits near second-person words, capitals, punctuation,
lengthened letters, obfuscated words, and length. Trees and calibration are
Spark ML's. Labels come only from rows whose crc32(doc_id) mod 5 is not 0;
remainder 4 calibrates, the others teach lexicon and trees. The learning rows
are a bounded sample (``MAX_LABELLED``, the least by hash); everything else
reads all documents. Labels and metadata are never features.

Plan: the sample's ids are sent to the tasks (bounded), so texts never shuffle;
the sample's features go to a small table that the tree rounds reread; scoring
is one narrow pass over all documents, whatever their sizes or copies. Each row's
text goes to Python once, and tasks work on ``SLICE_BYTES`` of it at a time.

Edge cases: a null text counts as empty and gets the score of a text without
words; labels that are null, or of unknown documents, are not used; documents
repeated are scored one by one; without labels of both classes the score is the
mean label (0 without any); an empty table gives an empty result; other columns
are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as tx
from .store import arrow_batches, written

#: labelled rows that the model learns from, at most
MAX_LABELLED = 20_000
#: text bytes that a task works on at once (its arrays take up to 70 times as much), and bytes of the batches that learning gets
SLICE_BYTES, BATCH_BYTES = 1 << 18, "4m"
#: learned words and word beginnings, at most
MAX_LEARNED = 2_000
#: code points of a learned word beginning
BEGINNINGS = (4, 5, 6)
#: standard errors by which a learned entry's log odds must exceed 0, and the odds ratio itself
LEARN_Z, LEARN_ODDS = 5.0, 1.0
#: words around a hit in which a second-person word counts as near
NEAR = 5

# Insulting words, and words that address a reader.
INSULTS = ("idiot", "idiots", "idiotic", "moron", "morons", "stupid", "dumb", "loser", "losers", "trash", "garbage", "scum", "clown",
           "pathetic", "worthless", "disgusting", "fool", "ugly", "hate", "imbecile", "filth", "vermin", "pig", "bastard", "bitch",
           "crap", "shit", "fuck", "asshole", "retard", "dumm", "dummkopf", "arschloch", "schwein", "abschaum", "widerlich",
           "connard", "crétin", "salaud", "salope", "merde", "débile", "ordure", "idiota", "estúpido", "imbécil", "basura",
           "asqueroso", "mierda", "cabrón", "tonto", "payaso")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "tu", "toi", "te",
                 "ton", "ta", "tes", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes")

FEATURES = ("insults", "learned_words", "learned_word_weight", "learned_beginnings", "learned_beginning_weight", "heaviest",
            "near_second_person", "second_person", "capitals", "capital_words", "exclamations", "punctuation", "lengthened",
            "obfuscated", "log_words")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[list(b"0123456789@$*#%!")] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[0x21:0x30] = _PUNCT[0x3A:0x41] = _PUNCT[0x5B:0x61] = _PUNCT[0x7B:0x7F] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte."""
    out = tx.LOWER[buf]
    latin = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    out[latin] += 0x20
    return out


def entries(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words' ranges and offsets, their names, and for each beginning's length the names (0 where the word is shorter)."""
    low = lowered(buf)
    start, end, at = tx.words(low, off, tx.ALNUM)
    prints = tx.Prints(low)
    points = np.flatnonzero((low & 0xC0) != 0x80)
    first = np.searchsorted(points, start)
    beginnings = []
    for k in BEGINNINGS:
        after = first + k
        stop = np.where(after < len(points), points[np.minimum(after, len(points) - 1)] if len(points) else 0, len(low))
        whole = stop < end  # longer words only: whole words are entries themselves
        names = prints.of(start, np.where(whole, stop, end)) ^ tx.U64(0x5851F42D4C957F2D * k & (1 << 64) - 1)
        beginnings.append(np.where(whole, names, tx.U64(0)))
    return start, end, at, prints.of(start, end), beginnings


class Lexicon:
    """Sorted names with weights."""

    def __init__(self, names: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(names)
        self.names, self.weights = names[order], weights[order]

    def of(self, names: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(names))
        place = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[place] == names, self.weights[place], 0.0)


def fixed(words: tuple[str, ...]) -> Lexicon:
    parts = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
    off = np.cumsum([0, *map(len, parts)])
    return Lexicon(tx.word_prints(buf, off[:-1], off[1:]), np.ones(len(parts)))


def features(buf: np.ndarray, off: np.ndarray, insults: Lexicon, address: Lexicon, learned: Lexicon) -> list[np.ndarray]:
    """The columns of FEATURES for each document."""
    start, end, at, names, beginnings = entries(buf, off)
    n = np.maximum(np.diff(at), 1).astype(np.float64)
    mean = lambda values: tx.per_document(values.astype(np.float64), at) / n
    insult = insults.of(names)
    word = learned.of(names)
    begin = np.zeros(len(names))
    for b in beginnings:
        begin = np.maximum(begin, learned.of(b))
    heavy = np.maximum(np.maximum(word, begin), insult)
    heaviest = np.zeros(len(off) - 1)
    np.maximum.at(heaviest, tx.owner(at), heavy)
    hit = np.flatnonzero(heavy > 0)
    spoken = address.of(names)
    you = np.flatnonzero(spoken)
    near = np.zeros(len(names))
    if len(you) and len(hit):
        own = tx.owner(at)
        place = np.searchsorted(you, hit)
        for side in (np.minimum(place, len(you) - 1), np.maximum(place - 1, 0)):
            near[hit] = np.maximum(near[hit], (np.abs(you[side] - hit) <= NEAR) & (own[you[side]] == own[hit]))
    chars = lambda mask: mask_sums(mask, off)
    letters = np.maximum(chars(_LETTER[buf]), 1)
    upper = _UPPER[buf]
    counted = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(upper, out=counted[1:])
    shouted = (counted[end] - counted[start] == end - start) & (end - start > 1)
    long3 = np.zeros(len(buf), dtype=bool)
    odd = np.zeros(len(buf), dtype=bool)
    if len(buf) > 2:
        long3[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _LETTER[buf[2:]]
        odd[1:-1] = _ODD[buf[1:-1]] & _LETTER[buf[:-2]] & _LETTER[buf[2:]]
        for edge in (off[:-1], off[:-1] + 1):  # neighbours are of the same document
            long3[edge[edge < len(buf)]] = False
        for edge in (off[:-1], off[1:] - 1):
            odd[edge[(edge >= 0) & (edge < len(buf))]] = False
    return [mean(insult), mean(word > 0), mean(word), mean(begin > 0), mean(begin), heaviest, mean(near), mean(spoken),
            chars(upper) / letters, mean(shouted), chars(buf == 0x21) / n, chars(_PUNCT[buf]) / n, chars(long3) / n, chars(odd) / n,
            np.log1p(np.diff(at))]


def mask_sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return tx.per_document(mask.astype(np.int64), off)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(lid, text, label, fold) of the learning rows; lid only orders them."""
    part = F.crc32(F.col("lid").cast("string")) % 5
    rows = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
            .select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("label"))
            .groupBy("lid").agg(F.max("label").alias("label"))  # a document labelled twice counts once
            .where(part != 0).orderBy(F.xxhash64("lid"), "lid").limit(MAX_LABELLED)
            .withColumn("fold", part.cast("int")))
    return (docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text"))
            .join(F.broadcast(rows), "lid").select("lid", "text", "label", "fold"))


def entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label, ..) -> (name, bad, good): toxic and other rows that hold an entry, slice by slice."""
    for part in tx.slices(batches, limit=SLICE_BYTES):
        buf, off = tx.flat(part.column(0))
        _, _, at, names, beginnings = entries(buf, off)
        own = tx.owner(at)
        label = part.column(1).to_numpy()
        pairs = np.concatenate([names, *beginnings])
        owners = np.tile(own, 1 + len(beginnings))
        owners, pairs = owners[pairs != 0], pairs[pairs != 0]
        order = np.lexsort((owners, pairs))
        pairs, owners = pairs[order], owners[order]
        once = np.ones(len(pairs), dtype=bool)
        once[1:] = (pairs[1:] != pairs[:-1]) | (owners[1:] != owners[:-1])
        pairs, toxic = pairs[once], label[owners[once]]
        found, begin = np.unique(pairs, return_index=True)
        if not len(found):
            continue
        bad = np.add.reduceat(toxic, begin)
        every = np.diff(np.append(begin, len(pairs)))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array((every - bad).astype(np.int64))],
                                         names=["name", "bad", "good"])


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Entries found in clearly more of the toxic rows than of the others."""
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(bad / (totals.get(1, 0) + 1)) - F.log(good / (totals.get(0, 0) + 1))
    top = (rows.mapInArrow(entry_counts, "name long, bad long, good long").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
           .withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / bad + 1 / good))
           .where((F.col("bad") >= 5) & (F.col("odds") >= LEARN_ODDS) & (F.col("z") >= LEARN_Z))
           .orderBy(F.desc("z"), "name").limit(MAX_LEARNED))
    with arrow_batches(rows.sparkSession, BATCH_BYTES):
        top = top.collect()
    return Lexicon(np.array([r.name for r in top], dtype=np.int64).view(tx.U64), np.array([r.odds for r in top], dtype=np.float64))


def featured(rows: DataFrame, learned: Lexicon, keep_text: bool = False) -> DataFrame:
    """rows (text, others) with the feature columns, in place of the text unless that is kept."""
    insults, address = fixed(INSULTS), fixed(SECOND_PERSON)
    fields = sorted(rows.schema.fields, key=lambda f: f.name != "text")  # the text first
    given = fields[0 if keep_text else 1:]
    schema = StructType([*given, *(StructField(n, DoubleType()) for n in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, limit=SLICE_BYTES):
            buf, off = tx.flat(part.column(0))
            made = features(buf, off, insults, address, learned)
            yield pa.RecordBatch.from_arrays([*part.columns[len(fields) - len(given):], *(pa.array(c.astype(np.float64)) for c in made)],
                                             names=[*(f.name for f in given), *FEATURES])

    return rows.select(*(f.name for f in fields)).mapInArrow(run, schema)


class Model:
    """Lexicon, trees and calibration; without both classes only a mean."""

    def __init__(self, learned: Lexicon, mean: float, trees: GBTClassificationModel | None,
                 isotonic: IsotonicRegressionModel | None) -> None:
        self.learned, self.mean, self.trees, self.isotonic = learned, mean, trees, isotonic

    def raw(self, rows: DataFrame) -> DataFrame:
        """featured rows with ``raw``, the trees' probability."""
        shaped = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        return self.trees.transform(shaped).withColumn("raw", vector_to_array("probability")[1])

    def scored(self, rows: DataFrame, keep_text: bool = False) -> DataFrame:
        """rows (text, others) with ``score``, among other columns, in place of the text unless that is kept."""
        rows = featured(rows, self.learned, keep_text)
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.mean))
        return self.raw(rows).withColumnRenamed("raw", "score") if self.isotonic is None else self.isotonic.transform(self.raw(rows))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        scored = self.scored(docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id")))
        # a null id has no remainder: it is not held out
        held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
        return scored.select("doc_id", held.alias("held_out"), F.col("score").cast("double").alias("score"),
                             (F.col("score") >= 0.5).cast("int").alias("predicted"))

    def accepted(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of docs, all columns, that are not predicted toxic."""
        others = [c for c in docs.columns if c != text_col]
        row = F.struct(*(f"`{c}`" for c in others)) if others else F.lit(0)
        kept = self.scored(docs.select(F.col(text_col).alias("text"), row.alias("row")), keep_text=True).where("score < 0.5")
        return kept.select(*((F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    rows = written(labelled(docs, labels, id_col, text_col, label_col), "labelled")
    classes: dict[tuple[int, bool], int] = {}
    for r in rows.groupBy("label", "fold").agg(F.count("*").alias("n")).collect():
        classes[r.label, r.fold == 4] = classes.get((r.label, r.fold == 4), 0) + r.n
    teaching = [classes.get((c, False), 0) for c in (0, 1)]
    total = sum(classes.values())
    mean = sum(n for (c, _), n in classes.items() if c) / total if total else 0.0
    if not all(teaching):
        return Model(Lexicon(np.empty(0, dtype=tx.U64), np.empty(0)), mean, None, None)
    learned = learn_lexicon(rows.where("fold != 4").select("text", "label", "fold"))
    # few rows: the tree rounds are cheapest on one partition per 2,000 of them; one order, so that they learn the same again
    table = written(featured(rows, learned).repartition(max(1, math.ceil(total / 2_000)), "lid")
                    .sortWithinPartitions("lid", "log_words", "label"), "toxicity-features", arrow_bytes=BATCH_BYTES)
    shaped = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    trees = GBTClassifier(labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, seed=1, minInstancesPerNode=3).fit(shaped.where("fold != 4"))
    model = Model(learned, mean, trees, None)
    if all(classes.get((c, True), 0) >= 20 for c in (0, 1)):  # else too few rows to calibrate on
        model.isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(model.raw(table.where("fold = 4")))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    return fit(docs, labels, id_col, text_col, label_col).score(docs, id_col, text_col)
