"""Conversation structure repair by a suffix-shared automaton.

A conversation is a signature: one letter a row, its role's class (system, user,
assistant, other) and its fault. Edits that make the roles follow
``(s?(ua)+)?`` at the least cost depend on the signature alone, and the best
rest of an edit list on the signature's suffix and the grammar's state. So
signatures are sorted by their reversal: neighbours share their suffix, which is
a path of the automaton that is already there, and a node's cost-to-go and best
edits are computed once for all conversations that pass through it. Nodes whose
costs differ by a constant only are one state (``Automaton.step``): the
signatures are minimised from the end to a handful of states, each worked out
once a task.

Plan: rows are numbered over the whole table by a range-partitioned sort, and
a conversation is cut at multiples of ``BLOCK`` rows, so that one with a
third of all rows spreads over tasks. Chunks of a cut conversation are first
reduced to 4 x 4 cost matrices; their product from the end tells each chunk
what follows it. Earlier rows with the same role and text are found by a
minimum aggregated before the shuffle. The sorted signatures are range
partitioned with the conversation as the last key, so a signature that many
conversations share spreads too. Digests stream a conversation's rows through
one task without holding them: a SHA-256 has to be taken in order.

Ties: rows of one turn are ordered by role, then by the MD5 of their text.

Edge cases: a null conversation, turn, role or text reads as one space (null
turns first; conversations with null ids are one); roles of other initials,
empty ones too, can be rerolled or deleted; repeated rows are duplicates; an
empty table gives an empty result; long texts are read whole, and only their
last character, their being blank and their MD5 count before the digest; other
columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.crawl import numbered
from .store import written

#: rows after which a conversation is cut
BLOCK = 4096
#: cost of what cannot be
NEVER = 1 << 40
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: grammar states: nothing yet, after system, after user, after assistant
STATES = range(4)
ACCEPT = (0, NEVER, NEVER, 0)
#: state after a user or assistant turn given in its place; which one it is follows from the state
NEXT = (2, 2, 3, 2)
#: (state, role class) -> state of turns that fit as they are
FITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: letter of a row that must go
GONE = "d"
ROLES = ("user", "assistant")


class Automaton:
    """Cost-to-go of signatures' suffixes for one end, shared between neighbours of the sorted order."""

    #: (letter, costs less the least) -> (costs less the least, what was taken off, edits and states for each state)
    _steps: dict[tuple[str, tuple[int, ...]], tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]] = {}

    def __init__(self, end: tuple[int, ...]) -> None:
        costs, inserts = _with_inserts([(c, "", q) for q, c in enumerate(end)])
        self.path = [(*_less(costs), inserts)]
        self.letters = ""

    @classmethod
    def step(cls, letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
        if (letter, after) not in cls._steps:
            best = []
            for q in STATES:
                ways = [(DELETE + after[q], "D", q)]
                if letter != GONE:
                    extra = TRUNCATED if letter.isupper() else 0
                    fit = FITS.get((q, letter.lower()))
                    if fit is not None:
                        ways.append((KEEP + extra + after[fit], "K", fit))
                    ways.append((REROLE + extra + after[NEXT[q]], "R", NEXT[q]))
                best.append(min(ways))  # of equal cost the ASCII-least
            costs, edits = _with_inserts(best)
            cls._steps[letter, after] = *_less(costs), edits
        return cls._steps[letter, after]

    def read(self, signature: str) -> None:
        """Makes the signature the current path; the suffix shared with the last one is kept."""
        backwards = signature[::-1]
        same = 0
        for a, b in zip(backwards, self.letters):
            if a != b:
                break
            same += 1
        del self.path[same + 1:]
        for letter in backwards[same:]:
            costs, total, _ = self.path[-1]
            costs, low, edits = self.step(letter, costs)
            self.path.append((costs, min(total + low, NEVER), edits))
        self.letters = backwards

    def cost(self, state: int) -> int:
        costs, total, _ = self.path[-1]
        return min(costs[state] + total, NEVER)

    def audit(self, state: int) -> tuple[str, int]:
        """The edits from this state, and the state they end in."""
        out = []
        for _, _, edits in reversed(self.path):
            while edits[state][0] == "I":
                out.append("I")
                state = edits[state][1]
            op, state = edits[state]
            out.append(op)
        return "".join(out), state


def _with_inserts(best: list[tuple[int, str, int]]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Best first edits by state once turns may be inserted before them."""
    for _ in STATES:
        best = [min(b, (INSERT + best[NEXT[q]][0], "I", NEXT[q])) if best[NEXT[q]][0] < NEVER else b for q, b in enumerate(best)]
    return tuple(min(c, NEVER) for c, _, _ in best), tuple((op, q) for _, op, q in best)


def _less(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The costs less their least, and that."""
    low = min(costs)
    return tuple(NEVER if c >= NEVER else c - low for c in costs), low


def unit(state: int) -> tuple[int, ...]:
    return tuple(0 if q == state else NEVER for q in STATES)


def spaced(column: str) -> Column:
    """As text, a null as one space."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(key, turn, role, text) after the damage that the rows' numbers call for."""
    fault = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20
    rows = conversations.select(spaced(conv_col).alias("key"), F.col(f"`{turn_col}`").cast("long").alias("turn"), spaced(role_col).alias("role"),
                                spaced(text_col).alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def rows_of(damage: DataFrame, block: int) -> DataFrame:
    """(key, turn, role, text, g, block, cls, blank, duplicate, truncated): the rows in order, numbered by g over all."""
    stable = written(damage.withColumn("hash", F.md5("text")).withColumn("tie", F.monotonically_increasing_id()), "turns")
    ordered = written(numbered(stable, ["key", "turn", "role", "hash", "tie"], "g").drop("tie"), "ordered")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    first = ordered.groupBy("key", "role", "hash").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    duplicate = F.col("first").isNull() & ~F.col("blank")
    judged = (ordered.withColumn("blank", blank).join(first, "g", "left").withColumn("duplicate", duplicate)
              .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~last.isin(".", "!", "?"))
              .withColumn("cls", F.when(initial.isin("s", "u", "a"), initial).otherwise("o")).withColumn("block", F.expr(f"g div {block}")))
    return written(judged.drop("first", "hash"), "judged")


def chunks_of(rows: DataFrame) -> DataFrame:
    """(key, block, signature, roles, number, chunks): a conversation's chunks, numbered from 0."""
    letter = (F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), F.upper("cls")).otherwise(F.col("cls")))
    listed = rows.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("g", letter.alias("letter"), "cls"))).alias("rows"))
    joined = lambda c: F.array_join(F.col(f"rows.{c}"), "")
    every = W.partitionBy("key")
    return (listed.select("key", "block", joined("letter").alias("signature"), joined("cls").alias("roles"))
            .withColumn("number", F.row_number().over(every.orderBy("block")) - 1).withColumn("chunks", F.count("*").over(every)))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's least costs from any state to any state."""
    for batch in batches:
        made = []
        for signature in batch.column(2).to_pylist():
            row = []
            for end in STATES:
                a = Automaton(unit(end))
                a.read(signature)
                row.append([a.cost(q) for q in STATES])
            made.append([row[end][q] for q in STATES for end in STATES])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, type=pa.list_(pa.int64()))], names=["key", "block", "matrix"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk's best edits end, by the state that they start from."""
    for batch in batches:
        made = []
        for signature, end in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a = Automaton(tuple(end))
            a.read(signature)
            made.append([a.audit(q)[1] if a.cost(q) < NEVER else q for q in STATES])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, type=pa.list_(pa.int64()))], names=["key", "block", "ends"])


def joined_ends(chunks: DataFrame) -> DataFrame:
    """(key, block, end, state): what follows each chunk, and the state before it. Only cut conversations
    need work: products of small matrices from their last chunk, then one step a chunk from their first."""
    cut = written(chunks.where("chunks > 1").select("key", "block", "signature"), "cut")

    def backward(pdf):
        pdf = pdf.sort_values("block", ascending=False)
        end, out = list(ACCEPT), []
        for m in pdf["matrix"]:
            out.append(end)
            end = [min(min(int(m[4 * q + e]) + end[e] for e in STATES), NEVER) for q in STATES]
        return pdf.assign(end=out)[["key", "block", "end"]]

    def forward(pdf):
        pdf = pdf.sort_values("block")
        state, out = 0, []
        for ends in pdf["ends"]:
            out.append(state)
            state = int(ends[state])
        return pdf.assign(state=out)[["key", "block", "end", "state"]]

    ends = written(cut.mapInArrow(_matrices, "key string, block long, matrix array<long>").groupBy("key")
                   .applyInPandas(backward, "key string, block long, end array<long>"), "ends")
    known = cut.join(ends, ["key", "block"]).select("key", "block", "signature", "end")
    reached = known.mapInArrow(_ends, "key string, block long, ends array<long>").join(ends, ["key", "block"])
    return reached.groupBy("key").applyInPandas(forward, "key string, block long, end array<long>, state int")


AUDITED = "key string, block long, state int, audit string, cost long, illegal long, first string, last string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by end and reversed signature: costs and audits along the automaton."""
    automaton, end, last, found = None, None, None, None
    for batch in batches:
        keys, blocks, signatures, roles, states, ends = (batch.column(i) for i in range(6))
        out = []
        for signature, role, state, e in zip(signatures.to_pylist(), roles.to_pylist(), states.to_pylist(), ends.to_pylist()):
            if e != end:
                automaton, end, last = Automaton(tuple(e)), e, None
            if (signature, state) != last:
                automaton.read(signature)
                last, found = (signature, state), (automaton.audit(state)[0], automaton.cost(state))
            legal = sum(role[i:i + 2] in ("su", "ua", "au") for i in range(len(role) - 1))
            out.append((state, found[0], found[1], len(role) - 1 - legal, role[0], role[-1]))
        state, audit, cost, illegal, first, final = zip(*out) if out else ((),) * 6
        yield pa.RecordBatch.from_arrays(
            [keys, blocks, pa.array(state, pa.int32()), pa.array(audit, pa.string()), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()),
             pa.array(first, pa.string()), pa.array(final, pa.string())], names=[f.split()[0] for f in AUDITED.split(", ")])


def audited(chunks: DataFrame) -> DataFrame:
    """Chunks with the edits that their conversation's cheapest list gives them."""
    chunks = written(chunks, "chunks")
    given = chunks.join(joined_ends(chunks), ["key", "block"], "left")
    accept = F.array(*(F.lit(c).cast("long") for c in ACCEPT))
    given = written(given.select("key", "block", "signature", "roles", F.coalesce("state", F.lit(0)).alias("state"),
                                 F.coalesce("end", accept).alias("end")), "given")
    last = [F.col("end"), F.reverse("signature"), F.col("state"), F.col("key"), F.col("block")]
    return written(given.repartitionByRange(*last).sortWithinPartitions(*last).mapInArrow(_audits, AUDITED), "audits")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, str, str]]:
    """(key, block, edit, role, text) of the rows that stay, from chunks' audits each followed by its rows."""

    def given(state: int) -> tuple[str, int]:
        return ROLES[state == 2], NEXT[state]

    def finish() -> Iterator[tuple[str, int, str, str, str]]:
        nonlocal at, state
        while at < len(audit):  # turns inserted after the last row
            role, state = given(state)
            yield key, block, "I", role, ""
            at += 1

    key, block, audit, at, state = None, None, "", 0, 0
    for batch in batches:
        for k, b, a, s, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if a is not None:
                yield from finish()
                key, block, audit, at, state = k, b, a, 0, s
                continue
            while audit[at] == "I":
                new, state = given(state)
                yield key, block, "I", new, ""
                at += 1
            op = audit[at]
            at += 1
            if op == "K":
                state = FITS[state, role[:1]]
                yield key, block, op, role, text
            elif op == "R":
                new, state = given(state)
                yield key, block, op, new, text
    yield from finish()


class Repair:
    """Judged rows and edits of a table of conversations."""

    def __init__(self, conversations: DataFrame, block: int = BLOCK, **columns: str) -> None:
        self.conv_col = columns.get("conv_col", "conv_id")
        self.conversations = conversations
        self.judged = rows_of(damaged(conversations, **columns), block)
        self.audits = audited(chunks_of(self.judged))

    def _records(self, *by: str) -> DataFrame:
        """Each chunk's audit, then its rows, chunk after chunk."""
        none = F.lit(None)
        heads = self.audits.select("key", "block", F.lit(-1).cast("long").alias("g"), "audit", "state", none.cast("string").alias("role"),
                                   none.cast("string").alias("text"))
        rows = self.judged.select("key", "block", "g", none.cast("string").alias("audit"), none.cast("int").alias("state"), "role", "text")
        return (heads.unionByName(rows).repartition(*by).sortWithinPartitions("key", "block", "g")
                .select("key", "block", "audit", "state", "role", "text"))

    def rows(self) -> DataFrame:
        """(key, block, place, edit, role, text): the repaired conversations' turns, in order of block and place."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, now, place = [], 0, None, 0
            for key, block, edit, role, text in edited(batches):
                place = place + 1 if (key, block) == now else 0
                now = (key, block)
                held.append((key, block, place, edit, role, text))
                size += len(text) + 64
                if size > 1 << 20:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

        def packed(held: list) -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)],
                                              names=["key", "block", "place", "edit", "role", "text"])

        return self._records("key", "block").mapInArrow(run, "key string, block long, place long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """(key, repaired_sha256) of conversations of which a turn stays."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done, now, digest = [], None, None
            for key, _, _, role, text in edited(batches):
                if key != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
                if len(done) >= 10_000:
                    yield packed(done)
                    done = []
            if now is not None:
                done.append((now, digest.hexdigest()))
            if done:
                yield packed(done)

        def packed(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["key", "repaired_sha256"])

        return self._records("key").mapInArrow(run, "key string, repaired_sha256 string")

    def report(self) -> DataFrame:
        """A row for each conversation of the input: faults, cost, audit and digest."""
        total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
        faults = self.judged.groupBy("key").agg(total("blank"), total("duplicate"), total("truncated"))
        turns = (self.judged.select("key", "turn").distinct().where("turn is not null").groupBy("key")
                 .agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")))
        parts = self.audits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "audit", "cost", "first", "last"))).alias("c"),
                                               F.sum("illegal").alias("illegal"))
        across = F.expr("size(filter(c, (x, i) -> i > 0 and concat(c[i - 1].last, x.first) not in ('su', 'ua', 'au')))").cast("long")
        parts = parts.select("key", (F.col("illegal") + across).alias("illegal"), F.expr("c[0].cost").alias("cost"),
                             F.array_join("c.audit", "").alias("audit"))
        every = self.conversations.select(F.col(f"`{self.conv_col}`").alias("conv_id")).distinct().withColumn("key", spaced("conv_id"))
        out = every
        for part in (turns, faults, parts, self.digests()):
            out = out.join(part, "key", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return out.select("conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
                          F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(conversations: DataFrame, block: int = BLOCK, **columns: str) -> DataFrame:
    return Repair(conversations, block, **columns).report()
