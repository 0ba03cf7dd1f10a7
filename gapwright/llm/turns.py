"""Faults of conversations, and their cheapest repair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.llm.scratch import kept
from gapwright.llm.text import SPACES, whole

CHUNK = 512  # turns of one conversation that are looked at together
ROLES, FAULTS = "sua?", ("ok", "truncated", "duplicate", "blank")
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last kept role was
NEXT = (USER, USER, ASSISTANT, USER)  # the role that may always follow
KEEP = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})  # by role of the turn
NEVER = (1 << 40, "")

Table = tuple[tuple[int, str], ...]  # cost and audit by grammar state

AT_END: tuple[Table, ...] = (((0, ""), (4, "II"), (2, "I"), (0, "")),)
GOES_ON: tuple[Table, ...] = tuple(tuple((0, "") if q == out else NEVER for q in range(4)) for out in range(4))


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations damaged by rule, for a trial of the repair: of
    ``crc32("conv_id:turn") % 20`` 0 drops a row, 1 empties its text, 2 takes
    the sentence marks out, 3 repeats it and 4 makes its role user. Nulls count
    as one space. ``live`` is false for a dropped row."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    told = rows.withColumn("_kind", F.crc32(key) % 20)
    kind = F.col("_kind")
    out = told.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("live"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return out.drop("_copy")


def _same(a: str, b: str, columns: list[str]) -> Column:
    both = F.lit(True)
    for c in columns:
        both = both & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return both


def _told(rows: DataFrame) -> DataFrame:
    """``rows`` with nulls as one space and the key by which equal turns are known."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("h"), "live")


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, symbols): a letter for role and first fault of
    each turn, equal turns of one number together, at most ``CHUNK`` letters."""
    bare = F.trim("text", F.lit(SPACES))
    marks = F.array(*map(F.lit, ".!?"))
    live = _told(rows).select(
        "conv_id", F.when(F.col("live"), F.col("turn")).alias("turn"), F.when(F.col("live"), F.col("role")).alias("role"), F.when(F.col("live"), F.col("h")).alias("h"),
        F.when(bare == "", 3).when(F.array_contains(marks, F.substring(bare, -1, 1)), 0).otherwise(1).alias("fault"),
    )
    keys = live.groupBy("conv_id", "turn", "role", "h").agg(F.min("fault").alias("fault"), F.count("h").alias("n"))
    # told by what was counted and not by the key, so that both uses read one exchange and texts are read once
    first = keys.where("n > 0 AND fault >= 0").groupBy("conv_id", "role", "h").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("at"))
    firsts = first.select("conv_id", F.col("at.turn").alias("turn"), "role", "h", F.lit(True).alias("first"))
    flagged = keys.alias("k").join(firsts.alias("f"), _same("k", "f", ["conv_id", "turn", "role", "h"]), "left").select("k.*", "first")
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    role = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    later = F.when(F.col("fault") == 3, 3).otherwise(2)
    letter = lambda fault: F.char((65 + 4 * fault + role).cast("long"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)).cast("long"), F.lit(CHUNK).cast("long")))
    head = F.when(F.col("first"), letter(F.col("fault"))).otherwise(letter(later))
    size = F.least(F.col("n") - F.col("_from"), F.lit(CHUNK)).cast("int")
    spread = flagged.withColumn("_from", at)
    text = F.when(F.col("n") == 0, "").when(F.col("_from") == 0, F.concat(head, F.repeat(letter(later), size - 1))).otherwise(F.repeat(letter(later), size))
    return spread.select("conv_id", "turn", "role", "h", "_from", text.alias("symbols"))


def _in_chunks(id_col: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = TaskContext.get().partitionId() << 40
        conv, letters, first, last, turns, held = None, None, None, None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            columns = (batch[c].to_pylist() for c in (id_col, "turn", "symbols"))
            for owner, turn, symbols in zip(*columns, strict=True):
                if letters is None or owner != conv or held + len(symbols) > chunk:
                    if letters is not None:
                        out.append((conv, line, "".join(letters)[::-1], first, last, turns))
                        line += 1
                    conv, letters, first, last, turns, held = owner, [], None, None, 0, 0
                if symbols:
                    letters.append(symbols)
                    held += len(symbols)
                    if turn is not None and turn != last:
                        first, last, turns = turn if first is None else first, turn, turns + 1
            if out:
                yield _batch(out, batch.schema.field(id_col).type)
        if letters is not None:
            yield _batch([(conv, line, "".join(letters)[::-1], first, last, turns)], batch.schema.field(id_col).type)

    def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [id_col, "line", "signature", "first_turn", "last_turn", "turns"]
        )

    return run


class Node:
    """A suffix of signatures: what its turns hold, and the cheapest repair
    from each grammar state on, one table for each way it may end."""

    __slots__ = ("tables", "counts", "head")

    def __init__(self, tables: tuple[Table, ...], counts: tuple[int, ...] = (0, 0, 0, 0), head: int | None = None):
        self.tables, self.counts, self.head = tables, counts, head

    def before(self, symbol: str) -> Node:
        """The node of the suffix that ``symbol`` begins."""
        fault, role = divmod(ord(symbol) - 65, 4)
        truncated, duplicate, blank, illegal = self.counts
        if self.head is not None and ROLES[role] + ROLES[self.head] not in ("su", "ua", "au"):
            illegal += 1
        counts = (truncated + (fault == 1), duplicate + (fault == 2), blank + (fault == 3), illegal)
        return Node(tuple(_step(table, role, fault) for table in self.tables), counts, role)


def _step(after: Table, role: int, fault: int) -> Table:
    """Cost and audit from each state on, by those after the turn."""
    used = []
    for q in range(4):
        cost, audit = after[q]
        best = (cost + 3, "D" + audit)
        if fault < 2:
            cost, audit = after[NEXT[q]]
            best = min(best, (cost + 2 + fault, "R" + audit))
            stays = KEEP[role].get(q)
            if stays is not None:
                cost, audit = after[stays]
                best = min(best, (cost + fault, "K" + audit))
        used.append(best)
    out = []
    for q in range(4):
        one = NEXT[q]
        two = NEXT[one]
        out.append(min(used[q], (used[one][0] + 2, "I" + used[one][1]), (used[two][0] + 4, "II" + used[two][1])))
    return tuple(out)


def _over_automaton(id_col: str):
    """Signatures come backwards and in order, so those that share a suffix
    follow each other: the path of the last one is kept as a stack, and only
    nodes beyond the shared suffix are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, before, path = None, "", []
        for batch in batches:
            found: list[tuple] = []
            for end, signature, starts in zip(batch["ends"].to_pylist(), batch["signature"].to_pylist(), batch["starts"].to_pylist(), strict=True):
                if end != ends:
                    ends, before, path = end, "", [Node(AT_END if end else GOES_ON)]
                shared = _shared(before, signature)
                del path[shared + 1 :]
                for symbol in signature[shared:]:
                    path.append(path[-1].before(symbol))
                before, node = signature, path[-1]
                cells = [table[q] for q in ((START,) if starts else range(4)) for table in node.tables]
                tail = ord(signature[0]) - 65 & 3 if signature else None
                found.append(([c for c, _ in cells], [a for _, a in cells], *node.counts, node.head, tail))
            kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.int32(), pa.int32()]
            names = ["costs", "audits", "truncated", "duplicate", "blank", "illegal", "head", "tail"]
            made = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 8, kinds, strict=True)]
            passed = [id_col, "line", "first_turn", "last_turn", "turns"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in passed), *made], [*passed, *names])

    return run


def _shared(a: str, b: str) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def _joined(chunks: list[dict]) -> tuple[int, str]:
    """Cost and audit of a conversation from those of its chunks."""
    best: list = [(c, n, None) for n, c in enumerate(chunks[-1]["costs"])]  # by state at the start of the chunk
    ways = [best]
    for chunk in reversed(chunks[:-1]):
        states = len(chunk["costs"]) // 4
        now = []
        for q in range(states):
            cells = range(4 * q, 4 * q + 4)  # audits within a chunk tell paths apart: all end with a turn
            now.append(min((chunk["costs"][c] + best[c % 4][0], chunk["audits"][c], c) for c in cells))
        best = [(cost, c, c % 4) for cost, _, c in now]
        ways.append(best)
    audit, state = [], START
    for chunk, way in zip(chunks, reversed(ways), strict=True):
        _, cell, after = way[state]
        audit.append(chunk["audits"][cell])
        state = after
    return best[START][0], "".join(audit)


def _combined(id_col: str):
    """Chunks come by conversation, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[dict]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(id_col).type
                yield from batch.to_pylist()

        out: list[tuple] = []
        for conv, group in groupby(rows(), itemgetter(id_col)):
            chunks = list(group)
            cost, audit = _joined(chunks)
            sums = [sum(c[n] for c in chunks) for n in ("blank", "duplicate", "truncated", "illegal")]
            told = [c for c in chunks if c["head"] is not None]
            for a, b in zip(told, told[1:], strict=False):
                sums[3] += ROLES[a["tail"]] + ROLES[b["head"]] not in ("su", "ua", "au")
            timed = [c for c in chunks if c["turns"]]
            gaps = 0
            if timed:
                repeated = sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
                gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - sum(c["turns"] for c in timed) + repeated
            out.append((conv, gaps if gaps < 1 << 63 else None, *sums, cost, audit))
            if len(out) == 4096:
                yield _batch(out, kind)
                out = []
        if out:
            yield _batch(out, kind)

    def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string()]
        names = [id_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _own(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, live_col: str | None) -> DataFrame:
    live = F.lit(True) if live_col is None else F.coalesce(F.col(live_col), F.lit(False))
    return rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), live.alias("live"))


def audits(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live_col: str | None = None, chunk: int = CHUNK
) -> DataFrame:
    """A row per conversation: (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit).

    Turns go by number, nulls first; those of one number by role, then by MD5
    of the text. A turn's first fault counts: blank, role and text seen earlier
    in the conversation, no sentence mark at its end. Edits are Keep (free),
    Rerole to user or assistant (2), Delete (3; blank and duplicate turns must
    go) and Insert an empty user or assistant turn (2); a truncated turn that
    stays adds 1. ``audit`` holds the initials of the cheapest edits after
    which the initials of the roles are ``(s?(ua)+)?``, the ASCII-least of
    several. ``illegal`` counts neighbours before the repair whose initials
    are not su, ua or au; ``gaps`` the numbers missing between the turns.

    Roles and faults of a conversation are its signature, cut into chunks of
    ``chunk`` turns so that one that holds most turns lies in many tasks. All
    chunks are dealt by range of their signature read backwards, so that those
    that share a suffix meet: the suffixes are the nodes of one automaton
    (DAWG), and cost-to-go and best audit suffix are found once per node and
    grammar state for all conversations. Only nodes on the border of two
    ranges are made twice. A chunk that does not end its conversation has a
    table for each state it may leave; the tables of a conversation's chunks
    are put together in one pass over them.

    Nulls in role and text are one space; a role without an initial of s, u, a
    cannot be kept. A null id is a conversation of its own. Repeated rows are
    turns. Rows where ``live_col`` is not true only name their conversation; a
    conversation without turns costs nothing. ``gaps`` beyond a long is null.
    An empty table gives no rows; other columns are not looked at. Texts are
    read in the JVM and never leave it here, however long.
    """
    symbols = _symbols(_own(rows, id_col, turn_col, role_col, text_col, live_col))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h", "_from"]
    dealt = symbols.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "symbols")
    kind = symbols.schema["conv_id"].dataType.simpleString()
    chunks = kept(dealt.mapInArrow(_in_chunks("conv_id", chunk), f"conv_id {kind}, line long, signature string, first_turn long, last_turn long, turns long"), "chunks")
    sides = chunks.groupBy("conv_id").agg(F.min("line").alias("_first"), F.max("line").alias("_last"))
    placed = chunks.alias("c").join(sides.alias("s"), F.col("c.conv_id").eqNullSafe(F.col("s.conv_id"))).select(
        "c.*", (F.col("line") == F.col("_first")).alias("starts"), (F.col("line") == F.col("_last")).alias("ends")
    )
    told = placed.repartitionByRange("ends", "signature", "line").sortWithinPartitions("ends", "signature")
    schema = f"conv_id {kind}, line long, first_turn long, last_turn long, turns long, costs array<long>, audits array<string>, truncated long, duplicate long, blank long, illegal long, head int, tail int"
    by_chunk = told.mapInArrow(_over_automaton("conv_id"), schema)
    ordered = by_chunk.repartition("conv_id").sortWithinPartitions("conv_id", "line")
    out = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string".format(kind)
    return ordered.mapInArrow(_combined("conv_id"), out).withColumnRenamed("conv_id", id_col)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, end, at, place, state = "", 0, 0, 0, START
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        out: list[tuple] = []
        for conv, edits, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "edits", "role", "text")), strict=True):
            if edits is not None:  # a conversation's audit comes before its turns
                audit, end, at, place, state = edits, len(edits.rstrip("I")), 0, 0, START
            else:
                while audit[at] == "I":
                    state, at, place = NEXT[state], at + 1, place + 1
                    out.append((conv, place, ("user", "assistant")[state - USER], ""))
                if audit[at] == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                    place += 1
                    out.append((conv, place, role, text))
                elif audit[at] == "R":
                    state, place = NEXT[state], place + 1
                    out.append((conv, place, ("user", "assistant")[state - USER], text))
                at += 1
            while end <= at < len(audit):  # what is inserted at the end
                state, at, place = NEXT[state], at + 1, place + 1
                out.append((conv, place, ("user", "assistant")[state - USER], ""))
        if out:
            kinds = [kind, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "place", "role", "text"])


def repaired(
    rows: DataFrame, plans: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live_col: str | None = None
) -> DataFrame:
    """(conv_id, place, role, text): the turns after the edits of ``plans``,
    the result of ``audits`` for the same rows. A conversation's rows lie in
    one partition, in order, and are streamed, not held: whoever hashes or
    writes a conversation as one text needs them so. Nulls, ties, repeats and
    empty tables as in ``audits``."""
    own = _told(_own(rows, id_col, turn_col, role_col, text_col, live_col)).where("live")
    edits = plans.select(F.col(id_col).alias("conv_id"), F.lit(0).alias("_kind"), F.col("audit").alias("edits"))
    turns = own.select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "h", "text")
    both = turns.unionByName(edits, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "_kind", F.col("turn").asc_nulls_first(), "role", "h")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return dealt.select("conv_id", "edits", "role", "text").mapInArrow(_applied, f"conv_id {kind}, place long, role string, text string").withColumnRenamed("conv_id", id_col)


def digests(found: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, repaired_sha256) of conversations as ``role:text`` lines; for
    rows that ``repaired`` gave, which lie in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for owner, place, role, text in zip(*(batch[c].to_pylist() for c in (id_col, "place", "role", "text")), strict=True):
                if place == 1:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = owner, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(role.encode() + b":")
                digest.update(text.encode())
            if done:
                yield _batch(done, batch.schema.field(id_col).type)
        if digest is not None:
            yield _batch([(conv, digest.hexdigest())], batch.schema.field(id_col).type)

    def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.string()), strict=True)], [id_col, "repaired_sha256"])

    return found.mapInArrow(run, f"{id_col} {found.schema[id_col].dataType.simpleString()}, repaired_sha256 string")
