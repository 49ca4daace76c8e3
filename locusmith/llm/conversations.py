"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by a Viterbi that runs in parallel.

Rows are ordered by conversation, turn (nulls first), role and text, and dealt to tasks by ranges of that order, so a
conversation of any size is cut into chunks, one a task, at most two of which a task shares with others. What a role
sequence may be is an automaton of four states (nothing yet, after system, after user, after assistant); a backward pass
carries the vector of each state's least cost to the end. Conversations that lie in one task are repaired there. A chunk
of a conversation that goes on starts from a speculative vector, that of an ended conversation. Fix-up passes rerun
chunks from their follower's vector, in step with the earlier run until both differ by a constant only, from where the
earlier run holds; passes end when every chunk's vector differs from its follower's by a constant. The constants stitch
costs together, and the start states of chunks follow from each chunk's end state for every start state. Then chunks
trace the edits forward: of the edits that keep the least cost, the one whose initial comes first.

The driver holds the vectors, states and counts of chunks that are shared, two a task at most, never rows. The audit and
the hash of one conversation are one string and one sequential hash, so its pieces meet, in order, in one task that
holds the audit alone.

Faults: blank (nothing but ASCII white space), duplicate (role and text seen earlier in the conversation), truncated (the
last character that isn't white space is not one of ``.!?``). Edits: Keep 0, Rerole 3, Delete 4 (blank and duplicate rows
must go), Insert 3; a truncated row that stays costs 3.

Nulls and the like: a null role or text is one space, a null turn comes first and leaves no gap, rows of a null conv_id
are one conversation. Rows of one turn are ordered by role, then text; repeated rows are adjacent and are counted before
they are dealt, so any number of them is one row. A conversation without rows has no faults, no edits and the hash of
the empty string. An empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint

#: State after the next role that an edit writes: user, user, assistant, user.
NEXT = (2, 2, 3, 2)
#: State after a kept role, by its initial.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WRITTEN = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Least costs of an ended conversation.
END = (0, 2 * INSERT, INSERT, 0)
#: Lines of repaired text in a piece.
PIECE = 1000

_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Vector = tuple[int, int, int, int]


def back(after: Vector, step: tuple) -> Vector:
    """Least costs before a step: ``(copies,)`` are rows that must go, ``(initial, truncated, role, text)`` is a row that may stay."""
    if len(step) == 1:
        return tuple(v + DELETE * step[0] for v in after)
    cut = CUT if step[1] else 0
    best = []
    for state, cost in enumerate(after):
        kept = KEEP[state].get(step[0])
        options = [cost + DELETE, after[NEXT[state]] + REROLE + cut]
        best.append(min(options if kept is None else [*options, after[kept] + cut]))
    user, assistant = min(best[2], best[3] + INSERT), min(best[3], best[2] + INSERT)
    return min(best[0], user + INSERT), min(best[1], user + INSERT), user, assistant


def backward(steps: list[tuple], end: Vector) -> list[Vector]:
    """The vectors before each step and, last, ``end``."""
    out = [end]
    for step in reversed(steps):
        out.append(back(out[-1], step))
    return out[::-1]


def parallel(one: Vector, other: Vector) -> bool:
    return len({a - b for a, b in zip(one, other, strict=True)}) == 1


def refit(steps: list[tuple], old_end: Vector, old_start: Vector, end: Vector) -> Vector:
    """The vector at the start for another vector at the end: reruns until it differs from the earlier run's by a constant."""
    old, new = old_end, end
    for step in reversed(steps):
        if parallel(old, new):
            return tuple(v + new[0] - old[0] for v in old_start)
        old, new = back(old, step), back(new, step)
    return new


def trace(steps: list[tuple], vectors: list[Vector], state: int, last: bool) -> Iterator[tuple[str, str | None, int]]:
    """The edits from ``state`` on: initial, repaired line if the edit leaves one, and the state after it."""
    for i, step in enumerate(steps):
        here, after = vectors[i], vectors[i + 1]
        if len(step) == 1:
            for _ in range(step[0]):
                yield "D", None, state
            continue
        initial, truncated, role, text = step
        while True:
            if after[state] + DELETE == here[state]:
                yield "D", None, state
            elif here[NEXT[state]] + INSERT == here[state]:
                state = NEXT[state]
                yield "I", f"{WRITTEN[state]}:", state
                continue
            else:
                kept = KEEP[state].get(initial)
                if kept is not None and after[kept] + (CUT if truncated else 0) == here[state]:
                    state = kept
                    yield "K", f"{role}:{text}", state
                else:
                    state = NEXT[state]
                    yield "R", f"{WRITTEN[state]}:{text}", state
            break
    while last and END[state]:
        state = NEXT[state]
        yield "I", f"{WRITTEN[state]}:", state


class Chunk:
    """Consecutive rows of a conversation: counts of faults, and the steps of the backward pass."""

    def __init__(self) -> None:
        self.steps: list[tuple] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self._seen: set[bytes] = set()

    def add(self, turn, role: str, text: str, n: int, blank: bool, truncated: bool, seen: bool) -> None:
        if not n:
            return
        initial = role[:1]
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if blank:
            self.blank += n
            self.steps.append((n,))
            return
        key = hashlib.sha256(f"{role}\0{text}".encode()).digest() + len(role).to_bytes(4, "big")
        if seen or key in self._seen:
            self.duplicate += n
            self.steps.append((n,))
            return
        self._seen.add(key)
        self.truncated += truncated
        self.steps.append((initial, truncated, role, text))
        if n > 1:
            self.duplicate += n - 1
            self.steps.append((n - 1,))


def together(chunks: list[dict]) -> tuple[int, int, int, int, int]:
    """gaps, blank, duplicate, truncated and illegal of a conversation from its chunks' counts, in order."""
    turns, low, high, illegal, last = 0, None, None, 0, None
    for c in chunks:
        illegal += c["illegal"]
        if c["first"] is not None:
            illegal += last is not None and last + c["first"] not in LEGAL
            last = c["last"]
        if c["low"] is not None:
            turns += c["turns"] - (high == c["low"])
            low, high = c["low"] if low is None else low, c["high"]
    total = lambda name: sum(c[name] for c in chunks)
    return 0 if low is None else high - low + 1 - turns, total("blank"), total("duplicate"), total("truncated"), illegal


def counts_of(chunk: Chunk) -> dict:
    return {n: getattr(chunk, n) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")}


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows are dropped, emptied, cut, repeated or re-roled by the crc32 of ``conv_id:turn``.

    A dropped row leaves a count of 0 behind, so that its conversation stays known.
    """
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", spelt("conv_id"), spelt("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(spelt("text"), "[.!?]", "")).otherwise(spelt("text"))
    gone = fate == 0
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(fate == 4, "user").otherwise(spelt("role")).alias("role"),
        F.when(gone, "").otherwise(text).alias("text"), F.when(gone, 0).when(fate == 3, 2).otherwise(1).alias("n"),
    )


def repair(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text, n): faults, least cost, edits and the hash of the repaired lines.

    ``parts`` is the number of ranges, the session's shuffle partitions unless given.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    marked = counted.withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "truncated": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})
    dealt = marked.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = checkpoint(dealt).withColumn("part", F.spark_partition_id())
    kind, turn_kind = (ordered.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    conv_type, turn_type = (to_arrow_type(ordered.schema[c].dataType) for c in ("conv_id", "turn"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in (b for b in batches if b.num_rows):
            first, last = b.slice(0, 1) if first is None else first, b.slice(b.num_rows - 1, 1)
        if first is not None:
            yield from (first, last)

    found = ordered.select("conv_id", "part").mapInArrow(ends, f"conv_id {kind}, part int").distinct().collect()
    of_conversation = Counter(r["conv_id"] for r in found)
    shared = {conversation: c for c, conversation in enumerate(k for k, n in of_conversation.items() if n > 1)}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, chunk, open_ = None, Chunk(), False

        def close() -> None:
            vectors = backward(chunk.steps, END)
            edits = [(e, line) for e, line, _ in trace(chunk.steps, vectors, 0, True)]
            lines = "\n".join(line for _, line in edits if line is not None)
            out.append((now, *together([counts_of(chunk)]), vectors[0][0], "".join(e for e, _ in edits), hashlib.sha256(lines.encode()).hexdigest()))

        for b in batches:
            for conversation, *rest in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                if not open_ or conversation != now:
                    if open_ and now not in shared:
                        close()
                    now, chunk, open_ = conversation, Chunk(), True
                if conversation not in shared:
                    chunk.add(*rest, False)
            if len(out) >= PIECE:
                yield _batch(out, conv_type)
                out = []
        if open_ and now not in shared:
            close()
        if out:
            yield _batch(out, conv_type)

    single = ordered.select("conv_id", "turn", "role", "text", "n", "blank", "truncated").mapInArrow(whole, f"conv_id {kind}, {_RESULT}")
    if not shared:
        return single

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            numbers = [shared.get(k) for k in b.column(0).to_pylist()]
            places = pa.array(range(at, at + b.num_rows), pa.int64())
            at += b.num_rows
            some = pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), places, *b.columns[1:]], names=["c", "at", *b.schema.names[1:]])
            some = some.filter(pa.array([n is not None for n in numbers]))
            if some.num_rows:
                yield some

    columns = ["turn", "role", "text", "n", "blank", "truncated"]
    picked = ordered.select("conv_id", "part", *columns).mapInArrow(pick, f"c int, at long, part int, turn {turn_kind}, role string, text string, n long, blank boolean, truncated boolean")
    # A text that an earlier chunk has: a row a chunk and text, so that no key has more rows than there are chunks.
    known = picked.where("n > 0").select("c", "role", F.sha2("text", 256).alias("digest"), "part").distinct()
    earliest = known.groupBy("c", "role", "digest").agg(F.min("part").alias("least"))
    seen = known.join(earliest, ["c", "role", "digest"]).select("c", "role", "digest", "part", (F.col("least") < F.col("part")).alias("seen"))
    flagged = picked.withColumn("digest", F.sha2("text", 256)).join(seen, ["c", "role", "digest", "part"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    chunks = checkpoint(flagged.select("c", "part", "at", *columns, "seen").repartition("c", "part").sortWithinPartitions("c", "part", "at"))

    def run(task, schema: str, keys: set | None = None) -> DataFrame:
        """``task`` of each chunk's key and rows; only of ``keys`` if given."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, chunk = None, Chunk()
            for b in batches:
                for c, part, _, *rest in zip(*[b.column(i).to_pylist() for i in range(10)], strict=True):
                    if (c, part) != now:
                        if now is not None and (keys is None or now in keys):
                            yield from task(now, chunk)
                        now, chunk = (c, part), Chunk()
                    if keys is None or now in keys:
                        chunk.add(*rest)
            if now is not None and (keys is None or now in keys):
                yield from task(now, chunk)

        return chunks.mapInArrow(work, schema)

    counted_as = f"blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low {turn_kind}, high {turn_kind}"

    def speculate(key: tuple[int, int], chunk: Chunk) -> Iterator[pa.RecordBatch]:
        start = backward(chunk.steps, END)[0]
        yield pa.RecordBatch.from_pylist([{"c": key[0], "part": key[1], "start": list(start), **counts_of(chunk)}], schema=_arrow(turn_type))

    of: dict[int, dict[int, dict]] = defaultdict(dict)
    for r in run(speculate, f"c int, part int, start array<long>, {counted_as}").collect():
        of[r["c"]][r["part"]] = r.asDict() | {"start": tuple(r["start"]), "end": END}
    ordered_of = {c: [of[c][p] for p in sorted(of[c])] for c in of}

    while True:
        todo = {}
        for c, own in ordered_of.items():
            for one, follower in zip(own, own[1:], strict=False):
                if not parallel(one["end"], follower["start"]):
                    todo[c, one["part"]] = (one["end"], one["start"], follower["start"])
        if not todo:
            break

        def fix(key: tuple[int, int], chunk: Chunk, todo=todo) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pylist([{"c": key[0], "part": key[1], "start": list(refit(chunk.steps, *todo[key]))}], schema=_VECTORS)

        for r in run(fix, "c int, part int, start array<long>", set(todo)).collect():
            of[r["c"]][r["part"]] |= {"start": tuple(r["start"]), "end": todo[r["c"], r["part"]][2]}

    vectors_of = {(c, x["part"]): (x["end"], x is own[-1]) for c, own in ordered_of.items() for x in own}

    def destinations(key: tuple[int, int], chunk: Chunk) -> Iterator[pa.RecordBatch]:
        end, last = vectors_of[key]
        vectors, reached = backward(chunk.steps, end), []
        for state in range(4):
            now = state
            for _, _, now in trace(chunk.steps, vectors, state, last):  # noqa: B007
                pass
            reached.append(now)
        yield pa.RecordBatch.from_pylist([{"c": key[0], "part": key[1], "start": reached}], schema=_VECTORS)

    reached = {(r["c"], r["part"]): r["start"] for r in run(destinations, "c int, part int, start array<long>").collect()}
    begins, summary, names = {}, {}, {c: conversation for conversation, c in shared.items()}
    for c, own in ordered_of.items():
        state = 0
        for x in own:
            begins[c, x["part"]] = state
            state = reached[c, x["part"]][state]
        more = 0
        for x, follower in zip(own[-2::-1], own[:0:-1], strict=True):
            more += follower["start"][0] - x["end"][0]
        summary[c] = (names[c], *together(own), own[0]["start"][0] + more)

    def pieces(key: tuple[int, int], chunk: Chunk) -> Iterator[pa.RecordBatch]:
        end, last = vectors_of[key]
        audit, lines, seq = [], [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"c": key[0], "part": key[1], "seq": seq, "audit": "".join(audit), "lines": "\n".join(lines), "n": len(lines)}], schema=_PIECES)

        for initial, line, _ in trace(chunk.steps, backward(chunk.steps, end), begins[key], last):
            audit.append(initial)
            if line is not None:
                lines.append(line)
            if len(audit) == PIECE:
                yield piece()
                audit, lines, seq = [], [], seq + 1
        yield piece()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, audit, begun = None, None, [], False

        def row() -> pa.RecordBatch:
            return _batch([(*summary[now], "".join(audit), state.hexdigest())], conv_type)

        for b in batches:
            for c, _, _, edits, lines, n in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if c != now:
                    if now is not None:
                        yield row()
                    now, state, audit, begun = c, hashlib.sha256(), [], False
                audit.append(edits)
                if n:
                    state.update((("\n" if begun else "") + lines).encode())
                    begun = True
        if now is not None:
            yield row()

    laid = run(pieces, "c int, part int, seq int, audit string, lines string, n int").repartition("c").sortWithinPartitions("c", "part", "seq")
    return single.unionByName(laid.mapInArrow(gathered, f"conv_id {kind}, {_RESULT}"))


_VECTORS = pa.schema([("c", pa.int32()), ("part", pa.int32()), ("start", pa.list_(pa.int64()))])
_PIECES = pa.schema([("c", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("lines", pa.string()), ("n", pa.int32())])


def _arrow(turn: pa.DataType) -> pa.Schema:
    numbers = [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "turns")]
    return pa.schema([*_VECTORS, *[pa.field(*x) for x in numbers], pa.field("first", pa.string()), pa.field("last", pa.string()), pa.field("low", turn), pa.field("high", turn)])


def _batch(rows: list[tuple], conversation: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", *[part.split()[0] for part in _RESULT.split(", ")]]
    kinds = [conversation, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)


def repair_damaged(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The repair of conversations after ``damage``."""
    return repair(damage(rows), parts)
