"""Repair of the turn structure of conversations by bidirectional Dijkstra over an edit lattice.

A repaired conversation has the roles ``(s?(ua)+)?``: a system turn may come first, then user and assistant in turns.
Rows are kept (0), given another role (1), deleted (2), and empty turns are inserted (5); a row that is cut off and stays
costs 5 more; blank and repeated rows must go. Among the cheapest repairs the one whose edits, written as D, I, K and R
in order, are least in ASCII order is taken; that string fixes the repair, as the place in the pattern gives each role.

1. Rows become light items (conversation, turn, role, two hashes of the text, faults), equal ones counted together, and
   are sorted over all partitions. A conversation is cut into blocks of about BLOCK items where needed, so that one with a
   large share of all rows is many tasks.
2. A lattice node is a place between items and what the pattern has seen last. Two heaps grow from the start and from the
   ends; when their smallest costs exceed the best meeting, every edge at which a cheapest path crosses from one side to
   the other is known. The least string is then read off along cheapest edges: before the crossing those that lead to one,
   after it those that lower the remaining cost. A block of a long conversation is solved between all pairs of states; its
   16 costs, and ranks that stand for the strings, are joined to one path over the blocks.
3. Texts are shuffled once, by conversation, sorted with the strings of their blocks, and streamed: a task holds the edits
   of one conversation and one batch of texts. Only the hash of a repaired text is sequential, as it must be.

Defined cases: nulls are one space in the key of the damage, as roles and as texts; a null conv_id is a conversation of
its own; null turns come first and count in no gap; rows of one turn are ordered by role, then by the hash of the text;
equal rows repeat each other; an empty role fits nowhere; long texts and long conversations are streamed; extra columns are
ignored; an empty table gives an empty result. Texts are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm.catalogue import read, registered
from panelworks.scale import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
RETAG, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
# Items of a block; a longer conversation is solved block by block.
BLOCK = 4096

# What the pattern has seen last: nothing, system, user, assistant. A conversation may end after nothing or assistant.
START, S, U, A = range(4)
STATES, ENDS = range(4), (START, A)
KEPT = {("s", START): S, ("u", START): U, ("u", S): U, ("u", A): U, ("a", U): A}
# The state after a turn that is inserted or given a role, and the states before it.
NEXT = (U, U, A, U)
BEFORE = {U: (START, S, A), A: (U,), START: (), S: ()}
ROLE = {U: "user", A: "assistant"}
#: What is inserted at the very end.
TAIL = ("", "II", "I", "")

Item = tuple[str, bool, bool, int]  # initial, must go, cut off, times

_KEY = ("conv_id", "turn", "role", "h1", "h2")
_STATS = "rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long"
_STAT_NAMES = tuple(part.split()[0] for part in _STATS.split(", "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as the damage leaves them; copies is 0 for a dropped row."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), fate.alias("fate")).select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def _items(rows: DataFrame) -> DataFrame:
    """Equal rows once: the key, faults, how often, and whether an earlier turn has the same role and text."""
    end = F.rtrim("text", F.lit(WHITE))
    told = rows.filter("copies > 0").select(
        "conv_id", "turn", "role", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"),
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies",
    )
    same = cut_lineage(told.groupBy(*_KEY, "blank", "truncated").agg(F.sum("copies").alias("copies")), "repair-items")
    # A struct holds a null turn, the smallest one; a plain minimum would pass it over.
    first = same.filter("not blank").groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h1").alias("x"), F.col("h2").alias("y"), "first")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y"))
    later = ~F.col("blank") & F.col("first").isNotNull() & (F.struct("turn") > F.col("first"))
    return same.join(first, on, "left").select(*_KEY, "blank", "truncated", "copies", later.alias("later"))


def _edges(items: list[Item], i: int, q: int, tail: bool) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, place, state) after each edit."""
    if i < len(items) or tail:
        yield "I", INSERT, i, NEXT[q]
    if i < len(items):
        initial, gone, cut, times = items[i]
        yield "D", DELETE * times, i + 1, q
        if not gone:
            more = CUT_OFF if cut else 0
            if (after := KEPT.get((initial, q))) is not None:
                yield "K", more, i + 1, after
            yield "R", RETAG + more, i + 1, NEXT[q]


def _edges_back(items: list[Item], i: int, q: int, tail: bool) -> Iterator[tuple[int, int, int]]:
    """(cost, place, state) before each edit that leads here."""
    if i < len(items) or tail:
        for p in BEFORE[q]:
            yield INSERT, i, p
    if i:
        initial, gone, cut, times = items[i - 1]
        yield DELETE * times, i - 1, q
        if not gone:
            more = CUT_OFF if cut else 0
            for p in BEFORE[q]:
                yield RETAG + more, i - 1, p
            for p in STATES:
                if KEPT.get((initial, p)) == q:
                    yield more, i - 1, p


def cheapest(items: list[Item], start: int, ends: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """Cost and least string of edits from state ``start`` to one of ``ends``; tail: turns may be inserted at the end."""
    n = len(items)
    reached: tuple[dict, dict] = ({(0, start): 0}, {(n, q): 0 for q in ends})
    done: tuple[dict, dict] = ({}, {})
    heaps = ([(0, 0, start)], [(0, -n, q) for q in ends])
    best = None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, i, q = heappop(heaps[side])
        i = abs(i)
        if (i, q) in done[side]:
            continue
        done[side][i, q] = cost
        if side == 0:
            steps = ((w, j, p) for _, w, j, p in _edges(items, i, q, tail))
        else:
            steps = _edges_back(items, i, q, tail)
        for w, j, p in steps:
            if cost + w < reached[side].get((j, p), cost + w + 1):
                reached[side][j, p] = cost + w
                heappush(heaps[side], (cost + w, j if side == 0 else -j, p))
            if (other := reached[1 - side].get((j, p))) is not None and (best is None or cost + w + other < best):
                best = cost + w + other
        if (other := reached[1 - side].get((i, q))) is not None and (best is None or cost + other < best):
            best = cost + other
    if best is None:
        return None
    ahead, behind = done
    # Every cheapest path is done wholly from one side, or has an edge from a node done from the start to one done from the
    # ends; mark what leads to such edges, and to ends.
    crossed = lambda x, cost: (x[0] == n and x[1] in ends and cost == best) or any(behind.get((j, p), best + 1) + w + cost == best for _, w, j, p in _edges(items, *x, tail))
    leads = [x for x, cost in ahead.items() if crossed(x, cost)]
    marked = set(leads)
    while leads:
        x = leads.pop()
        for w, j, p in _edges_back(items, *x, tail):
            if (j, p) not in marked and ahead.get((j, p), -1 - w) + w == ahead[x]:
                marked.add((j, p))
                leads.append((j, p))
    letters, i, q, left = [], 0, start, best
    while left or i < n or q not in ends:
        # A letter leads to one node only, so that the least letter is the start of the least string.
        letter, w, i2, q2 = min(
            (e for e in _edges(items, i, q, tail) if behind.get((e[2], e[3])) == left - e[1] or ((e[2], e[3]) in marked and ahead[e[2], e[3]] == best - left + e[1])),
            key=lambda e: e[0],
        )
        letters.append(letter * items[i][3] if letter == "D" else letter)
        i, q, left = i2, q2, left - w
    return best, "".join(letters)


def over_blocks(blocks: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """The states before and after each block on the cheapest path; of equal costs the one of least rank, and so on.

    A block is given as 16 costs (-1: no way) and 16 ranks of its strings, of each state before to each after. No string of
    a block ends with an insertion, so of two strings from one state none is the beginning of the other.
    """
    left: list[dict[int, int]] = [{q: INSERT * len(TAIL[q]) for q in STATES}]
    for costs, _ in reversed(blocks):
        after = left[-1]
        ways = {p: [costs[4 * p + q] + after[q] for q in after if costs[4 * p + q] >= 0] for p in STATES}
        left.append({p: min(w) for p, w in ways.items() if w})
    left.reverse()
    state, path = START, []
    for k, (costs, ranks) in enumerate(blocks):
        fits = [q for q in left[k + 1] if costs[4 * state + q] >= 0 and costs[4 * state + q] + left[k + 1][q] == left[k][state]]
        after = min(fits, key=lambda q: ranks[4 * state + q])
        path.append((state, after))
        state = after
    return path


class _Block:
    """Items of one conversation in order, and what the counts need."""

    def __init__(self, key: tuple) -> None:
        self.key, self.items = key, []
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_role = self.last_role = None
        self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, blank: bool, cut: bool, later: bool, copies: int) -> None:
        initial = role[:1]
        spare = copies if blank or later else copies - 1
        self.blank += copies * blank
        self.duplicate += 0 if blank else spare
        if spare < copies:
            self.items.append((initial, False, cut, 1))
            self.truncated += cut
        if spare:
            self.items.append((initial, True, False, spare))
        self.illegal += copies - 1
        if self.rows:
            self.illegal += self.last_role + initial not in ("su", "ua", "au")
        else:
            self.first_role = initial
        self.last_role = initial
        self.rows += copies
        if turn is not None:
            self.turns += self.last_turn != turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def stats(self) -> dict:
        return {name: getattr(self, name) for name in _STAT_NAMES}


def _solved(items: DataFrame, size: int) -> DataFrame:
    """Blocks of sorted items with their strings: one for a conversation that lies within a partition, else all 16."""
    kind = dict(items.dtypes)["conv_id"]
    schema = f"conv_id {kind}, turn long, role string, h1 long, h2 long, pid int, block long, whole boolean, cost array<long>, rank array<int>, edits array<string>, {_STATS}"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict = {}
        out: list[dict] = []
        waiting: list[_Block] = []  # blocks of the conversation at hand
        inside, number, pid = False, 0, 0

        def finish(last: bool) -> None:
            nonlocal number, inside
            whole = inside and not last and len(waiting) == 1
            for b in waiting:
                if whole:
                    ways = [cheapest(b.items, START, ENDS, True)]
                else:
                    ways = [cheapest(b.items, p, (q,), False) for p in STATES for q in STATES]
                edits = [w[1] if w else None for w in ways]
                order = {e: k for k, e in enumerate(sorted({e for e in edits if e is not None}))}
                out.append(
                    dict(zip(_KEY, b.key, strict=True)) | b.stats()
                    | {"pid": pid, "block": number, "whole": whole, "cost": [w[0] if w else -1 for w in ways], "rank": [order.get(e, -1) for e in edits], "edits": edits}
                )
                number += 1
            waiting.clear()
            inside = True

        def emitted() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], types["conv_id"] if n == "conv_id" else _TYPES.get(n)) for n in names], names=names)
            out.clear()
            return rows

        for batch in batches:
            types["conv_id"] = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                pid = row["pid"]
                if waiting and waiting[-1].key[0] != row["conv_id"]:
                    finish(False)
                if not waiting or len(waiting[-1].items) >= size:
                    waiting.append(_Block(tuple(row[k] for k in _KEY)))
                waiting[-1].add(row["turn"], row["role"], row["blank"], row["truncated"], row["later"], row["copies"])
                if len(waiting) > 4:  # a long conversation: its blocks are solved as they come
                    inside, rest = False, waiting.pop()
                    finish(True)
                    inside = False
                    waiting.append(rest)
            if len(out) > 2000:
                yield emitted()
        if waiting:
            finish(True)
        if out:
            yield emitted()

    ordered = items.repartitionByRange(*(F.col(k) for k in _KEY)).sortWithinPartitions(*_KEY)
    return ordered.withColumn("pid", F.spark_partition_id()).mapInArrow(run, schema)


_TYPES = {
    "turn": pa.int64(), "role": pa.string(), "h1": pa.int64(), "h2": pa.int64(), "pid": pa.int32(), "block": pa.int64(), "whole": pa.bool_(),
    "cost": pa.list_(pa.int64()), "rank": pa.list_(pa.int32()), "edits": pa.list_(pa.string()),
    **{n: pa.string() if n.endswith("_role") else pa.int64() for n in _STAT_NAMES},
}


def _chosen(table: pa.Table) -> pa.Table:
    """The blocks of one conversation, a few numbers each, to the index of the string that each contributes."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["pid"], r["block"]))
    path = over_blocks([(r["cost"], r["rank"]) for r in rows])
    columns = {"pid": pa.int32(), "block": pa.int64(), "way": pa.int32(), "last": pa.bool_()}
    values = [(r["pid"], r["block"], 4 * p + q, r is rows[-1]) for r, (p, q) in zip(rows, path, strict=True)]
    return pa.table([pa.array([v[k] for v in values], t) for k, t in enumerate(columns.values())], names=list(columns))


def _strings(items: DataFrame, size: int) -> DataFrame:
    """(key of the first item, edits, cost, stats) of every block, with the end's insertions."""
    blocks = cut_lineage(_solved(items, size), "repair-blocks")
    keep = [*_KEY, *_STAT_NAMES]
    whole = blocks.filter("whole").select(*keep, F.col("edits")[0].alias("edits"), F.col("cost")[0].alias("cost"))
    parts = blocks.filter("not whole")
    ways = parts.select("conv_id", "pid", "block", "cost", "rank").groupBy("conv_id").applyInArrow(_chosen, "pid int, block long, way int, last boolean")
    tails = F.array(*(F.lit(t) for t in TAIL))
    tail = F.when(F.col("last"), F.get(tails, F.col("way") % 4)).otherwise(F.lit(""))
    joined = parts.join(ways, ["pid", "block"]).select(
        *keep, F.concat(F.get("edits", F.col("way")), tail).alias("edits"), (F.get("cost", F.col("way")) + INSERT * F.length(tail)).alias("cost")
    )
    return whole.unionByName(joined)


class _Repaired:
    """One conversation as its rows stream by."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.parts, self.queue, self.at = conv_id, [], "", 0
        self.state, self.hash, self.any = START, hashlib.sha256(), False
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
        self.first_turn = self.last_turn = self.last_role = None

    def edits(self, row: dict) -> None:
        self.parts.append(row["edits"])
        self.queue, self.at = self.queue[self.at :] + row["edits"], 0
        for name in self.sums:
            self.sums[name] += row[name]
        if self.last_role is not None:
            self.sums["illegal"] += self.last_role + row["first_role"] not in ("su", "ua", "au")
        self.last_role = row["last_role"]
        if row["first_turn"] is not None:
            self.sums["turns"] -= self.last_turn == row["first_turn"]
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]

    def write(self, role: str, text: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.any = True
        self.hash.update(role.encode())
        self.hash.update(b":")
        self.hash.update(text.encode())

    def insertions(self) -> None:
        while self.queue[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self.write(ROLE[self.state], "")

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.insertions()
            letter = self.queue[self.at]
            self.at += 1
            if letter == "K":
                self.state = KEPT[role[:1], self.state]
                self.write(role, text)
            elif letter == "R":
                self.state = NEXT[self.state]
                self.write(ROLE[self.state], text)

    def result(self) -> tuple:
        self.insertions()
        s = self.sums
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - s["turns"]
        return (self.conv_id, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(self.parts), self.hash.hexdigest())


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``rows`` (as ``damaged`` gives them): counts of faults, cost, audit, hash of the repaired text."""
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, key_type = None, [], None
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        out.append(now.result())
                    now = _Repaired(row["conv_id"])
                if row["kind"] == 0:
                    now.edits(row)
                else:
                    now.row(row["role"], row["text"], row["copies"])
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_out_types(key_type))], names=names)
                out = []
        if now is not None:
            out.append(now.result())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_out_types(key_type))], names=names)

    edits = _strings(_items(rows), block).select("*", F.lit(1).alias("lead"), F.lit(0).alias("kind"))
    stays = F.col("copies") > 0
    texts = rows.select(
        "conv_id", *(F.when(stays, c).alias(n) for n, c in (("turn", F.col("turn")), ("role", F.col("role")), ("h1", F.xxhash64("text")), ("h2", F.xxhash64("text", F.lit(1))), ("text", F.col("text")))),
        "copies", stays.cast("int").alias("lead"), F.lit(1).alias("kind"),
    )
    together = texts.unionByName(edits, allowMissingColumns=True)
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "lead", *_KEY[1:], "kind").mapInArrow(run, schema)


def _out_types(key_type: pa.DataType) -> list[pa.DataType]:
    return [key_type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]


@registered("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair(damaged(read(spark, folder, "conversations")))
