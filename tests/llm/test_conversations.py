"""Repair of conversations against plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from panelworks.llm.conversation_repair import cheapest, damaged, repair

COLUMNS = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """What the contract does to each row."""
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def best_edits(items):
    """Least (cost, audit, roles and rows) over all edit strings, by recursion over places and roles so far."""

    @lru_cache(None)
    def rest(i, seen, spare):
        # seen: initial of the last role; spare: insertions that may follow here.
        found = []
        if i == len(items) and seen in ("", "a"):
            found.append((0, "", ()))
        free = {"": "su", "s": "u", "u": "a", "a": "u"}[seen]
        if spare:
            for r in free.replace("s", ""):
                found += [(c + 5, "I" + a, ((r, None),) + o) for c, a, o in [rest(i, r, spare - 1)] if c < 1e9]
        if i < len(items):
            initial, gone, cut = items[i]
            found += [(c + 2, "D" + a, o) for c, a, o in [rest(i + 1, seen, 2)]]
            if not gone:
                if initial and initial in free:
                    found += [(c + 5 * cut, "K" + a, ((initial, i),) + o) for c, a, o in [rest(i + 1, initial, 2)]]
                for r in free.replace("s", ""):
                    found += [(c + 1 + 5 * cut, "R" + a, ((r, i),) + o) for c, a, o in [rest(i + 1, r, 2)]]
        return min(found, key=lambda f: f[:2], default=(1e9, "", ()))

    return rest(0, "", 2)


def expected(rows):
    """One line of the result for the rows of one conversation, in order after damage."""
    items, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        items.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {r[1] for r in rows if r[1] is not None}
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(items, items[1:], strict=False))
    cost, audit, kept = best_edits(tuple(items))
    assert GOOD.fullmatch("".join(r for r, _ in kept))
    lines, names = [], {"u": "user", "a": "assistant"}
    letters = [x for x in audit if x != "D"]
    for letter, (r, i) in zip(letters, kept, strict=True):
        lines.append(f"{names[r]}:" if i is None else f"{rows[i][2] if letter == 'K' else names[r]}:{rows[i][3]}")
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_rows(seed, conversations):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello.", "Why?", "cut off", "", " \n", None, "Yes!", "a.b", f"{turn} ünï.", "Long. " * 50])
            rows.append((c, None if rng.random() < 0.05 else turn, role, text))
    return rows


def check(spark, rows, **options):
    found = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in repair(damaged(spark.createDataFrame(rows, COLUMNS)), **options).collect()}
    assert set(found) == {r[0] for r in rows}
    after = damage(rows)
    for conv in found:
        own = [r for r in after if r[0] == conv]
        order = lambda r: (r[1] is not None, r[1] or 0, r[2])
        assert found[conv] == expected(sorted(own, key=order)), (conv, own)


def one_text_a_place(rows):
    """Rows without two texts of equal turn and role, whose order is by hash."""
    return list({(r[0], r[1], " " if r[2] is None else r[2]): r for r in rows}.values())


def test_least_edits_against_recursion():
    rng = random.Random(3)
    for _ in range(400):
        items = tuple((rng.choice(["s", "u", "a", "x", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9)))
        items = tuple((i, g, c and not g) for i, g, c in items)
        cost, audit, _ = best_edits(items)
        assert cheapest([(*i, 1) for i in items], 0, (0, 3), True) == (cost, audit)


def test_repair_against_plain_python(spark):
    check(spark, one_text_a_place(random_rows(1, 150)))


def test_blocks_give_what_whole_conversations_give(spark):
    rng = random.Random(8)
    rows = one_text_a_place(random_rows(2, 20))
    rows += [(500, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", "", "C?", f"{t}."])) for t in range(300)]
    check(spark, rows, block=7)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, 2, "user", "Same."), (1, 2, "user", "Same."), (1, 2, "user", "Same."), (1, 3, "assistant", "Ok."),
        (2, None, "system", "Be."), (2, None, "user", "Go."), (2, 7, "assistant", "x" * 3_000_000 + "."), (3, -4, "user", "Neg."), (3, 9, "assistant", "Far."),
    ]
    check(spark, rows)


def test_extra_columns_and_empty_tables(spark):
    rows = one_text_a_place(random_rows(4, 5))
    plain = spark.createDataFrame(rows, COLUMNS)
    wide = plain.select("*", F.lit(1).alias("copies"), F.lit("x").alias("kind"), F.lit(2).alias("h1"), F.lit(None).cast("string").alias("edits"))
    key = lambda df: sorted(map(tuple, repair(damaged(df)).collect()), key=repr)
    assert key(wide) == key(plain)
    assert repair(damaged(plain.limit(0))).count() == 0


@pytest.mark.parametrize("fate", range(5))
def test_each_damage_occurs(fate):
    assert any(zlib.crc32(f"{c}:{t}".encode()) % 20 == fate for c in range(150) for t in range(9))
