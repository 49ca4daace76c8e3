"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from locusmith.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, gaps string"


def damaged(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def expected(rows):
    """Counts, and the cheapest, ASCII-least edits by Dijkstra's search with whole audits as ties."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = roles[-1:]
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        word = {"u": "user", "a": "assistant"}
        for letter in follows.replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", i, letter, (*lines, word[letter] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, lines))
            if kinds[i] in ("", "truncated"):
                cut = 3 if kinds[i] else 0
                if role[:1] and role[:1] in follows:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for letter in follows.replace("s", ""):
                    heapq.heappush(heap, (cost + cut + 3, audit + "R", i + 1, letter, (*lines, f"{word[letter]}:{text}")))


def made(seed, sizes):
    rng, rows = random.Random(seed), []
    for conv, size in enumerate(sizes):
        turn = rng.randrange(3)
        for _ in range(size):
            turn += rng.choice((0, 1, 1, 1, 1, 3))
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "Umpire", "", None))
            text = rng.choice((f"Say {rng.randrange(9)}.", f"so {rng.randrange(40)}", "Why?", "  ", "", None, "x!\n ", f"Long {rng.randrange(10**6)}!"))
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text, "clash"))
    return rows


def test_steps_by_hand():
    row = lambda role, cut=False: (role[:1], cut, role, "t")
    costs = lambda *steps: cv.backward(list(steps), cv.END)[0][0]
    assert costs() == 0 and costs(row("user")) == 3 and costs(row("system")) == 4 and costs(row("user"), row("assistant")) == 0
    assert costs(row("user"), row("user")) == 3 and costs((5,)) == 20 and costs(row("user"), row("assistant", True)) == 3


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_rows_against_search(spark, parts):
    rows = made(parts, [0, 1, 2, 3, 5, 8, 13, 200, 1, 4, 60])
    rows += [(None, None, None, None, None)] + [(None, t, "user", "Again.", None) for t in range(30)] + [(50, 7, "user", "Same.", None)] * 40
    got = cv.repair_damaged(spark.createDataFrame(rows, SCHEMA), parts).collect()
    want = damaged(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == expected(want[r["conv_id"]]), r["conv_id"]


def test_shared_conversation_converges(spark):
    """One conversation over all tasks: speculative vectors that are wrong by more than a constant are mended."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"Line {t}.", None) for t in range(400)] + [(1, 1000 + t, "system", f"Rule {t}", None) for t in range(50)]
    for parts in (3, 25):
        got = cv.repair_damaged(spark.createDataFrame(rows, SCHEMA), parts).collect()
        assert [tuple(r)[1:] for r in got] == [expected(damaged(rows)[1])]


def test_empty_and_all_dropped(spark):
    assert cv.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = [(c, 0, "user", "Hi.", None) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = cv.repair_damaged(spark.createDataFrame(gone, SCHEMA)).collect()
    assert len(got) == len(gone) and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_refit_stops_at_a_constant():
    rng = random.Random(3)
    for _ in range(200):
        steps = [(rng.choice("suat"), rng.random() < 0.2, "r", "t") if rng.random() < 0.8 else (rng.randrange(1, 4),) for _ in range(rng.randrange(12))]
        end = tuple(rng.randrange(9) for _ in range(4))
        assert cv.refit(steps, cv.END, cv.backward(steps, cv.END)[0], end) == cv.backward(steps, end)[0]
