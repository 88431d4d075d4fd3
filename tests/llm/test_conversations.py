"""Conversation repair against a plain search over all edits, and a plain version over whole tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from plumbspark.llm import conversation_repair as C
from plumbspark.llm.queries import QUERIES

WHITE = " \t\n\v\f\r"
GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, there string, part string, summary string, audit string"


def cheapest(marked):
    """Least (cost, audit, roles) over an automaton of positions and role strings' ends, by a heap."""
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, end, roles = heapq.heappop(heap)
        if (i, end) in done:
            continue
        done.add((i, end))
        if i == len(marked) and end in ("", "a"):
            return cost, audit, roles
        for r in moves[end]:
            if r != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, roles + ((r, None),)))
        if i < len(marked):
            initial, fault = marked[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, end, roles))
            if fault not in ("blank", "duplicate"):
                more = cost + 5 * (fault == "truncated")
                if initial and initial in moves[end]:
                    heapq.heappush(heap, (more, audit + "K", i + 1, initial, roles + ((None, i),)))
                for r in moves[end]:
                    if r != "s":
                        heapq.heappush(heap, (more + 1, audit + "R", i + 1, r, roles + ((r, i),)))


def exhaustive(marked, inserts=3):
    """The same by writing down every sequence of edits with few inserts."""
    best = None
    for edits in itertools.product("DKR", repeat=len(marked)):
        for k in range(inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(marked) + 1), k):
                audit = "".join("I" * places.count(i) + (edits[i] if i < len(marked) else "") for i in range(len(marked) + 1))
                rows, cost, choices = iter(marked), 0, []
                for e in audit:
                    initial, fault = (None, None) if e == "I" else next(rows)
                    if e in "KR" and fault in ("blank", "duplicate"):
                        break
                    cost += {"I": 5, "D": 2, "K": 0, "R": 1}[e] + 5 * (e in "KR" and fault == "truncated")
                    choices.append([""] if e == "D" else [initial] if e == "K" else ["u", "a"])
                else:
                    if any(GOOD.fullmatch("".join(c)) for c in itertools.product(*choices)):
                        best = min(best or (cost, audit), (cost, audit))
    return best


def plain(rows, spoil=True):
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        named = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(named).encode()) % 20 if spoil else 9
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, turns in convs.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
        seen, marked = set(), []
        for _, role, text in turns:
            left = text.strip(WHITE)
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role[:1], fault))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, roles = cheapest(marked)
        said = [(turns[i][1] if r is None else {"u": "user", "a": "assistant"}[r]) + ":" + ("" if i is None else turns[i][2]) for r, i in roles]
        faults = [sum(f == name for _, f in marked) for name in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_parser_finds_the_cheapest_edits():
    draw = random.Random(5)
    codes = {"": C.KEEP, "blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.CUT}
    for _ in range(150):
        marked = [(draw.choice("suaaux"), draw.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(draw.randint(0, 4))]
        got = C.cheapest(C.parse([(i, codes[f]) for i, f in marked]))
        assert got == exhaustive(marked) == cheapest(marked)[:2], marked


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_query_equals_the_plain_version(spark, folder):
    path = f"/root/testdata/{folder}"
    out = QUERIES["op12_conversation_repair"](spark, path)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert out.columns == names and dict(out.dtypes)["cost"] == "bigint"
    given = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, out.collect()), key=repr) == plain(given)


ODD = [
    *[(1, t, r, x) for t, r, x in [(0, "system", "Be kind."), (1, "user", "Hi?"), (2, "assistant", "Yes."), (5, "assistant", "More.")]],
    *[(2, None, "user", "a."), (2, None, "user", "b."), (2, 3, None, "c."), (2, 3, "", None), (2, 4, "tool", "x ")],
    *[(3, t, "assistant", f"said {t}.") for t in range(30)],
    *[(4, t, "user", "same.") for t in range(10)],
    (5, 1, None, None),
    (6, 1, "system", "only."),
    (None, 1, "user", "no id."),
    (None, 2, "assistant", "no id either"),
    *[(None, None, None, None)] * 3,
    (7, 1, "user", "long " * 100_000 + "."),
    (7, 2, "assistant", "é" * 50_000),
    *[(8, t, draw, f"{t} ?") for t, draw in enumerate(random.Random(2).choices(["user", "assistant", "system"], k=300))],
    *[(9, t // 2, draw, text) for t, (draw, text) in enumerate(zip(random.Random(3).choices(["user", "assistant", "system", "usher", "x"], k=200), random.Random(4).choices(["Yes.", "No", " ", "So?", "Right!"], k=200)))],
]


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, *["x"] * 4) for r in rows], SCHEMA).repartition(3)


def settled(rows):
    """Without the conversations whose turns of equal number have no order that the plain version knows."""
    return [r for r in rows if r[0] not in (2, 9)]


def test_odd_conversations(table):
    rows = settled(ODD)
    got = C.summaries(C.repaired(C.damaged(table(rows))))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_segments_give_the_same(table, size, monkeypatch):
    monkeypatch.setattr(C, "FOLD", 4)
    whole = C.damaged(table(ODD)).cache()
    want = sorted(map(tuple, C.summaries(C.repaired(whole)).collect()), key=repr)
    got = C.summaries(C.repaired(whole, whole_rows=5, segment_rows=size))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    by_bytes = C.summaries(C.repaired(whole, whole_bytes=100, segment_rows=size, segment_bytes=10))
    assert sorted(map(tuple, by_bytes.collect()), key=repr) == want


def test_an_empty_table(table):
    assert C.summaries(C.repaired(C.damaged(table([])))).collect() == []


def test_repaired_turns_are_a_sentence(table):
    turns = C.repaired(C.damaged(table(ODD))).where("summary IS NULL").orderBy("conv_id", "part", "position").collect()
    for conv, group in itertools.groupby(turns, key=lambda r: r.conv_id):
        assert GOOD.fullmatch("".join(r.role[:1] for r in group)), conv
