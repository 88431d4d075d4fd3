"""Repair of conversations by generalised LR parsing: the cheapest edits that make the roles a sentence.

Grammar of role initials: S -> (nothing) | P | s P, P -> u a | P u a. The parser keeps a graph-structured stack: tops
point at the stacks below them, which tops share. Every turn is shifted, reroled or deleted and turns are inserted
from every top; tops in the same state merge to the one with the least (cost, audit).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbspark.functions.sizes import broadcast_if_small
from plumbspark.llm.storage import written

WHITE = " \t\n\v\f\r"
ENDS = ".!?"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: The LR automaton. 0 start, 1 after s, 2 and 4 after P (alone, behind s), 3 after the first u, 5 after a later u;
#: 6 and 7 are reduced as soon as they are reached: three symbols of P u a, two of u a.
SHIFT = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 5, (4, "u"): 5, (3, "a"): 6, (5, "a"): 7}
POPS = {6: 2, 7: 3}
GOTO = {0: 2, 1: 4}
ACCEPT = (0, 2, 4)
#: A stack for each top from which what follows can be parsed; 4 goes on as 2 does.
STACKS = {0: None, 1: (0, None), 2: (0, None), 3: (0, None), 5: (2, (0, None))}

#: Conversations up to this size are parsed whole inside a task; longer ones in segments.
WHOLE_ROWS = 4096
WHOLE_BYTES = 16 << 20
SEGMENT_ROWS = 1024
RANGE_BYTES = 64 << 20
FOLD = 64

KEEP, BLANK, DUPLICATE, CUT = range(4)

_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LAST = (1 << 63) - 1

Tops = dict[int, tuple[int, str, tuple | None]]


def _offer(tops: Tops, state: int, cost: int, audit: str, below: tuple | None) -> bool:
    held = tops.get(state)
    if held is None or (cost, audit) < held[:2]:
        tops[state] = cost, audit, below
        return True
    return False


def _shift(tops: Tops, state: int, below: tuple | None, symbol: str, cost: int, audit: str) -> int | None:
    """Offers the top after ``symbol``, reduced; gives its state if it is new or cheaper."""
    to = SHIFT.get((state, symbol))
    if to is None:
        return None
    node = (to, (state, below))
    if to in POPS:
        for _ in range(POPS[to]):
            node = node[1]
        node = (GOTO[node[0]], node)
    return node[0] if _offer(tops, node[0], cost, audit, node[1]) else None


def _with_inserts(tops: Tops) -> Tops:
    work = list(tops)
    while work:
        state = work.pop()
        cost, audit, below = tops[state]
        for symbol in ROLES:
            changed = _shift(tops, state, below, symbol, cost + INSERT, audit + "I")
            if changed is not None:
                work.append(changed)
    return tops


def parse(turns: Iterable[tuple[str, int]], start: int = 0) -> Tops:
    """The tops after (role initial, fault) turns, from the stack of ``start``."""
    tops = _with_inserts({start: (0, "", STACKS[start])})
    for initial, fault in turns:
        after: Tops = {}
        for state, (cost, audit, below) in tops.items():
            _offer(after, state, cost + DELETE, audit + "D", below)
            if fault in (BLANK, DUPLICATE):
                continue
            more = cost + (TRUNCATED if fault == CUT else 0)
            _shift(after, state, below, initial, more, audit + "K")
            for symbol in ROLES:
                _shift(after, state, below, symbol, more + REROLE, audit + "R")
        tops = _with_inserts(after)
    return tops


def cheapest(tops: Tops) -> tuple[int, str]:
    return min(tops[s][:2] for s in ACCEPT if s in tops)


def repaired_roles(turns: Iterable[tuple[str, str]], audit: str, out: str = "") -> Iterator[tuple[str, str]]:
    """The (role, text) turns that ``audit`` makes; ``out``: the initial of the last turn that came before."""
    turns = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if out == "u" else "u"]
        out = role[:1]
        yield role, text


def fault_of(text: str) -> int:
    left = text.rstrip(WHITE)
    return BLANK if not left else KEEP if left[-1] in ENDS else CUT


class _Counts:
    """Counts over turns in order; two of them can be joined."""

    def __init__(self):
        self.faults = [0, 0, 0, 0]
        self.illegal, self.distinct = 0, 0
        self.low = self.high = None
        self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def row(self, cost: int, audit: str) -> dict:
        return dict(gaps=self.gaps(), blank=self.faults[BLANK], duplicate=self.faults[DUPLICATE],
                    truncated=self.faults[CUT], illegal=self.illegal, cost=cost, audit=audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): rows with planted faults, by crc32(``conv_id:turn``) modulo 20.

    0: the row goes (``there`` is false), 1: its text is empty, 2: it loses its ``.!?``, 3: it comes twice,
    4: its role is user. NULLs read as one space in the checksum and as role or text.
    """

    def read(c: str) -> Column:
        return F.coalesce(conversations[c].cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")) % 20
    rows = conversations.select(
        conversations["conv_id"].alias("conv_id"),
        conversations["turn"].cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(read("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(read("text"), ENDS, "")).otherwise(read("text")).alias("text"),
        (kind != 0).alias("there"),
        F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("times"),
    )
    return rows.withColumn("times", F.explode("times")).drop("times")


def _schema(rows: DataFrame) -> str:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return f"conv_id {kind}, part long, position long, role string, text string, summary struct<{_STATS.replace(' ', ':')}>".replace(",:", ",")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    summary = pa.struct([(p.split()[0], pa.string() if p.endswith("string") else pa.int64()) for p in _STATS.split(", ")])
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), summary]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "part", "position", "role", "text", "summary"])


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that fit a task: sorted by conversation and turn, parsed one after another."""

    def repaired(conv, turns) -> Iterator[tuple]:
        counts, seen, marked = _Counts(), set(), []
        for turn, role, text in turns:
            fault = fault_of(text)
            if fault != BLANK and (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
            counts.add(turn, role[:1], fault)
            marked.append((role[:1], fault))
        cost, audit = cheapest(parse(marked))
        for k, (role, text) in enumerate(repaired_roles(((r, t) for _, r, t in turns), audit)):
            yield conv, 0, k, role, text, None
        yield conv, _LAST, 0, None, None, counts.row(cost, audit)

    def run(batches):
        conv, turns, any_, kind = None, [], False, None
        for b in batches:
            kind, out = b.column("conv_id").type, []
            for c, turn, role, text, there in zip(*[b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "there")]):
                if any_ and c != conv:
                    out.extend(repaired(conv, turns))
                    turns = []
                conv, any_ = c, True
                if there:
                    turns.append((turn, role, text))
                if len(out) >= WHOLE_ROWS:
                    yield _batch(out, kind)
                    out = []
            if out:
                yield _batch(out, kind)
        if any_:
            yield _batch(list(repaired(conv, turns)), kind)

    ordered = rows.withColumn("order", F.xxhash64("text")).repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "order").drop("order")
    return ordered.mapInArrow(run, _schema(rows))


def _segments(rows: DataFrame, ranges: int, segment_rows: int, segment_bytes: int) -> DataFrame:
    """Long conversations' rows in order, numbered by segment and place in it, with their faults, written."""
    keyed = written(
        rows.select(
            "conv_id", "turn", "role", "text", F.xxhash64("text").alias("order"), F.sha2("text", 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "long-conversations",
    )
    first = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "row")).alias("first")
    firsts = keyed.groupBy("conv_id", "role", "digest").agg(first).select(F.col("first.row").alias("row"), F.lit(True).alias("new"))
    marked = keyed.join(firsts, "row", "left").select("conv_id", "turn", "role", "text", "order", "row", F.isnull("new").alias("again"))
    ranged = marked.repartitionByRange(ranges, "conv_id", "turn", "role", "order", "row")
    ranged = ranged.sortWithinPartitions("conv_id", "turn", "role", "order", "row")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def number(batches):
        from pyspark import TaskContext

        part, conv, held, size = TaskContext.get().partitionId() << 32, None, 0, 0
        for b in batches:
            parts, places, faults = [], [], []
            for c, text, again in zip(*[b.column(x).to_pylist() for x in ("conv_id", "text", "again")]):
                if (held and c != conv) or held >= segment_rows or size >= segment_bytes:
                    part, held, size = part + 1, 0, 0
                fault = fault_of(text)
                parts.append(part)
                places.append(held)
                faults.append(DUPLICATE if again and fault != BLANK else fault)
                conv, held, size = c, held + 1, size + len(text)
            arrays = [b.column("conv_id"), pa.array(parts, pa.int64()), pa.array(places, pa.int64()), b.column("turn")]
            arrays += [b.column("role"), b.column("text"), pa.array(faults, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "place", "turn", "role", "text", "fault"])

    out = f"conv_id {kind}, part long, place long, turn long, role string, text string, fault int"
    return written(ranged.mapInArrow(number, out), "conversation-segments")


_FOLDED = (
    "part long, parts array<long>, sizes array<long>, faults array<long>, illegal long, distinct long, low long, high long, "
    "opening string, closing string, paths array<struct<start:int,end:int,cost:long,audit:string>>"
)


def _class(state: int) -> int:
    return 2 if state == 4 else state


def _parsed(numbered: DataFrame) -> DataFrame:
    """A row for each segment: its counts, and the cheapest way from every top to every top."""
    kind = numbered.schema["conv_id"].dataType.simpleString()

    def parse_one(table: pa.Table) -> pa.Table:
        rows = table.select(["conv_id", "part", "turn", "role", "fault", "place"]).sort_by("place").to_pylist()
        counts, marked = _Counts(), [((r["role"] or "")[:1], r["fault"]) for r in rows]
        for r, (initial, fault) in zip(rows, marked):
            counts.add(r["turn"], initial, fault)
        paths = {}
        for start in STACKS:
            for state, (cost, audit, _) in parse(marked, start).items():
                key = start, _class(state)
                paths[key] = min(paths.get(key, (cost, audit)), (cost, audit))
        return _folded_table(rows[0]["conv_id"], rows[0]["part"], [rows[0]["part"]], [len(rows)], counts, paths, table.schema.field("conv_id").type)

    thin = numbered.select("conv_id", "part", "place", "turn", F.left("role", F.lit(1)).alias("role"), "fault")
    return thin.groupBy("conv_id", "part").applyInArrow(parse_one, f"conv_id {kind}, {_FOLDED}")


def _folded_table(conv, part, parts, sizes, c: _Counts, paths, kind) -> pa.Table:
    ways = [{"start": s, "end": e, "cost": cost, "audit": audit} for (s, e), (cost, audit) in paths.items()]
    way = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    longs = pa.list_(pa.int64())
    values = [(conv, kind), (part, pa.int64()), (parts, longs), (sizes, longs), (c.faults, longs), (c.illegal, pa.int64()),
              (c.distinct, pa.int64()), (c.low, pa.int64()), (c.high, pa.int64()), (c.first, pa.string()), (c.last, pa.string()),
              (ways, pa.list_(way))]
    names = ["conv_id", "part", "parts", "sizes", "faults", "illegal", "distinct", "low", "high", "opening", "closing", "paths"]
    return pa.table({n: pa.array([v], t) for n, (v, t) in zip(names, values)})


def _fold(table: pa.Table) -> pa.Table:
    """Neighbouring runs of segments as one."""
    rows = table.sort_by("part").to_pylist()
    counts, paths, parts, sizes = _Counts(), None, [], []
    for r in rows:
        parts += r["parts"]
        sizes += r["sizes"]
        counts.faults = [a + b for a, b in zip(counts.faults, r["faults"])]
        counts.illegal += r["illegal"] + (counts.last is not None and counts.last + r["opening"] not in LEGAL)
        counts.first = r["opening"] if counts.first is None else counts.first
        counts.last = r["closing"]
        if r["low"] is not None:
            counts.distinct += r["distinct"] - (r["low"] == counts.high)
            counts.low, counts.high = r["low"] if counts.low is None else counts.low, r["high"]
        own = {(w["start"], w["end"]): (w["cost"], w["audit"]) for w in r["paths"]}
        if paths is None:
            paths = own
            continue
        joined = {}
        for (a, m), (cost, audit) in paths.items():
            for (start, z), (more, rest) in own.items():
                if start == m:
                    way = cost + more, audit + rest
                    joined[a, z] = min(joined.get((a, z), way), way)
        paths = joined
    return _folded_table(rows[0]["conv_id"], rows[0]["part"], parts, sizes, counts, paths, table.schema.field("conv_id").type)


def _long(rows: DataFrame, ranges: int, segment_rows: int, segment_bytes: int) -> DataFrame:
    """Conversations of any length: segments are parsed side by side from every top, then folded in levels."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    numbered = _segments(rows, ranges, segment_rows, segment_bytes)
    folded = written(_parsed(numbered), "parsed-segments")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1
    while True:
        group = written(folded.select("conv_id", "part", F.floor(place / FOLD).alias("level")), "fold-groups")
        more = not group.where("level > 0").isEmpty()
        same = folded["conv_id"].eqNullSafe(group["conv_id"]) & (folded["part"] == group["part"])
        joined = folded.join(group, same).select(*[folded[c] for c in folded.columns], "level")
        folded = written(joined.groupBy("conv_id", "level").applyInArrow(_fold_leveled, folded.schema), "folded-segments")
        if not more:
            break

    def chosen(batches):
        for b in batches:
            for r in b.to_pylist():
                cost, audit = min((w["cost"], w["audit"]) for w in r["paths"] if w["start"] == 0 and w["end"] in ACCEPT)
                c = _Counts()
                c.faults, c.illegal, c.distinct, c.low, c.high = r["faults"], r["illegal"], r["distinct"], r["low"], r["high"]
                yield _batch([(r["conv_id"], _LAST, 0, None, None, c.row(cost, audit))], b.column("conv_id").type)

    def sliced(batches):
        """Each segment's part of the audit. Whether one turn is due as user or assistant follows from the number of
        turns before it, and whether the first of them is the system's."""
        for b in batches:
            for r in b.to_pylist():
                _, audit = min((w["cost"], w["audit"]) for w in r["paths"] if w["start"] == 0 and w["end"] in ACCEPT)
                edits, made, at, total = [], [], 0, 0
                for size in r["sizes"]:
                    start, left = at, size
                    while left:
                        left -= audit[at] != "I"
                        at += 1
                    made.append(total)
                    edits.append(audit[start:at])
                    total += len(edits[-1]) - edits[-1].count("D")
                edits[-1] += audit[at:]
                names = ["conv_id", "part", "audit", "made"]
                types = [b.column("conv_id").type, pa.int64(), pa.string(), pa.int64()]
                columns = [[r["conv_id"]] * len(edits), r["parts"], edits, made]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    slices = written(folded.mapInArrow(sliced, f"conv_id {kind}, part long, audit string, made long"), "audit-slices")
    # the first turn that stays says whether the system speaks first: then users follow an odd number of turns
    opened = _opening(numbered, slices)

    def repaired(segment: pa.Table, edits: pa.Table) -> pa.Table:
        rows_, own = segment.sort_by("place").to_pylist(), edits.to_pylist()[0]
        turns = ((r["role"], r["text"]) for r in rows_)
        before = own["made"] - own["system"]
        last = "" if own["made"] == 0 else "s" if before == 0 else "ua"[(before - 1) % 2]
        made = [(own["conv_id"], own["part"], k, role, text, None) for k, (role, text) in enumerate(repaired_roles(turns, own["audit"], last))]
        kind_ = segment.schema.field("conv_id").type
        return pa.Table.from_batches([_batch(made, kind_)] if made else [], schema=_batch([(None,) * 6], kind_).schema)

    texts = numbered.select("conv_id", "part", "place", "role", "text").groupBy("conv_id", "part")
    turns = texts.cogroup(opened.groupBy("conv_id", "part")).applyInArrow(repaired, _schema(rows))
    closing = folded.mapInArrow(chosen, _schema(rows))
    return turns.unionByName(closing).repartition("conv_id").sortWithinPartitions("conv_id", "part", "position")


def _fold_leveled(table: pa.Table) -> pa.Table:
    return _fold(table.drop_columns(["level"]))


def _opening(numbered: DataFrame, slices: DataFrame) -> DataFrame:
    """``slices`` with ``system``: 1 if the conversation's first repaired turn is a kept system turn."""
    kind = numbered.schema["conv_id"].dataType.simpleString()

    def first(segment: pa.Table, edits: pa.Table) -> pa.Table:
        own = edits.to_pylist()[0]
        roles = ((r["role"], "") for r in segment.sort_by("place").to_pylist())
        got = next(repaired_roles(roles, own["audit"]), ("", ""))[0][:1] == "s" if own["made"] == 0 else False
        return pa.table([edits.column("conv_id")[:1], pa.array([int(got)], pa.int64())], ["conv_id", "system"])

    thin = numbered.select("conv_id", "part", "place", F.left("role", F.lit(1)).alias("role")).groupBy("conv_id", "part")
    opens = thin.cogroup(slices.where("made = 0").groupBy("conv_id", "part"))

    def guarded(segment: pa.Table, edits: pa.Table) -> pa.Table:
        if not edits.num_rows:
            return pa.table([segment.column("conv_id")[:0], pa.array([], pa.int64())], ["conv_id", "system"])
        return first(segment, edits)

    found = opens.applyInArrow(guarded, f"conv_id {kind}, system long").groupBy("conv_id").agg(F.max("system").alias("system"))
    same = slices["conv_id"].eqNullSafe(found["conv_id"])
    return slices.join(found, same).select(*[slices[c] for c in slices.columns], "system")


def repaired(
    rows: DataFrame,
    whole_rows: int = WHOLE_ROWS,
    whole_bytes: int = WHOLE_BYTES,
    segment_rows: int = SEGMENT_ROWS,
    segment_bytes: int = WHOLE_BYTES // 2,
) -> DataFrame:
    """The repaired turns of every conversation, in order within a partition: (conv_id, part, position, role, text,
    summary); a last row with a NULL position's text and role and a ``summary`` closes each conversation.

    ``rows``: conv_id, turn, role, text, there; rows that aren't ``there`` only name their conversation. Turns go by
    number, NULL first, equal ones by role and a hash of the text. A NULL conv_id is a conversation as any other.
    NULL roles and texts read as one space. Repeated rows are duplicate turns. A conversation without rows is
    closed with zeros and an empty audit. An empty table gives no rows.

    Conversations of more than ``whole_rows`` rows or ``whole_bytes`` bytes are cut into segments that are parsed
    apart from every state the parser can be in; the same results, and no task holds more than a segment's texts.
    """
    blank = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), "there")
    sizes = rows.groupBy("conv_id").agg(F.count_if("there").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.where((F.col("n") > whole_rows) | (F.col("bytes") > whole_bytes)), "long-conversation-ids")
    size = long.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    if not size.n:
        return _whole(rows)
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.bytes // RANGE_BYTES))
    long = broadcast_if_small(long.select(F.col("conv_id").alias("id")))
    same = rows["conv_id"].eqNullSafe(long["id"])
    short = _whole(rows.join(long, same, "left_anti"))
    return short.unionByName(_long(rows.where("there").join(long, same, "left_semi"), ranges, segment_rows, segment_bytes))


def summaries(turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``repaired``: its counts, cost and audit, and the sha256 of its repaired
    ``role:text`` lines, which is taken up turn by turn."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        digest, lines = hashlib.sha256(), 0
        for b in batches:
            out = []
            for conv, role, text, summary in zip(*[b.column(n).to_pylist() for n in ("conv_id", "role", "text", "summary")]):
                if summary is None:
                    digest.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    lines += 1
                else:
                    out.append((conv, *summary.values(), digest.hexdigest()))
                    digest, lines = hashlib.sha256(), 0
            if out:
                types = [b.column("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(arrays, ["conv_id", *[p.split()[0] for p in _STATS.split(", ")], "repaired_sha256"])

    return turns.mapInArrow(run, f"conv_id {kind}, {_STATS}, repaired_sha256 string")
