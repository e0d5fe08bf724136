"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, found by iterative-deepening A*.

A conversation is its rows' codes, one byte a row: the initial of the role and whether the
row must go or is cut off.  The search goes depth first through the edits in ASCII order
(D, I, K, R) under a cost bound that grows by one, and remembers for each place and state
the largest rest of the bound with which it failed; the first accepting path is the
cheapest and, among those, the least in ASCII order.

Conversations longer than PIECE rows are searched piece by piece: exact costs from each
state at a piece's end tell the search what lies behind it, so a piece's first accepting
path belongs to the answer.  Conversations of more than LONG rows or CHARS characters are
never gathered: their rows are placed by distributed prefix sums and their segments are
summed up and searched by different tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.llm.common import saved, small, table
from vitalis.operators.ordering import prefix_sums

#: Costs of the edits, and of a cut-off row that stays.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: Initials in a row's code; GONE marks rows to delete, OFF rows that are cut off.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
GONE, OFF = 4, 8
#: The state is the last initial (none: OTHER); what may follow it, and the states that may end.
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (OTHER, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
NEVER = 1 << 60
#: Rows searched at once; rows and characters up to which a conversation is taken by one task; rows of a segment beyond it.
PIECE = 32
LONG = 4096
CHARS = 1 << 24
SEGMENT = 4096
#: Code strings whose answer a worker remembers.
REMEMBER = 100_000


def _after(state: int, cls: int) -> int | None:
    """The state after a kept row, None if it can't stand there."""
    if cls == SYSTEM:
        return SYSTEM if state == OTHER else None
    return cls if cls and NEXT[state] == cls else None


def _inserted(cost: list[int]) -> list[int]:
    """Costs from each state when rows may be inserted first."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    return cost


def costs(codes: bytes, ends: list[int] | None) -> list[int]:
    """Least cost from each state before the rows: to the end, or (with ``ends``) to what each state after the last row costs."""
    cost = _inserted([0 if q in ENDS else NEVER for q in range(4)]) if ends is None else list(ends)
    for code in reversed(codes):
        cls, off = code & 3, CUT_OFF if code & OFF else 0
        new = [DELETE + c for c in cost]
        if not code & GONE:
            for q in range(4):
                kept = _after(q, cls)
                if kept is not None:
                    new[q] = min(new[q], cost[kept] + off)
                new[q] = min(new[q], REROLE + off + cost[NEXT[q]])
        cost = _inserted(new)
    return [min(c, NEVER) for c in cost]


def _least(codes: bytes) -> list[tuple[int, int]]:
    """A lower bound of the cost of the rows from each place on, at the start and after it."""
    out = [(0, 0)]
    for code in reversed(codes):
        off = CUT_OFF if code & OFF else 0
        if code & GONE:
            first = later = DELETE
        else:
            rerole = min(DELETE, REROLE + off)
            later = off if code & 3 in (USER, ASSISTANT) else rerole
            first = off if code & 3 else rerole
        out.append((first + out[-1][0], later + out[-1][1]))
    return out[::-1]


def _search(codes: bytes, start: int, ends: list[int] | None) -> str:
    """The least cheapest edits of at most PIECE rows from a state.  With ``ends`` the path stops after the last row."""
    n, least = len(codes), _least(codes)
    behind = 0 if ends is None else min(ends)
    failed: dict[tuple[int, int], int] = {}

    def go(i: int, q: int, left: int) -> str | None:
        if i == n:
            if ends is not None:
                return "" if ends[q] <= left else None
            if q in ENDS:
                return "" if left >= 0 else None
        if left < least[i][q != OTHER] + behind or failed.get((i, q), -1) >= left:
            return None
        if i < n:
            rest = go(i + 1, q, left - DELETE)
            if rest is not None:
                return "D" + rest
        rest = go(i, NEXT[q], left - INSERT)
        if rest is not None:
            return "I" + rest
        if i < n and not codes[i] & GONE:
            off = CUT_OFF if codes[i] & OFF else 0
            kept = _after(q, codes[i] & 3)
            rest = go(i + 1, kept, left - off) if kept is not None else None
            if rest is not None:
                return "K" + rest
            rest = go(i + 1, NEXT[q], left - REROLE - off)
            if rest is not None:
                return "R" + rest
        failed[i, q] = left
        return None

    bound = least[0][start != OTHER] + behind
    while (path := go(0, start, bound)) is None:
        bound += 1
    return path


def replay(codes: bytes, audit: str, state: int = OTHER) -> Iterator[tuple[int, int | None, int]]:
    """(row or -1, new role or None, state) of every row that the edits leave or insert."""
    i = 0
    for e in audit:
        if e != "D":
            state = _after(state, codes[i] & 3) if e == "K" else NEXT[state]
            yield -1 if e == "I" else i, None if e == "K" else state, state
        i += e != "I"


def solve(codes: bytes, state: int = OTHER, ends: list[int] | None = None) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of a conversation's or a segment's rows."""
    cuts = list(range(0, len(codes), PIECE)) or [0]
    behind: list[list[int] | None] = [ends]
    for c in reversed(cuts[1:]):
        behind.append(costs(codes[c : c + PIECE], behind[-1]))
    path = []
    at = state
    for c in cuts:
        piece = codes[c : c + PIECE]
        path.append(_search(piece, at, behind.pop()))
        for _, _, q in replay(piece, path[-1], at):
            at = q
    audit = "".join(path)
    return _cost(codes, audit), audit, at


def _cost(codes: bytes, audit: str) -> int:
    total = i = 0
    for e in audit:
        if e == "I":
            total += INSERT
            continue
        total += DELETE if e == "D" else (REROLE if e == "R" else 0) + (CUT_OFF if codes[i] & OFF else 0)
        i += 1
    return total


def _prepared(rows: DataFrame) -> DataFrame:
    """conv_id, ck (its text, null apart), turn, role, text, code (without duplicates), gone."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    cls = F.when(role.startswith("s"), SYSTEM).when(role.startswith("u"), USER).when(role.startswith("a"), ASSISTANT).otherwise(OTHER)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    whole = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    code = cls + F.when(blank, GONE).when(~whole, OFF).otherwise(0)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    ck = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return rows.select("conv_id", ck.alias("ck"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), code.cast("int").alias("code"), gone.alias("gone"))


def _batches(rows: Iterator[tuple], types: list, names: list[str], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _conversations(batches: Iterator[pa.RecordBatch], note: Callable[[pa.DataType], None]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows that are there) of rows sorted by conversation."""
    key, conv, rows = None, None, []
    for b in batches:
        note(b.column(0).type)
        for c, k, *row, gone in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if k != key:
                if key is not None:
                    yield conv, rows
                key, conv, rows = k, c, []
            if not gone:
                rows.append(row)
    if key is not None:
        yield conv, rows


def _coded(rows: list[tuple]) -> tuple[bytes, list[int]]:
    """Codes of (turn, role, text, code) in order, and the numbers of blank, duplicate and cut-off rows."""
    seen, codes, n = set(), bytearray(), [0, 0, 0]
    for _, role, text, code in rows:
        if code & GONE:
            n[0] += 1
        elif (role, text) in seen:
            code = code & 3 | GONE
            n[1] += 1
        elif code & OFF:
            n[2] += 1
        seen.add((role, text))
        codes.append(code)
    return bytes(codes), n


def _illegal(codes: bytes) -> int:
    return sum((x & 3, y & 3) not in LEGAL for x, y in zip(codes, codes[1:], strict=False))


def _gaps(turns: list[int | None]) -> int:
    t = {x for x in turns if x is not None}
    return max(t) - min(t) + 1 - len(t) if t else 0


def _run(texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Summaries of whole conversations, or (``texts``) their repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = [None]
        known: dict[bytes, tuple[int, str, int]] = {}

        def note(kind: pa.DataType) -> None:
            types[0] = kind

        def out() -> Iterator[tuple]:
            for conv, rows in _conversations(batches, note):
                codes, n = _coded(rows)
                if codes not in known:
                    if len(known) > REMEMBER:
                        known.clear()
                    known[codes] = solve(codes)
                cost, audit, _ = known[codes]
                left = [(rows[i][1] if i >= 0 and role is None else ROLE[role], rows[i][2] if i >= 0 else "") for i, role, _ in replay(codes, audit)]
                if texts:
                    yield from ((conv, k, *r) for k, r in enumerate(left))
                else:
                    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode("utf-8", "surrogatepass")).hexdigest()
                    yield conv, _gaps([r[0] for r in rows]), *n, _illegal(codes), cost, audit, sha

        if texts:
            types += [pa.int64(), pa.string(), pa.string()]
            yield from _batches(out(), types, ["conv_id", "place", "role", "text"])
        else:
            types += [pa.int64()] * 6 + [pa.string()] * 2
            yield from _batches(out(), types, ["conv_id", *_SUMS, "audit", "repaired_sha256"])

    return run


_SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _long_keys(p: DataFrame, long: int, chars: int) -> DataFrame | None:
    n = p.groupBy("ck").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    keys = saved(n.where((F.col("n") > long) | (F.col("c") > chars)).select("ck"), "long")
    return keys if keys.limit(1).count() else None


class _LongRepair:
    """Conversations that no task gathers, by segments."""

    def __init__(self, p: DataFrame, segment: int) -> None:
        self.size = segment
        there = p.where(~F.col("gone")).withColumn("tset", F.col("turn").isNotNull().cast("int")).withColumn("tval", F.coalesce("turn", F.lit(0)))
        rows = saved(there.groupBy("ck", "tset", "tval", "role", "text").agg(F.count(F.lit(1)).alias("m"), F.first("code").alias("code")), "rows")
        first = saved(rows.groupBy("ck", "role", "text").agg(F.min(F.struct("tset", "tval")).alias("f")), "first")
        rows = rows.join(first, ["ck", "role", "text"]).withColumn("lead", (F.col("f.tset") == F.col("tset")) & (F.col("f.tval") == F.col("tval"))).drop("f")
        put = prefix_sums(rows, [F.col(c) for c in ("ck", "tset", "tval", "role", "text")], ["m"])
        start = put.groupBy("ck").agg(F.min("m_before").alias("start"))
        self.put = saved(put.join(start, "ck").withColumn("pos", (F.col("m_before") - F.col("start")).cast("long")).drop("m_before", "start"), "placed")
        self.ids = saved(p.select("ck", "conv_id").distinct(), "ids")
        self._segments()
        self._chained()

    def _segments(self) -> None:
        n = self.size
        end = F.col("pos") + F.col("m")
        r = self.put.select("ck", "pos", "m", "code", "lead", F.explode(F.sequence(F.floor(F.col("pos") / n), F.floor((end - 1) / n))).alias("seg"))
        begin = F.greatest(F.col("pos"), F.col("seg") * n)
        rest = F.col("code").bitwiseAND(3) + GONE
        head = F.when(F.col("lead") & (F.col("pos") >= F.col("seg") * n), F.col("code")).otherwise(rest)
        run = F.struct((begin - F.col("seg") * n).alias("at"), (F.least(end, (F.col("seg") + 1) * n) - begin).alias("n"), head.alias("head"), rest.alias("rest"))
        groups = r.groupBy("ck", "seg").agg(F.sort_array(F.collect_list(run)).alias("runs"))  # a segment's runs: its rows at most

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = [b"".join(bytes([x["head"]]) + bytes([x["rest"]]) * (x["n"] - 1) for x in runs) for runs in b.column(2).to_pylist()]
                sums = [[c for q in range(4) for c in costs(s, [0 if q == e else NEVER for e in range(4)])] + costs(s, None) for s in codes]
                cols = [b.column(0), b.column(1), pa.array(codes, pa.binary()), pa.array(sums, pa.list_(pa.int64())), pa.array(map(_illegal, codes), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["ck", "seg", "codes", "sums", "illegal"])

        # sums: for each state after the rows, the cost from each state before them; then the costs to the end
        self.segments = saved(groups.mapInArrow(coded, "ck string, seg long, codes binary, sums array<long>, illegal long"), "segments")

    def _streamed(self, df: DataFrame, order: list[Column], step: Callable, schema: str) -> DataFrame:
        """Rows of each conversation in order through ``step(rows)``: a few numbers a segment, nothing is gathered."""
        names = [f.name for f in T._parse_datatype_string(schema).fields]
        types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
        kinds = [types[f.dataType.simpleString()] for f in T._parse_datatype_string(schema).fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(step(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True)), kinds, names)

        return saved(df.repartition("ck").sortWithinPartitions("ck", *order).mapInArrow(run, schema), "streamed")

    def _chained(self) -> None:
        def backward(rows: Iterator[tuple]) -> Iterator[tuple]:
            key, ends, after = None, None, 0
            for ck, seg, sums, illegal, head, tail in rows:
                if ck != key:
                    key, ends, after = ck, None, None
                pair = 0 if after is None else (tail, after) not in LEGAL
                yield ck, seg, ends, illegal + pair, (cost := sums[16:] if ends is None else [min(min(sums[4 * e + q] + ends[e] for e in range(4)), NEVER) for q in range(4)])[OTHER]
                ends, after = cost, head

        s = self.segments.select("ck", "seg", "sums", "illegal", *[F.conv(F.hex(F.substring("codes", i, 1)), 16, 10).cast("int").bitwiseAND(3).alias(n) for i, n in ((1, "head"), (-1, "tail"))])
        ends = self._streamed(s, [F.col("seg").desc()], backward, "ck string, seg long, ends array<long>, illegal long, cost long")
        self.ends = ends

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [[solve(c, q, e) for q in range(4)] for c, e in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                cols = [b.column(0), b.column(1), b.column(2), pa.array([[x[1] for x in g] for g in got], pa.list_(pa.string())), pa.array([[x[2] for x in g] for g in got], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["ck", "seg", "codes", "audits", "states"])

        found = saved(self.segments.select("ck", "seg", "codes").join(ends.select("ck", "seg", "ends"), ["ck", "seg"]).mapInArrow(searched, "ck string, seg long, codes binary, audits array<string>, states array<long>"), "searched")

        def forward(rows: Iterator[tuple]) -> Iterator[tuple]:
            key, state = None, OTHER
            for ck, seg, states in rows:
                if ck != key:
                    key, state = ck, OTHER
                yield ck, seg, state
                state = states[state]

        begin = self._streamed(found.select("ck", "seg", "states"), [F.col("seg")], forward, "ck string, seg long, state long")
        self.audits = saved(found.join(begin, ["ck", "seg"]).select("ck", "seg", "codes", "state", F.element_at("audits", (F.col("state") + 1).cast("int")).alias("audit")), "audits")

    def rows(self) -> DataFrame:
        """(ck, seg, k, role, text) of the repaired conversations."""

        def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> Iterator[tuple]:
                for b in batches:
                    for ck, seg, codes, state, audit in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                        for k, (i, role, _) in enumerate(replay(codes, audit, state)):
                            yield ck, seg, k, i, None if role is None else ROLE[role]

            yield from _batches(out(), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()], ["ck", "seg", "k", "at", "new"])

        e = self.audits.mapInArrow(edited, "ck string, seg long, k long, at long, new string")
        own = self.put.where("lead").select("ck", F.floor(F.col("pos") / self.size).alias("seg"), F.pmod("pos", F.lit(self.size)).alias("at"), "role", "text")
        j = e.join(own, ["ck", "seg", "at"], "left")
        return j.select("ck", "seg", "k", F.coalesce("new", "role").alias("role"), F.when(F.col("at") >= 0, F.col("text")).otherwise("").alias("text"))

    def summaries(self) -> DataFrame:
        blank = F.col("code").bitwiseAND(GONE) != 0
        m, lead = F.col("m"), F.col("lead").cast("long")
        faults = self.put.groupBy("ck").agg(
            F.sum(F.when(blank, m).otherwise(0)).alias("blank"),
            F.sum(F.when(blank, 0).otherwise(m - lead)).alias("duplicate"),
            F.sum(F.when((F.col("code").bitwiseAND(OFF) != 0), lead).otherwise(0)).alias("truncated"),
        )
        turns = self.put.where("tset = 1").select("ck", "tval").distinct().groupBy("ck").agg((F.max("tval") - F.min("tval") + 1 - F.count(F.lit(1))).alias("gaps"))
        ends = self.ends.groupBy("ck").agg(F.sum("illegal").alias("illegal"), F.max(F.when(F.col("seg") == 0, F.col("cost"))).alias("cost"))
        audit = self.audits.groupBy("ck").agg(F.sort_array(F.collect_list(F.struct("seg", "audit"))).alias("a")).select("ck", F.array_join(F.col("a.audit"), "").alias("audit"))

        def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
            key, sha = None, hashlib.sha256()
            for ck, _, _, role, text in rows:
                if ck != key:
                    if key is not None:
                        yield key, sha.hexdigest()
                    key, sha = ck, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if key is not None:
                yield key, sha.hexdigest()

        shas = self._streamed(self.rows(), [F.col("seg"), F.col("k")], digest, "ck string, repaired_sha256 string")
        j = self.ids
        for f in (faults, turns, ends, audit, shas):
            j = j.join(f, "ck", "left")
        none = hashlib.sha256().hexdigest()
        return j.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _SUMS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def _split(rows: DataFrame, long: int, chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Prepared rows of the conversations that one task takes, sorted by conversation, and those of the others."""
    p = _prepared(rows)
    keys = _long_keys(p, long, chars)
    few = p if keys is None else p.join(small(keys), "ck", "left_anti").select(*p.columns)
    few = few.repartition("ck").sortWithinPartitions("ck", "gone", F.col("turn").asc_nulls_first(), "role", "text")
    return few, None if keys is None else saved(p.join(small(keys), "ck", "left_semi").select(*p.columns), "long-rows")


def repair(rows: DataFrame, long: int = LONG, chars: int = CHARS, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): its faults, cheapest edits and the repaired text's digest.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows stand by turn (nulls first), then role and text, so ties and repeated rows have
    one order.  A null role or text is one space, a null conv_id a conversation of its
    own; a role that begins with another letter than s, u or a (or is empty) can't be
    kept.  A boolean column ``gone`` marks rows that are not there: a conversation
    without other rows has zeros, an empty audit and the empty string's hash.  Other
    columns are not read; no row gives no conversation.
    """
    few, many = _split(rows, long, chars)
    id_type = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    schema = T.StructType([id_type, *[T.StructField(c, T.LongType()) for c in _SUMS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    out = few.mapInArrow(_run(False), schema)
    return out if many is None else out.unionByName(_LongRepair(many, segment).summaries())


def repaired_rows(rows: DataFrame, long: int = LONG, chars: int = CHARS, segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0; long conversations have larger steps), role, text."""
    few, many = _split(rows, long, chars)
    id_type = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    schema = T.StructType([id_type, T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    out = few.mapInArrow(_run(True), schema)
    if many is None:
        return out
    r = _LongRepair(many, segment)
    # a segment's rows and the rows inserted among them: at most three a row and two at the end
    place = F.col("seg") * (3 * segment + 2) + F.col("k")
    return out.unionByName(r.rows().join(r.ids, "ck").select("conv_id", place.alias("place"), "role", "text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with seeded faults by crc32 of ``conv_id:turn`` (null: a space) modulo 20: 0 drops the row (``gone``),
    1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user; a null role or text is a space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    r = r.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return r.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation after damage."""
    return repair(damaged(table(spark, sf_dir, "conversations")))
