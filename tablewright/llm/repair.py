"""Conversation repair: the cheapest edits that give a well-formed turn order.

A conversation of n rows spans a lattice of nodes (rows read, state), where the state is what the
output ends with: nothing, a system, a user or an assistant row. Keep, rerole and delete lead to
the next row, insert stays at the row. Two Dijkstra searches run over the lattice, from the start
and from the ends, each on its own heap; they stop when the sum of the heaps' least costs exceeds
the cheapest crossing, so all crossings of that cost are known, and the one with the least audit
is taken.

Least audits compose: two paths of equal cost between the same two nodes never spell one as the
beginning of the other (what the longer one had more would be inserts, which cost), so the order of
two audits stays the same whatever stands before or after them. Hence a long conversation is cut
into blocks of ``BLOCK`` rows, each solved for every pair of states at its borders, and the blocks
are joined two by two. Only narrow rows (number, initial, fault) go into the search; the texts meet
again when the digest of the repaired conversation is formed, one row at a time in sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import numbered, stored, table
from tablewright.llm.merkle import _CRC_TABLE, crc_sql

WORD_CHAR, END_CHAR = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: what the output ends with
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES, GOALS = (EMPTY, SYSTEM, USER, ASSISTANT), (EMPTY, ASSISTANT)
#: costs of the edits, and of leaving a truncated row
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: rows of a conversation that one search takes
BLOCK = 512
#: how a row is marked for the search: free of faults, cut short, or to be deleted
CLEAN, SHORT, GONE = range(3)
#: the state that follows a kept row of an initial
KEPT = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: the state that follows an inserted or renamed row
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BEFORE = {USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}

Label = tuple[int, str]
Row = tuple[str, int]


def row_edits(row: Row, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, next state) of the edits that take the row in a state."""
    initial, mark = row
    yield DELETE, "D", state
    if mark != GONE:
        extra = TRUNCATED if mark == SHORT else 0
        if (initial, state) in KEPT:
            yield extra, "K", KEPT[initial, state]
        yield REROLE + extra, "R", NEXT[state]


def _ahead(rows: list[Row], at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    if at < len(rows):
        for cost, letter, after in row_edits(rows[at], state):
            yield cost, letter, at + 1, after
    yield INSERT, "I", at, NEXT[state]


def _back(rows: list[Row], at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    if at:
        for before in STATES:
            for cost, letter, after in row_edits(rows[at - 1], before):
                if after == state:
                    yield cost, letter, at - 1, before
    for before in BEFORE.get(state, ()):
        yield INSERT, "I", at, before


class _Side:
    """One of the two searches: labels (cost, audit), settled nodes and a heap of (cost, rows, node).

    Edits without cost lead to the next row, so among equal costs the rows come in the search's
    own order and a node's label is the least when it is settled.
    """

    def __init__(self, rows: list[Row], starts: list[tuple[int, int]], forward: bool):
        self.rows, self.forward = rows, forward
        self.labels: dict[tuple[int, int], Label] = {}
        self.settled: set[tuple[int, int]] = set()
        self.heap: list[tuple[int, int, int]] = []
        for node in starts:
            self._put(node, (0, ""))

    def _put(self, node: tuple[int, int], label: Label) -> bool:
        if node in self.labels and self.labels[node] <= label:
            return False
        self.labels[node] = label
        heappush(self.heap, (label[0], node[0] if self.forward else -node[0], node[1]))
        return True

    def least(self) -> int | None:
        while self.heap:
            cost, at, state = self.heap[0]
            node = (at if self.forward else -at, state)
            if node not in self.settled and self.labels[node][0] == cost:
                return cost
            heappop(self.heap)
        return None

    def advance(self) -> Iterator[tuple[int, int]]:
        """Settles the least node; gives the nodes whose labels it betters."""
        _, at, state = heappop(self.heap)
        node = (at if self.forward else -at, state)
        self.settled.add(node)
        cost, audit = self.labels[node]
        for more, letter, *to in (_ahead if self.forward else _back)(self.rows, *node):
            if self._put(tuple(to), (cost + more, audit + letter if self.forward else letter + audit)):
                yield tuple(to)


def cheapest(rows: list[Row], entry: int, exits: tuple[int, ...]) -> Label | None:
    """Least (cost, audit) from a state before the rows to one of the exits after them."""
    ahead = _Side(rows, [(0, entry)], True)
    back = _Side(rows, [(len(rows), e) for e in exits], False)
    best = min((0 for n in ahead.labels if n in back.labels), default=None)
    while True:
        a, b = ahead.least(), back.least()
        if a is None or b is None or (best is not None and a + b > best):
            break
        side, other = (ahead, back) if a <= b else (back, ahead)
        for node in side.advance():
            if node in other.labels:
                cost = side.labels[node][0] + other.labels[node][0]
                best = cost if best is None else min(best, cost)
    if best is None:
        return None
    met = (
        (label[0] + back.labels[node][0], label[1] + back.labels[node][1])
        for node, label in ahead.labels.items() if node in back.labels
    )
    return min(met)


Matrix = dict[tuple[int, int], Label]


def solve(rows: list[Row], first: bool, last: bool) -> Matrix:
    """Least labels between the states at the borders; a first block starts empty, a last one ends well-formed."""
    entries = (EMPTY,) if first else STATES
    if last:  # all ends are alike, so one search finds the best of them
        found = {(e, EMPTY): cheapest(rows, e, GOALS) for e in entries}
    else:
        found = {(e, x): cheapest(rows, e, (x,)) for e in entries for x in STATES}
    return {k: v for k, v in found.items() if v is not None}


def joined(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of two neighbouring blocks."""
    out: Matrix = {}
    for (entry, middle), (cost, audit) in a.items():
        for (start, end), (more, rest) in b.items():
            if start == middle:
                label = (cost + more, audit + rest)
                if (entry, end) not in out or label < out[entry, end]:
                    out[entry, end] = label
    return out


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, block, blocks, initial, mark), sorted, become (conv, block, entry, exit, cost, audit)."""
    names = ["conv", "block", "entry", "exit", "cost", "audit"]
    now, rows, out = None, [], [[] for _ in names]

    def close():
        if now is not None:
            conv, block, blocks = now
            for (entry, end), (cost, audit) in solve(rows, block == 0, block == blocks - 1).items():
                for held, value in zip(out, (conv, block, entry, end, cost, audit), strict=True):
                    held.append(value)

    def batch():
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        for c in out:
            c.clear()
        return made

    for part in batches:
        for conv, block, blocks, initial, mark in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if now != (conv, block, blocks):
                close()
                now, rows = (conv, block, blocks), []
                if len(out[0]) >= 4096:
                    yield batch()
            rows.append((initial, mark))
    close()
    yield batch()


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_solved``, sorted by conv and block, become one (conv, cost, audit) for each conversation.

    Neighbours of equal span are joined first, so each letter is copied a logarithmic number of times.
    """
    now, block, matrix, stack, out = None, None, {}, [], []

    def push(level: int = 0):
        nonlocal matrix
        held = matrix
        while stack and stack[-1][0] == level:
            held, level = joined(stack.pop()[1], held), level + 1
        stack.append((level, held))
        matrix = {}

    def close():
        if now is not None:
            push()
            whole = stack.pop()[1]
            while stack:
                whole = joined(stack.pop()[1], whole)
            out.append((now, *whole[EMPTY, EMPTY]))

    def batch():
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.string()), strict=True)],
            names=["conv", "cost", "audit"],
        )
        out.clear()
        return made

    for part in batches:
        for conv, number, entry, end, cost, audit in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if conv != now:
                close()
                now, block = conv, number
                stack.clear()
                if len(out) >= 4096:
                    yield batch()
            elif number != block:
                push()
                block = number
            matrix[entry, end] = (cost, audit)
    close()
    yield batch()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, at, audit, role, text), an audit first and then its rows, become (conv, repaired_sha256)."""
    out: list[tuple[int, str]] = []

    class Open:
        def __init__(self, conv, audit):
            self.conv, self.audit, self.place, self.state = conv, audit, 0, EMPTY
            self.digest, self.some = hashlib.sha256(), False

        def put(self, line: str):
            if self.some:
                self.digest.update(b"\n")
            self.digest.update(line.encode())
            self.some = True

        def insert(self):
            while self.place < len(self.audit) and self.audit[self.place] == "I":
                self.state = NEXT[self.state]
                self.put("user:" if self.state == USER else "assistant:")
                self.place += 1

        def row(self, role: str, text: str):
            self.insert()
            letter = self.audit[self.place]
            self.place += 1
            if letter == "D":
                return
            if letter == "K":
                self.state = KEPT[role[:1], self.state]
            else:
                self.state = NEXT[self.state]
                role = "user" if self.state == USER else "assistant"
            self.put(f"{role}:{text}")

        def end(self):
            self.insert()
            out.append((self.conv, self.digest.hexdigest()))

    def batch():
        made = pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["conv", "repaired_sha256"],
        )
        out.clear()
        return made

    held = None
    for part in batches:
        for conv, at, audit, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if at < 0:
                if held is not None:
                    held.end()
                if len(out) >= 4096:
                    yield batch()
                held = Open(conv, audit)
            else:
                held.row(role, text)
    if held is not None:
        held.end()
    yield batch()


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with __at, their number in the order of conversation and turn, and what the search needs."""
    return stored(
        numbered(rows, [
            F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie"),
        ], "at").select(
            "conv", "turn", "role", "text", "at", F.substring("role", 1, 1).alias("initial"),
            (~F.col("text").rlike(WORD_CHAR)).alias("blank"), (~F.col("text").rlike(END_CHAR)).alias("open"),
            F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"),
        ),
        "rows",
    )


def repaired(conversations: DataFrame, all_convs: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows (conv_id, turn, role, text) are taken by turn, null turns first and ties by role and text. A row's
    first fault counts: blank (no word character), duplicate (role and text stand in an earlier row of
    the conversation), truncated (the last word character is none of ``.!?``). gaps are the missing
    turns between the least and the largest; illegal are neighbours whose roles' initials are not
    su, ua or au. audit spells the cheapest edits (K, R, D, I) that give ``(s?(ua)+)?``, of equal
    cost the least in ASCII; repaired_sha256 is of the repaired ``role:text`` lines. A null role or
    text counts as one space, a null conv_id is a conversation of its own. ``all_convs`` (conv_id) names
    conversations that may have no rows: they get zeros, an empty audit and the empty text's digest.
    An empty table gives an empty one; other columns are ignored.
    """
    plain = conversations.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    known = (all_convs if all_convs is not None else conversations).select("conv_id").distinct()
    names = stored(numbered(known, [F.col("conv_id").asc_nulls_first()], "conv"), "conversations")
    rows = _marked(plain.join(names.withColumnRenamed("conv_id", "named"), F.col("conv_id").eqNullSafe(F.col("named"))))
    narrow = rows.select("conv", "turn", "at", "initial", "blank", "open", "same")
    firsts = narrow.groupBy("conv", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    before = narrow.select((F.col("at") + 1).alias("at"), F.col("conv").alias("conv_"), F.col("initial").alias("initial_"))
    spans = narrow.groupBy("conv").agg(
        F.min("at").alias("first"), F.count("*").alias("n"),
        (F.max("turn") - F.min("turn") + 1).alias("turns"), F.count("turn").alias("dated"),
    )
    turns = narrow.where(F.col("turn").isNotNull()).select("conv", "turn").distinct().groupBy(F.col("conv").alias("conv_")).agg(
        F.count("*").alias("different")
    )
    spans = stored(spans.join(turns, F.col("conv") == F.col("conv_"), "left").select(
        F.col("conv").alias("of"), "first", "n", F.coalesce(F.col("turns") - F.col("different"), F.lit(0)).cast("long").alias("gaps")
    ), "spans")
    duplicate = ~F.col("blank") & F.col("new").isNull()
    truncated = ~F.col("blank") & F.col("new").isNotNull() & F.col("open")
    pair = F.concat("initial_", "initial")
    judged = stored(
        narrow.join(firsts, "at", "left").join(before, "at", "left").join(spans, F.col("conv") == F.col("of")).select(
            "conv", "at", "initial", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"),
            ((F.col("conv") == F.col("conv_")) & ~pair.isin("su", "ua", "au")).alias("illegal"),
            F.floor((F.col("at") - F.col("first")) / BLOCK).cast("long").alias("block"),
            F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"),
        ),
        "judged",
    )
    mark = F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), SHORT).otherwise(CLEAN)
    blocks = judged.select("conv", "block", "blocks", "at", "initial", mark.cast("int").alias("mark"))
    solved = blocks.repartition("conv", "block").sortWithinPartitions("conv", "block", "at").select(
        "conv", "block", "blocks", "initial", "mark"
    ).mapInArrow(_solved, "conv long, block long, entry int, exit int, cost long, audit string")
    best = stored(
        solved.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_composed, "conv long, cost long, audit string"),
        "audits",
    )
    lines = best.select("conv", F.lit(-1).cast("long").alias("at"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv", "at", F.lit(None).cast("string").alias("audit"), "role", "text")
    digests = lines.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(
        _digested, "conv long, repaired_sha256 string"
    )
    counts = judged.groupBy("conv").agg(*[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    whole = names.join(spans.select(F.col("of").alias("conv"), "gaps"), "conv", "left").join(counts, "conv", "left").join(
        best, "conv", "left"
    ).join(digests, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return whole.select(
        "conv_id", zero("gaps"), *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damage_kind() -> Column:
    """A number below 20 that decides what happens to a row."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    return F.crc32(named) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults: 0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it a user's."""
    kind, text = F.col("kind"), F.col("text")
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, r"[.!?]", "")).otherwise(text)
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        damage_kind().alias("kind"),
    ).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(damaged(conversations), conversations)


QUERIES = {"op12_conversation_repair": op12_conversation_repair}


def _dp() -> str:
    """The least label (cost, audit) of each state before a row, from those behind it."""

    def edge(cost: str, letter: str, then: str, when: str) -> str:
        return f"CASE WHEN {when} THEN {{'c': {cost} + b.{then}.c, 'a': '{letter}' || b.{then}.a}} END"

    extra, alive = "CASE WHEN r.mark = 1 THEN 1 ELSE 0 END", "r.mark < 2"
    out = []
    for state, after in (("e", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
        keeps = {"e": [("s", "s"), ("u", "u")], "s": [("u", "u")], "u": [("a", "a")], "a": [("u", "u")]}[state]
        edges = [edge("3", "D", state, "true"), edge(f"2 + {extra}", "R", after, alive)]
        edges += [edge(extra, "K", to, f"{alive} AND r.initial = '{i}'") for i, to in keeps]
        out.append(f"list_sort(list_filter([{', '.join(edges)}], lambda x: x IS NOT NULL))[1] AS {state}")
    return ", ".join(out)


def _insert(source: str) -> str:
    """The labels after inserts at the same row."""

    def least(state: str, other: str) -> str:
        return f"list_sort([{state}, {{'c': 2 + {other}.c, 'a': 'I' || {other}.a}}])[1]"

    first = f"SELECT * REPLACE ({least('u', 'a')} AS u, {least('a', 'u')} AS a) FROM {source}"
    return f"SELECT * REPLACE ({least('e', 'u')} AS e, {least('s', 'u')} AS s) FROM ({first})"


_FAR = "{'c': 1000000000::BIGINT, 'a': ''}"
_NONE = "{'c': 0::BIGINT, 'a': ''}"
_SPACE = r"[\x09-\x0D\x20]"

ORACLES = {"op12_conversation_repair": f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS bytes),
kinds AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))", 'bytes')} % 20 AS kind
    FROM conversations, crc
),
damage AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM kinds WHERE kind <> 0
),
named AS MATERIALIZED (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
    SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM damage JOIN named ON named.conv_id IS NOT DISTINCT FROM damage.conv_id
),
marked AS MATERIALIZED (
    SELECT *, role[1] AS initial, fault = 'blank' AS blank, fault = 'duplicate' AS duplicate, fault = 'truncated' AS truncated,
        CASE WHEN fault IN ('blank', 'duplicate') THEN 2 WHEN fault = 'truncated' THEN 1 ELSE 0 END AS mark,
        coalesce((lag(role[1]) OVER (PARTITION BY conv ORDER BY pos) || role[1]) NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM (SELECT *, CASE WHEN regexp_full_match(text, '{_SPACE}*') THEN 'blank' WHEN again THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?]{_SPACE}*$') THEN 'truncated' ELSE '' END AS fault
        FROM (SELECT *, min(pos) OVER (PARTITION BY conv, role, text) < pos AS again FROM placed))
),
counts AS MATERIALIZED (
    SELECT conv, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
        count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal
    FROM marked GROUP BY conv
),
best AS (
    {_insert(f"(SELECT conv, n + 1 AS pos, {_NONE} AS e, {_FAR} AS s, {_FAR} AS u, {_NONE} AS a FROM counts)")}
    UNION ALL
    {_insert(f"(SELECT r.conv, r.pos, {_dp()} FROM best b JOIN marked r ON r.conv = b.conv AND r.pos = b.pos - 1)")}
),
audits AS MATERIALIZED (SELECT conv, e.c AS cost, e.a AS audit FROM best WHERE pos = 1),
letters AS (
    SELECT conv, i, audit[i] AS letter, length(replace(audit[1:i], 'I', '')) AS pos, length(replace(audit[1:i], 'D', '')) AS place
    FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS i FROM audits)
),
lines AS (
    SELECT l.conv, l.i, l.place, l.letter, m.role, m.text,
        max(CASE WHEN l.place = 1 AND l.letter = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv) AS lead
    FROM letters l LEFT JOIN marked m ON m.conv = l.conv AND m.pos = l.pos AND l.letter <> 'I'
    WHERE l.letter <> 'D'
),
texts AS (
    SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS text
    FROM lines GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(texts.text, '')) AS repaired_sha256
FROM named LEFT JOIN counts USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN texts USING (conv)
"""}
