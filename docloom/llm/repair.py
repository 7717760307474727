"""Operator 13: repair of conversations' structure by the cheapest edits.

1. ``damaged`` makes the rows to repair with column functions alone; ``classified`` gives each a letter for its role and its first
   fault. Duplicates are told by the digests of role and text, so texts are not shuffled here.
2. A conversation's rows are sorted in one task and streamed. What is kept of a row is a byte, less than what its edit
   takes in the result. A backward pass gives the cost of each grammar state before each row (costs differ by a bounded
   number, so that a pass is a walk over few distinct steps, each computed once); a forward walk from the start takes
   the ASCII-least of the edits that lose nothing.
3. The edits meet their conversation's rows again, sorted in the same way, and texts are streamed into the digest.

Grammar: the roles' initials are ``(s?(ua)+)?``. Rows are ordered by turn, null first, then by the digest of role and text.
A null role or text is one space, in the damage's key also a null id or turn. Rows without ``conv_id`` are one conversation.
A role without characters fits nowhere.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import storage
from docloom.llm.trie import turn_digest

BLANKS = " \t\n\x0b\x0c\r"
#: What edits cost: deleting, inserting, changing the role, and leaving a truncated row in.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Grammar states: nothing yet, after the system's turn, after the user's, after the assistant's. The one that an inserted or changed turn leads to.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Costs of the states behind the last row, and the edits.
END = ((0, 2 * INSERT, INSERT, 0), ("", "II", "I", ""))

_TOLD = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, text, gone): each row with its damage; dropped rows stay, marked, so that no conversation is lost."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("fault")
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("c", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (fault == 3).cast("int")))).select("c", "turn", "role", "text", (fault == 0).alias("gone"))


def classified(rows: DataFrame) -> DataFrame:
    """(c, turn, digest, kind), sorted: the role's initial (``o`` for others), then ``b``, ``d`` or ``t`` for blank, duplicate or truncated,
    ``-`` for neither; null for rows that are gone. A conversation is in one partition."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    rows = rows.select(
        "c", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), "gone", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("whole")
    )
    before = F.row_number().over(Window.partitionBy("c", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())) - 1
    rows = rows.repartition("c").withColumn("before", before)
    fault = F.when(F.col("blank"), "b").when(F.col("before") > 0, "d").when(~F.col("whole"), "t").otherwise("-")
    rows = rows.select("c", "turn", "digest", "before", F.when(~F.col("gone"), F.concat("initial", fault)).alias("kind"))
    return rows.sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "digest", "before").drop("before")


@functools.lru_cache(maxsize=None)
def step(after: tuple[int, ...], kind: str) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """From the costs behind a row: those before it, less the smallest; the smallest; and for each state the edits up to the row's own, and the state then.

    There are few arguments: costs of two states differ by two insertions at most.
    """
    extra = TRUNCATED if kind[1] == "t" else 0

    def choices(state):
        yield "D", DELETE + after[state], state
        if kind[1] not in "bd":
            if (state, kind[0]) in KEEPS:
                to = KEEPS[state, kind[0]]
                yield "K", extra + after[to], to
            yield "R", REROLE + extra + after[NEXT[state]], NEXT[state]

    row = [list(choices(state)) for state in range(4)]
    cost = direct = [min(c for _, c, _ in options) for options in row]
    for _ in range(2):  # more than two insertions in a row come back to a state
        cost = [min(c, INSERT + cost[NEXT[state]]) for state, c in enumerate(direct)]

    def path(state):
        edits = ""
        while True:
            tight = [(e, to) for e, c, to in row[state] if c == cost[state]]
            if INSERT + cost[NEXT[state]] == cost[state]:
                tight.append(("I", NEXT[state]))
            edit, state = min(tight)
            edits += edit
            if edit != "I":
                return edits, state

    least = min(cost)
    return tuple(c - least for c in cost), least, tuple(path(state) for state in range(4))


def audit(kinds: list[str]) -> tuple[int, str]:
    """The cost and the edits of a conversation's rows."""
    costs, total, plans = END[0], 0, []
    for kind in reversed(kinds):
        costs, least, plan = step(costs, kind)
        total += least
        plans.append(plan)
    state, edits = 0, []
    for plan in reversed(plans):
        edit, state = plan[state]
        edits.append(edit)
    return total + costs[0], "".join(edits) + END[1][state]


class _Conversation:
    """What is known of the rows so far."""

    def __init__(self, c):
        self.c, self.kinds, self.turns, self.first, self.last = c, [], 0, None, None

    def add(self, turn, kind):
        self.kinds.append(kind)  # one of twelve strings
        if turn is not None and turn != self.last:
            self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn

    def told(self):
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        initials = [k[0] for k in self.kinds]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        return self.c, gaps, *(sum(k[1] == f for k in self.kinds) for f in "bdt"), illegal, *audit(self.kinds)


def _audited(batches):
    """A row for each conversation."""
    import pyarrow as pa

    names = ["c", *(part.split()[0] for part in _TOLD.split(", "))]

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "audit" else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names)

    now = None
    for batch in batches:
        out = []
        for c, turn, kind in zip(*(batch.column(k).to_pylist() for k in ("c", "turn", "kind")), strict=True):
            if now is None or c != now.c:
                if now:
                    out.append(now.told())
                now = _Conversation(c)
            if kind is not None:
                now.add(turn, kind)
        if out:
            yield told(out)
    if now:
        yield told([now.told()])


class _Repair:
    """Applies edits to the turns that come one by one."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, 0

    def _inserted(self):
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield ROLES[self.state], ""

    def turn(self, role: str, text: str):
        """The turns that come of the next one."""
        yield from self._inserted()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "K":
            self.state = KEEPS[self.state, role[0]]
            yield role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield ROLES[self.state], text

    def end(self):
        return self._inserted()


def repair(turns: list[tuple[str, str]], edits: str) -> list[tuple[str, str]]:
    """The repaired turns of one conversation."""
    now = _Repair(edits)
    return [x for role, text in turns for x in now.turn(role, text)] + list(now.end())


def _digested(batches):
    """The digest of each repaired conversation; its edits come first, then its turns."""
    import pyarrow as pa

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["c", "repaired_sha256"])

    def write(turns):
        nonlocal lines
        for role, text in turns:
            state.update(f"{'\n' if lines else ''}{role}:{text}".encode())
            lines += 1

    now, state, lines, of = None, None, 0, None
    for batch in batches:
        out = []
        for c, edits, role, text in zip(*(batch.column(k).to_pylist() for k in ("c", "audit", "role", "text")), strict=True):
            if edits is not None:
                if now:
                    write(now.end())
                    out.append((of, state.hexdigest()))
                now, state, lines, of = _Repair(edits), hashlib.sha256(), 0, c
            else:
                write(now.turn(role, text))
        if out:
            yield told(out)
    if now:
        write(now.end())
        yield told([(of, state.hexdigest())])


def audited(rows: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``rows`` (c, turn, role, text, gone)."""
    return classified(rows).mapInArrow(_audited, f"c long, {_TOLD}")


def repaired(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' faults, cheapest edits and repaired digest, a row for each ``conv_id``."""
    rows = damaged(conversations)
    found = storage.materialise(audited(rows), "audits")
    none = lambda kind: F.lit(None).cast(kind)
    edits = found.select("c", F.lit(0).alias("part"), none("long").alias("turn"), none("binary").alias("digest"), "audit", none("string").alias("role"), none("string").alias("text"))
    turns = rows.filter(~F.col("gone")).select("c", F.lit(1).alias("part"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), none("string").alias("audit"), "role", "text")
    both = edits.unionByName(turns).repartition("c").sortWithinPartitions("c", "part", F.col("turn").asc_nulls_first(), "digest")
    digests = both.mapInArrow(_digested, "c long, repaired_sha256 string")
    out = found.join(digests.withColumnRenamed("c", "of"), F.col("c").eqNullSafe(F.col("of")))
    return out.select(F.col("c").alias("conv_id"), *(part.split()[0] for part in _TOLD.split(", ")), "repaired_sha256")
