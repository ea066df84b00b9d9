"""Structure repair of conversations: the cheapest edits that make the roles read ``(system? (user assistant)+)?``.

Edits, in the order of a conversation's rows: Keep (0), Rerole to user or
assistant (3), Delete (4, required for blank and duplicate rows) and Insert
of an empty turn (3, anywhere); a truncated row that stays adds 3.

A path's weight is one Python integer.  Its high digits are the cost; its low
digits are octal, one a letter, the first edit's letter highest, with zeros
behind the last one.  Weights add letters at fixed places, so the least
integer is the least cost and, among equal costs, the ASCII-least string of
edit initials; an ordinary minimum over the DAG of (row, state) decides all.

Long conversations go in blocks of `BLOCK` rows, from the last to the first,
so that an integer has some thousand bits at most.  A block starts from the
four states' costs behind it and the *rank* of their letters behind it.
Inserts stand before the row that follows, so two strings of a block end with
a row's letter and neither is a proper prefix of the other: letters decide
where the strings differ, and where they are equal the rank, as one more
digit at the same place.

Two passes: the first shuffles a few bytes a row and finds the edits, the
second shuffles the texts once and streams each conversation, in order,
behind its edits.  A task holds one byte a row, and 16 bytes a distinct row,
of the conversation it is at, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.graph import written

BLOCK = 128
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
# Octal digits in the order of the letters; 0 is the padding.
DIGIT = {DELETE: 1, INSERT: 2, KEEP: 3, REROLE: 4}
LETTER = str.maketrans({str(d): x for x, d in DIGIT.items()})
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIAL = {"s": 0, "u": 1, "a": 2}
OTHER, MUST_GO, TRUNCATED = 3, 4, 8
# Where a kept row with a role initial leads to; where the one role that may come next leads to.
KEPT = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
NEXT = (USER, USER, ASSISTANT, USER)
NAME = ("user", "user", "assistant", "user")
LEGAL = {(0, 1), (1, 2), (2, 1)}
# Behind the last row: what is still to be inserted in each state.
TAIL = ("", INSERT * 2, INSERT, "")

NOT_BLANK = r"[^\x20\x09-\x0D]"
STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def block_weights(codes, behind: list[tuple[int, int]]) -> tuple[list[int], int]:
    """The least weight from each state before the rows ``codes``, given (cost, rank) of each state behind them, and the letters' width in bits."""
    width = 3 * (3 * len(codes) + 1)  # a row has its letter and at most two inserts before it, then the rank
    low, top = (1 << width) - 1, width - 3

    def put(letter: str, cost: int, weight: int) -> int:
        return ((weight >> width) + cost << width) | DIGIT[letter] << top | (weight & low) >> 3

    w = [cost << width | rank << top for cost, rank in behind]
    for code in reversed(codes):
        gone = [put(DELETE, COST[DELETE], x) for x in w]
        if not code & MUST_GO:
            extra = TRUNCATED_COST if code & TRUNCATED else 0
            for q in range(4):
                gone[q] = min(gone[q], put(REROLE, COST[REROLE] + extra, w[NEXT[q]]))
                if (code & 3) in KEPT[q]:
                    gone[q] = min(gone[q], put(KEEP, COST[KEEP] + extra, w[KEPT[q][code & 3]]))
        once = [min(gone[q], put(INSERT, COST[INSERT], gone[NEXT[q]])) for q in range(4)]
        w = [min(gone[q], put(INSERT, COST[INSERT], once[NEXT[q]])) for q in range(4)]
    return w, width


def cheapest_edits(codes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of a conversation given one code a row (role initial, MUST_GO, TRUNCATED)."""
    if not len(codes):
        return 0, ""
    behind = [(COST[INSERT] * len(t), len(t)) for t in TAIL]
    blocks = []
    for at in range((len(codes) - 1) // block * block, -1, -block):
        w, width = block_weights(codes[at:at + block], behind)
        low = (1 << width) - 1
        order = sorted({x & low for x in w})
        behind = [(x >> width, order.index(x & low)) for x in w]
        blocks.append((at, w, width))
    audit, state = [], START
    for at, w, width in reversed(blocks):
        row, rows = at, min(at + block, len(codes))
        letters = format(w[state] & ((1 << width) - 1), "o").zfill(width // 3).translate(LETTER)
        for n, x in enumerate(letters, 1):
            state = step(state, x, codes[row] & 3)
            row += x != INSERT
            if row == rows:
                break
        audit.append(letters[:n])
    return behind[START][0], "".join(audit) + TAIL[state]


def step(state: int, letter: str, initial: int) -> int:
    """The state behind an edit."""
    return state if letter == DELETE else KEPT[state][initial] if letter == KEEP else NEXT[state]


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "key")


def _edits(rows: DataFrame) -> DataFrame:
    """(conv_id, stats and audit) from rows without their texts, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out = _Conversation(None, True), []
        for b in batches:
            for conv, kind, turn, role, key, blank, cut in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "key", "blank", "cut"))):
                if one.unused or conv != one.conv:
                    if not one.unused:
                        out.append(one.result())
                    one = _Conversation(conv)
                if kind:
                    one.add(turn, INITIAL.get(role[:1], OTHER), key, blank, cut)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if not one.unused:
            out.append(one.result())
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), *((f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in STATS.split(", "))])
    light = _ordered(rows.select("conv_id", "kind", "turn", "role", "key", "blank", "cut"))
    return light.mapInArrow(run, f"conv_id long, {STATS}")


class _Conversation:
    """What the first pass holds of the conversation it is at."""

    def __init__(self, conv, unused: bool = False):
        self.conv, self.unused = conv, unused
        self.codes, self.seen = bytearray(), set()
        self.least = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: int, key: bytes, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.least, self.last = turn if self.least is None else self.least, turn
            self.turns += 1
        if self.codes and (self.codes[-1] & 3, initial) not in LEGAL:
            self.illegal += 1
        again = key in self.seen
        self.seen.add(key)
        code = initial
        if blank:
            self.blank += 1
            code |= MUST_GO
        elif again:
            self.duplicate += 1
            code |= MUST_GO
        elif cut:
            self.truncated += 1
            code |= TRUNCATED
        self.codes.append(code)

    def result(self) -> dict:
        cost, audit = cheapest_edits(self.codes)
        return {"conv_id": self.conv, "gaps": 0 if self.least is None else self.last - self.least + 1 - self.turns, "blank": self.blank,
                "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, head, role, text, letter) for every turn that stays, behind (conversation, head, None, None, None) for each conversation."""
    conv = head = None
    at, state = 0, START

    def inserts():
        nonlocal at, state
        while at < len(head["audit"]) and head["audit"][at] == INSERT:
            yield conv, head, NAME[state], "", INSERT
            at, state = at + 1, NEXT[state]

    for b in batches:
        for c, h, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "head", "role", "text"))):
            if h is not None:
                if head is not None:
                    yield from inserts()
                conv, head, at, state = c, h, 0, START
                yield conv, head, None, None, None
                continue
            yield from inserts()
            letter = head["audit"][at]
            if letter != DELETE:
                yield conv, head, role if letter == KEEP else NAME[state], text, letter
            at, state = at + 1, step(state, letter, INITIAL.get(role[:1], OTHER))
    if head is not None:
        yield from inserts()


def _prepared(turns: DataFrame, columns: tuple[str, str, str, str], ids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    conv, turn, role, text = columns
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.lit(1).alias("kind"), F.col(turn).cast("long").alias("turn"), clean(role).alias("role"), clean(text).alias("text"))
    rows = rows.withColumns({
        # stands for (role, text) wherever rows are compared
        "key": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))),
        "blank": ~F.col("text").rlike(NOT_BLANK), "cut": ~last_visible(F.col("text")).isin(".", "!", "?")})
    marks = (rows.select("conv_id") if ids is None else ids.select(F.col(conv).cast("long").alias("conv_id"))).distinct()
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "key", "text", "blank", "cut")]
    heads = written(_edits(marks.select("conv_id", F.lit(0).alias("kind"), *nothing).unionByName(rows)), "edits")
    head = F.struct(*[c for c in heads.columns if c != "conv_id"])
    none = F.lit(None).cast(heads.select(head.alias("h")).schema["h"].dataType)
    wide = rows.select("conv_id", "kind", "turn", "role", "key", "text", none.alias("head")).unionByName(
        heads.select("conv_id", F.lit(0).alias("kind"), *nothing[:4], head.alias("head")))
    return heads, _ordered(wide).select("conv_id", "head", "role", "text")


def last_visible(text: Column) -> Column:
    """The last character that is not white space ('' without one)."""
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))


def repair_conversations(turns: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for every conversation.

    Rows go by turn, null turns first; rows with the same turn by role and
    then by a hash of role and text.  Null roles and texts read as one blank,
    rows with a null conversation form a conversation of their own.  ``ids``
    (a table with the conversation column) names the conversations to report;
    one without rows gets zeros, an empty audit and the empty text's hash.
    Equal rows are told by a 128-bit hash.  Other columns are not looked at;
    an empty table gives an empty result; texts may have any length.
    """
    _, ordered = _prepared(turns, columns, ids)

    def run(batches):
        out, current = [], None

        def done():
            conv, head, sha, _ = current
            out.append({"conv_id": conv, **head, "repaired_sha256": sha.hexdigest()})

        for conv, head, role, text, letter in _repaired(batches):
            if letter is None:
                if current:
                    done()
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                current = [conv, head, hashlib.sha256(), False]
                continue
            current[2].update((("\n" if current[3] else "") + f"{role}:{text}").encode())
            current[3] = True
        if current:
            done()
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), *((f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in STATS.split(", ")), ("repaired_sha256", pa.string())])
    return ordered.mapInArrow(run, f"conv_id long, {STATS}, repaired_sha256 string")


def repaired_turns(turns: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """(conv_id, turn, role, text, edit): the turns of every repaired conversation, numbered from 0; see `repair_conversations`."""
    _, ordered = _prepared(turns, columns, None)

    def run(batches):
        out, size, at = [], 0, 0
        for conv, _, role, text, letter in _repaired(batches):
            if letter is None:
                at = 0
                continue
            out.append({"conv_id": conv, "turn": at, "role": role, "text": text, "edit": letter})
            at, size = at + 1, size + len(text)
            if size > 1 << 20 or len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return ordered.mapInArrow(run, "conv_id long, turn long, role string, text string, edit string")


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` rows damaged by crc32 of ``conv_id:turn`` mod 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 sets the role user.  Nulls read as one blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(0), (F.col("fate") == 3).cast("int"))).alias("copy")).drop("copy")
