"""Secret scans with one combined deterministic automaton.

All rules are compiled together: their reversed expressions, started at any
byte, become one minimal automaton whose single pass over a text's bytes
from the end marks every place where some rule's match begins.  At the
leftmost free place of a rule, the rule's own small automaton gives the
longest match; the scan of that rule goes on behind it.  So each rule finds
its leftmost, longest, non-overlapping matches, and all rules share one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.automaton import Dfa, ignore_case, parse, reverse
from wordloom.llm.batches import text_slices, utf8_texts


@dataclass(frozen=True)
class Rule:
    """``lead`` is the part of a match that does not count for ``least``, the shortest length that is a finding."""

    kind: str
    pattern: str
    lead: str = ""
    least: int = 1
    any_case_lead: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
# The three base kinds.  A run of hex digits counts from 24 on, so the automaton asks for 24 at once.
BASE_RULES = [
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", _ASSIGN, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", "", 20),
    Rule("hex", r"[0-9a-f]{24,}", "", 24),
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", "", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", "", 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "", 30),
]


def _trees(rule: Rule):
    lead = parse(rule.lead)
    if rule.any_case_lead:
        lead = ignore_case(lead)
    return lead, ("cat", (lead, parse(rule.pattern)))


class Scanner:
    """The compiled rules; `find` gives the (start, end, rule number) byte spans of a text."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        trees = [_trees(r) for r in rules]
        self.backward = Dfa([reverse(whole) for _, whole in trees], anywhere=True)
        self.whole = [Dfa([whole]) for _, whole in trees]
        self.lead = [Dfa([lead]) for lead, _ in trees]
        self._linked = None

    def __getstate__(self):
        return self.__dict__ | {"_linked": None}  # the arrays travel, the nested lists are made where they are used

    def _rows(self):
        if self._linked is None:
            self._linked = self.backward.rows()[0], [d.rows()[0] for d in self.whole], [d.rows()[0] for d in self.lead]
        return self._linked

    @staticmethod
    def _longest(state, data: bytes, at: int) -> int:
        """End of the longest match from ``at``, or -1."""
        best = at if state[256] else -1
        for i in range(at, len(data)):
            state = state[data[i]]
            if state[256]:
                best = i + 1
            elif state[257]:
                break
        return best

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        state, whole, lead = self._rows()
        marks = []
        at = len(data)
        for b in reversed(data):
            at -= 1
            state = state[b]
            if state[256]:
                marks.append((at, state[256]))
        marks.reverse()
        found = []
        for r, rule in enumerate(self.rules):
            bit, free = 1 << r, 0
            for at, mask in marks:
                if mask & bit and at >= free:
                    free = self._longest(whole[r], data, at)
                    body = self._longest(lead[r], data, at)
                    if free - body >= rule.least:
                        found.append((at, free, r))
        found.sort(key=lambda x: (x[0], x[2]))
        return found


def code_point_spans(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code point spans; the spans come sorted by start."""
    out, seen, chars = [], 0, 0
    for start, end, r in spans:
        chars += len(data[seen:start].decode("utf-8", "replace"))
        seen = start
        out.append((chars, chars + len(data[start:end].decode("utf-8", "replace")), r))
    return out


def scan_secrets(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings array<struct<kind, start, end>>) for every row, by start and then by rule order.

    Starts and ends are code points, the end exclusive.  Null and empty
    texts have no findings.
    """
    rules = list(rules if rules is not None else BASE_RULES + MORE_RULES)
    scanner = Scanner(rules)
    finding = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = [r.kind for r in rules]

    def run(batches):
        for b in batches:
            for first, last in text_slices(b, "text"):
                part = b.slice(first, last - first)
                rows = [[{"kind": kinds[r], "start": s, "end": e} for s, e, r in code_point_spans(t, scanner.find(t))]
                        for t in utf8_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, finding)], ["id", "findings"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, findings array<struct<kind:string,start:long,end:long>>")


def redactor(mark: str, rules: list[Rule] | None = None):
    """A function of a text's bytes that replaces each stretch of overlapping findings by ``mark``."""
    scanner = Scanner(list(rules if rules is not None else BASE_RULES + MORE_RULES))

    def clean(data: bytes) -> bytes:
        found = scanner.find(data)
        if not found:
            return data
        parts, at = [], 0
        for start, end, _ in found:
            if start >= at:
                parts += [data[at:start], mark.encode()]
            at = max(at, end)
        return b"".join([*parts, data[at:]])

    return clean


def redact(docs: DataFrame, mark: str, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with its secrets replaced in ``text_col``, slice by slice; null stays null, all other columns pass through."""
    clean = redactor(mark, rules)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for first, last in text_slices(b, text_col):
                part = b.slice(first, last - first)
                texts = [None if t is None else clean(t).decode() for t in part.column(at).cast(pa.binary()).to_pylist()]
                yield part.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans from the findings of `scan_secrets`."""
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda *kinds: F.filter("findings", lambda x: x["kind"].isin(*kinds))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"))
