"""Secret scans: every rule in one pass over a text's bytes with a combined deterministic automaton.

Matches are leftmost, non-overlapping and longest for each kind, as those of a regular expression search
for these rules; a match whose value is too short is dropped after it was taken. Positions are code points,
the end exclusive.

Defined cases: null and empty texts have no spans; rows that repeat are scanned alike; an empty table gives
an empty result. Cost follows the bytes, not the number of rules.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.automaton import Automaton, Rule, Scanner, compiled

#: The base kinds in their order, then those that this scan adds.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", nocase=True, group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
ADDED = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]


class Runner:
    """A scanner's arrays as Python lists, which a byte loop reads fastest."""

    def __init__(self, scanner: Scanner):
        back = scanner.back
        hot = np.flatnonzero(back.accepts)
        self.rules = scanner.rules
        # states that accept come last, and a state's number is the place of its row
        order = np.concatenate([np.flatnonzero(back.accepts == 0), hot])
        place = np.empty_like(order)
        place[order] = np.arange(len(order)) * back.classes
        self.back = place[back.moves.reshape(-1, back.classes)[order]].reshape(-1).tolist()
        self.first_hot = (len(order) - len(hot)) * back.classes
        self.start = int(place[0])
        self.mask = {int(place[s]): int(back.accepts[s]) for s in hot}
        self.back_table = bytes(back.class_of.astype(np.uint8))
        self.ahead = [(a, bytes(a.class_of.astype(np.uint8)), a.moves.tolist(), a.accepts.astype(bool).tolist()) for a in scanner.ahead]
        self.exact = [re.compile(r.pattern.encode(), re.IGNORECASE if r.nocase else 0) if r.least else None for r in self.rules]

    def starts(self, text: bytes) -> list[list[int]]:
        """By rule, the bytes at which a match begins, the last first: the one pass."""
        found: list[list[int]] = [[] for _ in self.rules]
        moves, hot, s, top = self.back, self.first_hot, self.start, len(text) - 1
        for i, c in enumerate(text.translate(self.back_table)[::-1]):
            s = moves[s + c]
            if s >= hot:
                mask = self.mask[s]
                for r in range(len(found)):
                    if mask >> r & 1:
                        found[r].append(top - i)
        return found

    def end(self, r: int, text: bytes, at: int) -> int:
        """The end of the longest match of rule r from ``at``."""
        a, table, moves, accepts = self.ahead[r]
        s, end, i = 0, at, at
        while i < len(text) and s != a.dead:
            s = moves[s * a.classes + table[text[i]]]
            i += 1
            if accepts[s]:
                end = i
        return end

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and rule."""
        out = []
        for r, starts in enumerate(self.starts(text)):
            upto = 0
            for at in reversed(starts):
                if at >= upto:
                    upto = self.end(r, text, at)
                    rule, exact = self.rules[r], self.exact[r]
                    if not exact or len(exact.match(text, at, upto)[rule.group]) >= rule.least:
                        out.append((at, r, upto))
        return sorted(out)


def findings(runner: Runner, text: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    spans = runner.spans(text)
    if not spans or text.isascii():
        return spans
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(lead[a]), r, int(lead[z])) for a, r, z in spans]


_runners: dict[str, Runner] = {}


def scan(docs: DataFrame, base: list[Rule] | None = None, added: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, a count for each base kind, base_sha256, spans and n_added.

    spans: kind:start:end, by start and then kind, joined by commas; base_sha256: the digest of the base
    kinds' part. The automaton is compiled once and sent with the tasks; its size follows the rules alone.
    """
    base, added = BASE if base is None else base, ADDED if added is None else added
    rules = base + added
    shared = docs.sparkSession.sparkContext.broadcast(compiled(rules))
    name = repr(rules)
    kinds = [r.kind for r in base]

    def make(batches):
        if name not in _runners:
            _runners[name] = Runner(shared.value)
        runner = _runners[name]
        for b in batches:
            rows: list[list] = [[] for _ in range(len(kinds) + 3)]
            for text in b.column(1).cast(pa.binary()).to_pylist():
                got = findings(runner, text or b"")
                mine = [x for x in got if x[1] < len(kinds)]
                say = lambda spans: ",".join(f"{rules[r].kind}:{a}:{z}" for a, r, z in spans)
                for k in range(len(kinds)):
                    rows[k].append(sum(r == k for _, r, _ in mine))
                for at, x in enumerate((hashlib.sha256(say(mine).encode()).hexdigest(), say(got), len(got) - len(mine))):
                    rows[len(kinds) + at].append(x)
            types = [pa.int64()] * len(kinds) + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(rows, types, strict=True))], names=["id", *kinds, "sha", "spans", "added"])

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = text.schema["id"].dataType.simpleString()
    out = text.mapInArrow(make, f"id {kind}, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


__all__ = ["ADDED", "BASE", "Automaton", "Runner", "findings", "scan"]
