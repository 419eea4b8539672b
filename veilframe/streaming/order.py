"""Chunks of a stream in the order of their numbers, however they arrive.

Plain state that a streaming operator keeps per stream: chunks that came too early
wait, those that came before are told apart from those that came too late. It is
kept as JSON between micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

REPEATED, LATE = "repeated", "late"


@dataclass
class Sequence:
    """The chunks of one stream, numbered from ``due`` on without gaps.

    ``clock`` is the latest event time seen. A chunk waits for its predecessors for
    ``patience`` on that clock; then they are given up and count as late.
    """

    due: int = 0
    last: int | None = None
    clock: int | None = None
    waiting: dict[int, tuple[str, int | None]] = field(default_factory=dict)
    gaps: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def load(cls, raw: dict) -> Sequence:
        waiting = {int(k): tuple(v) for k, v in raw["waiting"].items()}
        return cls(raw["due"], raw["last"], raw["clock"], waiting, [tuple(g) for g in raw["gaps"]])

    def dump(self) -> dict:
        return {
            "due": self.due, "last": self.last, "clock": self.clock,
            "waiting": {str(k): v for k, v in self.waiting.items()}, "gaps": self.gaps,
        }

    @property
    def finished(self) -> bool:
        return self.last is not None and self.due > self.last

    def put(self, seq: int, chunk: str, last: bool, at: int | None) -> str | None:
        """Take a chunk; why it is rejected, or None."""
        if at is not None:
            self.clock = at if self.clock is None else max(self.clock, at)
        if seq < self.due:
            return LATE if any(a <= seq < b for a, b in self.gaps) else REPEATED
        if seq in self.waiting or (self.last is not None and seq > self.last):
            return REPEATED
        self.waiting[seq] = (chunk, at)
        if last:
            self.last = seq
        return None

    def ready(self) -> list[tuple[int, str]]:
        """The chunks that nothing before them is missing for any more."""
        out = []
        while self.due in self.waiting:
            out.append((self.due, self.waiting.pop(self.due)[0]))
            self.due += 1
        return out

    def overdue(self, patience: int | None) -> bool:
        """Whether a chunk has waited for longer than ``patience``."""
        if patience is None or self.clock is None or not self.waiting:
            return False
        since = [at for _, at in self.waiting.values() if at is not None]
        return bool(since) and min(since) + patience < self.clock

    def skip(self) -> bool:
        """Give up what the next waiting chunk waits for; False if nothing waits."""
        if not self.waiting:
            return False
        first = min(self.waiting)
        if first > self.due:
            self.gaps.append((self.due, first))
            self.due = first
        return True


@dataclass
class Held:
    """A stream's sequence and its text after the last safe cut."""

    sequence: Sequence
    text: str = ""
    at: int = 0

    @classmethod
    def load(cls, raw: str | None) -> Held:
        if raw is None:
            return cls(Sequence())
        kept = json.loads(raw)
        return cls(Sequence.load(kept["sequence"]), kept["text"], kept["at"])

    def dump(self) -> str:
        return json.dumps({"sequence": self.sequence.dump(), "text": self.text, "at": self.at})

    def release(self, end: int) -> tuple[int, str]:
        """The first ``end`` characters of the held text, and where they stand."""
        out = self.at, self.text[:end]
        self.text, self.at = self.text[end:], self.at + end
        return out


def rejected(rows: Iterable[tuple], sequence: Sequence) -> list[tuple[int, str, str]]:
    """Put (seq, chunk, is_last, time) rows into a sequence: (seq, chunk, reason) of those it refuses."""
    out = []
    for seq, chunk, last, at in rows:
        why = sequence.put(int(seq), chunk or "", bool(last), at)
        if why:
            out.append((int(seq), chunk or "", why))
    return out
