"""Models and services behind one interface, with a deterministic stand-in for tests and offline runs."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol


class Provider(Protocol):
    """Replies to prompts; called on the executors, a batch at a time."""

    def call(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class Canned:
    """Replies made from the prompt alone, the same everywhere and each time."""

    replies: tuple[str, ...] = ("yes", "no")

    def call(self, prompts: list[str]) -> list[str]:
        return [self.replies[int(hashlib.md5(p.encode()).hexdigest(), 16) % len(self.replies)] for p in prompts]


@dataclass(frozen=True)
class Patient:
    """Tries again with growing pauses: twice as long each time, at most 30 seconds, and a least pause between calls."""

    provider: Provider
    attempts: int = 3
    base: float = 2.0
    interval: float = 0.0
    sleep: Callable[[float], None] = time.sleep

    def pause(self, attempt: int) -> float:
        return min(2**attempt * self.base, 30.0)

    def call(self, prompts: list[str]) -> list[str]:
        for attempt in range(self.attempts):
            try:
                if self.interval:
                    self.sleep(self.interval)
                return self.provider.call(prompts)
            except Exception:
                if attempt + 1 == self.attempts:
                    raise
                self.sleep(self.pause(attempt))
        return []


@dataclass
class Paced:
    """One call at a time, each in a time slot of its own; of ``owners`` callers that agree on ``base``, ``owner`` has every ``owners``-th slot.

    Slots are ``interval`` and ``slack`` apart and a call begins within
    ``slack`` of its slot, or waits for the next: no two calls of all owners
    begin closer than the interval. Without a base it is now.
    """

    provider: Provider
    interval: float
    owners: int = 1
    owner: int = 0
    base: float | None = None
    slack: float = 0.02
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time
    slot: int = 0

    def _wait(self) -> None:
        if self.base is None:
            self.base = self.clock()
        step = self.interval + self.slack
        while True:
            turn = (self.clock() - self.base - self.slack) / step
            past = math.ceil((turn - self.owner) / self.owners)  # slots of mine that are over
            self.slot = max(self.slot, past)
            begin = self.base + (self.slot * self.owners + self.owner) * step
            if (wait := begin - self.clock()) > 0:
                self.sleep(wait)
            self.slot += 1
            if self.clock() <= begin + self.slack:
                return

    def call(self, prompts: list[str]) -> list[str]:
        out: list[str] = []
        for p in prompts:
            self._wait()
            out += self.provider.call([p])
        return out


@dataclass(frozen=True)
class Checked:
    """Asks again, up to ``retries`` times, for replies that are not valid; what is not valid then is None."""

    provider: Provider
    valid: Callable[[str], bool]
    retries: int = 2

    def call(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(prompts)
        open_ = list(range(len(prompts)))
        for _ in range(self.retries + 1):
            for k, reply in zip(open_, self.provider.call([prompts[k] for k in open_]), strict=True):
                out[k] = reply if self.valid(reply) else None
            open_ = [k for k in open_ if out[k] is None]
            if not open_:
                break
        return out

