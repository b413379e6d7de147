"""One rate of calls for all tasks of a stage.

Time is cut into turns of ``sleep`` seconds since ``start``, and turns are dealt to
lanes in a circle.  Each row belongs to a lane, each lane to one task, and a call
waits for its lane's next turn.  So no two calls begin in one turn, whichever
tasks run, and a lane that comes late can't catch up.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field


class Clock:
    """The machine's time; a test brings its own."""

    def now(self) -> float:
        return time.time()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


@dataclass
class Pace:
    sleep: float
    lanes: int
    start: float = 0.0
    clock: Clock = field(default_factory=Clock)

    def wait(self, lane: int, last: int | None) -> int | None:
        """Wait for the lane's next turn, after turn ``last``; returns its number."""
        if self.sleep <= 0:
            return None
        now = self.clock.now()
        # Turns that have begun are over, but for one that begins just now.
        first = max(math.ceil((now - self.start) / self.sleep - 1e-9), 0 if last is None else last + 1)
        turn = first + (lane - first) % self.lanes
        ahead = self.start + turn * self.sleep - now
        if ahead > 0:
            self.clock.sleep(ahead)
        return turn


def called(call: Callable[[], dict], pace: Pace, lane: int, last: int | None, attempts: int) -> tuple[dict | None, str | None, int, int | None]:
    """What a call gives at last, why not, how often it was made, and the last turn taken."""
    error, made = None, 0
    while made < max(1, attempts):
        last, made = pace.wait(lane, last), made + 1
        try:
            return call(), None, made, last
        except Exception as problem:  # every failure ends in the table of failures
            error = f"{type(problem).__name__}: {problem}"
    return None, error, made, last
