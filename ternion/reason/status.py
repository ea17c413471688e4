"""What is known about the derived triples: whether there are any and whether they are up to date."""

from __future__ import annotations

import time
from dataclasses import dataclass, field


@dataclass
class Status:
    state: str = "initialized"  # then materialized, or stale after a change
    profile: str | None = None
    runs: int = 0
    last: dict[str, object] = field(default_factory=dict)
    at: float | None = None
    changed: float | None = None

    def materialized(self, report: dict[str, object], profile: str) -> None:
        self.state, self.profile, self.last, self.at = "materialized", profile, report, time.time()
        self.runs += 1

    def stale(self) -> None:
        self.state, self.changed = "stale", time.time()

    def as_dict(self) -> dict[str, object]:
        return {"state": self.state, "profile": self.profile, "runs": self.runs, "last": self.last, "at": self.at, "needs_rematerialization": self.state == "stale"}
