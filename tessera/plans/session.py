"""A run's handles: lazy frames under readable names, and how many backtests it has made."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

KINDS = ("panel", "feature", "backtest", "analysis")
#: Most bytes of a result that a caller sees.
DIGEST_BYTES = 2000


class SessionError(Exception):
    """A handle that isn't there, or is of another kind."""


@dataclass
class Artifact:
    handle: str
    kind: str
    payload: Any
    digest: dict


@dataclass
class Session:
    """The number of backtests is the number of trials: it only grows, and every analysis is deflated by it."""

    artifacts: dict[str, Artifact] = field(default_factory=dict)
    n_backtests: int = 0

    def put(self, kind: str, payload: Any, digest: dict) -> dict:
        """Stores a payload and returns its digest with the new handle; an oversized digest is an error."""
        if kind not in KINDS:
            raise SessionError(f"unknown kind {kind!r}")
        handle = f"{kind}_{sum(a.kind == kind for a in self.artifacts.values()) + 1}"
        shown = {"handle": handle, **digest}
        if len(json.dumps(shown)) > DIGEST_BYTES:
            raise SessionError(f"the digest of {handle} is longer than {DIGEST_BYTES} bytes")
        self.artifacts[handle] = Artifact(handle, kind, payload, shown)
        self.n_backtests += kind == "backtest"
        return shown

    def get(self, handle: str, *kinds: str) -> Any:
        found = self.artifacts.get(handle)
        if found is None:
            raise SessionError(f"no handle {handle!r}; there are: {', '.join(self.artifacts) or 'none'}")
        if kinds and found.kind not in kinds:
            raise SessionError(f"{handle} is a {found.kind}, not a {' or '.join(kinds)}; of those there are: {', '.join(self.handles(*kinds)) or 'none'}")
        return found.payload

    def handles(self, *kinds: str) -> list[str]:
        return [h for h, a in self.artifacts.items() if not kinds or a.kind in kinds]

    def close(self) -> None:
        self.artifacts.clear()
