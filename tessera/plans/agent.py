"""The optional loop around the tools: a client answers, tool calls are run, guards stop it. Queries never need it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from tessera.plans.api import ToolError, Tools, tool_schemas

REQUIRED = "analyze_results"


@dataclass
class Reply:
    """What the client says: text, and tool calls as (id, name, arguments)."""

    text: str
    calls: list[tuple[str, str, dict]] = field(default_factory=list)
    tokens: int = 0


@dataclass
class Run:
    answer: str = ""
    stop_reason: str = "end_turn"
    turns: int = 0
    tokens: int = 0
    sequence: list[str] = field(default_factory=list)
    errors: int = 0
    messages: list[dict] = field(default_factory=list)

    @property
    def completed(self) -> bool:
        return self.stop_reason == "end_turn"

    @property
    def analysed(self) -> bool:
        return REQUIRED in self.sequence


def run(client: Callable[[list[dict], list[dict]], Reply], tools: Tools, question: str, max_turns: int = 20, max_tokens: int = 200_000, max_repeats: int = 3) -> Run:
    """Asks until the client makes no more calls, or a guard fires: turns, tokens, or the same error again and again.

    A client that stops after a backtest that it hasn't analysed is reminded, once.
    """
    out, last, repeats, reminded = Run(messages=[{"role": "user", "content": question}]), "", 0, False
    while True:
        if out.turns >= max_turns:
            out.stop_reason = "max_turns"
            return out
        reply = client(out.messages, tool_schemas())
        out.turns += 1
        out.tokens += reply.tokens
        out.messages.append({"role": "assistant", "content": reply.text, "calls": reply.calls})
        if not reply.calls:
            if tools.session.n_backtests and not out.analysed and not reminded:
                reminded = True
                out.messages.append({"role": "user", "content": f"A backtest hasn't been analysed: call {REQUIRED} before you conclude."})
                continue
            out.answer = reply.text
            return out
        results = []
        for call, name, arguments in reply.calls:
            out.sequence.append(name)
            try:
                content, failed = json.dumps(tools.dispatch(name, arguments)), False
            except ToolError as e:
                content, failed = str(e), True
                out.errors += 1
            repeats = repeats + 1 if failed and content == last else int(failed)
            last = content if failed else ""
            results.append({"type": "tool_result", "id": call, "content": content, "is_error": failed})
        out.messages.append({"role": "user", "content": results})
        if repeats >= max_repeats:
            out.stop_reason = "repeated_error"
            return out
        if out.tokens > max_tokens:
            out.stop_reason = "token_budget"
            return out
