"""The loop with a scripted client, and the command line."""

import pytest
from tests.helpers import weekdays

from tessera.__main__ import main
from tessera.plans import agent, api


class FakeTools:
    def __init__(self, fail=False):
        self.fail = fail
        self.session = api.Session()

    def dispatch(self, name, arguments):
        if self.fail:
            raise api.ToolError("no")
        if name == "run_backtest":
            self.session.put("backtest", None, {})
        return {"ok": name}


def scripted(*replies):
    left = list(replies)
    return lambda messages, tools: left.pop(0)


def call(name):
    return agent.Reply("", [("1", name, {})], 10)


def test_a_run_ends_with_an_answer():
    got = agent.run(scripted(call("run_backtest"), call("analyze_results"), agent.Reply("done")), FakeTools(), "q")
    assert got.answer == "done" and got.completed and got.analysed and got.turns == 3


def test_a_forgotten_analysis_is_asked_for_once():
    got = agent.run(scripted(call("run_backtest"), agent.Reply("done"), agent.Reply("still done")), FakeTools(), "q")
    assert got.answer == "still done" and not got.analysed


@pytest.mark.parametrize(("replies", "options", "reason"), [([call("x")] * 9, {"max_turns": 4}, "max_turns"), ([call("x")] * 9, {"max_tokens": 15}, "token_budget")])
def test_guards(replies, options, reason):
    assert agent.run(scripted(*replies), FakeTools(), "q", **options).stop_reason == reason


def test_the_same_error_again_and_again():
    assert agent.run(scripted(*[call("x")] * 9), FakeTools(fail=True), "q").stop_reason == "repeated_error"


def test_command_line(spark, capsys):
    assert main(["registry"]) == 0 and "momentum_12_1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["suite"])
    assert len(weekdays(2)) == 2
