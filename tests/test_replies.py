"""Streams of replies and decisions after failed attempts, on small cases."""

import json

from veriseam.operators import replies


def chunk(**kw):
    return "data: " + json.dumps(kw)


def delta(text=None, thought=None, finish=None):
    return {"delta": {"content": text, "reasoning_content": thought}, "finish_reason": finish}


STREAMS = {
    "whole": [chunk(id="r1", model="m", choices=[delta(thought="Let me ")]), ": keep-alive", "", chunk(id="r1", choices=[delta("Hel", "see.")]), "event: x", chunk(choices=[delta("lo"), delta(" you", finish="stop")]), chunk(choices=[], usage={"total": 3}), "data: [DONE]", chunk(choices=[delta("late")])],
    "cut": [chunk(id="r2", choices=[delta("part")])],
    "odd": [chunk(choices=[delta("a", finish="stop")]), "data: {broken", chunk(choices=[delta("b")])],
    "odd early": ["data: nonsense", chunk(choices=[delta("b", finish="stop")])],
    "account": [chunk(choices=[delta("a")]), chunk(error={"code": "Arrearage", "message": "pay"})],
    "request": [chunk(code="DataInspectionFailed", message="no")],
    "passing": [chunk(error={"type": "server", "message": "Too many requests"})],
    "message": ['data: {"id": "r9", "choices": [{"message": {"content": "All"}, "finish_reason": "length"}], "usage": {"t": 1}}'],
    "nothing": ["event: ping"],
}


def test_streams(spark):
    rows = [(k, i, line) for k, lines in STREAMS.items() for i, line in enumerate(lines)]
    got = {r["reply"]: r for r in replies.assemble(spark.createDataFrame(rows, "reply string, seq int, line string")).collect()}
    r = got["whole"]
    assert (r["content"], r["reasoning"], r["finish_reason"], r["id"], r["model"], r["events"], r["outcome"]) == ("Hello you", "Let me see.", "stop", "r1", "m", 4, "complete")
    assert json.loads(r["usage"]) == {"total": 3}
    assert {k: (r["content"], r["outcome"]) for k, r in got.items() if k != "whole"} == {
        "cut": ("part", "broken"), "odd": ("a", "complete"), "odd early": ("", "broken"), "account": ("a", "account"), "request": ("", "request"), "passing": ("", "broken"), "message": ("All", "complete"), "nothing": ("", "broken"),
    }
    assert len(got) == len(STREAMS)


def test_decisions(spark):
    rows = [(1, 429, "x", None), (2, 503, None, "7"), (3, 500, "y", "soon"), (6, 504, "", None), (7, 504, "", None), (1, 400, "InvalidParameter", None), (1, 429, "Arrearage", "3"), (1, 400, "throttled", "-4"), (1, 404, "what", None), (5, 200, "timeout", "999"), (1, None, None, None)]
    got = [(r["kind"], r["action"], r["pause"]) for r in replies.decisions(spark.createDataFrame(rows, "attempt int, http int, message string, retry_after string")).collect()]
    assert got == [("", "retry", 5.0), ("", "retry", 7.0), ("", "retry", 20.0), ("", "retry", 120.0), ("", "give up", None), ("request", "stop: request", None), ("account", "stop: account", None), ("passing", "retry", 0.0), ("", "fail", None), ("passing", "retry", 120.0), ("", "fail", None)]
