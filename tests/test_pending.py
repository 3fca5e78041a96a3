"""Pending cases: what a chat's rows cost in calls of the state store, and what counts as an answer."""

import pandas as pd

from quillspark.streaming.streams import PendingCases


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None


class Handle:
    def getValueState(self, name, schema):  # noqa: N802
        self.state = Value()
        return self.state


def table(*rows):
    return pd.DataFrame([(pd.Timestamp(2024, 1, 1) + pd.Timedelta(seconds=s), *row) for s, *row in rows], columns=["ts", "kind", "fact", "branches"])


def test_calls_do_not_grow_with_rows():
    handle, cases = Handle(), PendingCases()
    cases.init(handle)
    rows = table(*((n, "answer" if n % 10 else "result", f"f{n % 7}", None) for n in range(1, 1001)))
    (closed,) = cases.handleInputRows((1,), iter([rows[500:], rows[:500]]), None)
    assert len(closed) == 100 and closed["facts"][0] == "f0,f1,f2,f3,f4,f5,f6" and closed["closed_at"].is_monotonic_increasing
    assert handle.state.calls == 2 and handle.state.value is None


def test_answers():
    handle, cases = Handle(), PendingCases()
    cases.init(handle)
    first = table((1, "pending", None, ["yes", "no"]), (2, "answer", "2", None), (3, "answer", "3", None), (4, "answer", "²", None), (5, "answer", None, None))
    assert cases.apply((1,), first).empty and handle.state.value == (["3", "no", "²"], ["yes", "no"])
    assert cases.apply((1,), table((6, "answer", "1", None), (7, "topic", None, None)))["facts"].tolist() == ["3,no,yes,²"]
