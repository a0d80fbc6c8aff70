"""Many keys share one state of an event-time fold: few calls to the store, same rows."""

import pandas as pd

from parcelyn.streaming import jobs


class _Value:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def exists(self):
        self.handle.calls += 1
        return self.value is not None

    def get(self):
        self.handle.calls += 1
        return self.value

    def update(self, value):
        self.handle.calls += 1
        self.value = value

    def clear(self):
        self.value = None


class _Map(dict):
    def __init__(self, handle):
        super().__init__()
        self.handle = handle

    def updateValue(self, key, value):
        self.handle.calls += 1
        self[key] = value

    def getValue(self, key):
        self.handle.calls += 1
        return self[key]

    def removeKey(self, key):
        self.handle.calls += 1
        del self[key]


class _Handle:
    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, *_):
        return _Map(self)

    def getValueState(self, *_):
        return _Value(self)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_grow_with_groups_not_with_keys():
    """3,000 keys of one group in disorder over two batches; a null is seen as None, whole numbers stay exact."""
    hour, big = 3_600_000, 2**62 + 1
    step = lambda carry, r: ((carry or 0) + 1, (r["n"], carry, r["us"]))
    fold, handle = jobs._Fold(["n"], "n", step, hour, 100 * hour, ["key", "n", "before", "us"]), _Handle()
    fold.init(handle)
    rows = [(f"k{k}", h * hour * 1000 + k, big if h else 0, 0 if h else 2) for h in range(3) for k in range(3000)]
    for part in (rows[1::2], rows[::2]):
        frame = pd.DataFrame({"key": [r[0] for r in part], "us": [r[1] for r in part], "v0": [r[2] for r in part], "nulls": [r[3] for r in part]})
        assert not list(fold.handleInputRows((0,), iter([frame]), _Mark(0)))
    assert handle.timers == {hour}
    handle.timers.clear()
    first = pd.concat(fold.handleExpiredTimer((0,), _Mark(hour + 5), None))
    assert len(first) == 3000 and first["n"].isna().all() and handle.timers == {2 * hour}
    rest = pd.concat(fold.handleExpiredTimer((0,), _Mark(3 * hour), None))
    assert set(rest["n"]) == {big} and sorted(set(rest["before"])) == [1, 2] and len(rest) == 6000
    assert not fold.waiting and handle.calls < 100
    # Idle keys go.
    assert not list(fold.handleExpiredTimer((0,), _Mark(200 * hour), None)) and fold.carries.value is None and fold.plan.value is None


def test_few_calls_a_row_over_all_groups():
    """100,000 rows of as many keys, dealt over all groups: the store is called once for ten rows or less."""
    hour, calls, made = 3_600_000, 0, 0
    rows = [(k, (k % 3) * hour * 1000 + k, float(k)) for k in range(100_000)]
    step = lambda last, r: (r["price"], (last, r["price"], r["us"]))
    for g in range(jobs.GROUPS):
        fold, handle = jobs._Fold(["price"], "price", step, hour, 100 * hour, ["key", "old", "new", "us"]), _Handle()
        fold.init(handle)
        own = rows[g :: jobs.GROUPS]
        frame = pd.DataFrame({"key": [r[0] for r in own], "us": [r[1] for r in own], "v0": [r[2] for r in own], "nulls": 0})
        assert not list(fold.handleInputRows((g,), iter([frame]), _Mark(0)))
        made += sum(map(len, fold.handleExpiredTimer((g,), _Mark(3 * hour), None)))
        calls += handle.calls
    assert made == len(rows) and calls < len(rows) / 10
