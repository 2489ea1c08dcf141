"""Items wait by blocks, so that the store is asked for a block and not for each item."""

import random

from millrace.streaming import reorder


class Row:
    def __init__(self, item):
        self.item, self.payloads = item, [] if item % 7 == 3 else [str(item)]


class State:
    def __init__(self):
        self.value, self.map, self.asked = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return State()

    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.map

    def getValue(self, key):
        self.asked += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.asked += 1
        self.map[key] = value

    def removeKey(self, key):
        self.asked += 1
        del self.map[key]


def test_the_store_is_asked_by_block(monkeypatch):
    monkeypatch.setattr(reorder, "CHUNK", 64, raising=False)
    monkeypatch.setattr(reorder, "BLOCK", 64, raising=False)
    rng, handle = random.Random(1), State()
    order = reorder.InOrder()
    order.init(handle)
    items = list(range(3000))
    parts = [[i for i in items if i * 2654435761 % 5 == n] + rng.sample(items, 20) for n in (3, 1, 4, 2, 0)]
    parts[1] = rng.sample(parts[1], len(parts[1]))
    out = [r for part in parts for r in order.handleInputRows(("s",), map(Row, part), None)]
    want = [i for i in items if i % 7 != 3]
    assert [(r.item, r.payload, r.row, r.position) for r in out] == [(i, str(i), 0, n) for n, i in enumerate(want)]
    assert not order.waiting.map
    assert order.waiting.asked < len(items)
