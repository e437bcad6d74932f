"""What a keyed stream asks of its state, on a state held in memory."""

import random

import pandas as pd
from pyspark.sql import types as T

from zoneflow.streaming.ordered import CHUNK, STRETCHES, InOrder

HELD = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("nr", T.LongType())])
DELAY = 16_000


class Memory:
    """State of one key and its timers; counts what is asked."""

    def __init__(self):
        self.maps, self.value, self.timers, self.asked = {}, None, set(), 0

    getMapState = getValueState = lambda self, *_: self

    def registerTimer(self, time):
        self.asked += 1
        self.timers.add(time)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def keys(self):
        return iter(list(self.maps))

    def containsKey(self, key):
        return key in self.maps

    def getValue(self, key):
        self.asked += 1
        return self.maps[key]

    def updateValue(self, key, value):
        self.asked += 1
        self.maps[key] = value

    def removeKey(self, key):
        del self.maps[key]

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Collected(InOrder):
    def start(self, handle):
        self.seen = []

    def ready(self, key, rows):
        self.seen += rows
        return self.given(rows)


def played(batches):
    """The rows in the order they are handled in, and what each batch asks of the state, timers included."""
    memory, processor = Memory(), Collected(HELD, "ts_ms", ["ts_ms", "nr"], HELD)
    processor.stretch, processor.delay = DELAY // STRETCHES, DELAY
    processor.init(memory)
    memory.watermark, newest, asked = 0, 0, []
    for batch in [*batches, []]:
        memory.asked = 0
        if batch:
            list(processor.handleInputRows((1,), iter([pd.DataFrame(batch, columns=HELD.names)]), memory))
        for time in sorted(t for t in memory.timers if t <= memory.watermark):
            memory.timers.discard(time)
            list(processor.handleExpiredTimer((1,), memory, None))
        asked.append(memory.asked)
        newest = max([newest, *[t for t, _ in batch]])
        memory.watermark = max(memory.watermark, newest - DELAY) if batch[1:] else newest
    while memory.timers:
        memory.watermark = min(memory.timers)
        memory.timers.discard(memory.watermark)
        list(processor.handleExpiredTimer((1,), memory, None))
    assert not memory.maps
    return processor.seen, asked


def test_a_long_replay_asks_little_of_the_state():
    """Many stretches come in one batch, as when a stream catches up; each has a row or two."""
    rows = [(1 + i * 800, i) for i in range(8000)]
    random.Random(5).shuffle(half := rows[:4000])
    seen, asked = played([half, rows[4000:], [(10_000_000, 9_000)]])
    assert seen == [*rows, (10_000_000, 9_000)]
    # Two batches: chunks written and read once, the last delay by stretches, a few timers.
    assert max(asked) <= 4 * (4000 // CHUNK + 1 + STRETCHES) + 10


def test_rows_of_overlapping_chunks_keep_their_order():
    """Batches that overlap in time by less than the delay, with rows of equal times."""
    dice = random.Random(7)
    rows = [(1 + dice.randrange(400) * 400, i) for i in range(3000)]
    arriving = sorted(rows, key=lambda r: r[0] + dice.randrange(DELAY))
    cuts = sorted(dice.sample(range(3000), 9))
    batches = [arriving[a:b] for a, b in zip([0, *cuts], [*cuts, 3000])]
    seen, _ = played(batches)
    assert seen == sorted(rows)
