"""Folds by column give what they give row by row; a bucket's rows are read some blocks at a time."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from taplight import settings as S
from taplight.streaming import folds, ordered_fold as O

TEXT, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
ROWS = T.StructType([T.StructField(n, k) for n, k in (
    ("flow_id", TEXT), ("src_ip", TEXT), ("dst_ip", TEXT), ("start_time", DOUBLE), ("dst_port", LONG),
    ("dst_ports", T.ArrayType(LONG)), ("summary_ports", LONG), ("summary_hosts", LONG), ("slow_end", DOUBLE),
    ("packet_count", LONG), ("bytes_transferred", LONG), ("fires", T.BooleanType()))])


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def put(self, value):
        self.held = value

    update = put

    def clear(self):
        self.held = None


class _Map(dict):
    def updateValue(self, k, value):
        self[k] = value

    def getValue(self, k):
        return self[k]

    def removeKey(self, k):
        del self[k]


class _Handle:
    def getMapState(self, *_):
        return _Map()

    def getValueState(self, *_):
        return _Value()

    getListState = getValueState

    def registerTimer(self, *_):
        pass


def _processor(fold, keys):
    made = O._OrderedFold(fold, ROWS, keys, "start_time", "flow_id")
    made.init(_Handle())
    return made


def _flows(n, seed, even=False):
    rng, rows, at = random.Random(seed), [], 0.0
    for i in range(n):
        at += 60.0 if even and rng.random() < 0.99 else rng.choice((0.0, 1.0, 29.0, 30.0, 31.0, 700.0, 4000.0)) if rng.random() < 0.02 else rng.choice((0, 1, 5))
        rows.append((f"f{i:05}", rng.choice(("a", "b", "c", None)), ("x", "y", None)[i % 3] if even else rng.choice(("x", "y", None)), at, rng.choice((80, 443, None)),
                     rng.choice(([], [1, 2], [7], None)), rng.choice((0, 3, None)), rng.choice((0, 9, None)), at + rng.choice((5.0, 300.0)),
                     rng.choice((5, 5, 100)), 10, rng.random() < 0.5))
    return rows


@pytest.mark.parametrize("even", [False, True])
@pytest.mark.parametrize("fold, wanted", [
    (folds.SourceEntropy(cap=40), "fires"), (folds.ScanFanout(None), None), (folds.SlowConnections(), None),
    (folds.TrailingStarts(16), None), (folds.TrailingStarts(24, sparse_only=True, every_row=True), None),
    (folds.TrailingStarts(24, sparse_only=True), None)])
def test_columns_give_what_rows_give(fold, wanted, even, monkeypatch):
    monkeypatch.setattr(O, "_JUDGED", 61)
    rows = [r for r in _flows(900, 5, even) if r[2] or not isinstance(fold, folds.ScanFanout)]
    carried = folds.Carrying(fold, [f for f in ROWS.fields if f.name in ("flow_id", "src_ip", "dst_port")], wanted)
    made = _processor(carried, ["dst_ip"])
    for lo, hi in ((0, 300), (300, 900)):
        list(made.handleInputRows((1,), iter([pa.Table.from_pylist([dict(zip(ROWS.fieldNames(), r)) for r in rows[lo:hi]],
                                                                   to_arrow_schema(ROWS)).to_pandas()]), None))
    got = []
    for limit in (rows[len(rows) // 2][3], rows[-100][3], 1e9):
        got += [tuple(None if v is pd.NA else v for v in r) for part in made._due(limit) for r in part.itertuples(index=False)]
    want, states = [], {}
    for r in rows:
        row = dict(zip(ROWS.fieldNames(), r))
        state = states.get(r[2])
        state = None if state and fold.expires_at(state) <= r[3] else state
        states[r[2]], out = fold.step(state, row)
        if not wanted or row[wanted]:
            want += [(row["flow_id"], row["src_ip"], row["dst_port"], *t[4:], pd.Timestamp(round(r[3] * 1e6), unit="us", tz="UTC")) for t in out]
    assert len(got) == len(want)
    full = 0
    for a, b in zip(sorted(got, key=lambda r: r[0]), sorted(want, key=lambda r: r[0])):
        assert a[:3] == b[:3] and a[-1] == b[-1]
        if "series" not in carried.output.fieldNames():
            assert a[3:-1] == pytest.approx(b[3:-1], abs=1e-9)
        elif list(a[3]):
            assert list(a[3]) == b[3]
            full += 1
        elif len(b[3]) >= S.BEACON_CROSS_MIN:   # left out only where it is far too uneven
            gaps = pd.Series(b[3]).diff().dropna()
            assert gaps.std() > 0.28 * gaps.mean()
    assert full > 10 or not even or "series" not in carried.output.fieldNames()


def test_a_bucket_is_read_some_blocks_at_a_time(monkeypatch):
    monkeypatch.setattr(O, "_READ", 500)
    monkeypatch.setattr(O, "_BLOCK", 100)
    monkeypatch.setattr(O, "_RUN_BYTES", 200_000)
    monkeypatch.setattr(O, "_ALIVE", 10)
    rows = _flows(20_000, 7)
    random.Random(1).shuffle(rows)
    made, most, held = _processor(folds.Carrying(folds.SlowConnections(), ROWS.fields[:1]), ["src_ip", "dst_ip"]), 0, 0
    for lo in range(0, len(rows), 1000):
        list(made.handleInputRows((1,), iter([pa.Table.from_pylist([dict(zip(ROWS.fieldNames(), r)) for r in rows[lo:lo + 1000]],
                                                                   to_arrow_schema(ROWS)).to_pandas()]), None))
    middle, last, seen = sorted(r[3] for r in rows)[12_345], float("-inf"), []
    for limit in (middle, 1e9):
        for part, until in made._ready(limit):
            times = part.column("start_time").to_pylist()
            assert last <= min(times) and max(times) <= until <= limit
            most, last = max(most, part.num_rows), until if until < limit else last
            seen += part.column("flow_id").to_pylist()
        held = sum(b[1] for b in made._blocks())
        assert held == len(rows) - len(seen) == sum(r[3] > limit for r in rows) and len(made.waiting) == len(made._blocks())
    assert sorted(seen) == sorted(r[0] for r in rows) and most < len(rows) / 4
