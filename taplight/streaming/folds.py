"""State machines behind the streaming operators, each with bounded state and expiry."""

from __future__ import annotations

import json
import math
from collections import Counter, deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import settings as S
from .ordered_fold import Fold


class FlowRecords(Fold):
    """Packets to flow records with idle, active and close cuts."""

    output = T.StructType([
        T.StructField("flow_id", T.StringType()), T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()), T.StructField("protocol", T.StringType()),
        T.StructField("packet_count", T.LongType()),
        T.StructField("bytes_transferred", T.LongType()),
        T.StructField("start_time", T.DoubleType()), T.StructField("end_time", T.DoubleType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("timestamps", T.ArrayType(T.DoubleType())),
        T.StructField("packet_sizes", T.ArrayType(T.LongType()))])

    def __init__(self, idle: float = S.FLOW_IDLE_SECONDS, active: float = S.FLOW_ACTIVE_SECONDS):
        self.idle, self.active = idle, active

    def step(self, state, row):
        out = []
        if state and (state["closed"] or row["ts"] >= state["last"] + self.idle
                      or row["ts"] >= state["first"] + self.active):
            out, state = self.on_expiry(state), None
        if state is None:
            state = {"id": [row[k] for k in ("flow_id", "src_ip", "dst_ip", "src_port",
                                             "dst_port", "protocol")],
                     "n": 0, "bytes": 0, "first": row["ts"], "ts": [], "sizes": []}
        state["n"] += 1
        state["bytes"] += row["packet_size"]
        state["last"] = row["ts"]
        if len(state["ts"]) < S.SERIES_CAP:
            state["ts"].append(row["ts"])
            state["sizes"].append(row["packet_size"])
        flags = row["flags"] or ""
        state["closed"] = row["protocol"] == "tcp" and ("F" in flags or "R" in flags)
        return state, out

    def expires_at(self, state):
        return state["last"] + self.idle

    def on_expiry(self, state):
        span = 0.0 if state["n"] <= 1 else state["last"] - state["first"]
        return [(*state["id"], state["n"], state["bytes"], state["first"], state["last"], span,
                 state["ts"], state["sizes"])]


class Carrying(Fold):
    """A fold that emits a row for each of its input rows, with that row's columns ``carry``
    instead of the contact's. Rows where ``wanted`` is not set are folded in silence.

    The carried columns stay Arrow arrays; only what the fold reads become Python values.
    """

    def __init__(self, fold: Fold, carry: list[T.StructField], wanted: str | None = None):
        self.fold, self.carry, self.wanted = fold, [f.name for f in carry], wanted
        self.output = T.StructType([*carry, *fold.output.fields[len(_CONTACT):],
                                    T.StructField("event_time", T.TimestampType())])

    def judge(self, part, keys, states):
        wanted = part.column(self.wanted).to_pylist() if self.wanted else [True] * len(keys)
        at, values = self.fold.across(part, keys, states, wanted)
        rows = part.select([*self.carry, *(() if "start_time" in self.carry else ("start_time",))]).take(
            pa.array(at, pa.int64())).combine_chunks()
        kinds, out = to_arrow_schema(self.output), {}
        for field in kinds:
            if field.name in self.carry:
                column = rows.column(field.name).cast(field.type)
            elif field.name == "event_time":
                column = pc.round(pc.multiply(rows.column("start_time"), 1e6)).cast(pa.int64()).cast(field.type)
            else:
                found = values[field.name]
                # Spark takes lists as they are; other columns pass through as Arrow arrays.
                out[field.name] = pd.Series(found, dtype=object) if pa.types.is_list(field.type) else pd.Series(
                    pd.arrays.ArrowExtensionArray(pa.array(found, field.type)))
                continue
            out[field.name] = pd.Series(pd.arrays.ArrowExtensionArray(column.combine_chunks()))
        yield pd.DataFrame(out)

    def expires_at(self, state):
        return self.fold.expires_at(state)

    def on_expiry(self, state):
        return self.fold.on_expiry(state)


class _Contacts(Fold):
    """A fold of a key's contacts whose states end without output."""

    reads: tuple[str, ...]

    def across(self, part, keys, states, wanted):
        """Positions of the rows with output, and its columns after the contact's, by name. States follow."""
        at, found, names = [], [], self.output.fieldNames()[len(_CONTACT):]
        rows = zip(*[part.column(c).to_pylist() for c in self.reads])
        for i, (k, values) in enumerate(zip(keys, rows)):
            row, state = dict(zip(self.reads, values)), states.get(k)
            if state is not None and self.expires_at(state) <= row["start_time"]:
                state = None
            states[k], out = self.step(state, row)
            if wanted[i]:
                at += [i] * len(out)
                found += [t[len(_CONTACT):] for t in out]
        return at, dict(zip(names, zip(*found) if found else [()] * len(names)))


_CONTACT = [T.StructField("flow_id", T.StringType()), T.StructField("src_ip", T.StringType()),
            T.StructField("dst_ip", T.StringType()), T.StructField("start_time", T.DoubleType())]


class TrailingStarts(_Contacts):
    """Last start times of a key, for the periodicity test. ``sparse_only`` keeps small
    flows and reports once two sources have contributed; before that it is silent, or with
    ``every_row`` reports no series."""

    output = T.StructType([*_CONTACT, T.StructField("series", T.ArrayType(T.DoubleType()))])

    def __init__(self, rows: int, sparse_only: bool = False,
                 ttl: float = S.STATE_IDLE_SECONDS["beacon"], every_row: bool = False):
        self.rows, self.sparse_only, self.ttl, self.every_row = rows, sparse_only, ttl, every_row

    def step(self, state, row):
        state = state or {"starts": [], "sources": []}
        state["last"] = row["start_time"]
        sparse = row["packet_count"] <= S.BEACON_SPARSE_PACKETS \
            and row["bytes_transferred"] < S.BEACON_SPARSE_BYTES
        if sparse or not self.sparse_only:
            state["starts"] = [*state["starts"], row["start_time"]][-self.rows:]
            if len(state["sources"]) < 2 and row["src_ip"] not in state["sources"]:
                state["sources"].append(row["src_ip"])
        if self.sparse_only and len(state["sources"]) < 2:
            return state, [(row["flow_id"], row["src_ip"], row["dst_ip"], row["start_time"],
                            [])] if self.every_row else []
        return state, [(row["flow_id"], row["src_ip"], row["dst_ip"], row["start_time"],
                        state["starts"])]

    def across(self, part, keys, states, wanted):
        """Series that are too uneven for the periodicity test by a wide margin come out empty."""
        at, series, tested, key, starts, sources, last = [], [], [], None, [], [], None

        def left() -> None:
            if tested:
                even = self._even(starts, [end for _, end in tested])
                for (i, end), kept in zip(tested, even):
                    if kept:
                        series[i] = starts[max(0, end - self.rows):end]
                tested.clear()

        columns = (part.column(c).to_pylist() for c in ("start_time", "src_ip", "packet_count", "bytes_transferred"))
        for i, (k, now, src, packets, size) in enumerate(zip(keys, *columns)):
            if k != key:
                left()
                if key is not None:
                    states[key] = {"starts": starts[-self.rows:], "sources": sources, "last": last}
                key, state = k, states.get(k)
                starts, sources, last = (list(state["starts"]), list(state["sources"]), state["last"]) if state else ([], [], None)
            if last is not None and last + self.ttl <= now:
                left()
                starts, sources = [], []
            last = now
            if not self.sparse_only or (packets <= S.BEACON_SPARSE_PACKETS and size < S.BEACON_SPARSE_BYTES):
                starts.append(now)
                if len(sources) < 2 and src not in sources:
                    sources.append(src)
            silent = self.sparse_only and len(sources) < 2
            if wanted[i] and (not silent or self.every_row):
                at.append(i)
                series.append([])
                if not silent and len(starts) >= S.BEACON_CROSS_MIN:
                    tested.append((len(series) - 1, len(starts)))
        left()
        if key is not None:
            states[key] = {"starts": starts[-self.rows:], "sources": sources, "last": last}
        return at, {"series": series}

    def _even(self, starts: list[float], ends: list[int]) -> np.ndarray:
        """Whether the gaps before each end vary by little more than the test allows, or may not be told."""
        gaps, ends = np.diff(np.asarray(starts)), np.asarray(ends)
        n = np.minimum(ends, self.rows) - 1
        total = np.concatenate([[0.0], np.cumsum(gaps)])[ends - 1]
        squares = np.concatenate([[0.0], np.cumsum(gaps * gaps)])[ends - 1]
        with np.errstate(all="ignore"):
            var = (squares - total * total / n) / (n - 1)
            mean = total / n
            full = ends > self.rows
            if full.any():
                # Long series are summed on their own, since differences of running sums lose digits.
                view = np.lib.stride_tricks.sliding_window_view(gaps, self.rows - 1)[ends[full] - self.rows]
                mean[full], var[full] = view.mean(axis=1), view.var(axis=1, ddof=1)
            return ~(var > (S.BEACON_EVEN * mean) ** 2)

    def expires_at(self, state):
        return state["last"] + self.ttl


class ScanFanout(_Contacts):
    """Distinct ports and hosts over a source's last 4,000 flow keys. A repeated key
    replaces its entry and keeps its place in the eviction order."""

    reads = ("flow_id", "src_ip", "dst_ip", "start_time", "dst_port", "dst_ports", "summary_ports", "summary_hosts")
    output = T.StructType([*_CONTACT, T.StructField("unique_dst_ports", T.LongType()),
                           T.StructField("unique_dst_hosts", T.LongType())])

    def __init__(self, cap: int | None = S.SCAN_FLOW_CAP,
                 ttl: float = S.STATE_IDLE_SECONDS["scan"]):
        self.cap, self.ttl = cap, ttl

    def step(self, state, row):
        state = state or {"flows": {}, "ports": {}, "hosts": {}}
        ports = sorted({*(row["dst_ports"] or []),
                        *([] if row["dst_port"] is None else [row["dst_port"]])})
        old = state["flows"].get(row["flow_id"])
        if old:
            self._count(state, old, -1)
        entry = [row["dst_ip"], [str(p) for p in ports], int(row["summary_ports"] or 0)]
        state["flows"][row["flow_id"]] = entry
        self._count(state, entry, 1)
        evicted = self.cap is not None and len(state["flows"]) > self.cap
        if evicted:
            self._count(state, state["flows"].pop(next(iter(state["flows"]))), -1)
        state["last"] = row["start_time"]
        # The largest summary is looked for again only when the flow that had it left.
        gone = old and old[2] == state.get("biggest")
        state["biggest"] = max(f[2] for f in state["flows"].values()) if gone or evicted else max(
            state.get("biggest", 0), entry[2])
        biggest = state["biggest"]
        return state, [(row["flow_id"], row["src_ip"], row["dst_ip"], row["start_time"],
                        max(len(state["ports"]), biggest, len(ports)),
                        max(len(state["hosts"]), int(row["summary_hosts"] or 0), 1))]

    @staticmethod
    def _count(state, entry, change):
        for table, items in (("hosts", [entry[0]]), ("ports", entry[1])):
            for item in items:
                left = state[table].get(item, 0) + change
                if left:
                    state[table][item] = left
                else:
                    del state[table][item]

    def expires_at(self, state):
        return state["last"] + self.ttl


class SourceEntropy(_Contacts):
    """Normalised entropy of the sources toward a destination, trailing 30 s or 500 flows."""

    output = T.StructType([*_CONTACT, T.StructField("src_ip_entropy", T.DoubleType())])

    def __init__(self, window: float = S.ENTROPY_WINDOW_SECONDS, cap: int = S.ENTROPY_WINDOW_ROWS):
        self.window, self.cap = window, cap

    def step(self, state, row):
        now = row["start_time"]
        kept = [x for x in (state or {"recent": []})["recent"] if x[0] >= now - self.window]
        recent = [*kept, [now, row["src_ip"]]][-self.cap:]
        if not row.get("fires", True):
            return {"recent": recent}, [(row["flow_id"], row["src_ip"], row["dst_ip"], now, None)]
        counts: dict[str, int] = {}
        for _, src in recent:
            counts[src] = counts.get(src, 0) + 1
        n = len(recent)
        if n < 2:
            value = 1.0
        elif len(counts) == 1:
            value = 0.0
        else:
            mass = sum(c * math.log2(c) for c in counts.values())
            value = (math.log2(n) - mass / n) / math.log2(len(counts))
        return {"recent": recent}, [(row["flow_id"], row["src_ip"], row["dst_ip"], now, value)]

    def across(self, part, keys, states, wanted):
        weight = [0.0] + [c * math.log2(c) for c in range(1, self.cap + 2)]
        at, values, key, recent, counts, mass = [], [], None, deque(), {}, 0.0
        fires = part.column("fires").to_pylist() if "fires" in part.column_names else [True] * len(keys)
        columns = (part.column(c).to_pylist() for c in ("start_time", "src_ip"))
        for i, (k, now, src) in enumerate(zip(keys, *columns)):
            if k != key:
                if key is not None:
                    states[key] = {"recent": list(map(list, recent))}
                key, recent = k, deque(map(tuple, (states.get(k) or {"recent": []})["recent"]))
                counts = Counter(s for _, s in recent)
                mass = sum(weight[c] for c in counts.values())
            if recent and recent[-1][0] + self.window <= now:
                recent, counts, mass = deque(), {}, 0.0
            recent.append((now, src))
            c = counts.get(src, 0) + 1
            counts[src] = c
            mass += weight[c] - weight[c - 1]
            while len(recent) > self.cap or recent[0][0] < now - self.window:
                _, old = recent.popleft()
                c = counts.pop(old) - 1
                mass += weight[c] - weight[c + 1]
                if c:
                    counts[old] = c
            if wanted[i]:
                n, kinds = len(recent), len(counts)
                at.append(i)
                values.append(None if not fires[i] else 1.0 if n < 2 else 0.0 if kinds == 1 else (
                    math.log2(n) - mass / n) / math.log2(kinds))
        if key is not None:
            states[key] = {"recent": list(map(list, recent))}
        return at, {"src_ip_entropy": values}

    def expires_at(self, state):
        return state["recent"][-1][0] + self.window


class SlowConnections(_Contacts):
    """Slow connections open at a server when each candidate starts."""

    reads = ("flow_id", "src_ip", "dst_ip", "start_time", "slow_end")
    output = T.StructType([*_CONTACT, T.StructField("concurrent", T.LongType()),
                           T.StructField("distinct_sources", T.LongType())])

    def __init__(self, ttl: float = S.STATE_IDLE_SECONDS["slow_rate"]):
        self.ttl = ttl

    def step(self, state, row):
        start, end = row["start_time"], row["slow_end"]
        still = [x for x in (state or {"open": []})["open"] if x[0] >= start]
        still.append([end, row["src_ip"]])
        return {"open": still}, [(row["flow_id"], row["src_ip"], row["dst_ip"], start, len(still),
                                  len({src for _, src in still}))]

    def expires_at(self, state):
        return max(end for end, _ in state["open"]) + self.ttl


class AlertMerge(Fold):
    """Alerts merged within a fixed window of the group's first; one row per closed group."""

    output = T.StructType([
        T.StructField("alert_id", T.StringType()), T.StructField("threat_class", T.StringType()),
        T.StructField("source_ip", T.StringType()), T.StructField("destination_ip", T.StringType()),
        T.StructField("protocol", T.StringType()), T.StructField("ts", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("first_severity", T.StringType()),
        T.StructField("n_detections", T.LongType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("evidence_json", T.StringType())])

    def __init__(self, window: float = S.MERGE_WINDOW_SECONDS):
        self.window = window

    def step(self, state, row):
        out = []
        if state and row["ts"] >= state["first"] + self.window:
            out, state = self.on_expiry(state), None
        if state is None:
            state = {"id": [row[k] for k in ("alert_id", "threat_class", "source_ip",
                                             "destination_ip", "protocol")],
                     "first": row["ts"], "conf": row["confidence"], "sev": row["severity"],
                     "n": 0, "names": [], "items": []}
        state["n"] += int(row.get("coalesced") or 1)
        state["conf"] = max(state["conf"], row["confidence"])
        for item in json.loads(row["evidence_json"] or "[]"):
            if item.get("feature_name") not in state["names"]:
                state["names"].append(item.get("feature_name"))
                state["items"].append(item)
        return state, out

    def expires_at(self, state):
        return state["first"] + self.window

    def on_expiry(self, state):
        return [(*state["id"], state["first"], state["conf"], state["sev"], state["n"],
                 state["names"], json.dumps(state["items"]))]


class AlertUpdates(AlertMerge):
    """The same groups, also each time one has grown, with a flag for the closed ones."""

    output = T.StructType([*AlertMerge.output.fields, T.StructField("closed", T.BooleanType())])

    def on_expiry(self, state):
        return [(*row, True) for row in super().on_expiry(state)]

    def grown(self, state):
        return [(*row, False) for row in super().on_expiry(state)]
