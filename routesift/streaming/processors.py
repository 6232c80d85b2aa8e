"""Stateful processors: one state per key, event-time timers to forget."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import pairwise
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def micros(t) -> int:
    return int(pd.Timestamp(t).value // 1000)


def in_order(rows) -> list[Row]:
    return sorted(rows, key=lambda r: (r.timestamp, r.event_id))


class Flapping(StatefulProcessor):
    """Sliding window per prefix: emits events with enough events and changes of direction in it.

    The changes in the window are kept as a count while it slides; a timer forgets idle prefixes.
    """

    def __init__(self, seconds: int, min_events: int, min_changes: int) -> None:
        self.span, self.min_events, self.min_changes = seconds * 1_000_000, min_events, min_changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", "at long, kind string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = deque((x[0], x[1]) for x in self.window.get())
        changes = sum(a[1] != b[1] for a, b in pairwise(held))
        for r in in_order(rows):
            at = micros(r.timestamp)
            changes += bool(held) and held[-1][1] != r.event_type
            held.append((at, r.event_type))
            while held[0][0] < at - self.span:
                first = held.popleft()
                changes -= first[1] != held[0][1]
            if len(held) >= self.min_events and changes >= self.min_changes:
                yield Row(event_id=r.event_id, prefix=key[0], n_events=len(held), n_changes=changes)
        self.window.put(list(held))
        self.handle.registerTimer((held[-1][0] + self.span) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last = max((x[0] for x in self.window.get()), default=None)
        if last is not None and (last + self.span) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


class Ema(StatefulProcessor):
    """Path-length baseline per prefix: emits the state after every event."""

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "ema double, var double, n long")

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:
        self.state.update((initialState.at[0, "ema"], initialState.at[0, "var"], int(initialState.at[0, "n"])) if hasattr(initialState, "at") else (initialState.ema, initialState.var, initialState.n))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ema, var, n = self.state.get() if self.state.exists() else (0.0, 0.0, 0)
        for r in in_order(rows):
            x = float(r.x)
            if n == 0:
                ema, var = x, 0.0
            else:
                delta = x - ema
                ema, var = ema + self.alpha * delta, (1 - self.alpha) * (var + self.alpha * delta * delta)
            n += 1
            yield Row(event_id=r.event_id, prefix=key[0], ema=ema, var=var, n=n)
        self.state.update((ema, var, n))

    def close(self) -> None:
        pass


class AnchoredTtl(StatefulProcessor):
    """A key is new again ``seconds`` after the row that was last new; a timer forgets idle keys."""

    def __init__(self, seconds: int) -> None:
        self.ttl = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for r in in_order(rows):
            at = micros(r.timestamp)
            new = last is None or at - last >= self.ttl
            if new:
                last = at
            yield Row(event_id=r.event_id, key=key[0], is_new=new)
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.last.exists() and (self.last.get()[0] + self.ttl) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class Propagation(StatefulProcessor):
    """Groups of arrivals that open with the first and close ``seconds`` later.

    The open group is one value: it is read once and stored once for a key's rows of a batch, however
    many they are, with one timer for the group that is open at their end.
    """

    def __init__(self, seconds: int, min_collectors: int) -> None:
        self.span, self.least = seconds * 1000, min_collectors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at long, collectors array<string>, times array<long>")

    def _closed(self, key: Any, arrivals: dict[str, int]) -> Iterator[Row]:
        times = sorted((t, c) for c, t in arrivals.items())
        if len(times) >= self.least:
            yield Row(prefix=key[0], origin_as=key[1], path=key[2], first_ms=times[0][0], spread_ms=times[-1][0] - times[0][0], arrival_order=[c for _, c in times])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.open.get()
        opened, arrivals = (held[0], dict(zip(held[1], held[2], strict=True))) if held is not None else (None, {})
        before = opened
        for at, collector in sorted((r.arrival_ms, r.collector) for r in rows):
            if opened is None or at >= opened + self.span:
                if opened is not None:
                    yield from self._closed(key, arrivals)
                opened, arrivals = at, {}
            arrivals.setdefault(collector, at)
        if opened is not None:
            self.open.update((opened, list(arrivals), list(arrivals.values())))
            if opened != before:
                self.handle.registerTimer(opened + self.span)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.open.get()
        if held is not None and held[0] + self.span <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            yield from self._closed(key, dict(zip(held[1], held[2], strict=True)))

    def close(self) -> None:
        pass


#: No alert and no resolution.
NOTHING = (None,) * 6


class Escalation(StatefulProcessor):
    """An alert that is still unresolved ``seconds`` after it fired comes out once, bumped.

    Keyed by alert; rows are alerts (kind ``fired``) and resolutions (``resolved``), in any order. An
    event-time timer per alert fires when the watermark passes its age, so the alert may have come in
    any earlier batch. A resolution before that time cancels it; one that comes before its alert is
    kept as long. Both are one value, so a key's rows of a batch cost one read and one write.
    """

    def __init__(self, seconds: int, below: float, bump: float, top: float) -> None:
        self.age, self.below, self.bump, self.top = seconds * 1_000_000, below, bump, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, alert_type string, prefix string, origin_as long, confidence double, ended long")

    def _due(self, at: int) -> int:
        return -(-(at + self.age) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.held.get() or NOTHING
        fired, ended = held[:5], held[5]
        for r in rows:
            at = micros(r.timestamp)
            if r.kind == "resolved":
                ended = at if ended is None else min(ended, at)
            elif r.confidence is not None and r.confidence < self.below:
                fired = (at, r.alert_type, r.prefix, r.origin_as, r.confidence)
        if fired[0] is not None and ended is not None and ended < fired[0] + self.age:
            if held[0] is not None:
                self.handle.deleteTimer(self._due(held[0]))
            fired = NOTHING[:5]
        if (now := (*fired, ended)) != held:
            self.held.update(now)
        for due in {self._due(at) for at in (fired[0], ended) if at is not None}:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, held = expiredTimerInfo.getExpiryTimeInMs(), self.held.get()
        if held is None:
            return
        fired, ended = held[:5], held[5]
        if fired[0] is not None and self._due(fired[0]) <= now:
            at, kind, prefix, origin, confidence = fired
            fired = NOTHING[:5]
            yield Row(id=key[0], alert_type=kind, prefix=prefix, origin_as=origin, confidence=min(confidence + self.bump, self.top), before=confidence, fired_us=at, due_us=at + self.age)
        if ended is not None and self._due(ended) <= now:
            ended = None
        if fired[0] is None and ended is None:
            self.held.clear()
        elif (*fired, ended) != held:
            self.held.update((*fired, ended))

    def close(self) -> None:
        pass


class KnownOrigins(StatefulProcessor):
    """Origins of a prefix with the time each was last seen: emits an announcement of one that wasn't seen for ``seconds``, with those that were.

    The map may be filled from an initial state of one row per prefix, ``origins`` being its pairs of
    origin and time. One timer per prefix, at the time the oldest origin expires, keeps the state no
    larger than the origins of that span.
    """

    def __init__(self, seconds: int) -> None:
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "origin long", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def _watch(self, held: dict[int, int]) -> None:
        """A timer for the oldest origin, if none comes earlier."""
        if held:
            due = (min(held.values()) + self.span) // 1000 + 1
            if not self.timer.exists() or due < self.timer.get()[0]:
                self.handle.registerTimer(due)
                self.timer.update((due,))

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:
        origins = initialState.at[0, "origins"] if hasattr(initialState, "at") else initialState.origins
        held = {int(o["origin"]): int(o["at"]) for o in (x if isinstance(x, dict) else x.asDict() for x in origins)}
        for origin, at in held.items():
            self.seen.updateValue((origin,), (at,))
        self._watch(held)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.seen.iterator()}
        changed = set()
        for r in in_order(rows):
            at = micros(r.timestamp)
            if r.origin_as is None:
                continue
            if r.origin_as not in held or at - held[r.origin_as] > self.span:
                known = sorted({r.origin_as, *(o for o, t in held.items() if at - t <= self.span)})
                yield Row(event_id=r.event_id, prefix=key[0], origin_as=r.origin_as, detected_us=at, known=known)
            held[r.origin_as] = max(at, held.get(r.origin_as, at))
            changed.add(r.origin_as)
        for origin in changed:
            self.seen.updateValue((origin,), (held[origin],))
        self._watch(held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = {k[0]: v[0] for k, v in self.seen.iterator()}
        for origin, at in list(held.items()):
            if (at + self.span) // 1000 + 1 <= now:
                self.seen.removeKey((origin,))
                del held[origin]
        self.timer.clear()
        self._watch(held)
        return iter(())

    def close(self) -> None:
        pass


class HeldCondition(StatefulProcessor):
    """A label's windows as a state machine: pending, firing after ``minimum`` windows in a row whose value holds, resolved at their end.

    A stretch ends with a window that doesn't hold or that is missing; a timer ends it when the
    watermark shows that the next window didn't come. Another timer tells that a label has been
    silent for ``silence`` windows. Emits (state, since, until, periods) at each change.
    """

    def __init__(self, seconds: int, minimum: int, silence: int) -> None:
        self.step, self.minimum, self.silence = seconds * 1000, minimum, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stretch = handle.getValueState("stretch", "since long, until long, periods long")
        self.last = handle.getValueState("last", "at long")

    def _row(self, key: Any, state: str, since: int, until: int, periods: int) -> Row:
        return Row(**{f"label{i}": k for i, k in enumerate(key)}, state=state, since_ms=since, until_ms=until, periods=periods)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.stretch.get() if self.stretch.exists() else None
        last = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: r.bucket_ms):
            at = r.bucket_ms
            if last is not None and at >= last + (self.silence + 1) * self.step:
                yield self._row(key, "silent", last + self.step, last + (self.silence + 1) * self.step, self.silence)
            if held is not None and (at > held[1] + self.step or not r.holds):
                if held[2] >= self.minimum:
                    yield self._row(key, "resolved", *held)
                held = None
            if r.holds:
                held = (held[0], at, held[2] + 1) if held is not None else (at, at, 1)
                if held[2] == self.minimum:
                    yield self._row(key, "firing", *held)
                elif held[2] == 1 and self.minimum > 1:
                    yield self._row(key, "pending", *held)
            last = at if last is None else max(last, at)
        if held is None:
            self.stretch.clear()
        else:
            self.stretch.update(held)
            self.handle.registerTimer(held[1] + 2 * self.step)
        if last is not None:
            self.last.update((last,))
            self.handle.registerTimer(last + (self.silence + 1) * self.step)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.stretch.exists() and self.stretch.get()[1] + 2 * self.step <= now:
            held = self.stretch.get()
            self.stretch.clear()
            if held[2] >= self.minimum:
                yield self._row(key, "resolved", *held)
        if self.last.exists() and self.last.get()[0] + (self.silence + 1) * self.step <= now:
            at = self.last.get()[0]
            self.last.clear()
            yield self._row(key, "silent", at + self.step, at + (self.silence + 1) * self.step, self.silence)

    def close(self) -> None:
        pass


class TokenBucket(StatefulProcessor):
    """A bucket per key that refills at a steady rate, as its theoretical arrival time: only requests that conform move it.

    Takes and gives frames (``transformWithStateInPandas``): of a key's rows of a batch two numbers are
    held, in arrays. A timer forgets a key whose bucket is full again.
    """

    #: Requests that are walked through at a time.
    CHUNK = 50_000

    def __init__(self, step: float, slack: float) -> None:
        self.step, self.slack = step, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tat = handle.getValueState("tat", "at double")

    def _full(self, tat: float) -> int:
        return int(tat * 1000) + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.tat.get()
        before = tat = held[0] if held is not None else float("-inf")
        parts = [(f["at_us"].to_numpy(), f["event_id"].to_numpy()) for f in rows]
        at, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, at))
        for i in range(0, len(order), self.CHUNK):
            some, conforming = order[i : i + self.CHUNK], []
            for t in (at[some] / 1e6).tolist():
                due = max(tat, t)
                ok = due - t <= self.slack + 1e-9
                if ok:
                    tat = due + self.step
                conforming.append(ok)
            yield pd.DataFrame({"key": key[0], "event_id": ids[some], "conforming": conforming})
        if tat != before:
            self.tat.update((tat,))
            self.handle.registerTimer(self._full(tat))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.tat.get()
        if held is not None and self._full(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.tat.clear()
        return iter(())

    def close(self) -> None:
        pass
