"""Event-time ordered state machines on ``transformWithStateInPandas``.

Rows wait in state in chunks until the watermark has passed them, then go through a step function in order - the same
step functions as the batch jobs. A key has one timer; when it goes off, only the chunks that hold a due row are read. What must end
without a further row (the close of a day, a time-out) is a ``late`` function; ``alarms`` names the times it must be called at when
rows come in. It is called once all rows up to the watermark are done; what a later row shows to be over, the step function ends.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import asdict
from functools import reduce
from itertools import groupby, repeat
from typing import Any
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, DataType, IntegralType, MapType, StructField, StructType

from tidemark.operators.machines import Box, advance_box

Step = Callable[[tuple, pd.DataFrame, str | None], tuple[pd.DataFrame, str | None]]
#: Key, time up to which all rows are done, and state to rows due and the new state.
Late = Callable[[tuple, int, str | None], tuple[pd.DataFrame, str | None]]
#: Key and new rows to the times at which ``late`` must be called.
Alarms = Callable[[tuple, pd.DataFrame], list[int]]
#: Rows of a chunk in which rows wait, and rows merged in memory at a time.
CHUNK_ROWS, MERGE_ROWS = 1_000, 20_000


def _plain(value: Any) -> Any:
    """A nested value without numpy's types."""
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, tuple):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "__iter__") and not isinstance(value, (str, bytes)):
        return [_plain(v) for v in value]
    return value.item() if hasattr(value, "item") else value


def _values(column: pd.Series, kind: DataType) -> list:
    """A column's values as state keeps them: pandas turns whole numbers among nulls into floats."""
    values = column.tolist()
    if isinstance(kind, IntegralType) and column.dtype.kind not in "iu":
        return [None if v is None or v != v else int(v) for v in values]
    if not isinstance(kind, (ArrayType, MapType, StructType)):
        return values
    return [v.tolist() if getattr(v, "dtype", object) != object else _plain(v) for v in values]


class Ordered(StatefulProcessor):
    """Buffer rows (``columns`` with ``at_ms``), release them up to the watermark, run ``step``.

    The rows of one call wait in chunks that follow each other in time, each one binary value (a state of nested rows converts every
    field on both sides of its socket); an index of the chunks' times is one small value. A key has one
    timer, at its earliest row or alarm, and when it goes off all that is due is released, so the calls to the state store go by
    chunks and keys, not by rows or times.
    """

    #: Whether the key keeps state of its own in maps, so that it must stay known.
    lasting = False

    def __init__(self, buffer: StructType, keys: list[str], order: list[str], step: Step | None, late: Late | None = None, alarms: Alarms | None = None,
                 step_ms: int | None = None):
        self.schema, self.keys, self.order, self.step, self.late, self.alarms, self.step_ms = buffer, keys, order, step, late, alarms, step_ms
        self.at, self.kinds = buffer.names.index("at_ms"), [f.dataType for f in buffer.fields]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk bigint", "rows binary")
        self.index = handle.getValueState("index", "text string")
        self.state = handle.getValueState("state", "text string")

    def _index(self) -> dict:
        """``chunks``: number -> first time; ``alarms``: times at which ``late`` is due; ``timer``: the one set; ``seen``: rows were released."""
        held = self.index.get()
        return json.loads(held[0]) if held else {"chunks": {}, "alarms": [], "next": 0, "timer": None, "seen": False}

    def _put_index(self, index: dict) -> None:
        if not (index["chunks"] or index["alarms"] or self.lasting):
            self.index.clear()
            return
        soonest = min([*index["chunks"].values(), *index["alarms"][:1]], default=None)
        if soonest is not None and (index["timer"] is None or soonest < index["timer"]):
            self.handle.registerTimer(soonest)
            index["timer"] = soonest
        self.index.update((json.dumps(index),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        index, alarms, new = self._index(), set(), []
        for pdf in rows:
            if self.alarms:
                alarms.update(map(int, self.alarms(key, pdf)))
            new += zip(*(_values(pdf[n], t) for n, t in zip(self.schema.names, self.kinds, strict=True)), strict=True)
            if len(new) >= MERGE_ROWS:
                self._wait(index, new)
                new = []
        self._wait(index, new)
        if alarms:
            index["alarms"] = sorted(alarms.union(index["alarms"]))
        self._put_index(index)
        return iter(())

    def _wait(self, index: dict, rows: list[tuple]) -> None:
        """Chunks of at most CHUNK_ROWS rows in the order of time, each within one step of ``step_ms`` if that is given."""
        rows.sort(key=lambda r: r[self.at])
        for _, same in groupby(rows, lambda r: r[self.at] // self.step_ms if self.step_ms else 0):
            part = list(same)
            for i in range(0, len(part), CHUNK_ROWS):
                self._keep_chunk(index, str(index["next"]), part[i : i + CHUNK_ROWS])
                index["next"] += 1

    def _keep_chunk(self, index: dict, chunk: str, rows: list[tuple]) -> None:
        self.waiting.updateValue((int(chunk),), (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),))
        index["chunks"][chunk] = rows[0][self.at]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, index = timerValues.getCurrentWatermarkInMs(), self._index()
        if index["timer"] is not None and index["timer"] <= mark:
            index["timer"] = None
        due = sorted((low, chunk) for chunk, low in index["chunks"].items() if low <= mark)
        held: list[tuple] = []
        for i, (_, chunk) in enumerate(due):
            rows = pickle.loads(self.waiting.getValue((int(chunk),))[0])
            now = [r for r in rows if r[self.at] <= mark]
            if len(now) < len(rows):
                self._keep_chunk(index, chunk, [r for r in rows if r[self.at] > mark])
            else:
                self.waiting.removeKey((int(chunk),))
                del index["chunks"][chunk]
            held += now
            until = due[i + 1][0] - 1 if i + 1 < len(due) else mark  # no later chunk holds a row up to here
            if len(held) >= MERGE_ROWS or until == mark:
                ready = [r for r in held if r[self.at] <= until]
                held = [r for r in held if r[self.at] > until]
                if ready:
                    self.fresh, index["seen"] = not index["seen"], True
                    yield from self.release(key, pd.DataFrame(ready, columns=self.schema.names).sort_values(self.order, kind="stable"))
        if self.late and index["alarms"] and index["alarms"][0] <= mark:
            index["alarms"] = [a for a in index["alarms"] if a > mark]
            out, state = self.late(key, mark, self._state())  # all rows up to the watermark are done
            self._keep(state)
            yield from self._keyed(key, out)
        self._put_index(index)

    def release(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows that no earlier one can precede any more, in order."""
        out, state = self.step(key, rows, self._state())
        self._keep(state)
        yield from self._keyed(key, out)

    def _state(self) -> str | None:
        held = self.state.get()
        return held[0] if held else None

    def _keep(self, state: str | None) -> None:
        if state is not None:
            self.state.update((state,))
        else:
            self.state.clear()

    def _keyed(self, key: tuple, out: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(out):
            out = out.reset_index(drop=True)
            for name, value in reversed(list(zip(self.keys, key))):
                out.insert(0, name, value)
            yield out

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, keys: list[str], order: list[str], step: Step | None, output: str, delay: str | None,
            late: Late | None = None, alarms: Alarms | None = None, step_ms: int | None = None, processor: type[Ordered] = Ordered) -> DataFrame:
    """Attach ``step`` to a stream with ``ts`` and ``at_ms``. Without ``delay`` the stream has its watermark already."""
    fields = [f for f in stream.schema.fields if f.name not in (*keys, "ts")]
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    full = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + output
    marked = stream.withWatermark("ts", delay) if delay else stream
    return marked.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor(StructType(fields), keys, order, step, late, alarms, step_ms), outputStructType=full,
        outputMode="append", timeMode="eventTime")


def timeline(stream: DataFrame, keys: list[str], delay: str | None = "10 seconds", step_ms: int | None = None) -> DataFrame:
    """Order, deal and snapshot events (kind, seq, prio) numbered in time order."""

    def step(key, rows, before):
        first = int(before or 0)
        out = rows[["at_ms", "seq", "prio", "kind"]].copy()
        out["event_no"] = range(first + 1, first + 1 + len(out))
        return out, str(first + len(out))

    return ordered(stream, keys, ["at_ms", "prio", "seq"], step,
                   "at_ms bigint, seq bigint, prio bigint, kind string, event_no bigint", delay, step_ms=step_ms)


#: Order in which feeds go at one time.
FEEDS = ("order", "deal", "snapshot")


def feeds_timeline(feeds: dict[str, tuple[DataFrame, str]], keys: list[str], step_ms: int | None = None) -> DataFrame:
    """One timeline of several feeds. ``feeds``: kind -> (stream of keys, ts, at_ms, seq; its own delay); at one time they go in the
    order given.

    Each feed has its own watermark and the least of them rules (see ``run_available``): a row is late only if its feed's own delay
    and every other feed have passed it, and a feed that stands still holds back the others.
    """
    columns = [*keys, "ts", "at_ms", "seq"]
    marked = [
        s.select(*columns).withColumns({"prio": F.lit(i).cast("bigint"), "kind": F.lit(kind)}).withWatermark("ts", delay)
        for i, (kind, (s, delay)) in enumerate(feeds.items())]
    return timeline(reduce(DataFrame.unionByName, marked), keys, None, step_ms)


def next_trade(stream: DataFrame, keys: list[str], delay: str = "10 minutes", close_of: Callable[[tuple], int] | None = None,
               default: int = 153_000_000) -> DataFrame:
    """Each row with the time of the next non-cancel row; rows wait in state until it arrives.

    With ``close_of`` (key to the end of its day, in milliseconds) rows that still wait at the close get ``default``,
    and the key's state ends; the day must then be part of the key.
    """

    def late(key, mark, before):
        if before is None or mark < close_of(key):
            return pd.DataFrame(), before
        waiting = json.loads(before)
        return pd.DataFrame({"seq": waiting, "next_time": [default] * len(waiting)}), None

    def step(key, rows, before):
        pending, done = json.loads(before) if before else [], []
        for seq, clock, side in zip(rows["seq"], rows["clock"], rows["side"]):
            if side not in (-1, -11):
                done += [(s, int(clock)) for s in pending]
                pending = []
            pending.append(int(seq))
        return pd.DataFrame(done, columns=["seq", "next_time"]), json.dumps(pending)

    return ordered(stream, keys, ["clock", "seq"], step, "seq bigint, next_time bigint", delay, close_of and late,
                   close_of and (lambda key, rows: [close_of(key)]))


def live_boxes(stream: DataFrame, keys: list[str], mid_rows: int, band: float, init: int, period: int,
               delay: str = "1 day") -> DataFrame:
    """Consolidation boxes of a bar stream; the moving average keeps its last closes in state."""

    def step(key, rows, before):
        state = json.loads(before) if before else {"closes": [], "box": asdict(Box())}
        closes, box, found = state["closes"], Box(**state["box"]), []
        for t, high, low, close in zip(rows["bt"], rows["high"], rows["low"], rows["close"]):
            closes = (closes + [float(close)])[-mid_rows:]
            if len(closes) < mid_rows:
                continue
            box, done = advance_box(box, int(t), float(high), float(low), float(close), sum(closes) / mid_rows, band, init, period)
            if done:
                found.append((done.start, done.end, int(t), done.high, done.low, done.days))
        cols = ["start_t", "end_t", "break_t", "box_high", "box_low", "days"]
        return pd.DataFrame(found, columns=cols), json.dumps({"closes": closes, "box": asdict(box)})

    return ordered(stream, keys, ["bt"], step,
                   "start_t bigint, end_t bigint, break_t bigint, box_high double, box_low double, days bigint", delay)


class _Cached:
    """Entries (tuples of whole numbers and short texts to tuples) in a map state, in pages of about PAGE entries that are read and written
    whole, through dictionaries for the length of one call; what changed is written at the end.

    A small book is one page, so the calls to the state store do not go by its orders. Once pages hold twice PAGE each they are split by
    more bits of the entries' hashes, one page at a time. The number of pages, if there are several, and of all entries stands as page -1.
    """

    #: Entries of a page, and pages held in memory.
    PAGE, HELD = 512, 512

    def __init__(self, state, fresh: bool = False):
        """``fresh``: the state is known to be empty, so nothing is asked of it."""
        self.state, self.fresh, self.known, self.dirty = state, fresh, {}, set()
        self.pages, self.count = (1, 0) if fresh else self._read(-1) or (1, 0)

    def _read(self, page: int):
        return pickle.loads(self.state.getValue((page,))[0]) if not self.fresh and self.state.containsKey((page,)) else None

    def _write(self, page: int, value) -> None:
        if value:
            self.state.updateValue((page,), (pickle.dumps(value, pickle.HIGHEST_PROTOCOL),))
        elif not self.fresh and self.state.containsKey((page,)):
            self.state.removeKey((page,))

    @staticmethod
    def _hash(key: tuple) -> int:
        """The same in every process."""
        out = len(key)
        for part in key:
            out = ((out ^ (crc32(part.encode()) if isinstance(part, str) else part)) * 0x9E3779B97F4A7C15 + 1) % 2**64
        return out >> 24

    def _page(self, key: tuple) -> tuple[int, dict]:
        at = self._hash(key) % self.pages if self.pages > 1 else 0
        if at not in self.known:
            if len(self.known) >= self.HELD:
                self.flush()
                at = self._hash(key) % self.pages
            self.known[at] = self._read(at) or {}
        return at, self.known[at]

    def get(self, key: tuple):
        return self._page(key)[1].get(key)

    def put(self, key: tuple, value: tuple | None) -> None:
        at, page = self._page(key)
        had = len(page)
        if value is None:
            page.pop(key, None)
        else:
            page[key] = value
        self.count += len(page) - had
        self.dirty.add(at)

    def flush(self) -> None:
        several = self.pages > 1
        for at in self.dirty:
            self._write(at, self.known[at])
        entries = self.count if several else len(self.known.get(0, ()))
        changed, self.known, self.dirty, self.fresh = bool(self.dirty), {}, set(), False
        if entries > 2 * self.PAGE * self.pages:
            self._split(entries)
        if changed and (several or self.pages > 1):
            self._write(-1, (self.pages, self.count) if self.count else None)
            if not self.count:
                self.pages = 1

    def _split(self, entries: int) -> None:
        pages = self.pages
        while entries > self.PAGE * pages:
            pages *= 2
        for at in range(self.pages):
            parts: dict[int, dict] = {at: {}}
            for key, value in (self._read(at) or {}).items():
                parts.setdefault(self._hash(key) % pages, {})[key] = value
            for part, held in parts.items():
                self._write(part, held)
        self.pages, self.count = pages, entries


class Ladder:
    """The prices of one side as a tree of 16-bit masks in a map state (side, depth, prefix): a price comes, goes or is followed
    to the next worse one in as many steps as it has hexadecimal digits, however many prices there are."""

    DEPTH = 10
    LAST = 16**DEPTH - 1

    def __init__(self, masks: _Cached, side: str):
        self.masks, self.side = masks, side

    def _score(self, price: int) -> int:
        return price if self.side == "B" else self.LAST - price

    def add(self, price: int) -> None:
        score = self._score(price)
        for depth in range(self.DEPTH):
            at = (self.side, depth, score >> 4 * (depth + 1))
            mask = (self.masks.get(at) or (0,))[0]
            self.masks.put(at, (mask | 1 << (score >> 4 * depth & 15),))
            if mask:
                return

    def remove(self, price: int) -> None:
        score = self._score(price)
        for depth in range(self.DEPTH):
            at = (self.side, depth, score >> 4 * (depth + 1))
            mask = self.masks.get(at)[0] & ~(1 << (score >> 4 * depth & 15))
            self.masks.put(at, (mask,) if mask else None)
            if mask:
                return

    def _greatest(self, depth: int, prefix: int) -> int:
        """The greatest score below the node."""
        while True:
            prefix = prefix << 4 | self.masks.get((self.side, depth, prefix))[0].bit_length() - 1
            if depth == 0:
                return prefix
            depth -= 1

    def best(self, n: int) -> list[int]:
        """The best n prices."""
        out: list[int] = []
        if self.masks.get((self.side, self.DEPTH - 1, 0)) is None:
            return out
        score = self._greatest(self.DEPTH - 1, 0)
        while len(out) < n:
            out.append(self._score(score))  # the score of a score is the price again
            for depth in range(self.DEPTH):
                lower = self.masks.get((self.side, depth, score >> 4 * (depth + 1)))[0] & ((1 << (score >> 4 * depth & 15)) - 1)
                if lower:
                    node = score >> 4 * (depth + 1) << 4 | lower.bit_length() - 1
                    score = self._greatest(depth - 1, node) if depth else node
                    break
            else:
                break
        return out


class Book(Ordered):
    """Orders by id, levels by price and ladders of prices, in the pages of one map state: an event touches its order, its level and a path
    of the ladder, whatever the size of the book."""

    N, lasting = 10, True

    def init(self, handle) -> None:
        super().init(handle)
        self.book = handle.getMapState("book", "page bigint", "entries binary")

    def release(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # keys of one, two and three parts: an order, a level, a node of a ladder
        self.held = _Cached(self.book, self.fresh)
        self.ladder = {s: Ladder(self.held, s) for s in "BS"}
        self.top: dict[str, list[int]] = {}  # best prices, until a level comes or goes
        column = lambda name: rows[name].tolist() if name in rows else repeat(None)
        bids, asks, oks = [], [], []
        for kind, order_id, side, price, qty, their_bids, their_asks in zip(*map(column, ("kind", "order_id", "side", "price", "qty", "bids", "asks"))):
            if kind == "check":
                oks.append(self._agrees("B", their_bids) and self._agrees("S", their_asks))
            else:
                oks.append(None)
                self._apply(kind, order_id, side, price, qty)
            bids.append(float(self._best("B")))
            asks.append(float(self._best("S")))
        self.held.flush()
        out = rows[["seq", "kind", "order_id"]].reset_index(drop=True).assign(best_bid=bids, best_ask=asks)
        out["ok"] = pd.Series(oks, dtype=object)
        yield from self._keyed(key, out)

    def _apply(self, kind: str, order_id: int, side: str, price: float | None, qty: int) -> None:
        own = self.held.get((order_id,))
        if kind == "insert":
            if own is None and qty > 0:
                price = int(price) if price == price and price is not None else self._best(side)
                self.held.put((order_id,), (side, price, int(qty)))
                self._change(side, price, 1, int(qty))
        elif own is not None and own[2]:
            side, price, left = own
            cut = min(int(qty), left)
            # a finished order stays as one without shares, so that a repeated insert changes nothing
            self.held.put((order_id,), (side, price, left - cut))
            self._change(side, price, -(cut == left), -cut)

    def _tops(self, side: str, n: int) -> list[int]:
        """The best n prices of a side or, as they are kept, more."""
        if len(self.top.get(side, ())) < n:
            self.top[side] = self.ladder[side].best(n)
        return self.top[side]

    def _best(self, side: str) -> int:
        return (self._tops(side, 1) or [0])[0]

    def _change(self, side: str, price: int, orders: int, volume: int) -> None:
        had = self.held.get((side, price)) or (0, 0)
        now = (had[0] + orders, had[1] + volume)
        self.held.put((side, price), now if now[0] else None)
        if not had[0]:
            self.ladder[side].add(price)
            self.top.pop(side, None)
        elif not now[0]:
            self.ladder[side].remove(price)
            self.top.pop(side, None)

    def _agrees(self, side: str, text: str | None) -> bool:
        """Prices and counts of the best levels equal, volumes within 20 shares."""
        theirs = json.loads(text)[: self.N] if text else []
        mine = self._tops(side, self.N)[: self.N]
        if len(mine) != len(theirs):
            return False
        for price, level in zip(mine, theirs):
            orders, volume = self.held.get((side, price))
            if price != level.get("price") or orders != level.get("orders") or level.get("volume") is None or abs(volume - level["volume"]) > 20:
                return False
        return True


def live_book(stream: DataFrame, keys: list[str], delay: str = "2 seconds", step_ms: int | None = None) -> DataFrame:
    """Order book per stock-day: best prices after every event, and snapshot checks on ``check`` events.

    A check event carries the expected levels in ``bids`` and ``asks`` (arrays of price, volume, orders); it reports whether the
    best ten of the book agree. Prices are whole numbers of at most ten hexadecimal digits.
    """
    for name in {"bids", "asks"}.intersection(stream.columns):  # a text crosses to Python and back at less cost than nested rows
        kind = stream.schema[name].dataType.elementType
        named = StructType([StructField(n, f.dataType) for n, f in zip(("price", "volume", "orders"), kind)])
        stream = stream.withColumn(name, F.to_json(F.col(name).cast(ArrayType(named))))
    return ordered(stream, keys, ["at_ms", "seq", "order_id"], None,
                   "seq bigint, kind string, order_id bigint, best_bid double, best_ask double, ok boolean", delay, step_ms=step_ms, processor=Book)


def timed_checks(stream: DataFrame, keys: list[str], wait_ms: int = 2000, delay: str = "2 seconds") -> DataFrame:
    """Snapshots against traded volume in time.

    A ``check`` row passes when the volume traded so far equals its ``volume`` at its own time or at a trade not more
    than ``wait_ms`` later; when the watermark passes that limit it fails, whether or not another row comes. Checks of
    one key may be many and of equal volume; rows of one time are taken by ``prio``, so trades with a lower one count.
    """

    def result(done: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(done, columns=["seq", "ok", "matched_ms"]).astype({"seq": "int64", "ok": bool, "matched_ms": "Int64"})

    def step(key, rows, before):
        total, open_checks = json.loads(before) if before else (0, [])
        done = []
        for kind, at, seq, volume in zip(rows["kind"], rows["at_ms"], rows["seq"], rows["volume"]):
            kept = []
            if kind == "check":
                open_checks.append((int(seq), int(at), int(volume)))
            else:
                done += [(s, False, None) for s, t, _ in open_checks if t + wait_ms < at]
                open_checks = [c for c in open_checks if c[1] + wait_ms >= at]
                total += int(volume)
            for check in open_checks:
                if check[2] == total:
                    done.append((check[0], True, int(at)))
                else:
                    kept.append(check)
            open_checks = kept
        return result(done), json.dumps((total, open_checks))

    def late(key, mark, before):
        total, open_checks = json.loads(before) if before else (0, [])
        over = [(s, False, None) for s, t, _ in open_checks if t + wait_ms < mark]
        open_checks = [c for c in open_checks if c[1] + wait_ms >= mark]
        return result(over), json.dumps((total, open_checks))

    def alarms(key, rows):
        return (rows.loc[rows["kind"] == "check", "at_ms"] + wait_ms + 1).tolist()

    return ordered(stream, keys, ["at_ms", "prio", "seq"], step, "seq bigint, ok boolean, matched_ms bigint", delay, late, alarms)
