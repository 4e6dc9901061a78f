"""Structured Streaming forms of the edit and request jobs. Each gives the rows of its batch form.

Event times of the given tables have no zone; cast them to TIMESTAMP with the session in UTC first.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.intake import classify_landed
from quire.operators.records import fold_records
from quire.operators.replay import STATE, Document, as_json
from quire.sources.tables import Store, scan_documents


def debounce_saves(changes: DataFrame, gap: str, delay: str, key: str = "doc", order: str = "event_id") -> DataFrame:
    """One row for each burst of changes, its last one, once the watermark has passed the quiet gap."""
    last = F.max(F.struct("ts", order))
    return changes.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap)).agg(last.alias("last")).select(key, "last.*")


def inflight_coalesce(requests: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first of equal requests within the watermark's delay."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def monotonic_dedupe(requests: DataFrame) -> DataFrame:
    """Requests whose id is above all ids seen before in the session; the state is that one number."""

    def run(key: tuple, batches, state: GroupState):
        rows = pd.concat(batches).sort_values(["ts", "event_id"])  # one session's requests of one trigger
        before = rows["request_id"].cummax().shift(1)
        if state.exists:
            before = before.fillna(state.get[0]).clip(lower=state.get[0])
        fresh = rows[before.isna() | (rows["request_id"] > before)]
        highest = int(rows["request_id"].max())
        state.update((max(highest, state.get[0]) if state.exists else highest,))
        yield fresh[["session", "request_id", "event_id"]]

    rows = requests.select("session", "request_id", "event_id", "ts").groupBy("session")
    return rows.applyInPandasWithState(run, "session bigint, request_id bigint, event_id bigint", "highest bigint", "append", GroupStateTimeout.NoTimeout)


def latest_render(requests: DataFrame) -> DataFrame:
    """R2: (session, page, event_id): the newest request of each page so far, whenever it changes."""

    def run(key: tuple, batches, state: GroupState):
        newest = state.get[0] if state.exists else -1
        now = max([newest, *(int(b["event_id"].max()) for b in batches if len(b))])
        if now > newest:
            state.update((now,))
            yield pd.DataFrame({"session": [key[0]], "page": [key[1]], "event_id": [now]})

    rows = requests.select("session", "page", "event_id").groupBy("session", "page")
    return rows.applyInPandasWithState(run, "session bigint, page bigint, event_id bigint", "newest bigint", "update", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Hands the events of a key over in order of (at, event_id), once the watermark has passed them, so it does not
    matter in which order they came within its delay. A timer wakes it for the next event or deadline."""

    #: Columns of an event; the first two are at (microseconds) and event_id.
    event_schema = "at bigint, event_id bigint"

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.event_schema)

    def handleInputRows(self, key, rows, timerValues):
        fields = dict(c.split() for c in self.event_schema.split(", "))
        plain = {"bigint": int, "boolean": bool, "string": str}
        for part in rows:  # a column with nulls comes as floats, which a state would not take for whole numbers
            columns = [[None if v is None or v != v else plain[t](v) for v in part[c]] for c, t in fields.items()]
            self.pending.appendList(list(zip(*columns)))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, timerValues)

    def _advance(self, key, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.pending.get(), key=lambda e: e[:2]) if self.pending.exists() else []
        due, rest = [e for e in events if e[0] <= watermark], [e for e in events if e[0] > watermark]
        out = [row for e in due for row in self.event(key, *e)] + list(self.silence(key, watermark))
        self.pending.clear()
        if rest:
            self.pending.appendList(rest)
        wake = min([e[0] for e in rest[:1]] + [d for d in [self.deadline()] if d is not None], default=None)
        if wake is not None:
            self.handle.registerTimer(max(wake, watermark) // 1000 + 1)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class _Stalled(_InOrder):
    """The clock of each started request: its last event and when that was."""

    event_schema = "at bigint, event_id bigint, request bigint, phase string"

    def __init__(self, seconds: float):
        self.limit = round(seconds * 1_000_000)

    def init(self, handle) -> None:
        super().init(handle)
        self.clocks = handle.getMapState("clocks", "request bigint", "event_id bigint, at bigint")

    def _timed_out(self, key, request: int, event_id: int) -> dict:
        self.clocks.removeKey((request,))
        return {"session": key[0], "request": request, "event_id": event_id}

    def event(self, key, at, event_id, request, phase):
        if self.clocks.containsKey((request,)):
            last, before = self.clocks.getValue((request,))
            if at - before > self.limit:
                yield self._timed_out(key, request, last)
        started = phase == "started" or self.clocks.containsKey((request,))
        if phase == "done":
            self.clocks.removeKey((request,))
        elif started:
            self.clocks.updateValue((request,), (event_id, at))

    def silence(self, key, watermark):
        for (request,), (event_id, at) in list(self.clocks.iterator()):
            if watermark - at > self.limit:
                yield self._timed_out(key, request, event_id)

    def deadline(self):
        return min((at + self.limit + 1 for _, at in self.clocks.values()), default=None)


class _Gated(_InOrder):
    """Whether a document is being composed, and the last change that no save has covered."""

    event_schema = "at bigint, event_id bigint, composing boolean"

    def __init__(self, seconds: float):
        self.gap = round(seconds * 1_000_000)

    def init(self, handle) -> None:
        super().init(handle)
        self.composing = handle.getValueState("composing", "composing boolean")
        self.unsaved = handle.getValueState("unsaved", "event_id bigint, at bigint")

    def silence(self, key, watermark):
        if self.unsaved.exists() and watermark - self.unsaved.get()[1] > self.gap:
            yield self._saved(key)

    def _saved(self, key) -> dict:
        event_id, at = self.unsaved.get()
        self.unsaved.clear()
        return {"doc": key[0], "event_id": event_id, "at": at}

    def event(self, key, at, event_id, composing):
        yield from self.silence(key, at)
        if composing is not None:
            self.composing.update((composing,))
        if not (self.composing.exists() and self.composing.get()[0]):
            self.unsaved.update((event_id, at))

    def deadline(self):
        return self.unsaved.get()[1] + self.gap + 1 if self.unsaved.exists() else None


def stalled_requests(events: DataFrame, seconds: float, delay: str) -> DataFrame:
    """(session, request, event_id): the last event of a started request after which `seconds` of event time passed
    without another; the rules are those of the batch form. The state of a session is a clock for each request that
    runs and the events that the watermark has not passed. Rows come once the watermark has passed the deadline."""
    rows = events.withWatermark("ts", delay).select("session", "request", "event_id", "ts", "phase", F.unix_micros("ts").alias("at"))
    return rows.groupBy("session").transformWithStateInPandas(_Stalled(seconds), "session bigint, request bigint, event_id bigint", "Append", "EventTime")


def gated_saves(changes: DataFrame, seconds: float, delay: str) -> DataFrame:
    """(doc, event_id, ts): one save for each burst of changes outside compositions, its last change, once the
    watermark is `seconds` past it. changes: (doc, event_id, ts, composing), composing null where unknown."""
    rows = changes.withWatermark("ts", delay).select("doc", "event_id", "ts", "composing", F.unix_micros("ts").alias("at"))
    saves = rows.groupBy("doc").transformWithStateInPandas(_Gated(seconds), "doc bigint, event_id bigint, at bigint", "Append", "EventTime")
    return saves.select("doc", "event_id", F.timestamp_micros("at").alias("ts"))


class _Newest(StatefulProcessor):
    """The newest generation that a session has seen."""

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", "revision bigint")

    def handleInputRows(self, key, rows, timerValues):
        newest = self.newest.get()[0] if self.newest.exists() else None
        out = []
        for part in rows:
            for at, event_id, revision in sorted(part[["at", "event_id", "revision"]].itertuples(index=False, name=None)):
                newest = int(revision) if newest is None else max(newest, int(revision))
                if revision == newest:
                    out.append({"session": key[0], "event_id": int(event_id), "revision": int(revision)})
        if newest is not None:
            self.newest.update((newest,))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stale_responses(responses: DataFrame) -> DataFrame:
    """(session, event_id, revision): the responses whose generation is the newest that their session has seen when
    they arrive; of one trigger, in order of time. Responses without a generation are left out."""
    rows = responses.where("revision is not null").select("session", "event_id", "revision", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("session").transformWithStateInPandas(_Newest(), "session bigint, event_id bigint, revision bigint", "Append", "None")


class _Replay(StatefulProcessor):
    """One value for each document: the last seq, the number of late actions, and the state as JSON."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("document", "last bigint, late bigint, document string")

    def handleInputRows(self, key, rows, timerValues):
        last, late, document = (*self.held.get()[:2], Document.load(self.held.get()[2])) if self.held.exists() else (None, 0, Document())
        for seq, action in sorted((int(s), a) for part in rows for s, a in zip(part["seq"], part["action"])):
            if last is not None and seq < last:
                late += 1
            else:
                document.apply(json.loads(action))
                last = seq
        self.held.update((last, late, document.dump()))
        yield pd.DataFrame([{"doc": key[0], **document.row(), "n_late": late}])

    def close(self) -> None:
        pass


def replay_actions(actions: DataFrame) -> DataFrame:
    """The columns of the batch form and n_late, for each document whenever actions of it arrive, in update
    mode. The actions of a trigger are sorted by seq; one whose seq is below the last one applied came too late to
    have an effect and is counted in n_late. The state is that of the document alone, not its log; it needs the
    RocksDB state store."""
    rows = as_json(actions).where("doc is not null")
    key = rows.schema["doc"].dataType.simpleString()
    return rows.groupBy("doc").transformWithStateInPandas(_Replay(), f"doc {key}, {STATE}, n_late bigint", "Update", "None")


def upsert_stream(updates: DataFrame, store: Store, name: str, checkpoint: str, order: str = "ord"):
    """M1: a query that folds record updates into a store, several of one key in order of arrival; `updates` has the
    store's columns and `order`. A refused update leaves the stored row. The store notes the batch id under `name` in
    the version that holds it, so a batch that runs again changes nothing."""
    key = (*store.parts, store.key)

    def each(batch: DataFrame, batch_id: int) -> None:
        store.change(batch, lambda stored, rows: (fold_records(stored, rows, key, order), None), (name, batch_id))

    return updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intake_stream(spark, folder: str, sinks: str, checkpoint: str, parts: DataFrame, manifest: DataFrame, mimetypes: DataFrame, streams: DataFrame):
    """A query that classifies files as they land (see classify_landed; a file's package is its name) and writes
    them to the folders supported, legacy and rejected under `sinks`.

    The rows of a trigger go to the folder of its batch id, which a trigger that runs again replaces, so each file is
    there once. The four tables are read anew by each trigger; a file whose parts are not there yet is rejected as
    `unread`.
    """
    files = scan_documents(spark, folder, stream=True)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("package"), name.alias("file_name"), "path", "size", F.substring("content", 1, 8).alias("content"))

    def each(batch: DataFrame, batch_id: int) -> None:
        route(batch, batch_id, sinks, parts, manifest, mimetypes, streams)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Where classified files go.
SINKS = ("supported", "legacy", "rejected")


def route(batch: DataFrame, batch_id: int, sinks: str, *tables: DataFrame) -> None:
    """Writes one batch of landed files to the folder of its id in each of SINKS."""
    found = classify_landed(batch, *tables).persist()
    for kind in SINKS:
        found.where(F.col("kind") == kind).drop("package", "kind").write.mode("overwrite").parquet(f"{sinks}/{kind}/batch={batch_id}")
    found.unpersist()
