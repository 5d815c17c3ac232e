"""The session machine: fixes, searches and user events to states and effects.

Events are rows ``session, seq, kind, payload`` (payload: JSON); every event gives one row
of the state after it and its effects in order. The batch and the streaming form run the
same step; a session's state is its phase, position, stale or current places, bathing
layer, position source, picker and selection.

Places in payloads are objects with at least id, lat, lon. Unknown kinds and payloads that
can't be read leave the state as it is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.sequences import REQUERY_M

OUT = "session string, seq long, phase string, lat double, lon double, source string, picker boolean, bathing string, selected string, n_spots int, n_bathing int, effects string"

START = {"phase": "welcome", "at": None, "spots": [], "radius": None, "reason": None, "source": None, "picker": False, "bathing": "off", "bathing_spots": [], "bathing_radius": None, "selected": None}

State = dict
Effects = list[dict]


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def visible(s: State) -> list[dict]:
    """Parks, then bathing places; an id once."""
    out: dict = {}
    for spot in [*s["spots"], *s["bathing_spots"]]:
        out.setdefault(spot.get("id"), spot)
    return list(out.values())


def _ask(s: State, at: tuple[float, float]) -> tuple[State, Effects]:
    """Search anew from a position; what is shown stays until the answer."""
    new, effects = s | {"phase": "searching", "at": at}, [{"kind": "search", "at": at}]
    return _again(new, effects)


def _again(s: State, effects: Effects) -> tuple[State, Effects]:
    """The bathing layer follows every new search unless it is off."""
    if s["bathing"] == "off":
        return s, effects
    return s | {"bathing": "loading"}, [*effects, {"kind": "search-bathing", "at": s["at"]}]


def _fixed(s: State, e: dict) -> tuple[State, Effects]:
    if s["source"] == "picked":
        return s, []
    at, followed = (float(e["lat"]), float(e["lon"])), s | {"source": "gps"}
    if s["at"] is None and s["phase"] != "failed":
        return followed | {"phase": "searching", "at": at, "spots": []}, [{"kind": "search", "at": at}]
    if s["at"] is not None and metres(s["at"], at) < REQUERY_M:
        return followed | {"at": at}, []
    resumed = [{"kind": "frame-map", "at": at}] if s["source"] is None and s["at"] is not None else []
    new, effects = _ask(followed, at)
    return new, resumed + effects


def _lost(s: State, e: dict) -> tuple[State, Effects]:
    if s["at"] is None:
        return s | {"phase": "needs-position", "reason": e.get("reason")}, [{"kind": "stop-watching"}]
    return (s | {"source": "picked"}, [{"kind": "stop-watching"}]) if s["source"] is None else (s, [])


def _picked(s: State, e: dict) -> tuple[State, Effects]:
    at = float(e["lat"]), float(e["lon"])
    new, effects = _ask(s | {"source": "picked", "picker": False}, at)
    return new, [{"kind": "close-picker"}, {"kind": "stop-watching"}, {"kind": "frame-map", "at": at}, *effects]


def _found(s: State, e: dict) -> tuple[State, Effects]:
    if s["phase"] != "searching":
        return s, []
    spots = list(e["spots"])
    new = s | {"phase": "ready" if spots else "empty", "spots": spots, "radius": e.get("radius")}
    return new, [{"kind": "frame-results", "ids": [x.get("id") for x in spots], "at": s["at"]}]


def _chosen(s: State, e: dict) -> tuple[State, Effects]:
    hit = next((x for x in visible(s) if x.get("id") == e.get("id")), None) if e.get("id") is not None else None
    return s | {"selected": e.get("id")}, [{"kind": "frame-spot", "id": hit["id"], "at": s["at"]}] if hit else []


def _directions(s: State, e: dict) -> tuple[State, Effects]:
    if not any(x.get("id") == e.get("id") for x in visible(s)):
        return s, []
    return s, [{"kind": "open-directions", "id": e["id"], "origin": s["at"] if s["source"] == "picked" else None}]


def _toggled(s: State, e: dict) -> tuple[State, Effects]:
    if s["bathing"] != "off":
        return s | {"bathing": "off", "bathing_spots": [], "bathing_radius": None}, []
    return _bathe(s, []) if s["at"] is not None else (s, [])


def _bathe(s: State, stale: list) -> tuple[State, Effects]:
    if s["at"] is None:
        return s, []
    return s | {"bathing": "loading", "bathing_spots": stale}, [{"kind": "search-bathing", "at": s["at"]}]


def _when(key: str, value: str, then: Callable[[State, dict], tuple[State, Effects]]) -> Callable[[State, dict], tuple[State, Effects]]:
    return lambda s, e: then(s, e) if s[key] == value else (s, [])


def _set(effect: str | None, **fields) -> Callable[[State, dict], tuple[State, Effects]]:
    return lambda s, e: (s | fields, [{"kind": effect}] if effect else [])


RULES: dict[str, Callable[[State, dict], tuple[State, Effects]]] = {
    "location-requested": _when("phase", "welcome", _set("watch-location", phase="locating")),
    "location-retry-requested": _when("phase", "needs-position", _set("watch-location", phase="locating")),
    "position-fixed": _fixed,
    "location-failed": _lost,
    "pick-requested": _set("open-picker", picker=True),
    "pick-cancelled": _set("close-picker", picker=False),
    "position-picked": _picked,
    "follow-requested": _when("source", "picked", _set("watch-location", source=None)),
    "search-succeeded": _found,
    "search-failed": _when("phase", "searching", _set(None, phase="failed")),
    "retry-requested": lambda s, e: _ask(s, s["at"]) if s["at"] is not None else (s, []),
    "spot-selected": _chosen,
    "directions-requested": _directions,
    "bathing-toggled": _toggled,
    "bathing-retry-requested": _when("bathing", "failed", lambda s, e: _bathe(s, s["bathing_spots"])),
    "bathing-search-succeeded": _when("bathing", "loading", lambda s, e: (s | {"bathing": "ready", "bathing_spots": list(e["spots"]), "bathing_radius": e.get("radius")}, [])),
    "bathing-search-failed": _when("bathing", "loading", _set(None, bathing="failed")),
}


def step(s: State, kind: str, payload: dict) -> tuple[State, Effects]:
    """The state after one event, and its effects. A selection that isn't visible is dropped."""
    rule = RULES.get(kind)
    new, effects = rule(s, payload) if rule else (s, [])
    if new["selected"] is not None and not any(x.get("id") == new["selected"] for x in visible(new)):
        new = new | {"selected": None}
    return new, effects


def _row(session: str, seq: int, s: State, effects: Effects) -> tuple:
    lat, lon = s["at"] or (None, None)
    return session, seq, s["phase"], lat, lon, s["source"], s["picker"], s["bathing"], s["selected"], len(s["spots"]), len(s["bathing_spots"]), json.dumps(effects, separators=(",", ":"))


_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _run(session: str, s: State, events: pd.DataFrame) -> tuple[State, pd.DataFrame]:
    rows = []
    for seq, kind, payload in zip(events["seq"], events["kind"], events["payload"]):
        try:
            body = json.loads(payload) if isinstance(payload, str) and payload else {}
            s, effects = step(s, kind, body if isinstance(body, dict) else {})
        except (ValueError, KeyError, TypeError):
            effects = []
        rows.append(_row(session, int(seq), s, effects))
    return s, pd.DataFrame(rows, columns=_NAMES)


def run_batch(events: DataFrame) -> DataFrame:
    """One row an event, over whole sessions in order of seq.

    A session's steps depend on each other, so a session is one task's work; but it is read
    as a sorted run in batches, with only its state held, however long it is."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s = None, dict(START)
        for pdf in batches:
            out = []
            for name, part in pdf.groupby("session", sort=False, dropna=False):
                if name != now:
                    now, s = name, dict(START)
                s, rows = _run(name, s, part)
                out.append(rows)
            if out:
                yield pd.concat(out)

    rows = events.select("session", "seq", "kind", "payload").repartition("session").sortWithinPartitions("session", "seq")
    return rows.mapInPandas(whole, OUT)


def run_stream(events: DataFrame, late: str | None = None) -> DataFrame:
    """The same over a stream, with a session's state kept between batches.

    Without ``late``, events are ordered by seq within a batch, and the source must deliver a
    session's batches in order. With it ("10 minutes"), events may come in any order: they have
    a column ``at`` (a timestamp), and an event waits in its session until the watermark, the
    newest time seen less ``late``, has passed it and every waiting event of smaller seq. So
    rows equal those of ``run_batch`` as long as an event comes at most ``late`` after any of
    greater seq. A later one that the watermark has passed is dropped by Spark, which counts it
    in ``numRowsDroppedByWatermark``; as a watermark starts at 1970, so is one of before that. An event without a time waits only for those before
    it; what is newer than the watermark waits for more events. A session's waiting events
    are part of its state, so a restart from the checkpoint loses none."""

    def some(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else dict(START)
        s["at"] = tuple(s["at"]) if s["at"] else None
        pdf = pd.concat(list(pdfs)).sort_values("seq", kind="stable")
        s, out = _run(key[0], s, pdf)
        state.update((json.dumps(s),))
        yield out

    def in_order(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, waiting = state.get if state.exists else (None, "[]")
        s, waiting, passed = json.loads(held) if held else dict(START), json.loads(waiting), state.getCurrentWatermarkMs()
        s["at"] = tuple(s["at"]) if s["at"] else None
        if not state.hasTimedOut:
            for pdf in pdfs:
                times = pdf["at_ms"].astype("Int64").fillna(passed)
                waiting += [[int(q), int(t), k if isinstance(k, str) else None, p if isinstance(p, str) else None] for q, t, k, p in zip(pdf["seq"], times, pdf["kind"], pdf["payload"])]
        waiting.sort(key=lambda e: e[0])
        ready = next((k for k, e in enumerate(waiting) if e[1] > passed), len(waiting))
        s, out = _run(key[0], s, pd.DataFrame(waiting[:ready], columns=["seq", "at_ms", "kind", "payload"]))
        state.update((json.dumps(s), json.dumps(waiting[ready:])))
        if waiting[ready:]:
            state.setTimeoutTimestamp(waiting[ready][1])
        if ready:
            yield out

    if late is None:
        return events.select("session", "seq", "kind", "payload").groupBy("session").applyInPandasWithState(some, OUT, "state string", "append", "NoTimeout")
    timed = events.withWatermark("at", late).select("session", "seq", "kind", "payload", "at", F.unix_millis("at").alias("at_ms"))
    return timed.groupBy("session").applyInPandasWithState(in_order, OUT, "state string, waiting string", "append", "EventTimeTimeout")
