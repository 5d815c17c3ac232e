"""Asking a remote service with care: retries, two at a time, a mirror, and offline first.

These wrap callables ``ask(kind, lat, lon, radius_m) -> rows``; waiting and clocks are
passed in, so nothing sleeps in tests."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from wayfold.functions.errors import FIRST_WAIT_MS, MAX_RETRIES, MAX_WAIT_MS, WAIT_FACTOR, ServiceError
from wayfold.operators.sequences import TTL_MS

Ask = Callable[..., object]

# Fixed value: questions on the way at once.
AT_ONCE = 2


def wait_ms(error: Exception, retries: int) -> float | None:
    """How long to wait before the next try; None: give up."""
    if not isinstance(error, ServiceError) or error.kind not in ("rate-limited", "busy") or retries >= MAX_RETRIES:
        return None
    wait = error.retry_after_ms if error.retry_after_ms is not None else FIRST_WAIT_MS * WAIT_FACTOR**retries
    return wait if wait <= MAX_WAIT_MS else None


def fair(ask: Ask, sleep: Callable[[float], None] = time.sleep, at_once: int = AT_ONCE) -> Ask:
    """At most ``at_once`` questions, each retried while throttled."""
    slots = threading.Semaphore(at_once)

    def guarded(*args):
        with slots:
            retries = 0
            while True:
                try:
                    return ask(*args)
                except ServiceError as e:
                    wait = wait_ms(e, retries)
                    if wait is None:
                        raise
                    sleep(wait / 1000)
                    retries += 1

    return guarded


def with_mirror(first: Ask, second: Ask) -> Ask:
    """Ask the mirror only when the first is busy. If both fail, the error is the mirror's own
    only when it is busy too; any other failure of it doesn't hide that the first was busy."""

    def either(*args):
        try:
            return first(*args)
        except ServiceError as busy:
            if busy.kind != "busy":
                raise
            try:
                return second(*args)
            except ServiceError as e:
                raise (e if e.kind == "busy" else busy) from None

    return either


def offline_first(local: Ask, live: Ask, covers: Callable[..., bool]) -> Ask:
    """The local answer where coverage admits the whole circle, else the live one."""
    return lambda kind, lat, lon, radius_m: (local if covers(lat, lon, radius_m) else live)(kind, lat, lon, radius_m)


def with_cache(ask: Ask, read: Callable[[str], tuple[float, object] | None], write: Callable[[str, tuple[float, object]], None], key: Callable[..., str], now_ms: Callable[[], float], ttl_ms: float = TTL_MS) -> Ask:
    """Answers kept by key (``read`` and ``write`` of time and rows) while they are young.

    Only successes are kept, empty ones too. A cache that can't be read or written to is as
    good as none: it never makes a question fail."""

    def cached(*args):
        k = key(*args)
        try:
            hit = read(k)
        except Exception:
            hit = None
        if hit is not None and 0 <= now_ms() - hit[0] < ttl_ms:
            return hit[1]
        rows = ask(*args)
        try:
            write(k, (now_ms(), rows))
        except Exception:
            pass
        return rows

    return cached
