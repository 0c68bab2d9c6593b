"""Plain sequential model of the application's answer handling (test oracle)."""

from __future__ import annotations

LARGEST = 9_223_372_036_854_775_807


def fold(history, base):
    """history: [(ts, remembered)] -> list of (ts, remembered, secs, streak) after each answer.

    One step per answer: remembered doubles the interval, forgotten sets it to six
    hours. An interval beyond 64 bits is reported as None. Repeated timestamps: the failure wins.
    """
    by_ts = {}
    for t, r in history:
        by_ts[t] = by_ts.get(t, True) and r
    out, secs, streak = [], base, 0
    for t in sorted(by_ts):
        if by_ts[t]:
            secs, streak = secs * 2, streak + 1
        else:
            secs, streak = 21600, 0
        out.append((t, by_ts[t], secs if secs <= LARGEST else None, streak))
    return out
