"""Deterministic bar series."""

import math
from datetime import datetime, timedelta

from structura.operators.series import Bars


def walk(n, seed, start=datetime(2020, 1, 1), step=timedelta(days=1), weekdays=True):
    """A linear congruential price walk; the constants are fixed values of the published counts below."""
    state, rows, price, dt = seed, [], 10.0, start

    def u():
        nonlocal state
        state = (state * 1103515245 + 12345) & 0x7FFFFFFF
        return (state >> 16) / 32768.0

    while len(rows) < n:
        if not weekdays or dt.weekday() < 5:
            close = price * (1 + (u() - 0.5) * 0.03 + (u() - 0.5) * 0.02)
            high = max(price, close) * (1 + u() * 0.012)
            low = min(price, close) * (1 - u() * 0.012)
            rows.append((dt, price, high, low, close, 1e6 + u() * 9e5))
            price = close
        dt += step
    return Bars(*(list(x) for x in zip(*rows)))


def sine(n=160, period=6, drift=80, amplitude=0.3, start=datetime(2025, 1, 1)):
    closes = [20 + 3 * math.sin(i / period) + i / drift for i in range(n)]
    return Bars([start + timedelta(days=i) for i in range(n)], closes, [c + amplitude for c in closes], [c - amplitude for c in closes], closes, [1.0] * n)
