"""Sequential admission of alerts: the small steps that run inside tasks over sorted rows.

No step holds a whole group: a batch of rows is worked on as arrays, and what passes to the next batch is a few numbers per open group.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd

COOLDOWN_FLOOR = 30.0


def cooldown_seconds(reputation: np.ndarray, base: float) -> np.ndarray:
    rep = np.where(np.isnan(reputation), 50.0, reputation)
    return np.maximum(COOLDOWN_FLOOR, base * (1.0 - rep / 200.0))


def _group_bounds(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a new group begins among sorted rows, the first row included, and the end."""
    changed = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        values = pdf[k].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.r_[0, np.flatnonzero(changed), len(pdf)] if len(pdf) else np.array([0])


def cooled_down(keys: list[str], base: float):
    """Task function over rows sorted by (keys, time): adds `allowed`.

    A row is allowed once its time less its own wait reaches the last allowed time, so the next allowed row is looked up, not walked to.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, -np.inf
        for pdf in batches:
            times = pdf["_at"].to_numpy(dtype=float)
            ready = times - cooldown_seconds(pdf["reputation"].to_numpy(dtype=float), base)
            allowed = np.zeros(len(pdf), dtype=bool)
            bounds = _group_bounds(pdf, keys)
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
                group = tuple(pdf[k].iat[begin] for k in keys)
                if group != current:
                    current, last = group, -np.inf
                i = begin
                while i < end:
                    # the wait lies between the floor and the larger of floor and base: nothing passes before, everything after
                    i += int(np.searchsorted(times[i:end], last + COOLDOWN_FLOOR, side="left"))
                    stop = min(end, i + 1 + int(np.searchsorted(times[i:end], last + max(base, COOLDOWN_FLOOR), side="left")))
                    passing = np.flatnonzero(ready[i:stop] >= last)
                    if not len(passing):
                        i = max(stop, i + 1)
                        continue
                    i += int(passing[0])
                    allowed[i], last = True, times[i]
                    i += 1
            yield pdf.drop(columns="_at").assign(allowed=allowed)
    return run


def walked_reputation(keys: list[str], low: float = 0.0, high: float = 100.0):
    """Task function over rows sorted by (keys, time) with the carried-in reputation: adds `reputation`.

    A step is x -> min(hi, max(lo, x + b)). Steps compose to a step of that form, so running compositions come from doubling: after k
    rounds each row holds the composition of the 2**k rows up to it, within its group.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, value = None, None
        for pdf in batches:
            n = len(pdf)
            bounds = _group_bounds(pdf, keys)
            start = np.repeat(bounds[:-1], np.diff(bounds))
            x = pdf["carried"].to_numpy(dtype=float).copy()[start] if n else np.empty(0)
            if n and current is not None and tuple(pdf[k].iat[0] for k in keys) == current:
                x[:bounds[1]] = value
            shift = np.where(pdf["is_valid"].to_numpy(dtype=bool), 2.0, -1.0)
            lo, hi = np.full(n, low), np.full(n, high)
            width, place = 1, np.arange(n)
            longest = int(np.diff(bounds).max()) if n else 0
            while width < longest:
                mine = np.flatnonzero(place - width >= start)
                before = mine - width
                new_shift = shift[before] + shift[mine]
                new_lo = np.clip(lo[before] + shift[mine], lo[mine], hi[mine])
                new_hi = np.clip(hi[before] + shift[mine], lo[mine], hi[mine])
                shift[mine], lo[mine], hi[mine] = new_shift, new_lo, new_hi
                width *= 2
            out = np.minimum(hi, np.maximum(lo, x + shift))
            if n:
                current, value = tuple(pdf[k].iat[n - 1] for k in keys), out[n - 1]
            yield pdf.drop(columns="carried").assign(reputation=out)
    return run


class ScopeBudget:
    """Who was admitted when in one scope, as sorted times; all limits are answered from these and one token level.

    Admitted are fewer than per_min in 60 s and per_hour in 3600 s; there must be a whole token (burst at most, per_min / 60 more each
    second); and an account may have its even share of the minute, at least one.
    """

    def __init__(self, per_min: int, per_hour: int, burst: int, saved: str | None = None):
        self.per_min, self.per_hour, self.burst = per_min, per_hour, burst
        told = json.loads(saved) if saved else {}
        self.times: list[float] = told.get("times", [])
        self.by_account: dict[str, list[float]] = told.get("by_account", {})
        self.level, self.level_at = told.get("level", float(burst)), told.get("level_at")

    def admits(self, now: float, account: str) -> bool:
        """Whether an alert may go out now; if so, it is entered. An account counts as seen once it gets as far as its share."""
        tokens = self.level if self.level_at is None else min(self.burst, self.level + (now - self.level_at) * self.per_min / 60.0)
        n = len(self.times)
        within = lambda times, seconds: len(times) - bisect_left(times, now - seconds)
        if within(self.times, 60) >= self.per_min or within(self.times, 3600) >= self.per_hour or tokens < 1.0 - 1e-9:
            return False
        own = self.by_account.setdefault(account, [])
        if within(own, 60) >= max(1, self.per_min // len(self.by_account)):
            return False
        self.level, self.level_at = tokens - 1.0, now
        self.times.append(now)
        own.append(now)
        if n > 4 * self.per_hour:
            del self.times[:bisect_left(self.times, now - 3600)]
            self.by_account = {k: v[bisect_left(v, now - 60):] for k, v in self.by_account.items()}
        return True

    def saved(self) -> str:
        return json.dumps({"times": self.times, "by_account": self.by_account, "level": self.level, "level_at": self.level_at})


def gated(base: float, per_min: int, per_hour: int, burst: int):
    """Task function over valid messages sorted by (scope, time): cooldown and rate limit in
    one step, since a rate-limited alert starts no cooldown. Adds `admitted` and, for admitted
    rows, `rate_state`: what the next batch of the scope continues from."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, budget, last = None, None, {}
        for pdf in batches:
            times = pdf["_at"].to_numpy(dtype=float)
            ready = times - cooldown_seconds(pdf["reputation"].to_numpy(dtype=float), base)
            admitted, saved = np.zeros(len(pdf), dtype=bool), np.full(len(pdf), None, dtype=object)
            bounds = _group_bounds(pdf, ["scope"])
            senders, accounts = pdf["sender_id"].to_numpy(), pdf["account_name"].to_numpy()
            before = pdf["_last_alert"].to_numpy(dtype=float)
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
                if budget is None or pdf["scope"].iat[begin] != current:
                    current, last = pdf["scope"].iat[begin], {}
                    budget = ScopeBudget(per_min, per_hour, burst, pdf["_rate_state"].iat[begin])
                for i in range(begin, end):
                    since = last.get(senders[i], before[i])
                    if (np.isnan(since) or ready[i] >= since) and budget.admits(times[i], accounts[i]):
                        last[senders[i]], admitted[i], saved[i] = times[i], True, budget.saved()
            yield pdf.drop(columns=["_at", "_last_alert", "_rate_state"]).assign(admitted=admitted, rate_state=saved)
    return run
