"""Start times of syllables on curves: the cheapest path through candidate boundaries.

A document's frames (boundary strength, voice activity) give candidates: peaks, rises of
activity, and a grid dense in voice and sparse in silence.  Every unit takes a later
candidate than the unit before it; a candidate costs by its strength, activity, the pause
before a line, and its distance from an anchor; a step costs by how long the unit before
is voiced against what its weight lets expect, by strong boundaries that it jumps, and by
silence inside.  The steps between two units' bands are priced as one matrix, as wide as
the longest unit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Params:
    """Expected lengths (seconds a weight, log spread), weights of the costs, grids and bands in seconds."""

    unit: float = 0.32
    spread: float = 0.75
    final: float = 0.9
    final_spread: float = 1.0
    longest: float = 4.0
    shortest: float = 0.05
    strength: float = 2.0
    jumped: float = 0.7
    length: float = 1.0
    anchor: float = 1.2
    line_pause: float = 2.0
    silent_start: float = 2.5
    silence: float = 3.0
    free_silence: float = 0.12
    grid: float = 0.03
    silent_grid: float = 0.1
    band: float = 2.5
    prior_band: float = 12.0


# Singing, and what differs in speech.
SONG = Params()
SPEECH = Params(unit=0.17, spread=0.6, final=0.3, final_spread=0.8, longest=1.6, strength=1.5, jumped=0.4, anchor=1.0, line_pause=1.0, silence=2.0, free_silence=0.15, grid=0.02, band=1.5, prior_band=8.0)
PEAK_NEAR, PEAK_WINDOW, PEAK_OVER, PEAK_ACTIVE, GRID_ACTIVE, ACTIVE, RISE = 0.04, 0.2, 0.04, 0.15, 0.3, 0.5, 0.8
PAUSE_LOOK, PAUSE_FULL, LINE_SILENCE, WORD_SILENCE, CLOSED_GAP, FINAL_LONGEST = 0.5, 0.3, 0.12, 0.15, 0.08, 2.5


@dataclass
class Units:
    """The units of a document as arrays; an anchor that is nan is none."""

    weight: np.ndarray
    opens: np.ndarray
    closes: np.ndarray
    anchor: np.ndarray
    trust: np.ndarray
    sigma: np.ndarray
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        n = len(self.weight)
        self.low = np.full(n, np.nan) if self.low is None else self.low
        self.high = np.full(n, np.nan) if self.high is None else self.high

    @property
    def anchored(self) -> np.ndarray:
        return ~np.isnan(self.anchor) & (self.trust > 0)


def moving(x: np.ndarray, size: int, what: str) -> np.ndarray:
    """Mean or greatest of ``size`` values around each, edges repeated."""
    left = size // 2
    padded = np.concatenate((np.full(left, x[0]), x, np.full(size - 1 - left, x[-1])))
    windows = np.lib.stride_tricks.sliding_window_view(padded, size)
    return windows.mean(axis=1) if what == "mean" else windows.max(axis=1)


def peaks(x: np.ndarray, hop: float, near: float = PEAK_NEAR, over: float = PEAK_OVER, window: float = PEAK_WINDOW) -> np.ndarray:
    """Frames that are the highest nearby and over the moving mean; the first of a plateau."""
    if not len(x):
        return np.zeros(0, int)
    k = max(1, round(near / hop))
    at = np.flatnonzero((x == moving(x, 2 * k + 1, "max")) & (x >= moving(x, max(1, int(window / hop)), "mean") + over) & (x > 0))
    return at[np.concatenate(([True], np.diff(at) > k))] if len(at) else at


class Curves:
    """Boundary strength and activity of a document's frames, and its candidates."""

    def __init__(self, boundary: np.ndarray, active: np.ndarray, hop: float):
        self.boundary, self.active, self.hop, self.n = np.asarray(boundary, float), np.asarray(active, float), hop, len(boundary)
        self.on = self.active > ACTIVE

    def frame(self, t: float) -> int:
        return int(np.clip(round(t / self.hop), 0, self.n - 1))

    def candidates(self, p: Params, t0: float, t1: float) -> None:
        hop, first = self.hop, max(0, int(t0 / self.hop))
        stop = min(self.n, int(np.ceil(t1 / hop)) + 1)
        inside = lambda f: f[(f >= first) & (f < stop)]
        high = inside(peaks(self.boundary, hop))
        high = high[self.active[high] > PEAK_ACTIVE]
        rises = inside(np.flatnonzero(np.diff(self.on.astype(np.int8)) == 1) + 1)
        grid = np.arange(first, stop, max(1, round(p.grid / hop)))
        frames = np.unique(np.concatenate((high, rises, grid[self.active[grid] > GRID_ACTIVE], np.arange(first, stop, max(1, round(p.silent_grid / hop))), [first])))
        value = np.zeros(self.n)
        value[high] = self.boundary[high]
        value[rises] = np.maximum(value[rises], RISE)
        voiced, silent = (np.concatenate(([0.0], np.cumsum(x) * hop)) for x in (self.on, ~self.on))
        self.time, self.peak, self.act, self.voiced = frames * hop, value[frames], self.active[frames], voiced[frames]
        self.strong = np.maximum(self.boundary[frames], self.peak)
        self.pause = np.clip((silent[frames] - silent[np.maximum(frames - int(PAUSE_LOOK / hop), 0)]) / PAUSE_FULL, 0, 1)
        self.passed = np.concatenate(([0.0], np.cumsum(self.peak)))

    def quiet_from(self, t: float, least: float, limit: float) -> float:
        """The first time from ``t`` on where the voice rests for ``least`` seconds, or the limit."""
        first, stop = self.frame(t), min(self.n, int(np.ceil(limit / self.hop)) + 1)
        need = max(1, int(least / self.hop))
        off = np.concatenate(([0], np.cumsum(~self.on[first:stop])))
        rests = np.flatnonzero(off[need:] - off[:-need] == need) if len(off) > need else []
        return (first + (int(rests[0]) if len(rests) else max(0, stop - first))) * self.hop

    def prior(self, u: Units, t0: float, t1: float, p: Params) -> np.ndarray:
        """Where each unit is expected: its share of the voiced time between anchors, else of all."""
        a = self.frame(t0)
        b = max(self.frame(t1), a + 1)
        clock = np.concatenate(([0.0], np.cumsum(self.on[a:b])))
        times = t0 + np.arange(len(clock)) * self.hop
        w = np.maximum(u.weight, 0.2)
        done = np.cumsum(w) - w
        known = np.flatnonzero(~np.isnan(u.anchor))
        if not len(known):
            total = done[-1] + w[-1]
            return np.interp(clock[-1] * done / total, clock, times) if clock[-1] > 0 else t0 + (t1 - t0) * done / total
        at = np.interp(u.anchor[known], times, clock)
        rate = (at[-1] - at[0]) / max(done[known[-1]] - done[known[0]], 1e-9) if len(known) > 1 else 0.0
        rate = rate if rate > 0 else p.unit / self.hop
        spot = np.interp(done, done[known], at)
        spot += np.minimum(0.0, done - done[known[0]]) * rate + np.maximum(0.0, done - done[known[-1]]) * rate
        out = np.interp(spot, clock, times)
        out[known] = u.anchor[known]
        return out


def huber(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1.0, 0.5 * x * x, x - 0.5)


def bands(c: Curves, u: Units, prior: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """The candidates (first, after the last) of each unit, each band beginning after the one before."""
    m = len(c.time)
    sure = ~np.isnan(u.anchor) & (u.trust >= 0.5)
    half = np.where(sure, np.maximum(p.band, 6 * u.sigma), p.band * 2.5 if u.anchored.any() else p.prior_band)
    low, high = prior - half, prior + half
    low = np.where(np.isnan(u.low), low, np.where(u.low <= high, np.maximum(low, u.low), u.low))
    high = np.where(np.isnan(u.high), high, np.where(u.high >= low, np.minimum(high, u.high), u.high))
    low, high = np.minimum(low, high), np.maximum(low, high)
    first = np.minimum(np.searchsorted(c.time, low, "left"), m - 1)
    after = np.maximum(np.searchsorted(c.time, high, "right"), first + 1)
    # a[k] > a[k - 1]: the greatest so far of a[k] - k, plus k.
    k = np.arange(len(first))
    first = np.minimum(np.maximum.accumulate(first - k) + k, m - 1)
    return [(int(a), int(min(max(b, a + 1), m))) for a, b in zip(first, after)]


def length_cost(voiced: np.ndarray, weight: float, closes: bool, p: Params) -> np.ndarray:
    """How unlikely a voiced length is, in squared spreads of its logarithm."""
    expected, spread = (max(p.final, p.unit * weight), p.final_spread) if closes else (p.unit * max(weight, 0.3), p.spread)
    z = (np.log(voiced + 0.03) - np.log(expected)) / spread
    return p.length * 0.5 * z * z


def align_units(u: Units, c: Curves, p: Params = SONG, t0: float = 0.0, t1: float | None = None) -> np.ndarray:
    """(units, 2): start and end of each unit."""
    n = len(u.weight)
    if not n or not c.n:
        return np.zeros((n, 2))
    end = c.n * c.hop if t1 is None else min(t1, c.n * c.hop)
    c.candidates(p, t0, end)
    place = bands(c, u, c.prior(u, t0, end, p), p)

    def own(i: int, at: slice) -> np.ndarray:
        t = c.time[at]
        cost = p.silent_start * (1.0 - c.act[at]) - p.strength * c.strong[at] - (p.line_pause * c.pause[at] if u.opens[i] else 0.0)
        if u.anchored[i]:
            cost = cost + p.anchor * u.trust[i] * huber((t - u.anchor[i]) / max(u.sigma[i], 0.02))
        return np.where((t < u.low[i] - 1e-6) | (t > u.high[i] + 1e-6), np.inf, cost)

    def steps(i: int, pa: int, pb: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(cost, from): of unit i from each candidate that is near enough to the next one's a.., the nearest first."""
        new = np.arange(a, b)
        longest = p.longest * (FINAL_LONGEST if u.closes[i] else 1.0)
        low = np.maximum(np.searchsorted(c.voiced, c.voiced[new] - longest - 1e-9, "left"), pa)
        old = new - np.arange(1, max(1, int((new - low).max())) + 1)[:, None]
        may = (old >= low) & (old < pb)
        old = np.where(may, old, pa)
        passed, voiced = c.time[new] - c.time[old], c.voiced[new] - c.voiced[old]
        may &= (passed >= p.shortest) & (voiced <= longest)
        cost = length_cost(np.maximum(voiced, 0.0), u.weight[i], bool(u.closes[i]), p) + p.jumped * (c.passed[new] - c.passed[old + 1])
        if not u.closes[i]:
            cost = cost + p.silence * np.maximum(0.0, passed - voiced - p.free_silence)
        return np.where(may, cost, np.inf), old

    a, b = place[0]
    total, came = own(0, slice(a, b)), []
    for i in range(1, n):
        (pa, pb), (a, b) = place[i - 1], place[i]
        cost, old = steps(i - 1, pa, pb, a, b)
        through = cost + total[old - pa]
        best, each = through.argmin(axis=0), np.arange(b - a)
        reach, back = through[best, each], old[best, each]
        if np.isinf(reach).all():  # no way here: the chain starts again at this unit
            reach, back = np.full(b - a, total.min()), np.full(b - a, pa + int(total.argmin()))
        came.append(back)
        total = reach + own(i, slice(a, b))
    a, b = place[-1]
    rest = np.array([max(c.quiet_from(c.time[j] + p.shortest, LINE_SILENCE, end) - c.time[j], p.shortest) for j in range(a, b)])
    j = a + int((total + length_cost(rest, u.weight[-1], True, p)).argmin())
    path = [j]
    for i in range(n - 1, 0, -1):
        j = int(came[i - 1][j - place[i][0]]) if place[i][0] <= j < place[i][1] else max(0, j - 1)
        path.append(j)
    start = np.maximum.accumulate(c.time[path[::-1]])
    return with_ends(start, u, c, p, end)


def with_ends(start: np.ndarray, u: Units, c: Curves, p: Params, limit: float) -> np.ndarray:
    """A unit ends where the voice rests, at the next one's start at the latest; small gaps in a line close."""
    after = np.append(start[1:], limit)
    after = np.where(after <= start, start + p.shortest, after)
    rest = np.array([c.quiet_from(s + p.shortest, LINE_SILENCE if closes else WORD_SILENCE, nxt) for s, closes, nxt in zip(start, u.closes, after)])
    end = np.minimum(after, rest)
    end = np.where(~u.closes.astype(bool) & (after - end < CLOSED_GAP), after, end)
    end = np.maximum(end, start + p.shortest)
    end[:-1] = np.minimum(end[:-1], np.maximum(start[1:], start[:-1] + 1e-3))
    return np.stack((start, end), axis=1)


def align_frames(units: DataFrame, frames: DataFrame, key: str, hop: float, p: Params = SONG) -> DataFrame:
    """(key, g_no, start, end) of units (key, g_no, weight, line_start, line_end, anchor, trust, sigma) on
    frames (key, i, boundary, active), a document at a time.

    Null anchors are none; a document without frames has all its units at 0, one without
    units gives nothing; frames that are missing are silent.
    """
    kind = dict(units.dtypes)[key]

    def run(k, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("g_no")
        size = int(b["i"].max()) + 1 if len(b) else 0
        curves = np.zeros((2, size))
        curves[:, b["i"].to_numpy()] = b[["boundary", "active"]].to_numpy().T
        u = Units(a["weight"].to_numpy(float), a["line_start"].to_numpy(bool), a["line_end"].to_numpy(bool), a["anchor"].to_numpy(float), a["trust"].fillna(0.0).to_numpy(float), a["sigma"].fillna(0.1).to_numpy(float))
        out = align_units(u, Curves(curves[0], curves[1], hop), p)
        return pd.DataFrame({key: [k[0]] * len(a), "g_no": a["g_no"].to_numpy(), "start": out[:, 0], "end": out[:, 1]})

    u = units.select(key, "g_no", "weight", "line_start", "line_end", "anchor", "trust", "sigma")
    return u.groupBy(key).cogroup(frames.select(key, "i", "boundary", "active").groupBy(key)).applyInPandas(run, f"`{key}` {kind}, g_no int, start double, end double")
