"""Syllable alignment on made curves: accuracy floors, and the path against every path."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.operators import syllable_path as sp

HOP = 0.01
LINES = (7, 9, 6, 8, 10)


def made(seed, gap=1.0, unit=0.32, noise=0.05, legato=0.0):
    """Curves with a peak at each start, activity while sung, noise on both; units and true (start, end)."""
    r = np.random.default_rng(seed)
    truth, t = [], 0.8
    for size in LINES:
        line = []
        for k in range(size):
            d = unit * np.exp(r.normal(0, 0.3)) * (2.0 if k == size - 1 else 1.0)
            line.append((t, t + d))
            t += d
        truth.append(line)
        t += gap
    n = int(t / HOP) + 50
    boundary, active = np.abs(r.normal(0, noise, n)), np.clip(r.normal(0.03, 0.02, n), 0, 0.2)
    for line in truth:
        for a, b in line:
            active[round(a / HOP) : round(b / HOP)] = 0.95
            weak = a != line[0][0] and r.random() < legato
            boundary[round(a / HOP)] = (0.25 if weak else 0.6) + 0.4 * r.random()
    flat = [x for line in truth for x in line]
    opens = np.array([k == 0 for line in truth for k in range(len(line))])
    closes = np.array([k == len(line) - 1 for line in truth for k in range(len(line))])
    none = np.full(len(flat), np.nan)
    return sp.Curves(boundary, active, HOP), sp.Units(np.ones(len(flat)), opens, closes, none, np.zeros(len(flat)), np.full(len(flat), 0.1)), np.array(flat)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_song_without_anchors(seed):
    curves, units, truth = made(seed)
    got = sp.align_units(units, curves)
    assert (np.abs(got[:, 0] - truth[:, 0]) < 0.05).mean() > 0.9 and (np.diff(got[:, 0]) > 0).all() and (got[:, 1] > got[:, 0]).all()
    ends = np.flatnonzero(units.closes)
    assert (np.abs(got[ends, 1] - truth[ends, 1]) < 0.15).all()


@pytest.mark.parametrize("params, unit, noise", [(sp.SONG, 0.32, 0.25), (sp.SPEECH, 0.17, 0.08)])
def test_noisy_anchors(params, unit, noise):
    near = []
    for seed in range(8):
        curves, units, truth = made(seed, unit=unit, legato=0.15, gap=0.6)
        r = np.random.default_rng(seed)
        units.anchor, units.trust, units.sigma = truth[:, 0] + r.normal(0, noise, len(truth)), np.full(len(truth), 0.8), np.full(len(truth), noise)
        near.append((np.abs(sp.align_units(units, curves, params)[:, 0] - truth[:, 0]) < 0.08).mean())
    assert np.mean(near) > 0.85


def test_path_is_the_cheapest():
    """Three units on a short curve: the cost of every triple of candidates, spelled out."""
    for seed in range(6):
        r = np.random.default_rng(seed)
        n = 90
        boundary, active = np.where(r.random(n) < 0.08, r.random(n), 0.0), (r.random(n // 10).repeat(10) < 0.8) * 0.9
        curves = sp.Curves(boundary, active, HOP)
        units = sp.Units(np.array([1.0, 2.0, 1.0]), np.array([True, False, False]), np.array([False, False, True]), np.array([np.nan, 0.4, np.nan]), np.array([0, 0.7, 0]), np.full(3, 0.1))
        p = sp.Params(grid=0.05, silent_grid=0.08, unit=0.2)
        got = sp.align_units(units, curves, p)
        end, m = n * HOP, len(curves.time)
        place = sp.bands(curves, units, curves.prior(units, 0.0, end, p), p)

        def price(path):
            total = 0.0
            for i, j in enumerate(path):
                total += 2.5 * (1 - curves.act[j]) - 2.0 * curves.strong[j] - (2.0 * curves.pause[j] if i == 0 else 0.0)
                if i == 1:
                    x = abs((curves.time[j] - 0.4) / 0.1)
                    total += 1.2 * 0.7 * (x * x / 2 if x < 1 else x - 0.5)
                if i < 2:
                    q = path[i + 1]
                    passed, voiced = curves.time[q] - curves.time[j], curves.voiced[q] - curves.voiced[j]
                    if passed < 0.05 or voiced > 4.0:
                        return np.inf
                    total += 0.5 * (np.log((voiced + 0.03) / (0.2 * units.weight[i])) / 0.75) ** 2 + 0.7 * curves.peak[j + 1 : q].sum() + 3.0 * max(0.0, passed - voiced - 0.12)
                else:
                    rest = max(curves.quiet_from(curves.time[j] + 0.05, 0.12, end) - curves.time[j], 0.05)
                    total += 0.5 * np.log((rest + 0.03) / 0.9) ** 2
            return total

        paths = (t for t in itertools.combinations(range(m), 3) if all(a <= j < b for j, (a, b) in zip(t, place)))
        best = min(map(price, paths))
        at = [int(np.flatnonzero(np.isclose(curves.time, t))[0]) for t in got[:, 0]]
        assert price(at) == pytest.approx(best, abs=1e-9)


def test_of_tables(spark):
    curves, units, truth = made(5)
    frames = [(1, i, float(b), float(a)) for i, (b, a) in enumerate(zip(curves.boundary, curves.active))]
    rows = [(1, k, 1.0, bool(units.opens[k]), bool(units.closes[k]), None, None, None) for k in range(len(truth))] + [(2, 0, 1.0, True, True, 0.5, 0.5, None)]
    u = spark.createDataFrame(rows, "d int, g_no int, weight double, line_start boolean, line_end boolean, anchor double, trust double, sigma double")
    f = spark.createDataFrame([*frames, (3, 0, 0.5, 1.0)], "d int, i int, boundary double, active double")
    got = sp.align_frames(u, f, "d", HOP).orderBy("d", "g_no").collect()
    assert (np.abs(np.array([r["start"] for r in got if r["d"] == 1]) - truth[:, 0]) < 0.05).mean() > 0.9
    assert [(r["start"], r["end"]) for r in got if r["d"] == 2] == [(0.0, 0.0)] and len(got) == len(rows)
    assert sp.align_frames(u.where("d = 9"), f.where("d = 9"), "d", HOP).count() == 0
