"""Orthogonal wavelet filters: five by table, the Daubechies, symlet and coiflet families by spectral factorisation.

All filters of N vanishing moments come from one polynomial, whose roots fall into groups {z, 1/z} (with their
conjugates): a filter takes one of each group. Daubechies' takes those inside the unit circle; the symlet is the choice
whose phase is closest to a line. Roots are refined in decimal arithmetic, because the polynomial's grow fast with N.
"""

from __future__ import annotations

import re
from decimal import Decimal, localcontext
from functools import lru_cache
from itertools import product
from math import comb

import numpy as np

# The published decomposition low-pass coefficients of the five filters.
LOW_PASS = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db4": [-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965],
    "db6": [
        -0.0010773010853084796, 0.004777257510945511, 0.0005538422011614961, -0.03158203931748603, 0.027522865530305727, 0.09750160558732304,
        -0.12976686756726194, -0.22626469396543983, 0.31525035170919763, 0.7511339080210954, 0.49462389039845306, 0.11154074335010947,
    ],
    "coif3": [
        -3.459977319727278e-05, -7.0983302506379e-05, 0.0004662169598204029, 0.0011175187708306303, -0.0025745176881367972, -0.009007976136730624,
        0.015880544863669452, 0.03455502757329774, -0.08230192710629983, -0.07179982161915484, 0.42848347637737, 0.7937772226260872,
        0.40517690240911824, -0.06112339000297255, -0.06577191128146936, 0.023452696142077168, 0.007782596425672746, -0.003793512864380802,
    ],
    "sym4": [-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161, 0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427],
}
WAVELETS = tuple(LOW_PASS)


#: Orders that are computed: vanishing moments of db and sym, half of them of coif.
HIGHEST = {"db": 20, "sym": 20, "coif": 5}
DIGITS, STARTS = 60, 60


def times(a: tuple, b: tuple) -> tuple:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def over(a: tuple, b: tuple) -> tuple:
    n = b[0] * b[0] + b[1] * b[1]
    return (a[0] * b[0] + a[1] * b[1]) / n, (a[1] * b[0] - a[0] * b[1]) / n


def square_root(a: tuple) -> tuple:
    size = (a[0] * a[0] + a[1] * a[1]).sqrt()
    re_ = ((size + a[0]) / 2).sqrt()
    im = ((size - a[0]) / 2).sqrt()
    return re_, im if a[1] >= 0 else -im


def root_groups(n: int) -> list[list[tuple]]:
    """For each group of the polynomial of order n its members inside the unit circle: one real root, or a root and its conjugate."""
    rising = [comb(n - 1 + k, k) for k in range(n)]  # sum of C(n - 1 + k, k) y^k
    groups = []
    for guess in np.roots(rising[::-1]) if n > 1 else []:
        if guess.imag < -1e-9:
            continue
        y = (Decimal(float(guess.real)), Decimal(float(guess.imag)) if abs(guess.imag) > 1e-9 else Decimal(0))
        for _ in range(12):
            value, slope = (Decimal(0), Decimal(0)), (Decimal(0), Decimal(0))
            for c in reversed(rising):
                slope = tuple(u + v for u, v in zip(times(slope, y), value, strict=True))
                value = times(value, y)
                value = (value[0] + c, value[1])
            step = over(value, slope)
            y = (y[0] - step[0], y[1] - step[1])
        # y = (2 - z - 1/z) / 4
        half = (1 - 2 * y[0], -2 * y[1])
        root = square_root(tuple(u - v for u, v in zip(times(half, half), (1, 0), strict=True)))
        z = (half[0] + root[0], half[1] + root[1])
        if z[0] * z[0] + z[1] * z[1] > 1:
            z = over((Decimal(1), Decimal(0)), z)
        groups.append([z] if y[1] == 0 else [z, (z[0], -z[1])])
    return groups


def from_roots(n: int, roots: list[tuple]) -> list[Decimal]:
    """The filter with n zeros at -1 and the given ones, highest power first, scaled so that its taps sum to the root of 2."""
    taps = [(Decimal(1), Decimal(0))]
    for z in [(Decimal(-1), Decimal(0))] * n + roots:
        shifted = [*taps, (Decimal(0), Decimal(0))]
        for i, t in enumerate(taps):
            p = times(t, z)
            shifted[i + 1] = (shifted[i + 1][0] - p[0], shifted[i + 1][1] - p[1])
        taps = shifted
    real = [t[0] for t in taps]
    scale = Decimal(2).sqrt() / sum(real)
    return [t * scale for t in real]


def bend(taps: np.ndarray) -> float:
    """How far the phase of a filter is from its best line, over the half of the frequencies that it passes."""
    w = np.linspace(0.0, np.pi * 0.75, 64)
    phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(len(taps)))) @ taps))
    slope = (w * phase).sum() / (w * w).sum()
    return float(((phase - slope * w) ** 2).sum())


def daubechies(n: int) -> list[float]:
    with localcontext() as ctx:
        ctx.prec = DIGITS
        inside = [z for g in root_groups(n) for z in g]
        return [float(t) for t in reversed(from_roots(n, inside))]


def symlet(n: int) -> list[float]:
    """Of a filter and its mirror image the one whose energy comes first; below order 4 there is no choice, and it is Daubechies'."""
    if n < 4:
        return daubechies(n)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        one, groups = (Decimal(1), Decimal(0)), root_groups(n)
        rough = [[complex(float(z[0]), float(z[1])) for z in g] for g in groups]
        best = None
        for flips in product((False, True), repeat=len(groups) - 1):
            chosen = [1 / z if f else z for f, g in zip((False, *flips), rough, strict=True) for z in g]
            taps = np.real(np.poly([-1.0] * n + chosen))
            found = (bend(taps / taps.sum()), flips)
            best = found if best is None else min(best, found)
        roots = [over(one, z) if f else z for f, g in zip((False, *best[1]), groups, strict=True) for z in g]
        taps = [float(t) for t in from_roots(n, roots)]
    early = sum(i * t * t for i, t in enumerate(taps)) <= (len(taps) - 1) / 2
    return taps if early else taps[::-1]


def coiflet(k: int) -> list[float]:
    """6 k taps: 2 k vanishing moments of the wavelet, and of the scaling function about its centre.

    The low-pass filter is c^k (sum of C(k - 1 + j, j) s^j, j < k, + s^k f), where c and s are the squares of cosine and
    sine of half the frequency; the 2 k numbers of f make it orthogonal. Newton's steps start at points drawn with a
    fixed seed; of the solutions the one that is most alike on both sides of its centre counts.
    """
    # in powers of x = exp(-iw), shifted: c = (1 + x)^2 / 4x and s = -(1 - x)^2 / 4x; place 0 is power -2 k
    c, s, width = np.array([1.0, 2.0, 1.0]) / 4, np.array([-1.0, 2.0, -1.0]) / 4, 6 * k
    power = lambda p, m: np.ones(1) if m == 0 else np.convolve(p, power(p, m - 1))
    at = lambda p, place: np.pad(p, (place, width - place - len(p)))
    known = sum(comb(k - 1 + j, j) * np.pad(power(s, j), (k - 1 - j, k - 1 - j)) for j in range(k))
    known = at(np.convolve(power(c, k), known), 1) * np.sqrt(2)
    free = np.stack([at(np.convolve(power(c, k), power(s, k)), i) for i in range(2 * k)], axis=1) * np.sqrt(2)
    found = []
    for seed in range(STARTS):
        f = np.random.default_rng(seed).normal(size=2 * k) * 2
        for _ in range(40):
            if not np.abs(f).max() < 1e6:  # it went astray
                break
            h = known + free @ f
            miss = np.array([h[: width - 2 * m] @ h[2 * m :] - (m == 0) for m in range(3 * k)])
            slope = np.stack([free[: width - 2 * m].T @ h[2 * m :] + free[2 * m :].T @ h[: width - 2 * m] for m in range(3 * k)])
            f = f - np.linalg.lstsq(slope, miss, rcond=None)[0]
        if np.abs(miss).max() < 1e-13:
            sides = np.abs(h[2 * k + 1 : 4 * k + 1] - h[: 2 * k][::-1]).sum() + np.abs(h[4 * k + 1 :]).sum()
            found.append((round(float(sides), 6), h[::-1].tolist()))
    if not found:
        raise ValueError(f"no coiflet of order {k}")
    return min(found)[1]


@lru_cache(maxsize=64)
def computed(family: str, order: int) -> list[float]:
    return {"db": daubechies, "sym": symlet, "coif": coiflet}[family](order)


def low_pass(wavelet: str) -> list[float]:
    """The decomposition low-pass filter of haar, dbN, symN or coifN."""
    if wavelet in LOW_PASS:
        return LOW_PASS[wavelet]
    name = re.fullmatch(r"(db|sym|coif)([1-9]\d*)", wavelet)
    if not name or not (2 if name[1] == "sym" else 1) <= int(name[2]) <= HIGHEST[name[1]]:
        raise ValueError(f"unknown wavelet {wavelet!r}; known: {', '.join(WAVELETS)}, db1 to db20, sym2 to sym20, coif1 to coif5")
    return computed(name[1], int(name[2]))


def high_pass(wavelet: str) -> list[float]:
    """The quadrature mirror of the low-pass filter."""
    low = low_pass(wavelet)
    return [(c if k % 2 else -c) for k, c in enumerate(reversed(low))]


def usable_levels(n: int, wavelet: str) -> int:
    """How often n points can be halved before the filter no longer fits."""
    taps = len(low_pass(wavelet))
    return 0 if n < taps else max(0, (n // (taps - 1)).bit_length() - 1)
