"""Per-series forecasters, fitted for a whole batch of series at once: smoothing and seasonal ARIMA models by likelihood.

A batch is a matrix of histories, aligned at their last day. Every candidate model of every series is a row; all rows
run through the days together, and a Gauss-Newton search with damped steps moves all their parameters at once (each
row's steps and damping are its own). Models of one series are compared by corrected AIC. Forecasts are not clipped but at
zero, as demand is not negative.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from stockweave.params import HORIZON, SEASON

#: Candidates that are searched at once, times days: bounds the errors held.
CELLS = 4 << 20
STEPS, NUDGE = 16, 1e-4


def aicc(sse: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of k parameters, variance included, from the sum of squared errors."""
    return n * np.log(np.maximum(sse, 1e-12) / n) + 2 * k + 2 * k * (k + 1) / np.maximum(n - k - 1, 1e-9)


def gauss_newton(errors: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, free: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, sum of squares) of each row; errors(parameters, rows) gives (points, days); free marks what may move.

    Each step evaluates a row's point and a nudge of each free parameter. A step that raises the sum is taken back and
    shortened. A row rests once a step gains less than a millionth, or three steps in a row gain nothing.
    """
    n, k = x.shape
    most = int(free.sum(axis=1).max(initial=0))
    which = np.argsort(~free, axis=1, kind="stable")[:, :most]  # the free ones first
    moved = np.take_along_axis(free, which, axis=1)
    best, trial, cost, damp, idle = x.copy(), x.copy(), np.full(n, np.inf), np.full(n, 1e-2), np.zeros(n, int)
    curve, slope = np.zeros((n, most, most)), np.zeros((n, most))
    live = np.arange(n)
    for _ in range(steps if most else 1):
        points = np.repeat(trial[live, None], most + 1, axis=1)
        for j in range(most):
            points[np.arange(len(live)), j + 1, which[live, j]] += NUDGE * moved[live, j]
        with np.errstate(all="ignore"):
            e = errors(points.reshape(-1, k), np.repeat(live, most + 1)).reshape(len(live), most + 1, -1)
            now = np.einsum("nt,nt->n", e[:, 0], e[:, 0])
        better = now < cost[live]
        gained = np.where(better, cost[live] - now, 0.0) > 1e-6 * np.abs(now)
        up, own = live[better], e[better]
        change = (own[:, 1:] - own[:, :1]) / NUDGE
        curve[up], slope[up] = change @ change.transpose(0, 2, 1), np.einsum("njt,nt->nj", change, own[:, 0])
        best[up], cost[up] = trial[up], now[better]
        damp[live] = np.clip(np.where(better, damp[live] * 0.2, damp[live] * 8.0), 1e-8, 1e8)
        idle[live] = np.where(gained, 0, idle[live] + np.where(better, 3, 1))
        live = live[idle[live] < 3]
        if not len(live) or not most:
            break
        left = np.where(np.isfinite(curve[live]), curve[live], 0.0)
        scale = np.einsum("njj->nj", left)
        scale = scale + 1e-9 * (scale.max(axis=1)[:, None] + 1e-12)
        step = np.linalg.solve(left + (damp[live, None] * scale)[:, :, None] * np.eye(most), -np.nan_to_num(slope[live])[:, :, None])[:, :, 0]
        trial[live] = best[live]
        for j in range(most):
            trial[live, which[live, j]] += np.clip(step[:, j], -2.0, 2.0) * moved[live, j]
    return best, cost


def batches(histories: list[np.ndarray], rows_each: int) -> Iterable[np.ndarray]:
    """Numbers of histories, in groups whose candidates' errors are bounded; like lengths go together."""
    order = np.argsort([len(y) for y in histories], kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * rows_each * len(histories[order[hi]]) <= CELLS:
            hi += 1
        yield order[lo:hi]
        lo = hi


def aligned(histories: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(series, days) that ends with every history's last day, 0 before its first; each one's length."""
    lengths = np.array([len(y) for y in histories])
    out = np.zeros((len(histories), int(lengths.max())))
    for row, y in zip(out, histories, strict=True):
        row[len(row) - len(y) :] = y
    return out, lengths


# ---- exponential smoothing

#: Error, trend and season of the families; multiplicative ones need values above 0.
FAMILIES = [("A", t, s) for s in "NA" for t in ("N", "A", "Ad")] + [("M", t, s) for s in "NAM" for t in ("N", "A", "Ad")]
_STARTS = (0.1,)


def _between(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    return lo + (hi - lo) / (1.0 + np.exp(-np.clip(x, -30, 30)))


def ets_weights(x: np.ndarray, trend: np.ndarray, season: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """alpha, beta, gamma and phi of search parameters: 0 < beta < alpha < 1, gamma < 1 - alpha, phi from 0.8 to 0.98."""
    alpha = _between(x[:, 0], 1e-4, 0.9999)
    beta = np.where(trend > 0, alpha * _between(x[:, 1], 1e-4, 0.9999), 0.0)
    gamma = np.where(season > 0, (1 - alpha) * _between(x[:, 2], 1e-4, 0.9999), 0.0)
    return alpha, beta, gamma, np.where(trend == 2, _between(x[:, 3], 0.8, 0.98), (trend == 1).astype(float))


def ets_start(y: np.ndarray, first: int, season: int = SEASON) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Level, trend, additive and multiplicative season before the first day, from the first weeks; a season by day of the row."""
    early = y[first : first + min(len(y) - first, 8 * season)]
    whole = early[: len(early) // season * season].reshape(-1, season)
    level, by_day = whole.mean(), whole.mean(axis=0)
    trend = (whole[len(whole) // 2 :].mean() - whole[: len(whole) // 2].mean()) / (season * max(1, (len(whole) + 1) // 2)) if len(whole) > 1 else 0.0
    at = (first + np.arange(season)) % season
    add, mul = np.zeros(season), np.ones(season)
    add[at], mul[at] = by_day - level, by_day / level if level > 0 else 1.0
    return float(level), float(trend), add, mul


def ets_filter(y: np.ndarray, first: np.ndarray, rows: np.ndarray, kind: np.ndarray, start: tuple, x: np.ndarray, season: int = SEASON) -> tuple[np.ndarray, tuple]:
    """((points, days) errors, last states): one pass through the days for all points.

    kind: (points, 3) of error, trend and season as numbers. Errors of multiplicative families are scaled by the
    geometric mean of the forecasts, so that sums of squares compare as likelihoods.
    """
    error, trend, seasonal = kind.T
    alpha, beta, gamma, phi = ets_weights(x, trend, seasonal)
    level, slope = start[0][rows].copy(), np.where(trend > 0, start[1][rows], 0.0)
    mul = seasonal == 2
    cycle = np.where(mul[:, None], start[3][rows], np.where((seasonal == 1)[:, None], start[2][rows], 0.0)).T.copy()
    values, begins = np.ascontiguousarray(y.T), first[rows]
    days, some_mul, late = y.shape[1], bool(mul.any()), int(begins.max())
    out, logs = np.zeros((days, len(rows))), np.zeros(len(rows))
    any_error = bool((error == 1).any())
    for t in range(int(begins.min()), days):
        s = cycle[t % season]
        base = level + phi * slope
        f = np.where(mul, base * s, base + s) if some_mul else base + s
        if any_error:
            f = np.where(error == 1, np.maximum(f, 1e-6), f)
        u = values[t][rows] - f
        if t < late:
            u = np.where(t >= begins, u, 0.0)
        out[t] = np.where(error == 1, u / f, u) if any_error else u
        if any_error:
            logs += np.where((error == 1) & (t >= begins), np.log(np.maximum(np.abs(f), 1e-12)), 0.0)
        by_level = u / np.where(mul, np.maximum(s, 1e-6), 1.0) if some_mul else u
        new_level, new_slope = base + alpha * by_level, phi * slope + beta * by_level
        cycle[t % season] = s + gamma * (u / np.where(mul, np.maximum(np.abs(base), 1e-6), 1.0) if some_mul else u)
        if t < late:
            new_level, new_slope = np.where(t >= begins, new_level, level), np.where(t >= begins, new_slope, slope)
        level, slope = new_level, new_slope
    out *= np.where(error == 1, np.exp(logs / np.maximum(days - begins, 1)), 1.0)
    return out.T, (level, slope, cycle, phi, mul)


def ets_forecasts(histories: list[np.ndarray], horizon: int = HORIZON, season: int = SEASON) -> tuple[np.ndarray, list[tuple | None]]:
    """((series, horizon) forecasts, chosen (error, trend, season, weights)) by least corrected AIC over all families.

    None and nulls where no family can be fitted: under three seasons of days, or values that are not finite.
    """
    out, chosen = np.full((len(histories), horizon), np.nan), [None] * len(histories)
    usable = [k for k, y in enumerate(histories) if len(y) >= 3 * season and np.isfinite(y).all()]
    for group in batches([histories[k] for k in usable], len(FAMILIES) * len(_STARTS) * 5):
        own = [usable[g] for g in group]
        y, lengths = aligned([histories[k] for k in own])
        first = y.shape[1] - lengths
        starts = [ets_start(row, a, season) for row, a in zip(y, first.tolist(), strict=True)]
        start = tuple(np.array([s[k] for s in starts]) for k in range(4))
        tried = [(k, f, a) for k in range(len(own)) for f in FAMILIES if f[0] == "A" or histories[own[k]].min() > 0 for a in _STARTS]
        row = np.array([t[0] for t in tried])
        kind = np.array([("AM".index(e), ("N", "A", "Ad").index(t), "NAM".index(s)) for _, (e, t, s), _ in tried])
        x = np.column_stack([[np.log(a / (1 - a)) for *_, a in tried], *[np.full(len(tried), v) for v in (-2.0, -2.0, 2.0)]])
        free = np.column_stack([np.ones(len(tried), bool), kind[:, 1] > 0, kind[:, 2] > 0, kind[:, 1] == 2])
        best, cost = gauss_newton(lambda p, r: ets_filter(y, first, row[r], kind[r], start, p, season)[0], x, free)  # noqa: B023
        k = free.sum(axis=1) + 2 + (kind[:, 1] > 0) + (season - 1) * (kind[:, 2] > 0)
        score = np.where(np.isfinite(cost), aicc(cost, lengths[row], k), np.inf)
        pick = np.array([np.flatnonzero(row == j)[np.argmin(score[row == j])] for j in range(len(own))])
        _, (level, slope, cycle, phi, mul) = ets_filter(y, first, row[pick], kind[pick], start, best[pick], season)
        growth = np.cumsum(phi[:, None] ** np.arange(1, horizon + 1), axis=1) * slope[:, None]
        ahead = cycle[(y.shape[1] + np.arange(horizon)) % season].T
        fore = level[:, None] + growth
        fore = np.where(mul[:, None], fore * ahead, fore + ahead)
        weights = ets_weights(best[pick], kind[pick, 1], kind[pick, 2])
        for j, number in enumerate(own):
            if np.isfinite(fore[j]).all() and np.isfinite(score[pick[j]]):
                out[number] = np.maximum(fore[j], 0.0)
                chosen[number] = (*tried[pick[j]][1], tuple(float(w[j]) for w in weights))
    return out, chosen


# ---- seasonal ARIMA

#: Greatest orders p, q, P, Q.
MOST = (5, 5, 2, 2)
KPSS_LIMIT, SEASON_LIMIT = 0.463, 0.64


def season_strength(y: np.ndarray, season: int = SEASON) -> float:
    """How much of the variance about a moving mean the days of the season explain, from 0 to 1."""
    if len(y) < 2 * season + 1:
        return 0.0
    half = season // 2
    rest = y[half : len(y) - (season - 1 - half)] - np.convolve(y, np.full(season, 1 / season), "valid")
    day = np.arange(len(rest)) % season
    seasonal = (np.bincount(day, rest, season) / np.bincount(day, minlength=season))[day]
    var = rest.var()
    return float(max(0.0, 1.0 - (rest - seasonal).var() / var)) if var > 1e-12 else 0.0


def kpss(y: np.ndarray) -> float:
    """The KPSS statistic of a constant level, with a Bartlett window: large for a unit root."""
    n, e = len(y), y - y.mean()
    lags = int(3 * np.sqrt(n) / 13)
    spread = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    return float((np.cumsum(e) ** 2).sum() / (n * n * spread)) if spread > 1e-12 else 0.0


def differences(y: np.ndarray, season: int = SEASON) -> tuple[int, int]:
    """(d, D): one seasonal difference where the season is strong, then differences until the level looks stationary."""
    seasonal = int(season_strength(y, season) > SEASON_LIMIT)
    w = y[season:] - y[:-season] if seasonal else y
    d = 0
    while d < 2 - seasonal and len(w) > 3 * season and kpss(w) > KPSS_LIMIT:
        w, d = np.diff(w), d + 1
    return d, seasonal


def _partial(r: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from partial autocorrelations (points, order)."""
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        before = out[:, :k].copy()
        out[:, k] = r[:, k]
        out[:, :k] = before - r[:, k : k + 1] * before[:, ::-1]
    return out


def polynomials(x: np.ndarray, season: int = SEASON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ar, ma, constant): coefficients by lag, (points, lags) each, of w_t = c + sum ar (w_(t-k) - c) + e_t + sum ma e_(t-k).

    x: (points, p + q + P + Q + 1) search parameters; hyperbolic tangents of them are partial autocorrelations, so every
    point is stationary and invertible; orders beyond a model's have parameter 0.
    """
    p, q, sp, sq = MOST
    r = np.tanh(x[:, :-1])
    cuts = np.cumsum([p, q, sp])
    ar, ma, sar, sma = (_partial(part) for part in np.split(r, cuts, axis=1))
    def product(one, many):
        lags = one.shape[1] + season * many.shape[1]
        out = np.zeros((len(x), lags + 1))
        whole = np.concatenate([np.ones((len(x), 1)), -one], axis=1)
        for k in range(many.shape[1] + 1):
            out[:, k * season : k * season + whole.shape[1]] += whole * (1.0 if k == 0 else -many[:, k - 1 : k])
        return out[:, 1:]
    return -product(ar, sar), product(ma, sma), x[:, -1]


def arma_errors(w: np.ndarray, first: np.ndarray, rows: np.ndarray, x: np.ndarray, season: int = SEASON) -> np.ndarray:
    """(points, days) one-step errors, given nothing happened before a series' first day."""
    ar, ma, c = polynomials(x, season)
    lags, days = ar.shape[1], w.shape[1]
    live = np.arange(days) >= first[:, None]
    filtered = np.concatenate([np.ones((len(rows), 1)), -ar], axis=1)
    a = np.empty((len(rows), days))
    order = np.argsort(rows, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(rows[order])) + 1):  # a series' points at once
        s = rows[own[0]]
        back = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(lags), w[s] * live[s]]), lags + 1)[:, ::-1]
        ones = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(lags), live[s].astype(float)]), lags + 1)[:, ::-1]
        a[own] = filtered[own] @ back.T - c[own, None] * (filtered[own] @ ones.T if live[s, 0] == 0 or days <= 4 * lags else _settled(filtered[own], days))
    a = np.ascontiguousarray((a * live[rows]).T)
    used = np.flatnonzero(np.abs(ma).max(axis=0) > 0)
    if not len(used):
        return a.T
    e = np.zeros((days + lags, len(rows)))
    theta, masked = np.ascontiguousarray(ma[:, used].T), live[rows].T
    steps = used + 1
    whole = bool(live.all())
    for t in range(days):
        new = a[t] - np.einsum("kn,kn->n", theta, e[lags + t - steps])
        e[lags + t] = new if whole else new * masked[t]
    return e[lags:].T


def _settled(filtered: np.ndarray, days: int) -> np.ndarray:
    """What a constant of 1 from day 0 on becomes."""
    return np.cumsum(filtered, axis=1)[:, np.minimum(np.arange(days), filtered.shape[1] - 1)]


def likelihood(w: np.ndarray, first: np.ndarray, rows: np.ndarray, x: np.ndarray, season: int = SEASON) -> tuple[np.ndarray, np.ndarray]:
    """(sum of squared standardised errors, sum of log variances) by the exact state-space filter of all points at once.

    The variance of the state converges; from then on the plain recursion gives the same errors. Log likelihood is
    -n/2 log(2 pi squares / n) - logs/2 - n/2 at the best variance.
    """
    ar, ma, c = polynomials(x, season)
    lags = ar.shape[1]
    m, n = lags + 1, len(rows)
    shift = np.zeros((n, m, m))
    shift[:, :-1, 1:] = np.eye(m - 1)
    shift[:, :lags, 0] += ar
    load = np.concatenate([np.ones((n, 1)), ma], axis=1)
    noise = load[:, :, None] * load[:, None, :]
    var, power = noise.copy(), shift.copy()
    for _ in range(16):  # the sum of powers, doubled each time
        var = var + power @ var @ power.transpose(0, 2, 1)
        power = power @ power
    begins, days = first[rows], w.shape[1]
    state, squares, logs = np.zeros((n, m)), np.zeros(n), np.zeros(n)
    open_ = np.ones(n, bool)  # the variance still changes
    for t in range(int(begins.min()), days):
        live = t >= begins
        f = var[:, 0, 0]
        e = np.where(live, w[rows, t] - c - state[:, 0], 0.0)
        squares += e * e / f
        logs += np.where(live, np.log(np.where(f > 0, f, np.nan)), 0.0)
        gain = var[:, :, 0] / f[:, None]
        moved = state + gain * e[:, None]
        state = np.where(live[:, None], ar_step(moved, ar), state)
        go = np.flatnonzero(open_ & live)
        if len(go):
            new = noise[go]  # what is seen is known: only the rest of the state keeps its variance, shifted
            new[:, :-1, :-1] += var[go][:, 1:, 1:] - gain[go][:, 1:, None] * var[go][:, 0, None, 1:]
            if t % 4 == 0:
                open_[go[np.abs(new - var[go]).max(axis=(1, 2)) < 1e-10]] = False
            var[go] = new
    return squares, logs


def ar_step(state: np.ndarray, ar: np.ndarray) -> np.ndarray:
    """The next state of the companion form: shifted, plus the coefficients times the first."""
    out = np.zeros_like(state)
    out[:, :-1] = state[:, 1:]
    out[:, : ar.shape[1]] += ar * state[:, :1]
    return out


def _around(order: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Orders one step away: one order up or down, p and q or P and Q together, the constant in or out."""
    moves = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1)]
    out = [tuple(o + s * v for o, v in zip(order[:4], move, strict=True)) + order[4:] for move in moves for s in (1, -1)]
    return [o for o in out + [order[:4] + (1 - order[4],)] if all(0 <= v <= m for v, m in zip(o[:4], MOST, strict=True))]


def arma_search(w: np.ndarray, lengths: np.ndarray, constant: np.ndarray, season: int = SEASON) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(order, parameters, corrected AIC) of each row of w: a stepwise search over p, q, P, Q and a constant.

    It starts from four models and goes to the best neighbour of each series until none is better; all series' candidates
    of a round are fitted together. A candidate's parameters start from those of the model it is a neighbour of.
    """
    first, places = w.shape[1] - lengths, np.cumsum([0, *MOST])
    tried: list[dict[tuple, float]] = [{} for _ in lengths]
    best = [((0, 0, 0, 0, 0), np.zeros(places[-1] + 1), np.inf)] * len(lengths)
    ask = [(k, o + (int(constant[k]),), np.zeros(places[-1] + 1)) for k in range(len(lengths)) for o in ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))]
    while ask:
        results = []
        size = max(1, CELLS // (w.shape[1] * 8))
        for lo in range(0, len(ask), size):
            part = ask[lo : lo + size]
            row = np.array([k for k, *_ in part])
            free = np.zeros((len(part), places[-1] + 1), bool)
            for j, (_, o, _) in enumerate(part):
                for a, v in zip(places, o[:4], strict=False):
                    free[j, a : a + v] = True
                free[j, -1] = bool(o[4])
            scale = w[row].std(axis=1) + 1e-9
            x = np.where(free, np.array([s for *_, s in part]), 0.0) + np.where(free, 0.05, 0.0) * (np.array([s for *_, s in part]) == 0)
            x[:, -1] = np.where(free[:, -1], w[row].sum(axis=1) / lengths[row], 0.0)
            unit = np.ones_like(x)
            unit[:, -1] = scale
            best_x, _ = gauss_newton(lambda p, r: arma_errors(w, first, row[r], p * unit[r], season), x / unit, free, 10)  # noqa: B023
            found = best_x * unit
            squares, logs = likelihood(w, first, row, found, season)
            n = lengths[row]
            score = aicc(squares, n, free.sum(axis=1) + 1) + logs
            results += [(k, o, found[j], float(s) if np.isfinite(s) else np.inf) for j, ((k, o, _), s) in enumerate(zip(part, score, strict=True))]
        better = set()
        for k, o, x, s in results:
            tried[k][o] = s
            if s < best[k][2] - 1e-6:
                best[k] = (o, x, s)
                better.add(k)
        ask = [(k, o, best[k][1]) for k in sorted(better) for o in _around(best[k][0]) if o not in tried[k] and (o[4] == 0 or constant[k])]
    return [b[0] for b in best], np.array([b[1] for b in best]), np.array([b[2] for b in best])


def sarima_forecasts(histories: list[np.ndarray], horizon: int = HORIZON, season: int = SEASON) -> tuple[np.ndarray, list[tuple | None]]:
    """((series, horizon) forecasts, chosen (p, d, q, P, D, Q, constant)); None and nulls under four seasons or not finite."""
    out, chosen = np.full((len(histories), horizon), np.nan), [None] * len(histories)
    usable = [k for k, y in enumerate(histories) if len(y) >= 4 * season and np.isfinite(y).all()]
    for group in batches([histories[k] for k in usable], 32):
        own = [usable[g] for g in group]
        taken = [differences(histories[k], season) for k in own]
        parts = []
        for k, (d, seasonal) in zip(own, taken, strict=True):
            w = histories[k]
            w = w[season:] - w[:-season] if seasonal else w
            parts.append(np.diff(w, d))
        w, lengths = aligned(parts)
        orders, x, _ = arma_search(w, lengths, np.array([d + s <= 1 for d, s in taken]), season)
        first = w.shape[1] - lengths
        ar, ma, c = polynomials(x, season)
        e = arma_errors(w, first, np.arange(len(own)), x, season)
        lags = ar.shape[1]
        line = np.concatenate([np.zeros((len(own), lags)), (w - c[:, None]) * (np.arange(w.shape[1]) >= first[:, None])], axis=1)[:, -lags:]
        errors = np.concatenate([np.zeros((len(own), lags)), e], axis=1)[:, -lags:]
        for _ in range(horizon):
            new = (ar * line[:, : -lags - 1 : -1]).sum(axis=1) + (ma * errors[:, : -lags - 1 : -1]).sum(axis=1)
            line, errors = np.column_stack([line, new]), np.column_stack([errors, np.zeros(len(own))])
        fore = line[:, lags:] + c[:, None]
        for j, (k, (d, seasonal)) in enumerate(zip(own, taken, strict=True)):
            ahead, before = fore[j], [histories[k][season:] - histories[k][:-season] if seasonal else histories[k]]
            for _ in range(d):
                before.append(np.diff(before[-1]))
            for level in reversed(before[:-1]):
                ahead = level[-1] + np.cumsum(ahead)
            if seasonal:
                whole = list(histories[k][-season:])
                for v in ahead:
                    whole.append(whole[-season] + v)
                ahead = np.array(whole[season:])
            if np.isfinite(ahead).all():
                p, q, sp, sq, const = orders[j]
                out[k], chosen[k] = np.maximum(ahead, 0.0), (p, d, q, sp, seasonal, sq, const)
    return out, chosen
