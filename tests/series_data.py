"""Hand-made series and a slow, plain computation of the indicators."""

from __future__ import annotations

import datetime as dt
import math
import random


def bars(symbol, closes, volumes=None, spread=1.0, interval="1d", seed=1, gaps=False):
    rnd = random.Random(seed)
    day, rows = dt.datetime(2020, 1, 1), []
    for i, c in enumerate(closes):
        o = c if spread == 0 else c + rnd.uniform(-spread, spread) / 2
        hi = max(o, c) + (rnd.uniform(0, spread) if spread else 0)
        lo = min(o, c) - (rnd.uniform(0, spread) if spread else 0)
        v = volumes[i] if volumes else float(rnd.randint(100, 900))
        rows.append((symbol, interval, day, float(o), float(hi), float(lo), float(c), float(v)))
        day += dt.timedelta(days=rnd.choice([1, 1, 1, 3, 40]) if gaps else 1)
    return rows


def walk(n, seed, start=50.0):
    rnd, x, out = random.Random(seed), start, []
    for _ in range(n):
        x = max(1.0, x + rnd.gauss(0, 1))
        out.append(round(x, 2))
    return out


def catalogue():
    rows = []
    for n in (1, 2, 9, 10, 19, 20, 29, 30, 60, 137):
        rows += bars(f"n{n:03d}", walk(n, n), seed=n)
    rows += bars("long", walk(700, 5), seed=5, gaps=True)
    rows += bars("flat", [10.1] * 300, [7.0] * 300, spread=0)
    rows += bars("halt", walk(90, 6) + [44.4] * 400, seed=6, spread=0)
    rows += bars("rise", [float(i) for i in range(1, 101)], spread=0.2)
    rows += bars("idle", walk(80, 7), [0.0] * 80)
    rows += bars("long", walk(160, 8), interval="1wk", seed=8)
    return rows


def window(values, i, n):
    return [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]


def mean(values, i, n, k):
    w = window(values, i, n)
    if len(w) < k:
        return None
    return w[0] if len(set(w)) == 1 else math.fsum(w) / len(w)


def total(values, i, n, k):
    w = window(values, i, n)
    return math.fsum(w) if len(w) >= k else None


def div(a, b):
    return None if a is None or b is None or b == 0 else a / b


def ewm(values, alpha):
    out, y = [], None
    for v in values:
        if v is not None:
            y = v if y is None else (y if y == v else (1 - alpha) * y + alpha * v)
        out.append(y)
    return out


def strength(gain, loss):
    r = div(gain, loss)
    return None if r is None else min(100.0, max(0.0, 100 - 100 / (1 + r)))


def compute(series):
    """List of dicts, one per bar, for one series in time order."""
    o, h, l, c, v = ([r[k] for r in series] for k in range(3, 8))
    n = len(series)
    out = [{"ts": r[2]} for r in series]
    prev = [None, *c[:-1]]
    delta = [None if p is None else x - p for x, p in zip(c, prev)]
    up = ewm([None if d is None else max(d, 0.0) for d in delta], 1 / 14)
    down = ewm([None if d is None else max(-d, 0.0) for d in delta], 1 / 14)
    fast, slow = ewm(c, 2 / 13), ewm(c, 2 / 27)
    macd = [a - b for a, b in zip(fast, slow)]
    signal = ewm(macd, 0.2)
    obv, run = [], 0.0
    for d, vol in zip(delta, v):
        run += 0.0 if not d else math.copysign(vol, d)
        obv.append(run)
    tr, pdm, mdm, flow, inn, outf = [], [], [], [], [], []
    for i in range(n):
        first = i == 0
        tr.append(max([h[i] - l[i]] + ([] if first else [abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])])))
        a, b = (0.0, 0.0) if first else (h[i] - h[i - 1], l[i - 1] - l[i])
        pdm.append(a if a > b and a > 0 else 0.0)
        mdm.append(b if b > a and b > 0 else 0.0)
        m = div((c[i] - l[i]) - (h[i] - c[i]), h[i] - l[i])
        flow.append(None if m is None else m * v[i])
        tp = (h[i] + l[i] + c[i]) / 3
        was = tp if first else (h[i - 1] + l[i - 1] + c[i - 1]) / 3
        inn.append(tp * v[i] if tp > was else 0.0)
        outf.append(tp * v[i] if tp < was else 0.0)
    ratio, dx = [], []
    for i in range(n):
        r = out[i]
        for w in (5, 10, 20, 60, 120):
            r[f"ma{w}"] = mean(c, i, w, max(2, w // 2))
        for w in (5, 10, 20):
            r[f"vol_ma{w}"] = mean(v, i, w, max(2, w // 2))
        r["vol_ratio"] = div(v[i], r["vol_ma20"])
        ratio.append(r["vol_ratio"])
        w = window(ratio, i, 60)
        high, low = 1.5, 0.8
        if len(w) >= 20:
            m = math.fsum(w) / len(w)
            s = math.sqrt(math.fsum((x - m) ** 2 for x in w) / (len(w) - 1))
            high, low = m + s, m - s
        r["vol_ratio_high"], r["vol_ratio_low"] = high, max(low, 0.3)
        r["obv"], r["obv_ma20"] = obv[i], mean(obv, i, 20, 5)
        r["rsi"] = strength(up[i], down[i]) if i >= 14 else None
        r["bias"] = None if r["ma20"] is None else (c[i] - r["ma20"]) / r["ma20"] * 100
        r["atr"] = mean(tr, i, 14, 5)
        trs = total(tr, i, 14, 5)
        r["plus_di"] = div(100 * total(pdm, i, 14, 1), trs)
        r["minus_di"] = div(100 * total(mdm, i, 14, 1), trs)
        d = None
        if r["plus_di"] is not None:
            d = div(abs(r["plus_di"] - r["minus_di"]), r["plus_di"] + r["minus_di"])
        dx.append(None if d is None else d * 100)
        r["adx"] = mean(dx, i, 14, 5)
        r["cmf"] = div(total(flow, i, 20, 5), total(v, i, 20, 5))
        r["mfi"] = strength(total(inn, i, 14, 5), total(outf, i, 14, 5)) if i >= 4 else None
        r["macd"], r["macd_signal"], r["macd_hist"] = macd[i], signal[i], macd[i] - signal[i]
        if n < 20:
            for k in list(r):
                if k != "ts":
                    r[k] = None
    return out
