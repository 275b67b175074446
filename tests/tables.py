"""Seeded tables with planted structure."""

import numpy as np
import pandas as pd


def sales(n=1000):
    """sales = price x quantity x (1 - discount), rounded to cents."""
    rng = np.random.default_rng(1)
    price, qty, disc = np.round(rng.uniform(50, 5000, n), 2), rng.integers(1, 11, n), rng.choice([0, 0.05, 0.1, 0.2], n)
    return pd.DataFrame(
        {
            "order_id": np.arange(1, n + 1),
            "order_date": pd.date_range("2023-01-01", periods=365).to_numpy()[rng.integers(0, 365, n)],
            "region": rng.choice(["North", "South", "East", "West"], n),
            "category": rng.choice(["Tools", "Toys", "Books", "Food"], n),
            "unit_price": price,
            "quantity": qty,
            "discount": disc,
            "sales": np.round(price * qty * (1 - disc), 2),
        }
    )


def noise(n=600):
    rng = np.random.default_rng(2)
    out = {"ts": pd.date_range("2022-01-01", periods=n), "segment": rng.choice(list("abcde"), n), "flag": rng.random(n) < 0.5, "region": rng.choice(list("wxyz"), n)}
    return pd.DataFrame(out | {f"n{i}": rng.normal(size=n) for i in range(6)})


def hourly(days=90):
    """Counts that add up, two copies of a temperature, and a daily cycle with two peaks."""
    rng = np.random.default_rng(3)
    n = 24 * days
    hr = np.arange(n) % 24
    temp = 0.5 + 0.3 * np.sin(2 * np.pi * (hr - 9) / 24) + rng.normal(0, 0.08, n)
    level = 20 + 80 * np.exp(-((hr - 8) ** 2) / 4) + 120 * np.exp(-((hr - 18) ** 2) / 6)
    casual, registered = rng.poisson(level * 0.2 * (0.5 + temp)), rng.poisson(level)
    return pd.DataFrame(
        {
            "instant": np.arange(1, n + 1),
            "dteday": pd.date_range("2011-01-01", periods=n, freq="h"),
            "weathersit": rng.integers(1, 4, n),
            "hr": hr,
            "temp": temp,
            "atemp": 0.9 * temp + rng.normal(0, 0.012, n),
            "hum": rng.uniform(0.2, 1, n),
            "casual": casual,
            "registered": registered,
            "cnt": casual + registered,
        }
    )


def groups(n=900):
    """Means, spreads and slopes that differ by group; a factor that interacts; a step in time."""
    rng = np.random.default_rng(4)
    g = np.resize(list("abc"), n)
    state = np.resize(["before", "before", "before", "after", "after", "after"], n)
    x = rng.normal(size=n)
    shift = pd.Series(g).map({"a": 0.0, "b": 4.0, "c": 9.0}).to_numpy()
    sd = pd.Series(g).map({"a": 1.0, "b": 3.0, "c": 8.0}).to_numpy()
    sign = pd.Series(g).map({"a": 1.0, "b": 0.0, "c": -1.0}).to_numpy()
    ts = pd.date_range("2024-01-01", periods=n, freq="2h")
    mixed = np.where((g == "a") == (state == "before"), 5.0, -5.0) + rng.normal(size=n)
    return pd.DataFrame({"ts": ts, "team": g, "state": state, "x": x, "shifted": shift + rng.normal(size=n), "spread": rng.normal(size=n) * sd, "slope": sign * x + 0.3 * rng.normal(size=n), "curved": x**2 + 0.2 * rng.normal(size=n), "mixed": mixed, "stepped": np.where(np.arange(n) < n // 2, 0.0, 3.0) + rng.normal(size=n)})


def outliers(n=1000):
    rng = np.random.default_rng(5)
    temp = rng.normal(20, 4, n)
    temp[rng.choice(n, 15, replace=False)] = -999
    value = rng.normal(100, 10, n)
    value[:12] *= rng.uniform(4, 9, 12)
    zero = np.where(rng.random(n) < 0.8, 0.0, rng.exponential(5, n))
    return pd.DataFrame({"team": np.resize(list("ab"), n), "temperature": temp, "value": value, "mostly_zero": zero, "clean": rng.normal(size=n)})


def dirty(n=500):
    rng = np.random.default_rng(6)
    price = [f"${v:,.2f}" if i % 10 else "N/A" for i, v in enumerate(rng.uniform(500, 9000, n))]
    return pd.DataFrame(
        {
            "id": [f"{i:05d}" for i in range(n)],
            "price": price,
            "quantity": ["many" if i % 3 == 0 else str(i % 40) for i in range(n)],
            "pct": [f"{v:.1f}%" for v in rng.uniform(0, 100, n)],
            "order_date": pd.date_range("2020-01-01", periods=n).strftime("%d/%m/%Y"),
            "code": [f"{i % 40:03d}" for i in range(n)],
            "level": np.resize(["low", "medium", "high"], n),
            "month": np.resize(["Jan", "Feb", "Mar", "Apr"], n),
            "note": [f"a free text of some length, number {i} of them" for i in range(n)],
            "ok": np.resize([True, False], n),
        }
    )
