"""Small panels and brute-force versions of the definitions, in numpy and pandas."""

import numpy as np
import pandas as pd

from pairtide.operators.timeline import index_panel
from pairtide.session import stage


def wide_panel(rows=60, assets=5, seed=0, gaps=0.15, odd=True):
    rng = np.random.default_rng(seed)
    dates = pd.date_range("2024-01-01", periods=rows, freq="D")
    values = 100 + rng.normal(0, 1, (rows, assets)).cumsum(axis=0)
    frame = pd.DataFrame(values.round(4), index=dates, columns=[f"A{i:02d}" for i in range(assets)])
    if gaps:
        frame = frame.mask(rng.random(frame.shape) < gaps)
    if odd:
        frame.iloc[rows // 2, 0], frame.iloc[rows // 3, 1] = 0.0, -5.0
    return frame


def long_panel(spark, wide):
    long = wide.rename_axis("ts").reset_index().melt("ts", var_name="asset", value_name="price").dropna()
    return spark.createDataFrame(long).selectExpr("cast(ts as timestamp_ntz) ts", "asset", "price")


def indexed_panel(spark, wide):
    return stage(index_panel(long_panel(spark, wide)), "test_panel")


def window_returns(wide, start, end):
    with np.errstate(all="ignore"):
        logs = np.log(wide.iloc[start : end + 1].ffill())
    return logs.diff().replace([np.inf, -np.inf], np.nan).fillna(0.0)


def pearson(x, y):
    if x.max() == x.min() or y.max() == y.min():
        return 0.0
    return np.corrcoef(x, y)[0, 1]


def spearman(x, y):
    if x.max() == x.min() or y.max() == y.min():
        return np.nan
    return np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]


def kendall(x, y):
    total = ties_x = ties_y = 0.0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            total, ties_x, ties_y = total + a * b, ties_x + a * a, ties_y + b * b
    return np.nan if ties_x * ties_y == 0 else total / np.sqrt(ties_x * ties_y)


def distance(x, y):
    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    scale = np.sqrt((a * a).mean() * (b * b).mean())
    return 0.0 if scale == 0 else np.sqrt(max((a * b).mean(), 0) / scale)


def mutual(x, y, q=4):
    a = pd.qcut(x, q, labels=False, duplicates="drop")
    b = pd.qcut(y, q, labels=False, duplicates="drop")
    if np.isnan(a).all() or np.isnan(b).all():
        return np.nan
    table = pd.crosstab(a, b).to_numpy() / len(a)
    px, py = table.sum(1, keepdims=True), table.sum(0, keepdims=True)
    cell = table > 0
    return (table[cell] * np.log(table[cell] / (px * py)[cell])).sum()


CORRELATIONS = {
    "pearson": pearson,
    "squared_pearson": lambda x, y: pearson(x * x, y * y),
    "spearman": spearman,
    "kendall": kendall,
    "distance": distance,
    "mutual_information": mutual,
}


def chen_area(x, y):
    """Level-2 terms by joining segments one after another."""
    s1, s2, s12, s21 = 0.0, 0.0, 0.0, 0.0
    for dx, dy in zip(np.diff(x), np.diff(y)):
        s12 += s1 * dy + dx * dy / 2
        s21 += s2 * dx + dx * dy / 2
        s1, s2 = s1 + dx, s2 + dy
    return s12 - s21


def lead(a, b):
    return 0.0 if abs(a - b) <= 1e-12 else np.sign(a - b)


def pair_value(spec, x, y):
    def c(a, b, lag):
        if lag >= len(a):
            return np.nan
        return CORRELATIONS[spec.correlation](a[:-lag], b[lag:])

    if spec.method == "signature":
        if spec.scaling != "mean-centering":
            x, y = (v / (v.std(ddof=1) or 1.0) for v in (x, y))
        return chen_area(x, y) * (0.5 if spec.signature_form == "levy" else 1.0)
    if spec.method == "ccf_at_lag":
        value = c(x, y, spec.lag) - c(y, x, spec.lag)
    else:
        ahead = np.abs([c(x, y, k) for k in range(1, spec.max_lag + 1)])
        behind = np.abs([c(y, x, k) for k in range(1, spec.max_lag + 1)])
        if spec.method == "ccf_auc":
            a, b = ahead.sum(), behind.sum()
            value = 0.0 if a + b == 0 else lead(a, b) * max(a, b) / (a + b)
        else:
            a, b = ahead.max(), behind.max()
            value = lead(a, b) * max(a, b)
    return 0.0 if np.isnan(value) else value


def matrix(spec, returns):
    columns = sorted(returns.columns)
    out = pd.DataFrame(0.0, index=columns, columns=columns)
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            out.loc[a, b] = pair_value(spec, returns[a].to_numpy(), returns[b].to_numpy())
            out.loc[b, a] = -out.loc[a, b]
    return out


def edge_dict(rows):
    return {(r.start_pos, r.end_pos, r.asset_i, r.asset_j): r.value for r in rows}
