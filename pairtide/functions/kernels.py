"""Array arithmetic for one tile of a window: all pairs of two small asset blocks.

Every correlation is written as an inner product of per-series feature vectors, so
a tile of pairs is a matrix product. Inputs have shape (windows, assets, rows).
"""

import numpy as np

TIE = 1e-12  # differences of correlations below this are rounding


def _unit(values, on_constant):
    """Centre and scale each series to length one; constant series get ``on_constant``."""
    centred = values - values.mean(axis=-1, keepdims=True)
    norm = np.sqrt((centred * centred).sum(axis=-1, keepdims=True))
    constant = (values.max(axis=-1, keepdims=True) == values.min(axis=-1, keepdims=True)) | (norm == 0)
    return np.where(constant, on_constant, centred / np.where(norm == 0, 1.0, norm))


def _average_ranks(values):
    """Ranks from 1 with ties sharing their mean rank."""
    flat = values.reshape(-1, values.shape[-1])
    order = np.argsort(flat, axis=1, kind="stable")
    ordered = np.take_along_axis(flat, order, axis=1)
    fresh = np.ones(ordered.shape, dtype=bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    tied = np.cumsum(fresh) - 1
    place = np.tile(np.arange(1.0, flat.shape[1] + 1), len(flat))
    mean = np.bincount(tied, weights=place) / np.bincount(tied)
    ranks = np.empty(flat.shape)
    np.put_along_axis(ranks, order, mean[tied].reshape(flat.shape), axis=1)
    return ranks.reshape(values.shape)


def _pair_signs(values):
    """Sign of every row pair, scaled so that the inner product is Kendall's tau-b."""
    a, b = np.triu_indices(values.shape[-1], k=1)
    signs = np.sign(values[..., a] - values[..., b])
    norm = np.sqrt((signs * signs).sum(axis=-1, keepdims=True))
    return np.where(norm == 0, np.nan, signs / np.where(norm == 0, 1.0, norm))


def _distance_vectors(values):
    """Double-centred distances, scaled so that the inner product is the squared distance correlation."""
    gaps = np.abs(values[..., :, None] - values[..., None, :])
    row = gaps.mean(axis=-1, keepdims=True)
    centred = gaps - row - np.swapaxes(row, -1, -2) + gaps.mean(axis=(-1, -2), keepdims=True)
    flat = centred.reshape(values.shape[:-1] + (-1,))
    norm = np.sqrt((flat * flat).sum(axis=-1, keepdims=True))
    constant = (values.max(axis=-1, keepdims=True) == values.min(axis=-1, keepdims=True)) | (norm == 0)
    return np.where(constant, 0.0, flat / np.where(norm == 0, 1.0, norm))


def _quantile_codes(values, quantiles):
    """Right-closed quantile bins with repeated edges merged; -1 for a constant series."""
    edges = np.moveaxis(np.quantile(values, np.linspace(0, 1, quantiles + 1), axis=-1), 0, -1)
    codes = np.zeros(values.shape, dtype=np.int8)
    for k in range(1, quantiles):
        fresh = edges[..., k, None] > edges[..., k - 1, None]
        codes += fresh & (edges[..., k, None] < values)
    return np.where(edges[..., :1] == edges[..., -1:], np.int8(-1), codes)


def _mutual_information(left, right, quantiles):
    rows = left.shape[-1]
    x, y = _quantile_codes(left, quantiles), _quantile_codes(right, quantiles)
    one_x = [(x == a).astype(float) for a in range(quantiles)]
    one_y = [np.swapaxes((y == b).astype(float), -1, -2) for b in range(quantiles)]
    total = np.zeros(left.shape[:2] + (right.shape[1],))
    for ox in one_x:
        px = ox.sum(axis=-1)[..., :, None] / rows
        for oy in one_y:
            py = oy.sum(axis=-2)[..., None, :] / rows
            p = ox @ oy / rows
            total += np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0) / np.where(px * py > 0, px * py, 1.0)), 0.0)
    bad = (x[..., 0] < 0)[..., :, None] | (y[..., 0] < 0)[..., None, :]
    return np.where(bad, np.nan, np.maximum(total, 0.0))


_EMBEDDINGS = {
    "pearson": lambda v: _unit(v, 0.0),
    "squared_pearson": lambda v: _unit(v * v, 0.0),
    "spearman": lambda v: _unit(_average_ranks(v), np.nan),
    "kendall": _pair_signs,
    "distance": _distance_vectors,
}


def _cross(correlation, quantiles, early, late):
    """Correlation of every ``early`` series with every ``late`` series."""
    if correlation == "mutual_information":
        return _mutual_information(early, late, quantiles)
    embed = _EMBEDDINGS[correlation]
    product = embed(early) @ np.swapaxes(embed(late), -1, -2)
    return np.sqrt(np.maximum(product, 0.0)) if correlation == "distance" else product


def _lagged(spec, left, right, lag):
    """(left leads right, right leads left) correlations at a positive lag."""
    rows = left.shape[-1]
    if lag >= rows:
        nothing = np.full(left.shape[:2] + (right.shape[1],), np.nan)
        return nothing, nothing
    ahead = _cross(spec.correlation, spec.quantiles, left[..., : rows - lag], right[..., lag:])
    behind = _cross(spec.correlation, spec.quantiles, right[..., : rows - lag], left[..., lag:])
    return ahead, np.swapaxes(behind, -1, -2)


def _scaled(values, scaling):
    if scaling == "mean-centering":
        return values
    std = values.std(axis=-1, ddof=1, keepdims=True)
    return values / np.where(std == 0, 1.0, std)


def _signed_area(spec, left, right):
    x, y = _scaled(left, spec.scaling), _scaled(right, spec.scaling)
    path_x, path_y = x[..., :-1] - x[..., :1], y[..., :-1] - y[..., :1]
    step_x, step_y = np.diff(x, axis=-1), np.diff(y, axis=-1)
    area = path_x @ np.swapaxes(step_y, -1, -2) - step_x @ np.swapaxes(path_y, -1, -2)
    return area / 2.0 if spec.signature_form == "levy" else area


def _lead(ahead, behind):
    """Sign of the difference; sides equal up to rounding tie, as rank measures often do."""
    gap = ahead - behind
    return np.where(np.abs(gap) <= TIE, 0.0, np.sign(gap))


def pair_values(spec, left, right):
    """Lead-lag value of every (left, right) pair; undefined values become 0."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if spec.method == "signature":
            value = _signed_area(spec, left, right)
        elif spec.method == "ccf_at_lag":
            ahead, behind = _lagged(spec, left, right, abs(spec.lag))
            value = (ahead - behind) * np.sign(spec.lag)
        else:
            value = lead_of_lags(spec, [_lagged(spec, left, right, lag) for lag in range(1, spec.max_lag + 1)])
    return np.nan_to_num(value, nan=0.0)


def lead_of_lags(spec, sides):
    """Value of the methods over several lags, from ``(ahead, behind)`` correlations at each."""
    ahead = np.abs(np.stack([s[0] for s in sides]))
    behind = np.abs(np.stack([s[1] for s in sides]))
    a, b = (ahead.sum(axis=0), behind.sum(axis=0)) if spec.method == "ccf_auc" else (ahead.max(axis=0), behind.max(axis=0))
    strength = _lead(a, b) * np.maximum(a, b)
    return strength / (a + b) if spec.method == "ccf_auc" else strength


def doubles_per_series(spec, rows):
    """Working numbers one series of one window needs, for sizing batches."""
    if spec.method != "signature":
        if spec.correlation == "distance":
            return 3 * rows * rows
        if spec.correlation == "kendall":
            return 2 * rows * rows
    return 8 * rows
