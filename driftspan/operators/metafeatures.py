"""Metafeatures of a neighbourhood: named functions of its feature matrix and target."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _central(x: np.ndarray, k: int) -> np.ndarray:
    return ((x - x.mean(axis=0)) ** k).mean(axis=0)


def _moment_ratio(x: np.ndarray, k: int) -> np.ndarray:
    spread = _central(x, 2) ** (k / 2)
    return np.divide(_central(x, k), spread, out=np.zeros(x.shape[1]), where=spread > 0)


def _sample(f: Callable) -> Callable:
    """Zeros for a single row, where a sample statistic is undefined."""
    return lambda x, y: f(x) if len(x) > 1 else np.zeros(np.shape(f(np.vstack([x, x]))))


def _upper(m: np.ndarray) -> np.ndarray:
    m = np.atleast_2d(m)
    return np.abs(m[np.triu_indices(len(m), 1)])


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def _discretised(c: np.ndarray) -> np.ndarray:
    """Numbers of about equally full bins, as many as the cube root of the rows; a column of fewer values keeps them."""
    values, number = np.unique(c, return_inverse=True)
    bins = max(2, round(len(c) ** (1 / 3)))
    if len(values) <= bins:
        return number
    return np.searchsorted(np.quantile(c, np.arange(1, bins) / bins), c, side="right")


def _column_entropy(x: np.ndarray) -> np.ndarray:
    return np.array([_entropy(np.bincount(_discretised(c))) for c in x.T])


def _mutual(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    label = np.unique(y, return_inverse=True)[1]
    out = []
    for c in x.T:
        number = _discretised(c)
        out.append(_entropy(np.bincount(number)) + _entropy(np.bincount(label)) - _entropy(np.bincount(number * (label.max() + 1) + label)))
    return np.array(out)


def _correlation(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return _upper(np.corrcoef(x, rowvar=False))


#: name: (needs a target, function of matrix and target)
REGISTRY: dict[str, tuple[bool, Callable]] = {
    "mean": (False, lambda x, y: x.mean(axis=0)),
    "var": (False, _sample(lambda x: x.var(axis=0, ddof=1))),
    "sd": (False, _sample(lambda x: x.std(axis=0, ddof=1))),
    "min": (False, lambda x, y: x.min(axis=0)),
    "max": (False, lambda x, y: x.max(axis=0)),
    "range": (False, lambda x, y: np.ptp(x, axis=0)),
    "median": (False, lambda x, y: np.median(x, axis=0)),
    "iq_range": (False, lambda x, y: np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)),
    "mad": (False, lambda x, y: 1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0)),
    "skewness": (False, lambda x, y: _moment_ratio(x, 3)),
    "kurtosis": (False, lambda x, y: _moment_ratio(x, 4) - 3),
    "cov": (False, _sample(lambda x: _upper(np.cov(x, rowvar=False)))),
    "cor": (False, _sample(_correlation)),
    "eigenvalues": (False, _sample(lambda x: np.linalg.eigvalsh(np.atleast_2d(np.cov(x, rowvar=False)))[::-1])),
    "nr_inst": (False, lambda x, y: float(len(x))),
    "nr_attr": (False, lambda x, y: float(x.shape[1])),
    "nr_num": (False, lambda x, y: float(x.shape[1])),
    "nr_cat": (False, lambda x, y: 0.0),
    "inst_to_attr": (False, lambda x, y: len(x) / x.shape[1]),
    "nr_class": (True, lambda x, y: float(len(np.unique(y)))),
    "freq_class": (True, lambda x, y: np.unique(y, return_counts=True)[1] / len(y)),
    "class_ent": (True, lambda x, y: _entropy(np.unique(y, return_counts=True)[1])),
    "attr_ent": (False, lambda x, y: _column_entropy(x)),
    "mut_inf": (True, lambda x, y: _mutual(x, y)),
}

SUMMARIES: dict[str, Callable] = {"mean": np.mean, "sd": lambda v: np.std(v, ddof=1) if len(v) > 1 else 0.0, "min": np.min, "max": np.max, "median": np.median, "range": np.ptp}


def check(names: list[str], has_target: bool, summary: list[str] | None) -> None:
    for name in names:
        if name not in REGISTRY:
            raise ValueError(f"Unsupported metafeature '{name}'; supported: {', '.join(sorted(REGISTRY))}")
        if REGISTRY[name][0] and not has_target:
            raise ValueError(f"Metafeature '{name}' needs a target")
    for s in summary or []:
        if s not in SUMMARIES:
            raise ValueError(f"Unsupported summary '{s}'; supported: {', '.join(sorted(SUMMARIES))}")


def extract(names: list[str], x: np.ndarray, y: np.ndarray | None, summary: list[str] | None = None) -> np.ndarray:
    """The named values one after the other, each whole or summarised; undefined ones are 0."""
    parts = []
    for name in names:
        v = np.atleast_1d(np.asarray(REGISTRY[name][1](x, y), float)).ravel()
        parts.append(np.array([SUMMARIES[s](v) for s in summary]) if summary and len(v) else v)
    return np.nan_to_num(np.concatenate(parts), nan=0.0, posinf=0.0, neginf=0.0)


def fit_width(v: np.ndarray, width: int) -> np.ndarray:
    """Padded with zeros, or cut, to width."""
    out = np.zeros(width)
    out[: min(width, len(v))] = v[:width]
    return out
