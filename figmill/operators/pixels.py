"""Measures of images held as arrays: width, height and grey or RGB values row by row, as NumPy kernels in Arrow batches.

Decoding image files is left to the reader; nothing here needs an image library.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from figmill.functions.udfs import vectorized

BLACK, WHITE = 90, 245


def _image(values, width: int) -> np.ndarray:
    a = np.asarray(values, float)
    return a.reshape(-1, int(width))


@vectorized("entropy double, edges double, content double, tones double, score double")
def complexity(grey: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Parts and score (0 to 100) of the visual complexity of grey images: entropy, edges, tones and content against the corner."""

    def one(values, w):
        if values is None or not len(values) or not w:
            return (None,) * 5
        a = _image(values, w)
        share = np.bincount(np.clip(a, 0, 255).astype(int).ravel(), minlength=256) / a.size
        entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum() / 8)
        inner = np.abs(8 * a[1:-1, 1:-1] - sum(a[1 + i : a.shape[0] - 1 + i, 1 + j : a.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)) if min(a.shape) > 2 else np.zeros(0)
        edges = float((inner > 27).sum() / a.size)
        content = float((np.abs(a - a[0, 0]) > 21).mean())
        tones = float(min((share > 0.0005).sum() / 64, 1))
        return entropy, edges, content, tones, 100 * (0.38 * entropy + 0.34 * min(edges / 0.22, 1) + 0.18 * tones + 0.10 * min(content / 0.55, 1))

    return pd.DataFrame([one(v, w) for v, w in zip(grey, width, strict=True)], columns=["entropy", "edges", "content", "tones", "score"])


@vectorized("double")
def structural_similarity(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
    """Mean structural similarity of two grey images in windows of seven by seven; null for images unlike in size or too small."""

    def windows(x: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(x, (7, 7)).reshape(-1, 49)

    def one(x, y, w):
        if x is None or y is None or len(x) != len(y) or not w or w < 7 or len(x) < 7 * w:
            return None
        p, q = windows(_image(x, w)), windows(_image(y, w))
        mp, mq = p.mean(1), q.mean(1)
        vp, vq = p.var(1, ddof=1), q.var(1, ddof=1)
        cov = ((p - mp[:, None]) * (q - mq[:, None])).sum(1) / 48
        c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
        return float((((2 * mp * mq + c1) * (2 * cov + c2)) / ((mp**2 + mq**2 + c1) * (vp + vq + c2))).mean())

    return pd.Series([one(x, y, w) for x, y, w in zip(a, b, width, strict=True)], dtype="float64")


def _grown(mask: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        m = np.pad(mask, 1)
        mask = np.logical_or.reduce([m[1 + i : m.shape[0] - 1 + i, 1 + j : m.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return mask


def _parts(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of the connected parts of a mask: runs of each row are joined with touching runs of the row above."""
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    boxes: list[list[int]] = []
    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        here = []
        for x0, x1 in zip(edges[::2], edges[1::2]):
            k = len(parent)
            parent.append(k)
            boxes.append([int(x0), y, int(x1), y + 1])
            for a0, a1, j in above:
                if a0 < x1 and x0 < a1:
                    parent[find(k)] = find(j)
            here.append((x0, x1, k))
        above = here
    joined: dict[int, list[int]] = {}
    for i, b in enumerate(boxes):
        o = joined.setdefault(find(i), list(b))
        o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3])]
    return sorted((tuple(b) for b in joined.values()), key=lambda b: (b[1], b[0]))


@vectorized("array<struct<x0:int,y0:int,x1:int,y1:int>>")
def connected_boxes(grey: pd.Series, width: pd.Series, steps: pd.Series) -> pd.Series:
    """Boxes of the parts of an image darker than WHITE after growing them by some steps; from the top, then the left."""

    def one(values, w, n):
        if values is None or not len(values) or not w:
            return []
        return [dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in _parts(_grown(_image(values, w) <= WHITE, int(n or 0)))]

    return pd.Series([one(v, w, n) for v, w, n in zip(grey, width, steps, strict=True)])


@vectorized("struct<x0:int,y0:int,x1:int,y1:int>")
def content_box(grey: pd.Series, width: pd.Series) -> pd.DataFrame:
    """The box of all that is darker than WHITE, with a margin; the whole image if nothing is."""

    def one(values, w):
        if values is None or not len(values) or not w:
            return (None,) * 4
        a = _image(values, w)
        ys, xs = np.where(a <= WHITE)
        h, w = a.shape
        if not len(xs):
            return 0, 0, w, h
        margin = max(4, int(min(w, h) * 0.006))
        return max(0, xs.min() - margin), max(0, ys.min() - margin), min(w, xs.max() + 1 + margin), min(h, ys.max() + 1 + margin)

    return pd.DataFrame([one(v, w) for v, w in zip(grey, width, strict=True)], columns=["x0", "y0", "x1", "y1"]).astype("Int32")


@vectorized("axes double, texture double")
def line_features(grey: pd.Series, width: pd.Series) -> pd.DataFrame:
    """axes: rows and columns with much black, an eighth each, 3 at most; texture: mean step between neighbours."""

    def one(values, w):
        if values is None or not len(values) or not w:
            return None, None
        a = _image(values, w)
        dark = a < BLACK
        lines = (dark.mean(1) > 0.16).sum() + (dark.mean(0) > 0.16).sum()
        steps = [np.abs(np.diff(a, axis=k)).mean() if a.shape[k] > 1 else 0.0 for k in (0, 1)]
        return float(min(3.0, lines / 8)), float(sum(steps) / 2)

    return pd.DataFrame([one(v, w) for v, w in zip(grey, width, strict=True)], columns=["axes", "texture"])


@vectorized("label string, score double")
def letter(crop: pd.Series, template_labels: pd.Series, templates: pd.Series) -> pd.DataFrame:
    """The template (bits of a square) most like a crop of the same size by overlap less half the squared error; null under 0.45."""

    def one(bits, labels, masks):
        if bits is None or labels is None or not len(labels):
            return None, None
        x, best = np.asarray(bits, bool), (None, 0.45)
        for name, mask in zip(labels, masks, strict=True):
            t = np.asarray(mask, bool)
            union = (x | t).sum()
            score = (x & t).sum() / union - 0.5 * (x != t).mean() if t.shape == x.shape and union else -1.0
            if score > best[1] or best[0] is None and score == best[1]:
                best = (name, float(score))
        return best if best[0] else (None, None)

    return pd.DataFrame([one(*row) for row in zip(crop, template_labels, templates, strict=True)], columns=["label", "score"])
