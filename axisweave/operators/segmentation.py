"""Change points of binned coverage: a Bayesian segmentation with negative-binomial segments and length prior.

A segment's evidence is the beta-negative-binomial marginal of its bins; its level is its mean. The number of reads in a bin has shape
r, a segment's length minus one is negative-binomial (segment_r, segment_p). Every table is one row at a time from prefix sums, so memory
is linear in the bins.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Prior:
    r: int = 10
    alpha: float = 1.0
    beta: float = 1.0
    segment_r: int = 10
    segment_p: float = 0.95
    min_fold: float = 0.5


class Evidence:
    """Log evidence and mean of the segments that begin at one bin, for all ends."""

    def __init__(self, y: np.ndarray, prior: Prior):
        self.y, self.p, self.n = np.asarray(y, float), prior, len(y)
        self.total = np.concatenate([[0.0], np.cumsum(self.y)])
        lg = np.vectorize(lgamma, otypes=[float])
        constant = lg(self.y + prior.r) - lg(self.y + 1) - lgamma(prior.r)
        self.constant = np.concatenate([[0.0], np.cumsum(constant)])
        top = int(self.total[-1] + self.n * prior.r + prior.alpha + prior.beta) + 2
        self.table = np.concatenate([[0.0, 0.0], np.cumsum(np.log(np.arange(1, top)))]) if prior.alpha == int(prior.alpha) and prior.beta == int(prior.beta) else None
        self.lg = (lambda x: self.table[np.asarray(x).astype(np.int64)]) if self.table is not None else lg

    def row(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(log evidence, mean) of segments [s, t] for t = s .. n-1."""
        size = np.arange(1, self.n - s + 1)
        total = self.total[s + 1 :] - self.total[s]
        a, b = total + self.p.alpha, size * self.p.r + self.p.beta
        prior = lgamma(self.p.alpha) + lgamma(self.p.beta) - lgamma(self.p.alpha + self.p.beta)
        return self.lg(a) + self.lg(b) - self.lg(a + b) - prior + self.constant[s + 1 :] - self.constant[s], total / size


def length_prior(n: int, r: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of length k + 1, log probability of a length over k + 1) for k = 0 .. n-1; survival is summed from the far end."""
    k = np.arange(max(4 * n, n + 200))
    lg = np.vectorize(lgamma, otypes=[float])
    log_g = lg(k + r) - lg(k + 1.0) - lgamma(r) + r * np.log1p(-p) + k * np.log(p)
    tail = np.logaddexp.accumulate(log_g[::-1])[::-1]
    ratio = log_g[-1] - log_g[-2]
    beyond = log_g[-1] + ratio - np.log1p(-np.exp(min(ratio, -1e-12)))
    return log_g[:n], np.logaddexp(tail[1 : n + 1], beyond)


def segment(ys: list[np.ndarray], prior: Prior, mode: str = "decreasing") -> tuple[list[int], list[list[float]]]:
    """The best cuts (the last bin of each segment but the last) of one or more samples of equal length, and each segment's means.

    Backward dynamic program over where segments begin; a cut is allowed only if, against the best segmentation that follows,
    mode decreasing: the level falls below all levels before (increasing: rises) and by the fold in the same sample, for one sample at
    least, where all upstream levels are positive if there are several samples; mode fold: the smaller level is at most min_fold of the larger.
    Of equal scores the earliest cut wins, and a cut wins over none.
    """
    n, k = len(ys[0]), len(ys)
    ev = [Evidence(y, prior) for y in ys]
    log_g, over = length_prior(n, prior.segment_r, prior.segment_p)
    best, nxt = np.full(n + 1, -np.inf), np.full(n + 1, -1)
    level = np.zeros((k, n + 1))  # of the first segment of the best suffix
    high, low = np.full((k, n + 1), -np.inf), np.full((k, n + 1), np.inf)
    for s in range(n - 1, -1, -1):
        rows = [e.row(s) for e in ev]
        score, mean = sum(x[0] for x in rows), np.stack([x[1] for x in rows])
        size = n - s
        whole = score[-1] + (over[size - 2] if size > 1 else 0.0)
        top, cut = whole, -1
        if size > 1:
            m, after = mean[:, :-1], slice(s + 1, n)
            then = level[:, after]
            with np.errstate(divide="ignore", invalid="ignore"):
                if mode == "fold":
                    ok = ~(np.minimum(m, then) / np.maximum(m, then) > prior.min_fold)
                elif mode == "increasing":
                    ok = (low[:, after] > m) & ~(m / then > prior.min_fold)
                else:
                    ok = (high[:, after] < m) & ~(then / m > prior.min_fold)
            feasible = ok.any(axis=0)
            if k > 1 and mode != "fold":
                feasible &= ((m if mode == "decreasing" else then) > 0).all(axis=0)
            prior_of = log_g[: size - 1] if s else np.where(np.arange(size - 1) > 0, over[np.maximum(np.arange(size - 1) - 1, 0)], 0.0)
            total = np.where(feasible, score[:-1] + prior_of + best[after], -np.inf)
            at = int(np.argmax(total))
            if total[at] >= whole:
                top, cut = total[at], at
        best[s], nxt[s] = top, s + cut + 1 if cut >= 0 else n
        own = mean[:, cut] if cut >= 0 else mean[:, -1]
        level[:, s] = own
        high[:, s] = np.maximum(own, high[:, nxt[s]]) if cut >= 0 else own
        low[:, s] = np.minimum(own, low[:, nxt[s]]) if cut >= 0 else own
    cuts, s, levels = [], 0, []
    while s < n:
        levels.append([float(v) for v in level[:, s]])
        s = int(nxt[s])
        if s < n:
            cuts.append(s - 1)
    return cuts, levels


def cut_confidence(ys: list[np.ndarray], prior: Prior) -> np.ndarray:
    """Log posterior probability of a cut after each bin but the last, over all segmentations without constraints."""
    n = len(ys[0])
    ev = [Evidence(y, prior) for y in ys]
    log_g, over = length_prior(n, prior.segment_r, prior.segment_p)
    edge = np.concatenate([[0.0], over])[:n]  # a segment at either end of size k + 1 may go on outside
    suffix, prefix = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)  # of bins from s on after a cut; of bins up to t (excluded) before one
    suffix[n] = prefix[0] = 0.0
    for s in range(n - 1, -1, -1):
        score = sum(e.row(s)[0] for e in ev)
        terms = score + np.append(log_g[: n - s - 1], 0.0) + suffix[s + 1 :]
        terms[-1] = score[-1] + edge[n - s - 1]
        if s == 0:
            terms[:-1] = score[:-1] + edge[: n - 1] + suffix[1:n]
        suffix[s] = np.logaddexp.reduce(terms)
    for s in range(n):
        score = sum(e.row(s)[0] for e in ev)
        start = edge[: n - s] if s == 0 else log_g[: n - s]
        prefix[s + 1 :] = np.logaddexp(prefix[s + 1 :], prefix[s] + score + start)
    return prefix[1:n] + suffix[1:n] - suffix[0]


def odds(log_confidence: float) -> float:
    rest = np.expm1(-log_confidence)
    return float("inf") if rest <= 0 else float(-np.log(rest))


SHAPES = {"free": ("any",), "valley": ("decreasing", "increasing"), "peak": ("increasing", "decreasing")}


def segment_shaped(ys: list[np.ndarray], prior: Prior, shape: str = "free", segments: int | None = None) -> tuple[list[int], list[list[float]]]:
    """The best cuts and each segment's means, as segment() returns them, for other shapes of the levels.

    free: no constraint; valley: all falling steps come before all rising ones; peak: the other way round. A step rises or falls in the sum of
    the samples, against the best segmentation that follows. ``segments`` fixes the number of segments (free only; ValueError if there are fewer bins).
    """
    n, steps = len(ys[0]), SHAPES[shape]
    if segments is not None and (shape != "free" or not 1 <= segments <= n):
        raise ValueError("a number of segments goes with the free shape, and with as many bins at least")
    ev = [Evidence(y, prior) for y in ys]
    log_g, over = length_prior(n, prior.segment_r, prior.segment_p)
    # states: the kinds of steps that may still come or, with a fixed number, the segments that must still come
    states = len(steps) if segments is None else segments
    best, level = np.full((states, n + 1), -np.inf), np.zeros((states, n + 1))
    nxt, into = np.full((states, n), -1), np.zeros((states, n), int)
    for s in range(n - 1, -1, -1):
        rows = [e.row(s) for e in ev]
        score, mean = sum(x[0] for x in rows), sum(x[1] for x in rows)
        size = n - s
        whole = score[-1] + (over[size - 2] if size > 1 else 0.0)
        first = log_g[: size - 1] if s else np.where(np.arange(size - 1) > 0, over[np.maximum(np.arange(size - 1) - 1, 0)], 0.0)
        for g in range(states):
            top, cut, then = (whole if segments is None or g == 0 else -np.inf), -1, g
            for d in range(g, states) if segments is None else range(g - 1, g):
                if size < 2 or d < 0:
                    continue
                after = level[d, s + 1 : n]
                kind = steps[d] if segments is None else "any"
                ok = np.ones(size - 1, bool) if kind == "any" else after < mean[:-1] if kind == "decreasing" else after > mean[:-1]
                total = np.where(ok, score[:-1] + first + best[d, s + 1 : n], -np.inf)
                at = int(np.argmax(total))
                if total[at] > top:
                    top, cut, then = total[at], at, d
            best[g, s], nxt[g, s], into[g, s] = top, (s + cut + 1 if cut >= 0 else n), then
            level[g, s] = mean[cut] if cut >= 0 else mean[-1]
    cuts, levels, s, g = [], [], 0, states - 1 if segments is not None else 0
    while s < n:
        to, then = int(nxt[g, s]), int(into[g, s])
        levels.append([float(np.mean(y[s:to])) for y in ys])
        if to < n:
            cuts.append(to - 1)
        s, g = to, then
    return cuts, levels


def sample_cuts(ys: list[np.ndarray], prior: Prior, times: int, seed: int = 0) -> list[list[int]]:
    """Segmentations drawn from the posterior without constraints: each the cuts, drawn from the first bin on by the suffix sums."""
    n = len(ys[0])
    ev = [Evidence(y, prior) for y in ys]
    log_g, over = length_prior(n, prior.segment_r, prior.segment_p)
    edge = np.concatenate([[0.0], over])[:n]
    suffix, rows = np.zeros(n + 1), []
    for s in range(n - 1, -1, -1):
        score = sum(e.row(s)[0] for e in ev)
        inner = edge[: n - s - 1] if s == 0 else log_g[: n - s - 1]
        terms = score + np.append(inner, edge[n - s - 1]) + suffix[s + 1 :]
        suffix[s] = np.logaddexp.reduce(terms)
        rows.append(np.cumsum(np.exp(terms - suffix[s])))
    rng, out = np.random.default_rng(seed), []
    for _ in range(times):
        s, cuts = 0, []
        while s < n:
            walk = rows[n - 1 - s]
            s += 1 + min(int(np.searchsorted(walk, rng.random() * walk[-1])), n - s - 1)
            if s < n:
                cuts.append(s - 1)
        out.append(cuts)
    return out


OUT = "chr string, strand string, start int, stop int, sample_levels array<array<double>>, pos int, cut int, confidence double, log_odds double"


def _signals(rows: pd.DataFrame, start: int, stop: int, width: int) -> tuple[list[np.ndarray], int]:
    """Each sample's values of all bins of the exon (0 where there is no row), and the bins' width."""
    step = int(rows["width"].iloc[0]) if "width" in rows else width
    n = max(-(-(stop - start + 1) // step), int(rows["bin"].max()) + 1)
    wide = rows.pivot_table(index="bin", columns="sample", values="y", aggfunc="sum", fill_value=0).reindex(range(n), fill_value=0)
    return [wide[c].to_numpy(float) for c in sorted(wide.columns)], step


def change_points(bins: DataFrame, width: int, prior: Prior | None = None, mode: str | None = None, min_bins: int = 0, shift: bool = True, segments: int | None = None) -> DataFrame:
    """Change points of exons from binned coverage.

    bins: chr, strand, start, stop (the exon), sample, bin, y; a bin without a row counts as 0. A column width, if there is one, holds the exon's own
    bin width, a column mode its own mode. A group is one exon with its samples, whose bins are bounded by its length (coarsen very long exons first).
    mode is that of segment() or segment_shaped() (with ``segments``, the number of segments); it defaults to falling coverage in the direction of the strand. Returns a row for each
    cut that is over min_bins from both ends and whose position lies within the exon: the position (a bin on where coverage rises, with ``shift``), the levels of
    all samples before and after it, confidence and log odds.
    """
    prior = prior or Prior()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chr_, strand, start, stop = key
        ys, step = _signals(rows, start, stop, width)
        how = rows["mode"].iloc[0] if "mode" in rows else mode or ("increasing" if strand == "-" else "decreasing")
        cuts, levels = segment_shaped(ys, prior, how, segments) if how in SHAPES else segment(ys, prior, how)
        confidence = cut_confidence(ys, prior) if cuts else np.zeros(0)
        out = []
        for i, c in enumerate(cuts):
            pos = int(start + (c + (shift and sum(levels[i + 1]) > sum(levels[i]))) * step + step // 2)
            if min_bins < c < len(ys[0]) - min_bins - 1 and start < pos < stop:
                out.append((chr_, strand, start, stop, [levels[i], levels[i + 1]], pos, c, float(np.exp(confidence[c])), odds(confidence[c])))
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in OUT.split(", ")])

    return bins.groupBy("chr", "strand", "start", "stop").applyInPandas(run, OUT)


def sampled_change_points(bins: DataFrame, width: int, times: int, prior: Prior | None = None, seed: int = 0) -> DataFrame:
    """(chr, strand, start, stop, cut, share): the bins after which drawn segmentations have a cut, and the share of ``times`` draws that do."""
    prior = prior or Prior()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ys, _ = _signals(rows, key[2], key[3], width)
        n = pd.Series([c for cuts in sample_cuts(ys, prior, times, seed) for c in cuts], dtype="int64").value_counts().sort_index()
        return pd.DataFrame([(*key, int(c), k / times) for c, k in n.items()], columns=["chr", "strand", "start", "stop", "cut", "share"])

    return bins.groupBy("chr", "strand", "start", "stop").applyInPandas(run, "chr string, strand string, start int, stop int, cut int, share double")
