"""Linear-chain conditional random fields with two labels, for whole blocks.

With two labels a chain's state is one number, the odds of label 1 against 0.
All sequences of a block advance together, longest first, so a step is a few
numpy operations on the sequences that are still running.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

_LOW, _HIGH = 1e-30, 1e30
#: Elements of the sequences that ``fit`` holds in full at a time, about.
PIECE = 1 << 17


@dataclass
class Chain:
    """Log weights of the transitions (from 0 to 0 has weight 0) and of
    starting with label 1 rather than 0."""

    t01: float = 0.0
    t10: float = 0.0
    t11: float = 0.0
    start: float = 0.0


class Layout:
    """Order in which the sequences with the given bounds advance."""

    def __init__(self, bounds: np.ndarray) -> None:
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        self.first, self.size = bounds[:-1][order], size[order]
        longest = int(self.size[0]) if len(size) else 0
        self.running = np.searchsorted(-self.size, -np.arange(longest), side="left")

    def __len__(self) -> int:
        return len(self.running)


def forward(e: np.ndarray, layout: Layout, chain: Chain) -> np.ndarray:
    """Odds of label 1 at each element given those up to it; ``e`` are the
    elements' own odds."""
    t01, t10, t11 = np.exp([chain.t01, chain.t10, chain.t11])
    out, now = np.empty(len(e)), np.empty(0)
    for step in range(len(layout)):
        at = layout.first[: layout.running[step]] + step
        own = e[at]
        if step:
            now = now[: len(at)]
            now = (t01 + t11 * now) / (1 + t10 * now) * own
        else:
            now = np.exp(chain.start) * own
        now = np.minimum(np.maximum(now, _LOW), _HIGH)
        out[at] = now
    return out


def backward(e: np.ndarray, layout: Layout, chain: Chain) -> np.ndarray:
    """What the elements after each one multiply its odds by."""
    t01, t10, t11 = np.exp([chain.t01, chain.t10, chain.t11])
    out = np.ones(len(e))
    for step in reversed(range(len(layout) - 1)):
        at = layout.first[: layout.running[step + 1]] + step
        later = e[at + 1] * out[at + 1]
        out[at] = np.minimum(np.maximum((t10 + t11 * later) / (1 + t01 * later), _LOW), _HIGH)
    return out


def marginals(score: np.ndarray, bounds: np.ndarray, chain: Chain) -> np.ndarray:
    """Probability of label 1 at each element; ``score``: its log odds alone."""
    e, layout = np.exp(np.clip(score, -30, 30)), Layout(bounds)
    odds = forward(e, layout, chain) * backward(e, layout, chain)
    return odds / (1 + odds)


def viterbi(score: np.ndarray, bounds: np.ndarray, chain: Chain) -> np.ndarray:
    """The most probable labels of each sequence; of equal ones label 0."""
    layout = Layout(bounds)
    back0, back1 = np.zeros(len(score), bool), np.zeros(len(score), bool)
    label, lead, now = np.zeros(len(score), bool), np.empty(len(score)), np.empty(0)
    for step in range(len(layout)):
        at = layout.first[: layout.running[step]] + step
        if step:
            now = now[: len(at)]
            back0[at], back1[at] = now + chain.t10 > 0, now + chain.t11 > chain.t01
            now = np.maximum(chain.t01, now + chain.t11) - np.maximum(0, now + chain.t10) + score[at]
        else:
            now = chain.start + score[at]
        lead[at] = now
    for step in reversed(range(len(layout))):
        at = layout.first[: layout.running[step]] + step
        # a sequence's last element decides by its lead, others by the next one
        ends = layout.size[: len(at)] == step + 1
        after = np.where(ends, at, np.minimum(at + 1, len(score) - 1))
        label[at] = np.where(ends, lead[at] > 0, np.where(label[after], back1[after], back0[after]))
    return label


def fit(emit: Callable[[np.ndarray], np.ndarray], back: Callable[[np.ndarray], np.ndarray], width: int, label: np.ndarray, bounds: np.ndarray, rounds: int = 80, rate: float = 0.25, ridge: float = 1e-3, weight: np.ndarray | None = None) -> tuple[np.ndarray, Chain]:
    """Weights that maximise the conditional likelihood of ``label``, and the
    chain.  ``emit`` gives the elements' log odds for ``width`` weights and
    ``back`` the weights' gradient for the elements' errors.  ``weight`` counts
    each element's sequence that often."""
    theta, step1, step2 = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    label = label.astype(np.float64)
    weight = np.ones(len(label)) if weight is None else weight
    inside = np.ones(len(label), bool)
    inside[bounds[:-1][np.diff(bounds) > 0]] = False
    here = np.flatnonzero(inside)
    firsts = np.flatnonzero(~inside)
    scale = max(1.0, weight.sum())
    was, now = label[here - 1], label[here]
    seen = [((1 - was) * now * weight[here]).sum(), (was * (1 - now) * weight[here]).sum(), (was * now * weight[here]).sum()]
    # whole sequences at a time, so that only the sums need memory for all
    at = np.unique(np.append(np.searchsorted(bounds, np.arange(bounds[0], bounds[-1], PIECE)), len(bounds) - 1))
    pieces = [(bounds[i], bounds[j], Layout(bounds[i : j + 1] - bounds[i]), np.flatnonzero(inside[bounds[i] : bounds[j]])) for i, j in zip(at[:-1], at[1:], strict=True)]
    for k in range(1, rounds + 1):
        chain = Chain(*theta[width:])
        e = np.exp(np.clip(emit(theta[:width]), -30, 30))
        error, slope = np.empty(len(e)), np.array(seen)
        for lo, hi, layout, here in pieces:
            own, each = e[lo:hi], weight[lo:hi]
            r, q = forward(own, layout, chain), backward(own, layout, chain)
            odds = r * q
            error[lo:hi] = (label[lo:hi] - odds / (1 + odds)) * each
            a, b = r[here - 1], own[here] * q[here]
            w01, w10, w11 = np.exp(chain.t01) * b, np.exp(chain.t10) * a, np.exp(chain.t11) * a * b
            total = (1 + w01 + w10 + w11) / each[here]
            slope -= [(w / total).sum() for w in (w01, w10, w11)]
        g = np.concatenate([back(error), slope, [error[firsts].sum()]]) / scale - ridge * theta
        step1, step2 = 0.9 * step1 + 0.1 * g, 0.99 * step2 + 0.01 * g * g
        theta = theta + rate * (1 - k / (rounds + 1)) * (step1 / (1 - 0.9**k)) / (np.sqrt(step2 / (1 - 0.99**k)) + 1e-8)
    return theta[:width], Chain(*theta[width:].tolist())
