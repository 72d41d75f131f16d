"""Histogram trees for all held-out cells at once: forests and boosted trees.

Feature values are cut once into 8-bit codes, for all folds. Each model (a held-out cell and its
``Settings``) then needs sums per (tree, node, feature, code): the number of rows and the sum of
gradients. Gradients are integers of a fixed unit, so the sums, and with them every split, do not
depend on how rows are dealt. The best split of a node maximises the L2-regularised gain; ties go to
the first feature and the lowest code.

Three ways grow the same trees:

* **Together** (up to ``LOCAL_CELLS`` rows x features): a group per model holds its rows of codes, and
  all models of a task are one Spark job.
* **Held** (up to ``HELD_TIMES`` as many): the same, but rows come in batches, in the order of
  models, and the task keeps a byte per row and feature.
* **Spread** (beyond): rows stay where they are. One job per level of all models: tasks add up their
  rows' sums per node, a shuffle by node completes them and finds the best split, and only splits
  return to the driver. Raw predictions of the boosted models travel with the rows and are written
  every few rounds; a model that has stopped leaves the jobs.

Boosted models stop after ``patience`` rounds without a lower error on the fold's validation cells
and keep the rounds up to the least one. ``leaves`` grows the best leaf first: a node is evaluated
only while it can still be among the ``leaves - 1`` best splits. Forests weigh rows by a Poisson
variable hashed from the row's key and the tree, so a bootstrap sample needs no shuffle.
"""

from __future__ import annotations

import heapq
import math
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.functions import fixed
from voltarc.operators import folds
from voltarc.operators.predictions import prediction_table
from voltarc.operators.tables import quoted, safe_names
from voltarc.sources.stages import discard, settled

BINS = 256
MISSING = BINS - 1  # code of a missing value, replaced by that of the fold's fill value
LOCAL_CELLS = 1 << 25  # rows x features up to which a model is grown in one task
HELD_TIMES = 16  # times as many are grown in one task that holds nothing but their codes
CHUNK_CELLS = 1 << 22  # rows x features x trees that are summed at a time
SPARSE_CELLS = 1 << 20  # rows x features of nodes whose splits are looked for at a time
DENSE_CELLS = 1 << 22  # nodes x codes of all features up to which a level's histograms are kept
SEARCH_CELLS = 1 << 16  # of these, cells that are searched at a time
FLAT_CELLS = 1 << 20  # rows x features up to which a level's sums of all features are one pass
WRITE_EVERY = 8  # rounds between two written states of spread models
UNITS = 2**30  # gradients are counted in units of the label's range / UNITS
ERROR_UNITS = 2**20


@dataclass(frozen=True)
class Settings:
    """One model. ``trees`` are rounds where ``boost``; shares are of rows and columns per tree."""
    name: str
    trees: int
    step: float = 1.0
    depth: int = 12
    leaves: int | None = None
    min_rows: int = 1
    l2: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    huber: float | None = None  # gradients are clipped here
    patience: int | None = None
    boost: bool = True
    seed: int = 1337


# ---------------------------------------------------------------- sums and splits

def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) per id and tree, the same wherever the row is."""
    salt = _mix(np.array([seed * 1_000_003 + tree + 1], np.uint64))
    return _mix(_mix(ids ^ salt) + salt) / 2.0**64


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def weights(ids: np.ndarray, settings: Settings, tree: int) -> np.ndarray:
    """How often each row counts in a tree."""
    if settings.boost:
        return (np.ones(len(ids), np.int64) if settings.rows >= 1 else
                (_uniform(ids, settings.seed, tree) < settings.rows).astype(np.int64))
    return np.searchsorted(_POISSON, _uniform(ids, settings.seed, tree), side="right")


def columns(kept: np.ndarray, settings: Settings, tree: int) -> np.ndarray:
    """Mask of the features that a tree may use."""
    own = np.flatnonzero(kept)
    take = math.ceil(settings.columns * len(own))
    order = np.argsort(_uniform(own.astype(np.uint64), settings.seed ^ 0x5EED, tree),
                       kind="stable")
    mask = np.zeros(len(kept), bool)
    mask[own[order[:take]]] = True
    return mask


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def cells(slot: np.ndarray, row: np.ndarray, weight: np.ndarray, codes: np.ndarray,
          gradient: np.ndarray) -> Cells:
    """Sums per cell ((slot * features) + feature) * BINS + code, in order of cells: cell, rows, sum
    of gradients. ``slot`` numbers the nodes, ``row`` points into codes and gradient."""
    wide = codes.shape[1]
    parts = []
    step = max(1, CHUNK_CELLS // max(1, wide))
    for at in range(0, len(slot), step):
        s, r, w = slot[at:at + step], row[at:at + step], weight[at:at + step]
        key = ((s[:, None] * wide + np.arange(wide)) * BINS + codes[r]).ravel()
        n, g = np.repeat(w, wide), np.repeat(w * gradient[r], wide)
        top = int(s.max() + 1) * wide * BINS if len(s) else 0
        if top <= 2 * len(key) and len(s) < 1 << 22:  # sums of doubles are exact here
            number = np.bincount(key, n, top)
            used = np.flatnonzero(np.bincount(key, minlength=top))
            parts.append((used, number[used].astype(np.int64),
                          np.bincount(key, g, top)[used].astype(np.int64)))
        else:
            parts.append(_added(key, n, g))
    if len(parts) == 1:
        return parts[0]
    return _added(*[np.concatenate(x) for x in zip(*parts)]) if parts else (
        np.empty(0, np.int64),) * 3


def _added(key: np.ndarray, n: np.ndarray, g: np.ndarray) -> Cells:
    if not len(key):
        return key, n, g
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], np.add.reduceat(n[order], start), np.add.reduceat(g[order], start)


SPLIT = ["slot", "rows", "total", "gain", "feature", "cut", "left_rows", "left_total"]


def best_splits(found: Cells, wide: int, allowed: np.ndarray, l2: float, min_rows: int
                ) -> np.ndarray:
    """A row of SPLIT per slot; gain is 0 without a split. ``allowed``: mask of features per slot."""
    key, n, g = found
    if not len(key):
        return np.empty((0, len(SPLIT)))
    part, code = key // BINS, key % BINS
    slot, feature = part // wide, part % wide
    start = np.concatenate([[True], part[1:] != part[:-1]])
    first = np.flatnonzero(start)
    group = np.cumsum(start) - 1
    all_n, all_g = np.cumsum(n), np.cumsum(g)
    before_n, before_g = (all_n - n)[first], (all_g - g)[first]
    left_n, left_g = all_n - before_n[group], all_g - before_g[group]
    node_n = np.add.reduceat(n, first)[group]
    node_g = np.add.reduceat(g, first)[group]
    right_n, right_g = node_n - left_n, node_g - left_g
    good = ((left_n >= min_rows) & (right_n >= min_rows) & (left_n > 0) & (right_n > 0)
            & allowed[slot, feature])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left_g.astype(float)**2 / (left_n + l2) + right_g.astype(float)**2 / (right_n + l2)
                - node_g.astype(float)**2 / (node_n + l2))
    gain = np.where(good & (gain > 1.0), gain, 0.0)  # one squared unit: rounding
    begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    top = np.maximum.reduceat(gain, begin)
    which = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(slot)]])))
    hits = np.flatnonzero(gain == top[which])
    pick = hits[np.unique(which[hits], return_index=True)[1]]
    return np.column_stack([slot[pick], node_n[pick], node_g[pick], gain[pick], feature[pick],
                            code[pick], left_n[pick], left_g[pick]])


class Histograms:
    """Rows and gradients per node and code, as arrays, for the features that can split: those in
    ``usable`` with two codes or more. The codes that occur in ``rows`` (places, by default all), those
    of all features side by side, are a row per node."""

    def __init__(self, codes: np.ndarray, usable: np.ndarray, rows: np.ndarray | None = None):
        some = slice(None) if rows is None else rows
        present = {f: np.flatnonzero(np.bincount(codes[some, f], minlength=BINS))
                   for f in np.flatnonzero(usable).tolist()}
        self.own = [f for f, known in present.items() if len(known) > 1]
        if len(codes) > 1 and codes.strides[0] == 1:  # codes held by column are not held twice
            present = {f: np.arange(int(codes[:, f].max()) + 1) for f in self.own}
            self.columns = [codes[:, f] for f in self.own]
        else:
            self.columns = []
            for f in self.own:
                number = np.zeros(BINS, np.uint8)
                number[present[f]] = np.arange(len(present[f]))
                self.columns.append(number[codes[:, f]])
        sizes = [len(present[f]) for f in self.own]
        self.offset = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.width = int(self.offset[-1])
        self.place = np.repeat(np.arange(len(self.own)), sizes)
        self.feature = np.array(self.own, np.int64)[self.place]
        self.code = np.concatenate([present[f] for f in self.own] or [np.empty(0, np.int64)])
        self.flat = None  # places in a node's row, for few rows
        if self.own and len(codes) * len(self.own) <= FLAT_CELLS:
            self.flat = np.column_stack(self.columns) + self.offset[:-1]
        self.kind = np.int64

    def expect(self, gradient: np.ndarray, weight: int) -> None:
        """The next sums are of these gradients, each with at most this total weight."""
        most = float(np.abs(gradient).max(initial=0)) * weight * max(1, len(self.own))
        self.kind = float if most < 2.0**52 else np.int64

    def sums(self, slot: np.ndarray, row: np.ndarray, weight: np.ndarray, gradient: np.ndarray,
             slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Integers, as doubles where also sums over all features are exact."""
        pull = (weight * gradient[row]).astype(float)  # a feature's sums are exact here
        single = not len(weight) or weight.max() <= 1
        if self.flat is not None:  # one pass over all features
            wide, size = len(self.own), slots * self.width
            key = (self.flat[row] + (slot * self.width)[:, None]).ravel()
            n = np.bincount(key, None if single else np.repeat(weight, wide), size)
            g = np.bincount(key, np.repeat(pull, wide), size)
            return tuple(x.reshape(slots, -1).astype(self.kind, copy=False) for x in (n, g))
        n = np.empty((slots, self.width), self.kind)
        g = np.empty((slots, self.width), self.kind)
        start, key = slot * BINS, np.empty(len(slot), np.int64)
        for column, a, b in zip(self.columns, self.offset, self.offset[1:]):
            np.add(start, column[row], out=key)
            for out, w in ((n, None if single else weight), (g, pull)):
                out[:, a:b] = np.bincount(key, w, slots * BINS).reshape(slots, BINS)[:, :b - a]
        return n, g

    def best(self, n: np.ndarray, g: np.ndarray, allowed: np.ndarray, l2: float, min_rows: int
             ) -> np.ndarray:
        """What :func:`best_splits` finds, for every slot."""
        out, first = np.empty((len(n), len(SPLIT))), self.offset[1]
        step = max(1, SEARCH_CELLS // self.width)
        for at in range(0, len(n), step):
            some = slice(at, at + step)
            node_n = n[some, :first].sum(axis=1, keepdims=True)
            node_g = g[some, :first].sum(axis=1, keepdims=True)
            # every feature's codes add up to the node
            left_n = np.cumsum(n[some], axis=1)
            left_n -= (self.place * node_n).astype(n.dtype, copy=False)
            left_g = np.cumsum(g[some], axis=1)
            left_g -= (self.place * node_g).astype(g.dtype, copy=False)
            right_n = node_n - left_n
            good = (left_n >= max(1, min_rows)) & (right_n >= max(1, min_rows))
            mask = allowed[some]
            if not mask[:, self.own].all():
                good &= mask[:, self.feature]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (left_g.astype(float, copy=False)**2 / (left_n + l2)
                        + (node_g - left_g).astype(float, copy=False)**2 / (right_n + l2)
                        - node_g.astype(float)**2 / (node_n + l2))
            good &= gain > 1.0
            gain[~good] = 0.0
            pick = gain.argmax(axis=1)
            slot = np.arange(len(pick))
            out[some] = np.column_stack([
                slot + at, node_n, node_g, gain[slot, pick], self.feature[pick], self.code[pick],
                left_n[slot, pick], left_g[slot, pick]])
        return out


def _searched(slot: np.ndarray, row: np.ndarray, weight: np.ndarray, codes: np.ndarray,
              gradient: np.ndarray, allowed: np.ndarray, settings: Settings) -> np.ndarray:
    """:func:`best_splits` over nodes with at most SPARSE_CELLS rows x features together, or one."""
    wide = codes.shape[1]
    sizes = np.bincount(slot, minlength=len(allowed)) * wide
    part = np.cumsum(sizes) // SPARSE_CELLS if len(sizes) else sizes
    order = np.argsort(slot, kind="stable")
    ends = np.searchsorted(part[slot[order]], np.unique(part), side="right").tolist()
    found, start = [], 0
    for end in ends:
        own = order[start:end]
        start = end
        if len(own):
            base = slot[own[0]]
            top = slot[own[-1]] + 1
            some = best_splits(cells(slot[own] - base, row[own], weight[own], codes, gradient),
                               wide, allowed[base:top], settings.l2, settings.min_rows)
            some[:, 0] += base
            found.append(some)
    return np.concatenate(found) if found else np.empty((0, len(SPLIT)))


# ---------------------------------------------------------------- trees

class Tree:
    """Nodes in the order in which they were made; a node's children lie side by side."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left = [0], [0], [-1]
        self.parent, self.depth = [-1], [0]
        self.rows, self.total, self.gain = [0.0], [0.0], [0.0]
        self.open = [0]  # nodes whose best split is wanted
        self.used: set[int] | None = None  # nodes that split, where leaves are limited

    def learn(self, splits: np.ndarray, settings: Settings) -> None:
        """Best splits of the open nodes, in their order; opens the next nodes."""
        for node, (_, rows, total, gain, feature, cut, _, _) in zip(self.open, splits.tolist()):
            self.rows[node], self.total[node] = rows, total
            if self.depth[node] < settings.depth:
                self.gain[node], self.feature[node], self.cut[node] = gain, int(feature), int(cut)
        if settings.leaves is None:
            split = [n for n in self.open if self.gain[n] > 0]
        else:
            split = self._best_first(settings.leaves)
        self.open = []
        for node in split:
            if self.left[node] < 0:
                self.left[node] = len(self.feature)
                for _ in range(2):
                    self.open.append(len(self.feature))
                    for x, v in ((self.feature, 0), (self.cut, 0), (self.left, -1),
                                 (self.parent, node), (self.depth, self.depth[node] + 1),
                                 (self.rows, 0.0), (self.total, 0.0), (self.gain, 0.0)):
                        x.append(v)

    def _best_first(self, leaves: int) -> list[int]:
        """Nodes in the order in which leaf-wise growth would split them, as far as it is known."""
        queue, order = [(-self.gain[0], 0)], []
        while queue and len(order) < leaves - 1:
            gain, node = heapq.heappop(queue)
            if gain >= 0:
                break
            order.append(node)
            if self.left[node] >= 0:
                for child in (self.left[node], self.left[node] + 1):
                    heapq.heappush(queue, (-self.gain[child], child))
        self.used = set(order)
        return order

    def arrays(self, settings: Settings, unit: float) -> dict[str, np.ndarray]:
        """feature, cut, left (-1: leaf) and value per node; values are steps in the label."""
        left = np.array(self.left, np.int32)
        if self.used is not None:
            left[[n for n in range(len(left)) if n not in self.used]] = -1
        rows, total = np.array(self.rows), np.array(self.total)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(rows > 0, -unit * total / (rows + settings.l2), 0.0) * settings.step
        return dict(feature=np.array(self.feature, np.int32), cut=np.array(self.cut, np.int32),
                    left=left, value=value)


def walk(tree: Mapping[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Leaf of every row."""
    at = np.zeros(len(codes), np.int32)
    rows = np.arange(len(codes))
    while len(rows):
        node = at[rows]
        on = tree["left"][node] >= 0
        rows, node = rows[on], node[on]
        at[rows] = tree["left"][node] + (codes[rows, tree["feature"][node]] > tree["cut"][node])
    return at


def paths(tree: Mapping[str, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of every row, and the features that its path tests, as bits of 64-bit words."""
    at, rows = np.zeros(len(codes), np.int32), np.arange(len(codes))
    seen = np.zeros((len(codes), -(-codes.shape[1] // 64)), np.uint64)
    while len(rows):
        node = at[rows]
        on = tree["left"][node] >= 0
        rows, node = rows[on], node[on]
        feature = tree["feature"][node]
        seen[rows, feature >> 6] |= np.uint64(1) << (feature & 63).astype(np.uint64)
        at[rows] = tree["left"][node] + (codes[rows, feature] > tree["cut"][node])
    return at, seen


def walk_changed(tree: Mapping[str, np.ndarray], codes: np.ndarray, own: np.ndarray, j: int,
                 code: np.ndarray) -> np.ndarray:
    """Leaf of the rows ``own`` (places) with these codes in feature ``j``."""
    at, rows = np.zeros(len(own), np.int32), np.arange(len(own))
    while len(rows):
        node = at[rows]
        on = tree["left"][node] >= 0
        rows, node = rows[on], node[on]
        feature = tree["feature"][node]
        here = np.where(feature == j, code[rows], codes[own[rows], feature])
        at[rows] = tree["left"][node] + (here > tree["cut"][node])
    return at


def shuffled_guesses(base: float, trees: Sequence[Mapping[str, np.ndarray]], codes: np.ndarray,
                     others: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of a forest's predictions per row: as it is, then for each feature with the code that the
    row has in each of ``others``. A tree is walked again only where a changed code lies on the path."""
    wide, repeats = codes.shape[1], len(others)
    plain, change = np.full(len(codes), base * len(trees)), np.zeros((wide, repeats, len(codes)))
    for tree in trees:
        at, seen = paths(tree, codes)
        value = tree["value"][at]
        plain += value
        for j in np.unique(tree["feature"][tree["left"] >= 0]).tolist() if repeats else ():
            on_path = np.flatnonzero(seen[:, j >> 6] >> np.uint64(j & 63) & np.uint64(1))
            own = [on_path[z[on_path, j] != codes[on_path, j]] for z in others]
            rows = np.concatenate(own)
            if len(rows):
                code = np.concatenate([z[o, j] for z, o in zip(others, own)])
                moved = tree["value"][walk_changed(tree, codes, rows, j, code)] - value[rows]
                change[j, np.repeat(np.arange(repeats), [len(o) for o in own]), rows] += moved
    return np.column_stack([plain, (plain + change.reshape(-1, len(codes))).T])


def _partial(tree: Tree) -> dict[str, np.ndarray]:
    return dict(feature=np.array(tree.feature, np.int32), cut=np.array(tree.cut, np.int32),
                left=np.array(tree.left, np.int32))


def _slots(trees: Sequence[Tree], codes: np.ndarray, picked: Sequence[np.ndarray],
           counts: Sequence[np.ndarray], at: list[np.ndarray] | None = None):
    """Slot, row and weight of the rows (``picked`` per tree, with ``counts``) in open nodes. Slots
    number the open nodes of all trees in order. ``at`` keeps where rows are between levels."""
    slots, rows, weight, base = [], [], [], 0
    for k, (tree, own, n) in enumerate(zip(trees, picked, counts)):
        if not tree.open:
            continue
        here = at[k] if at is not None else walk(_partial(tree), codes[own])
        number = np.full(len(tree.feature), -1, np.int64)
        number[tree.open] = base + np.arange(len(tree.open))
        base += len(tree.open)
        slot = number[here]
        on = slot >= 0
        slots.append(slot[on])
        rows.append(own[on])
        weight.append(n[on])
    none = np.empty(0, np.int64)
    join = lambda x: np.concatenate(x) if x else none
    return join(slots), join(rows), join(weight)


def grow(codes: np.ndarray, gradient: np.ndarray, ids: np.ndarray, train: np.ndarray,
         kept: np.ndarray, settings: Settings, numbers: Sequence[int],
         tables: Histograms | None = None) -> list[Tree]:
    """The trees ``numbers`` on the rows ``train`` (places), level by level, all together.

    A level's histograms are kept where they are small; then only the smaller child of a node is
    counted, its sibling is the rest of the node. ``tables`` serves several calls on the same codes.
    """
    tables = Histograms(codes, kept, train) if tables is None else tables
    trees = [Tree() for _ in numbers]
    masks = [columns(kept, settings, t) for t in numbers]
    picked, counts, at = [], [], []
    for t in numbers:
        w = weights(ids[train], settings, t)
        picked.append(train[w > 0])
        counts.append(w[w > 0])
        at.append(np.zeros(int((w > 0).sum()), np.int32))
    tables.expect(gradient, max((int(w.sum()) for w in counts), default=0))
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # by tree and node
    least = 2 * max(1, settings.min_rows)
    while any(t.open for t in trees):
        slot, row, weight = _slots(trees, codes, picked, counts, at)
        allowed = np.concatenate([np.repeat(m[None], len(t.open), axis=0)
                                  for m, t in zip(masks, trees)])
        nodes = [(k, node) for k, t in enumerate(trees) for node in t.open]
        found = np.zeros((len(nodes), len(SPLIT)))
        found[:, 0] = np.arange(len(nodes))
        found[:, 1] = np.bincount(slot, weight, len(nodes))  # sums of doubles are exact here
        found[:, 2] = np.bincount(slot, weight * gradient[row], len(nodes))
        wanted = (found[:, 1] >= least) & np.array(
            [trees[k].depth[node] < settings.depth for k, node in nodes])
        size = int(wanted.sum()) * tables.width
        if size and size <= min(DENSE_CELLS, 4 * len(slot) * len(tables.own)):
            n, g = _counted(nodes, trees, wanted, held, tables, slot, row, weight, gradient)
            some = tables.best(n, g, allowed[wanted], settings.l2, settings.min_rows)
            fresh_tables = {nodes[s]: (n[i], g[i]) for i, s in enumerate(np.flatnonzero(wanted))}
            # leaf-wise growth may split a node of an earlier level
            held = fresh_tables if settings.leaves is None else held | fresh_tables
            found[wanted, 3:] = some[:, 3:]
        elif size:
            held = {} if settings.leaves is None else held
            on = wanted[slot]
            some = _searched(slot[on], row[on], weight[on], codes, gradient, allowed, settings)
            found[some[:, 0].astype(np.int64)] = some
        learn_all(trees, found, settings)
        for k, tree in enumerate(trees):
            if tree.open:
                fresh = np.zeros(len(tree.feature), bool)
                fresh[tree.open] = True
                left = np.array(tree.left)
                node = at[k]
                go = (left[node] >= 0) & fresh[np.maximum(left[node], 0)]
                node, own = node[go], picked[k][go]
                at[k][go] = left[node] + (codes[own, np.array(tree.feature)[node]]
                                          > np.array(tree.cut)[node])
    return trees


def _counted(nodes: Sequence[tuple[int, int]], trees: Sequence[Tree], wanted: np.ndarray,
             held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], tables: Histograms,
             slot: np.ndarray, row: np.ndarray, weight: np.ndarray, gradient: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Histograms of the ``wanted`` ones of the open ``nodes``; of two children of a held node the
    larger one is the rest of it."""
    sizes = np.bincount(slot, minlength=len(nodes))
    direct = wanted.copy()
    rest: dict[int, tuple[int, tuple[int, int]]] = {}  # slot -> slot of its sibling, their parent
    for s in range(len(nodes) - 1):
        k, node = nodes[s]
        parent = trees[k].parent[node]
        if parent >= 0 and trees[k].left[parent] == node and (k, parent) in held:
            more, less = (s, s + 1) if sizes[s] > sizes[s + 1] else (s + 1, s)
            if wanted[more]:
                rest[more] = less, (k, parent)
                direct[more], direct[less] = False, True
    number = np.where(direct, np.cumsum(direct) - 1, -1)
    if not direct.all():
        on = direct[slot]
        slot, row, weight = slot[on], row[on], weight[on]
    n, g = tables.sums(number[slot], row, weight, gradient, int(direct.sum()))
    if not rest:
        return n, g
    place = np.cumsum(wanted) - 1
    out_n, out_g = (np.empty((int(wanted.sum()), tables.width), x.dtype) for x in (n, g))
    both = np.flatnonzero(wanted & direct)
    out_n[place[both]], out_g[place[both]] = n[number[both]], g[number[both]]
    for s, (less, parent) in rest.items():
        whole_n, whole_g = held.pop(parent)
        np.subtract(whole_n, n[number[less]], out=out_n[place[s]])
        np.subtract(whole_g, g[number[less]], out=out_g[place[s]])
    return out_n, out_g


def learn_all(trees: Sequence[Tree], found: np.ndarray, settings: Settings) -> None:
    """Hand each tree the splits of its open nodes; a node without rows gets none."""
    total = sum(len(t.open) for t in trees)
    full = np.zeros((total, len(SPLIT)))
    if len(found):
        full[found[:, 0].astype(np.int64)] = found
    base = 0
    for tree in trees:
        n = len(tree.open)
        if n:
            tree.learn(full[base:base + n], settings)
        base += n


# ---------------------------------------------------------------- one model on its rows

@dataclass
class Scale:
    """Labels as integers above ``low``, in ``unit``."""
    low: float
    unit: float

    @staticmethod
    def of(low: float, high: float) -> "Scale":
        return Scale(low, (high - low) / UNITS if high > low else 1.0 / UNITS)

    def whole(self, y: np.ndarray) -> np.ndarray:
        return np.rint((y - self.low) / self.unit).astype(np.int64)

    def mean(self, total: int, n: int) -> float:
        return self.low + self.unit * (total / n)

    def gradient(self, guess: np.ndarray, y: np.ndarray, settings: Settings) -> np.ndarray:
        g = guess - y
        if settings.huber is not None:
            g = np.clip(g, -settings.huber, settings.huber)
        return np.rint(g / self.unit).astype(np.int64)

    def error(self, guess: np.ndarray, y: np.ndarray) -> int:
        """Sum of squares in whole units: the same for any order of rows."""
        e = np.rint(np.abs(guess - y) / (self.unit * (UNITS // ERROR_UNITS)))
        return int((np.minimum(e, 2.0**31).astype(np.int64)**2).sum())


class Patience:
    """Rounds to keep: up to the least validation error."""

    def __init__(self, patience: int | None):
        self.patience, self.best, self.rounds, self.seen = patience, None, 0, 0

    def goes_on(self, error: int | None) -> bool:
        """After a round; ``error`` is None without validation rows, which keeps all rounds."""
        self.seen += 1
        if error is None or self.best is None or error < self.best:
            self.best, self.rounds = error, self.seen
        return self.patience is None or error is None or self.seen - self.rounds < self.patience


def fit(codes: np.ndarray, y: np.ndarray, ids: np.ndarray, train: np.ndarray, check: np.ndarray,
        kept: np.ndarray, settings: Settings, scale: Scale
        ) -> tuple[float, list[dict[str, np.ndarray]]]:
    """Base value and trees of one model; ``train`` and ``check`` are places of rows."""
    base = scale.mean(int(scale.whole(y[train]).sum()), len(train)) if len(train) else 0.0
    guess, tables = np.full(len(y), base), Histograms(codes, kept, train)
    if not settings.boost:
        gradient = scale.gradient(guess, y, settings)
        step = max(1, CHUNK_CELLS // max(1, len(train) * codes.shape[1]))
        return base, [t.arrays(settings, scale.unit) for at in range(0, settings.trees, step)
                      for t in grow(codes, gradient, ids, train, kept, settings,
                                    range(at, min(at + step, settings.trees)), tables)]
    wait, trees = Patience(settings.patience), []
    for t in range(settings.trees):
        tree = grow(codes, scale.gradient(guess, y, settings), ids, train, kept, settings, [t],
                    tables)[0].arrays(settings, scale.unit)
        trees.append(tree)
        guess += tree["value"][walk(tree, codes)]
        if not wait.goes_on(scale.error(guess[check], y[check]) if len(check) else None):
            break
    return base, trees[:wait.rounds]


def importance_trees(codes: np.ndarray, y: np.ndarray, ids: np.ndarray, settings: Settings,
                     scale: Scale, numbers: Sequence[int]
                     ) -> tuple[float, list[dict[str, np.ndarray]], np.ndarray]:
    """Base value, trees ``numbers`` of a forest on all rows, and the sum over them of each feature's
    share of the gain."""
    base = scale.mean(int(scale.whole(y).sum()), len(y))
    gradient = scale.gradient(np.full(len(y), base), y, settings)
    kept, every = np.ones(codes.shape[1], bool), np.arange(len(y))
    tables, made, share = Histograms(codes, kept), [], np.zeros(codes.shape[1])
    for number in numbers:
        tree = grow(codes, gradient, ids, every, kept, settings, [number], tables)[0]
        made.append(tree.arrays(settings, scale.unit))
        on = made[-1]["left"] >= 0
        gain = np.bincount(made[-1]["feature"][on], np.array(tree.gain)[on], codes.shape[1])
        share += gain / gain.sum() if on.any() else 0.0
    return base, made, share


def predict(base: float, trees: Sequence[Mapping[str, np.ndarray]], codes: np.ndarray,
            settings: Settings) -> np.ndarray:
    out = np.zeros(len(codes))
    for tree in trees:
        out += tree["value"][walk(tree, codes)]
    return base + (out if settings.boost else out / max(1, len(trees)))


# ---------------------------------------------------------------- tables

def cut_points(samples: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Per feature up to BINS - 2 rising upper bounds of codes: all values where there are few,
    else sketched quantiles, as histogram boosters take them; bounds only place the cuts."""
    probs = F.array(*[F.lit(k / (BINS - 2)) for k in range(1, BINS - 2)])
    row = samples.select(*[quoted(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
                         ).agg(*[F.percentile_approx(F.nanvl(f"f{i}", F.lit(None)), probs, 10_000)
                                 for i in range(len(features))]).first()
    return [np.unique(np.array(bounds or [], float)) for bounds in row]


def code_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), MISSING,
                    np.searchsorted(bounds, values, side="left")).astype(np.uint8)


def coded(samples: DataFrame, features: Sequence[str], label: str, keys: Sequence[str],
          bounds: Sequence[np.ndarray]) -> DataFrame:
    """keys, _y, _id (a hash of the keys) and _codes: one byte per feature."""
    def code(values: pd.Series) -> pd.Series:
        table = np.stack(values.to_list()).astype(float) if len(values) else np.empty((0, 0))
        out = np.empty(table.shape, np.uint8)
        for i, b in enumerate(bounds):
            out[:, i] = code_of(table[:, i], b)
        return pd.Series([r.tobytes() for r in out], dtype=object)

    values = F.array(*[F.coalesce(quoted(f).cast("double"), F.lit(float("nan")))
                       for f in features])
    return samples.where(F.col(label).isNotNull()).select(
        *keys, F.col(label).cast("double").alias("_y"), F.xxhash64(*keys).alias("_id"),
        F.pandas_udf(code, "binary")(values).alias("_codes"))


def code_matrix(codes: pd.Series, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(-1, wide).copy()


def _fold_plan(plan: DataFrame, roles: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per held-out cell: kept and fill value per feature, validation cells."""
    by = plan.groupBy("hold").agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("kept", "fill")))).alias("m"))
    listed = F.array(*[F.lit(f) for f in features])
    val = roles.where("role = 'val'").groupBy("hold").agg(F.collect_list("cell_id").alias("val"))
    return by.join(val, "hold", "left").select(
        "hold", F.transform(listed, lambda f: F.col("m")[f]["kept"]).alias("kept"),
        F.transform(listed, lambda f: F.col("m")[f]["fill"]).alias("fill"),
        F.coalesce("val", F.array().cast("array<string>")).alias("val"))


def _filled(codes: np.ndarray, fill: Sequence[float], bounds: Sequence[np.ndarray]) -> np.ndarray:
    own = np.array([code_of(np.array([f], float), b)[0] for f, b in zip(fill, bounds)], np.uint8)
    return np.where(codes == MISSING, own[None, :], codes)


def held_out(samples: DataFrame, features: Sequence[str], label: str, keys: Sequence[str],
             settings: Sequence[Settings], guard: bool = True, fill_missing: bool = False,
             roles: DataFrame | None = None, holds: Sequence[str] | None = None,
             min_train: int = 1, local_cells: int = LOCAL_CELLS,
             held_cells: int | None = None) -> DataFrame:
    """Predictions of every held-out cell by every model, fitted on the other cells: keys, y_true,
    y_pred, model, rounds (trees kept) and predict_ms (per row).

    ``guard`` applies the name and correlation guards per fold, ``fill_missing`` fills missing
    values with the median of the training cells (without it with 0). Folds with fewer than
    ``min_train`` training rows are skipped. Forests learn from the training cells, the validation
    cells serve patience. ``samples`` should be a written table. Rows without a label are left out.
    """
    features = safe_names(features) if guard else list(features)
    roles = folds.fold_roles(samples) if roles is None else roles
    plan = folds.fold_prepare(samples, features, label,
                              fixed.CORR_LIMIT if guard else float("inf"), fill_missing, roles)
    runs = folds.loco_folds(samples, min_train).where("is_run").select("hold")
    plans = settled(_fold_plan(plan.join(runs, "hold", "left_semi"), roles, features))
    if holds is not None:
        plans = plans.where(F.col("hold").isin(list(holds)))
    bounds = cut_points(samples, features)
    rows = settled(coded(samples, features, label, keys, bounds))
    low, high, n = rows.agg(F.min("_y"), F.max("_y"), F.count("*")).first()
    scale = Scale.of(low or 0.0, high or 0.0)
    if n * max(1, len(features)) <= local_cells:
        out = _together(rows, plans, list(settings), keys, bounds, scale)
    elif n * max(1, len(features)) <= (HELD_TIMES * local_cells if held_cells is None else held_cells):
        out = _held(rows, n, plans, list(settings), keys, bounds, scale)
    else:
        out = _spread(rows, plans, list(settings), keys, bounds, scale)
    return prediction_table(out)


def _output(samples: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(samples.dtypes)
    return ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "y_true double", "y_pred double",
                      "model string", "rounds int", "predict_ms double"])


def _together(rows: DataFrame, plans: DataFrame, settings: list[Settings], keys: Sequence[str],
              bounds: list[np.ndarray], scale: Scale) -> DataFrame:
    wide = len(bounds)
    holds = sorted(r["hold"] for r in plans.select("hold").collect())  # one name per fold
    names = ["_hold", "_model"]

    def run(_, data: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        columns_of = [*keys, "y_true", "y_pred", "model", "rounds", "predict_ms"]
        if plan.empty or data.empty:
            return pd.DataFrame(columns=columns_of)
        p, own = plan.iloc[0], settings[int(plan["_model"].iat[0])]
        data = data.sort_values(["_id", "_y"], kind="stable")
        codes = _filled(code_matrix(data["_codes"], wide), p["fill"], bounds)
        cell, y = data["cell_id"].to_numpy(), data["_y"].to_numpy()
        ids = data["_id"].to_numpy().view(np.uint64)
        test = cell == p["hold"]
        check = np.isin(cell, np.array(list(p["val"]), object)) & ~test
        base, trees = fit(codes, y, ids, np.flatnonzero(~test & ~check), np.flatnonzero(check),
                          np.array(list(p["kept"]), bool), own, scale)
        start = time.perf_counter()
        guess = predict(base, trees, codes[test], own)
        spent = 1000 * (time.perf_counter() - start) / max(1, int(test.sum()))
        return data.loc[test, list(keys)].assign(
            y_true=y[test], y_pred=guess, model=own.name, rounds=len(trees), predict_ms=spent)

    models = F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))).alias("_model")
    if not holds:
        return rows.limit(0).select(*keys, F.col("_y").alias("y_true"), F.col("_y").alias("y_pred"),
                                    F.lit("").alias("model"), F.lit(0).alias("rounds"),
                                    F.lit(0.0).alias("predict_ms"))
    dealt = rows.select("*", F.explode(F.array(*[F.lit(h) for h in holds])).alias("_hold")).select(
        "*", models)
    planned = plans.select("*", F.col("hold").alias("_hold")).select("*", models)
    parts = 4 * len(holds) * len(settings)  # so that few models share a partition
    return (dealt.repartition(parts, *names).groupBy(*names)
            .cogroup(planned.repartition(parts, *names).groupBy(*names))
            .applyInPandas(run, _output(rows, keys)))


def _held(rows: DataFrame, n: int, plans: DataFrame, settings: list[Settings], keys: Sequence[str],
          bounds: list[np.ndarray], scale: Scale) -> DataFrame:
    """:func:`_together` for models of many rows. The driver holds the names and masks of the folds."""
    wide = len(bounds)
    folds_of = [(p["hold"], list(p["val"]), list(p["kept"]), list(p["fill"]))
                for p in plans.orderBy("hold").collect()]
    if not folds_of:
        return _together(rows, plans, settings, keys, bounds, scale)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = None

        def fitted() -> pd.DataFrame:
            own = settings[number % len(settings)]
            base, trees = fit(codes, y, ids, np.flatnonzero(role == 0), np.flatnonzero(role == 1),
                              np.array(kept, bool), own, scale)
            start = time.perf_counter()
            guess = predict(base, trees, codes[role == 2], own)
            spent = 1000 * (time.perf_counter() - start) / max(1, len(guess))
            return pd.concat(tests).assign(y_true=y[role == 2], y_pred=guess, model=own.name,
                                           rounds=len(trees), predict_ms=spent)

        for pdf in batches:
            model = pdf["_model"].to_numpy()
            ends = np.flatnonzero(np.r_[model[1:] != model[:-1], True]) + 1 if len(model) else []
            start = 0
            for end in ends:
                some, start = pdf.iloc[start:end], end
                if int(model[end - 1]) != number:
                    if number is not None:
                        yield fitted()
                    number, at = int(model[end - 1]), 0
                    hold, val, kept, fill = folds_of[number // len(settings)]
                    codes = np.empty((n, wide), np.uint8, order="F")
                    y, ids = np.empty(n), np.empty(n, np.uint64)
                    role, tests = np.zeros(n, np.int8), []  # 0 train, 1 validation, 2 test
                cell, to = some["cell_id"].to_numpy(), at + len(some)
                codes[at:to] = _filled(code_matrix(some["_codes"], wide), fill, bounds)
                y[at:to], ids[at:to] = some["_y"], some["_id"].to_numpy().view(np.uint64)
                role[at:to] = np.where(cell == hold, 2, np.isin(cell, np.array(val, object)))
                tests.append(some.loc[cell == hold, list(keys)])
                at = to
        if number is not None:
            yield fitted()

    count = len(folds_of) * len(settings)  # each model gets all rows, in the order of their hashes
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_model"))
    return (dealt.repartition(4 * count, "_model").sortWithinPartitions("_model", "_id", "_y")
            .mapInPandas(run, _output(rows, keys)))


# ---------------------------------------------------------------- spread models

@dataclass(eq=False)
class Model:
    """A model that is being grown: what its tasks need to know."""
    hold: str
    val: set[str]
    kept: np.ndarray
    fill: list[float]
    settings: Settings
    base: float = 0.0
    done: list[dict[str, np.ndarray]] | None = None  # trees since the last written state
    trees: list[dict[str, np.ndarray]] | None = None
    growing: list[Tree] | None = None
    numbers: list[int] | None = None
    wait: Patience | None = None


def _spread(rows: DataFrame, plans: DataFrame, settings: list[Settings], keys: Sequence[str],
            bounds: list[np.ndarray], scale: Scale) -> DataFrame:
    """Grow all models over rows that stay where they are. The driver holds names, masks, splits."""
    wide = len(bounds)
    models = [Model(p["hold"], set(p["val"]), np.array(p["kept"], bool), list(p["fill"]), s,
                    done=[], trees=[]) for p in plans.orderBy("hold").collect() for s in settings]
    sums = {r["cell_id"]: (r["n"], r["s"]) for r in rows.groupBy("cell_id").agg(
        F.count("*").alias("n"), F.sum(F.rint((F.col("_y") - scale.low) / scale.unit)
                                       .cast("decimal(38,0)")).alias("s")).collect()}
    for m in models:
        own = [v for c, v in sums.items() if c != m.hold and c not in m.val]
        m.base = scale.mean(int(sum(s for _, s in own)), sum(n for n, _ in own)) if own else 0.0
        m.wait = Patience(m.settings.patience)
    state = rows.select("*", F.lit(None).cast("binary").alias("_guess"))
    active, turn, written = list(models), 0, []
    forest_step = 16  # trees of a forest that grow together
    while active:
        for m in active:
            m.numbers = ([turn] if m.settings.boost else
                         list(range(turn * forest_step, min((turn + 1) * forest_step,
                                                            m.settings.trees))))
            m.growing = [Tree() for _ in m.numbers]
        while any(t.open for m in active for t in m.growing):
            _level(state, active, models, bounds, scale)
        for m in active:
            made = [t.arrays(m.settings, scale.unit) for t in m.growing]
            m.trees += made
            if m.settings.boost:
                m.done += made
            m.growing = []
        turn += 1
        errors = _errors(state, [m for m in active if m.settings.boost], models, bounds, scale)
        rest = []
        for m in active:
            if m.settings.boost:
                if m.wait.goes_on(errors.get(models.index(m))) and turn < m.settings.trees:
                    rest.append(m)
            elif turn * forest_step < m.settings.trees:
                rest.append(m)
        active = rest
        if turn % WRITE_EVERY == 0 and active:
            state = settled(state.mapInPandas(_advance(list(models), bounds), state.schema))
            discard(*written)
            written = [state]
            for m in models:
                m.done = []
    for m in models:
        if m.settings.boost:
            m.trees = m.trees[:m.wait.rounds]
    out = rows.mapInPandas(_predicted(models, bounds, list(keys)), _output(rows, keys))
    return out


def _guesses(pdf: pd.DataFrame, models: Sequence[Model]) -> np.ndarray:
    """Written raw predictions, one row per model."""
    if pdf["_guess"].iat[0] is None:
        return np.repeat(np.array([m.base for m in models])[:, None], len(pdf), axis=1)
    return np.frombuffer(b"".join(pdf["_guess"]), float).reshape(len(pdf), -1).T.copy()


def _batches(batches: Iterator[pd.DataFrame], models: Sequence[Model],
             bounds: Sequence[np.ndarray]):
    """Per batch and model with work: model number, codes, label, cells, ids, current prediction."""
    for pdf in batches:
        if pdf.empty:
            continue
        raw, y = code_matrix(pdf["_codes"], len(bounds)), pdf["_y"].to_numpy()
        cell, ids = pdf["cell_id"].to_numpy(), pdf["_id"].to_numpy().view(np.uint64)
        guesses = _guesses(pdf, models)
        fills: dict[str, np.ndarray] = {}
        for k, m in enumerate(models):
            if m.hold not in fills:
                fills = {m.hold: _filled(raw, m.fill, bounds)}
            codes = fills[m.hold]
            for tree in m.done:
                guesses[k] += tree["value"][walk(tree, codes)]
            yield pdf, k, codes, y, cell, ids, guesses


def _level(state: DataFrame, active: list[Model], models: list[Model],
           bounds: Sequence[np.ndarray], scale: Scale) -> None:
    """One job: the best split of every open node of every model."""
    wide, every = len(bounds), list(models)
    at_work = {models.index(m) for m in active if any(t.open for t in m.growing)}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, k, codes, y, cell, ids, guesses in _batches(batches, every, bounds):
            if k not in at_work:
                continue
            m = every[k]
            train = np.flatnonzero(~np.isin(cell, np.array([m.hold, *m.val], object)))
            counts = [weights(ids[train], m.settings, t) for t in m.numbers]
            slot, row, weight = _slots(m.growing, codes, [train[w > 0] for w in counts],
                                       [w[w > 0] for w in counts])
            guess = guesses[k] if m.settings.boost else np.full(len(y), m.base)
            found = cells(slot, row, weight, codes, scale.gradient(guess, y, m.settings))
            node = found[0] // (wide * BINS)
            for s in np.unique(node).tolist():
                own = node == s
                yield pd.DataFrame({"model": [k], "slot": [s], "cells": [
                    np.concatenate([x[own] for x in found]).astype(np.int64).tobytes()]})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        k, s = int(pdf["model"].iat[0]), int(pdf["slot"].iat[0])
        m = every[k]
        parts = [np.frombuffer(b, np.int64).reshape(3, -1) for b in pdf["cells"]]
        found = _added(*np.concatenate(parts, axis=1))
        owner = [i for i, t in enumerate(m.growing) for _ in t.open][s]
        mask = columns(m.kept, m.settings, m.numbers[owner])
        allowed = np.zeros((s + 1, wide), bool)
        allowed[s] = mask
        split = best_splits(found, wide, allowed, m.settings.l2, m.settings.min_rows)
        return pd.DataFrame({"model": [k], "split": [split[0].tolist()]})

    sums = state.mapInPandas(add, "model int, slot int, cells binary")
    splits: dict[int, list] = {k: [] for k in at_work}
    for r in sums.groupBy("model", "slot").applyInPandas(
            best, "model int, split array<double>").collect():  # one row per open node
        splits[r["model"]].append(r["split"])
    for k in at_work:
        learn_all(models[k].growing, np.array(splits[k]).reshape(-1, len(SPLIT)),
                  models[k].settings)


def _errors(state: DataFrame, active: list[Model], models: list[Model],
            bounds: Sequence[np.ndarray], scale: Scale) -> dict[int, int]:
    """Validation error per model; models without validation rows are absent."""
    every, at_work = list(models), {models.index(m) for m in active}
    if not at_work:
        return {}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, k, _, y, cell, _, guesses in _batches(batches, every, bounds):
            m = every[k]
            check = np.isin(cell, np.array([*m.val], object)) & (cell != m.hold)
            if k in at_work and check.any():
                yield pd.DataFrame({"model": [k], "e": [scale.error(guesses[k][check], y[check])]})

    return {r["model"]: int(r["e"]) for r in state.mapInPandas(add, "model int, e long")
            .groupBy("model").agg(F.sum("e").alias("e")).collect()}


def _advance(models: list[Model], bounds: Sequence[np.ndarray]):
    """Predictions up to the last finished round, written with the rows."""
    every = [replace(m, growing=None, trees=None) for m in models]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, k, _, _, _, _, guesses in _batches(batches, every, bounds):
            if k == len(every) - 1:
                yield pdf.assign(_guess=[r.tobytes() for r in np.ascontiguousarray(guesses.T)])
    return add


def _predicted(models: list[Model], bounds: Sequence[np.ndarray], keys: list[str]):
    every = list(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, cell = code_matrix(pdf["_codes"], len(bounds)), pdf["cell_id"].to_numpy()
            for m in every:
                own = cell == m.hold
                if own.any():
                    start = time.perf_counter()
                    guess = predict(m.base, m.trees, _filled(raw[own], m.fill, bounds), m.settings)
                    spent = 1000 * (time.perf_counter() - start) / int(own.sum())
                    yield pdf.loc[own, keys].assign(
                        y_true=pdf.loc[own, "_y"], y_pred=guess, model=m.settings.name,
                        rounds=len(m.trees), predict_ms=spent)
    return run
