"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over word and word-prefix features;
each model also sees the probabilities of the categories before it. In training those are
out-of-fold predictions, so a later model learns from probabilities as uncertain as it will meet.

The models are fitted on a bounded sample of labelled documents (``SAMPLE`` ids that documents
have, chosen by a hash of the id, half of them positive in some category if there are as many; of
the rows of an id, one). Rows weigh the inverse of the share of their half that was chosen, so a
probability means the same however many labels there are. The sample is written once. What is
chosen from its features, ``FEATURES`` per category, and its rows over them are small whatever the
size of the corpus. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import discard, others, settle, shielded

SAMPLE = 12_000  # labelled documents that are learned from, at most
SAMPLE_PARTS = 32  # tasks that count the sample's features, so that a worker holds few texts' counts
FEATURES = 1_000  # features per category, at most
LEAST_DOCS = 3  # sample documents that must hold a feature
LEAST_LIFT = 2.0  # times the category's share that a feature's documents must have
PREFIXES = (3, 4, 5, 6)
FOLDS = 4
ROUNDS = 300
STEP = 1.0
PENALTY = 0.3
REJECT_AT = 0.35

_WORD = re.compile(r"[^\W\d_]+")


def features(token: str) -> list[str]:
    """Words of a lower-cased token and their prefixes, the latter marked with ``*``."""
    out = []
    for w in _WORD.findall(token):
        out.append(w)
        out += [w[:n] + "*" for n in PREFIXES if n < len(w)]
    return out


def document_features(text: str | None) -> set[str]:
    found: set[str] = set()
    for token in set((text or "").lower().split()):
        found.update(features(token))
    return found


@dataclass
class Chain:
    categories: list[str]
    index: dict[str, int]  # feature -> column
    weights: list[np.ndarray]  # per category: columns, then earlier probabilities
    biases: list[float]
    _seen: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def columns(self, text: str | None) -> list[int]:
        seen, index, found = self._seen, self.index, set()
        for token in set((text or "").lower().split()):
            own = seen.get(token)
            if own is None:
                own = tuple(index[f] for f in features(token) if f in index)
                if len(seen) >= 200_000:
                    seen.clear()
                if len(token) <= 64:
                    seen[token] = own
            if own:
                found.update(own)
        return sorted(found)

    def predict(self, columns: list[int]) -> list[float]:
        m, out = len(self.index), []
        for w, b in zip(self.weights, self.biases):
            z = b + sum(w[c] for c in columns) + sum(p * w[m + k] for k, p in enumerate(out))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def _fit(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, m: int,
         weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by full gradient steps. rows, cols: where features are set;
    extra: one column per earlier category; weights: of the rows, 1 on average."""
    n, k = len(y), extra.shape[1]
    w, mean = np.zeros(m + k), ((weights * y).sum() + 0.5) / (weights.sum() + 1)
    b = float(np.log(mean / (1 - mean)))
    if n == 0 or y.min() == y.max():
        return w, b
    # Steps shrink per column with what the column has seen, so rare columns move as far as others.
    sw, sb = np.full(m + k, 1e-10), 1e-10
    for _ in range(ROUNDS):
        z = np.bincount(rows, w[cols], n) + extra @ w[m:] + b
        r = weights * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = np.concatenate([np.bincount(cols, r[rows], m), r @ extra]) + PENALTY / n * w
        gb = float(r.sum())
        sw, sb = sw + g * g, sb + gb * gb
        w, b = w - STEP * g / np.sqrt(sw), b - STEP * gb / np.sqrt(sb)
    return w, b


def train_chain(index: dict[str, int], sets: list[list[int]], labels: np.ndarray,
                categories: list[str], row_weights: np.ndarray | None = None) -> Chain:
    n, m = len(sets), len(index)
    share = np.ones(n) if row_weights is None or not n else row_weights / row_weights.mean()
    rows = np.repeat(np.arange(n), [len(s) for s in sets]).astype(np.int64)
    cols = np.array([c for s in sets for c in s], np.int64)
    fold = np.arange(n) % FOLDS
    extra, weights, biases = np.zeros((n, 0)), [], []
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        w, b = _fit(rows, cols, extra, y, m, share)
        weights.append(w)
        biases.append(b)
        if c + 1 == len(categories):
            break
        unseen = np.zeros(n)
        for f in range(FOLDS):
            train = fold != f
            place = np.cumsum(train) - 1
            inside = train[rows]
            wf, bf = _fit(place[rows[inside]], cols[inside], extra[train], y[train], m,
                          share[train])
            z = np.bincount(rows, wf[cols], n) + extra @ wf[m:] + bf
            unseen[~train] = (1 / (1 + np.exp(-np.clip(z, -40, 40))))[~train]
        extra = np.column_stack([extra, unseen])
    return Chain(categories, index, weights, biases)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str = "doc_id",
        text: str = "text", sample: int = SAMPLE) -> Chain:
    """Learn the chain. ``labels``: the id and one 0/1 column per category; NULL counts as 0, of
    several rows of an id the greatest value holds, labels without a document are passed over. Of
    documents with one id, the text of least hash is learned. Without labelled texts the chain
    predicts from the prior alone."""
    ids = docs.select(F.col(f"`{doc_id}`").alias("_id"))
    marks = labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(
        F.col(f"`{doc_id}`").alias("_id")).agg(*[
            F.max(F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("int")).alias(f"_y{k}")
            for k, c in enumerate(categories)]).join(ids, "_id", "left_semi")
    ys = [f"_y{k}" for k in range(len(categories))]
    some = F.greatest(*ys, F.lit(0)) > 0
    order = [F.xxhash64("_id"), F.col("_id")]
    marks = settle(marks, "toxic-labels")
    n_some, n_all = marks.agg(F.count_if(some), F.count("*")).first()
    halves = []
    for half, limit, held in ((some, sample // 2, n_some),
                              (~some, sample - sample // 2, n_all - n_some)):
        halves.append(marks.where(half).orderBy(*order).limit(limit)
                      .withColumn("_w", F.lit(max(held / max(limit, 1), 1.0))))
    text_of = F.col(f"`{text}`")
    rows = settle(
        docs.select(F.col(f"`{doc_id}`").alias("_id"), F.struct(
            text_of.isNull().alias("none"), F.xxhash64(text_of).alias("hash"),
            text_of.alias("text")).alias("_t"))
        .join(F.broadcast(halves[0].union(halves[1])), "_id")  # at most ``sample`` rows
        .repartition(SAMPLE_PARTS, "_id").groupBy("_id", "_w", *ys).agg(F.min("_t").alias("_t"))
        .select("_id", "_w", F.col("_t.text").alias("_text"), F.array(*ys).alias("_y")),
        "toxic-sample")

    width = len(categories)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[Counter] = [Counter() for _ in range(width + 1)]
            for t, y in zip(pdf["_text"], pdf["_y"]):
                found = document_features(t)
                held[width].update(found)
                for k in range(width):
                    if y[k]:
                        held[k].update(found)
            names = list(held[width])
            if not names:  # nothing but NULL and empty texts
                continue
            yield pd.DataFrame({"f": pd.Series(names, dtype=object), "n": [held[width][f] for f in names],
                                "p": [[held[k][f] for k in range(width)] for f in names]})

    counts = rows.mapInPandas(count, "f string, n long, p array<long>")
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("_y", F.lit(k))).alias(y)
                                                 for k, y in enumerate(ys)]).first()
    n = totals["n"] or 0
    summed = (counts.groupBy("f").agg(F.sum("n").alias("n"), *[
        F.sum(F.get("p", F.lit(k))).alias(y) for k, y in enumerate(ys)])
        .where(F.col("n") >= LEAST_DOCS))
    index: dict[str, int] = {}
    scores = []
    for y in ys:  # chi-square of the feature against the category, where it speaks for it
        pos = float(totals[y] or 0)
        expected = F.col("n") * (pos / max(n, 1))
        scores.append(F.when(F.col(y) >= LEAST_LIFT * expected, (F.col(y) - expected)**2 / (
            F.greatest(expected, F.lit(0.5)) * max(1 - pos / max(n, 1), 1e-3))))
    ranked = summed.select("f", *[s.alias(f"_s{k}") for k, s in enumerate(scores)])
    for k in range(width):
        for r in ranked.where(f"_s{k} is not null").orderBy(F.desc(f"_s{k}"), "f").select("f").limit(FEATURES).collect():
            index.setdefault(r["f"], len(index))

    empty = Chain(categories, index, [], [])

    def pick(texts: pd.Series) -> pd.Series:
        return pd.Series([empty.columns(t) for t in texts])

    got = (rows.select("_id", F.pandas_udf(pick, "array<int>")("_text").alias("c"), "_y", "_w")
           .orderBy(*order).collect())  # at most ``sample`` rows of chosen features
    discard(marks, rows)
    return train_chain(index, [list(r["c"]) for r in got],
                       np.array([list(r["_y"]) for r in got]).reshape(len(got), width), categories,
                       np.array([r["_w"] for r in got], float))


@shielded
def classify(docs: DataFrame, chain: Chain, text: str = "text", toxic: str | None = None,
             threshold: float = REJECT_AT) -> DataFrame:
    """Add ``p_<category>`` for each category and ``rejected`` (probability of category ``toxic``,
    by default the last, of at least ``threshold``).

    A NULL or empty text has no features and gets the probabilities of none. Whole texts are read;
    a feature counts once however often it occurs. Equal rows get equal results and stay repeated,
    ids are not read, an empty table stays empty, input columns with result names are replaced.
    """
    names = [f"p_{c}" for c in chain.categories]
    toxic = toxic or chain.categories[-1]
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by FEATURES per category

    def score(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.predict(model.columns(t)) for t in texts], columns=names)

    keep = others(docs, [*names, "rejected"])
    schema = ", ".join(f"`{x}` double" for x in names)
    return (docs.select(*keep, F.pandas_udf(score, schema)(F.col(f"`{text}`")).alias("_chain"))
            .select(*keep, *[F.col(f"_chain.`{x}`").alias(x) for x in names],
                    (F.col(f"_chain.`p_{toxic}`") >= threshold).alias("rejected")))
