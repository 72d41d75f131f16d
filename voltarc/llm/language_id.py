"""Language identification by error-correcting output codes.

Each language gets a codeword. For each bit, a binary classifier over byte n-grams tells the
languages whose bit is 1 from those whose bit is 0: it is a likelihood-ratio model whose weights
come from n-gram counts per language. A text's language is the codeword with the least loss, where
a bit that was predicted with a large margin weighs more than one near the border.

Counts are gathered from every training text; a batch sends one row of ``BUCKETS`` counts per
language, so nothing grows with the texts but the number of such rows. The model has languages x
buckets numbers. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import others, shielded

ORDERS = (2, 3, 4)
PER_ORDER = 8192
BUCKETS = PER_ORDER * len(ORDERS)
EXHAUSTIVE = 7  # languages up to which every way to split them in two is a bit
SHARPNESS = 12.0  # loss per mean log-ratio of an n-gram
AMBIGUOUS_BELOW = 0.8  # score under which a prediction is flagged
UNKNOWN = "und"
RESULTS = ["lang_pred", "score", "ambiguous"]

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def counts(text: str) -> np.ndarray:
    """How often each bucket of byte n-grams occurs in a text."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for k, n in enumerate(ORDERS):
        if len(b) < n:
            continue
        h = np.zeros(len(b) - n + 1, np.uint32)
        for j in range(n):
            h = (h + b[j:len(b) - n + 1 + j]) * _FACTORS[j]
            h ^= h >> np.uint32(15)
        out[k * PER_ORDER:(k + 1) * PER_ORDER] = np.bincount(h % PER_ORDER, minlength=PER_ORDER)
    return out


def codewords(languages: int) -> np.ndarray:
    """+1 / -1, a row per language. Few languages: every split into two. More: of many random
    codes the one whose closest two rows are furthest apart."""
    if languages <= EXHAUSTIVE:
        bits = 2**(languages - 1) - 1
        rows = [[1] * bits]
        for i in range(1, languages):
            run = 2**(languages - 1 - i)
            rows.append([1 if (j // run) % 2 else -1 for j in range(bits)])
        return np.array(rows[:languages]).reshape(languages, bits)
    rng, bits = np.random.default_rng(7), 10 * int(np.ceil(np.log2(languages)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (languages, bits))
        agree = code @ code.T - 2 * bits * np.eye(languages, dtype=int)
        if (gap := -agree.max()) > far or best is None:
            best, far = code, gap
    return best


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        c = counts(text).astype(np.float32)
        margins = SHARPNESS * (c @ self.weights) / max(1.0, float(c.sum()))
        loss = np.logaddexp(0, -self.code * margins).sum(axis=1)
        p = np.exp(loss.min() - loss)
        best = int(loss.argmin())  # a tie goes to the first in alphabetical order
        score = float(p[best] / p.sum())
        return self.languages[best], score, score < AMBIGUOUS_BELOW


def from_counts(table: dict[str, np.ndarray]) -> Codes:
    languages = sorted(table)
    code = codewords(len(languages))
    if not languages:
        return Codes([], np.zeros((0, 0)), np.zeros((BUCKETS, 0), np.float32))
    held = np.array([table[x] for x in languages], float) + 0.5
    share = held.reshape(len(languages), len(ORDERS), PER_ORDER)
    share = (share / share.sum(axis=2, keepdims=True)).reshape(len(languages), BUCKETS)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for k in range(code.shape[1]):
        one, zero = share[code[:, k] > 0], share[code[:, k] < 0]
        if len(one) and len(zero):
            weights[:, k] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
    return Codes(languages, code, weights)


FAN_IN = 64  # sums of one language that a task adds up


def _rows(langs: list[str], sums: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"_lang": pd.Series(langs, dtype=object),
                         "c": pd.Series(sums, dtype=object)})


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Codes:
    """Learn from every row with a text and a language."""
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for t, x in zip(pdf["_text"], pdf["_lang"]):
                c = counts(t)
                if x in held:
                    held[x] += c
                else:
                    held[x] = c
        yield _rows(list(held), [c.tobytes() for c in held.values()])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int64) for c in pdf["c"]], axis=0)
        return _rows([pdf["_lang"].iat[0]], [total.tobytes()]).assign(_at=pdf["_at"].iat[0])

    rows = (docs.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang"))
            .where("_text is not null and _lang is not null"))
    part = rows.mapInPandas(gather, "_lang string, c binary").withColumn(
        "_at", F.spark_partition_id())
    tasks = rows.rdd.getNumPartitions()
    while True:  # levels of sums, as many as the number of tasks asks for
        part = (part.withColumn("_at", F.floor(F.col("_at") / FAN_IN).cast("int"))
                .groupBy("_lang", "_at").applyInPandas(add, "_lang string, c binary, _at int"))
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    return from_counts({r["_lang"]: np.frombuffer(bytes(r["c"]), np.int64)
                        for r in part.collect()})  # a row per language


@shielded
def identify(docs: DataFrame, model: Codes, text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous.

    A NULL text or one without a letter is ``und`` with score 0, as is every text if the model has
    learned from nothing. Equal texts get equal results; repeated rows stay, ids are not read, an
    empty table stays empty, input columns with result names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers

    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=RESULTS)

    keep = others(docs, RESULTS)
    found = F.pandas_udf(predict, "lang_pred string, score double, ambiguous boolean")
    return (docs.select(*keep, found(F.col(f"`{text}`")).alias("_id"))
            .select(*keep, *[F.col(f"_id.{r}").alias(r) for r in RESULTS]))
