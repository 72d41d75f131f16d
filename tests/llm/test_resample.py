"""Importance resampling against a plain restatement, and its radix sort against sorting."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from voltarc.llm import queries, resample
from voltarc.llm.common import settle

A_TO_Z = {i: i + 32 for i in range(65, 91)}


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))
    both = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(g.encode()) % 10_000 for g in both]


def plain(docs, items):
    """doc_id -> n_features, weight, score, rank"""
    own = [(i, *grams(t)) for i, t in docs]
    s, t = [0] * 10_000, [0] * 10_000
    for _, _, at in own:
        for b in at:
            s[b] += 1
    for x in items:
        for b in grams(x)[1]:
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (S + 10_000.0)
                                       / ((float(s[b]) + 1) * (T + 10_000.0))))
            for b in range(10_000)]
    out, able = {}, []
    for i, n, at in own:
        weight = sum(gain[b] for b in at) // len(at) if at else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(at), weight, score, None]
        if n >= 20:
            able.append((-score, i is None, i or 0, i))
    for k, (*_, i) in enumerate(sorted(able)[:len(able) * 25 // 100]):
        out[i][3] = k + 1
    return out


def test_query_equals_restatement(spark):
    folder = f"{DATA}/sf0.01"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(
        f"{folder}/{name}.parquet").select(*c).collect()]
    want = plain(read("documents", "doc_id", "text"), [x for x, in read("benchmark", "text")])
    got = {r.doc_id: [r.n_features, r.weight, r.score, r.rank]
           for r in queries.op13_resample(spark, folder).collect()}
    assert got == want


def test_edges(spark):
    long = " ".join(f"w{i % 97} {'x' * (i % 60)}y" for i in range(30_000))
    rows = [(3, "Ab cd " * 15), (-2**63, "ab CD " * 15), (2**63 - 1, "é ab " * 15), (None, "zz " * 30),
            (5, None), (6, ""), (7, "two words"), (8, long), (9, "!!! \x00"), (10, "q1 " * 19),
            *[(100 + k, "the same text in every row of these " * 4) for k in range(20)]]
    items = ["ab cd ab", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(x,) for x in items], "text string")
    for block in (None, 7):
        got = {r.doc_id: [r.n_features, r.weight, r.score, r.rank]
               for r in resample.resampled(docs, target, block=block).collect()}
        assert got == plain(rows, items)
    wide = docs.withColumns({c: F.lit("mine") for c in ("rank", "_row", "hi", "pos", "bucket", "n")})
    out = resample.resampled(wide, target)
    assert out.columns == ["doc_id", "_row", "hi", "pos", "bucket", "n", *resample.RESULTS]
    assert {r.doc_id: r.rank for r in out.collect()} == {i: v[3] for i, v in got.items()}
    assert resample.resampled(docs.limit(0), target).count() == 0
    assert resample.resampled(docs, target.limit(0)).count() == len(rows)
    twice = resample.resampled(docs.union(docs), target)
    ranks = sorted(r.rank for r in twice.where("rank is not null").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 2 * 25 * 25 // 100
    texts = resample.drawn(docs, target).orderBy("rank").collect()
    assert [r.doc_id for r in texts] == sorted((i for i in got if got[i][3]),
                                               key=lambda i: got[i][3])
    assert all((r.doc_id, r.text) in rows for r in texts)


def test_ranks_follow_the_best_scores(spark):
    """Documents that look like the target are drawn before others, up to the noise."""
    rng = np.random.default_rng(4)
    near = [f"n{i}" for i in range(50)]
    far = [f"f{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(near if i < 200 else far, 40))) for i in range(800)]
    target = spark.createDataFrame([(" ".join(rng.choice(near, 40)),) for _ in range(50)],
                                   "text string")
    got = resample.resampled(spark.createDataFrame(rows, "doc_id long, text string"), target)
    taken = [r.doc_id for r in got.where("rank is not null").collect()]
    assert len(taken) == 200 and sum(i < 200 for i in taken) > 130


@pytest.mark.parametrize("low_bits,high_bits", [(0, 0), (5, 3), (11, 17), (64, 20), (63, 1)])
def test_radix_sort(spark, low_bits, high_bits):
    rng = np.random.default_rng(low_bits)
    keys = [(int(rng.integers(0, 2**high_bits)), int(rng.integers(0, 2**63)) % 2**low_bits * (
        1 if low_bits < 64 else 2)) for _ in range(300)]
    rows = [(i, h, lo if lo < 2**63 else lo - 2**64, 5 * i) for i, (h, lo) in enumerate(keys)]
    df = settle(spark.createDataFrame(rows, "row long, hi long, lo long, pos long"), "test-keys")
    got = resample.radix_sorted(df, low_bits, high_bits, block=64, digit_bits=9).collect()
    assert sorted(r.pos for r in got) == list(range(300))
    order = [r.row for r in sorted(got, key=lambda r: r.pos)]
    assert order == sorted(range(300), key=lambda i: (keys[i], i))
