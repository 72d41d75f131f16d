"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from voltarc.llm import queries, spelling

A_TO_Z = {i: i + 32 for i in range(65, 91)}


def counted(docs, least=7, times=2, misspell=31):
    c = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if misspell and h % misspell == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= times}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(words, near_of):
    form = {}
    for w, close in near_of.items():
        if close:
            best = min(close, key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out[w] = (w, f, root, words[w], len(near_of[w]), words[f] if f else None)
    return out


def near_by_pairs(words):
    return {w: [x for x in words if one_edit(w, x)] for w in words}


def near_by_gaps(words):
    """By looking up every deletion and every wildcard."""
    gaps, near = {}, {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            gaps.setdefault((w[:k], w[k + 1:]), []).append(w)
    for (a, b), own in gaps.items():
        for w in own:
            near[w] |= set(own) - {w}
            if a + b in words:
                near[w].add(a + b)
                near[a + b].add(w)
    return near


def test_query_equals_brute_force(spark):
    folder = f"{DATA}/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet")
            .select("doc_id", "text").collect()]
    words = counted(docs)
    got = {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n)
           for r in queries.op11_spelling_variants(spark, folder).collect()}
    assert got == brute(words, near_by_gaps(words))


@pytest.mark.parametrize("tile", [2, 5, spelling.TILE])
def test_tiles_lose_nothing(spark, tile):
    """Short alphabets, long words, words that start or end alike: every pair, each once."""
    rng = np.random.default_rng(tile)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(1, 8)))): int(rng.integers(1, 9))
             for _ in range(160)}
    words |= {"stem" + "".join(rng.choice(list("xy"), 4)): int(rng.integers(1, 200))
              for _ in range(60)}
    long = "lmno" * 100
    words |= {long: 50, long[:200] + "Z" + long[201:]: 4, long[1:]: 500, long + "m": 1, "日本語": 7,
              "日本": 70, "😀a": 2, "😀": 30}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n)
           for r in spelling.variants(df, tile=tile).collect()}
    assert got == brute(words, near_by_pairs(words))


def test_chain_of_forms(spark):
    words = [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaabbbb", 10000),
             ("zzzzzzz", 5)]
    got = {r.word: r.root for r in spelling.variants(
        spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {"aaabbbb", "zzzzzzz"} and got["zzzzzzz"] == "zzzzzzz"


def test_edges(spark):
    rows = [(1, "Übermut übermut ÜBERMUT abcdefg ABCDEFG"), (1, "abcdefg"), (2, None), (3, ""),
            (None, "abcdefg hijklmno"), (4, "hijklmno" * 40_000), (4, "hijklmno" * 40_000),
            (5, "1234567 short abcdefgh2abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("mine") for c in ("word", "n", "_id", "_text")})
    for k in (0, 1, 31):
        got = {r.word: r.n for r in spelling.count_words(docs, misspell=k).collect()}
        assert got == counted(rows, misspell=k)
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0
    assert spelling.variants(spelling.count_words(docs)).count() == len(counted(rows, misspell=0))
    with pytest.raises(ValueError):
        spelling.variants(docs.select("word", "n"), ratio=1)
