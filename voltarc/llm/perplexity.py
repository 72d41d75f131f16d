"""Quality by perplexity under an interpolated modified Kneser-Ney model of word n-grams.

The model is learned from trusted texts. A document passes if its perplexity is at most a quantile of
the trusted documents' perplexities in its language. A trusted text is scored without its own counts,
as it would else know itself by heart.

n-grams are strings of ``ORDER`` words, after ``ORDER - 1`` start marks and before an end mark. Words
are what white space separates; characters of scripts of East Asia are words by themselves.

Most n-grams of words are rare, so counts and requests are as many as the words of the corpus. They
move as blobs of numbered words, known by 64-bit hashes, and a slice of all bigrams at a time: the
documents are read again for each slice, and the disk holds the requests of one. Documents are dealt
into batches by a hash. For each order from the highest down, batches ask for their n-grams, these
requests meet the counts in parts dealt by a hash of the n-gram, and a part answers each batch in the
order of the hashes, and hands what it counted to the order below. At last a batch's texts meet its
answers. ``SLICES`` does not depend on the input, so work and disk grow with it in proportion.

``count_grams`` and ``log_probabilities`` give the same model as tables of n-grams of characters or
words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltarc.functions.quantiles import group_quantiles
from voltarc.llm.common import discard, settle, shielded

ORDER = 3
BATCH_BYTES = 4 << 20  # of text in a batch, about
PARTITION_BYTES = 256 << 20  # of text in a task that goes through batches, about
PACK_BYTES = 32 << 20  # of rows that a task holds before it packs them
PORTION = 200_000  # characters that are numbered at a time, so that they stay in a core's cache
PART_BYTES = 6 << 20  # of text whose n-grams meet in a part, about
HELD = 1 << 20  # n-grams that a task holds before it packs them
MERGED = 1 << 20  # n-grams of blobs that a task holds before it merges them
SLICES = 7  # of all bigrams, and with them of the n-grams that begin or end in them
WORD_SLICES = 2
SCORE_SLICES = 4  # of the batches
BROADCAST_IDS = 2_000_000
QUANTILE = 0.995
RESULTS = ["n_grams", "perplexity", "threshold", "kept"]

_EAST = "⺀-鿿豈-﫿\U00020000-\U0003ffff"
_WORDS = re.compile(f"[{_EAST}]|[^\\s{_EAST}]+")


@dataclass(frozen=True)
class Units:
    """What n-grams are made of; a separator and the marks are no part of any unit."""
    order: int
    separator: str
    start: str
    end: str

    def split(self, text: str) -> list[str]:
        return _WORDS.findall(text) if self.separator else list(text)

    def first(self, gram: Column | str, k: int) -> Column:
        return F.substring_index(gram, self.separator, k) if self.separator else F.substring(gram, 1, k)

    def last(self, gram: Column | str, k: int) -> Column:
        if self.separator:
            return F.substring_index(gram, self.separator, -k)
        return F.substring(gram, -k, k)


CHARACTERS = Units(4, "", "\x02", "\x03")
WORDS = Units(ORDER, " ", "\t", "\n")


class _Grams:
    """The units of some texts in a row, numbered: ``ids[k - 1][i]`` is the k-gram that ends at unit
    i, ``at`` the units that are no start marks and ``which`` the text of each of these."""

    def __init__(self, texts: list[str], units: Units):
        lead = [units.start] * (units.order - 1)
        self.units, self.flat, sizes = units, [], []
        for t in texts:
            own = units.split(t)
            self.flat += lead + own + [units.end]
            sizes.append(len(own) + 1)
        self.which = np.repeat(np.arange(len(texts)), sizes)
        self.at = np.arange(len(self.which)) + (self.which + 1) * len(lead)
        codes, base = pd.factorize(np.array(self.flat, object))
        self.ids = [codes.astype(np.int64)]
        for _ in lead:
            before = np.concatenate([[0], self.ids[-1][:-1]])
            self.ids.append(np.unique(before * len(base) + codes, return_inverse=True)[1])

    def names(self, ends: np.ndarray, k: int) -> list[str]:
        join, flat = self.units.separator.join, self.flat
        return [join(flat[i - k + 1:i + 1]) for i in ends.tolist()]


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of about PORTION characters; a longer text is one by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PORTION:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def count_grams(texts: DataFrame, units: Units = CHARACTERS) -> DataFrame:
    """gram, n over all rows of ``_text``; combined per batch, then by group."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, total = list(pdf["_text"]), Counter()
            for a, b in _portions(texts):
                grams = _Grams(texts[a:b], units)
                _, first, n = np.unique(grams.ids[-1][grams.at], return_index=True,
                                        return_counts=True)
                total.update(dict(zip(grams.names(grams.at[first], units.order), n.tolist())))
            yield pd.DataFrame({"gram": pd.Series(list(total), dtype=object),
                                "n": pd.Series(list(total.values()), dtype="int64")})

    return (texts.select("_text").where("_text is not null")
            .mapInPandas(counted, "gram string, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def tables(counts: DataFrame, units: Units = CHARACTERS) -> list[DataFrame]:
    """For k = 1 .. order: gram, n, where n is the count for k = order and else the number of
    different units that stand before the gram."""
    out = [counts]
    for k in range(units.order - 1, 0, -1):
        out.append(settle(out[-1].groupBy(units.last("gram", k).alias("gram"))
                          .agg(F.count("*").alias("n")), f"kn-{k}"))
    return out[::-1]


def _discount(times: list[int]) -> list[float]:
    """D1, D2, D3+ from how many n-grams of an order have the counts 1 to 4; where these give none
    between 0 and the count, half the count, so that no probability is 0."""
    n1, n2, n3, n4 = times
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [i - (i + 1) * y * b / a if a else 0.0
         for i, (a, b) in enumerate([(n1, n2), (n2, n3), (n3, n4)], 1)]
    return [x if 0 < x <= i else i / 2 for i, x in enumerate(d, 1)]


def _discounts(tables_: list[DataFrame]) -> list[list[float]]:
    return [_discount([x or 0 for x in t.agg(*[
        F.sum((F.col("n") == i).cast("long")) for i in range(1, 5)]).first()]) for t in tables_]


class Model:
    """``table``: gram of any order below or at the highest, n of its own, and as a context the
    total t and the taken-off mass d of what follows. The rest are a few numbers."""

    def __init__(self, counts: DataFrame, units: Units = CHARACTERS):
        by_order = tables(counts, units)
        self.units, self.discounts = units, _discounts(by_order)
        n, parts = F.col("n"), []
        for k, (t, d) in enumerate(zip(by_order, self.discounts), 1):
            sums = [F.sum(n).alias("t"),
                    F.sum(F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])).alias("d")]
            parts.append(t.select("gram", "n", F.lit(None).cast("long").alias("t"),
                                  F.lit(None).cast("double").alias("d")))
            if k == 1:  # the one empty context
                self.letters = t.count() + 1  # and one for every unseen unit
                self.t1, self.d1 = [x or 0 for x in t.agg(*sums).first()]
            else:
                parts.append(t.groupBy(units.first("gram", k - 1).alias("gram")).agg(*sums)
                             .select("gram", F.lit(None).cast("long").alias("n"), "t", "d"))
        table = parts[0]
        for part in parts[1:]:
            table = table.union(part)
        self.table = table.groupBy("gram").agg(*[F.max(c).alias(c) for c in "ntd"])

    def scorer(self) -> Scorer:
        return Scorer(self.units, self.discounts, self.letters, self.t1, self.d1)


@dataclass
class Scorer:
    units: Units
    discounts: list[list[float]]
    letters: int
    t1: int
    d1: float

    def values(self, k: int, answers: np.ndarray) -> np.ndarray:
        """n, t and d of k-grams from n, the rest of t, and how many followers have the counts 1, 2, more."""
        out = np.zeros((len(answers), 3))
        out[:, 0] = answers[:, 0]
        if k < self.units.order:
            out[:, 1] = answers[:, 1] + answers[:, 2:] @ np.arange(1, 4)
            out[:, 2] = answers[:, 2:] @ np.array(self.discounts[k])
        return out

    def logs(self, at: np.ndarray, which: np.ndarray, ids: list[np.ndarray],
             looked: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        """Log-probability of each unit ``at`` a place, of text ``which``. ``ids[k - 1]`` numbers the
        k-gram that ends at a place, ``looked[k - 1]`` has n, t and d of each number. A text that
        ``own`` marks is taken out of the counts, an n-gram that only it holds also out of the counts
        of shorter ones."""
        out, mine = np.empty(len(at)), own[which] > 0
        for known in (False, True):
            pick = mine == known
            out[pick] = self._logs(at[pick], which[pick], ids, looked, known)
        return out

    def _logs(self, at: np.ndarray, which: np.ndarray, ids: list[np.ndarray],
              looked: list[np.ndarray], known: bool) -> np.ndarray:
        levels, gone, first_above = [], None, None
        for k in range(self.units.order, 0, -1):
            d = np.array([0.0, *self.discounts[k - 1]])
            off = lambda n: d[np.minimum(n, 3).astype(np.int64)]  # noqa: B023, E731
            gram = ids[k - 1][at]
            if k > 1:
                context = ids[k - 2][at - 1]
                t, mass = looked[k - 2][context, 1], looked[k - 2][context, 2]
            else:
                t, mass = np.full(len(at), float(self.t1)), self.d1
            if not known:
                n = looked[k - 1][gram, 0]
                levels.append((n - off(n), t, mass))
                continue
            _, first, place, times = np.unique(which * len(looked[k - 1]) + gram, return_index=True,
                                               return_inverse=True, return_counts=True)
            mine = times if gone is None else np.bincount(place[first_above], gone, len(first))
            n = looked[k - 1][gram[first], 0]
            left = np.maximum(n - mine, 0)
            group = which if k == 1 else np.unique(which * len(looked[k - 2]) + context,
                                                   return_inverse=True)[1]
            t = t - np.bincount(group[first], mine)[group]
            mass = mass - np.bincount(group[first], off(n) - off(left))[group]
            levels.append((np.maximum(left - off(left), 0)[place], t, np.maximum(mass, 0)))
            gone, first_above = ((mine > 0) & (left == 0)).astype(float), first
        p = np.full(len(at), 1 / self.letters)
        for seen, t, mass in reversed(levels):
            p = np.where(t > 0, (seen + mass * p) / np.maximum(t, 1), p)
        return np.log(p)


def log_probabilities(requests: DataFrame, counts: DataFrame, units: Units = CHARACTERS
                      ) -> DataFrame:
    """gram, logp for each distinct requested gram: p(last unit | the units before)."""
    model = Model(counts, units)
    scorer, order = model.scorer(), units.order
    asked = requests.select("gram").distinct()
    keys = [units.last("gram", k) for k in range(1, order + 1)]
    keys += [units.first(units.last("gram", k), k - 1) for k in range(2, order + 1)]
    answers = (asked.select(F.col("gram").alias("_whole"), F.explode(F.array(*keys)).alias("gram"))
               .distinct().join(model.table, "gram").fillna(0, list("ntd"))
               .groupBy(F.col("_whole").alias("gram"))
               .agg(F.collect_list(F.struct("gram", *"ntd")).alias("found")))

    def one(gram: str, rows) -> float:
        own = gram.split(units.separator) if units.separator else list(gram)
        found = {r["gram"]: (r["n"], r["t"], r["d"]) for r in ([] if rows is None else rows)}
        looked = [np.array([found.get(units.separator.join(own[max(i - k, 0):i]), (0.0, 0.0, 0.0))
                            for i in range(1, order + 1)]) for k in range(1, order + 1)]
        return float(scorer.logs(np.array([order - 1]), np.zeros(1, np.int64),
                                 [np.arange(order)] * order, looked, np.zeros(1))[0])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"gram": pdf["gram"], "logp": [
                one(g, f) for g, f in zip(pdf["gram"], pdf["found"])]})

    return asked.join(answers, "gram", "left").mapInPandas(scored, "gram string, logp double")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows, about PACK_BYTES at a time, as one compressed blob per ``_batch``."""
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by("_batch").combine_chunks()
        own = rows["_batch"].to_numpy()
        starts = np.flatnonzero(np.diff(own, prepend=own[0] - 1)).tolist()
        blobs = []
        for a, b in zip(starts, [*starts[1:], len(own)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_table(rows.slice(a, b - a))
            blobs.append(zstandard.compress(sink.getvalue()))
        return pa.record_batch([pa.array(own[starts], pa.int32()), pa.array(blobs, pa.binary())],
                               names=["_batch", "_docs"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield pack(held)
            held, size = [], 0
    if held:
        yield pack(held)


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all()


_SPACES = [c for c in range(0x3001) if chr(c).isspace()]
_KINDS = np.zeros(0x110000, np.uint8)  # of code points: 1 white space, 2 a word by itself
_KINDS[_SPACES] = 1
for _low, _high in zip(_EAST[::3], _EAST[2::3]):
    _KINDS[ord(_low):ord(_high) + 1] = 2
_POWER = 0x9E3779B97F4A7C15
_START, _END = np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash per row of words."""
    out = columns[0]
    for c in columns[1:]:
        out = _mixed(out * np.uint64(_POWER) + c)
    return out


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    """The first powers of a number and of its inverse, modulo 2^64."""
    steps = np.ones((2, n), np.uint64)
    steps[0, 1:], steps[1, 1:] = _POWER, pow(_POWER, -1, 1 << 64)
    return np.cumprod(steps, axis=1, dtype=np.uint64)


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts in a row, and how many each text has. A word's hash is a polynomial
    in its code points, so differences of one running sum give those of all words."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS[points]
    plain, alone = kinds == 0, kinds == 2
    inside = np.concatenate([[False], plain, [False]])
    begins = np.flatnonzero(alone | (plain & ~inside[:-2]))
    ends = np.flatnonzero(alone | (plain & ~inside[2:])) + 1
    up, down = _powers(1 << len(points).bit_length())
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed(points + np.uint64(1)) * up[:len(points)], out=total[1:])
    words = _mixed((total[ends] - total[begins]) * down[begins])
    closes = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(begins, closes), prepend=0)


class _Hashed:
    """Like ``_Grams`` with a hash per word: ``flat`` has start marks, words and an end mark of each text."""

    def __init__(self, texts: list[str]):
        lead, parts = ORDER - 1, [_word_hashes(texts[a:b]) for a, b in _portions(texts)]
        words = np.concatenate([np.zeros(0, np.uint64), *[w for w, _ in parts]])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]]) + 1
        text = np.repeat(np.arange(len(texts)), self.sizes - 1)
        self.flat = np.full(len(words) + (lead + 1) * len(texts), _START)
        self.flat[np.arange(len(words)) + text * (lead + 1) + lead] = words
        self.flat[np.cumsum(self.sizes + lead) - 1] = _END

    def ends(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the k-grams that matter end, also as contexts, and the text of each."""
        more = 0 if k == ORDER else 1  # the start mark before the first word is a context
        which = np.repeat(np.arange(len(self.sizes)), self.sizes + more)
        return np.arange(len(which)) + (which + 1) * (ORDER - 1 - more), which

    def columns(self, ends: np.ndarray, k: int) -> list[np.ndarray]:
        return [self.flat[ends - j] for j in range(k - 1, -1, -1)]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """In order; sorting is many times faster here than the hashing of ``np.unique``."""
    numbers = np.sort(numbers)
    return numbers[np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])[:len(numbers)])]


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in order, a place of each, and for each place which of them it has."""
    names, number = np.unique(ids, return_inverse=True)
    places = np.empty(len(names), np.int64)
    places[number] = np.arange(len(ids))
    return names, places, number


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0, each in as few bytes as its largest needs, first bytes first."""
    small = [a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for a in arrays]
    head = np.array([len(small), *[x for a in small for x in (a.itemsize, len(a))]], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(
        a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in small))


def _arrays(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    head = np.frombuffer(data, np.int64, 1 + 2 * int(np.frombuffer(data, np.int64, 1)[0]))
    out, at = [], head.nbytes
    for size, n in head[1:].reshape(-1, 2).tolist():
        a = np.frombuffer(data, np.uint8, size * n, at).reshape(size, n).T
        a = np.ascontiguousarray(a).view(f"u{size}").reshape(n) if n else np.zeros(0, "u1")
        out.append(a.astype(np.uint64 if size == 8 else np.int64, copy=False))
        at += size * n
    return out


def _sorted_blob(ids: np.ndarray, *rest: np.ndarray) -> bytes:
    return _blob(np.diff(ids, prepend=np.uint64(0)), *rest)


def _grams_blob(columns: list[np.ndarray], *rest: np.ndarray) -> bytes:
    """Rows of words as numbers of a list of words, in order, and columns beside them."""
    words, codes = np.unique(np.concatenate(columns), return_inverse=True)
    codes = codes.reshape(len(columns), -1)
    order = np.argsort(codes[0], kind="stable")
    return _sorted_blob(words, *codes[:, order], *[r[order] for r in rest])


def _grams_of(blob: bytes, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    words, *arrays = _arrays(blob)
    words = np.cumsum(words.astype(np.uint64), dtype=np.uint64)
    return [words[c] for c in arrays[:k]], [a.astype(np.int64) for a in arrays[k:]]


#: Rows between jobs: requests, trigrams of trusted texts by their last two words, counts for the
#: order below, answers (key: the batch) and sums over a part.
_ASKED, _ENDING, _COUNTED, _ANSWER, _SUMS = range(5)
_ROWS = "kind int, level int, key int, part int, blob binary, sums array<long>"
_SUMMED = ["n1", "n2", "n3", "n4", "grams", "total"]


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] * 4 + [pa.binary(), pa.list_(pa.int64())]
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)],
                           names=["kind", "level", "key", "part", "blob", "sums"])


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run of equal values."""
    values, starts = np.unique(sorted_, return_index=True)
    yield from zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_)])


@dataclass
class Dealing:
    """How n-grams are dealt: a bigram's hash gives its slice, an n-gram's hash its part of a slice."""
    slices: int
    parts: int
    word_slices: int
    word_parts: int

    def part(self, columns: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """The part of each k-gram; parts of a slice follow one another, and ids in a slice's parts."""
        return self.in_slice(self.slice(columns, ids), ids, len(columns))

    def slice(self, columns: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        if len(columns) == 1:
            return (ids % np.uint64(self.word_slices)).astype(np.int64)
        ids = ids if len(columns) == 2 else _hashed(columns[:2])
        return (ids % np.uint64(self.slices)).astype(np.int64)

    def in_slice(self, s: np.ndarray | int, ids: np.ndarray, k: int) -> np.ndarray:
        parts = self.word_parts if k == 1 else self.parts
        return s * parts + ((ids >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _requests(dealt: DataFrame, dealing: Dealing, k: int, s: int) -> DataFrame:
    """A row per task's share and part: the distinct k-grams of slice ``s`` in each batch; for the
    highest order also the n-grams of trusted texts, and those whose last words are of the slice."""
    def asked(batch: np.ndarray, ids: np.ndarray, batches: int) -> Iterator[tuple]:
        ids, place = np.unique(ids, return_inverse=True)
        key = _distinct(place * batches + batch)
        times, batch = np.bincount(key // batches, minlength=len(ids)), key % batches
        ends = np.cumsum(times)
        for p, a, b in _runs(dealing.in_slice(s, ids, k)):
            yield _ASKED, k, p, p, _sorted_blob(ids[a:b], times[a:b],
                                                batch[ends[a] - times[a]:ends[b - 1]]), None

    def trusted(kind: int, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
        ids, places, number = _numbered(ids)
        columns, times = [c[places] for c in columns], np.bincount(number)
        for p, a, b in _runs(dealing.in_slice(s, ids, k)):
            yield kind, k, p, p, _grams_blob([c[a:b] for c in columns], times[a:b]), None

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {_ASKED: [], _COUNTED: [], _ENDING: []}

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            for kind, got in held.items():
                if sum(len(x[0]) for x in got) >= least:
                    columns = [np.concatenate(c) for c in zip(*got)]
                    got.clear()
                    if kind == _ASKED:
                        out = asked(*columns, int(columns[0].max()) + 1)
                    else:
                        out = trusted(kind, *columns)
                    yield _row_batch(list(out))

        for rb in rows:
            texts, batch = rb["_text"].to_pylist(), rb["_batch"].to_numpy()
            known = np.array(rb["_own"].to_pylist(), bool)
            for a, b in _portions(texts):
                grams = _Hashed(texts[a:b])
                ends, which = grams.ends(k)
                columns = grams.columns(ends, k)
                ids = _hashed(columns)
                pick = np.flatnonzero(dealing.slice(columns, ids) == s)
                held[_ASKED].append((batch[a:b][which[pick]].astype(np.int64), ids[pick]))
                if k == ORDER:
                    own = known[a:b][which]
                    pick = pick[own[pick]]
                    held[_COUNTED].append((ids[pick], *[c[pick] for c in columns]))
                    own = np.flatnonzero(own)
                    last = [c[own] for c in columns[1:]]
                    pick = own[dealing.slice(last, _hashed(last)) == s]
                    held[_ENDING].append((ids[pick], *[c[pick] for c in columns]))
                yield from flushed(HELD)
        yield from flushed(1)

    return dealt.mapInArrow(ask, _ROWS)


class _Counts:
    """n-grams with sums beside them, merged while they come."""

    def __init__(self, k: int, width: int):
        self.k, self.width, self.new = k, width, 0
        self.held = [(np.zeros(0, np.uint64), *[np.zeros(0, np.uint64)] * k,
                      np.zeros((0, width), np.int64))]

    def add(self, columns: list[np.ndarray], values: np.ndarray) -> None:
        self.held.append((_hashed(columns), *columns, values))
        self.new += len(values)
        if self.new > MERGED:
            self.merged()

    def merged(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Hashes in order, words, sums."""
        ids, *columns, values = [np.concatenate(c) for c in zip(*self.held)]
        ids, places, number = _numbered(ids)
        columns = [c[places] for c in columns]
        sums = np.zeros((len(ids), self.width), np.int64)
        for j in range(self.width):
            sums[:, j] = np.rint(np.bincount(number, values[:, j], len(ids)))
        self.held, self.new = [(ids, *columns, sums)], 0
        return ids, columns, sums


def _sums(n: np.ndarray) -> list[int]:
    return [*[int((n == i).sum()) for i in range(1, 5)], int((n > 0).sum()), int(n.sum())]


def _answers(rows: DataFrame, dealing: Dealing, k: int) -> DataFrame:
    """Per part: answers to the batches, counts for the order below, sums over the part. Values are n,
    as a context the total t, and how many k-grams that follow have the counts 1, 2, more."""
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        counts, ending = _Counts(k, 1 if k == ORDER else 5), _Counts(k, 0)
        asked, new = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
            if kind == _ASKED:
                wanted, times, batch = _arrays(blob)
                wanted = np.cumsum(wanted.astype(np.uint64), dtype=np.uint64)
                asked.append((np.repeat(wanted, times), batch))
                new += len(batch)
                if new > MERGED:
                    wanted, place, batch = merged(asked)
                    asked, new = [(wanted[place], batch)], 0
                continue
            columns, rest = _grams_of(blob, k)
            if kind == _COUNTED:
                counts.add(columns, np.stack(rest, axis=1))
            else:
                ending.add(columns, np.zeros((len(columns[0]), 0), np.int64))
        ids, columns, values = counts.merged()
        out = [(_SUMS, k, part, part, None, _sums(values[:, 0]))]
        if k > 1:
            own = values[:, 0] > 0
            n, columns = values[own, 0], [c[own] for c in columns]
            last = ending.merged()[1] if k == ORDER else columns
            below = _Counts(k - 1, 5)
            below.add(columns[:-1], np.stack([n * 0, n, n == 1, n == 2, n > 2], axis=1).astype(np.int64))
            below.add(last[1:], np.repeat([[1, 0, 0, 0, 0]], len(last[0]), axis=0))
            _, words, sums = below.merged()
            target = dealing.part(words, _hashed(words))
            order = np.argsort(target, kind="stable")
            for p, a, b in _runs(target[order]):
                pick = order[a:b]
                out.append((_COUNTED, k - 1, p, part,
                            _grams_blob([c[pick] for c in words], *sums[pick].T), None))
        wanted, place, batch = merged(asked)
        # Equal values have one number; the last row of values is that of n-grams without counts.
        values = np.concatenate([values, np.zeros((1, values.shape[1]), np.int64)])
        _, first, number = _numbered(_hashed([*values.T.astype(np.uint64)]))
        order = np.lexsort(values[first].T)
        first, number = first[order], np.argsort(order)[number]
        if k < ORDER:  # most n-grams have followers of few counts: what these leave of t is small
            values[:, 1] -= values[:, 2:] @ np.arange(1, 4)
        found = np.full(len(wanted), number[-1])
        if len(ids):
            at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
            found = np.where(ids[at] == wanted, number[at], found)
        for b, start, end in _runs(batch):
            used, codes = np.unique(found[place[start:end]], return_inverse=True)
            out.append((_ANSWER, k, b, part, _blob(codes, *values[first[used]].T), None))
        return pa.Table.from_batches([_row_batch(out)])

    def merged(asked: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order; the distinct requests by batch, then hash, as places of hashes and batches."""
        wanted, batch = [np.concatenate(c) for c in zip(*asked)]
        wanted, place = np.unique(wanted, return_inverse=True)
        key = _distinct(batch * max(len(wanted), 1) + place)
        return wanted, key % max(len(wanted), 1), key // max(len(wanted), 1)

    return rows.groupBy("key").applyInArrow(meet, _ROWS)


@contextmanager
def _short_lived(spark: SparkSession):
    """Shuffle files go when a job has ended, as the next slice needs their place."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _answered(dealt: DataFrame, dealing: Dealing) -> DataFrame:
    """The answers to all batches, and the sums."""
    tables, words, later = [], [], F.col("kind") == _COUNTED
    for s in range(dealing.slices):
        high = settle(_answers(_requests(dealt, dealing, 3, s), dealing, 3), f"kn-3-{s}")
        low = settle(_answers(_requests(dealt, dealing, 2, s).union(high.where(later)), dealing, 2),
                     f"kn-2-{s}")
        tables.append(settle(high.union(low).where(~later), f"kn-answers-{s}"))
        discard(high)
        words.append(settle(low.where(later), f"kn-words-{s}"))
        discard(low)
    for s in range(dealing.word_slices):
        rows = _requests(dealt, dealing, 1, s)
        for t in words:
            rows = rows.union(t.where(F.floor(F.col("key") / dealing.word_parts) == s))
        tables.append(settle(_answers(rows, dealing, 1), f"kn-1-{s}"))
    discard(*words)
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _scorer(rows: DataFrame) -> Scorer:
    sums = {k: [0] * len(_SUMMED) for k in range(1, ORDER + 1)}
    sums |= {r["level"]: [r[c] or 0 for c in _SUMMED] for r in rows.where(F.col("kind") == _SUMS)
            .groupBy("level").agg(*[F.sum(F.col("sums")[i]).alias(c) for i, c in enumerate(_SUMMED)])
            .collect()}
    discounts = [_discount(sums[k][:4]) for k in range(1, ORDER + 1)]
    n1, n2, _, _, grams, total = sums[1]
    d1, d2, d3 = discounts[0]
    return Scorer(WORDS, discounts, grams + 1, total, d1 * n1 + d2 * n2 + d3 * (grams - n1 - n2))


def perplexities(docs: DataFrame, text: str = "text", own: str = "_known") -> DataFrame:
    """Add n_grams and perplexity under the model of the texts that ``own`` marks, without the text;
    these texts are scored without their own counts. Documents are dealt by a hash of all their
    columns, so each slice finds the same batches."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    batches = int(size // BATCH_BYTES) + 1
    slices, word_slices, score_slices = [min(x, batches) for x in (SLICES, WORD_SLICES, SCORE_SLICES)]
    dealing = Dealing(slices, int(size // (slices * PART_BYTES)) + 1,
                      word_slices, int(size // (word_slices * PART_BYTES)) + 1)
    rest = [c for c in docs.columns if c.lower() not in {text.lower(), *RESULTS}]
    dealt = (docs.select(*[F.col(f"`{c}`") for c in rest],
                         F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
             .withColumn("_batch", F.pmod(F.xxhash64(*[f"`{c}`" for c in rest], "_text"),
                                          F.lit(batches)).cast("int")))
    with _short_lived(spark):
        rows = _answered(dealt.select("_batch", "_text", F.col(f"`{own}`").alias("_own")), dealing)
        scorer = _scorer(rows)
        answers = rows.where(F.col("kind") == _ANSWER).select(F.col("key").alias("_batch"), "level", "part", "blob")
        schema = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in rest)

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            docs = pa.concat_tables([_unpacked(blob) for blob in left["_docs"].to_pylist()])
            grams = _Hashed(docs["_text"].to_pylist())
            level, blobs = right["level"].to_numpy(), right["blob"].to_pylist()
            by_part = np.argsort(right["part"].to_numpy(), kind="stable")
            ids, looked = [], []
            for k in range(1, ORDER + 1):
                ends, which = grams.ends(k)
                columns = grams.columns(ends, k)
                names, places, number = _numbered(_hashed(columns))
                part = dealing.part([c[places] for c in columns], names)
                got = [_arrays(blobs[i]) for i in by_part.tolist() if level[i] == k]
                got = np.concatenate([scorer.values(k, np.stack(c, axis=1))[codes] for codes, *c in got])
                values = np.zeros((len(names), 3))
                order = np.argsort(part, kind="stable")
                if len(got) != len(order):
                    raise ValueError("a batch has not got an answer to each request")
                values[order] = got
                numbers = np.zeros(len(grams.flat), np.int64)
                numbers[ends] = number
                ids.append(numbers)
                looked.append(values)
            counted = np.array(docs[own].to_pylist(), bool)
            logs = scorer.logs(ends, which, ids, looked, counted)
            sums = np.bincount(which, logs, len(counted))
            return (docs.select(rest).append_column("n_grams", pa.array(grams.sizes, pa.int64()))
                    .append_column("perplexity", pa.array(np.exp(-sums / grams.sizes))))

        # Batches bound a worker's memory, partitions the number of tasks: a task has many batches.
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = min(batches, max(least, int(size // PARTITION_BYTES) + 1))
        out = None
        for s in range(score_slices):
            mine = F.col("_batch") % score_slices == s
            packed = dealt.where(mine).mapInArrow(_packed, "_batch int, _docs binary").repartition(parts, "_batch")
            done = settle(packed.groupBy("_batch").cogroup(answers.where(mine).groupBy("_batch"))
                          .applyInArrow(score, f"{schema}, n_grams long, perplexity double"), f"perplexities-{s}")
            out = done if out is None else out.union(done)
    return out


def _reached(values: DataFrame, keys: list[str], quantile: float) -> DataFrame:
    """Per group the least perplexity that is not below the interpolated quantile. It is one of the
    group's, so no small group loses its worst text only because there is one."""
    marks = group_quantiles(values, keys, "perplexity", {"_mark": quantile}).drop("n")
    v = F.col("perplexity")
    return (values.join(marks, keys).groupBy(*keys)
            .agg(F.coalesce(F.min(F.when(v >= F.col("_mark"), v)), F.max(v)).alias("_least")))


@shielded
def judge(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang", trusted_id: str = "doc_id", quantile: float = QUANTILE
          ) -> DataFrame:
    """Add n_grams, perplexity, threshold and kept; the text is left out.

    ``trusted``: a table of ids. The model counts every trusted text, and each of these is scored
    without its own counts. kept: perplexity at most the least one that reaches the ``quantile`` among
    the trusted documents of the row's language (NULL is a language of its own); a language without
    any takes the quantile of all trusted documents, and without those everything is kept. A NULL or empty text is one end mark. Rows stay one to one;
    a NULL id is never trusted; empty tables are fine; input columns with result names are
    replaced. The trusted ids are broadcast up to ``BROADCAST_IDS`` of them, else both sides are
    shuffled.
    """
    ids = settle(trusted.select(F.col(f"`{trusted_id}`").alias("_tid")).where("_tid is not null")
                 .distinct(), "trusted-ids")
    marked = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rest = [F.col(f"`{c}`") for c in docs.columns]
    flagged = docs.join(marked, F.col(f"`{doc_id}`") == F.col("_tid"), "left").select(
        *rest, F.col("_tid").isNotNull().alias("_known"))
    scored = perplexities(flagged, text)
    known = scored.where("_known")
    # Exact however large a language is: a sketch encloses the rank, the values between are counted.
    spoken = F.concat(F.lit("="), F.col(f"`{lang}`").cast("string"))
    values = known.select(F.coalesce(spoken, F.lit("")).alias("_lang"), "perplexity")
    by_lang = _reached(values, ["_lang"], quantile).withColumnRenamed("_least", "_own")
    overall = _reached(values.withColumn("_lang", F.lit("")), ["_lang"], quantile).first()
    overall = overall["_least"] if overall else None
    rest = [F.col(f"`{c}`") for c in scored.columns if c != "_known"]
    return (scored.join(by_lang, F.coalesce(spoken, F.lit("")) == F.col("_lang"), "left")
            .withColumn("threshold", F.coalesce("_own", F.lit(overall).cast("double")))
            .select(*rest, "threshold",
                    F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
                    .alias("kept")))
