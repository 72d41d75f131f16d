"""Spelling variants: words one edit apart, found by dense tiles over prefixes and suffixes.

Two words differ by exactly one inserted, deleted or replaced character if and only if they differ
and their common prefix plus their common suffix reaches the longer length minus one. So with a
longer length of L one of the two holds at least L // 2 characters, and words that may be close
share a tile: the longer length, and the first or the last L // 2 characters. Inside a tile the
words are rows of two padded code-point matrices, one from the left and one from the right, and the
matrices are compared with themselves in blocks, column by column.

A tile with more than ``TILE`` words is cut again by the same rule in the gap between what its words
share, so the gap halves. With a gap of one character a tile holds at most one word per character
of the alphabet (and the word without it), each of them one edit from all others: its pairs are the
answer. Thus no pair of words is left out, and none is looked at because a tile is large.

A pair may lie in several tiles; it counts in that which takes the prefix wherever the common prefix
is long enough. A tile sends one row per word that has a close one: how many, and the most frequent.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import discard, settle

TILE = 512  # words of a tile that is compared as it is
CELLS = 1 << 20  # pairs compared at a time
HELD = 200_000  # different words that a counting task holds before it sends them on
NO_LIMIT = 2**31 - 1
LETTERS = "A-Za-zÀ-ÿ"


def _counted(least_chars: int, misspell: int, letters: str):
    run = re.compile(f"[{letters}]{{{least_chars},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for pdf in batches:
            for i, t in zip(pdf["_id"], pdf["_text"]):
                if t is None:
                    continue
                mark = f"{i or ''}:"
                # A to Z only; runs under the least length cannot become a word
                for w, n in Counter(run.findall(t.encode().lower().decode())).items():
                    if misspell:
                        h = zlib.crc32((mark + w).encode())
                        if h % misspell == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1:]
                            if len(w) < least_chars:
                                continue
                    held[w] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object),
                            "n": np.array(list(held.values()), np.int64)})
    return count


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                least_chars: int = 7, least_count: int = 2, misspell: int = 0,
                letters: str = LETTERS) -> DataFrame:
    """word, n: maximal runs of ``letters``, A-Z lower-cased, of at least ``least_chars`` characters
    that occur at least ``least_count`` times in all texts.

    ``misspell`` = k deletes one character from about one in k (document, word) pairs, chosen by a
    checksum of both: a noise source for tests. NULL and empty texts hold no words; a NULL id
    counts as an empty one in the checksum; rows that repeat count again; other columns are unused.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("_id"),
                       F.col(f"`{text}`").cast("string").alias("_text"))
    return (rows.mapInPandas(_counted(least_chars, misspell, letters), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


_TILE = ["longer", "p", "s", "below", "shared"]


def _child(side: str) -> list:
    """Columns of a word's tile that shares ``gap // 2`` more characters on one side."""
    more = F.floor((F.col("longer") - F.col("p") - F.col("s")) / 2).cast("int")
    p, s = ((F.col("p") + more, F.col("s")) if side == "prefix" else
            (F.col("p"), F.col("s") + more))
    below = F.col("below") if side == "prefix" else F.least("below", F.col("p") + more)
    return [F.col("longer").alias("longer"), p.alias("p"), s.alias("s"), below.alias("below"),
            F.concat_ws("\x00", F.substr("word", F.lit(1), p),
                        F.substr("word", F.length("word") - s + 1, s)).alias("shared")]


def _halves(rows: DataFrame) -> DataFrame:
    """Each row's two child tiles."""
    both = F.explode(F.array(F.struct(*_child("prefix")), F.struct(*_child("suffix"))))
    return rows.withColumn("_t", both).select("word", "n", "_t.*")


def _tiled(words: DataFrame, tile: int) -> list[DataFrame]:
    """word, n and tile; a word is in tiles as the longer and as the shorter of a pair. Written
    tables whose tiles are small, one per level of cutting."""
    start = words.where(F.length("word") > 0).select(
        "word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer"),
        F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(NO_LIMIT).alias("below"))
    parts, rows = [], settle(_halves(start), "spelling-tiles")
    while True:
        large = settle(rows.groupBy(*_TILE).agg(F.count("*").alias("k"))
                       .where((F.col("k") > tile) & (F.col("longer") - F.col("p") - F.col("s") > 1))
                       .drop("k"), "spelling-large-tiles")
        if large.isEmpty():
            parts.append(rows)
            discard(large)
            return parts
        more = settle(_halves(rows.join(large, _TILE, "left_semi")), "spelling-tiles")
        rest = settle(rows.join(large, _TILE, "left_anti"), "spelling-tiles")
        discard(rows, large)
        parts.append(rest)
        rows = more


def _matrix(words: list[str], start: int, width: int) -> np.ndarray:
    """Code points of the words from ``start`` on, a row per word, padded with zeros."""
    cut = np.array([w[start:] for w in words], dtype=f"U{max(width, 1)}")
    codes = cut.view(np.uint32).reshape(len(words), -1)
    top = codes.max(initial=0)
    return codes.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


def _stack(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, side: int) -> np.ndarray:
    """Rows of several tiles as (column, tile, row), short tiles filled with zero rows."""
    at = starts[:, None] + np.minimum(np.arange(side), sizes[:, None] - 1)
    out = codes[at]
    out[np.arange(side) >= sizes[:, None]] = 0
    return np.ascontiguousarray(out.transpose(2, 0, 1))


def _common(codes: np.ndarray, a: slice) -> np.ndarray:
    """Length of the common prefix of rows ``a`` with all rows, per tile."""
    same = codes[0][:, a, None] == codes[0][:, None, :]
    total = same.astype(np.uint32 if len(codes) > 255 else np.uint8)
    for column in codes[1:]:
        same &= column[:, a, None] == column[:, None, :]
        total += same
        if not same.any():
            break
    return total


def _close(words: list[str], gap: int, p: int, s: int, below: int, starts: np.ndarray,
           sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of one shape, their rows in order of preference -> row, close rows, the first one."""
    left = _matrix(words, p, gap)
    right = _matrix([w[::-1] for w in words], s, gap)
    side_of = 1 << np.ceil(np.log2(sizes)).astype(np.int64)
    for side in np.unique(side_of).tolist():
        of = np.flatnonzero(side_of == side)
        step = max(1, CELLS // (side * side))
        high = max(1, CELLS // side)
        for at in range(0, len(of), step):
            own = of[at:at + step]
            begin, size = starts[own], sizes[own]
            x, y = _stack(left, begin, size, side), _stack(right, begin, size, side)
            real = np.arange(side) < size[:, None]
            for row in range(0, side, high):
                a = slice(row, min(row + high, side))
                prefix = _common(x, a)
                near = (prefix + _common(y, a).astype(np.uint32) >= gap - 1)
                if below != NO_LIMIT:
                    near &= prefix < below - p
                near &= real[:, a, None] & real[:, None, :]
                index = np.arange(a.start, a.stop)
                near[:, index - a.start, index] = False
                total = near.sum(axis=2)
                tile, r = np.nonzero(total)
                if len(tile):
                    first = near[tile, r].argmax(axis=1)
                    yield begin[tile] + a.start + r, total[tile, r], begin[tile] + first


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by tile, then by falling count and word -> a row per word and tile."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if batch.empty:
            continue
        new = _starts(batch)
        yield from _tiles(batch.iloc[:new[-1]], new)
        rest = batch.iloc[new[-1]:].reset_index(drop=True)  # its tile may go on in the next batch
    if rest is not None and len(rest):
        yield from _tiles(rest, np.array([0, len(rest)]))


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    change = np.zeros(len(pdf), bool)
    change[0] = True
    for c in _TILE:
        v = pdf[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _tiles(pdf: pd.DataFrame, borders: np.ndarray) -> Iterator[pd.DataFrame]:
    begin, size = borders[:-1], np.diff(borders)
    begin, size = begin[size > 1], size[size > 1]
    if not len(begin):
        return
    words, n = pdf["word"].tolist(), pdf["n"].to_numpy()
    shape = pdf[_TILE[:4]].to_numpy()[begin]
    kinds, of = np.unique(shape, axis=0, return_inverse=True)
    for k, (longer, p, s, below) in enumerate(kinds.tolist()):
        tiles = np.flatnonzero(of.ravel() == k)
        sizes = size[tiles]
        rows = np.concatenate([np.arange(b, b + z) for b, z in zip(begin[tiles], sizes)])
        own = [words[r] for r in rows.tolist()]
        starts = np.cumsum(sizes) - sizes
        for row, total, first in _close(own, longer - p - s, p, s, below, starts, sizes):
            yield pd.DataFrame({"word": [own[r] for r in row.tolist()], "n_near": total,
                                "form": [own[r] for r in first.tolist()],
                                "form_n": n[rows[first]]})


def single_edits(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, form, form_n: for every word of ``words`` (word, n; each word once) that has one,
    the number of words one edit away and the most frequent of them, ties by code points."""
    out, parts = None, _tiled(words.select("word", "n"), tile)
    for rows in parts:
        found = (rows.repartition(*_TILE).sortWithinPartitions(*_TILE, F.desc("n"), "word")
                 .mapInPandas(_compare, "word string, n_near long, form string, form_n long"))
        out = found if out is None else out.union(found)
    best = out.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("b"))
    done = settle(best.select("word", "n_near", F.col("b.form").alias("form"),
                              (-F.col("b.n")).alias("form_n")), "spelling-edits")
    discard(*parts)
    return done


def _rooted(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms. Counts grow along a chain by a factor, so
    it is short; every round follows as many steps as all rounds before together."""
    ends = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = settle(ends.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not longer.where("moved").isEmpty()
        discard(ends)
        ends = longer.drop("moved") if not moved else settle(longer.drop("moved"), "spelling-roots")
        if not moved:
            return ends
        discard(longer)


def variants(words: DataFrame, ratio: float = 10, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; each word once).

    form: the most frequent word one edit away, ties by code points, if it occurs at least
    ``ratio`` times as often, with its count form_n; root: the end of the chain of forms, the word
    itself without one. n_near counts all words one edit away. An empty table stays empty. The
    result is read from a written table, everything before it is removed.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = settle(words.select("word", "n"), "spelling-words")
    near = single_edits(words, tile)
    taken = F.col("form_n") >= F.lit(ratio) * F.col("n")
    judged = settle(words.join(near, "word", "left").select(
        "word", F.when(taken, F.col("form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("form_n")).alias("form_n")), "spelling-judged")
    roots = _rooted(judged.where("form is not null"))
    done = settle(judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"),
        "spelling-variants")
    discard(words, near, judged)
    return done
