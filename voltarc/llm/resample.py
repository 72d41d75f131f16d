"""Importance resampling towards a target: draw the documents that look most like a target corpus.

Hashed n-grams (runs of 1 to 2 words) of all documents and of all target texts are counted per
bucket. A bucket's gain is the logarithm of how much likelier the target holds it, a document's
weight the mean gain of its n-grams, and its score the weight plus a Gumbel variable made from a
digest of its id. The documents with the highest scores are a draw without replacement in
proportion to the weights.

The draw needs exact ranks. They come from a distributed radix sort, least significant digit first,
over one composite key: falling score, then rising id. A row has a position; blocks of ``BLOCK``
positions are the units of work. A pass counts the rows of each block per digit, and prefix sums over
(digit, block) tell where a block's rows with a digit begin; inside a block a stable counting sort
gives the place among them. So a pass computes the new position of every row, and the next pass
deals rows by it. After the last pass positions are ranks. Only (row, key) travels, no task holds
more than a block, and no pass compares keys. Number and width of the digits follow the range of the
keys.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltarc.llm.common import discard, settle, shielded

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
BLOCK = 1 << 18  # positions of a block, at most
LEAST_BLOCK = 1 << 12  # a block holds a 64th of the rows in between
DIGIT_BITS = 12  # at most; a pass keeps 2^bits counts per block
KNOWN = 500_000  # different words whose checksums a task remembers
RESULTS = ["n_features", "weight", "score", "rank"]

#: A-Z to a-z, every other ASCII character that is no letter or digit to a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))
_CHECK = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)


def _append_tables(longest: int) -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, with value b, becomes when n more bytes follow, apart
    from the share of those bytes. A checksum is linear: that of ``a + b`` is the shifted checksum
    of ``a`` xor that of ``b``."""
    # Feeding a zero byte into the plain register: r -> (r >> 8) ^ T[r & 255].
    table = _CHECK ^ np.uint32(zlib.crc32(b"\0"))  # linear part only
    out = np.empty((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(longest):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ table[out[n] & np.uint32(255)]
    return out


SHORT = 48  # bytes of a word whose checksum is appended by table
_APPEND = _append_tables(SHORT + 1)


class _Words(dict):
    """word -> checksum | checksum of blank and word << 32, and its length apart."""

    def __missing__(self, word: bytes) -> int:
        number = zlib.crc32(word) | zlib.crc32(b" " + word) << 32
        self[word] = number
        return number


def _after(first: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of ``a + b`` from those of a and b and the length of b, up to SHORT + 1 bytes."""
    out = more.copy()
    for k in range(4):
        out ^= _APPEND[length, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def features(text: str | None, buckets: int, known: _Words) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one or two words."""
    words = (text or "").encode().translate(_WORD_BYTES).split()
    n = len(words)
    if not n:
        return 0, np.empty(0, np.int64)
    if len(known) > KNOWN:
        known.clear()
    both = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    single = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    length = np.fromiter(map(len, words[1:]), np.int64, n - 1)
    blank = (both[1:] >> np.uint64(32)).astype(np.uint32)
    pair = _after(single[:-1], blank, np.minimum(length, SHORT) + 1)
    for i in np.flatnonzero(length > SHORT).tolist():
        pair[i] = zlib.crc32(words[i + 1], zlib.crc32(b" ", int(single[i])))
    return n, np.concatenate([single, pair]).astype(np.int64) % buckets


def _bucket_counts(buckets: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, known = np.zeros(buckets, np.int64), _Words()
        for pdf in batches:
            for t in pdf["_text"]:
                at = features(t, buckets, known)[1]
                if len(at):
                    total += np.bincount(at, minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})
    return count


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: n-grams of all texts per bucket. A task adds up its own counts first."""
    return (docs.select(F.col(f"`{text}`").alias("_text"))
            .mapInPandas(_bucket_counts(buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket 1000 times the log of the ratio of smoothed shares, rounded down. Both tables have
    at most ``buckets`` rows, the bound of what comes to the driver and goes out to the tasks."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, table in ((s, source), (t, target)):
        for row in table.collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets)
                                                / ((a + 1) * (all_t + buckets))))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def _scored(gain: np.ndarray):
    def score(texts: pd.Series, noise: pd.Series) -> pd.DataFrame:
        known, rows = _Words(), []
        for t, h in zip(texts, noise):
            n, at = features(t, len(gain), known)
            weight = int(gain[at].sum()) // len(at) if len(at) else 0
            gumbel = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            rows.append((n, len(at), weight, weight + gumbel))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight", "score"])
    return score


def _digit(width: int, low_bits: int, shift: int) -> Column:
    """Digit of the composite key (hi, lo) that begins at bit ``shift``; lo has ``low_bits`` bits."""
    mask = F.lit((1 << width) - 1)
    if shift >= low_bits:
        return F.shiftrightunsigned("hi", shift - low_bits).bitwiseAND(mask)
    low = F.shiftrightunsigned("lo", shift).bitwiseAND(mask)
    if shift + width <= low_bits:
        return low
    high = F.col("hi").bitwiseAND(mask)
    return low.bitwiseOR(F.shiftleft(high, low_bits - shift)).bitwiseAND(mask)


def _placed(block: int):
    def place(rows: pd.DataFrame, begins: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort(rows["pos"].to_numpy())]  # the order that the pass keeps
        digit = rows["digit"].to_numpy()
        count = np.bincount(digit)
        order = np.argsort(digit, kind="stable")  # radix sort of small integers
        start = np.zeros(len(count), np.int64)
        start[begins["digit"].to_numpy()] = begins["begin"].to_numpy()
        shift = start - (np.cumsum(count) - count)
        out = rows.iloc[order][["row", "hi", "lo"]]
        out["pos"] = np.arange(len(out)) + shift[digit[order]]
        return out
    return place


def radix_sorted(rows: DataFrame, low_bits: int, high_bits: int, block: int = BLOCK,
                 digit_bits: int = DIGIT_BITS) -> DataFrame:
    """row, hi, lo, pos for a written table row, hi, lo, pos: pos becomes the place in the order of
    the key hi * 2^low_bits + lo (both unsigned). pos must hold different numbers, in blocks of at
    most ``block``; they need not be dense."""
    bits = max(1, low_bits + high_bits)
    passes = -(-bits // digit_bits)
    width = -(-bits // passes)
    if width > 16:
        raise ValueError("digits of at most 16 bits")
    for k in range(passes):
        dealt = rows.withColumns({"digit": _digit(width, low_bits, k * width).cast("int"),
                                  "block": F.floor(F.col("pos") / block)})
        counts = settle(dealt.groupBy("digit", "block").agg(F.count("*").alias("n")),
                        "radix-counts")
        # at most 2^width rows; what lies before a digit
        first = counts.groupBy("digit").agg(F.sum("n").alias("total")).select(
            "digit", (F.sum("total").over(Window.orderBy("digit")) - F.col("total")).alias("base"))
        inside = Window.partitionBy("digit").orderBy("block")  # one row per block
        begins = counts.join(first, "digit").select(
            "digit", "block", (F.col("base") + F.sum("n").over(inside) - F.col("n"))
            .alias("begin"))
        placed = settle(dealt.groupBy("block").cogroup(begins.groupBy("block")).applyInPandas(
            _placed(block), "row long, hi long, lo long, pos long"), "radix-pass")
        discard(rows, counts)
        rows = placed
    return rows


@shielded
def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
              target_text: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
              percent: int = PERCENT, seed: int = SEED, block: int | None = None) -> DataFrame:
    """Add n_features, weight, score and rank: 1, 2, 3 ... for the ``percent`` of the documents with
    at least ``least_words`` words that have the highest scores (rounded down; ties to the smaller
    id), NULL for all others.

    A NULL or empty text has no features and weight 0. Ids are integers; a NULL id comes after all
    others and counts as empty in the digest. Rows that repeat an id are ranked one by one, in no
    fixed order among equal scores. An empty table stays empty. Input columns with result names are
    replaced. The result is read from a table without texts, so it has every column but the text;
    ``drawn`` gives the texts.
    """
    source, wanted = bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets)
    gain = gains(source, wanted, buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256), 1, 8),
        16, 10).cast("long")
    rest = [F.col(f"`{c}`") for c in docs.columns
            if c.lower() not in {*RESULTS, text.lower()}]
    scored = F.pandas_udf(_scored(gain),
                          "n_words long, n_features long, weight long, score long")
    judged = settle(docs.select(*rest, F.col(f"`{doc_id}`").cast("long").alias("_id"),
                                scored(F.col(f"`{text}`"), noise).alias("_s"))
                    .select(*rest, "_id", "_s.*")
                    .withColumn("_row", F.monotonically_increasing_id()), "resample-scores")
    able = judged.where(F.col("n_words") >= least_words)
    n, top, low, least, most, no_id = able.agg(
        F.count("*"), F.max("score"), F.min("score"), F.min("_id"), F.max("_id"),
        F.coalesce(F.bool_or(F.col("_id").isNull()), F.lit(False))).first()
    draw = n * percent // 100
    if not draw:
        return judged.withColumn("rank", F.lit(None).cast("long")).select(*rest, *RESULTS)
    if least is None or most - least < 2**62:
        lo, low_bits = F.col("_id") - F.lit(least or 0), ((most or 0) - (least or 0)).bit_length()
    else:  # the order of signed numbers as that of unsigned ones
        lo, low_bits = F.col("_id").bitwiseXOR(F.lit(-2**63)), 64
    hi = F.lit(top) - F.col("score")
    if no_id:
        hi = 2 * hi + F.col("_id").isNull().cast("long")
    keys = able.select(F.col("_row").alias("row"), hi.alias("hi"),
                       F.coalesce(lo, F.lit(0)).alias("lo"), F.col("_row").alias("pos"))
    placed = radix_sorted(settle(keys, "radix-keys"), low_bits, (top - low).bit_length() + no_id,
                          block or min(BLOCK, max(LEAST_BLOCK, n // 64)))
    ranks = placed.where(F.col("pos") < draw).select(
        F.col("row").alias("_row"), (F.col("pos") + 1).alias("rank"))
    done = settle(judged.join(ranks, "_row", "left").select(*rest, *RESULTS), "resample-ranks")
    discard(judged, placed)
    return done


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
          **options) -> DataFrame:
    """The documents that ``resampled`` draws, with all their columns and rank. Documents are known
    by id and text, so rows that repeat both come back if one of them is drawn, with the best rank."""
    marked = docs.withColumn("_same", F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    ranks = (resampled(marked.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), "_same"), target,
                       doc_id, text, **options).where("rank is not null")
             .groupBy("_same").agg(F.min("rank").alias("rank")))
    kept = [c for c in docs.columns if c.lower() != "rank"]
    return ranks.join(marked.select(*[F.col(f"`{c}`") for c in kept], "_same"), "_same").select(
        *[F.col(f"`{c}`") for c in kept], "rank")
