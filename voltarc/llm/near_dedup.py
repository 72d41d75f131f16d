"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of word shingles. Documents with equal sets are one node. MinHash values are cut
into bands; nodes with an equal band are candidates. Candidates get a longer signature of ``VALUES``
further one-byte values, and a pair's signatures are compared batch by batch: after m of n equal
values, the posterior probability that the similarity reaches the threshold is a binomial tail
(uniform prior), and the pair is dropped as soon as it falls below ``MISS``. Survivors are compared on
their full shingle sets.

A bucket of k nodes holds k^2 pairs, of which k - 1 may be enough. So the work goes in turns, and
nodes that are linked by then are one group:

1. every node of a bucket is compared with one node of it, found by a grouped minimum;
2. buckets that still hold several groups are compared, and of the survivors those are sent on that
   would join groups, the likeliest first: fewer than the bucket has nodes;
3. the survivors between groups that are still different are sent on, all of them.

The second turn starts from buckets of ``JOIN`` nodes and cuts those of more than ``BUCKET`` by further
pieces of the long signature, up to ``CUTS`` times, so that nodes meet those that are more alike; it
may miss a pair. The last turn cuts nothing: a bucket of more than ``BUCKET`` nodes is compared in
blocks. Its largest group by then needs no pairs within itself, so blocks of the other nodes meet all
blocks, blocks of that group only these. A pair of different groups that shares a bucket is compared
there, whatever the bucket's size; nothing is capped or skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import discard, settle, shielded
from voltarc.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 30, 4  # a pair at 0.85 shares no band with a probability of 2e-10, at 0.8 of 1e-7
VALUES = 512  # one-byte values of a candidate's long signature
BATCH = 64
MISS = 1e-6
BUCKET = 1024  # nodes of a bucket that are compared as they are
JOIN = 64
BLOCK = 1024  # nodes of a bucket that one side of a comparison task holds
PIECES, PIECE = 4, 6  # pieces of the long signature that cut a large bucket, and their bytes
CUTS = 4
BITS = 1 << 25  # of a map of keys, 4 MB whatever the number of keys
RESULTS = ["n_shingles", "component_id", "kept"]

_rng = np.random.default_rng(20240229)
_MULTIPLY, _ADD = (_rng.integers(0, 2**32, BANDS * ROWS + VALUES, dtype=np.uint32)
                   for _ in range(2))
_MULTIPLY |= np.uint32(1)
_PLACE = _rng.integers(0, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    k = min(size, n)
    total = np.full(n - k + 1, k, np.uint64) * _PLACE[size]
    for j in range(k):
        total += h[j:n - k + 1 + j] * _PLACE[j]
    total = np.sort(_mix(total))
    return total[np.r_[True, total[1:] != total[:-1]]]


def minima(shingles: np.ndarray, part: slice) -> np.ndarray:
    """Least value of each hash function of ``part`` over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    multiply, add = _MULTIPLY[part, None], _ADD[part, None]
    out = np.full(len(multiply), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (multiply * x[at:at + 512] + add).min(axis=1), out=out)
    return out


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A number per band."""
    low = minima(shingles, slice(0, BANDS * ROWS)).astype(np.uint64).reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        return _mix((low * _PLACE[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)
                    * _PLACE[ROWS])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bytes of VALUES minima, none of them in a band."""
    low = minima(shingles, slice(BANDS * ROWS, None))
    return (_mix(low.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "utf-8")))


def _marked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Add _maybe to ``docs``, by its _key: true wherever ``keys`` has the _key, and by chance for a
    share of the others. So only some of the texts have to move to an exact join."""
    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("_place", F.pmod(F.xxhash64("_key"), F.lit(BITS)) + 1)

    bits = settle(place(keys.select("_key")).groupBy(
        F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")), "key-bits")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    bit = byte.cast("int").bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return (place(docs).withColumn("_bucket", F.bitmap_bucket_number("_place"))
            .join(F.broadcast(bits), "_bucket", "left")
            .withColumn("_maybe", F.coalesce(bit, F.lit(False)))
            .drop("_bucket", "_place", "_bits"))


def _sign(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        s = shingle_set(t)
        rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                     bands_of(s).view(np.int64)) if len(s) else (0, None, None))
    return pd.DataFrame(rows, columns=["n", "node", "bands"])


def _candidate(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame({"x": [s.view(np.int64) for s in sets],
                         "sig": [signature(s).tobytes() for s in sets]})


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """Per batch, the fewest equal values with which a pair stays: with m of n equal and a uniform
    prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m). Bytes are equal by chance too."""
    t, out = threshold + (1 - threshold) / 256, []
    for n in range(BATCH, VALUES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t)**(n + 1 - m)
        out.append(m)
    return out


def _stay(a: np.ndarray, b: np.ndarray, least: list[int], sig: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (a, b) of rows of ``sig`` survive, and their equal values; later batches look at
    survivors only."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        if not len(alive):
            break
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (sig[a[alive], cut] == sig[b[alive], cut]).sum(axis=1)
        good = matches >= need
        alive, matches = alive[good], matches[good]
    return alive, matches


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, VALUES)


def _pruned(pairs: DataFrame, sigs: DataFrame, least: list[int]) -> DataFrame:
    """Pairs (a, b) that the sequential test keeps."""
    def stay(x: pd.Series, y: pd.Series) -> pd.Series:
        out, n = np.zeros(len(x), bool), len(x)
        both = _matrix(pd.concat([x, y]))
        out[_stay(np.arange(n), np.arange(n, 2 * n), least, both)[0]] = True
        return pd.Series(out)

    return (pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
            .where(F.pandas_udf(stay, "boolean")("sa", "sb")).select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    both = F.size(F.array_intersect("xa", "xb"))
    return (pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
            .withColumn("both", both)
            .where(den * F.col("both") >= num * (F.size("xa") + F.size("xb") - F.col("both")))
            .select(F.col("a").alias("u"), F.col("b").alias("v")))


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut so that no run of equal keys is spread over two of them."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if batch.empty:
            continue
        last = np.ones(len(batch), bool)
        for k in keys:
            last &= (batch[k] == batch[k].iat[-1]).to_numpy()
        at = len(batch) - int(last.sum())
        if at:
            yield batch.iloc[:at].reset_index(drop=True)
        rest = batch.iloc[at:].reset_index(drop=True)
    if rest is not None:
        yield rest


def _cut(members: DataFrame, sigs: DataFrame, cuts: int) -> list[DataFrame]:
    """Buckets of several groups as written tables band, node, comp, i, j, own. i and j number the
    blocks of a bucket that are compared; own is a node's block."""
    parts, zero = [], F.lit(0)
    for turn in range(cuts + 1):
        sizes = settle(
            members.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(
                F.sum("n").alias("k"), F.max(F.struct("n", "comp")).alias("most"),
                F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where("lo <> hi").select("band", "k", "most"), "bucket-sizes")
        large = sizes.where(F.col("k") > BUCKET)
        parts.append(settle(
            members.join(sizes.where(F.col("k") <= BUCKET).select("band"), "band")
            .select("band", "node", "comp", zero.alias("own"), zero.alias("i"), zero.alias("j")),
            "bucket-whole"))
        if large.isEmpty():
            discard(sizes)
            break
        if turn == cuts:  # what is still large in blocks
            parts.append(settle(_blocks(members, large), "bucket-blocks"))
        else:
            piece = F.pmod(F.col("band") + F.lit(turn * PIECES) + F.col("p"), F.lit(VALUES // PIECE))
            members = settle(
                members.join(large.select("band"), "band").join(sigs, "node")
                .select("band", "node", "comp", "sig", F.explode(F.sequence(
                    F.lit(0), F.lit(PIECES - 1))).alias("p"))
                .select(F.xxhash64("band", "p", F.substr("sig", (piece * PIECE + 1).cast("int"),
                                                         F.lit(PIECE))).alias("band"),
                        "node", "comp"), "bucket-pieces")
        discard(sizes)
    return parts


def _blocks(members: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs of blocks of the ``large`` buckets, but for pairs within a bucket's largest group."""
    sides = large.select(
        "band", F.col("most.comp").alias("main"),
        F.ceil(F.col("most.n") / BLOCK).cast("int").alias("a"),
        F.ceil((F.col("k") - F.col("most.n")) / BLOCK).cast("int").alias("b"))
    inside, h, first = F.col("comp") == F.col("main"), F.xxhash64("node"), F.col("a")
    own = F.when(inside, F.pmod(h, "a")).otherwise(first + F.pmod(h, "b")).cast("int")
    others = F.sequence(F.when(inside, first).otherwise(F.lit(0)), first + F.col("b") - 1)
    return (members.join(sides, "band").withColumn("own", own)
            .select("band", "node", "comp", "own", F.explode(others).alias("other"))
            .select("band", "node", "comp", "own", F.least("own", "other").alias("i"),
                    F.greatest("own", "other").alias("j")))


def _met_before(a: np.ndarray, b: np.ndarray, band: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which pairs share a bucket with a smaller number than ``band``; that one sends them on."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 4096):
        x, y = tags[a[at:at + 4096]], tags[b[at:at + 4096]]
        lower = (x != 0) & (x < band[at:at + 4096, None])
        out[at:at + 4096] = ((x[:, :, None] == y[:, None, :]) & lower[:, :, None]).any(axis=(1, 2))
    return out


def _joining(a: np.ndarray, b: np.ndarray, comp: np.ndarray, matches: np.ndarray) -> list[int]:
    """Of the pairs those that join groups not yet joined by likelier ones."""
    head: dict[int, int] = {}

    def find(x: int) -> int:
        while head.setdefault(x, x) != x:
            head[x] = x = head[head[x]]
        return x

    out = []
    for k in np.argsort(-matches, kind="stable").tolist():
        x, y = find(int(comp[a[k]])), find(int(comp[b[k]]))
        if x != y:
            head[x] = y
            out.append(k)
    return out


def _across(cut: list[DataFrame], sigs: DataFrame, least: list[int], every: bool) -> DataFrame:
    """Surviving pairs of different groups in a bucket: those that join groups, or every one.

    Blocks of buckets are sorted runs in a partition; a partition's runs are compared together, row r
    with row r + 1, r + 2 ... of its run, so that small buckets cost no call of their own. A pair that
    meets in several buckets is sent on by the first of them; each row carries their numbers.
    """
    run = ["band", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(batches, run):
            n = len(pdf)
            keys = pdf[run].to_numpy()
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            size = np.diff(np.r_[first, n])
            bucket = np.repeat(np.arange(len(first)), size)
            end = np.repeat(np.r_[first[1:], n], size)
            sig, node = _matrix(pdf["sig"]), pdf["node"].to_numpy()
            comp, own = pd.factorize(pdf["comp"])[0], pdf["own"].to_numpy()
            alone = keys[:, 1] == keys[:, 2]  # a block with itself
            tags = np.zeros((n, BANDS), np.int64)
            for r, t in enumerate(pdf["tags"]):
                if t is not None:
                    tags[r, :len(t)] = t
            left, step, found = np.arange(n), 0, []
            while True:
                step += 1
                left = left[left + step < end[left]]
                if not len(left):
                    break
                a = left[(comp[left] != comp[left + step])
                         & (alone[left] | (own[left] != own[left + step]))]
                at, matches = _stay(a, a + step, least, sig)
                if every:
                    new = ~_met_before(a[at], a[at] + step, keys[a[at], 0], tags)
                    at, matches = at[new], matches[new]
                if len(at):
                    found.append((a[at], a[at] + step, matches))
            if not found:
                continue
            a, b, matches = (np.concatenate(x) for x in zip(*found))
            if not every:  # per bucket, so that a pair's fate does not hang on the batch
                order = np.argsort(bucket[a], kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[a[order]])) + 1
                keep = [p[k] for p in np.split(order, cuts)
                        for k in _joining(a[p], b[p], comp, matches[p])]
                a, b = a[keep], b[keep]
            pairs = pd.DataFrame({"a": node[a], "b": node[b]})
            swap = pairs["a"] > pairs["b"]
            pairs.loc[swap, ["a", "b"]] = pairs.loc[swap, ["b", "a"]].to_numpy()
            yield pairs.drop_duplicates()

    out = None
    for part in cut:
        rows = part.join(sigs, "node").repartition(*run).sortWithinPartitions(*run)
        pairs = rows.mapInPandas(compare, "a binary, b binary")
        out = pairs if out is None else out.union(pairs)
    return out.distinct()


def _with_groups(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return members.withColumn("comp", F.col("node"))
    return (members.join(groups, "node", "left")
            .select("band", "node", F.coalesce("comp", "node").alias("comp")))


@shielded
def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 85,
                    den: int = 100) -> DataFrame:
    """Add n_shingles, component_id (the least id linked, directly or over others) and kept
    (doc_id = component_id). Linked: den * |intersection| >= num * |union| of the 5-word sets.

    A NULL text or one without words has no shingles and is linked with nothing. NULL ids never
    become a component_id unless a component has no other; such rows are all kept. Rows that repeat
    an id and its text are all kept if one is; ``one_of_each`` drops the repeats. An empty table
    gives an empty result. Input columns with result names are replaced. The result is read from a
    table without texts, so it has every column but the text; shingle sets are written for
    candidates only.
    """
    return _judged(docs, doc_id, text, num, den).drop("_id", "_key", "_group")


def _judged(docs: DataFrame, doc_id: str, text: str, num: int, den: int) -> DataFrame:
    """``near_duplicates`` with the row's _id, _key, a digest of its text, and _group, its component
    (NULL without words)."""
    key = _key(F.col("_text"))
    rest = [c for c in docs.columns if c.lower() not in {*RESULTS, text.lower()}]
    named = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{doc_id}`").alias("_id"),
                        F.col(f"`{text}`").alias("_text"))
    ids = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    signed = F.pandas_udf(_sign, "n long, node binary, bands array<long>")
    signs = settle(named.select(*[F.col(f"`{c}`") for c in rest], "_id", key.alias("_key"),
                                signed("_text").alias("_s"))
                   .select(*[F.col(f"`{c}`") for c in rest], "_id", "_key", "_s.*"), "signatures")
    nodes = settle(signs.where("node is not null").groupBy("node")
                   .agg(F.min("_id").alias("least_id"), F.min(F.struct("_key", "_id")).alias("at"),
                        F.first("bands").alias("bands")), "nodes")

    spread = nodes.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    members = settle(spread.join(shared, "band"), "band-members")
    needed = settle(members.select("node").distinct().join(nodes, "node").select("node", "at.*"),
                    "candidates")
    likely = _marked(ids.withColumn("_key", key), needed.select("_key")).where("_maybe")
    picked = likely.join(
        needed.toDF("node", "k", "i"), (F.col("_key") == F.col("k")) & F.col("_id").eqNullSafe(
            F.col("i"))).dropDuplicates(["node"])
    made = F.pandas_udf(_candidate, "x array<bigint>, sig binary")
    held = settle(picked.select("node", made("_text").alias("c")).select("node", "c.*"),
                  "candidate-sets")
    sets, sigs = held.select("node", "x"), held.select("node", "sig")

    least = least_matches(num / den)
    groups, cut = None, None
    for turn in ("star", "join", "every"):
        placed = _with_groups(members, groups)
        if turn == "star":
            centre = placed.groupBy("band").agg(F.min("node").alias("c"))
            pairs = _pruned(placed.join(centre, "band").where("node <> c").select(
                F.col("c").alias("a"), F.col("node").alias("b")).distinct(), sigs, least)
        else:  # a bucket of two was compared in the first turn
            if cut:
                discard(*cut)
            every = turn == "every"
            sizes = members.groupBy("band").agg(F.count("*").alias("k")).where(
                F.col("k") > (2 if every else JOIN))
            cut = _cut(placed.join(sizes.select("band"), "band"), sigs, 0 if every else CUTS)
            listed = reduce(DataFrame.union, cut if every else cut[:1]).groupBy("node").agg(F.sort_array(F.collect_set("band")).alias("tags"))
            tagged = settle(sigs.join(listed, "node", "left"), "tagged-signatures")
            pairs = _across(cut, tagged, least, every)
        pairs = settle(pairs, "pairs")
        if turn != "star":
            discard(tagged)
        new = settle(_verified(pairs, sets, num, den), f"links-{turn}")
        discard(pairs)
        if new.isEmpty() and groups is not None:
            continue
        links = new if groups is None else new.union(
            groups.select(F.col("node").alias("u"), F.col("comp").alias("v")))
        old, groups = groups, settle(components(links), f"groups-{turn}")
        if old is not None:
            discard(old)

    named_groups = nodes.join(groups, "node", "left").select(
        "node", "least_id", F.coalesce("comp", "node").alias("comp"))
    smallest = named_groups.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    by_node = named_groups.join(smallest, "comp").select("node", "component_id",
                                                         F.col("comp").alias("_group"))
    done = settle(signs.drop("bands").join(by_node, "node", "left")
                  .withColumn("component_id", F.when(F.col("node").isNull(), F.col("_id"))
                              .otherwise(F.col("component_id")))
                  .select(*[F.col(f"`{c}`") for c in rest], "_id", "_key", "_group",
                          F.col("n").alias("n_shingles"), "component_id",
                          F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")), "judged")
    discard(signs, nodes, members, needed, held, groups, *cut)
    return done


@shielded
def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 80,
                den: int = 100) -> DataFrame:
    """One document of each component of ``near_duplicates``, with all its columns: that of the least
    id, NULL last, then of the least digest of its text. Documents without words stay. Rows that
    repeat an id and its text stay once."""
    ids = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    judged = settle(_judged(ids, doc_id, text, num, den).groupBy("_id", "_key")
                    .agg(F.first("_group").alias("_group"), F.count("*").alias("_rows")), "judged")
    first = (judged.where("_group is not null").groupBy("_group")
             .agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_key")).alias("x"))
             .select(F.col("x._id").alias("_i"), F.col("x._key").alias("_k"),
                     F.lit(True).alias("_first")))
    judged = judged.join(first, F.col("_id").eqNullSafe(F.col("_i"))
                         & (F.col("_key") == F.col("_k")), "left").select(
        "_id", "_key", "_rows", (F.col("_group").isNull() | F.col("_first").isNotNull())
        .alias("_kept"))
    judged = settle(judged.where("not _kept or _rows > 1"), "kept-once")
    rows = _marked(docs.withColumn("_key", _key(F.col(f"`{text}`"))), judged)
    untouched = rows.where("not _maybe").drop("_maybe").withColumnRenamed("_key", "_key_of")
    marked = rows.where("_maybe").drop("_maybe").withColumnRenamed("_key", "_key_of")
    same = (F.col(f"`{doc_id}`").eqNullSafe(F.col("_id"))
            & F.col("_key_of").eqNullSafe(F.col("_key")))
    once = untouched.union(marked.join(judged, same, "left_anti"))
    repeated = judged.where("_kept")
    if not repeated.isEmpty():
        once = once.union(marked.join(repeated, same, "left_semi")
                          .dropDuplicates([doc_id, "_key_of"]))
    return once.drop("_key_of")
