"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document
with a smaller id, or earlier in the same one.

Not every suffix has to be sorted. Each window of LENGTH bytes has an anchor: the leftmost least
hash among its ``GRAM``-byte pieces. Equal windows have equal anchors at equal offsets, so
1. anchors whose piece occurs once in the corpus rule out every window they stand for;
2. the other anchors' suffixes, with the bytes to their left, are sorted: each task sorts its own
   into a run, drops those that equal an earlier one of the run in all they could be compared in,
   front-codes the rest (length of the common prefix, rest of the bytes) and sends it to the
   partition of its anchor;
3. a partition merges its runs with a loser tree that knows each head's common prefix with the last
   winner, so bytes known to be equal are never compared again. The merge leaves suffixes in order
   with the length of the common prefix of neighbours. For each offset, neighbours that agree far
   enough right, and equally far left, are equal windows; all but the earliest are removed. What a
   partition finds goes out packed by bucket of documents, and each bucket is put together.

Hot anchors (a line or passage that a large part of the corpus shares) are split by offset and by
the window's own bytes: equal windows were already reduced to one per run, different ones go to
different partitions. Anchors are shuffled once, by their hash, and counted as they come in its
order. Text is shuffled by document twice, packed, to fetch suffixes and to cut spans; tables in
between are removed when they have been read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import discard, settle, shielded

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # pieces in a window, each a possible offset of its anchor
HOT = 20_000  # occurrences from which an anchor is split by offset: a fifth of a partition
PART_SUFFIXES = 100_000  # suffixes that a merge partition takes, about
BLOCK = 1 << 16  # windows that are hashed at a time
RUNS_A_BATCH = 256  # runs that leave a task together
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
LAST_ID = 2**63 - 1  # stands for a NULL id: after all others

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        np.cumprod(np.full(n - 1, _BASE, np.uint64), out=out[1:])
    return out


_POWER = _powers(GRAM)


def _piece_hashes(b: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each GRAM-byte piece, by doubling: pieces of 1, 2, 4, .. bytes."""
    h = b.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < GRAM:
        h = h[:-width] * _POWER[width] + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text, their hashes, and the first and last window start that
    each stands for."""
    none = np.empty(0, np.int64)
    if len(b) < LENGTH:
        return none, none.astype(np.uint64), none, none
    h = _piece_hashes(b)
    # Leftmost least of each SPAN pieces: least of prefixes and suffixes of blocks of SPAN.
    n = len(h)
    order = np.arange(n, dtype=np.int64)
    best_h, best_i, width = h, order, 1
    while width * 2 <= SPAN:
        left_h, right_h = best_h[:-width], best_h[width:]
        take = right_h < left_h
        best_h = np.where(take, right_h, left_h)
        best_i = np.where(take, best_i[width:], best_i[:-width])
        width *= 2
    rest = SPAN - width
    m = n - SPAN + 1
    left_h, right_h = best_h[:m], best_h[rest:rest + m]
    at = np.where(right_h < left_h, best_i[rest:rest + m], best_i[:m])
    change = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [m - 1]])
    where = at[first]
    return where, h[where], first, last


def _bytes(text: str | None) -> bytes:
    return (text or "").encode()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_doc, _txt (with it a document is known; rows that repeat both are the same document)."""
    return docs.select(
        "*", F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID)).alias("_doc"),
        F.xxhash64(F.col(f"`{text}`"), F.lit(1)).alias("_txt"))


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An anchor in one number: position, offset of its first and of its last window."""
    for pdf in batches:
        docs, texts, hashes, places = [], [], [], []
        for d, x, t in zip(pdf["_doc"], pdf["_txt"], pdf["_text"]):
            at, h, first, last = anchors(np.frombuffer(_bytes(t), np.uint8))
            docs.append(np.full(len(at), d, np.int64))
            texts.append(np.full(len(at), x, np.int64))
            hashes.append(h.view(np.int64))
            places.append((at << 16) | ((at - last) << 8) | (at - first))
        if docs:
            yield pd.DataFrame({"_doc": np.concatenate(docs), "_txt": np.concatenate(texts),
                                "h": np.concatenate(hashes), "place": np.concatenate(places)})


def _repeats(hot: int):
    """Rows in the order of h -> those whose h occurs twice, with n, the count up to ``hot``. At most
    ``hot`` rows of one h wait for it to be known."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, known = None, None  # rows of the last h; an h that has been found hot
        for batch in batches:
            if known is not None:
                same = batch["h"].to_numpy() == known
                if same.any():
                    yield batch[same].assign(n=hot)
                batch = batch[~same]
            if batch.empty:
                continue
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            h = batch["h"].to_numpy()
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.repeat(np.diff(np.r_[start, len(h)]), np.diff(np.r_[start, len(h)]))
            open_ = np.arange(len(h)) >= start[-1]
            if n[-1] >= hot:
                known, rest = h[-1], None
                open_[:] = False
            else:
                known, rest = None, batch[open_].reset_index(drop=True)
            out = ~open_ & (n > 1)
            if out.any():
                yield batch[out].assign(n=np.minimum(n[out], hot))
        if rest is not None and len(rest) > 1:
            yield rest.assign(n=len(rest))
    return count


def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([zstandard.compress(_bytes(t)) for t in texts], dtype=object)


def _unpacked(packed: pd.Series) -> pd.Series:
    return pd.Series([zstandard.decompress(z).decode() for z in packed], dtype=object)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at."""
    n = min(len(a), len(b))
    lo = known
    step = 8
    while lo < n and a[lo:lo + step] == b[lo:lo + step]:
        lo += step
        step *= 2
    if lo >= n:
        return n
    hi = min(lo + step, n)
    while lo < hi:
        mid = (lo + hi) // 2
        if a[lo:mid + 1] == b[lo:mid + 1]:
            lo = mid + 1
        else:
            hi = mid
    return lo


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """A sorted run as common prefixes with the string before, the bytes after them, lengths."""
    lcp, rest, before = np.zeros(len(strings), np.uint8), [], b""
    for i, s in enumerate(strings):
        k = common_prefix(before, s, 0)
        lcp[i] = k
        rest.append(s[k:])
        before = s
    return lcp, b"".join(rest), np.array([len(s) for s in strings], np.uint8)


def front_decode(lcp: np.ndarray, rest: bytes, lengths: np.ndarray) -> list[bytes]:
    out, before, at = [], b"", 0
    for k, n in zip(lcp.tolist(), lengths.tolist()):
        before = before[:k] + rest[at:at + n - k]
        at += n - k
        out.append(before)
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs, each with its common prefixes. Yields run, place in it, and the common
    prefix with the string yielded before.

    A loser tree whose entries know their common prefix with the last winner: of two heads the one
    with the longer such prefix is the smaller; only equal ones are compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    heads = [0] * k
    strings = [r[0] for r in runs]
    size = [len(s) for s in strings] + [0] * (k - len(runs))
    known = [0] * k  # common prefix of each run's head with the last winner

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one with the winner"""
        if heads[b] >= size[b]:
            return a, b
        if heads[a] >= size[a]:
            return b, a
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        x, y = strings[a][heads[a]], strings[b][heads[b]]
        n = common_prefix(x, y, ka)
        if x[n:n + 1] < y[n:n + 1] or (n == len(x) == len(y) and a < b):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers, winners = [0] * k, [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    top = winners[1]
    while heads[top] < size[top]:
        yield top, heads[top], known[top]
        heads[top] += 1
        if heads[top] < size[top]:
            known[top] = runs[top][1][heads[top]]  # with the string before it: the winner
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


_WIRE = "part long, run binary, _doc long, _txt long, spans binary"


def _items(texts: list[bytes], places: pd.Series, counts: pd.Series, hashes: pd.Series, hot: int,
           parts: int) -> tuple[np.ndarray, ...]:
    """Numbers of a batch's suffixes: text, place, least and greatest offset, part. An anchor that is
    hot gives one for each of its windows, in the part of the window's own bytes."""
    text = np.repeat(np.arange(len(texts)), [len(p) for p in places])
    place = np.concatenate(places.to_list()).astype(np.int64)
    at, low, high = place >> 16, (place >> 8) & 255, place & 255
    part = np.concatenate(hashes.to_list()).astype(np.int64) % parts
    often = np.concatenate(counts.to_list()) >= hot
    rest, own = np.flatnonzero(~often), np.flatnonzero(often)
    wide = high[own] - low[own] + 1
    many = np.repeat(own, wide)
    offset = low[many] + np.arange(len(many)) - np.repeat(np.cumsum(wide) - wide, wide)
    dealt = np.empty(len(many), np.int64)
    for a in range(0, len(many), BLOCK):
        some = slice(a, a + BLOCK)
        starts = zip(text[many[some]].tolist(), (at[many[some]] - offset[some]).tolist())
        dealt[some] = [xxhash.xxh64_intdigest(texts[t][s:s + LENGTH]) % parts for t, s in starts]
    pick = np.concatenate([rest, many])
    return (text[pick].astype(np.int32), at[pick].astype(np.int32),
            np.concatenate([low[rest], offset]).astype(np.uint8),
            np.concatenate([high[rest], offset]).astype(np.uint8),
            np.concatenate([part[rest], dealt]))


def _runs(hot: int, parts: int):
    """Pandas batches of documents with their repeated anchors -> runs and spans settled here. A
    batch's suffixes are numbers; their bytes are cut for one part at a time."""
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            texts = [zstandard.decompress(z) for z in pdf["_z"]]
            docs, digests = pdf["_doc"].tolist(), pdf["_txt"].tolist()
            *numbers, part = _items(texts, pdf["_place"], pdf["_n"], pdf["_h"], hot, parts)
            order = np.argsort(part, kind="stable")
            ends = np.r_[np.flatnonzero(np.diff(part[order])) + 1, len(order)].tolist()
            settled, rows, start = [], [], 0
            for end in ends:
                own = order[start:end]
                start = end
                # right, left reversed, least and greatest offset, document, its digest, place, text
                items = sorted([
                    (texts[t][at:at + LENGTH - low], texts[t][at - high:at][::-1], low, high,
                     docs[t], digests[t], at, t)
                    for t, at, low, high in zip(*[x[own].tolist() for x in numbers])])
                kept, spans = items[:1], []
                for i in items[1:]:
                    if kept[-1][:4] != i[:4]:
                        kept.append(i)
                    # An earlier one of this run is equal in every window that this one stands for.
                    elif kept[-1][4:7] != i[4:7]:
                        spans.append((i[7], i[6] - i[3], i[6] - i[2] + LENGTH))
                rows.append((int(part[own[0]]), _pack(kept), None, None, None))
                if spans:
                    settled.append(np.array(spans, np.int32))
                if len(rows) == RUNS_A_BATCH:
                    yield _wire(rows)
                    rows = []
            yield _wire(rows)
            if settled:
                yield _wire([(None, None, docs[t], digests[t], s.tobytes())
                             for t, s in _by_text(np.concatenate(settled))])
    return send


def _by_text(spans: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of text, start and end -> each text with its joined spans."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    for own in np.split(spans, np.flatnonzero(np.diff(spans[:, 0])) + 1):
        yield int(own[0, 0]), _joined(own[:, 1:])


def _wire(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows)) if rows else [()] * 5
    return pd.DataFrame({name: pd.Series(list(c), dtype=kind) for name, c, kind in zip(
        ("part", "run", "_doc", "_txt", "spans"), columns,
        ("Int64", object, "Int64", "Int64", object))})


def _pack(own: list[tuple]) -> bytes:
    lcp, rest, lengths = front_code([i[0] for i in own])
    left = b"".join([i[1] for i in own])
    meta = np.array([[len(i[1]), i[2], i[3]] for i in own], np.uint8)
    ids = np.array([[i[4], i[5], i[6]] for i in own], np.int64)
    head = np.array([len(own), len(rest), len(left)], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), lcp.tobytes(), lengths.tobytes(),
                                        meta.tobytes(), ids.tobytes(), rest, left]))


def _unpack(packed: bytes):
    blob = zstandard.decompress(packed)
    n, r, m = np.frombuffer(blob, np.int64, 3).tolist()
    at = 24
    lcp = np.frombuffer(blob, np.uint8, n, at)
    lengths = np.frombuffer(blob, np.uint8, n, at + n)
    meta = np.frombuffer(blob, np.uint8, 3 * n, at + 2 * n).reshape(n, 3)
    ids = np.frombuffer(blob, np.int64, 3 * n, at + 5 * n).reshape(n, 3)
    at += 5 * n + 24 * n
    return lcp, front_decode(lcp, blob[at:at + r], lengths), meta, ids, blob[at + r:at + r + m]


def _equal_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of a partition; spans of windows that also start earlier."""
    runs = [_unpack(b) for b in pdf["run"]]
    order, lcp = [], []
    for run, i, k in merge([(r[1], r[0].tolist()) for r in runs]):
        order.append((run, i))
        lcp.append(k)
    n = len(order)
    base = np.cumsum([0] + [len(r[1]) for r in runs])
    pick = np.array([base[run] + i for run, i in order], np.int64)
    meta = np.concatenate([r[2] for r in runs])[pick].astype(np.int64)
    ids = np.concatenate([r[3] for r in runs])[pick]
    lefts: list[bytes] = []
    for r in runs:
        ends = np.cumsum(r[2][:, 0].astype(np.int64))
        lefts += [r[4][e - s:e] for e, s in zip(ends.tolist(), r[2][:, 0].tolist())]
    lefts = [lefts[p] for p in pick.tolist()]
    lcp_a = np.array(lcp, np.int64)
    left_order = np.array(sorted(range(n), key=lefts.__getitem__), np.int64)
    left_lcp, before = np.zeros(n, np.int64), b""
    for j, i in enumerate(left_order.tolist()):
        left_lcp[j] = common_prefix(before, lefts[i], 0)
        before = lefts[i]
    age = np.empty(n, np.int64)  # by document, then place
    age[np.lexsort((ids[:, 2], ids[:, 1], ids[:, 0]))] = np.arange(n)

    # Windows of one suffix overlap: together they are the span from its first to its last.
    least, most = np.full(n, SPAN, np.int64), np.full(n, -1, np.int64)
    for o in range(SPAN):
        mine = np.flatnonzero((meta[:, 1] <= o) & (o <= meta[:, 2]))
        if not len(mine):
            continue
        right_group = np.cumsum(lcp_a < LENGTH - o)
        left_group = np.empty(n, np.int64)
        left_group[left_order] = np.cumsum(left_lcp < o) if o else 0
        key = right_group[mine] * (n + 1) + left_group[mine]
        by = np.lexsort((age[mine], key))
        k = key[by]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        first = mine[by][np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = mine[by]
        # Rows of one id with different texts count as one document each, in the order of _txt.
        dup = (~new) & (age[later] > age[first]) & (
            (ids[later, 0] != ids[first, 0]) | (ids[later, 1] != ids[first, 1])
            | (ids[later, 2] != ids[first, 2]))
        hit = later[dup]
        least[hit] = np.minimum(least[hit], o)
        most[hit] = o
    hit = np.flatnonzero(most >= 0)
    rows = np.column_stack([ids[hit], ids[hit, 2] - least[hit] + LENGTH])
    rows[:, 2] -= most[hit]
    bucket = (rows[:, 0] ^ rows[:, 1]) % int(pdf["parts"].iat[0])
    order = np.argsort(bucket, kind="stable")
    own = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return pd.DataFrame({
        "bucket": np.array([bucket[o[0]] for o in own], np.int64),
        "run": pd.Series([zstandard.compress(rows[o].tobytes()) for o in own], dtype=object)})


def _spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """The partitions' findings for one bucket of documents: a row per document."""
    rows = np.concatenate([np.frombuffer(zstandard.decompress(b), np.int64).reshape(-1, 4)
                           for b in pdf["run"]])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    cut = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
    parts = np.split(rows, cut) if len(rows) else []
    return pd.DataFrame({
        "_doc": np.array([x[0, 0] for x in parts], np.int64),
        "_txt": np.array([x[0, 1] for x in parts], np.int64),
        "spans": pd.Series([_joined(x[:, 2:]).tobytes() for x in parts], dtype=object)})


def _joined(spans: np.ndarray) -> np.ndarray:
    """Sorted, overlapping and touching spans as one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    ends = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]
    return np.column_stack([spans[new, 0], ends])


def _cut(packed: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for z, held in zip(packed, spans):
        b = zstandard.decompress(z)
        if held is None or not len(held):
            rows.append((len(b), 0, 0, hashlib.sha256(b).hexdigest(), []))
            continue
        s = _joined(np.concatenate([np.frombuffer(x, np.int64) for x in held]).reshape(-1, 2))
        digest, at = hashlib.sha256(), 0
        for a, e in s.tolist():
            digest.update(b[at:a])
            at = e
        digest.update(b[at:])
        rows.append((len(b), int((s[:, 1] - s[:, 0]).sum()), len(s), digest.hexdigest(),
                     s.tolist()))
    return pd.DataFrame(rows, columns=[*RESULTS, "removed"])


@shielded
def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT
             ) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_sha256 and removed (the spans, start and end).

    A NULL text is empty. A NULL id comes after all others. Rows that repeat an id and its text are
    one document; rows of one id with different texts are different documents, ordered by a digest.
    Ids are integers. Texts shorter than LENGTH are left alone. An empty table stays empty; input
    columns with result names are replaced; the text comes back from its packed form, NULL as NULL.
    """
    keep = [c for c in docs.columns if c.lower() not in {*RESULTS, "removed", text.lower()}]
    packed = F.pandas_udf(_packed, "binary")
    keyed = _keyed(docs, doc_id, text).withColumn("_text", F.col(f"`{text}`"))
    texts = keyed.where(F.octet_length("_text") >= LENGTH).select("_doc", "_txt", "_text")
    found = texts.mapInPandas(_anchor_rows, "_doc long, _txt long, h long, place long")
    marks = settle(found.repartition("h").sortWithinPartitions("h").mapInPandas(
        _repeats(hot), "_doc long, _txt long, h long, place long, n long"), "repeated-anchors")
    total = marks.agg(F.sum(F.when(F.col("n") < hot, 1).otherwise(
        F.col("place").bitwiseAND(255)
        - F.shiftright("place", 8).bitwiseAND(255) + 1))).first()[0] or 0
    parts = int(total // PART_SUFFIXES) + 1
    # A document's marks are bounded by its own length.
    by_doc = marks.groupBy("_doc", "_txt").agg(
        F.collect_set(F.struct("place", "n", "h")).alias("_marks"))
    wire = settle(texts.select("_doc", "_txt", packed("_text").alias("_z"))
                  .join(by_doc, ["_doc", "_txt"])
                  .select("_doc", "_txt", "_z", F.col("_marks.place").alias("_place"),
                          F.col("_marks.n").alias("_n"), F.col("_marks.h").alias("_h"))
                  .mapInPandas(_runs(hot, parts), _WIRE), "suffix-runs")
    discard(marks)
    merged = (wire.where("part is not null").select("part", "run", F.lit(parts).alias("parts"))
              .groupBy("part").applyInPandas(_equal_windows, "bucket long, run binary")
              .groupBy("bucket").applyInPandas(_spans, "_doc long, _txt long, spans binary"))
    spans = settle(merged.union(wire.where("part is null").select("_doc", "_txt", "spans"))
                   .groupBy("_doc", "_txt").agg(F.collect_list("spans").alias("_spans")),
                   "repeated-spans")
    discard(wire)
    cut = F.pandas_udf(_cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                             "removed array<array<bigint>>")
    unpacked = F.pandas_udf(_unpacked, "string")
    out = (keyed.select(*[F.col(f"`{c}`") for c in keep], "_doc", "_txt",
                        packed("_text").alias("_z"), F.col("_text").isNull().alias("_none"))
           .join(spans, ["_doc", "_txt"], "left"))
    # the text column is made only where it is selected
    return out.select(*[F.when(~F.col("_none"), unpacked("_z")).alias(c)
                        if c.lower() == text.lower() else F.col(f"`{c}`")
                        for c in docs.columns if c.lower() not in {*RESULTS, "removed"}],
                      cut("_z", "_spans").alias("_cut")).select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*RESULTS, "removed"}],
        *[F.col(f"_cut.{r}").alias(r) for r in [*RESULTS, "removed"]])
