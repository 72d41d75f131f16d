"""Byte-pair encoding without replaying merges, and decoding by offsets.

Every encoding that merges produce has the property that each two neighbours are what merging would
give for their joined bytes. So the encoder walks from the left with the longest token that starts
at each place (found by one Aho-Corasick pass), checks only neighbouring pairs, and steps back to a
shorter token where a pair does not hold. Places that failed are remembered, which keeps the walk
linear. Decoding reads each token's bytes between two entries of an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltarc.llm.common import others, shielded

#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CACHED_WORDS = 200_000  # words that a worker remembers, and as many of the time before
CACHED_LENGTH = 64
SLICE = 256  # rows whose token ids are handed over at once
#: The same cut by the faster standard module, for texts of characters on which both agree:
#: there, a letter is what is neither digit, underscore nor non-word.
_COMMON_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+"
                           r"|\s+(?!\S)|\s+")
_UNCOMMON = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0590-\u1fff\u2070-\U0010ffff]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A byte-level vocabulary. Ids need not follow the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self._cut = regex.compile("|".join(map(regex.escape, sorted(
            self.special, key=len, reverse=True)))) if self.special else None
        self._words = regex.compile(WORDS)

        size = 1 + max([*vocab.values(), *self.special.values()])
        content = [b""] * size
        for b, i in vocab.items():
            content[i] = b
        for s, i in self.special.items():
            content[i] = s.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in content], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(content), np.uint8)

        # rank: order of creation; halves: what a token was merged from (bytes are whole).
        self._rank = {i: -1 for b, i in vocab.items() if len(b) == 1}
        self._halves: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letters[c] for c in x)
                    for x in (m if isinstance(m, list) else m.split(" ")))
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self._merged.setdefault(pair, rank)
            if made not in self._halves and len(a + b) > 1:
                self._halves[made], self._rank[made] = pair, rank
        self._fits: dict[int, bool] = {}  # of both tokens as one number
        self._decimal = [str(i) for i in range(size)]
        self._length = {i: len(b) for b, i in vocab.items() if i in self._rank}
        self._auto = ahocorasick.Automaton()
        for b, i in vocab.items():
            if i in self._rank:
                self._auto.add_word(b.decode("latin-1"), (i, len(b)))
        self._auto.make_automaton()
        # shorter: the longest token that is a proper prefix.
        known = {b: i for b, i in vocab.items() if i in self._rank}
        self._shorter: dict[int, int] = {}
        for b, i in known.items():
            for n in range(len(b) - 1, 0, -1):
                if b[:n] in known:
                    self._shorter[i] = known[b[:n]]
                    break
        # Words seen lately, and those seen before them, with their ids as 32-bit numbers.
        self._seen: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def forget(self) -> None:
        """Free what the words so far have left; the vocabulary stays."""
        for known in (self._seen, self._before, self._fits):
            known.clear()

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens open: no pair of parts that meet
        there joins before both tokens are complete."""
        pair = left * len(self._decimal) + right
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[pair] = self._border(left, right)
        return known

    def _border(self, left: int, right: int) -> bool:
        # The parts that touch the border, newest first: undo the youngest merge of the two sides
        # and see whether the touching parts would have joined before that merge took place.
        merged, rank, halves = self._merged, self._rank, self._halves
        until, undone_right = float("inf"), False
        while True:
            made = merged.get((left, right))
            # Of equal merges the one further left takes place first.
            if made is not None and (made < until or (made == until and undone_right)):
                return False
            newest = max(rank[left], rank[right])
            if newest < 0:
                return True
            undone_right, until = rank[right] == newest, newest
            if undone_right:
                right = halves[right][0]
            else:
                left = halves[left][1]

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        longest = [-1] * (n + 1)
        for end, (token, length) in self._auto.iter(word.decode("latin-1")):
            longest[end - length + 1] = token
        out: list[int] = []
        length, shorter, fits = self._length, self._shorter, self.fits
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while token >= 0:
            while True:
                end = at + length[token]
                if alive[end] and (not out or fits(out[-1], token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                if token in shorter:
                    token = shorter[token]
                    continue
                alive[at] = 0
                if not out:
                    raise ValueError("a byte is not in the vocabulary")
                token = out.pop()
                at -= length[token]
        return out

    def _encoded(self, word: str) -> bytes:
        entry = self._before.get(word)
        if entry is None:
            entry = array("i", self.encode_word(word.encode())).tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self._seen) >= CACHED_WORDS:
                self._before = dict(self._seen)
                self._seen.clear()
            self._seen[word] = entry
        return entry

    def _entries(self, text: str) -> list[bytes]:
        get, encoded = self._seen.get, self._encoded
        cut = self._words if _UNCOMMON.search(text) else _COMMON_WORDS
        return [get(w) or encoded(w) for w in cut.findall(text)]

    def ids_of(self, text: str) -> np.ndarray:
        if self._cut is None or not self._cut.search(text):
            return np.frombuffer(b"".join(self._entries(text)), np.int32)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += self._entries(text[at:m.start()])
            out.append(array("i", [self.special[m[0]]]).tobytes())
            at = m.end()
        return np.frombuffer(b"".join(out + self._entries(text[at:])), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.ids_of(text).tolist()

    def joined(self, ids: np.ndarray) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self._decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Bytes that are no valid UTF-8 become replacement characters."""
        if not len(ids):
            return ""
        picked = np.asarray(ids, np.int64)
        starts = self.offsets[picked]
        lengths = self.offsets[picked + 1] - starts
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self.blob[where].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    return BytePairs(path)


@shielded
def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int). A NULL text counts as empty and gives an empty array."""
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([bpe.ids_of(t or "") for t in texts], dtype=object)

    return docs.select(*others(docs, ["ids"]), ids(F.col(f"`{text}`")).alias("ids"))


@shielded
def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``. A NULL or empty array gives an empty text."""
    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series(["" if v is None else bpe.decode(v) for v in values], dtype=object)

    return docs.select(*others(docs, ["decoded"]), texts(F.col(f"`{ids}`")).alias("decoded"))


@shielded
def digests(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, decode again and add n_tokens, ids_sha256 and decoded_sha256, in one pass;
    ``with_ids`` adds the token ids themselves, which take the place of the text.

    ``path``: the vocabulary file, present on every executor. A NULL text counts as empty: no
    tokens, digests of nothing. Strings of special tokens in a text are those tokens. Repeated
    rows stay repeated; input columns with result names are replaced. A text is handled whole; a
    worker holds one batch and a memory of ``CACHED_WORDS`` words at most.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    types = [T.LongType(), T.StringType(), T.StringType()]

    def row(bpe: BytePairs, t: str | None) -> tuple:
        ids = bpe.ids_of(t or "")
        return (len(ids), hashlib.sha256(bpe.joined(ids).encode()).hexdigest(),
                hashlib.sha256(bpe.decode(ids).encode()).hexdigest(), ids)

    if with_ids:
        keep = others(docs, [*names, "ids", text])
        held = docs.select(*keep, F.col(f"`{text}`").alias("_text"))

        def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Output in slices of ``SLICE`` rows, as ids are larger than what is known of them. A
            worker outlives its task, so the words are forgotten at the end of it."""
            bpe = load(path)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    n, ids_sha, decoded_sha, ids = zip(*[row(bpe, t) for t in part[-1].to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(ids_sha),
                         pa.array(decoded_sha), pa.array(ids, pa.list_(pa.int32()))],
                        [*part.schema.names[:-1], *names, "ids"])
            bpe.forget()

        schema = T.StructType([f for f in held.schema.fields if f.name != "_text"])
        for name, kind in zip([*names, "ids"], [*types, T.ArrayType(T.IntegerType())]):
            schema = schema.add(name, kind)
        return held.mapInArrow(slices, schema)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        bpe = load(path)
        return pd.DataFrame([row(bpe, t)[:3] for t in texts], columns=names)

    return (docs.select(*others(docs, names), both(F.col(f"`{text}`")).alias("_bpe"))
            .select(*others(docs, names), *[F.col(f"_bpe.{n}").alias(n) for n in names]))
