"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of 13 words (a shorter item is one window). A window occurs in
a document only if all of its word shingles do, so for set containment one shingle, the rarest, is
the whole necessary prefix. Document shingles meet those prefix tokens in an equi-join; the offset
of the token in its window and the lengths of document and window bound where the window can lie;
what is left is compared word by word with the document.

Only built-in functions are used. What is exploded per document word is three narrow columns, never
the text. Documents with equal texts are one key, and meetings are made distinct before their
shuffle, so copy groups and common passages are small there. The token and window tables are
written first: Spark broadcasts them if their size allows and otherwise shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import ascii_lower, others, settle, shielded

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 5
RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text: Column) -> Column:
    """Runs of digits, letters and anything beyond ASCII, A-Z lower-cased; NULL has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BREAK), ""),
                      F.array().cast("array<string>"))


def _join(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, F.lit(n) if isinstance(n, int) else n), " ")


def _shingle(words: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n)])


def _shingles(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: _shingle(words, i, n))


def positions(narrow: DataFrame, n: int) -> DataFrame:
    """_key, _n, _p, token: the shingles of n words of ``narrow`` (_key, _w) with their places. Short
    texts have none; a filter by their length would make Spark cut every text into words twice, and
    the length is taken before the explode, which copies what its rows need."""
    hashes = F.when(F.col("_n") >= n, _shingles(F.col("_w"), n))
    return narrow.select("_key", "_w", F.size("_w").alias("_n")).select(
        "_key", "_n", F.posexplode(hashes).alias("_p", "token"))


def windows(items: DataFrame, item: str = "item_id", text: str = "text",
            window: int = WINDOW) -> DataFrame:
    """Distinct windows: wtext (words joined by spaces), wlen, items (the ids that hold it)."""
    held = (items.select(F.col(f"`{item}`").cast("string").alias("item"),
                         words_of(F.col(f"`{text}`")).alias("w"))
            .where("item is not null and size(w) > 0"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (held.select("item", "w", F.explode(starts).alias("i"))
            .select("item", F.least(F.size("w"), F.lit(window)).alias("wlen"),
                    _join(F.col("w"), F.col("i"), window).alias("wtext"))
            .groupBy("wtext", "wlen").agg(F.array_sort(F.collect_set("item")).alias("items")))


def prefix_tokens(held: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rarest shingle of each window: token, size, offset, wlen, wtext. Rarity is the number of
    windows with the shingle; ties go by hash, so that windows that overlap tend to share one."""
    w = held.withColumn("w", F.split("wtext", " "))
    size = F.least(F.col("wlen"), F.lit(shingle))
    tokens = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for n in range(1, shingle + 1):
        tokens = tokens.when(F.col("size") == n, _shingle(F.col("w"), F.col("offset"), n))
    each = (w.withColumn("size", size)
            .select("wtext", "wlen", "w", "size",
                    F.explode(F.sequence(F.lit(0), F.col("wlen") - size)).alias("offset"))
            .select("wtext", "wlen", "size", "offset", tokens.alias("token")))
    count = each.groupBy("token").agg(F.count("*").alias("n"))
    return (each.join(count, "token").groupBy("wtext", "wlen", "size")
            .agg(F.min(F.struct("n", "token", "offset")).alias("m"))
            .select("wtext", "wlen", "size", "m.token", "m.offset"))


@shielded
def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, per_cent: int = 5) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256 and contaminated to each document.

    n_hit: words inside any occurrence of a window. items_sha256: of the ids of the items with an
    occurring window, sorted as strings, comma-joined. contaminated: at least one word is hit and
    the hit words are ``per_cent`` or more of all. A NULL or empty text has no words and is not
    contaminated; items with a NULL id or no words are ignored; rows of one item id count as one
    item. Equal rows get equal results and stay repeated; document ids are not read; empty tables
    are fine on either side; input columns with result names are replaced.
    """
    keep = others(docs, RESULTS)
    held = settle(windows(items, item, item_text, window), "windows")
    tokens = settle(prefix_tokens(held), "prefix-tokens")
    sizes = sorted(r[0] for r in tokens.select("size").distinct().collect())  # at most SHINGLE

    key = F.unhex(F.md5(F.encode(F.col(f"`{text}`"), "utf-8")))
    narrow = (docs.where(F.col(f"`{text}`").isNotNull())
              .select(key.alias("_key"), words_of(F.col(f"`{text}`")).alias("_w")))
    found = None
    for n in sizes:
        start = F.col("_p") - F.col("offset")
        met = (positions(narrow, n).join(tokens.where(F.col("size") == n), "token")
               .where((start >= 0) & (start + F.col("wlen") <= F.col("_n")))
               .select("_key", start.alias("start"), "wlen", "wtext"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = narrow.limit(0).select("_key", F.lit(0).alias("start"), F.lit(0).alias("wlen"),
                                       F.lit("").alias("wtext"))
    # A document's meetings are at most its words times the windows behind one token.
    meetings = (found.distinct().join(held, ["wtext", "wlen"])
                .groupBy("_key").agg(F.collect_list(F.struct("start", "wlen", "wtext", "items"))
                                     .alias("_met")))

    placed = (docs.select(*keep, key.alias("_key")).join(meetings, "_key", "left")
              .withColumn("_w", words_of(F.col(f"`{text}`"))))
    exact = F.filter("_met", lambda m: _join(F.col("_w"), m["start"], m["wlen"]) == m["wtext"])
    spans = F.array_sort(F.array_distinct(F.transform(
        "_hits", lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["wlen"]).alias("b")))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["to"]), F.lit(0))).alias("n"),
            F.greatest(s["to"], x["b"]).alias("to")))["n"]
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda m: m["items"]))))
    none = F.lit(0).cast("long")
    return (placed.withColumn("_hits", exact)
            .select(*keep, F.size("_w").cast("long").alias("n_words"),
                    F.coalesce(covered.cast("long"), none).alias("n_hit"),
                    F.coalesce(ids, F.array().cast("array<string>")).alias("_ids"))
            .select(*keep, "n_words", "n_hit", F.size("_ids").cast("long").alias("n_items"),
                    F.sha2(F.array_join("_ids", ","), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0)
                     & (100 * F.col("n_hit") >= per_cent * F.col("n_words"))).alias("contaminated")))
