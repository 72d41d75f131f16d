"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voltarc.llm import (bpe, decontaminate, language_id, near_dedup, perplexity, pii,
                         quality_rules, suffix_dedup, toxicity, url_filter)

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 700} and{i % 11}" for i in range(20_000))
PLAIN = "the quick brown fox jumps over the lazy dog while a small bird sings in the old tree. "
ROWS = [(1, PLAIN * 3, "en"), (1, PLAIN * 3, "en"), (2, None, "en"), (3, "", None), (4, LONG, "en"),
        (None, PLAIN * 2, "de"), (None, None, None), (5, "123 456 \n\t ", "en"), (6, "één ", "nl"),
        (7, PLAIN * 3 + "tail of other words", "en")]
SCHEMA = "doc_id long, text string, lang string"
#: Names that operators use for results or might use inside.
CLASHING = ["host", "n_words", "kept", "_text", "_key", "_id", "node", "band", "n", "a", "spans",
            "token", "_doc", "p_toxic", "perplexity", "_words", "item", "score"]


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0), (None, 1), (4, None)],
                                   "doc_id long, toxic int")
    items = spark.createDataFrame([(10, PLAIN), (11, None), (12, ""), (None, PLAIN), (13, "bird"),
                                   (10, "sings in")], "item_id long, text string")
    chain = toxicity.Chain(["toxic"], {"fox": 0}, [np.array([9.0])], [-3.0])
    langs = language_id.from_counts({"en": language_id.counts(PLAIN),
                                     "nl": language_id.counts("de snelle bruine vos één ")})
    trusted = labels.select("doc_id").where("doc_id = 1")
    return {
        "toxicity": lambda d: toxicity.classify(d, chain),
        "language": lambda d: language_id.identify(d, langs),
        "near": near_dedup.near_duplicates,
        "near_one": near_dedup.one_of_each,
        "suffix": suffix_dedup.repeated,
        "benchmark": lambda d: decontaminate.contaminated(d, items),
        "quality": quality_rules.judge,
        "bpe": lambda d: bpe.digests(d, PATH),
        "perplexity": lambda d: perplexity.judge(d, trusted),
        "pii": pii.detect,
    }


NAMES = ["toxicity", "language", "near", "near_one", "suffix", "benchmark", "quality", "bpe",
         "perplexity", "pii"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_stay(spark, name):
    op = operators(spark)[name]
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    plain = op(docs).collect()
    if name == "near_one":  # of 1, 1, 7 (17 shingles of 21) and the equal set without an id one stays
        assert sorted(r.doc_id or 0 for r in plain) == [0, 1, 2, 3, 4, 5, 6]
    else:
        assert len(plain) == len(ROWS)
        one = [r.asDict() for r in plain if r.doc_id == 1]
        assert one[0] == one[1]  # equal rows get equal results

    clashing = docs
    for c in CLASHING:
        clashing = clashing.withColumn(c, F.lit("mine"))
    wide = op(clashing)
    assert len(wide.columns) == len({c.lower() for c in wide.columns})
    results = [c for c in op(docs).columns if c not in docs.columns]
    left = [c for c in CLASHING if c not in results]
    rows = wide.collect()
    assert len(rows) == len(plain)
    assert all(r[c] == "mine" for r in rows for c in left)
    key = lambda r: str([r[c] for c in ["doc_id", *results]])
    assert sorted(map(key, rows)) == sorted(map(key, plain))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    out = operators(spark)[name](docs)
    assert out.count() == 0 and "doc_id" in out.columns


def test_urls(spark):
    rules = url_filter.rule_table(spark, [("org", "/", "allow"), ("a.org", "/x", "block"),
                                          ("a.org", "/x", "allow"), ("b.org", "", "block")])
    urls = [("http://A.org/xy?q", "block", "a.org/x"), ("http://za.org/x", "allow", "org/"),
            ("http://a.org", "allow", None), ("s.b.org", "allow", None), (None, "allow", None),
            ("x://s.b.org#f", "block", "b.org"), ("x://s.b.org/", "block", "b.org"),
            ("http://a.org/xy?q", "block", "a.org/x"), ("://", "allow", None)]
    df = spark.createDataFrame([(i, u, "mine") for i, (u, _, _) in enumerate(urls)],
                               "page_id int, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, rules).collect()}
    assert [(got[i].verdict, got[i].rule) for i in range(len(urls))] == [u[1:] for u in urls]
    assert got[0].host == "a.org" and got[0].path == "/xy"
    assert url_filter.judge(df.limit(0), rules).count() == 0
    none = url_filter.judge(df, url_filter.rule_table(spark, []), default="block")
    assert {r.verdict for r in none.collect()} == {"block"}


def test_near_groups(spark):
    """Chains of similar texts, a large group of near copies, and texts under five words."""
    base = [f"w{i}" for i in range(120)]
    rows = [(1000 + k, " ".join([*base[:60], f"x{k}", *base[61:]])) for k in range(300)]
    rows += [(5, "one two"), (6, "ONE  two"), (7, "two one"), (8, None)]
    chain = list(base) + [f"c{i}" for i in range(40)]
    for k in range(6):
        chain[k * 20] = f"new{k}"
        rows.append((2000 + k, " ".join(chain)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[1000 + k] for k in range(300)} == {1000}
    assert (got[5], got[6], got[7], got[8]) == (5, 5, 7, 8)
    assert {got[2000 + k] for k in range(6)} == {2000}


def test_sequential_bounds():
    """At the threshold a true pair is lost with a probability of about MISS a batch."""
    from math import comb

    least = near_dedup.least_matches(0.85)
    assert len(least) == near_dedup.VALUES // near_dedup.BATCH
    for n, m in zip(range(near_dedup.BATCH, near_dedup.VALUES + 1, near_dedup.BATCH), least):
        lost = sum(comb(n, k) * 0.85**k * 0.15**(n - k) for k in range(m))
        assert lost < 10 * near_dedup.MISS


def test_loser_tree():
    rng = np.random.default_rng(3)
    runs, every = [], []
    for _ in range(5):
        own = sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8))
                     for _ in range(int(rng.integers(0, 40))))
        lcp, rest, lengths = suffix_dedup.front_code(own)
        assert suffix_dedup.front_decode(lcp, rest, lengths) == own
        runs.append((own, lcp.tolist()))
        every += own
    merged, before = [], b""
    for run, i, k in suffix_dedup.merge(runs):
        s = runs[run][0][i]
        assert k == suffix_dedup.common_prefix(before, s, 0)
        merged.append(s)
        before = s
    assert merged == sorted(every)


def test_hot_anchors_split(spark):
    """Splitting by offset changes nothing."""
    shared = "x".join(map(str, range(80)))
    rows = [(i, f"{i * 7919} {shared} {i * 104729}" * (1 + i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cold = {r.doc_id: r for r in suffix_dedup.repeated(df).collect()}
    hot = {r.doc_id: r for r in suffix_dedup.repeated(df, hot=2).collect()}
    assert cold == hot
    assert sum(r.n_removed for r in hot.values()) > 0
    for i, t in rows:
        left, at = [], 0
        for a, b in hot[i].removed:
            left.append(t.encode()[at:a])
            at = b
        left.append(t.encode()[at:])
        assert hashlib.sha256(b"".join(left)).hexdigest() == hot[i].kept_sha256


def test_tokens_like_the_library():
    from tokenizers import Tokenizer

    rng, ours = np.random.default_rng(1), bpe.load(PATH)
    theirs = Tokenizer.from_file(PATH)
    letters = list("ab \n\t\x1c\x85'sTtlr12²é漢字😀!?\r\x0bhe an") + ["<|endoftext|>", "  ", "'re"]
    for _ in range(400):
        s = "".join(rng.choice(letters, rng.integers(0, 40)))
        ids = theirs.encode(s, add_special_tokens=False).ids
        assert ours.encode(s) == ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    for s in ("a" * 5000, "ab" * 3000, " " * 2000):
        assert ours.encode(s) == theirs.encode(s, add_special_tokens=False).ids


def test_pii_evidence():
    iban = "pay to account GB82 WEST 1234 5698 7654 32 now"
    kinds = {k for k, *_ in pii.find(iban)}
    assert "iban" in kinds
    assert "iban" not in {k for k, *_ in pii.find(iban.replace("32 now", "33 now"))}
    assert pii.find("call tel 212 555 0187 today")[-1][0] == "tel"
    assert not [s for s in pii.find("part no 212 555 0187") if s[0] == "tel"]
    text = "mail a.b@c.example.com or 10.0.0.1"
    spans = pii.find(text)
    assert pii.redact(text, spans) == "mail <EMAIL> or <IP>"
    assert pii.find("@" * 10_000) == [] and pii.find("1" * 100_000) == []


def test_kneser_ney_sums_to_one(spark):
    """Over all characters that may follow a context, and one unseen, probabilities add to 1."""
    texts = spark.createDataFrame([("abcab",), ("abd",), ("bcabb",)], "_text string")
    counts = perplexity.count_grams(texts)
    letters = {r.gram[-1] for r in counts.collect()}
    asked = [(c + x,) for c in ("abc", "zzz", "\x02\x02\x02", "cab") for x in [*letters, "?"]]
    logs = perplexity.log_probabilities(spark.createDataFrame(asked, "gram string"),
                                        counts).collect()
    for c in ("abc", "zzz", "\x02\x02\x02", "cab"):
        assert abs(sum(np.exp(r.logp) for r in logs if r.gram[:3] == c) - 1) < 1e-9


def test_codewords_are_apart():
    for n in (2, 3, 5, 7, 12, 40):
        code = language_id.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2)


def test_weak_supervision_trusts_agreeing_rules(spark):
    good = " ".join(f"a{i}b" for i in range(80)) + "."
    bad = ("$$$ ### !!\n" * 40)
    rows = [(i, good.replace("a", f"a{i}")) for i in range(30)] + [(100 + i, bad) for i in range(6)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.kept == (r.doc_id < 100) for r in got)
    assert all((r.p_good > 0.5) == (r.doc_id < 100) for r in got)


def test_chain_uses_earlier_categories():
    """The second category is told apart only by the first one's probability."""
    rng = np.random.default_rng(0)
    sets, labels = [], []
    for i in range(400):
        a = i % 2
        sets.append(sorted({int(x) for x in rng.integers(1, 20, 4)} | ({0} if a else set())))
        labels.append([a, a])
    chain = toxicity.train_chain({str(i): i for i in range(20)}, sets, np.array(labels),
                                 ["first", "second"])
    assert chain.weights[1][20] > 0  # weight of the first category's probability
    p = np.array([chain.predict(s) for s in sets])
    assert ((p > 0.5) == np.array(labels)).mean() > 0.99


def test_chain_learns_one_row_of_an_id(spark):
    """Labels without a document take no place in the sample; repeated ids bring one text each."""
    docs = spark.createDataFrame(
        [(i, f"plain w{i % 7}" if i % 2 else f"nasty w{i % 7}") for i in range(40)]
        + [(1, None), (1, "plain again"), (1, "plain again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0 and i < 1000)) for i in range(40)]
                                   + [(1000 + i, 1) for i in range(200)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, ["toxic"], sample=20)
    got = toxicity.classify(docs, chain).collect()
    assert all(r.rejected == (r.text or "").startswith("nasty") for r in got)


def test_sample_weights_keep_the_share(spark):
    """Half of the sample is positive, a tenth of the documents: the prior is a tenth."""
    docs = spark.createDataFrame([(i, "same words") for i in range(400)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)],
                                   "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, ["toxic"], sample=20)
    assert toxicity.classify(docs, chain).first().p_toxic == pytest.approx(0.1, abs=0.03)


def test_quality_without_texts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    with_texts = quality_rules.judge(docs)
    without = quality_rules.judge(docs, with_text=False)
    assert without.columns == [c for c in with_texts.columns if c != "text"]
    assert (sorted(map(str, without.collect()))
            == sorted(map(str, with_texts.drop("text").collect())))


@pytest.mark.parametrize("cuts", [0, 2])
def test_near_small_blocks(spark, monkeypatch, cuts):
    """Buckets cut by pieces and into blocks of two nodes link the same texts as brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "BUCKET", 3)
    monkeypatch.setattr(near_dedup, "CUTS", cuts)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:i * 3] + [f"x{i}"] + base[i * 3 + 1:]) for i in range(12)]
    texts += [" ".join(base[i * 8:] + [f"y{k}" for k in range(i * 8)]) for i in range(1, 8)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        num=92).collect()}
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 92 * len(x | y):
                    want[a] = want[b] = min(want[a], want[b])
    assert got == dict(enumerate(want)) and len(set(want)) > 2


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Pieces of the signature that never agree cut all large buckets to single nodes in the second
    turn; the last turn still finds every link, and a bucket's largest group is not dealt in pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "BUCKET", 3)
    monkeypatch.setattr(near_dedup, "JOIN", 2)
    monkeypatch.setattr(near_dedup, "PIECES", 1)
    monkeypatch.setattr(near_dedup, "PIECE", 256)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[i * 2:] + [f"y{k}" for k in range(i * 2)]) for i in range(24)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        num=94).collect()}
    assert got == {i: 0 for i in range(24)}  # each text is linked with the next ones only
    members = spark.createDataFrame(
        [(1, bytes([n]), b"main" if n < 20 else bytes([n])) for n in range(23)],
        "band long, node binary, comp binary")
    whole, dealt = near_dedup._cut(members, None, 0)
    rows = dealt.collect()
    met = {frozenset((x.node, y.node)) for x in rows for y in rows if (x.i, x.j) == (y.i, y.j)
           and x.node != y.node and x.comp != y.comp}
    assert whole.count() == 0 and len(met) == 20 * 3 + 3
    assert sum(r.comp == b"main" for r in rows) <= 20 * 2


def kneser_ney(texts, alone, order=3):
    """Brute force: (n-grams, perplexity) per text, one of ``texts`` if ``alone`` is its place."""
    def grams(t):
        w = ["<"] * (order - 1) + t.split() + [">"]
        return [tuple(w[i:i + order]) for i in range(len(w) - order + 1)]

    def levels(held):
        out = [Counter(g for t in held for g in grams(t))]
        for _ in range(order - 1):
            out.append(Counter(g[1:] for g in out[-1]))
        return out[::-1]

    discounts = []
    for level in levels(texts):
        times = Counter(level.values())
        n = [times[i] for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0 for i in (1, 2, 3)]
        discounts.append([0] + [x if 0 < x <= i else i / 2 for i, x in enumerate(d, 1)])
    units = len({g[-1] for t in texts for g in grams(t)}) + 1
    model = levels([t for i, t in enumerate(texts) if i != alone])

    def p(g):
        value = 1 / units
        for k in range(1, order + 1):
            level, d = model[k - 1], discounts[k - 1]
            follow = [n for h, n in level.items() if h[:-1] == g[order - k:-1]]
            n = level[g[order - k:]]
            if follow:
                value = (n - d[min(n, 3)] + value * sum(d[min(m, 3)] for m in follow)) / sum(follow)
        return value

    return lambda t: (len(grams(t)), np.exp(-np.mean([np.log(p(g)) for g in grams(t)])))


def sentences(rng, n):
    """Words of four kinds in a fixed order of kinds."""
    kinds = ["the a one this".split(), "red old big new".split(), "fox cat dog bird".split(),
             "sees has finds eats".split()]
    return " ".join(str(rng.choice(kinds[k % 4])) for k in range(4 * n))


def test_perplexity_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [sentences(rng, int(rng.integers(1, 6))) for _ in range(12)]
    texts += [texts[3], "", None, "never seen words", "the red fox", "red red red fox"]
    trusted = [*range(14), 14]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in perplexity.judge(
        docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
    held = [texts[i] or "" for i in trusted]
    for i, t in enumerate(texts):
        alone = trusted.index(i) if i in trusted else None
        n, value = kneser_ney(held, alone)(t or "")
        assert got[i].n_grams == n and got[i].perplexity == pytest.approx(value)


def test_perplexity_in_slices_by_brute_force(spark, monkeypatch):
    """Many batches, slices and parts; words of white space and scripts of several kinds."""
    monkeypatch.setattr(perplexity, "BATCH_BYTES", 200)
    monkeypatch.setattr(perplexity, "PART_BYTES", 150)
    rng = np.random.default_rng(8)
    texts = [sentences(rng, int(rng.integers(1, 9))) for _ in range(30)]
    texts += [texts[3], "", None, "ünï\u2003cödé\tthe\x1c red \U0001f600x", "the \u6f22 \u5b57 the", "red " * 40]
    trusted = [*range(0, 30, 2), 30, 33, 34, 35]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in perplexity.judge(
        docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
    held = [texts[i] or "" for i in trusted]
    for i, t in enumerate(texts):
        n, value = kneser_ney(held, trusted.index(i) if i in trusted else None)(t or "")
        assert got[i].n_grams == n and got[i].perplexity == pytest.approx(value)


def test_perplexity_requests_are_small(spark):
    """What a slice of requests puts on disk; rows of strings took many times the text."""
    docs = (spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
            .selectExpr("0 as _batch", "text as _text", "doc_id % 3 = 0 as _own").coalesce(1))
    size = docs.selectExpr("sum(octet_length(_text))").first()[0]
    dealing = perplexity.Dealing(perplexity.SLICES, 1, 1, 1)
    for k in (3, 2):
        rows = perplexity._requests(docs, dealing, k, 0)
        assert rows.selectExpr("sum(length(blob))").first()[0] < 0.6 * size


def test_perplexity_keeps_a_quantile_of_few(spark):
    """At least the quantile of each language's trusted texts passes, however few they are."""
    rng = np.random.default_rng(7)
    rows = [(i, sentences(rng, 12), "abc"[i % 3]) for i in range(18)]
    trusted = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    got = perplexity.judge(spark.createDataFrame(rows, SCHEMA), trusted).collect()
    assert all(r.kept for r in got)
    half = perplexity.judge(spark.createDataFrame(rows, SCHEMA), trusted, quantile=0.5).collect()
    assert sum(r.kept for r in half) == 12  # of six values the fourth is the first to reach the median


def test_perplexity_hears_word_order(spark):
    """Unseen texts in the usual order pass; the same words in senseless order do not."""
    rng = np.random.default_rng(6)
    rows = [(i, sentences(rng, 15), "en") for i in range(90)]
    for i in range(30):
        words = rows[60 + i][1].split()
        rng.shuffle(words)
        rows.append((100 + i, " ".join(words), "en"))
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    got = {r.doc_id: r.kept for r in perplexity.judge(
        spark.createDataFrame(rows, SCHEMA), trusted).collect()}
    assert sum(got[i] for i in range(60, 90)) >= 27
    assert not any(got[100 + i] for i in range(30))


def test_one_of_each_without_good_ids(spark):
    """Near copies that have no id, or share one, leave exactly one document of the group."""
    base = [f"w{i}" for i in range(120)]
    copies = [" ".join([*base[:60], f"x{k}", *base[61:]]) for k in range(6)]
    other = " ".join(f"z{i}" for i in range(50))
    for ids in ([None] * 6, [4] * 6, [None, 4, None, 4, 9, None]):
        rows = [*zip(ids, copies), (None, other), (None, None), (2, "")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        left = [(r.doc_id, r.text) for r in near_dedup.one_of_each(docs).collect()]
        assert len(left) == 4 and {(None, other), (None, None), (2, "")} <= set(left)
        kept = next(r for r in left if r[1] in copies)
        assert kept[0] == min((i for i in ids if i is not None), default=None)


def test_repeats_over_batches():
    """Counting in the order of hashes, whatever the batches, with a bounded wait."""
    import pandas as pd

    rng = np.random.default_rng(2)
    h = np.sort(np.concatenate([rng.integers(0, 40, 60), np.full(50, 17), np.full(30, 99)]))
    rows = pd.DataFrame({"h": h, "place": np.arange(len(h))})
    times = Counter(h.tolist())
    for hot in (2, 5, 1000):
        for size in (1, 3, 7, 500):
            parts = [rows.iloc[i:i + size].reset_index(drop=True) for i in range(0, len(h), size)]
            got = pd.concat(list(suffix_dedup._repeats(hot)(iter(parts))))
            want = {(i, int(x), min(times[x], hot)) for i, x in enumerate(h) if times[x] > 1}
            assert len(got) == len(want)
            assert set(zip(got["place"], got["h"], got["n"])) == want
    assert list(suffix_dedup._repeats(5)(iter([]))) == []


def test_suffixes_wait_as_numbers():
    """A batch whose passages are all hot holds few bytes a window, before the merge and in it."""
    import tracemalloc

    import pandas as pd
    import zstandard

    rng = np.random.default_rng(5)
    line = bytes(rng.integers(97, 123, 400).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, 200).astype(np.uint8)) + line for _ in range(200)]
    found = [suffix_dedup.anchors(np.frombuffer(t, np.uint8)) for t in texts]
    places = [(at << 16) | ((at - last) << 8) | (at - first) for at, _, first, last in found]
    pdf = pd.DataFrame({"_doc": np.arange(200), "_txt": np.arange(200),
                        "_z": [zstandard.compress(t) for t in texts], "_place": places,
                        "_n": [np.full(len(p), 9) for p in places],
                        "_h": [f[1].view(np.int64) for f in found]})
    windows = 200 * (600 - suffix_dedup.LENGTH + 1)

    def peak(run):
        tracemalloc.start()
        out = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    wire, most = peak(lambda: pd.concat(list(suffix_dedup._runs(9, 50)(iter([pdf])))))
    assert most < 250 * windows
    ends = [np.frombuffer(s, np.int64).reshape(-1, 2) for s in wire["spans"].dropna()]
    # the first text is the earliest; a letter before the line may be equal too
    assert len(ends) == 199 and all(len(e) == 1 and 190 < e[0, 0] <= 200 and e[0, 1] == 600 for e in ends)

    wire = pd.concat(list(suffix_dedup._runs(2000, 1)(iter([pdf[i:i + 1] for i in range(200)]))))
    own = wire[wire["part"].notna()].assign(parts=1)
    out, most = peak(lambda: suffix_dedup._equal_windows(own))
    assert most < 1500 * sum(len(suffix_dedup._unpack(b)[0]) for b in own["run"])


def test_texts_without_letters(spark):
    """Digits, fractions, superscripts and Roman numerals are no letters."""
    model = language_id.fit(spark.createDataFrame(
        [("the quick brown fox", "en"), ("de snelle bruine vos", "nl")], "text string, lang string"))
    for t in ("½", "²²", "Ⅷ", "12 _ 3", "", None, "٣"):
        assert model.predict(t)[0] == "und"
    assert model.predict("²fox")[0] in ("en", "nl")


def test_language_sums_in_levels(spark, monkeypatch):
    """The model does not depend on the number of tasks or levels."""
    rows = [(f"word{i % 7} text {i}", "en" if i % 3 else "nl") for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    one = language_id.fit(docs.coalesce(1))
    monkeypatch.setattr(language_id, "FAN_IN", 2)
    many = language_id.fit(docs.repartition(9))
    assert one.languages == many.languages
    for t in ("word1 text", "word5 9 text", "nl"):
        assert one.predict(t) == many.predict(t)


def test_components(spark):
    """Long paths, stars, cycles, repeated and reversed edges, text nodes."""
    from voltarc.llm import graph

    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)]
    edges += [(700, 701), (701, 702), (702, 700), (701, 700), (900, 900)]
    edges += [(int(a), int(b)) for a, b in rng.integers(2000, 2040, (30, 2))]
    rng.shuffle(edges)
    best = {}
    for a, b in edges:
        if a != b:
            best.setdefault(a, a), best.setdefault(b, b)
    for _ in best:
        for a, b in edges:
            if a != b:
                best[a] = best[b] = min(best[a], best[b])
    text = [(f"n{a:05d}", f"n{b:05d}") for a, b in edges]
    df = spark.createDataFrame(text, "u string, v string").repartition(5)
    got = {r.node: r.comp for r in graph.components(df).collect()}
    assert got == {f"n{a:05d}": f"n{b:05d}" for a, b in best.items()}
    assert graph.components(df.limit(0)).count() == 0


def test_texts_are_cut_into_words_once(spark):
    odd = ["", None, " ", "A b", " -x- ", "\x00a\x00\x7fb\n\r C", "É İ \U0001f600x", "[a]", "a.b.c.d.E"]
    docs = spark.createDataFrame([(t, t) for t in odd], "_key string, text string")
    words = docs.select("_key", decontaminate.words_of(F.col("text")).alias("_w"))
    want = {t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            for t in odd}
    assert {r._key: r._w for r in words.collect()} == want
    found = decontaminate.positions(words, 2)
    assert sorted((r._key, r._n, r._p) for r in found.collect()) == sorted(
        (t, len(w), i) for t, w in want.items() for i in range(len(w) - 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "[_key#" in generate and "_w#" not in generate.rsplit("[_key#", 1)[1].split("]")[0]


@pytest.mark.parametrize("local", [0, 1 << 17])
def test_components_of_few_edges_end_in_one_task(spark, monkeypatch, local):
    from voltarc.llm import graph

    written = []
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    monkeypatch.setattr(graph, "settle", lambda df, name, real=graph.settle: written.append(name) or real(df, name))
    edges = spark.createDataFrame([(f"n{i:03d}".encode(), f"n{i + 1:03d}".encode()) for i in range(60)] +
                                  [(b"x", b"z"), (b"y", b"x")], "u binary, v binary").repartition(7)
    got = {bytes(r.node): bytes(r.comp) for r in graph.components(edges).collect()}
    assert got == {f"n{i:03d}".encode(): b"n000" for i in range(61)} | {k: b"x" for k in (b"x", b"y", b"z")}
    assert len(written) == 2 if local else len(written) > 2


def test_few_texts_move_to_the_join(spark):
    """Every key that is held is marked, others only by chance, NULL included."""
    texts = [None, "", *[f"text {i}" for i in range(3000)]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn(
        "_key", near_dedup._key(F.col("text")))
    for held in (set(texts[:40]), set(texts[1:3]), set()):
        keys = docs.where(F.col("text").isin([t for t in held if t is not None])
                          | (F.col("text").isNull() & F.lit(None in held)))
        got = {r.text for r in near_dedup._marked(docs, keys).where("_maybe").collect()}
        assert held <= got and len(got) <= len(held) + 3
