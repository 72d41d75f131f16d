"""Each operator's query against a plain re-statement of its contract, over whole small tables."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voltarc.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


def result(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, FOLDER).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(texts, num, den):
    """Brute force: smallest id reachable over pairs of similar shingle sets."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    shared = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            shared[g].append(i)
    both = Counter(p for ids in shared.values() for p in itertools.combinations(sorted(ids), 2))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeated(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(b[s:s + length])
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def personal(text):
    text = text or ""

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            s = [int(c) for c in digits[::-1]]
            total = sum(s[::2]) + sum(sum(divmod(2 * d, 10)) for d in s[1::2])
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text)
            if good(k, m[0])]


def test_near_dedup(spark, docs):
    expected = components(list(zip(docs.doc_id, docs.text)), 85, 100)
    got = result(spark, "op3_near_dedup")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_suffix_dedup(spark, docs):
    got = result(spark, "op4_suffix_dedup")
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} \
        == repeated(list(zip(docs.doc_id, docs.text)))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, FOLDER)
    theirs = con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    as_rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object)
                                   .where(f[sorted(f.columns)].notna(), None).values.tolist()))
    assert as_rows(ours.toPandas()) == as_rows(theirs)


def test_quality_measures(spark, docs):
    got = result(spark, "op6_quality_rules")
    for i, t in zip(docs.doc_id, docs.text):
        n, chars, symbols, dup, rep = quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got.values()) > 0.5 * len(got)


def test_bpe(spark, docs):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = result(spark, "op7_bpe")
    for i, t in zip(docs.doc_id, docs.text):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(",".join(map(str, ids)))
        assert got[i].decoded_sha256 == sha(reference.decode(ids, skip_special_tokens=False))


def test_personal_data(spark, docs):
    got = result(spark, "op10_pii")
    found = 0
    for i, t in zip(docs.doc_id, docs.text):
        spans, r = personal(t), got[i]
        found += len(spans)
        counts = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            counts[k] for k in ("email", "ip", "card", "phone"))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == sha(joined)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert found


def test_language_held_out(spark, docs):
    got = result(spark, "op2_language_id")
    held = [(got[i].lang_pred, x) for i, x in zip(docs.doc_id, docs.lang)
            if got[i].held_out and x is not None]
    assert held and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_separates(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = result(spark, "op1_toxicity")
    assert not any(got[i].rejected for i, y in labels.items() if not y)
    toxic = [got[i].rejected for i, y in labels.items() if y]
    assert sum(toxic) >= 0.8 * len(toxic)


def test_perplexity_separates(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = result(spark, "op8_perplexity")
    good = [got[i].kept for i, y in labels.items() if y]
    bad = [got[i].kept for i, y in labels.items() if not y]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.6 * len(bad)
