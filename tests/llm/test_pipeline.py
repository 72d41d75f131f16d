"""Each stage of the corpus pipeline, recomputed by brute force from what the stage before has kept."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_contracts import FOLDER, components, sha
from voltarc.llm import pii, toxicity
from voltarc.llm.common import table
from voltarc.llm.queries import CATEGORIES, labels_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile("|".join(f"<{k.upper()}>" for k in pii.KINDS))


@pytest.fixture(scope="module")
def stages(spark):
    """name -> rows of the stage, from the first input on"""
    docs = table(spark, FOLDER, "documents")
    out = {"input": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(),
                                     stage(spark, docs, FOLDER).schema)
        out[name] = docs.collect()
    return out


def by_id(rows):
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_toxic_documents_go(spark, stages):
    docs = table(spark, FOLDER, "documents")
    chain = toxicity.fit(docs, labels_of(spark, FOLDER), CATEGORIES)
    want = [r for r in stages["input"]
            if chain.predict(chain.columns(r.text))[-1] < toxicity.REJECT_AT]
    assert by_id(stages["toxicity"]) == by_id(want) and 0 < len(want) < len(stages["input"])


def test_one_document_of_each_group_stays(stages):
    before = by_id(stages["toxicity"])
    groups = components([(i, r.text) for i, r in before.items()], 80, 100)
    want = {i: r for i, r in before.items() if groups[i][1] == i}
    assert by_id(stages["near_dedup"]) == want and len(want) < len(before)


def test_contaminated_documents_go(spark, stages):
    windows = {}
    for item in table(spark, FOLDER, "benchmark").collect():
        words = WORD.findall(lowered(item.text))
        for k in range(max(len(words) - 12, 1) if words else 0):
            window = tuple(words[k:k + 13])
            windows.setdefault(len(window), set()).add(window)
    want = {}
    for i, r in by_id(stages["near_dedup"]).items():
        words = WORD.findall(lowered(r.text))
        hit = set()
        for size, held in windows.items():
            for k in range(len(words) - size + 1):
                if tuple(words[k:k + size]) in held:
                    hit.update(range(k, k + size))
        if not hit or 20 * len(hit) < len(words):
            want[i] = r
    assert by_id(stages["decontaminate"]) == want
    assert len(want) < len(stages["near_dedup"])


def test_personal_data_becomes_marks(stages):
    before, after = by_id(stages["decontaminate"]), by_id(stages["pii"])
    assert before.keys() == after.keys()
    changed = 0
    for i, r in after.items():
        text = before[i].text
        if text is None:
            continue
        spans = pii.find(text)
        # Without its marks, the text is what no span covers.
        covered = {k for _, start, end, _ in spans for k in range(start, end)}
        left = "".join(c for k, c in enumerate(text) if k not in covered)
        assert MARK.sub("", r.text) == MARK.sub("", left)
        assert r.n_chars == len(r.text) and (r.text == text) == (not spans)
        assert not [s for s in pii.find(r.text) if s[0] in ("email", "card")]
        assert r.asDict() | {"text": 0, "n_chars": 0} == before[i].asDict() | {"text": 0, "n_chars": 0}
        changed += bool(spans)
    assert changed


def test_tokens_are_those_of_the_redacted_texts(stages):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.no_truncation()
    plain.no_padding()
    before, after = by_id(stages["pii"]), by_id(stages["bpe"])
    assert before.keys() == after.keys()
    for i, r in after.items():
        ids = plain.encode(before[i].text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(",".join(map(str, ids)))
        assert r.decoded_sha256 == sha(plain.decode(ids, skip_special_tokens=False))


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert by_id(got.collect()) == by_id(stages["bpe"])


EDGES = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two", None, "a", 7),
         (3, "one two", None, "a", 7), (None, "no id here", "de", None, 10),
         (None, None, None, None, None), (4, "word " * 30_000, "en", "a", 150_000)]


def test_stages_take_edge_rows(spark):
    """NULL and empty texts and rows without an id pass all stages; repeated rows stay once."""
    docs = spark.createDataFrame(
        EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.select("*", *[docs["lang"].alias(c) for c in ("ids", "_key", "kept", "rejected")])
    empty = wide.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        columns = wide.columns
        wide, empty = stage(spark, wide, FOLDER), stage(spark, empty, FOLDER)
        assert empty.count() == 0
        if name != "bpe":
            assert wide.columns == empty.columns == columns
    rows = wide.collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "None", "None"]
    assert all((r.n_tokens == 0) == (r.doc_id in (1, 2) or not r.ids) for r in rows)
