from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from feedloom.llm import bpe
from feedloom.llm.registry import load

QUERIES_BY_NAME = load()[0]
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tables():
    return bpe.load_tables(PATH)


def check(encoder, texts):
    bounds, ids = encoder.encode(texts)
    for k, want in enumerate(LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == want.ids, texts[k]


def test_verified_pairs_are_those_that_merging_keeps(tables):
    """For random token pairs the test agrees with merging their joined letters."""
    import numpy as np

    rng = random.Random(3)
    inner = [(t, i) for t, i in tables["own"].items() if not t.endswith("\n")]
    last = list(tables["own"].items())
    pairs = [(rng.choice(inner), rng.choice(inner if rng.random() < 0.3 else last)) for _ in range(4000)]
    good = bpe.compatible(tables, np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    assert good.tolist() == [bpe.merge(tables, a[0] + b[0]) == [a[1], b[1]] for a, b in pairs]


def test_heap_and_plain_search_merge_alike(tables, monkeypatch):
    rng = random.Random(4)
    spelled = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 30))) + "\n" for _ in range(500)]
    short = [bpe.merge(tables, w) for w in spelled]
    monkeypatch.setattr(bpe, "SHORT_WORD", 0)
    assert [bpe.merge(tables, w) for w in spelled] == short


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    check(ENCODERS.setdefault("one", bpe.Encoder(bpe.load_tables(PATH))), texts)


ENCODERS: dict = {}


def test_odd_texts(tables, monkeypatch):
    encoder = bpe.Encoder(tables)
    odd = ["", None, "<|endoftext|>", "a<|startoftext|>B<|endoftext|><|endoftext|>c", "ΑΣ Σ", "İI", "é é", "it's don't'll", "<|endoftext", "x" * 3000, "\x1c\x85\xa0a"]
    check(encoder, odd)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    check(encoder, odd * 2)
    check(encoder, [f"fresh words {k}" for k in range(50)])


def test_common_words_stay_known(tables, monkeypatch):
    """When the words exceed what is kept, those that occur again and again aren't tokenised anew; the rare ones go."""
    monkeypatch.setattr(bpe, "CACHE_WORDS", 100)
    encoder, learned = bpe.Encoder(tables), []
    tokenise = encoder._tokenise
    monkeypatch.setattr(encoder, "_tokenise", lambda words: (learned.extend(words), tokenise(words)))
    common = "the quick brown fox's tail, É été <|endoftext|> é"
    for k in range(20):
        check(encoder, [f"{common} {common}", " ".join(f"rare{chr(97 + k)}{chr(97 + i)}" for i in range(26)) * 2])
        assert len(encoder.counts) <= 150 and len(encoder.words) <= 160
    assert learned.count("quick") == learned.count("tail") == 1


def test_query(spark, documents):
    from conftest import SF_DIR

    got = {r.doc_id: r for r in QUERIES_BY_NAME["op2_bpe_round_trip"](spark, SF_DIR).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in documents.collect():
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(want), digest(" ".join(map(str, want))))
        assert got[r.doc_id].decoded_sha256 == digest(LIBRARY.decode(want, skip_special_tokens=False))


def test_odd_documents(odd_documents, no_documents):
    rows = bpe.decode(bpe.encode(odd_documents, PATH), PATH).collect()
    assert len(rows) == odd_documents.count() and rows[0].row == "r"
    for r in rows:
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(no_documents, PATH), PATH).collect() == []
