from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest

from feedloom.llm import lm


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) + ["\n"]


def expected(rows):
    """Exact base scores, and exact pair scores with the operator's smoothing, by row."""
    one, two = collections.Counter(), collections.Counter()
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10:
            w = words(r.text)
            one.update(w)
            two.update(zip(["\n", *w], w))
    n, v = sum(one.values()), len(one)
    p = lambda x: (one[x] + 0.1) / (n + 0.1 * (v + 1))
    for r in rows:
        w = words(r.text)
        pairs = sum(math.log10((min(two[h, x], one[h]) + 100 * p(x)) / (one[h] + 100)) for h, x in zip(["\n", *w], w))
        yield r.doc_id, len(w), sum(one[x] > 0 for x in w), n, round(sum(math.log10(p(x)) for x in w), 6), pairs


@pytest.mark.parametrize("table", ["documents", "odd_documents"])
def test_scores(request, table):
    docs = request.getfixturevalue(table)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in lm.fit_and_score(docs).collect()), key=repr)
    want = sorted(expected(docs.collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    # counts are known to a power of two
    assert np.allclose([g[5] / g[1] for g in got], [w[5] / w[1] for w in want], atol=0.35)


def test_no_documents(no_documents):
    assert lm.fit_and_score(no_documents).collect() == []


@pytest.mark.parametrize("bound, n, most", [("SHARD_BYTES", 2, 40_000), ("WORD_SHARD_BYTES", 1, 6_000)])
def test_several_passes_give_the_same_scores(documents, monkeypatch, bound, n, most):
    model = lm.fit(documents)
    part = lm.fold("doc_id", 10)
    once = {r.doc_id: r for r in lm.score(documents, model, part == 0).collect()}
    monkeypatch.setattr(lm, bound, most)
    assert len(lm._shards(model.blocks, model.key_bits, n, most)) > 1
    for r in lm.score(documents, model, part == 0).collect():
        assert math.isclose(r.score, once[r.doc_id].score, rel_tol=1e-9) and r.base_score == once[r.doc_id].base_score


@pytest.mark.parametrize("table", ["documents", "odd_documents"])
@pytest.mark.parametrize("task_bytes", [1 << 28, 1000])
def test_keys_sent_to_the_parts_of_the_filter(request, monkeypatch, table, task_bytes):
    """One pass over the texts however many parts the filter has, each copied to several tasks or not."""
    docs = request.getfixturevalue(table)
    part, model = lm.fold("doc_id", 10), lm.fit(docs)
    rows = lambda: sorted((repr(tuple(r)[:-1]), r.score) for r in lm.score(docs, model, part == 0).collect())
    once, passes = rows(), []
    monkeypatch.setattr(lm, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(lm, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(lm, "_pass", lambda *args, known=lm._pass: passes.append(1) or known(*args))
    many = rows()
    assert len(lm._shards(model.blocks, model.key_bits, 2, 2_000)) > 5 and len(passes) == 1
    assert [r[0] for r in many] == [r[0] for r in once] and np.allclose([r[1] for r in many], [r[1] for r in once], rtol=1e-12)


def quantised(count):
    """The middle of the counts that share a power of two."""
    return (3 * 2 ** (count.bit_length() - 1) - 1) / 2 if count else 0.0


@pytest.mark.parametrize("table", ["documents", "odd_documents"])
def test_scores_of_a_filter_without_false_answers(request, table):
    """With bits to spare the filter gives every level exactly, so the scores are those of plainly quantised counts."""
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    one, two = collections.Counter(), collections.Counter()
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10:
            w = words(r.text)
            one.update(w)
            two.update(zip(["\n", *w], w))
    n, v = sum(one.values()), len(one)

    def log_p(h, x):
        history = quantised(one[h])
        return math.log10((min(quantised(two[h, x]), history) + 100 * (quantised(one[x]) + 0.1) / (n + 0.1 * (v + 1))) / (history + 100))

    want = sorted((r.doc_id is None, r.doc_id or 0, sum(log_p(h, x) for h, x in zip(["\n", *words(r.text)], words(r.text)))) for r in rows)
    part = lm.fold("doc_id", 10)
    got = lm.score(docs, lm.fit(docs.where(part != 0), bits_per_entry=96), part == 0).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in got)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9)


def test_counts_beyond_32_bits():
    import pyarrow as pa

    keys, counts = np.array([5, 1 << 60], np.uint64), np.array([3 << 33, 7], np.int64)
    rows = pa.Table.from_batches([lm._blob_rows(1, keys, counts, 1)])
    block = lm._block(rows.slice(0, 1), 64)
    held = (1, 0, 1, np.zeros(1, np.int64), np.array([block.column("size")[0].as_py()], np.uint64), np.frombuffer(block.column("bits")[0].as_py(), np.uint8))
    assert lm.levels(held, keys).tolist() == [35, 3]


def test_rare_words_are_joined(documents, monkeypatch):
    model = lm.fit(documents)
    part = lm.fold("doc_id", 10)
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(documents, model, part == 0).collect()}
    monkeypatch.setattr(lm, "HEAD_WORDS", 20)
    assert 0 < len(lm._head(model.vocabulary)) <= 20
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(documents, model, part == 0).collect()} == want


def test_filter_never_underestimates():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) >> np.uint64(8))
    counts = rng.zipf(1.6, len(keys)).clip(max=10_000)
    table = pa.table({"n": pa.array([2], pa.int32()), "bucket": pa.array([0], pa.int32()), "keys": [keys.tobytes()], "counts": [counts.astype(np.uint32).tobytes()]})
    block = lm._block(table, 8)
    size, bits = block.column("size")[0].as_py(), block.column("bits")[0].as_py()
    held = lm.Filter(8, 0, 1, np.zeros(1, np.int64), np.array([size], np.uint64), np.frombuffer(bits, np.uint8))
    level = lm.levels(tuple(held), keys)
    true = np.frexp(counts)[1]
    assert (level >= true).all() and (level == true).mean() > 0.9
    unknown = np.unique(rng.integers(1 << 40, 1 << 54, 5000, dtype=np.uint64))
    assert (lm.levels(tuple(held), unknown[~np.isin(unknown, keys)]) > 0).mean() < 0.06
