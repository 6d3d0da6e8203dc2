from __future__ import annotations

import itertools
import random
import re

import pytest
import xxhash

from feedloom.llm import groups, simhash


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    """The smallest reachable node of each, by searching all pairs."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(2000):
        differing = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not differing & m for m in masks)


@pytest.mark.parametrize("table", ["documents", "odd_documents"])
def test_documents(request, table):
    docs = request.getfixturevalue(table)
    rows = simhash.near_duplicates(docs).collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    linked = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i][1] ^ prints[j][1]).bit_count() <= 4]
    least = brute_components(range(len(prints)), linked)
    ids = {}
    for i, root in least.items():
        if prints[i][0] is not None:
            ids[root] = min(ids.get(root, 1 << 60), prints[i][0])
    want = [(d, f"{p:016x}", ids.get(least[i])) for i, (d, p) in enumerate(prints)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=repr) == sorted(want, key=repr)
    assert sum(r.kept for r in rows) == len(set(least.values()))
    assert all(r.doc_id == r.component_id for r in rows if r.kept)


def test_no_documents(no_documents):
    assert simhash.near_duplicates(no_documents).collect() == []


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    """Fingerprints in one tight cloud, with buckets of two rows as large."""
    monkeypatch.setattr(simhash, "BUCKET", 2)
    rng = random.Random(5)
    prints = {0}
    while len(prints) < 150:
        prints.add(rng.choice(list(prints)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(3, 6))))
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.component for r in groups.components(links, "t").collect()}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    want = brute_components(prints, linked)
    assert {p: got.get(p, p) for p in prints} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 230)] + [(300, k) for k in range(301, 320)]
    got = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    proper = [(a, b) for a, b in edges if a != b]
    assert got == brute_components({x for e in proper for x in e}, proper)
