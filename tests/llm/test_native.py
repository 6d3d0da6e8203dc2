"""License scan, mixing and WARC on odd rows."""

from __future__ import annotations

import base64
import hashlib
import re

import pytest

from feedloom.llm import licenses, license_rules, mixing, warc
from feedloom.session import stage_path


def test_rules_are_well_formed():
    rules = license_rules.rules()
    assert len(rules) > 200 and [r.rule_id for r in rules] == list(range(len(rules)))
    for r in rules:
        for word in r.keyword.split():
            assert word in r.pattern, r


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", "mit"),
    ("GNU General Public License, version 3 or later", "gpl-3-or-later"),
    ("the gnu general public license", "gpl"),
    ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
    ("committed to smitten limits", ""),
])
def test_labels(spark, text, labels):
    rows = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [",".join(x for x in r.labels if x != "cc-by-nc") for r in rows] == [labels]


def test_contained_detections_are_suppressed(spark):
    text = "a b licensed under the apache license version 2 0 c mit license"
    rows = licenses.detections(licenses.searched(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert sorted((r.start_word, r.end_word, r.label, r.kind) for r in rows) == [(2, 10, "apache-2", "notice"), (11, 13, "mit", "name")]


def test_licenses_of_odd_documents(odd_documents, no_documents):
    rows = licenses.scan(odd_documents).collect()
    assert len(rows) == odd_documents.count() and licenses.scan(no_documents).collect() == []
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[6].n_words, by_id[6].n_base, by_id[6].first_word, by_id[6].last_word) == (20000, 4000, 1, 19996)
    assert by_id[6].base_labels == ["mit"] and by_id[6].labels == ["mit"] and by_id[6].score == 0.9
    for d, n in ((3, 0), (4, 0), (5, 0), (7, 1), (10, 2)):
        assert (by_id[d].n_words, by_id[d].n_base, by_id[d].first_word, by_id[d].labels, by_id[d].score) == (n, 0, None, [], 0.0)


def targets_by_filling(sizes, weights, share, most):
    """Targets by sharing the excess round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        waiting = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in waiting) if waiting else 0
        over = [s for s in waiting if weight[s] * level > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full.update(over)
        left = share * sum(sizes.values()) - most * sum(sizes[s] for s in full)


@pytest.mark.parametrize("table", ["documents", "odd_documents"])
def test_mix(request, table):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    plan = {r.source: r for r in mixing.mixing_plan(mixing.sized(docs)).collect()}
    want = targets_by_filling(sizes, (3, 1, 2), 1.5, 2.0)
    assert {s: pytest.approx(t) for s, t in want.items()} == {s: p.target for s, p in plan.items()}
    mixed = mixing.mix(docs).collect()
    assert mixing.mix(docs).columns == docs.columns and sorted(mixed, key=repr) == sorted(mixing.mix(docs).collect(), key=repr)
    for source, target in want.items():
        taken = sum(len((r.text or "").split()) for r in mixed if r.source == source)
        largest = max(len((r.text or "").split()) for r in rows if r.source == source)
        assert abs(taken - target) <= largest and taken <= 2 * sizes[source]


def test_mix_of_nothing(no_documents):
    assert mixing.mix(no_documents).collect() == []


PAGES = [(1, "http://a/b c\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (2, "u", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "other"), (None, "u", "<p>é</p>"), (5, "u", "z" * (17 << 20))]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, key int")


def test_warc_round_trip(spark, pages):
    path = stage_path(spark, "test-warc")
    warc.write_archives(warc.plan_records(pages, key="page_id", uri="url", text="html"), path)
    got = sorted(((warc_id(r.record_id), r.record_type, warc_id(r.refers_to), r.payload, r.payload_bytes, r.payload_digest, r.verified) for r in warc.read_archives(spark, path).collect()), key=repr)
    want = []
    for key, _, html in PAGES:
        data = (html or "").encode()
        others = [k for k, _, h in PAGES if (h or "") == (html or "") and k is not None]
        first = max(others) if others else None
        response = first is None or key == first
        want.append((key, "response" if response else "revisit", None if response else first, data if response else None, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), True))
    assert got == sorted(want, key=repr)


def warc_id(text):
    value = (text or "None").rsplit(":", 1)[-1]
    return None if value == "None" else int(value)


def test_archives_are_plain_gzip_members(spark, pages):
    import gzip
    import zlib

    path = stage_path(spark, "test-warc")
    warc.write_archives(warc.plan_records(pages.limit(4).coalesce(1), key="page_id", uri="url", text="html"), path)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 4
    with pytest.raises((ValueError, zlib.error)):
        list(warc.iterate_records(data[:-30]))
    broken = warc._member([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:key:1>"), ("WARC-Payload-Digest", "sha1:A"), ("WARC-Block-Digest", "sha1:B"), ("X-Payload-Length", 1)], b"h\r\n\r\nx", 6)
    assert not any(warc._read(f, b, True)["verified"] for f, b in warc.iterate_records(broken))


def test_no_pages(spark, pages):
    path = stage_path(spark, "test-warc")
    warc.write_archives(warc.plan_records(pages.where("false"), key="page_id", uri="url", text="html"), path)
    assert warc.read_archives(spark, path).collect() == []


def test_small_payloads_are_no_revisits(pages):
    rows = warc.plan_records(pages.where("page_id < 5"), key="page_id", uri="url", text="html", least_bytes=9).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 9} == {"response"} and any(r.record_type == "revisit" for r in rows)


def matches_of(parsed):
    """Texts that a parsed pattern matches: every branch, repeats at their least and most (or twice), sets of characters in full."""
    import itertools

    kinds = re._constants
    parts = []
    for op, arg in parsed:
        if op is kinds.LITERAL:
            parts.append([chr(arg)])
        elif op is kinds.IN:
            parts.append([chr(c) for kind, at in arg for c in ([at] if kind is kinds.LITERAL else range(at[0], at[1] + 1))])
        elif op is kinds.BRANCH:
            parts.append([x for branch in arg[1] for x in matches_of(branch)])
        elif op is kinds.SUBPATTERN:
            parts.append(matches_of(arg[-1]))
        else:
            assert op is kinds.MAX_REPEAT, op
            parts.append([x * n for n in sorted({arg[0], min(arg[1], 2)}) for x in matches_of(arg[2])])
    return ["".join(x) for x in itertools.product(*parts)]


def test_keyword_is_in_every_match():
    spaced = license_rules.spaced
    for r in license_rules.rules():
        for text in matches_of(re._parser.parse(r.pattern)):
            assert re.fullmatch(r.pattern, text) and spaced(r.keyword) in spaced(text), (r, text)


def test_only_ascii_letters_are_folded(spark):
    """The Kelvin sign's lower case is k, and that of the dotted capital I begins with i."""
    texts = ["blue oa\u212a model license", "under the m\u0130t license", "Blue OAK model license", "ÉTÉ under THE mit license"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == [[], [], ["blueoak-1"], ["mit"]] and [r.n_words for r in rows] == [4, 4, 4, 5]


def test_mix_of_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "word " * (i % 7), f"s{i % 3}") for i in range(60)], "doc_id string, text string, source string")
    first = sorted(r.doc_id for r in mixing.mix(docs).collect())
    assert first and first == sorted(r.doc_id for r in mixing.mix(docs.repartition(5)).collect())


@pytest.mark.parametrize("text, label, score", [
    ("See the LICENSE file for details.", "unspecified", 0.5),
    ("see license", "unspecified", 0.5),
    ("Unauthorised copying of this file", "proprietary", 0.9),
    ("unauthorized use or distribution of this program", "proprietary", 0.9),
    ("has waived all copyright and related or neighboring rights", "cc0-1", 1.0),
])
def test_labels_of_every_spelling(spark, text, label, score):
    rows = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.labels, r.score) for r in rows] == [([label], score)]
