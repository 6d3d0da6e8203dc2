"""Piece tables: cuts, arrangements, exact round trips; odd rows. The query itself has SQL."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from feedloom.llm import piece_table
from feedloom.llm.piece_table import Piece

TEXTS = st.text(alphabet=" \t\n\x0b ab<>PSMéß中🙂", max_size=60)


def joined(pieces, text):
    return b"".join(piece_table.streamed(pieces, text))


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 10**9))
def test_round_trip(text, key):
    data = text.encode()
    made = piece_table.arranged(data, str(key), arranged_percent=100)
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert made.n == len(units)
    output = joined(made.pieces, data)
    assert piece_table.digest(made.pieces, data) == hashlib.sha256(output).hexdigest()
    if any(s in text for s in ("<P>", "<S>", "<M>")) or not text:
        assert made.form == "plain" and output == data
        return
    h = piece_table.draws(str(key), 42)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    want = {"psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[made.form]
    assert output.decode() == want and (made.prefix_chars, made.middle_chars) == (len(prefix), len(middle))
    back = piece_table.parsed(output, made.form)
    assert joined([p for part in back for p in part], output) == data


@given(st.lists(st.integers(1, 5), max_size=6), st.integers(0, 30))
def test_split_keeps_what_pieces_stand_for(lengths, at):
    text = b"abcdefghijklmnopqrstuvwxyz"
    pieces = [Piece(0, 2 * i, n) for i, n in enumerate(lengths)]
    left, right = piece_table.split(pieces, at)
    whole = joined(pieces, text)
    assert joined(left, text) == whole[:at] and joined(right, text) == whole[at:]


def test_digests_are_those_of_the_texts(spark, documents):
    from pyspark.sql import functions as F

    made = piece_table.fill_in_middle(documents)
    wrong = piece_table.restore(made).join(documents.select("doc_id", "text"), "doc_id").where(
        (F.col("restored") != F.col("text")) | (F.sha2("restored", 256) != F.col("restored_sha256"))
    )
    assert wrong.count() == 0 and made.where(F.sha2("output", 256) != F.col("output_sha256")).count() == 0
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "spm", "psm"}


def test_odd_documents(spark, odd_documents, no_documents):
    docs = odd_documents.withColumnRenamed("ids", "form").withColumnRenamed("u", "restored")
    made = piece_table.fill_in_middle(docs, arranged_percent=100)
    rows = made.collect()
    texts = sorted((r.text or "") for r in docs.collect())
    assert len(rows) == len(texts) and sorted(r.restored for r in piece_table.restore(made).collect()) == texts
    for r in rows:
        if r.doc_id in (3, 4):
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.pieces, r.output) == (0, "plain", None, None, [], "")
        if r.doc_id == 5:
            assert r.n == 1 and r.form != "plain"
    twice = [tuple(r) for r in rows if r.doc_id == 2]
    assert twice[0] == twice[1]
    assert piece_table.restore(piece_table.fill_in_middle(no_documents)).collect() == []


def test_sentinels_in_a_text(spark):
    rows = spark.createDataFrame([(i, f"a b <{s}> c d") for i in range(40) for s in "PSM"], "doc_id long, text string")
    assert {r.form for r in piece_table.fill_in_middle(rows).collect()} == {"plain"}


def test_output_without_its_sentinels():
    with pytest.raises(ValueError):
        piece_table.parsed(b"<P>a<M>b", "psm")
    with pytest.raises(ValueError):
        piece_table.parsed(b"<P>a<S>b<M>c", "spm")
