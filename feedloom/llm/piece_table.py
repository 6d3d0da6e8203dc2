"""Fill-in-middle transformation on piece tables.

A document is a list of descriptors ``(buffer, start, length)`` over buffers that never change: the text and the sentinels.
Cutting splits descriptors, an arrangement permutes them and puts sentinels between them, and the inverse permutation over
the finished output restores the text. Outputs and digests are streamed from the descriptors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedloom.llm.common import output_schema, slices

TEXT, SENTINELS = 0, 1
SENTINEL_BUFFER = b"<P><S><M>"
SENTINEL_BYTES = 3
SEED, ARRANGED_PERCENT, SPM_PERCENT = 42, 50, 80
SLICE_BYTES = 2 << 20
PIECES = "array<struct<buffer: int, start: long, length: long>>"


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


P, S, M = (Piece(SENTINELS, at, SENTINEL_BYTES) for at in (0, 3, 6))
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: What stands in each form, in order: sentinels, and parts of the document by their place in the text.
ARRANGEMENTS: dict[str, tuple] = {"psm": (P, PREFIX, S, SUFFIX, M, MIDDLE), "spm": (S, SUFFIX, P, PREFIX, M, MIDDLE)}


def sentinel(piece: Piece) -> bytes:
    return SENTINEL_BUFFER[piece.start:piece.start + piece.length]


def split(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and after byte ``at`` of what they stand for; a piece that ``at`` falls into is split."""
    for i, piece in enumerate(pieces):
        if at < piece.length:
            left, right = Piece(piece.buffer, piece.start, at), Piece(piece.buffer, piece.start + at, piece.length - at)
            return pieces[:i] + [left] * (at > 0), [right, *pieces[i + 1:]]
        at -= piece.length
    return pieces, []


def cut(pieces: list[Piece], first: int, second: int) -> list[list[Piece]]:
    """Prefix, middle and suffix, cut at two bytes in order."""
    prefix, rest = split(pieces, first)
    return [prefix, *split(rest, second - first)]


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of the form, with its sentinels."""
    return [piece for item in ARRANGEMENTS[form] for piece in ([item] if isinstance(item, Piece) else parts[item])]


def parsed(output: bytes, form: str) -> list[list[Piece]]:
    """Pieces of a finished output between its sentinels, put back into the order of the text.

    No part holds a sentinel, and no sentinel begins inside another, so the first place of each is its own.
    """
    order, at, parts = ARRANGEMENTS[form], 0, [[], [], []]
    for i in range(0, len(order), 2):
        start = at + SENTINEL_BYTES
        if output[at:start] != sentinel(order[i]):
            raise ValueError(f"output lacks {sentinel(order[i]).decode()} at byte {at}")
        at = output.index(sentinel(order[i + 2]), start) if i + 2 < len(order) else len(output)
        parts[order[i + 1]] = [Piece(TEXT, start, at - start)]
    return parts


def streamed(pieces: list[Piece], text: bytes) -> Iterator[memoryview]:
    """What the pieces stand for, one after another, without copying."""
    buffers = memoryview(text), memoryview(SENTINEL_BUFFER)
    for piece in pieces:
        yield buffers[piece.buffer][piece.start:piece.start + piece.length]


def digest(pieces: list[Piece], text: bytes) -> str:
    hashed = hashlib.sha256()
    for chunk in streamed(pieces, text):
        hashed.update(chunk)
    return hashed.hexdigest()


def unit_ends(text: bytes) -> np.ndarray:
    """The byte after each unit: a word with the ASCII white space before it, or white space that ends the text."""
    codes = np.frombuffer(text, np.uint8)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    follows = np.concatenate([blank[1:], [True]])
    ends = np.flatnonzero(~blank & follows) + 1
    return np.append(ends, len(text)) if len(text) and blank[-1] else ends


def n_chars(text: bytes) -> int:
    """Code points of a UTF-8 text."""
    return len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits from the digest of the seed and the key."""
    hashed = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(hashed[i:i + 8], 16) for i in range(0, 32, 8)]


class Arranged(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    pieces: list[Piece]


def arranged(text: bytes, key: str, seed: int = SEED, arranged_percent: int = ARRANGED_PERCENT, spm_percent: int = SPM_PERCENT) -> Arranged:
    """The document as a permuted list of pieces."""
    ends, whole = unit_ends(text), [Piece(TEXT, 0, len(text))] if text else []
    n, (h1, h2, h3, h4) = len(ends), draws(key, seed)
    if not text or any(sentinel(s) in text for s in (P, S, M)) or h3 % 100 >= arranged_percent:
        return Arranged(n, "plain", None, None, whole)
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return Arranged(n, form, n_chars(text[:first]), n_chars(text[first:second]), arrange(cut(whole, first, second), form))


def fill_in_middle(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: int = SEED, arranged_percent: int = ARRANGED_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """``docs`` without the text, with ``n`` units, ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (code
    points; null if plain), ``pieces`` over the text and ``SENTINEL_BUFFER``, and ``output`` with ``output_sha256``.

    The key and the seed alone decide form and cuts, so reruns and repeated rows agree; a null key counts as an empty
    text. A null text is empty. Empty texts, and those that hold a sentinel, stay plain, so that every output can be
    restored. A text is cut anywhere between two units, also at its ends: parts may be empty. An empty table gives an empty
    one. Columns of ``docs`` with the names of added ones are replaced.
    """
    added = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "pieces": PIECES, "output": "string", "output_sha256": "string"}

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                texts = [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]
                keys = part.column(key).cast(pa.string()).fill_null("").to_pylist()
                rows = [arranged(t, k, seed, arranged_percent, spm_percent) for t, k in zip(texts, keys)]
                made = {
                    "n": [r.n for r in rows], "form": [r.form for r in rows], "prefix_chars": [r.prefix_chars for r in rows],
                    "middle_chars": [r.middle_chars for r in rows], "pieces": [[p._asdict() for p in r.pieces] for r in rows],
                    "output_sha256": [digest(r.pieces, t) for r, t in zip(rows, texts)],
                }
                output = pa.array([b"".join(streamed(r.pieces, t)) for r, t in zip(rows, texts)], pa.binary()).cast(pa.string())
                columns = {n: part.column(n) for n in part.schema.names if n not in (text, *added)}
                kinds = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "pieces": pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))}
                yield pa.RecordBatch.from_pydict({**columns, **{c: output if c == "output" else pa.array(made[c], kinds.get(c, pa.string())) for c in added}})

    return docs.mapInArrow(run, output_schema(docs.drop(text), **added))


def restore(rows: DataFrame, *, output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` without the output, with ``restored`` and ``restored_sha256``: the text, rebuilt from output and form alone.

    A plain output is the text. A null form counts as plain, a null output as empty. An output that lacks a sentinel of
    its form is an error. An empty table gives an empty one.
    """
    def run(batches):
        for batch in batches:
            for part in slices(batch, output, SLICE_BYTES):
                texts = [t or b"" for t in part.column(output).cast(pa.binary()).to_pylist()]
                forms = part.column(form).to_pylist()
                pieces = [[p for part in parsed(t, f) for p in part] if f in ARRANGEMENTS else [Piece(TEXT, 0, len(t))] for t, f in zip(texts, forms)]
                columns = {n: part.column(n) for n in part.schema.names if n not in (output, "restored", "restored_sha256")}
                restored = pa.array([b"".join(streamed(p, t)) for p, t in zip(pieces, texts)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict({**columns, "restored": restored, "restored_sha256": [digest(p, t) for p, t in zip(pieces, texts)]})

    return rows.mapInArrow(run, output_schema(rows.drop(output), restored="string", restored_sha256="string"))
