"""BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes a word's tokens. A sequence of tokens is the one that merging by rank gives exactly when
each token merges to itself and no adjacent pair would have merged across its border first; all pairs of a batch are
tested at once by undoing merges in the reverse order of their ranks. Only words with a failing pair are merged.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from feedloom.llm.common import output_schema, slices

WORD_END = "</w>"
#: Stands for the word end inside a word; no byte is written as this character.
END = "\n"
#: Distinct words, and chunks between white space, kept by a task before it forgets all but the most used half.
CACHE_WORDS = 150_000
#: Bytes of text encoded at once.
SLICE_BYTES = 1 << 20
#: Letters up to which a word is merged by plain search, and what stands for a pair that doesn't merge.
SHORT_WORD, NO_PAIR = 40, (1 << 62, -1)
#: Texts of these characters alone are split here; any other goes through the tokenizer's own normaliser and splitter,
#: whose Unicode tables may differ from Python's.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-ɏ‐-‧€]*")


def _ranges(kind: str) -> str:
    """The characters of a Unicode category up to those of ``PLAIN``, as ranges of a character class."""
    codes = [c for c in range(0x250) if unicodedata.category(chr(c))[0] == kind]
    firsts = [c for c in codes if c - 1 not in set(codes)]
    lasts = [c for c in codes if c + 1 not in set(codes)]
    return "".join(f"{chr(x)}-{chr(y)}" for x, y in zip(firsts, lasts))


#: A chunk's words: letters, one digit, the ends of English contractions, other signs.
PIECES = re.compile(rf"[{_ranges('L')}]+|[{_ranges('N')}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_ranges('L')}{_ranges('N')}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def load_tables(path: str) -> dict:
    """Vocabulary, merges and derived arrays of a tokenizer file with word ends and byte letters."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    spec = json.loads(source)
    model = spec["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or model["continuing_subword_prefix"]:
        raise ValueError("a BPE tokenizer with word ends is needed")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = {i: t for t, i in [*model["vocab"].items(), *special.items()]}
    size = max(names) + 1
    inner = {(t[:-len(WORD_END)] + END if t.endswith(WORD_END) else t): i for t, i in model["vocab"].items()}
    left, right, rank = np.arange(size), np.arange(size), np.full(size, -1)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys, merged = np.empty(len(merges), np.int64), np.empty(len(merges), np.int64)
    for k, (a, b) in enumerate(merges):
        x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
        left[z], right[z], rank[z] = x, y, k
        keys[k], merged[k] = x * size + y, z
    order = np.argsort(keys)
    tables = {
        "source": source, "special": special, "names": [names.get(i, "") for i in range(size)], "size": size, "inner": inner,
        "left": left, "right": right, "rank": rank, "keys": keys[order], "key_rank": order.astype(np.int64),
        "pairs": {int(k): (i, int(z)) for i, (k, z) in enumerate(zip(keys, merged))},
    }
    # only tokens that merging gives for their own letters may be proposed
    own = {t: i for t, i in inner.items() if merge(tables, t) == [i]}
    reach: dict[str, int] = {}
    for t in own:
        reach[t[:3]] = max(reach.get(t[:3], 0), len(t))
    return tables | {"own": own, "reach": reach}


def _symbols(tables: dict, word: str) -> list[int]:
    """Tokens of the single letters of a word; the last letter carries the word end if the word does."""
    letters = [*word[:-2], word[-2:]] if word.endswith(END) else [*word]
    return [tables["inner"][x] for x in letters]


def _merge_short(tokens: list[int], pairs: dict, size: int) -> list[int]:
    """The same by searching all pairs again after each merge, which is faster for few letters."""
    found = [pairs.get(a * size + b, NO_PAIR) for a, b in zip(tokens, tokens[1:])]
    while found:
        best = min(found)
        if best is NO_PAIR:
            break
        at = found.index(best)
        tokens[at:at + 2] = [best[1]]
        del found[at]
        if at < len(found):
            found[at] = pairs.get(tokens[at] * size + tokens[at + 1], NO_PAIR)
        if at:
            found[at - 1] = pairs.get(tokens[at - 1] * size + tokens[at], NO_PAIR)
    return tokens


def merge(tables: dict, word: str) -> list[int]:
    """Exact merging: the pair of the lowest rank first, the leftmost of equals, with a heap over a linked list."""
    tokens, pairs, size = _symbols(tables, word), tables["pairs"], tables["size"]
    if len(tokens) <= SHORT_WORD:
        return _merge_short(tokens, pairs, size)
    after, before = [*range(1, len(tokens)), -1], [*range(-1, len(tokens) - 1)]
    heap = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] >= 0 and (found := pairs.get(tokens[at] * size + tokens[after[at]])):
            heapq.heappush(heap, (found[0], at, found[1]))

    for at in range(len(tokens) - 1):
        offer(at)
    while heap:
        rank, at, made = heapq.heappop(heap)
        if tokens[at] < 0 or after[at] < 0 or pairs.get(tokens[at] * size + tokens[after[at]], (None,))[0] != rank:
            continue
        gone = after[at]
        tokens[at], tokens[gone], after[at] = made, -1, after[gone]
        if after[at] >= 0:
            before[after[at]] = at
        offer(before[at])
        offer(at)
    return [t for t in tokens if t >= 0]


def propose(tables: dict, word: str) -> list[int]:
    """Greedy longest match over a word that ends in ``END``; only the last token may hold the word end."""
    own, reach, at, last, out = tables["own"], tables["reach"], 0, len(word) - 1, []
    while True:
        longest = reach.get(word[at:at + 3], 2)
        if last + 1 - at <= longest and (whole := own.get(word[at:])) is not None:
            out.append(whole)
            return out
        for end in range(min(last - 1, at + longest), at, -1):
            if (token := own.get(word[at:end])) is not None:
                break
        else:
            raise ValueError(f"no token for {word[at]!r}")
        out.append(token)
        at = end


def compatible(tables: dict, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each pair of tokens, whether merging their joined letters leaves the border between them.

    The later of the two tokens is split again and again. Just before it was made, the two symbols at the border were
    there with every merge of a lower rank done: had they a merge of a lower rank than the next one undone, that merge
    would have crossed the border. Of two merges of equal rank the left one comes first, so the right one is undone first.
    """
    left, right, rank, size = tables["left"], tables["right"], tables["rank"], tables["size"]
    keys, key_rank = tables["keys"], tables["key_rank"]
    good = np.ones(len(first), bool)
    a, b, live = first.copy(), second.copy(), np.arange(len(first))
    # a merge across the border counts if its rank is under the limit, or equal where the right side was undone last
    limit = np.full(len(first), np.iinfo(np.int64).max)
    while len(live):
        key = a * size + b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        crossed = (keys[at] == key) & (key_rank[at] < limit)
        good[live[crossed]] = False
        ra, rb = rank[a], rank[b]
        undo_left = ra > rb
        top = np.maximum(ra, rb)
        go = ~crossed & (top >= 0)
        limit = np.where(undo_left, ra, rb + 1)[go]
        a, b = np.where(undo_left, right[a], a)[go], np.where(undo_left, b, left[b])[go]
        live = live[go]
    return good


class _Numbers(dict):
    """Numbers of chunks; a chunk not seen before gets the next one and is noted in ``fresh``."""

    def __init__(self, plain: bool, fresh: list):
        super().__init__()
        self.plain, self.fresh, self.base = plain, fresh, 0

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = self.base + len(self.fresh)
        self.fresh.append((self.plain, chunk))
        return number


class Encoder:
    """Token ids of texts, with the tokens of the chunks seen last remembered.

    No word crosses white space, so a text is a sequence of chunks, each looked up once.
    """

    def __init__(self, tables: dict):
        from tokenizers import Tokenizer

        self.tables, self.letters = tables, byte_letters()
        self.whole = Tokenizer.from_str(tables["source"])
        self.special = re.compile("|".join(map(re.escape, sorted(tables["special"], key=len, reverse=True)))) if tables["special"] else None
        self.fresh: list[tuple[bool, str]] = []
        self.plain, self.mapped = _Numbers(True, self.fresh), _Numbers(False, self.fresh)
        # special tokens: as chunks of byte letters they can't be words, as no word mixes signs and letters
        self.words = {t: [i] for t, i in self.tables["special"].items()}
        self.flat, self.starts, self.counts, self.uses = np.empty(0, np.int32), *(np.empty(0, np.int64) for _ in range(3))

    def _trim(self) -> None:
        """Forget all chunks but those used most, at most half as many as may be kept, and all words but theirs."""
        often = np.argsort(-self.uses, kind="stable")[:CACHE_WORDS // 2]
        often = np.sort(often[self.uses[often] > 1])
        number = np.full(len(self.uses), -1)
        number[often] = np.arange(len(often))
        number, words = number.tolist(), self.words
        self.words = {t: [i] for t, i in self.tables["special"].items()}
        for known in (self.plain, self.mapped):
            kept = {chunk: number[n] for chunk, n in known.items() if number[n] >= 0}
            known.clear()
            known.update(kept)
            known.base = len(often)
            self.words.update((w, words[w]) for chunk in kept for w in self._spell(known.plain, chunk))
        counts = self.counts[often]
        starts = np.cumsum(counts) - counts
        self.flat = self.flat[np.repeat(self.starts[often] - starts, counts) + np.arange(counts.sum())]
        # halved, so that what was common long ago gives way
        self.starts, self.counts, self.uses = starts, counts, self.uses[often] // 2

    def _chunks(self, text: str):
        """Number tables and chunks of a text's parts in order."""
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special and "<" in text else ():
            parts += [(False, text[at:m.start()]), (True, m[0])]
            at = m.end()
        parts.append((False, text[at:] if at else text))
        for is_special, part in parts:
            if is_special:
                yield self.mapped, [part]
            elif PLAIN.fullmatch(part):
                yield self.plain, (part if part.isascii() else unicodedata.normalize("NFC", part)).lower().split()
            else:
                yield self.mapped, [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(part))]

    def _spell(self, plain: bool, chunk: str) -> list[str]:
        """The words of a chunk in byte letters."""
        if not plain:
            return [chunk]
        return [w if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in PIECES.findall(chunk)]

    def _tokenise(self, words: list[str]) -> None:
        """Speculate, verify all pairs, and merge the words that failed."""
        spelled = [w + END for w in words]
        proposed = [propose(self.tables, w) for w in spelled]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(itertools.chain.from_iterable(proposed), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        for k in np.unique(owner[inside[~compatible(self.tables, flat[inside], flat[inside + 1])]]).tolist():
            proposed[k] = merge(self.tables, spelled[k])
        self.words.update(zip(words, proposed))

    def _learn(self) -> None:
        """Tokens of the fresh chunks, in the order of their numbers."""
        spelled = [self._spell(plain, chunk) for plain, chunk in self.fresh]
        new = list({w: None for words in spelled for w in words if w not in self.words})
        if new:
            self._tokenise(new)
        tokens = [list(itertools.chain.from_iterable(map(self.words.__getitem__, words))) for words in spelled]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(itertools.chain.from_iterable(tokens), np.int32, int(counts.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        self.uses = np.concatenate([self.uses, np.zeros(len(counts), np.int64)])
        self.fresh.clear()
        self.plain.base = self.mapped.base = len(self.counts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and token ids of all texts; a null text is empty."""
        if max(len(self.words), len(self.counts)) > CACHE_WORDS:
            self._trim()
        numbers, bounds = [], [0]
        for text in texts:
            for known, chunks in self._chunks(text) if text else ():
                numbers += map(known.__getitem__, chunks)
            bounds.append(len(numbers))
        if self.fresh:
            self._learn()
        numbers = np.array(numbers, np.int64)
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        counts = self.counts[numbers]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.starts[numbers] - ends[:-1], counts) + np.arange(ends[-1])]
        return ends[bounds], ids


def _names(path: str) -> list[str]:
    """The token of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [names.get(i, "") for i in range(max(names) + 1)]


def _joined(lists: pa.ListArray, vocabulary: pa.Array) -> pa.Array:
    """The tokens of each list of ids, joined by spaces; null for null."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    words = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), vocabulary.take(lists.flatten()))
    texts = pc.if_else(pc.is_valid(lists), pc.binary_join(words, pa.scalar(" ", pa.large_string())), pa.scalar(None, pa.large_string()))
    return texts.cast(pa.string())


def encode(docs: DataFrame, path: str, *, text: str = "text", output: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` in ``output``, as the tokenizer file at ``path`` gives them without added
    special tokens; special tokens written in a text are themselves. A null or empty text has no ids. With ``decoded``
    the ids are decoded into that column in the same pass. A column named like an output is replaced. The tables, a few
    MB of fixed size, are broadcast; no row is shuffled. Every row is encoded by itself, so repeated rows get equal ids and
    an empty table gives an empty one; a very long text is worked on by itself.
    """
    tables = docs.sparkSession.sparkContext.broadcast(load_tables(path))
    added = {output: "array<int>"} | ({decoded: "string"} if decoded else {})

    def run(batches):
        encoder = Encoder(tables.value)
        vocabulary = pa.array(tables.value["names"], pa.large_string())
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                bounds, ids = encoder.encode(part.column(text).to_pylist())
                columns = {n: part.column(n) for n in part.schema.names if n not in added}
                columns[output] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                if decoded:
                    columns[decoded] = _joined(columns[output], vocabulary)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, output_schema(docs, **added))


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids`` in ``output``: the tokens joined by spaces, special ones too, as the
    tokenizer gives it. Null ids give a null text, none an empty one. A column named like the output is replaced;
    repeated rows agree, and an empty table gives an empty one.
    """
    tokens = encoded.sparkSession.sparkContext.broadcast(_names(path))

    def run(batches):
        vocabulary = pa.array(tokens.value, pa.large_string())
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                kept = {n: part.column(n) for n in part.schema.names if n != output}
                yield pa.RecordBatch.from_pydict({**kept, output: _joined(part.column(ids), vocabulary)})

    return encoded.mapInArrow(run, output_schema(encoded, **{output: "string"}))
