"""JSON objects of files of any layout, in one pass over splits of the files.

Text is read in pieces between opening braces, a separator at which Spark can split any file: one object a line, an indented
array, or a single line that is one huge array. A task walks its pieces in order and takes whole objects. Inside a file's
first split the walk starts at a known place; in others it first has to find its place, as a split may begin inside an
object or even inside a string. What lies before the first object there, and after the last, is kept as an edge; the edges
of neighbouring splits are put together and walked again, so an object cut by a border is found once.

A damaged record costs that record: the walk goes on at the next text that begins like a record. Nothing is collected, and a
record lies in one task only.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from feedloom.session import stage

#: While a split looks for its place, this many characters of objects in a row settle it.
SETTLED = 4 << 20
#: So many pieces are walked at a time.
PIECES = 256
#: Rows of edges come after the records of their split.
EDGE_PLACE = 1 << 40

_GAPS = re.compile(r"[\s,\[\]\ufeff]*")
#: What follows an object that lies inside another one, and what is too short to tell.
_NESTED = re.compile(r"\s*(?:\}|,\s*[^\s{\]]|\]\s*[,}])")
_UNTOLD = re.compile(r"\s*[,\]]?\s*\Z")
#: A parser's complaint so near the end may be about text still to come.
_NEAR_END = 8


class Walk:
    """Takes objects out of a text that comes in parts.

    ``placed`` says that the text begins between objects. Otherwise objects are held back until they are followed by what
    follows a record; those that turn out to lie inside another object count as part of the edge.
    """

    def __init__(self, fields: set[str], placed: bool):
        names = "|".join(sorted(map(re.escape, fields)))
        self.fields, self.placed, self.decode = fields, placed, json.JSONDecoder().raw_decode
        self.begins = re.compile(rf'[\n\r][\s,\[]*(?=\{{)|(?=\{{\s*"(?:{names})"\s*:)')
        self.text, self.at, self.searched = "", 0, 0
        self.held: list[tuple[int, int]] = []
        self.head: str | None = "" if placed else None
        self.found: list[str] = []

    def feed(self, more: str, last: bool = False) -> list[str]:
        """Records, damaged ones too, that the text so far settles; with ``last``, all that are left."""
        self.text = self.text[self.at:] + more if self.placed else self.text + more
        if self.placed:
            self.searched, self.at = max(0, self.searched - self.at), 0
        if not self.placed:
            self._find_place(last)
        if self.placed:
            self._take(last)
        found, self.found = self.found, []
        return found

    def _object(self, start: int, last: bool) -> tuple[dict | None, int, bool]:
        """The object at a brace, its end, and whether more text may still complete it."""
        try:
            return *self.decode(self.text, start), False
        except json.JSONDecodeError as error:
            open_end = error.msg.startswith("Unterminated string") or error.pos >= len(self.text) - _NEAR_END
            return None, start, open_end and not last
        except RecursionError:
            return None, start, False

    def _settle(self) -> None:
        self.head = self.text[:self.held[0][0]]
        self.found += [self.text[a:b] for a, b in self.held]
        self.placed, self.at, self.held, self.searched = True, self.held[-1][1], [], 0

    def _find_place(self, last: bool) -> None:
        while not self.placed:
            start = self.text.find("{", self.at)
            if start < 0:
                self.at = len(self.text)
                return
            value, end, waits = self._object(start, last)
            if waits or value is not None and not last and _UNTOLD.match(self.text, end):
                self.at = start
                return
            if value is None:
                if self.held:
                    self._settle()
                else:
                    self.at = start + 1
            elif _NESTED.match(self.text, end):
                self.held, self.at = [], end
            else:
                if self.held or self.fields & value.keys():
                    self.held.append((start, end))
                self.at = end
                if self.held and end - self.held[0][0] > SETTLED:
                    self._settle()

    def _next_begin(self, after: int, last: bool) -> tuple[int | None, bool]:
        """Where the next record begins after a damaged one, and whether more text is needed to tell."""
        for match in self.begins.finditer(self.text, max(after, self.searched)):
            start = match.end()
            value, end, waits = self._object(start, last)
            if waits or value is not None and not last and _UNTOLD.match(self.text, end):
                self.searched = match.start()
                return None, True
            if value is not None and self.fields & value.keys() and not _NESTED.match(self.text, end):
                return start, False
        self.searched = max(after, len(self.text) - 256)
        return None, not last

    def _take(self, last: bool) -> None:
        while True:
            start = _GAPS.match(self.text, self.at).end()
            if start == len(self.text):
                self.at = start
                return
            if self.text[start] == "{":
                value, end, waits = self._object(start, last)
                if waits:
                    self.at = start
                    return
                if value is not None:
                    self.found.append(self.text[start:end])
                    self.at = end
                    continue
            begin, waits = self._next_begin(start + 1, last)
            if waits:
                self.at = start
                return
            stop = len(self.text) if begin is None else begin
            self.found.append(self.text[start:stop].rstrip(" \t\r\n,[]"))
            self.at, self.searched = stop, 0

    def edges(self) -> tuple[str | None, str, str]:
        """At the end of a split: records held back are settled; then head, records and tail. A split without any record
        of its own is all tail, and its head is None."""
        if not self.placed and self.held:
            self._settle()
            self._take(False)
        found, self.found = self.found, []
        return self.head, found, self.text[self.at:] if self.placed else self.text


SPLIT_SCHEMA = "file string, start long, place long, kind int, text string"
RECORD, HEAD, WHOLE, TAIL = range(4)


def _walk_splits(fields: set[str]):
    """Rows of ``SPLIT_SCHEMA`` from rows of ``value, file, start, length, size``, split after split."""

    def run(batches):
        walk, split, place, rows = None, None, 0, []

        def add(kind: int, text: str) -> None:
            nonlocal place
            rows.append((split[0], split[1], place, kind, text))
            place += 1

        def close() -> None:
            file_end = split[1] + split[2] >= split[3]
            if file_end and walk.placed:
                for text in walk.feed("", last=True):
                    add(RECORD, text)
            head, found, tail = walk.edges()
            for text in found:
                add(RECORD, text)
            if head is None:
                add(WHOLE, tail)
                return
            if split[1] > 0:
                add(HEAD, head)
            add(TAIL, tail.lstrip(" \t\r\n,[]\ufeff"))

        def batch_of():
            nonlocal rows
            columns, rows = list(zip(*rows)), []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.string())], ["file", "start", "place", "kind", "text"])

        # All that is made of a batch is made of a few pieces at a time; in text, walk and rows they take several times the room.
        for batch in (whole.slice(k, PIECES) for whole in batches for k in range(0, whole.num_rows, PIECES)):
            pieces = [(p or b"").decode("utf-8", "replace") for p in batch.column("value").cast(pa.binary()).to_pylist()]
            origin = list(zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length", "size"))))
            at = 0
            while at < len(pieces):
                first = origin[at] != split
                if first:
                    if walk is not None:
                        close()
                    split, place = origin[at], 0
                    walk = Walk(fields, placed=split[1] == 0)
                stop = at
                while stop < len(pieces) and origin[stop] == split:
                    stop += 1
                brace = "" if first and split[1] == 0 else "{"
                for text in walk.feed(brace + "{".join(pieces[at:stop])):
                    add(RECORD, text)
                at = stop
            if rows:
                yield batch_of()
        if walk is not None:
            close()
        if rows:
            yield batch_of()

    return run


def _joined_edges(edges: DataFrame, fields: set[str]) -> DataFrame:
    """Records that lie across splits: from a tail on to the next head, through splits that have no record of their own."""
    order = Window.partitionBy("file").orderBy("start", "kind")
    chains = edges.withColumn("chain", F.count_if(F.col("kind") == TAIL).over(order)).filter(F.trim("text") != "")

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), ("kind", "ascending")])
        found = Walk(fields, placed=True).feed("".join(table.column("text").to_pylist()), last=True)
        n = len(found)
        return pa.table({
            "file": pa.array([table.column("file")[0].as_py()] * n, pa.string()), "start": pa.array([table.column("start")[0].as_py()] * n, pa.int64()),
            "place": pa.array([EDGE_PLACE + i for i in range(n)], pa.int64()), "kind": pa.array([RECORD] * n, pa.int32()), "text": pa.array(found, pa.string()),
        })

    return chains.groupBy("file", "chain").applyInArrow(walk, SPLIT_SCHEMA)


def json_records(spark: SparkSession, path: str, schema: T.StructType, bad: str) -> DataFrame:
    """Objects of all files under ``path`` with the columns of ``schema``; ``bad`` is the text of one that can't be read.

    ``_file``, ``_start`` and ``_place`` order them as they stand in the files. The files are read once, into a stage table.
    Objects between which there is anything but white space, commas and brackets are taken, the rest is one bad record.
    """
    pieces = spark.read.option("lineSep", "{").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size"),
    )
    fields = set(schema.fieldNames())
    walked = stage(pieces.mapInArrow(_walk_splits(fields), SPLIT_SCHEMA), "json-records")
    records = walked.filter(F.col("kind") == RECORD).unionByName(_joined_edges(walked.filter(F.col("kind") != RECORD), fields))
    typed = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json("text", typed, {"columnNameOfCorruptRecord": bad})
    return records.select(parsed.alias("r"), F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("place").alias("_place")).select("r.*", "_file", "_start", "_place")
