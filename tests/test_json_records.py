"""Objects out of files of any layout: damage costs one record, and borders of splits don't show."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings, strategies as st

from feedloom.schema import ITEM
from feedloom.sources import storage
from feedloom.sources.json_records import Walk

FIELDS = set(ITEM.fieldNames())
VALUES = st.text(alphabet='ab{}[]",\\:\n é中', max_size=12) | st.integers(0, 9) | st.none() | st.lists(st.integers(0, 3), max_size=2)
NESTED = st.fixed_dictionaries({"k": VALUES}) | st.lists(st.fixed_dictionaries({"name": VALUES, "title": VALUES}), max_size=3)
RECORDS = st.lists(st.fixed_dictionaries({"ord": st.integers(0, 99), "title": VALUES}, optional={"extra": NESTED, "link": VALUES}), max_size=6)
LAYOUTS = {
    "lines": lambda rows: "".join(json.dumps(r) + "\n" for r in rows),
    "array": lambda rows: json.dumps(rows),
    "indented": lambda rows: json.dumps(rows, indent=2, ensure_ascii=False),
    "rows of an array": lambda rows: "[\n" + ",\n".join(json.dumps(r) for r in rows) + "\n]\n",
    "close": lambda rows: "".join(json.dumps(r) for r in rows),
}


def walked(text: str, cuts: list[int]) -> list[str]:
    """What the tasks of the splits of a text find, and what their edges give when put together; cuts lie at braces."""
    at = [0, *sorted({text.find("{", c) for c in cuts} - {-1, 0}), len(text)]
    found, edge = [], ""
    for i, (a, b) in enumerate(zip(at, at[1:])):
        walk, last = Walk(FIELDS, placed=a == 0), b == len(text)
        mine = []
        for k in range(a, b, 7):
            mine += walk.feed(text[k:min(k + 7, b)])
        if last and walk.placed:
            mine += walk.feed("", last=True)
        head, more, tail = walk.edges()
        mine += more
        if head is None:
            edge += tail
        else:
            found += Walk(FIELDS, placed=True).feed(edge + head, last=True) + mine
            edge = tail
    return found + Walk(FIELDS, placed=True).feed(edge, last=True)


@settings(max_examples=400, deadline=None)
@given(RECORDS, st.sampled_from(sorted(LAYOUTS)), st.lists(st.integers(0, 400), max_size=4))
def test_any_layout_and_any_borders(rows, layout, cuts):
    text = LAYOUTS[layout](rows)
    assert [json.loads(r) for r in walked(text, [])] == rows
    # A split that ends inside a list of objects that look like records can't tell them from records.
    if not any(isinstance(r.get("extra"), list) for r in rows):
        assert [json.loads(r) for r in walked(text, cuts)] == rows


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
@pytest.mark.parametrize("place", [0, 3, 9])
@pytest.mark.parametrize("keep", [1, 5, 20, 33])
def test_a_damaged_record_costs_one(layout, place, keep):
    rows = [{"ord": i, "title": f"title {i} with , and {{", "summary": "words " * 5} for i in range(10)]
    text = LAYOUTS[layout](rows)
    whole = [t for t in walked(text, [])]
    broken = text.replace(whole[place], whole[place][:keep])
    for cuts in ([], [60], [100, 300, 500]):
        found = walked(broken, cuts)
        good = []
        for t in found:
            try:
                good.append(json.loads(t))
            except json.JSONDecodeError:
                pass
        assert good == rows[:place] + rows[place + 1:] and len(found) <= 10


def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def split_small(spark):
    small_splits(spark)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_many_tasks_read_one_file(spark, tmp_path, split_small, layout):
    rows = [{"ord": None, "title": f"{i} {{", "summary": "word " * (i % 9), "extra": {"deep": [i, {"x": "}"}]}} for i in range(200)]
    (tmp_path / "items.json").write_text(LAYOUTS[layout](rows))
    assert spark.read.option("lineSep", "{").text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = storage.load_ordered_items(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.title, r.summary) for r in got] == [(i, r["title"], r["summary"]) for i, r in enumerate(rows)]


def test_a_record_longer_than_several_splits(spark, tmp_path, split_small):
    rows = [{"ord": i, "title": f"t{i}", "extra": [{"a": "{" * 40, "b": {}}] * (150 if i == 2 else 0)} for i in range(5)]
    (tmp_path / "items.json").write_text(json.dumps(rows))
    got = storage.load_items(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.title) for r in got] == [(i, f"t{i}") for i in range(5)]


def test_damaged_first_line(spark, tmp_path):
    lines = [json.dumps({"ord": i, "title": f"t{i}"}) for i in range(100)]
    (tmp_path / "items.json").write_text("\n".join([lines[0][:9], *lines[1:]]) + "\n")
    from pyspark.sql import Observation

    bad = Observation()
    rows = storage.load_items(spark, str(tmp_path), bad=bad)
    assert sorted(r.ord for r in rows.collect()) == list(range(1, 100)) and bad.get["bad_records"] == 1


def test_other_bytes(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'\xef\xbb\xbf{"ord": 1, "title": "bad \xff byte"}\r\n{"ord": 2, "title": 5}\r\n[1, 2]\r\n{"ord": "x"}')
    got = storage.load_items(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.title) for r in got] == [(1, "bad � byte"), (2, "5")]
    (tmp_path / "b.json").write_text("")
    assert storage.load_items(spark, str(tmp_path / "b.json")).count() == 0


def test_a_batch_is_walked_in_small_parts():
    """One Arrow batch of 40 MB: what is made of it at a time stays far smaller than the batch."""
    import tracemalloc

    import pyarrow as pa

    from feedloom.sources.json_records import _walk_splits

    n, body = 10_000, "x" * 4000
    values = [""] + [f'"id": "{i}", "title": "{body}"}}\n' for i in range(n)]
    size = sum(map(len, values)) + n
    batch = pa.RecordBatch.from_pydict({
        "value": values, "file": ["f"] * len(values), "start": [0] * len(values), "length": [size] * len(values), "size": [size] * len(values)})
    del values
    tracemalloc.start()
    found = sum(out.num_rows - out.column("kind").to_pylist().count(3) for out in _walk_splits({"id", "title"})(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n and peak < 15_000_000
