"""License scan: ordered signature rules behind a keyword prefilter. DataFrame operations only.

Texts are searched as lower-case words, each with a space of its own on either side, so that neighbouring matches
never share a character. A document without an anchor word of any keyword is left after one set lookup; a rule's regex
runs only where its keyword occurs. Of overlapping detections one that lies within another is dropped if the other has
a better priority, or the same and is longer or comes from an earlier rule.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.llm.common import text_or_empty
from feedloom.llm.license_rules import KINDS, SCORES, Rule, rules, spaced
from feedloom.session import stage

#: Capitals whose lower case holds an ASCII letter, and the letters that stand for them.
OUTSIDE = {"\u212a": "\u0138", "\u0130": "\u0131"}
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def ascii_lower(text: Column) -> Column:
    """Lower case that makes no character an ASCII letter but A to Z: the Kelvin sign and the dotted capital I, the only
    others whose lower case holds one, stay outside ASCII."""
    for sign, other in OUTSIDE.items():
        text = F.replace(text, F.lit(sign), F.lit(other))
    return F.lower(text)


def spaced_text(text: Column) -> Column:
    """Lower-case words with a space before and after each; an empty string if there is none."""
    words = F.trim(F.regexp_replace(ascii_lower(text), GAP, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _words(spaced_piece: Column) -> Column:
    spaces = F.length(spaced_piece) - F.length(F.replace(spaced_piece, F.lit(" "), F.lit("")))
    return (spaces / 2).cast("long")


def _anchors(ordered: list[Rule]) -> list[str]:
    """The longest word of each keyword: a text that has none of them matches no rule."""
    return sorted({max(r.keyword.split(), key=len) for r in ordered})


def _constant(value: list, kind: str) -> Column:
    """A list as one literal of the given type: the plan holds the rules as data, not as an expression for each."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _found(t: Column, ordered: list[Rule]) -> Column:
    """For each rule that matches: its number, and the words of the pieces between its matches and of the matches."""
    groups: dict[str, list[dict]] = {}
    for r in ordered:
        groups.setdefault(spaced(r.keyword), []).append({"rule_id": r.rule_id, "pattern": spaced(r.pattern)})
    by_keyword = _constant(
        [{"keyword": k, "rules": v} for k, v in groups.items()], "array<struct<keyword: string, rules: array<struct<rule_id: int, pattern: string>>>>"
    )
    some = F.arrays_overlap(F.split(F.trim(t), "  ", -1), F.array(*[F.lit(a) for a in _anchors(ordered)]))
    possible = F.flatten(F.transform(F.filter(by_keyword, lambda g: F.contains(t, g["keyword"])), lambda g: g["rules"]))
    matching = F.filter(possible, lambda r: F.rlike(t, r["pattern"]))
    return F.when(some, F.transform(matching, lambda r: F.struct(
        r["rule_id"].alias("rule_id"),
        F.transform(F.split(t, r["pattern"], -1), _words).alias("between"),
        F.transform(F.regexp_extract_all(t, r["pattern"], F.lit(0)), _words).alias("long"),
    )))


def _base(df: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Adds ``n_base, first_word, last_word, base_labels``: every place of a phrase, overlapping ones too."""
    found = []
    for phrase in phrases:
        pieces = F.split("t", rf" (?={spaced(phrase)[1:]})", -1)
        found.append(F.when(F.contains("t", F.lit(spaced(phrase))), F.struct(
            (F.size(pieces) - 1).cast("long").alias("n"),
            ((F.length(F.element_at(pieces, 1)) - F.length(F.replace(F.element_at(pieces, 1), F.lit(" "), F.lit("")))) / 2).cast("long").alias("first"),
            (F.col("n_words") - (F.length(F.element_at(pieces, -1)) - F.length(F.replace(F.element_at(pieces, -1), F.lit(" "), F.lit(""))) + 1) / 2).cast("long").alias("last"),
        )))
    df = df.withColumns({f"b{i}": f for i, f in enumerate(found)})
    at = [F.col(f"b{i}") for i in range(len(found))]
    labels = F.filter(F.array(*[F.when(b.isNotNull(), F.lit(label)) for b, label in zip(at, phrases.values())]), lambda x: x.isNotNull())
    return df.withColumns({
        "n_base": sum((F.coalesce(b["n"], F.lit(0)) for b in at), F.lit(0)).cast("long"),
        "first_word": F.least(*[b["first"] for b in at]), "last_word": F.greatest(*[b["last"] for b in at]),
        "base_labels": F.array_sort(F.array_distinct(labels)),
    }).drop(*[f"b{i}" for i in range(len(found))])


def searched(docs: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = BASE, ordered: list[Rule] | None = None) -> DataFrame:
    """One row for each document with its word count, base places and raw rule matches, without the text.

    ``row`` tells rows apart that share a key. A null or empty text has no words and no places.
    """
    rows = docs.select(F.col(key).alias("key"), spaced_text(text_or_empty(text)).alias("t"))
    rows = _base(rows.withColumn("n_words", _words(F.col("t"))), phrases)
    rows = rows.withColumn("found", _found(F.col("t"), rules() if ordered is None else ordered)).drop("t")
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "licenses")


def detections(rows: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    """Spans that remain, from ``searched``: ``row, key, start_word, end_word, rule_id, label, kind``.

    Only documents with a match take part; a window holds the matches of one document.
    """
    ordered = rules() if ordered is None else ordered
    hits = rows.where(F.size("found") > 0).select("row", "key", F.explode("found").alias("f")).select(
        "row", "key", "f.rule_id", F.posexplode(F.arrays_zip(F.slice("f.between", F.lit(1), F.size("f.long")).alias("between"), F.col("f.long").alias("long"))).alias("pos", "x")
    )
    upto = F.sum(F.col("x.between") + F.col("x.long")).over(Window.partitionBy("row", "rule_id").orderBy("pos"))
    spans = hits.repartition("row").withColumn("end_word", upto).withColumn("start_word", F.col("end_word") - F.col("x.long")).drop("pos", "x")
    facts = _constant([{"priority": r.priority, "label": r.label, "kind": r.kind} for r in ordered], "array<struct<priority: int, label: string, kind: string>>")
    spans = spans.select("*", F.element_at(facts, F.col("rule_id") + 1).alias("r")).select("row", "key", "start_word", "end_word", "rule_id", "r.*")
    ahead = Window.partitionBy("row").orderBy("start_word", F.desc("end_word"), "priority", "rule_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") <= p, F.col("end_word"))).over(ahead) for p in range(len(KINDS))]
    spans = spans.withColumn("reach", F.element_at(F.array(*reach), F.col("priority") + 1))
    return spans.where(F.col("reach").isNull() | (F.col("reach") < F.col("end_word"))).drop("reach", "priority")


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = BASE, ordered: list[Rule] | None = None) -> DataFrame:
    """Labels of every document: ``key, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null and empty texts have no words, labels or places. Repeated rows and ids are scanned each; an empty table gives an empty
    one, and columns other than key and text aren't read. Labels are arrays in code point order. The score is that of the strongest kind of detection, 0 without any; a base
    place counts as a notice.
    """
    rows = searched(docs, key=key, text=text, phrases=phrases, ordered=ordered)
    score = F.element_at(F.create_map(*[F.lit(x) for kind in KINDS for x in (kind, SCORES[kind])]), F.col("kind"))
    by_row = detections(rows, ordered).groupBy("row").agg(F.collect_set("label").alias("more"), F.max(score).alias("best"))
    joined = rows.drop("found").join(by_row, "row", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    base = F.when(F.col("n_base") > 0, F.lit(SCORES["notice"])).otherwise(F.lit(0.0))
    return joined.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"),
        F.greatest(base, F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def scan_sql() -> str:
    """The same result in DuckDB's SQL, with comma-joined labels, over the table ``documents``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({r.rule_id}, {r.priority}, {quote(r.label)}, {SCORES[r.kind]}, {quote(spaced(r.keyword))}, {quote(spaced(r.pattern))})" for r in rules())
    text = "coalesce(text, '')"
    for sign, other in OUTSIDE.items():
        text = f"replace({text}, '{sign}', '{other}')"
    words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    base = " UNION ALL ".join(
        f"SELECT doc_id, {quote(label)} AS label, {words('left(t, p - 1)')} AS word FROM spaced, "
        f"unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, {len(spaced(phrase))}) = {quote(spaced(phrase))})) AS u(p) WHERE contains(t, {quote(spaced(phrase))})"
        for phrase, label in BASE.items()
    )
    return f"""
WITH plain AS (SELECT doc_id, trim(regexp_replace(lower({text}), '{GAP}', '  ', 'g')) AS x FROM documents),
spaced AS (SELECT doc_id, CASE WHEN x = '' THEN '' ELSE concat(' ', x, ' ') END AS t FROM plain),
rule(rule_id, priority, label, score, keyword, pattern) AS (VALUES {table}),
pairs AS (SELECT s.doc_id, r.rule_id, string_split_regex(t, pattern) AS pieces, regexp_extract_all(t, pattern, 0) AS hits
  FROM spaced s JOIN rule r ON contains(s.t, r.keyword)),
hit AS (SELECT doc_id, rule_id, unnest(range(len(hits))) AS i, unnest(hits) AS h, unnest(pieces[1:len(hits)]) AS piece FROM pairs WHERE len(hits) > 0),
ends AS (SELECT *, sum({words('h')} + {words('piece')}) OVER (PARTITION BY doc_id, rule_id ORDER BY i) AS e FROM hit),
spans AS (SELECT e.doc_id, e.rule_id, r.priority, r.label, r.score, e - {words('h')} AS s, e FROM ends e JOIN rule r USING (rule_id)),
kept AS (SELECT doc_id, label, score FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND b.e >= a.e
  AND b.priority <= a.priority AND (b.priority < a.priority OR b.e - b.s > a.e - a.s OR b.rule_id < a.rule_id))),
places AS ({base}),
b AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM kept UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id),
k AS (SELECT doc_id, max(score) AS score FROM kept GROUP BY doc_id)
SELECT s.doc_id, {words('s.t')} AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(greatest(CASE WHEN n_base > 0 THEN {SCORES['notice']} ELSE 0 END, coalesce(score, 0)) AS DOUBLE) AS score
FROM spaced s LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""
