"""Similarity join: which of many rows can resemble one of a few, without meeting every pair.

The ratio of two texts is twice the characters in matching blocks over the characters of both. Texts of lengths a and b whose
ratio reaches t have at least M = t (a + b) / 2 characters in blocks, and as two blocks have an unmatched character between
them, at most (1 - t)(a + b) + 1 blocks. A text of 200 characters or more is matched from its rare characters only (those that
are at most a hundredth of it, and one more), so its blocks are also at most one more than it has of these. A block of n
characters holds n - q + 1 whole q-grams; hence at least M - (q - 1) times the blocks of the q-gram places of the kept text
also stand in the later one. That number, ``needed``, gives two filters that lose no pair:

* Part: of any ``needed - ENOUGH`` places left out, the others still share ``ENOUGH``; only those are looked at.
* Count: a kept row that shares fewer places with all the few rows together goes, and so does a pair that does.
* Prefix: of the n places it shares, any ``n - needed + 1`` include one that it shares with each row it resembles, so it is
  looked up under its rarest ones only.

Every row takes the longest q that still leaves a good part of its places needed. Rows meet only under equal keys (see
``operators.dedup``), whose q-grams are hashed with the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.similarity import ratio_bound
from feedloom.session import stage

GRAM_SIZES = (8, 5, 3, 2, 1)
#: Share of a text's places that must be needed for a size of grams to be taken.
NEEDED_SHARE = 0.4
#: Places that two texts must share among those looked at.
ENOUGH = 32
#: Texts of this length are matched from rare characters only.
LONG_TEXT = 200
ROUNDING = 1e-6


def _grams(text: Column, q: int) -> Column:
    """All q-grams of a text, one for each place."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def _rare_characters(text: Column) -> Column:
    """Characters of a text that stand in it at most ``length / 100 + 1`` times, repeats counted."""
    most = F.floor(F.length(text) / 100) + 1

    def add(total: Column, character: Column) -> Column:
        times = F.length(text) - F.length(F.replace(text, character, F.lit("")))
        return total + F.when(times <= most, times).otherwise(0)

    return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), F.lit(0), add)


def _needed(threshold: Column, low: Column, high: Column, length: Column, rare: Column, q: int | Column) -> Column:
    """Least number of a text's q-gram places that stand in any text it resembles; both texts together have ``low`` to
    ``high`` characters, the text itself ``length``."""
    by_gaps = F.least(*[threshold * both / 2 - ((1 - threshold) * both + 1) * (q - 1) for both in (low, high)])
    by_rare = F.when(length >= LONG_TEXT, threshold * low / 2 - (rare + 1) * (q - 1))
    return F.ceil(F.greatest(by_gaps, by_rare) - ROUNDING)


def _places(kept: DataFrame) -> DataFrame:
    """``ord, key, length, threshold, rare, q, left, needed, gram`` for the places looked at of the texts of ``ord, key,
    threshold, text``, in grams of the row's size; ``left`` places are left out, and ``needed`` of the others are shared."""
    length, threshold = F.length("text"), F.col("threshold")
    rows = kept.withColumn("rare", F.when(length >= LONG_TEXT, _rare_characters(F.col("text"))))
    low = length + F.ceil(length * threshold / (2 - threshold) - ROUNDING)
    high = length + F.floor(length * (2 - threshold) / threshold + ROUNDING)
    needed = {q: _needed(threshold, low, high, length, F.col("rare"), q) for q in GRAM_SIZES}
    enough = lambda q: (needed[q] >= 1) & (needed[q] >= NEEDED_SHARE * (length - q + 1)) if q > 1 else F.lit(True)
    chosen = F.coalesce(*[F.when(enough(q), F.struct(F.lit(q).alias("q"), F.greatest(needed[q], F.lit(1)).alias("needed"))) for q in GRAM_SIZES])
    rows = rows.select("ord", "key", length.alias("length"), "threshold", "rare", chosen.alias("c"), "text")
    grams = F.coalesce(*[F.when(F.col("c.q") == q, _grams(F.col("text"), q)) for q in GRAM_SIZES])
    rows = rows.select("ord", "key", "length", "threshold", "rare", "c.*", grams.alias("all")).withColumn("left", F.greatest(F.col("needed") - ENOUGH, F.lit(0)))
    looked_at = F.slice("all", F.lit(1), F.greatest(F.size("all") - F.col("left"), F.lit(0)).cast("int"))
    rows = rows.select("ord", "key", "length", "threshold", "rare", "q", "left", (F.col("needed") - F.col("left")).alias("needed"), F.explode(looked_at).alias("g"))
    return rows.withColumn("gram", F.xxhash64("key", "q", "g")).drop("g")


def _gram_sets(later: DataFrame) -> DataFrame:
    """``ord, key, q, length, grams``: the different grams of every size of the texts of ``ord, key, text``."""
    sizes = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.array_distinct(_grams(F.col("text"), q)).alias("g")) for q in GRAM_SIZES]))
    sized = later.select("ord", "key", F.length("text").alias("length"), sizes.alias("s")).select("ord", "key", "length", "s.*")
    return sized.select("ord", "key", "q", "length", F.transform("g", lambda g: F.xxhash64("key", "q", g)).alias("grams"))


def candidate_pairs(later: DataFrame, kept: DataFrame) -> DataFrame:
    """``later_ord, kept_ord``, each once: every pair that meets under a key and whose texts there may reach the threshold.

    ``later``: the few rows, ``ord, key, text``. ``kept``: ``ord, key, threshold, text``. Empty texts resemble nothing. The
    many rows are dealt out by gram against one row for each gram, so a common gram is split over tasks like any skewed
    key; an aggregate holds the places of one text.
    """
    sets = stage(_gram_sets(later), "similar-sets")
    grams = sets.select("ord", F.explode("grams").alias("gram"))
    holders = grams.groupBy("gram").agg(F.count("*").alias("holders"))
    matched = _places(kept).join(holders, "gram").groupBy("ord", "key", "length", "threshold", "rare", "q", "left", "needed").agg(
        F.sort_array(F.collect_list(F.struct("holders", "gram"))).alias("places")
    ).filter(F.size("places") >= F.col("needed"))
    matched = stage(matched.withColumn("places", F.transform("places", lambda p: p["gram"])), "similar-places")
    rarest = F.array_distinct(F.slice("places", F.lit(1), (F.size("places") - F.col("needed") + 1).cast("int")))
    met = matched.select(F.col("ord").alias("kept_ord"), "key", F.explode(rarest).alias("gram")).join(
        grams.withColumnRenamed("ord", "later_ord"), "gram").select("later_ord", "kept_ord", "key").distinct()
    kept_side = matched.select(F.col("ord").alias("kept_ord"), "key", F.col("length").alias("kept_length"), "threshold", "rare", "q", "left", "places")
    later_side = sets.select(F.col("ord").alias("later_ord"), "key", "q", "length", "grams")
    both = F.col("length") + F.col("kept_length")
    # Each gram that the later text lacks stands at one place at least.
    shared = F.size("places") - F.size(F.array_except("places", "grams"))
    needed = _needed(F.col("threshold"), both, both, F.col("kept_length"), F.col("rare"), F.col("q"))
    pairs = met.join(kept_side, ["kept_ord", "key"]).join(later_side, ["later_ord", "key", "q"])
    fits = (ratio_bound(F.col("length"), F.col("kept_length")) >= F.col("threshold")) & (shared >= needed - F.col("left"))
    return pairs.filter(fits).select("later_ord", "kept_ord").distinct()


def _edits(threshold: float, characters: Column | float) -> Column:
    """Most characters to be put in or taken out between two texts of so many ``characters`` that have the ratio."""
    return F.floor((1 - threshold) * characters + ROUNDING)


def _cut(threshold: float, length: Column) -> Column:
    """``size`` of segments at which a text has about a fifth more of them than edits can touch, and one more at least, and ``step``:
    so many places are one in the keys, as the keys of many edits would else grow with the square of their number."""
    edits = _edits(threshold, 2 * length / threshold)
    size, step = F.floor(length / (1.2 * (edits + 1))), F.floor((edits + 1) / 16)
    return F.struct(F.greatest(size, F.lit(1)).cast("int").alias("size"), F.greatest(step, F.lit(1)).cast("int").alias("step"))


def _marks(text: Column) -> Column:
    """64 bits of which an edit changes just one, so two texts differ in no more bits than there are edits between them.

    Characters move 16 counters of four bits, which go through 0000, 0001, 0011, 0111, 1111, 1110, 1100 and 1000.
    """
    counters = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) % 16 * 4)

    def move(bits: Column, at: Column) -> Column:
        counter = F.call_function("shiftrightunsigned", bits, at).bitwiseAND(F.lit(15))
        ones = F.bit_count(counter)
        step = F.when(counter < 8, ones).otherwise(4 - ones)
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), at + step))

    return F.aggregate(counters, F.lit(0).cast("long"), move)


def segment_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """``later_ord, kept_ord``, each once: every pair of different rows of ``ord, text`` whose ratio may reach the threshold,
    0.8 at least, both ways round. For texts of which most resemble few others.

    Characters in blocks stand in both texts in one order, so one text is the other with at most ``(1 - threshold)`` times the
    characters of both put in or taken out. Of the segments into which a text is cut its rarest are taken, one more than there
    may be edits. From the left, look for the first of these at whose end there have been no more edits than there are taken
    segments before it: the last one is, if none is before. At the segment before that there had been more, so no edit touches
    this one, and those before it are just as many as the taken segments before it. Segment number ``n`` from 0 thus stands in
    the other text, moved by ``-n``, ``-n + 2`` and so on up to ``n``. Segment and place are the key.

    Segments of common words still meet in many pairs, growing with the square of the rows. Pairs whose marks differ in more
    bits than there may be edits go where they meet, before anything is written or dealt out.
    """
    length = F.length("text")
    rows = stage(rows.select("ord", "text", _marks(F.col("text")).alias("marks")), "similar-texts")
    # An explicit number and no broadcast, as rows grow to a hundred times what Spark has measured.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ord").withColumn("length", length)
    low, high = F.ceil(length * threshold / (2 - threshold) - ROUNDING), F.floor(length * (2 - threshold) / threshold + ROUNDING)
    cuts = F.array_distinct(F.transform(F.sequence(F.greatest(low, F.lit(1)), high), lambda n: _cut(threshold, n)))
    gram = F.xxhash64("size", F.substr("text", F.col("at") + 1, F.col("size"))).alias("gram")
    places = F.sequence(F.lit(0), F.col("length") - F.col("size"))
    grams = rows.withColumn("cut", F.explode(cuts)).select("*", "cut.*").filter("size <= length").withColumn("at", F.explode(places))
    holders = grams.select(gram).groupBy("gram").agg(F.count("*").alias("holders"))
    places = F.sequence(F.lit(0), F.col("length") - F.col("size"), F.col("size"))
    segments = rows.select("*", _cut(threshold, length).alias("cut")).select("*", "cut.*").withColumn("at", F.explode(places))
    known = segments.select("ord", "length", "marks", "step", "at", gram).join(holders.hint("merge"), "gram")
    edits = _edits(threshold, 2 * F.col("length") / threshold).cast("int")
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("holders", "at", "gram"))), F.lit(1), edits + 1)
    taken = known.groupBy("ord", "length", "marks", "step").agg(F.array_sort(F.transform(rarest, lambda s: F.struct(s["at"], s["gram"]))).alias("taken"))
    taken = taken.select("ord", "marks", "step", edits.alias("edits"), F.posexplode("taken").alias("n", "s")).select("*", "s.*")
    place = lambda at: F.floor(at / F.col("step"))
    moved = F.array_distinct(F.transform(F.sequence(-F.col("n"), F.col("n"), F.lit(2)), lambda m: place(F.col("at") + m)))
    key = lambda at: F.hash("gram", at, "step").alias("key")
    sought = taken.withColumn("place", F.explode(moved)).filter("place >= 0").select(
        key("place"), F.col("ord").alias("kept_ord"), F.col("marks").alias("kept_marks"), "edits")
    found = grams.select("*", gram).select(key(place(F.col("at"))), F.col("ord").alias("later_ord"), "marks")
    few = F.bit_count(F.col("marks").bitwiseXOR(F.col("kept_marks"))) <= F.col("edits")
    met = sought.join(found.hint("merge"), "key").filter((F.col("later_ord") > F.col("kept_ord")) & few).select("later_ord", "kept_ord").distinct()
    ways = F.array(F.struct("later_ord", "kept_ord"), F.struct(F.col("kept_ord").alias("later_ord"), F.col("later_ord").alias("kept_ord")))
    return met.select(F.explode(ways).alias("w")).select("w.*")
