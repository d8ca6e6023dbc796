"""Benchmark decontamination: a prefix-filtered join of item windows with documents, in DataFrame operations only.

An item is the set of its windows of `width` words (an item of fewer words is one window). The texts are split into words once:
a table of marks, one byte for each hash of a shingle that some window has, goes to the tasks, and only shingles with a mark are kept, with
their places, beside the number of words of the document. A document contains a window only if it contains each of its
shingles, so the rarest one, by its count over all documents, is a necessary prefix: only these are joined. A match fixes where the window would start; it must lie inside the document (positional and length bound), and
the words there must equal those of the window (exact verification).

Defined results: null texts and texts without words have no words, no hits and no windows; repeated documents get equal
rows; repeated item ids are one item, a null item id is written as empty text; windows that several items share count for
each; empty tables give no hits or no rows; columns besides `doc_id`, `text` and `item_id` are not looked at, and results
carry the document's own columns only where the text is filtered. Texts are read whole.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import bounded, same_document
from recspark.session import checkpointed

# Fixed value: a word is a run of ASCII letters, digits and anything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARKS_PER_TOKEN = 16
MOST_MARKS = 1 << 24


def words(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def shingles(codes: Column, count: Column, width: int) -> Column:
    """(at, token) of all runs of `width` words, in order; `codes` are the hashes of the words."""
    runs = F.transform(
        F.sequence(F.lit(0), count - width),
        lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(codes, i + k) for k in range(width)]).alias("token")),
    )
    return F.when(count >= width, runs).otherwise(F.array().cast("array<struct<at: int, token: bigint>>"))


def codes_of(items: Column) -> Column:
    return F.transform(items, lambda word: F.xxhash64(word))


def windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, n (words of the window), window (its words joined by spaces), words."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words("text").alias("all"))
    size = F.size("all")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(size - width, F.lit(0)) + 1))
    cut = rows.filter(size > 0).select("item_id", "all", starts.alias("start"))
    cut = cut.select("item_id", F.slice("all", F.col("start"), F.lit(width)).alias("words"))
    return cut.select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("window"), "words").distinct()


def marks_of(tokens: DataFrame) -> bytes:
    """A byte for each remainder of a token, 1 where there is such a token; at most MOST_MARKS bytes, whatever the tokens."""
    size = min(MOST_MARKS, max(1024, 1 << (tokens.count() * MARKS_PER_TOKEN).bit_length()))
    place = F.pmod("token", F.lit(size))
    bits = F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))")
    rows = tokens.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("slot")).agg(bits.alias("bits")).toArrow()
    slots = np.zeros(size // 64, dtype=np.int64)
    slots[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return np.unpackbits(slots.view(np.uint8), bitorder="little").tobytes()


def scanned(documents: DataFrame, sizes: list[int], marks: bytes) -> DataFrame:
    """id, hash (of the text), n_words, hits (size, at, token of the shingles with a mark), one row for each document."""
    rows = documents.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), codes_of(words("text")).alias("codes"))
    rows = rows.withColumn("n_words", F.size("codes"))
    table, one = F.lit(marks), F.lit(b"\x01")
    marked = [
        F.filter(
            shingles(F.col("codes"), F.col("n_words"), size),
            lambda s: F.substring(table, (F.pmod(s["token"], F.lit(len(marks))) + 1).cast("int"), F.lit(1)) == one,
        )
        for size in sizes
    ]
    named = [F.struct(F.lit(size).alias("size"), hits.alias("hits")) for size, hits in zip(sizes, marked)]
    return checkpointed(rows.select("id", "hash", "n_words", *([F.array(*named).alias("by_size")] if sizes else [])))


@dataclass
class Occurrences:
    documents: DataFrame  # id, hash, n_words of every document
    places: DataFrame  # id, hash (of the text), start, n, window: every occurrence of a window in a document, once


def occurrences(documents: DataFrame, items: DataFrame, width: int = 10, shingle: int = 3) -> Occurrences:
    cut = windows(items, width).select("n", "window", "words").distinct()
    cut = checkpointed(cut.withColumn("size", F.least(F.col("n"), F.lit(shingle))))
    sizes = sorted(r["size"] for r in cut.select("size").distinct().collect())
    asked = None
    for size in sizes:
        mine = cut.filter(F.col("size") == size).select(
            "size", "n", "window", F.inline(shingles(codes_of(F.col("words")), F.col("n"), size)).alias("offset", "token")
        )
        asked = mine if asked is None else asked.unionByName(mine)
    if asked is None:
        rows = scanned(documents, [], b"")
        none = rows.limit(0).select("id", "hash", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("window"))
        return Occurrences(rows, none)
    asked = checkpointed(asked)
    tokens = checkpointed(asked.select("size", "token").distinct())
    table = scanned(documents, sizes, marks_of(tokens))
    hits = table.select("id", "hash", "n_words", F.inline("by_size")).select("id", "hash", "n_words", "size", F.inline("hits"))
    # A mark may stand for several tokens; the join keeps the tokens of windows.
    hits = checkpointed(hits.join(bounded(tokens), ["size", "token"]))
    rarity = hits.groupBy("size", "token").agg(F.count("*").alias("found"))
    # Windows with a shingle that no document has cannot occur.
    counted = asked.join(rarity, ["size", "token"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    rarest = counted.groupBy("size", "window", "n").agg(F.min(F.struct("found", "token", "offset")).alias("rarest"))
    places = rarest.filter("rarest.found > 0").select("size", "rarest.token", "rarest.offset", "n").distinct()
    candidates = (
        hits.join(bounded(checkpointed(places)), ["size", "token"])
        .withColumn("start", F.col("at") - F.col("offset"))
        .filter("start >= 0 AND start + n <= n_words")
    )
    grouped = checkpointed(candidates.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "n")).alias("places")))
    # Only texts of documents with a candidate are dealt out.
    keys = bounded(grouped.select(F.col("id").alias("__id"), F.col("hash").alias("__hash")))
    texts = documents.select("doc_id", "text").join(keys, same_document(keys), "left_semi")
    texts = texts.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), "text").join(
        grouped, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("hash"))
    )
    read = texts.select("id", "hash", "places", words("text").alias("words"))
    spelt = read.select(
        "id", "hash",
        F.explode(
            F.transform(
                "places",
                lambda p: F.struct(p["start"], p["n"], F.array_join(F.slice("words", p["start"] + 1, p["n"]), " ").alias("window")),
            )
        ).alias("place"),
    ).select("id", "hash", "place.*")
    known = bounded(checkpointed(cut.select("window", F.col("n").alias("__n"))))
    found = spelt.join(known, "window", "left_semi").distinct()
    return Occurrences(table.select("id", "hash", "n_words"), found)


def covered(places: Column) -> Column:
    """Number of positions inside at least one of the spans (start, n)."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("words"))
    total = F.aggregate(
        F.array_sort(places),
        start,
        lambda a, p: F.struct(
            F.greatest(a["to"], p["start"] + p["n"]).alias("to"),
            (a["words"] + F.greatest(F.lit(0), p["start"] + p["n"] - F.greatest(a["to"], p["start"]))).alias("words"),
        ),
    )
    return total["words"]


def contamination(documents: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, items (ids in order, as strings)."""
    seen = occurrences(documents, items, width)
    found = checkpointed(seen.places)
    owners = checkpointed(windows(items, width).select("window", "item_id"))
    hits = (
        found.join(bounded(owners), "window")
        .groupBy("id", "hash")
        .agg(F.collect_set(F.struct("start", "n")).alias("places"), F.collect_set("item_id").alias("items"))
        .select("id", "hash", covered(F.col("places")).alias("n_hit"), F.array_sort("items").alias("items"))
    )
    rows = seen.documents.select(F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"), F.col("n_words").cast("long").alias("n_words"))
    return rows.join(
        hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left"
    ).select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(documents: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents without those that hold a window of an item."""
    bad = occurrences(documents, items, width).places.select(F.col("id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    bad = bounded(checkpointed(bad))
    return documents.join(bad, same_document(bad), "left_anti")
