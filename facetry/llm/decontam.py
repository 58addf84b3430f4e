"""Benchmark decontamination with DataFrame functions only.

Test items become windows of 13 normalised words (an item of fewer words is one
window); the hashes of all windows are a set that is broadcast. Training texts are cut
into words in one pass; every window of theirs probes the set, and a probe that hits is
verified: its words are compared with the words of the benchmark's window before
anything leaves the scan. Only verified windows are shuffled, for the counts of each
document; that query's rows without hits come from the same scan.

The set is broadcast while its words and item names have at most ``BROADCAST_BYTES``
bytes (measured before); beyond, the hashes of the documents' windows meet it by a
shuffle and the texts are joined back for the verification. A window that very many
documents hold is one key of that join, which adaptive execution splits.

Edge cases: null and empty texts have no words and no hits; very long texts are scanned
whole; a window that occurs in several items counts for all of them; windows that
overlap or touch share their words' hits; rows that repeat an id and text share one
result each; empty tables give empty results or no hits; further columns pass through
``remove_contaminated``, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.session import settled

WINDOW = 13
#: Bytes of words and item names that are broadcast at most.
BROADCAST_BYTES = 64 << 20

#: What is between words: ASCII but for digits, letters a-z.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """A-Z lower-cased; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The normalised words of a text."""
    return F.filter(F.split(normal(text), _BETWEEN), lambda w: w != "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct ``key, n, window`` with the items that hold the window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    unique = cut.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return unique.select(F.xxhash64("window").alias("key"), F.size("window").alias("n"), "window", "items")


def _weighed(table: DataFrame) -> tuple[list[int], int]:
    """The sizes of the windows and their bytes with those of the item names."""
    own = F.aggregate(F.concat("window", "items"), F.lit(64).cast("long"), lambda total, w: total + F.octet_length(w) + 16)
    found = table.groupBy("n").agg(F.sum(own).alias("bytes")).collect()  # at most a row for each size
    return sorted(r["n"] for r in found), sum(r["bytes"] for r in found)


def _scan(documents: DataFrame, sizes: list[int], rows: bool) -> DataFrame:
    """``doc_id, digest, m, w, at, size, key`` of every window of the documents; with
    ``rows`` also one line for each document, at -1 with size 0."""
    cut = documents.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("w")).withColumn("m", F.size("w"))
    first, least = (-1 if rows else 0), min(sizes, default=1)
    places = F.sequence(F.lit(first), F.greatest(F.col("m") - least, F.lit(first)))
    if not rows:
        cut = cut.filter(F.col("m") >= least)
    each = cut.select("doc_id", "digest", "m", "w", F.explode(places).alias("at"))
    if len(sizes) < 2:
        return each.withColumn("size", F.when(F.col("at") < 0, 0).otherwise(least)).withColumn("key", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.slice("w", F.col("at") + 1, least))))
    # no lambda from here to the join: what stands in generated code is never held row by row
    some = F.when(F.col("at") < 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, sizes)))
    sized = each.select("*", F.explode(some).alias("size")).filter((F.col("at") < 0) | (F.col("at") + F.col("size") <= F.col("m")))
    return sized.withColumn("key", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.slice("w", F.col("at") + 1, F.col("size")))))


def hits(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, rows: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, digest, m, start, n, items`` of every window that occurs: ``m`` words in
    the text, ``start`` counted from 0, ``digest`` to tell texts of one id apart. With
    ``rows`` also a line for each document, with ``start`` -1 and ``n`` 0."""
    table = settled(windows(benchmark, size))
    sizes, weight = _weighed(table)
    scanned = _scan(documents, sizes, rows)
    columns = ["doc_id", "digest", "m", F.col("at").alias("start"), F.col("size").alias("n"), "items"]
    # the documents' own lines meet a line of the table that no window can have
    mark = table.sparkSession.range(1 if rows else 0).select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"))
    if weight <= broadcast_bytes:
        held = F.broadcast(table.unionByName(mark))
        same = F.when(scanned.at < 0, held.n == 0).otherwise((held.n == scanned.size) & (F.slice("w", F.col("at") + 1, F.col("size")) == F.col("window")))
        return scanned.join(held, (scanned.key == held.key) & same).select(*columns)
    probes = scanned.filter("at >= 0").select("doc_id", "digest", "m", "at", "size", "key")
    met = probes.join(table.withColumnRenamed("n", "size"), ["key", "size"])
    texts = documents.select(F.col("doc_id").alias("its_id"), F.xxhash64("text").alias("its_digest"), words(F.col("text")).alias("w")).dropDuplicates(["its_id", "its_digest"])
    verified = met.join(texts, met.doc_id.eqNullSafe(texts.its_id) & (met.digest == texts.its_digest) & (F.slice("w", F.col("at") + 1, F.col("size")) == F.col("window"))).select(*columns)
    if rows:
        verified = verified.unionByName(documents.select("doc_id", F.xxhash64("text").alias("digest"), F.size(words(F.col("text"))).alias("m"), F.lit(-1).alias("start"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("items")))
    return verified


def counted(found: DataFrame) -> DataFrame:
    """``doc_id, digest, rows, m, n_hit, items, spans`` of hits by document; ``spans`` are
    the windows' places in order."""
    span = F.when(F.col("n") > 0, F.struct("start", (F.col("start") + F.col("n")).alias("stop")))
    grouped = found.groupBy("doc_id", "digest").agg(F.count_if(F.col("n") == 0).alias("rows"), F.max("m").cast("long").alias("m"), F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set(F.when(F.size("items") > 0, F.col("items"))).alias("items"))
    # words inside any span: each span adds what lies beyond the spans before it
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    inside = F.aggregate("spans", start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(s["stop"], a["upto"]).alias("upto")), lambda a: a["n"])
    return grouped.select("doc_id", "digest", "rows", "m", inside.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), "spans")


def _judged(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The report of the query: one row per document."""
    found = counted(hits(documents.select("doc_id", "text"), benchmark, size, True, broadcast_bytes))
    report = found.select(
        "rows", "doc_id", F.col("m").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _judged(F.col("n_hit"), F.col("m")).alias("contaminated")
    )
    # rows that repeat an id and text are counted as one group
    return report.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that aren't contaminated; passages of the benchmark in them are
    cut out. All columns stay as they are."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    mark = uuid.uuid4().hex[:8]  # no column is called so
    its_id, its_digest, bad, spans = (f"{x}_{mark}" for x in ("id", "digest", "bad", "spans"))
    found = settled(counted(hits(documents.select("doc_id", "text"), benchmark, size, False, broadcast_bytes)).select(F.col("doc_id").alias(its_id), F.col("digest").alias(its_digest), _judged(F.col("n_hit"), F.col("m")).alias(bad), F.col("spans").alias(spans)))
    weight = found.agg(F.sum(32 + 8 * F.size(spans))).first()[0] or 0
    if weight <= broadcast_bytes:
        found = F.broadcast(found)
    joined = documents.join(found, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.xxhash64("text") == F.col(its_digest)), "left")
    # each word with what stands before it, so that the k-th chunk has the k-th word
    sep, word = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
    chunks = F.regexp_extract_all("text", F.lit(f"{sep}*+{word}++|{sep}++"), F.lit(0))
    cut = F.array_join(F.filter(chunks, lambda _, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["stop"]))), "")
    kept = joined.filter(~F.coalesce(bad, F.lit(False)))
    return kept.withColumn("text", F.when(F.col(spans).isNotNull(), cut).otherwise(F.col("text"))).select(*columns)
