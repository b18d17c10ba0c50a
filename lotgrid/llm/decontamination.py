"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Three steps, all of built-in functions.

1. Windows of an item's size are laid where one of the item's anchor shingles stands: a
   similarity ``t`` of two equally long windows needs ``2t / (1 + t)`` of an item's
   shingles, so of any larger rest of an item's shingles one occurs in the window.  A
   document shorter than the item needs only ``t`` of them, so more anchors are laid for it.
2. Every window has a 64-bit SimHash of its words.  Fingerprints are cut into ``BLOCKS``
   blocks; of two within ``RADIUS`` bits at least one pair of blocks differs in at most
   ``RADIUS // BLOCKS`` bits.  Items are indexed under all such neighbours of their blocks,
   windows look their own blocks up, and the full distance is compared after that: all
   windows within the radius of an item of their size are candidates, whichever item's
   anchor laid them.
3. The similarity of the weighted 5-word shingles (a shingle weighs as often as it occurs)
   of window and item decides.

The radius is a filter of words' votes, not of shingles; README has the share of windows at
a similarity of 0.75 that it lets through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.llm.common import stored

# Production parameters.
WIDTH = 5
MIN_SIMILARITY = 0.75
BLOCKS, BLOCK_BITS = 8, 8
RADIUS = 23  # bits of 64 in which a window's fingerprint may differ from its item's
# Tables about the benchmark up to this number of bytes are sent to all tasks; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20

WORD = r"[\p{L}\p{N}]+"


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))


def _needed(size: Column) -> Column:
    """Shingles of an item with ``size`` shingles that an equally long window has to hold."""
    return F.ceil(size * (2 * MIN_SIMILARITY / (1 + MIN_SIMILARITY)) - 1e-9)


def _shingle_count(words: str) -> Column:
    return F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.size(words) - (WIDTH - 1), F.lit(1)))


def _shingle_hashes(words: str, width: int = WIDTH) -> Column:
    """Hash of each ``width`` words by position; a shorter text is one shingle."""
    at = ", ".join(f"get({words}, i + {k})" for k in range(width))
    every = f"transform(sequence(0, greatest(size({words}) - {width}, 0)), i -> xxhash64({at}))"
    return F.expr(f"IF(size({words}) > 0, {every}, array())")


def _counted_shingles(words: str) -> Column:
    """Shingles as text, numbered by occurrence, so that a set intersection respects weights."""
    plain = f"transform(sequence(1, greatest(size({words}) - {WIDTH - 1}, 1)), i -> array_join(slice({words}, i, {WIDTH}), ' '))"
    counted = "transform(p, (s, i) -> s || '#' || size(filter(slice(p, 1, i + 1), o -> o = s)))"
    # The outer one-element transform names the shingles, so that they are built once; only repeated ones are counted.
    return F.expr(f"get(transform(array({plain}), p -> IF(size(array_distinct(p)) = size(p), transform(p, s -> s || '#1'), {counted})), 0)")


def simhash(words: str) -> Column:
    """64-bit SimHash of an array of words; each occurrence votes with its word's hash."""
    vote = "aggregate(hs, 0, (n, h) -> n + IF(bit_get(h, b) = 1, 1, -1))"
    bits = f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | shiftleft(IF({vote} > 0, 1L, 0L), b))"
    return F.expr(f"get(transform(array(transform({words}, w -> xxhash64(w))), hs -> {bits}), 0)")


# Exploding uses the outer forms: the inner ones make the optimizer test the size of an array
# first, by computing it a second time, with its own inputs recomputed for every element.


def prepare_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, words, size, item, fingerprint, shingles`` of the items that have words; equal rows once.  ``item`` is the words' hash."""
    items = benchmark.select("item_id", _words("text").alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("size", F.size("words")).withColumn("item", F.xxhash64("words"))
    return stored(items.select("*", simhash("words").alias("fingerprint"), _counted_shingles("words").alias("shingles")), "leak_items")


def _anchors(items: DataFrame) -> DataFrame:
    """``hash, at, size, slack, brief``: the anchor shingles of the items, one row per place and size.

    ``brief`` ones are only for documents of fewer words than the item, which may miss more shingles.
    """
    shingles = items.select("size", _shingle_count("words").alias("n"), _shingle_hashes("words").alias("hashes"))
    shingles = shingles.withColumn("slack", (F.col("n") - _needed(F.col("n"))).cast("int"))
    shingles = shingles.withColumn("spare", (F.col("n") - F.ceil(F.col("n") * MIN_SIMILARITY - 1e-9)).cast("int"))
    # The anchors are the shingles with the smallest hashes: any choice that is fixed per item will do.
    ranked = F.expr("slice(array_sort(transform(hashes, (h, i) -> struct(h AS hash, i AS at))), 1, spare + 1)")
    placed = shingles.select("size", "slack", F.posexplode(ranked).alias("rank", "a"))
    return placed.select("a.hash", "a.at", "size", "slack", (F.col("rank") > F.col("slack")).alias("brief")).distinct()


def _bounded(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Send ``df`` to all tasks when its rows are within the bound of bytes."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def _block(bits: str, at: str) -> str:
    return f"CAST(shiftrightunsigned({bits}, {at} * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} AS INT)"


def _index(items: DataFrame) -> DataFrame:
    """``size, block, value, entries``: items by every value that a block of a near fingerprint can have."""
    flips = sorted(m for m in range(1 << BLOCK_BITS) if m.bit_count() <= RADIUS // BLOCKS)
    near = F.array(*[F.lit(m) for m in flips])
    rows = items.select("size", "item", "fingerprint", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).distinct()
    rows = rows.withColumn("value", F.expr(_block("fingerprint", "block"))).withColumn("value", F.explode(F.transform(near, lambda m: F.col("value").bitwiseXOR(m))))
    return rows.groupBy("size", "block", "value").agg(F.collect_set(F.struct("item", "fingerprint")).alias("entries"))


def _candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, key, first, size, item, distance``: windows and items of one size within the radius."""
    index = stored(_index(items), "leak_index")
    at = F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> struct(b AS block, {_block('bits', 'b')} AS value))")
    asked = windows.select("doc_id", "key", "first", "size", "bits", F.explode_outer(at).alias("at")).select("*", "at.*")
    met = asked.join(_bounded(index, 32 + 24 * F.size("entries")), ["size", "block", "value"])
    near = F.expr(f"filter(entries, e -> bit_count(bits ^ e.fingerprint) <= {RADIUS})")
    found = met.select("doc_id", "key", "first", "size", "bits", near.alias("near")).where(F.size("near") > 0)
    found = found.select("doc_id", "key", "first", "size", "bits", F.explode_outer("near").alias("e"))
    return found.groupBy("doc_id", "key", "first", "size", F.col("e.item").alias("item")).agg(F.min(F.bit_count(F.expr("bits ^ e.fingerprint"))).alias("distance"))


def _holding(named: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``named`` whose text has one of ``keys(key)``, found where they lie while the keys are within the bound, so that other texts are not shuffled."""
    return named.join(_bounded(keys.select("key").distinct(), F.lit(64)), "key", "left_semi")


def _laid(named: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """The words of ``windows(doc_id, key, first, size, ...)``, cut from their documents, which are one row each."""
    extra = [c for c in windows.columns if c not in ("doc_id", "key", "first", "size")]
    by_doc = windows.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "size", *extra)).alias("windows"))
    by_doc = stored(by_doc, name).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "windows")
    kept = "".join(f", w.{c} AS {c}" for c in extra)
    cut = F.expr(f"transform(windows, w -> struct(w.first AS first, w.size AS size{kept}, slice(words, w.first + 1, w.size) AS words))")
    return (
        named.join(by_doc, named["doc_id"].eqNullSafe(by_doc["d"]) & (named["key"] == by_doc["k"]))
        .select("doc_id", "key", "windows", _words("text").alias("words"))
        .select("doc_id", "key", F.explode_outer(cut).alias("w"))
        .select("doc_id", "key", "w.*")
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Passages of ``benchmark(item_id, text)`` in ``docs(doc_id, text)``.

    One row per document and item: ``doc_id, key, item_id, first_word, n_words, distance,
    similarity`` of the most similar window (the first of equals); ``key`` is the text's
    hash.  Words are runs of letters and digits in lower case.  A document shorter than an
    item is one window.  Null and empty texts have no windows; equal rows are one; texts of
    any length are read whole.  An empty benchmark leaks nowhere.  ``min_similarity`` may be
    raised, not lowered below ``MIN_SIMILARITY``.
    """
    if min_similarity < MIN_SIMILARITY:
        raise ValueError(f"anchors are laid for a similarity of {MIN_SIMILARITY} or more")
    items = prepare_items(benchmark)
    anchors = stored(_anchors(items), "leak_anchors")
    named = docs.select("doc_id", F.xxhash64(text).alias("key"), F.col(text).alias("text"))

    # An item of fewer words is one shingle of its own width.
    short = [r["size"] for r in items.where(F.col("size") < WIDTH).select("size").distinct().collect()]
    placed = reduce(
        DataFrame.unionByName,
        [
            named.select("doc_id", "key", _words("text").alias("words"))
            .select("doc_id", "key", F.size("words").alias("n"), _shingle_hashes("words", width).alias("hashes"))
            .select("doc_id", "key", "n", F.posexplode_outer("hashes").alias("pos", "hash"))
            for width in [WIDTH, *sorted(short)]
        ],
    )
    # Every window of the item's size whose anchor is no further off its place than shingles may be missing.
    starts = F.expr("transform(sequence(-slack, slack), d -> greatest(0, least(pos - at + d, n - size)))")
    windows = (
        placed.join(_bounded(anchors, F.lit(64)), "hash")
        .where(~F.col("brief") | (F.col("n") < F.col("size")))
        .select("doc_id", "key", "size", F.explode_outer(F.array_distinct(starts)).alias("first"))
        .distinct()
    )
    windows = stored(windows, "leak_starts")
    # Most documents hold no anchor; the others' texts are met from here on.
    named = stored(_holding(named, windows).dropDuplicates(["doc_id", "key"]), "leak_texts")
    laid = _laid(named, windows, "leak_windows").select("doc_id", "key", "first", "size", simhash("words").alias("bits"))
    near = _laid(named, _candidates(stored(laid, "leak_prints"), items), "leak_near").withColumn("own", _counted_shingles("words"))
    sought = items.select("item_id", "item", "size", "shingles")
    size = 64 + F.aggregate("shingles", F.lit(0), lambda s, x: s + F.octet_length(x) + 16)
    met = near.join(_bounded(sought, size), ["item", "size"]).withColumn("common", F.size(F.array_intersect("own", "shingles")))
    scored = met.withColumn("similarity", F.col("common") / (F.size("own") + F.size("shingles") - F.col("common"))).where(F.col("similarity") >= min_similarity)
    scored = scored.withColumn("n_words", F.size("words"))
    best = F.max(F.struct("similarity", (-F.col("first")).alias("back"), "n_words", (-F.col("distance")).alias("near")))
    return (
        scored.groupBy("doc_id", "key", "item_id")
        .agg(best.alias("b"))
        .select(
            "doc_id",
            "key",
            "item_id",
            (-F.col("b.back")).cast("long").alias("first_word"),
            F.col("b.n_words").cast("long").alias("n_words"),
            (-F.col("b.near")).cast("int").alias("distance"),
            F.col("b.similarity").alias("similarity"),
        )
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; columns stay as they are."""
    leaks = stored(find_leaks(docs, benchmark, text).select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct(), "leaks")
    leaks = _bounded(leaks, F.lit(64))
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["d"]) & (F.xxhash64(docs[text]) == leaks["k"]), "left_anti")


SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(0, greatest(len(w) - 4, 1))) AS pos, w FROM docs WHERE len(w) > 0),
dsh AS (SELECT doc_id, n, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM ds),
its AS (SELECT item_id, len(w) AS n, unnest(range(0, greatest(len(w) - 4, 1))) AS pos, w FROM items WHERE len(w) > 0),
ish AS (SELECT item_id, n, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM its),
starts AS (
  SELECT DISTINCT d.doc_id, d.n AS dn, i.item_id, i.n AS n, greatest(0, least(d.pos - i.pos + g.o, d.n - i.n)) AS first
  FROM dsh d JOIN ish i USING (s) CROSS JOIN (SELECT unnest(range(-10, 11)) AS o) g),
win AS (
  SELECT s.doc_id, s.item_id, s.first, least(s.n, s.dn) AS len, d.s, count(*) AS c
  FROM starts s JOIN dsh d ON d.doc_id = s.doc_id AND d.pos >= s.first AND d.pos <= s.first + greatest(least(s.n, s.dn) - 5, 0)
  GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM ish GROUP BY ALL),
its_n AS (SELECT item_id, sum(c) AS n FROM ic GROUP BY ALL),
sims AS (
  SELECT w.doc_id, w.item_id, w.first, w.len, sum(least(w.c, coalesce(ic.c, 0))) AS common, sum(w.c) AS own
  FROM win w LEFT JOIN ic ON ic.item_id = w.item_id AND ic.s = w.s GROUP BY ALL),
best AS (
  SELECT doc_id, item_id, first, len, common * 1.0::DOUBLE / (own + n - common) AS similarity FROM sims JOIN its_n USING (item_id))
SELECT doc_id, item_id, first::BIGINT AS first_word, len::BIGINT AS n_words, similarity FROM best WHERE similarity >= {MIN_SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first) = 1
"""
