"""Exact n-gram Jaccard join with a token-group matrix.

Documents with the same shingle set are one node.  Similar nodes are first brought into
groups: tokens that several nodes have in their prefixes name a leader, and the nodes that
really are similar to it form its group.  What may still link across groups is decided by
the token-group matrix: every group holds the union of its members' tokens as bits, a query
node's overlap with a group is bounded by its tokens whose bits the group lacks, and only
groups that can qualify are opened and compared member by member, blocks of large groups
with all nodes that open them at once.

Two sets with a Jaccard similarity of at least 3/4 share a token among the first
``n - ceil(3n/4) + 1`` tokens of both, in any order that is the same for all.  The order
used here puts frequent tokens last; their frequencies come from a counting table of fixed
size over all documents.  A wrong count costs time, never a link.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.llm.common import byte_lengths, dropped, fresh, released, stored, text_parts, trimmed
from lotgrid.llm.components import components
from lotgrid.llm.wordhash import shingle_sets, split_words

# Production parameters.  The similarity is 3/4: 100 * intersection >= 75 * union.
WIDTH = 5
CELL_BITS = 24  # the counting table has 2**24 cells of one byte: 16 MB, whatever the corpus
CELL_BLOCKS = 64
LEADER_TOKENS = 3  # prefix tokens with one leader from which its nearness is looked at
GROUP_SIZE = 64  # members of a group of the matrix
HUB_ROUNDS = 2  # in which only representatives of the parts of a large group are compared
BLOCK_SIZE = 128  # nodes of a block that is compared with another at once
COLUMNS_AT_ONCE = 16_384
NEAR_SHARE = 0.36  # bound of the intersection over both sizes from which nodes are grouped; 3/7 is needed to link
# Rows of 16 bytes up to this number are sent to all tasks: 8 MB.
BROADCAST_ROWS = 500_000
TEXTS_AT_ONCE = 256
BYTES_AT_ONCE = 256 << 10


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches with their texts' shingle sets."""
    for whole in batches:
        for start, count in text_parts(byte_lengths(whole.column("text")), TEXTS_AT_ONCE, BYTES_AT_ONCE):
            batch = whole.slice(start, count)
            yield batch, shingle_sets(split_words(batch.column("text").to_pylist()), WIDTH)
    trimmed()


def _node(tokens: np.ndarray) -> int | None:
    """Signed 64-bit name of a set; None for the empty one."""
    if not len(tokens):
        return None
    with np.errstate(over="ignore"):
        return int((np.bitwise_xor.reduce(tokens * np.uint64(0xC2B2AE3D27D4EB4F)) + np.add.reduce(tokens) * np.uint64(0x165667B19E3779F9)).astype("i8"))


def _survey(docs: DataFrame) -> DataFrame:
    """One row per document (``doc_id, text_key, n, node``) and, per task, its token counts by block of cells (``block, cells``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, "u2")
        kind = None

        def rows(doc_id, key, n, node, block, packed) -> pa.RecordBatch:
            columns = [doc_id, key, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(block, pa.int32()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "node", "block", "cells"])

        for batch, sets in _sets(batches):
            kind = batch.column("doc_id").type
            at, count = np.unique(np.concatenate(sets) >> np.uint64(64 - CELL_BITS), return_counts=True)
            cells[at] = np.minimum(cells[at] + count, 60_000)
            none = [None] * len(sets)
            yield rows(batch.column("doc_id"), batch.column("text_key"), [len(s) for s in sets], [_node(s) for s in sets], none, none)
        for k, part in enumerate(np.split(cells, CELL_BLOCKS)):
            if part.any():
                yield rows(pa.nulls(1, kind), pa.nulls(1, pa.int64()), [None], [None], [k], [zlib.compress(part.tobytes(), 1)])

    kind = dict(docs.dtypes)["doc_id"]
    named = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return named.mapInArrow(run, f"doc_id {kind}, text_key long, n long, node long, block int, cells binary")


def _frequency_levels(survey: DataFrame) -> np.ndarray:
    """One byte per cell: 0 for the rare ones, then eight steps per doubling of the count."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << CELL_BITS) // CELL_BLOCKS, "i8")
        for packed in part["cells"]:
            total += np.frombuffer(zlib.decompress(packed), "u2")
        return pd.DataFrame({"block": part["block"].iloc[:1], "sum": [int(total.sum())], "cells": [zlib.compress(np.minimum(total, 2**32 - 1).astype("u4").tobytes(), 1)]})

    # A task's counts are at most 512 KB a block; a second level would add them in parts first.
    rows = survey.where("block IS NOT NULL").select("block", "cells").groupBy("block").applyInPandas(add, "block int, sum long, cells binary").collect()
    noise = sum(r["sum"] for r in rows) / (1 << CELL_BITS)
    levels = np.zeros((CELL_BLOCKS, (1 << CELL_BITS) // CELL_BLOCKS), "u1")
    # A token of one document may look this frequent; below that counts say nothing.
    rare = 1 + noise + 2 * noise**0.5
    for r in rows:
        count = np.frombuffer(zlib.decompress(r["cells"]), "u4")
        levels[r["block"]] = np.minimum(255, np.ceil(8 * np.log2(np.maximum(count / rare, 1.0)))).astype("u1")
    return levels.reshape(-1)


def _bitmap(tokens: np.ndarray, bits: int) -> list[int]:
    """Bits of the tokens' cells among ``bits``, as 64-bit numbers."""
    flags = np.zeros(bits, bool)
    flags[(tokens & np.uint64(bits - 1)).astype("i8")] = True
    return np.packbits(flags, bitorder="little").view("<i8").tolist()


def _signatures(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """``node, n, prefix, bits``: prefix tokens and a bitmap of 2 to 4 bits a token.

    Equal sets within a batch of texts give one row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for _, sets in _sets(batches):
            rows = {}
            for s in sets:
                node, n = _node(s), len(s)
                if node is None or node in rows:
                    continue
                keep = n - (3 * n + 3) // 4 + 1
                order = np.argsort(level[s >> np.uint64(64 - CELL_BITS)], kind="stable")[:keep]
                rows[node] = (node, n, s[order].astype("i8").tolist(), _bitmap(s, 1 << max(6, (2 * n - 1).bit_length())))
            node, n, prefix, bits = zip(*rows.values(), strict=True) if rows else ((), (), (), ())
            lists = [pa.array(list(v), pa.list_(pa.int64())) for v in (prefix, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), *lists], ["node", "n", "prefix", "bits"])

    return docs.select("text").mapInArrow(run, "node long, n long, prefix array<long>, bits array<long>")


def _lacking(a: Column, b: Column) -> Column:
    """Bits of ``a`` that ``b`` does not have: as many tokens at least are only in ``a``.

    Widths are powers of two; of two that differ by a factor of two the wider is folded.
    """

    def folded(x: Column, other: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        fold = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(x) > F.size(other), fold).otherwise(x)

    missing = F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(missing, F.lit(0), lambda s, x: s + x)


def _bound(p: str, q: str) -> Column:
    """Bound of the intersection of two rows over the sum of their sizes, from the bitmaps."""
    np_, nq = F.col(f"{p}.n"), F.col(f"{q}.n")
    bp, bq = F.col(f"{p}.bits"), F.col(f"{q}.bits")
    return F.least(np_ - _lacking(bp, bq), nq - _lacking(bq, bp)) / (np_ + nq)


def _sizes_fit(p: str, q: str) -> Column:
    return 4 * F.least(f"{p}.n", f"{q}.n") >= 3 * F.greatest(f"{p}.n", f"{q}.n")


# Bounds are compared with a little slack for their rounding.
LEAST_SHARE = 3 / 7 - 1e-9


def _token_sets(nodes: DataFrame, docs: DataFrame, members: DataFrame) -> DataFrame:
    """``node, comp, size, tokens`` of the given ``nodes(node, comp, size)``, from one document each; it is named by its id and its text's hash, so that a null id names one too."""
    named = members.join(nodes, "node").groupBy("node", "comp", "size").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("owner"))
    owners = stored(named.select("node", "comp", "size", "owner.doc_id", "owner.text_key"), "join_owners")
    # Texts stay where they are while the list of owners is short; a longer one is met by shuffle.
    side = F.broadcast(owners) if owners.count() <= BROADCAST_ROWS else owners
    named = docs.select("text", F.xxhash64("text").alias("key"), F.col("doc_id").alias("id"))
    chosen = named.join(side, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "node", "comp", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches):
            # Repeated rows of a batch, and copies with null ids, give one row.
            rows = {k: at for at, (k, s) in enumerate(zip(batch.column("node").to_pylist(), sets, strict=True)) if _node(s) == k}
            kept = [sets[at].astype("i8") for at in rows.values()]
            ends = np.cumsum([0, *map(len, kept)])
            tokens = pa.array(np.concatenate([np.zeros(0, "i8"), *kept]), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)
            names = ["node", "comp", "size"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(list(rows.values()), pa.int64())) for c in names), lists], [*names, "tokens"])

    return stored(chosen.mapInArrow(run, "node long, comp long, size long, tokens array<long>"), "join_sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets really have a similarity of 3/4."""
    sets = sets.dropDuplicates(["node"])
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    counted = both.select("a", "b", common.alias("common"), (F.size("ta") + F.size("tb")).alias("total"))
    return stored(counted.where(7 * F.col("common") >= 3 * F.col("total")).select("a", "b"), "join_links")


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """``a, b, bound, ca, cb``: the pairs whose nodes are not in one component yet, with the two components."""
    of = lambda n: comps.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    known = known.select("a", "b", "bound", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    return known.where("x <> y").select("a", "b", "bound", F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"))


def _sized(groups: DataFrame) -> DataFrame:
    """``node, comp, size``: the nodes of ``groups(node, comp)`` with the number of nodes of their group."""
    return stored(groups.join(groups.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "comp").select("node", "comp", "size"), "join_sized")


def _within_groups(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect the similar nodes inside each group of ``placed(node, comp, size)``.

    A group is compared block by block first, each node only with those of its own block.
    One representative for each component found then meets those of the other components,
    for at most ``HUB_ROUNDS`` rounds.  Only where a group is still in parts, every node
    outside its largest part meets all nodes of the group.  A task returns only the links that
    connect the parts it has seen.
    """
    small, large = F.col("size") <= BLOCK_SIZE, placed.where(F.col("size") > BLOCK_SIZE)
    bundles = max(1, placed.where(small).count() // BLOCK_SIZE)
    # The sets know their groups, so that they move once, to their blocks.
    x, y = F.when(small, F.expr(f"pmod(xxhash64(comp), {bundles})")).otherwise(F.col("comp")), F.when(small, -1).otherwise(F.expr(_block("node", "size")))
    found = _compared(sets.select(x.alias("x"), y.alias("y"), "comp", "node", "tokens"), "join_blocks")
    links = found.where("a <> b").select("a", "b")
    if large.isEmpty():
        return links
    # Parts of large groups: every node with its part's name and how many of its block it links to.
    parts = found.select(F.col("a").alias("node"), F.col("b").alias("part"), "degree").join(large.select("node", "comp"), "node")
    parts = stored(parts.select("comp", "node", "part", "degree"), "join_parts")
    for _ in range(HUB_ROUNDS):
        open_groups = parts.groupBy("comp").agg(F.countDistinct("part").alias("size")).where("size > 1")
        first = parts.join(open_groups, "comp").groupBy("comp", "size", "part").agg(F.max(F.struct("degree", "node")).alias("hub"))
        dealt = first.select(F.col("hub.node").alias("node"), "comp", F.col("comp").alias("x"), F.expr(_block("part", "size")).alias("y"))
        dealt = stored(dealt, "join_dealt")
        met = _compared(dealt.join(sets.select("node", "tokens"), "node"), "join_hubs").where("a <> b").select("a", "b") if not dealt.isEmpty() else None
        if met is None or met.isEmpty():
            break
        links = links.unionByName(met)
        parts = _renamed(parts, met)
    # Nothing is dealt where every group is one part.
    if not dealt.isEmpty():
        links = links.unionByName(_between_parts(parts, sets))
    return links


def _block(key: str, size: str) -> str:
    return f"CAST(pmod(xxhash64({key}), CAST(ceil({size} / {BLOCK_SIZE}) AS INT)) AS INT)"


def _renamed(parts: DataFrame, met: DataFrame) -> DataFrame:
    """Parts under the names that new links between some of their nodes give them."""
    named = parts.select("node", "part")
    between = met.join(named.select(F.col("node").alias("a"), F.col("part").alias("x")), "a").join(named.select(F.col("node").alias("b"), F.col("part").alias("y")), "b")
    new = components(between.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "part")
    out = parts.join(new.withColumnRenamed("comp", "new"), "part", "left").select("comp", "node", F.coalesce("new", "part").alias("part"), "degree")
    return stored(out, "join_parts")


def _compared(dealt: DataFrame, name: str) -> DataFrame:
    """``a, b, degree``: every node of ``dealt(node, comp, x, y, tokens)``, the first node of its block that it reaches, and its links."""

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in part.drop_duplicates("node").groupby("comp"):
            nodes = group["node"].to_numpy()
            root, degree = _connected(group["tokens"].tolist())
            found.append(pd.DataFrame({"a": nodes, "b": nodes[root], "degree": degree}))
        trimmed()
        return pd.concat(found)

    rows = dealt.select("x", "y", "comp", "node", "tokens")
    return stored(rows.groupBy("x", "y").applyInPandas(compare, "a long, b long, degree long"), name)


def _between_parts(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the parts of the groups that are still apart: all nodes outside the largest part meet all nodes.

    Every link is given as the names of two parts.
    """
    sizes = parts.groupBy("comp", "part").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("comp").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    most = most.select("comp", F.col("top.part").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("outer"))
    rows = stored(parts.join(most, "comp"), "join_apart")
    asks, all_ = F.expr(f"CAST(ceil(outer / {BLOCK_SIZE}) AS INT)"), F.expr(f"CAST(ceil(all / {BLOCK_SIZE}) AS INT)")
    # The asking nodes of a block go to every block of the others, and the other way round.
    left = rows.where("part <> main").select("comp", "node", "part", F.lit(0).alias("side"), F.expr(_block("node", "outer")).alias("y"), F.explode(F.sequence(F.lit(0), all_ - 1)).alias("z"))
    right = rows.select("comp", "node", "part", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), asks - 1)).alias("y"), F.expr(_block("node", "all")).alias("z"))

    dealt = left.unionByName(right).join(sets.select("node", "tokens"), "node").select("comp", "y", "z", "side", "part", "tokens")
    return stored(dealt.groupBy("comp", "y", "z").applyInPandas(_parts_linked, "a long, b long").distinct(), "join_links")


def _parts_linked(rows: pd.DataFrame) -> pd.DataFrame:
    """``a, b``: names of parts that sets of ``side`` 0 and 1 connect, each with the smallest that it reaches."""
    ask, other = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if not len(ask) or not len(other):
        return pd.DataFrame({"a": [], "b": []}, dtype="i8")
    i, j = np.nonzero(_linked(ask["tokens"].tolist(), other["tokens"].tolist()))
    names, number = np.unique(np.concatenate([ask["part"].to_numpy(), other["part"].to_numpy()]), return_inverse=True)
    a, b = number[i], number[len(ask) + j]
    root = np.arange(len(names))
    while True:
        # Every part takes the smallest name among the parts that it links to.
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    return pd.DataFrame({"a": names, "b": names[root]})[names != names[root]]


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether each set of ``left`` and each of ``right`` have a similarity of 3/4."""
    sets = [*left, *right]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    token, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[at] > 1
    owner, column = owner[shared], number[at[shared]]
    common = np.zeros((len(left), len(right)), "f4")
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [first, first + COLUMNS_AT_ONCE])
        table = np.zeros((len(sets), COLUMNS_AT_ONCE), "f4")
        table[owner[a:b], column[a:b] - first] = 1.0
        common += table[: len(left)] @ table[len(left) :].T
    return 7 * common >= 3 * (size[: len(left), None] + size[None, len(left) :])


def _connected(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first one that it reaches by links of a similarity of 3/4, and its number of links."""
    linked = _linked(sets, sets)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        least = np.where(linked, label[None, :], len(sets)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label, linked.sum(axis=1) - 1
        label = least


def _asked_blocks(opened: DataFrame, members: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between components: the nodes of ``opened(a, grp)`` meet the members of their groups, block by block.

    Every link is given as the names of two components.
    """
    asks = opened.groupBy("grp").agg(F.count(F.lit(1)).alias("asks"))
    blocks = F.expr(f"CAST(ceil(asks / {BLOCK_SIZE}) AS INT)")
    left = opened.join(asks, "grp").select("grp", F.col("a").alias("node"), F.lit(0).alias("side"), F.expr(_block("a", "asks")).alias("y"))
    right = members.join(asks, "grp").select("grp", "node", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("y"))
    dealt = left.unionByName(right).join(comps.select("node", F.col("comp").alias("part")), "node", "left").join(sets.select("node", "tokens"), "node")
    dealt = dealt.select("grp.comp", "grp.block", "grp.width", "y", "side", F.coalesce("part", "node").alias("part"), "tokens")
    return stored(dealt.groupBy("comp", "block", "width", "y").applyInPandas(_parts_linked, "a long, b long").distinct(), "join_links")


def _across_groups(postings: DataFrame, comps: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the token-group matrix cannot rule out between nodes in different groups.

    ``postings(token, node)`` has every prefix token of two or more nodes.  Pairs
    ``(a, b, bound)`` with members of groups of at most ``GROUP_SIZE``; the nodes ``(a, grp)``
    that open a block of a larger group; and the members ``(node, grp)`` of the larger groups.
    """
    placed = postings.join(comps, "node", "left").select("token", "node", F.coalesce("comp", "node").alias("comp"))
    open_tokens = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    placed = stored(placed.join(open_tokens.select("token"), "token", "left_semi"), "join_open")
    nodes = placed.select("node", "comp").distinct()
    sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    kinds = signatures.dropDuplicates(["node"])
    members = nodes.join(sizes, "comp").join(kinds, "node").withColumn("block", F.expr(f"pmod(xxhash64(node), CAST(ceil(members / {GROUP_SIZE}) AS INT))"))
    # Members of a group have bitmaps of one width.
    group = F.struct("comp", "block", F.size("bits").alias("width"))
    members = stored(members.select("node", "comp", "members", "n", "bits", group.alias("grp")), "join_members")
    tokens = placed.select("token", "node").join(members.select("node", "comp", "members", "n", "grp"), "node")
    queries = tokens.select("token", F.col("node").alias("a"), "n", F.struct("members", "comp").alias("own"))
    holders = tokens.select("token", "grp", F.struct("members", "comp").alias("other")).distinct()
    # Of two groups the members of the smaller one ask; equal sizes go by name.
    asked = queries.join(holders, "token").where("own < other").select("a", "n", "grp", "other.members").distinct()
    spans = members.groupBy("grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    asked = stored(asked.join(spans, "grp").where("4 * n >= 3 * lo AND 4 * hi >= 3 * n").select("a", "grp", "members"), "join_asked")
    matrix = members.groupBy("grp").agg(F.collect_list(F.struct("node", "n", "bits")).alias("m"))
    union = F.expr("aggregate(slice(m, 2, size(m)), m[0].bits, (u, x) -> zip_with(u, x.bits, (p, q) -> p | q))")
    matrix = stored(matrix.select("grp", union.alias("bits"), "m"), "join_matrix")
    q = members.select(F.col("node").alias("a"), F.struct("n", "bits").alias("q"))
    opened = asked.join(q, "a").join(matrix, "grp")
    wq, wg = F.size("q.bits"), F.size("bits")
    fits = (2 * wq >= wg) & (2 * wg >= wq) & (4 * (F.col("q.n") - _lacking(F.col("q.bits"), F.col("bits"))) >= 3 * F.col("q.n"))
    opened, small = opened.where(fits), F.col("members") <= GROUP_SIZE
    pairs = opened.where(small).select("a", "q", F.explode("m").alias("g")).where(_sizes_fit("q", "g"))
    pairs = pairs.select("a", F.col("g.node").alias("b"), _bound("q", "g").alias("bound")).where(F.col("bound") >= LEAST_SHARE)
    # Variants of one text open nearly all blocks of their family: its members stay together in rows of blocks.
    return pairs, stored(opened.where(~small).select("a", "grp"), "join_opened"), members.where(~small).select("node", "grp")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Documents link when 100 * intersection >= 75 * union of their sets of 5-word shingles;
    ``component_id`` is the smallest doc_id reachable.  A null or empty text, or one without
    words, has no shingles and links with nothing.  Rows with a null doc_id take part; a
    component that has no other rows has a null id.
    """
    survey = stored(_survey(docs), "join_survey")
    members = survey.where("block IS NULL").select("doc_id", "text_key", "n", "node")
    levels = _frequency_levels(survey)
    signatures = stored(_signatures(docs, levels), "join_signatures")
    rows = signatures.select("node", F.explode_outer("prefix").alias("token"))
    shared = rows.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    shared = stored(shared, "join_shared")
    # The prefixes are moved twice; the first copy goes before the second is made.
    released(docs.sparkSession)
    postings = stored(rows.join(shared, "token").select("token", "node", "leader", "last").distinct(), "join_postings")
    dropped(shared)
    sides = signatures.select("node", F.struct("n", "bits").alias("s")).dropDuplicates(["node"])
    sides = stored(sides.join(postings.select("node").distinct(), "node", "left_semi"), "join_sides")
    dropped(signatures)
    led = postings.select(F.col("node").alias("a"), F.explode(F.array("leader", "last")).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    # One common token rarely means nearness; what is missed here is left to the matrix.
    led = led.where(F.col("w") >= LEADER_TOKENS).select("a", "b")
    led = led.join(sides.select(F.col("node").alias("a"), F.col("s").alias("p")), "a").join(sides.select(F.col("node").alias("b"), F.col("s").alias("q")), "b")
    # Groups take in what is only near, so that whole clusters of variants are compared inside them.
    near = stored(led.select("a", "b", _bound("p", "q").alias("bound")).where(F.col("bound") >= NEAR_SHARE).select("a", "b"), "join_near")
    groups = components(near)
    del rows, led
    released(docs.sparkSession)
    placed = _sized(groups)
    sets = _token_sets(placed, docs, members)
    links = _within_groups(placed, sets)
    comps = components(links)
    rest, opened, large = _across_groups(postings.select("token", "node"), groups, sides.select("node", "s.*"))
    rest = stored(_between(rest, comps), "join_rest")
    missing = rest.select(F.explode(F.array("a", "b")).alias("node")).union(opened.select("a")).distinct().join(sets.select("node"), "node", "left_anti")
    missing = stored(missing, "join_missing")
    if not missing.isEmpty():
        alone = missing.select("node", F.col("node").alias("comp"), F.lit(1).cast("long").alias("size"))
        sets = sets.unionByName(_token_sets(alone, docs, members))
    if not opened.isEmpty():
        met = _asked_blocks(opened, large, comps, sets)
        if not met.isEmpty():
            links = links.unionByName(met)
            comps = components(links)
            rest = stored(_between(rest.select("a", "b", "bound"), comps), "join_rest")
    # One link joins two components: their most promising pair goes first, and only where
    # components stay apart all their pairs are compared.
    if not rest.isEmpty():
        first = rest.groupBy("ca", "cb").agg(F.max(F.struct("bound", "a", "b")).alias("p")).select("p.a", "p.b")
        links = links.unionByName(_verified(first, sets))
        comps = components(links)
        rest = stored(_between(rest.select("a", "b", "bound").distinct(), comps), "join_rest")
        if not rest.isEmpty():
            links = links.unionByName(_verified(rest, sets))
            comps = components(links)
    dropped(sets, sides, postings)
    ids = stored(members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id")), "join_ids")
    placed = ids.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = stored(placed.groupBy("comp").agg(F.min("first_id").alias("component_id")), "join_named")
    answer = stored(placed.join(named, "comp").select("node", "component_id"), "join_answer")
    # A node with very many copies is met by skew splitting; both sides are plain tables.
    return members.join(answer, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of linked ones: that with the smallest id.

    Columns stay as they are; rows without shingles all stay; of repeated rows one stays.
    ``docs`` has to be a stored table: its rows are numbered, in each of two readings alike.
    """
    row = fresh("row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    groups = stored(similar_documents(numbered.select(F.col(row).alias("doc_id"), F.col(text).alias("text"))), "join_groups")
    ids = numbered.select(F.col(row).alias("doc_id"), F.col(doc_id).alias("own"))
    # Only groups of two and more are looked at again.
    many = groups.where("doc_id <> component_id").select("component_id").distinct()
    inside = groups.join(many, "component_id", "left_semi").join(ids, "doc_id").select("component_id", F.struct(F.col("own").isNull().alias("none"), "own", "doc_id").alias("who"))
    inside = stored(inside, "join_inside")
    first = stored(inside.groupBy("component_id").agg(F.min("who").alias("first")), "join_first")
    gone = inside.join(first, "component_id").where(F.col("who.doc_id") != F.col("first.doc_id")).select(F.col("who.doc_id").alias(row))
    return numbered.join(stored(gone, "join_gone"), row, "left_anti").drop(row)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, m.c), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) m USING (doc_id)
"""
