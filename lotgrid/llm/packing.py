"""Best-fit packing of documents into fixed-length sequences, improved by swaps.

Texts are tokenised once; after that only piece lengths move.  Pieces are spread over
groups of a fixed number of sequences, so that a group is one task of bounded size whatever
the corpus.  Each group is packed best fit first, longest piece first, and then improved:
documents are moved or exchanged one for one and two for one between underfull bins, each
step raising the sum of squared fills, until bins run empty.  Bins that stay underfull in
all groups are packed once more together.
"""

from __future__ import annotations

import os
import re
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgrid.llm.common import map_texts, stored
from lotgrid.llm.wordhash import split_words

# Production parameters.
CAPACITY = 2048
END_ID = 0
GROUP_BINS = 2048  # sequences that one packing task fills
FULL = 0.999  # bins filled less than this go to the second round
MEMO_WORDS = 1_000_000  # words whose ids one Python worker remembers
TEXTS_AT_ONCE = 256

GROUP_BITS = 24  # bins of a group in the low bits of a sequence id


class WordIds:
    """Ids of a tokenizer whose tokens never cross white space and do not tell A-Z from a-z, remembered per word.

    Words are cut and hashed for many texts at once; ids are looked up for the distinct ones.
    The memory is sorted arrays, about 45 bytes a word; a dictionary of a million words takes four times that.
    """

    # White space beyond ASCII takes two or three bytes; texts that have it go through str.split().
    WIDE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
    SPACE = re.compile(r"[^\S\x1c-\x1f]+")  # str.split() also breaks at four control characters

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        # Hashes of the known words in ascending order, and where each one's ids are told.
        self.keys, self.slots = np.zeros(0, "u8"), np.zeros(0, "i4")
        self.starts, self.sizes, self.flat = np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "u4")

    def _learn(self, words: list[str]) -> None:
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        lengths = np.fromiter(map(len, words), "i8", len(words))
        begins = np.cumsum(lengths + 1) - lengths - 1
        at = np.fromiter(map(itemgetter(0), encoded.offsets), "i8", len(encoded.ids))
        sizes = np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(words))
        self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, sizes.astype("i4")])
        self.flat = np.concatenate([self.flat, np.array(encoded.ids, "u4")])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # One blank stands for every wide one.
        plain = [" ".join(filter(None, self.SPACE.split(t))) if not t.isascii() and self.WIDE.search(t) else t for t in texts]
        words = split_words(plain)
        kinds, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_WORDS:
            self._forget()
        place = np.searchsorted(self.keys, kinds)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == kinds[known]
        if not known.all():
            new = np.flatnonzero(~known)
            data, at = words.data.tobytes(), first[new]
            spans = zip(words.begin[at].tolist(), words.end[at].tolist(), strict=True)
            slots = np.arange(len(self.starts), len(self.starts) + len(new), dtype="i4")
            self._learn([data[a:b].decode("utf-8", "surrogatepass") for a, b in spans])
            self.slots = np.insert(self.slots, place[new], slots)
            self.keys = np.insert(self.keys, place[new], kinds[new])
            place = np.searchsorted(self.keys, kinds)
        at = self.slots[place][number]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        marks = np.concatenate([[0], ends])[words.bounds]
        return [ids[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]


_ENCODERS: dict[str, WordIds] = {}


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every row of ``docs(doc_id, text)``.

    A document is its ids and one ``end_id``; a null text is empty.  Only documents above
    the capacity are cut.  A repeated row gives its pieces again.
    """

    def run(texts: list[str | None]) -> tuple[list[int], dict[str, list]]:
        encoder = _ENCODERS.setdefault(tokenizer, None) or WordIds(tokenizer)
        _ENCODERS[tokenizer] = encoder
        at, out = [], {name: [] for name in made}
        for k, ids in enumerate(encoder.encode([t or "" for t in texts])):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                at.append(k)
                for name, value in zip(made, (piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    out[name].append(value)
        return at, out

    made = {"piece": ("int", pa.int32())} | {c: ("long", pa.int64()) for c in ("start", "length", "ids_crc32")}
    return map_texts(docs, ["doc_id"], "text", made, run, TEXTS_AT_ONCE)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    frees = 0  # bit f is set when a bin has f places free
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = frees >> n
        if fits:
            free = (fits & -fits).bit_length() - 1 + n
            b = by_free[free].pop()
            if not by_free[free]:
                frees ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := free - n:
            by_free.setdefault(left, []).append(b)
            frees |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: drain the emptiest bins into fuller ones that still have room.

    A step moves one document, or exchanges one or two documents of the drained bin for one
    shorter document elsewhere; the step that moves most is taken.  The receiving bin is the
    fuller one, so every step raises the sum of squared fills and the search ends.  Every
    underfull bin is tried, emptiest first, and all are tried again as long as that empties
    one; the search also ends at the fewest bins that can exist.
    """
    fewest = -(-sum(lengths) // capacity)
    size, home = np.array(lengths, "i8"), np.zeros(len(lengths), "i8")
    for b, held in enumerate(bins):
        home[held] = b
    fill = np.bincount(home, size, len(bins)).astype("i8") if bins else np.zeros(0, "i8")
    alive, emptied = len(bins), False
    tried = np.zeros(len(bins), bool)
    while alive > fewest:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity) & ~tried)
        if not len(open_bins):
            if not emptied:
                break
            tried[:], emptied = False, False
            continue
        source = open_bins[np.argmin(fill[open_bins])]
        tried[source] = True
        while fill[source]:
            own = np.flatnonzero(home == source)
            room = np.where(fill >= fill[source], capacity - fill, 0)
            room[source] = 0
            given = {int(size[i]): (i,) for i in own}
            for k, i in enumerate(own):
                for j in own[k + 1 :]:
                    given.setdefault(int(size[i] + size[j]), (i, j))
            place, gain, step = room[home], 0, None
            for total, docs in given.items():
                if len(docs) == 1 and gain < total <= room.max(initial=0):
                    # the fullest bin that takes the document whole
                    gain, step = total, (docs, None, int(np.argmin(np.where(room >= total, room, capacity + 1))))
                moved = total - size
                moved[(moved > place) | (moved <= gain)] = 0
                if moved.any():
                    taken = int(np.argmax(moved))
                    gain, step = int(moved[taken]), (docs, taken, int(home[taken]))
            if step is None:
                break
            docs, taken, target = step
            home[list(docs)] = target
            if taken is not None:
                home[taken] = source
            fill[target] += gain
            fill[source] -= gain
        if not fill[source]:
            alive, emptied = alive - 1, True
    order = np.argsort(home, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(home[order])) + 1)
    return [p.tolist() for p in parts if len(p)]


def _pack_groups(pieces: DataFrame, groups: int, first_group: int, capacity: int) -> DataFrame:
    """Pack each of ``groups`` random parts; adds ``sequence_id, offset, fill``."""

    def run(part: pa.Table) -> pa.Table:
        # Ties between equal lengths fall the same way however the rows arrive.
        keys = [c for c in ("length", "doc_id", "piece", "start") if c in part.column_names]
        part = part.sort_by([(c, "ascending") for c in keys])
        lengths = part["length"].to_pylist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        out = part.take(pa.array([i for b in bins for i in b], pa.int64())).drop_columns(["__group"])
        size, own = np.array([len(b) for b in bins]), out["length"].to_numpy()
        ends, first = np.cumsum(own), np.repeat(np.cumsum(size) - size, size)
        fill = np.add.reduceat(own, np.cumsum(size) - size)
        group = first_group + part["__group"][0].as_py()
        made = {
            "sequence_id": (group << GROUP_BITS) + np.repeat(np.arange(len(bins)), size),
            "offset": ends - own - (ends - own)[first],
            "fill": np.repeat(fill, size),
        }
        for name, values in made.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    # Rows of a stored table are numbered alike in every run of a task.
    dealt = pieces.withColumn("__group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in pieces.dtypes)
    return dealt.groupBy("__group").applyInArrow(run, f"{kinds}, sequence_id long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_bins: int = GROUP_BINS) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Every piece is placed once; the pieces of one sequence follow each other without a gap.
    No pieces give no rows.
    """
    pieces = stored(pieces, "pack_pieces")

    def groups_of(df: DataFrame) -> int:
        tokens = df.agg(F.sum("length")).first()[0] or 0
        return max(1, round(tokens / (capacity * group_bins)))

    groups = groups_of(pieces)
    first = stored(_pack_groups(pieces, groups, 0, capacity), "pack_first")
    done = F.col("fill") >= F.lit(int(FULL * capacity))
    rest = first.where(~done).drop("sequence_id", "offset", "fill")
    second = _pack_groups(rest, groups_of(rest), groups, capacity)
    return first.where(done).unionByName(second).drop("fill")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all documents."""
    return pack(cut_pieces(docs, tokenizer, capacity, end_id), capacity)
