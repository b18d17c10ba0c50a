"""Collocations: phrases that occur more often than their parts let expect.

Phrases of up to three words are counted in weighted acyclic automata (count transducers):
a path spells a phrase, its weight is the phrase's count, and states with the same arcs,
weights and continuations are one state.  Every task builds transducers from the sorted
n-grams of its shards of text, cut by prefix ranges; the transducers of one range are
united, equal paths summing their weights; the parts of every candidate are looked up by
composing them with the transducer of the range that owns them.

Texts, counts and candidates stay distributed.  What passes the driver are the limits of
the prefix ranges, one number for about ``RANGE_TOKENS`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.llm.common import byte_lengths, dropped, pack_integers, small_integers, stored, text_parts, unpack_integers
from lotgrid.llm.wordhash import mix, split_words

# Production parameters.
WORDS = 3
LEAST = 10  # occurrences of a candidate
TOP = 2000  # phrases per language
INSIDE = 50  # percent of a phrase's occurrences inside one longer phrase that make it drop out
UNKNOWN = "und"
SHARD_BYTES = 16 << 20  # text of a shard
RANGE_TOKENS = 1 << 20  # words for which there is one prefix range
MARK_EVERY = 256  # words for which one prefix is looked at to place the limits of ranges

_BREAKS, _GAPS = np.zeros(256, bool), np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS[[0x20, 9]] = True
_GAPS |= _BREAKS


# ---------------------------------------------------------------- text


@dataclass
class Pieces:
    """Words of some texts: hashes, whether each goes on in the piece of the one before, and where it stands."""

    hashes: np.ndarray
    goes_on: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def word(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.end[k]].tobytes().translate(_LOWER)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split_pieces(texts: list[str | None]) -> Pieces:
    w = split_words(texts, _GAPS)
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[w.data])])
    at = breaks[w.begin]
    goes_on = np.concatenate([[False], at[1:] == at[:-1]]) if len(at) else np.zeros(0, bool)
    return Pieces(w.hashes, goes_on, w.begin, w.end, w.data)


def prefix_code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Place of a phrase in the order of ranges: five bytes of its first word, then three of its second."""
    return ((first << np.uint64(24)) | second).astype("u8") >> np.uint64(1)


def _heads(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    five = np.array([int.from_bytes(w[:5].ljust(5, b"\0"), "big") for w in words], "u8")
    return five, five >> np.uint64(16)


# ---------------------------------------------------------------- transducers


def _share(offsets: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Unite equal segments of arcs: state of every segment, and the arcs of the states that stay."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    if not n:
        return np.zeros(0, "i8"), offsets, columns
    place = np.arange(len(columns[0])) - np.repeat(offsets[:-1], sizes)
    seed = 0
    while True:
        with np.errstate(over="ignore"):
            arc = mix(place.astype("u8") + np.uint64(seed))
            for c in columns:
                arc = mix(arc * np.uint64(0x9FB21C651E98DF25) + c.astype("u8"))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(arc, dtype="u8")])
            key = mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype("u8"))
        _, chosen, state = np.unique(key, return_index=True, return_inverse=True)
        # Equal keys must mean equal arcs; else other keys are drawn.
        source = np.repeat(offsets[chosen][state], sizes) + place
        same = np.array_equal(sizes[chosen][state], sizes) and all(np.array_equal(c[source], c) for c in columns)
        if same:
            break
        seed += 1
    new_sizes = sizes[chosen]
    ends = np.cumsum(new_sizes)
    keep = np.repeat(offsets[chosen] - (ends - new_sizes), new_sizes) + np.arange(ends[-1])
    return state, np.concatenate([[0], ends]), [c[keep] for c in columns]


@dataclass
class Phrases:
    """Sorted n-grams of one vocabulary: per length, word numbers and counts.

    ``two[0]`` and ``three[0]`` number the prefix in the table of the shorter phrases.
    """

    words: pa.Array
    one: np.ndarray  # word numbers, ascending
    f1: np.ndarray
    two: tuple[np.ndarray, np.ndarray]
    f2: np.ndarray
    three: tuple[np.ndarray, np.ndarray]
    f3: np.ndarray


@dataclass
class Transducer:
    """Three layers of arcs; the arcs of the start are layer 1.  ``target`` of an arc is a state of the next layer."""

    words: pa.Array
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # offsets of states, labels, weights, targets

    @staticmethod
    def build(p: Phrases) -> Transducer:
        """From sorted phrases, last layer first; equal states are one."""
        off3 = np.searchsorted(p.three[0], np.arange(len(p.f2) + 1))
        state2, off3, (label3, weight3) = _share(off3, [p.three[1], p.f3])
        off2 = np.searchsorted(p.two[0], np.arange(len(p.one) + 1))
        state1, off2, (label2, weight2, target2) = _share(off2, [p.two[1], p.f2, state2])
        none = np.zeros(len(label3), "i8")
        return Transducer(p.words, [(np.array([0, len(p.one)]), p.one, p.f1, state1), (off2, label2, weight2, target2), (off3, label3, weight3, none)])

    def unfold(self) -> Phrases:
        """All phrases in order."""
        (_, one, f1, state1), (off2, label2, weight2, target2), (off3, label3, weight3, _) = self.layers

        def follow(offsets: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = (offsets[1:] - offsets[:-1])[states] if len(states) else np.zeros(0, "i8")
            before = np.repeat(np.arange(len(states)), sizes)
            ends = np.cumsum(sizes)
            arcs = np.repeat(offsets[states] - (ends - sizes), sizes) + np.arange(len(before)) if len(states) else np.zeros(0, "i8")
            return before, arcs

        at2, arc2 = follow(off2, state1)
        at3, arc3 = follow(off3, target2[arc2])
        return Phrases(self.words, one, f1, (at2, label2[arc2]), weight2[arc2], (at3, label3[arc3]), weight3[arc3])

    def packed(self) -> dict:
        out = {"words": self.words}
        for k, (offsets, label, weight, target) in enumerate(self.layers, 1):
            for name, values in (("sizes", np.diff(offsets)), ("labels", label), ("weights", weight), ("targets", target)):
                out[f"{name}{k}"] = pack_integers(small_integers(values))
        return out

    @staticmethod
    def opened(row: dict) -> Transducer:
        layers = []
        for k in range(1, WORDS + 1):
            sizes, label, weight, target = (unpack_integers(row[f"{c}{k}"]).astype("i8") for c in ("sizes", "labels", "weights", "targets"))
            layers.append((np.concatenate([[0], np.cumsum(sizes)]).astype("i8"), label, weight, target))
        return Transducer(row["words"], layers)

    @staticmethod
    def union(parts: list[Transducer]) -> Phrases:
        """Phrases of all transducers; the weights of equal paths are added up."""
        coded = pa.chunked_array([t.words for t in parts], pa.binary()).combine_chunks()
        coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), "i8")
        rank[order] = np.arange(len(order))
        number = rank[coded.indices.to_numpy()]
        ends = np.cumsum([len(t.words) for t in parts])
        all_ = [t.unfold() for t in parts]
        own = [number[e - len(t.words) : e] for t, e in zip(parts, ends, strict=True)]
        one, at1, f1 = _added([w[p.one] for w, p in zip(own, all_, strict=True)], [p.f1 for p in all_])
        begin = np.cumsum([0] + [len(p.one) for p in all_])
        wide = np.int64(max(1, len(order)))
        codes = [at1[b + p.two[0]] * wide + w[p.two[1]] for b, w, p in zip(begin, own, all_, strict=False)]
        two, at2, f2 = _added(codes, [p.f2 for p in all_])
        begin = np.cumsum([0] + [len(p.f2) for p in all_])
        codes = [at2[b + p.three[0]] * wide + w[p.three[1]] for b, w, p in zip(begin, own, all_, strict=False)]
        three, _, f3 = _added(codes, [p.f3 for p in all_])
        return Phrases(coded.dictionary.take(pa.array(order)), one, f1, (two // wide, two % wide), f2, (three // wide, three % wide), f3)

    def compose(self, phrases: list[list[bytes]]) -> np.ndarray:
        """Weights of the given phrases; 0 for one that is no path."""
        out = np.zeros(len(phrases), "i8")
        spelled = [np.array([k for k, p in enumerate(phrases) if len(p) > n], "i8") for n in range(WORDS)]
        state = np.zeros(len(phrases), "i8")
        alive = np.ones(len(phrases), bool)
        for n, (offsets, label, weight, target) in enumerate(self.layers):
            rows = spelled[n][alive[spelled[n]]]
            if not len(rows) or not len(label):
                alive[spelled[n]] = False
                out[spelled[n]] = 0
                continue
            found = pc.index_in(pa.array([phrases[k][n] for k in rows.tolist()], pa.binary()), value_set=self.words)
            word = np.asarray(pc.fill_null(found, -1)).astype("i8")
            # Labels ascend inside a state, so (state, label) ascends over the layer.
            wide = np.int64(len(self.words) + 1)
            known = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * wide + label
            at = np.minimum(np.searchsorted(known, state[rows] * wide + word), len(known) - 1)
            hit = (word >= 0) & (known[at] == state[rows] * wide + word)
            out[rows] = np.where(hit, weight[at], 0)
            state[rows] = target[at]
            alive[rows] = hit
            dead = spelled[n][~alive[spelled[n]]]
            out[dead] = 0
        return out


def _added(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(kinds), "i8")
    np.add.at(total, number, np.concatenate(weights))
    return kinds.astype("i8"), number.astype("i8"), total


def count_phrases(hashes: np.ndarray, goes_on: np.ndarray, spelling: dict[int, bytes]) -> Phrases:
    """All phrases of up to three words of a shard, sorted."""
    kinds, number = np.unique(hashes, return_inverse=True)
    words = [spelling[h] for h in kinds.tolist()]
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(order), "i8")
    rank[order] = np.arange(len(order))
    w, wide = rank[number], np.int64(max(1, len(words)))
    f1 = np.bincount(w, minlength=len(words)).astype("i8")
    pair = np.flatnonzero(goes_on[1:])
    two, which, f2 = np.unique(w[pair] * wide + w[pair + 1], return_inverse=True, return_counts=True)
    at = np.full(len(w), -1, "i8")
    at[pair] = which
    triple = pair[np.flatnonzero(goes_on[np.minimum(pair + 2, len(w) - 1)] & (pair + 2 < len(w)))]
    three, f3 = np.unique(at[triple] * wide + w[triple + 2], return_counts=True)
    spelled = pa.array([words[k] for k in order], pa.binary())
    return Phrases(spelled, np.arange(len(words)), f1, (two // wide, two % wide), f2, (three // wide, three % wide), f3)


def cut(p: Phrases, limits: np.ndarray) -> Iterator[tuple[int, Phrases]]:
    """The phrases by prefix range; a first word stands in every range that has a phrase of it, its own count in one."""
    five, three = _heads(p.words.to_pylist())
    of1 = np.searchsorted(limits, prefix_code(five[p.one], np.uint64(0)), "right")
    first = p.one[p.two[0]]
    of2 = np.searchsorted(limits, prefix_code(five[first], three[p.two[1]]), "right")
    of3 = of2[p.three[0]]
    # Rows of each range, in order; a stable sort keeps phrases sorted.
    by2, by3 = np.argsort(of2, kind="stable"), np.argsort(of3, kind="stable")
    by1 = np.argsort(of1, kind="stable")
    for r in np.unique(np.concatenate([of1, of2])).tolist():
        own1, own2, own3 = (by[np.searchsorted(of[by], r) : np.searchsorted(of[by], r, "right")] for by, of in ((by1, of1), (by2, of2), (by3, of3)))
        one = np.union1d(own1, p.two[0][own2])
        f1 = np.where(of1[one] == r, p.f1[one], 0)
        used = np.unique(np.concatenate([p.one[one], p.two[1][own2], p.three[1][own3]]))
        new = lambda x, used=used: np.searchsorted(used, x)
        yield r, Phrases(
            p.words.take(pa.array(used)),
            new(p.one[one]),
            f1,
            (np.searchsorted(one, p.two[0][own2]), new(p.two[1][own2])),
            p.f2[own2],
            (np.searchsorted(own2, p.three[0][own3]), new(p.three[1][own3])),
            p.f3[own3],
        )


def pruned(p: Phrases, least: int) -> Phrases:
    """Only phrases of at least ``least`` occurrences, and the prefixes that spell them."""
    keep3 = p.f3 >= least
    keep2 = p.f2 >= least
    keep2[p.three[0][keep3]] = True
    keep1 = p.f1 >= least
    keep1[p.two[0][keep2]] = True
    to1, to2 = np.cumsum(keep1) - 1, np.cumsum(keep2) - 1
    used = np.unique(np.concatenate([p.one[keep1], p.two[1][keep2], p.three[1][keep3]]))
    new = lambda x: np.searchsorted(used, x)
    return Phrases(
        p.words.take(pa.array(used)),
        new(p.one[keep1]),
        p.f1[keep1],
        (to1[p.two[0][keep2]], new(p.two[1][keep2])),
        p.f2[keep2],
        (to2[p.three[0][keep3]], new(p.three[1][keep3])),
        p.f3[keep3],
    )


# ---------------------------------------------------------------- Spark

_PACKED = [f"{c}{k}" for k in range(1, WORDS + 1) for c in ("sizes", "labels", "weights", "targets")]
_ARROW = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("words", pa.list_(pa.binary())), *[(c, pa.binary()) for c in _PACKED]])
_SCHEMA = "lang string, part int, n long, words array<binary>, " + ", ".join(f"{c} binary" for c in _PACKED)


def _rows(made: list[tuple[str, int, int, Transducer]]) -> pa.RecordBatch:
    columns: dict[str, list] = {c: [] for c in _ARROW.names}
    spelled, ends = [], [0]
    for lang, part, n, t in made:
        row = {"lang": lang, "part": part, "n": n} | t.packed()
        spelled.append(row.pop("words"))
        ends.append(ends[-1] + len(spelled[-1]))
        for c, v in row.items():
            columns[c].append(v)
    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(spelled) if spelled else pa.array([], pa.binary()))
    return pa.RecordBatch.from_arrays([words if f.name == "words" else pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _transducers(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[dict, Transducer]]:
    for batch in [table] if isinstance(table, pa.RecordBatch) else table.to_batches():
        plain = batch.select([c for c in batch.schema.names if c != "words"]).to_pylist()
        lists = batch.column("words")
        for k, row in enumerate(plain):
            yield row, Transducer.opened(row | {"words": lists.slice(k, 1).flatten()})


def _limits(texts: DataFrame, range_tokens: int) -> dict[str, np.ndarray]:
    """Limits of the prefix ranges per language, from every ``MARK_EVERY``-th pair of words; they only share work out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            for start, count in text_parts(byte_lengths(batch.column("text")), batch.num_rows):
                of: dict[str, list[str]] = {}
                for name, text in zip(lang[start : start + count], batch.column("text").slice(start, count).to_pylist(), strict=True):
                    of.setdefault(name, []).append(text)
                for name, mine in of.items():
                    p = split_pieces(mine)
                    at = np.arange(len(p.hashes) % MARK_EVERY, len(p.hashes) - 1, MARK_EVERY)
                    five, _ = _heads([p.word(k) for k in at.tolist()])
                    _, three = _heads([p.word(k + 1) for k in at.tolist()])
                    code = prefix_code(five, three).astype("i8")
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code)], ["lang", "code"])

    marks = stored(texts.mapInArrow(run, "lang string, code long"), "phrase_marks")
    per = max(1, range_tokens // MARK_EVERY)
    # Only languages of more than one range come to the driver.
    sizes = {r["lang"]: r["count"] for r in marks.groupBy("lang").count().where(F.col("count") >= 2 * per).collect()}
    out = {}
    if sizes:
        most = max(sizes.values()) // per
        probs = [k / most for k in range(1, most)]
        wanted = marks.where(F.col("lang").isin(list(sizes))).groupBy("lang").agg(F.percentile_approx("code", probs, max(10_000, 10 * most)).alias("at"))
        for r in wanted.collect():
            at = np.array(r["at"], "u8")
            number = max(1, sizes[r["lang"]] // per)
            out[r["lang"]] = np.unique(at[np.arange(1, number) * len(at) // number])
    dropped(marks)
    return out


def count_shards(texts: DataFrame, limits: dict[str, np.ndarray]) -> DataFrame:
    """Transducers of every shard of ``texts(lang, text)``, one per language and prefix range."""
    none = np.zeros(0, "u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list, dict[int, bytes]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (hashes, goes_on, spelling) in held.items():
                if sum(map(len, hashes)):
                    phrases = count_phrases(np.concatenate(hashes), np.concatenate(goes_on), spelling)
                    made = []
                    for part, own in cut(phrases, limits.get(lang, none)):
                        made.append((lang, part, int(own.f1.sum()), Transducer.build(own)))
                        if len(made) == 16:
                            yield _rows(made)
                            made = []
                    if made:
                        yield _rows(made)
            held.clear()

        for batch in batches:
            lang = batch.column("lang").to_pylist()
            lengths = byte_lengths(batch.column("text"))
            for start, count in text_parts(lengths, batch.num_rows):
                of: dict[str, list[str]] = {}
                for name, text in zip(lang[start : start + count], batch.column("text").slice(start, count).to_pylist(), strict=True):
                    of.setdefault(name, []).append(text)
                for name, mine in of.items():
                    p = split_pieces(mine)
                    hashes, goes_on, spelling = held.setdefault(name, ([], [], {}))
                    hashes.append(p.hashes)
                    goes_on.append(p.goes_on)
                    kinds, first = np.unique(p.hashes, return_index=True)
                    for h, k in zip(kinds.tolist(), first.tolist(), strict=True):
                        if h not in spelling:
                            spelling[h] = p.word(k)
                size += sum(lengths[start : start + count])
                if size >= SHARD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.mapInArrow(run, _SCHEMA)


def unite(shards: DataFrame, least: int) -> DataFrame:
    """One transducer per language and range, without phrases of fewer than ``least`` occurrences; ``n`` counts all words."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(_transducers(table))
        lang, part, n = rows[0][0]["lang"], rows[0][0]["part"], sum(r["n"] for r, _ in rows)
        whole = Transducer.build(pruned(Transducer.union([t for _, t in rows]), least))
        return pa.Table.from_batches([_rows([(lang, part, n, whole)])])

    return shards.groupBy("lang", "part").applyInArrow(run, _SCHEMA)


def listed(united: DataFrame, least: int) -> DataFrame:
    """``lang, words, a``: the phrases of two and more words with at least ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in _transducers(batch):
                p = t.unfold()
                names = p.words.cast(pa.string()).to_pylist()
                first = p.one[p.two[0]]
                keep2, keep3 = np.flatnonzero(p.f2 >= least), np.flatnonzero(p.f3 >= least)
                two = [[names[a], names[b]] for a, b in zip(first[keep2].tolist(), p.two[1][keep2].tolist(), strict=True)]
                at = p.three[0][keep3]
                three = [[names[a], names[b], names[c]] for a, b, c in zip(first[at].tolist(), p.two[1][at].tolist(), p.three[1][keep3].tolist(), strict=True)]
                words, a = two + three, np.concatenate([p.f2[keep2], p.f3[keep3]])
                for k in range(0, len(words), 20_000):
                    own = words[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["lang"]] * len(own), pa.string()), pa.array(own, pa.list_(pa.string())), pa.array(a[k : k + 20_000], pa.int64())], ["lang", "words", "a"]
                    )

    return united.mapInArrow(run, "lang string, words array<string>, a long")


def part_counts(parts: DataFrame, united: DataFrame, limits: dict[str, np.ndarray]) -> DataFrame:
    """``lang, phrase, f`` of the distinct ``parts(lang, phrase)``, each composed with the transducer of its range."""
    none = np.zeros(0, "u8")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            spelled = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            five, _ = _heads([s[0] for s in spelled])
            _, three = _heads([s[1] if len(s) > 1 else b"" for s in spelled])
            code = prefix_code(five, three)
            part = np.zeros(len(lang), "i4")
            for name in set(lang):
                mine = np.array([x == name for x in lang])
                part[mine] = np.searchsorted(limits.get(name, none), code[mine], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    def look_up(asked: pa.Table, given: pa.Table) -> pa.Table:
        phrases = [p.encode().split(b" ") for p in asked["phrase"].to_pylist()]
        found = np.zeros(len(phrases), "i8")
        if phrases:
            for _, t in _transducers(given):
                found = t.compose(phrases)
        return pa.table({"lang": asked["lang"], "phrase": asked["phrase"], "f": pa.array(found, pa.int64())})

    placed = parts.select("lang", "phrase").mapInArrow(place, "lang string, phrase string, part int")
    return placed.groupBy("lang", "part").cogroup(united.groupBy("lang", "part")).applyInArrow(look_up, "lang string, phrase string, f long")


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(18,0)")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    *,
    least: int = LEAST,
    top: int = TOP,
    inside: int = INSIDE,
    range_tokens: int = RANGE_TOKENS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language.

    A null language is ``und`` and one with it, a null or empty text has no words, repeated
    rows count as often as they stand there, and texts are read whole.  Equal scores and
    counts are ordered by the phrase's bytes, so ranks are unique.  A language without a
    phrase of ``least`` occurrences has no rows; an empty table gives an empty one.  The
    score is exact for up to 10 ** 18 occurrences; products are decimals of 38 digits.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    limits = _limits(texts, range_tokens)
    united = stored(unite(count_shards(texts, limits), least), "phrases")
    total = united.groupBy("lang").agg(F.sum("n").alias("n"))
    found = stored(listed(united, least).withColumn("phrase", F.array_join("words", " ")), "candidates")
    size = F.size("words")
    # Every way to cut a candidate, with both parts.
    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("right")
    )
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase")).distinct()
    counts = stored(part_counts(parts, united, limits), "part_counts")
    scored = (
        cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .withColumn("score", F.call_function("div", _wide("a") * _wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), _wide("l") * _wide("r")))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    longer = found.where(size > 2).select(
        "lang", F.col("a").alias("f"), F.explode(F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))).alias("pair")
    )
    longer = longer.groupBy("lang", F.array_join("pair", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = (
        scored.join(longer, ["lang", "phrase"], "left")
        .where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
        .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of 64 shares of every language, then the best of those.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = kept.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.drop("share").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
        FROM documents)),
    spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS pos FROM pieces),
    grams AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(ws[pos:pos + size - 1], ' ') AS phrase, ws, pos
    FROM spots, (SELECT unnest([1, 2, 3]) AS size) WHERE pos + size - 1 <= len(ws))
  GROUP BY lang, size, phrase),
    totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
    cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size >= 2 AND f >= {LEAST}),
    cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
    scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.lp JOIN grams y ON y.lang = c.lang AND y.phrase = c.rp),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM cand WHERE size = 3) GROUP BY lang, phrase),
    kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE g.longer IS NULL OR 100 * g.longer < {INSIDE} * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
