"""Vector codes against a plain version, with ties, unusable vectors and huge components."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lotgrid.llm import vector_codes as vc


def plain(rows, parts, entries, rounds):
    kept = [(k, [int(np.floor(256 * x)) if abs(x) < 1e300 else int(x) * 256 for x in v], lab) for k, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        hits = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, h in zip(cut, hits) if h[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, per = [], {}
    for (k, _, lab), c in zip(kept, cut):
        near = [nearest(p, c[p]) for p in range(parts)]
        error = sum(d for d, _ in near)
        per[lab] = per.get(lab, 0) + error
        out.append([k, "".join(f"{e:02x}" for _, e in near), error, lab, sha])
    return sorted(([k, code, e if e < 1 << 63 else None, per[lab] if per[lab] < 1 << 63 else None, sha] for k, code, e, lab, sha in out), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vc.compress(df.repartition(3), **how)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256", "tried"]
    return sorted((list(r)[:5] for r in got.collect()), key=str), got


def test_same_as_plain_with_ties_and_unusable_vectors(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.choice([0.0, 0.25, -0.5, 1.0, rnd.random()]) for _ in range(12)], rnd.choice([1, 1, 1, 2, None])) for k in range(90)]
    rows += [(3, rows[7][1], 1), (None, rows[8][1], None), (90, rows[8][1], 2)]
    rows += [(91, None, 1), (92, [None] * 12, 1), (93, [float("nan")] * 12, 1), (94, [float("inf")] * 12, 2), (95, [], 1), (96, [1.0], 1)]
    got, _ = run(spark, rows, parts=4, entries=8, rounds=2)
    assert got == plain([r for r in rows if r[0] != 96], 4, 8, 2)


@pytest.mark.parametrize("big", [1e9, 1e200, 1e308])
def test_huge_components_stay_exact(spark, big):
    rows = [(k, [k * big / 64, -big / (k + 1), float(k), 0.5, 2.0**k], k % 2) for k in range(20)]
    got, _ = run(spark, rows, parts=2, entries=4, rounds=2)
    want = plain([(k, v + [0.0], lab) for k, v, lab in rows], 2, 4, 2)  # filled up to two equal parts
    assert [r[:4] for r in got] == [r[:4] for r in want]


def test_pruning_skips_entries_and_empty_table(spark):
    rnd = random.Random(9)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(8)], 0) for k in range(300)]
    got, df = run(spark, rows, parts=2, entries=64, rounds=1)
    assert got == plain(rows, 2, 64, 1)
    assert df.agg({"tried": "avg"}).first()[0] < 0.5 * 2 * 64
    assert run(spark, [])[0] == []
    assert run(spark, [(1, None, None)])[0] == []


def test_other_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], 1, "x", 3), (2, [1.5, 1.0], 1, "y", 4)], "vec_id long, embedding array<double>, label int, v string, code int")
    rows = vc.compress(df, parts=2, entries=2).orderBy("vec_id").collect()
    assert [r["code"] for r in rows] == ["0000", "0100"]
