"""Jaccard join against all pairs, on copies, near copies and awkward rows."""

import random
import re

import pytest

from lotgrid.llm.components import components
from lotgrid.llm.jaccard_join import keep_one, similar_documents


def brute(rows):
    """Component of every row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for c, (doc, _) in zip(comp, rows, strict=True):
        least[c] = min((d for d in (least.get(c), doc) if d is not None), default=None)
    return [(doc, len(s), least[c] if s else doc) for (doc, _), s, c in zip(rows, sets, comp, strict=True)]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(25)]
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([4, 30, 60, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        texts.append(" ".join(base[: len(base) * 3 // 4] + shared))
        texts.append(" ".join(shared + base[:8]))
    texts += [texts[0]] * 5 + ["", None, " \n", "one", "ONE ", "one two", "x " * 3000]
    rng.shuffle(texts)
    return [(k * 3, t) for k, t in enumerate(texts)]


def as_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    got = similar_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")).collect()
    assert as_text(tuple(r) for r in got) == as_text(brute(rows))


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g"
    rows = [(None, text), (7, text), (7, text), (None, "only null here and more"), (7, "other words of the same id"), (None, None)]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert as_text(tuple(r) for r in got) == as_text([(None, 3, 7), (7, 3, 7), (7, 3, 7), (None, 1, None), (7, 2, 7), (None, 0, None)])


def test_keep_one(spark, tmp_path):
    text = "a b c d e f g"
    rows = [(4, text, "x"), (2, text, "y"), (2, text, "y"), (None, text, "z"), (1, "quite another text than that", None), (None, None, "n"), (5, "", "e")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, component_id string").write.parquet(path)
    docs = spark.read.parquet(path)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert as_text(tuple(r) for r in kept.collect()) == as_text([rows[1], rows[4], rows[5], rows[6]])


def test_empty(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chain_and_star(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 130)}


def test_sets_of_groups_move_once(spark, monkeypatch):
    """Sets know their group when they are made, so that none are shuffled to be told it."""
    from lotgrid.llm import jaccard_join

    plans, compared = {}, jaccard_join._compared

    def spy(*args):
        plans[args[-1]] = args[0]._jdf.queryExecution().optimizedPlan().toString() if len(args) == 2 else "Join"
        return compared(*args)

    monkeypatch.setattr(jaccard_join, "_compared", spy)
    words = [f"w{n}" for n in range(60)]
    rows = [(k, " ".join([*words[:k], "other", *words[k:]])) for k in range(5)]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    assert "Join" not in plans["join_blocks"]


def family(n):
    """Variants of one text; every fifth is changed so much that it stays outside the group of the others."""
    rng = random.Random(1)
    few, base = [f"e{k}" for k in range(12)], [f"w{k}" for k in range(150)]
    texts = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(150), 12 if k % 5 == 0 else 4):
            w[at] = rng.choice(few)
        texts.append(" ".join(w))
    return list(enumerate(texts))


def made(spark, generator, run):
    """The result of ``run`` and the number of rows that Spark's Generate nodes of this generator made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    tag = f"made-{random.random()}"
    spark.sparkContext.setJobDescription(tag)
    try:
        result = run()
    finally:
        spark.sparkContext.setJobDescription(None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    seen, rows = store.executionsList(), 0
    for e in (seen.apply(k) for k in range(seen.size())):
        if e.description() != tag:
            continue
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "Generate" and generator in node.desc():
                found = [node.metrics().apply(k) for k in range(node.metrics().size())]
                rows += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in found if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return result, rows


def test_members_of_a_large_group_are_not_exploded(spark):
    """A node that opens the blocks of a family meets them as a whole, not in one row a member."""
    rows = family(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, count = made(spark, "explode(m", lambda: similar_documents(docs).collect())
    assert as_text(tuple(r) for r in got) == as_text(brute(rows))
    assert count < 300


def test_link_into_a_block_of_a_large_group(spark, monkeypatch):
    """Nodes meet all members of the blocks that they open, however many blocks of nodes ask; links name components."""
    from lotgrid.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_SIZE", 2)
    tokens = {1: range(8), 2: range(20, 28), 11: range(7), 12: range(6), 13: range(5), 14: range(21, 28), 15: range(40, 48)}
    grp = {"comp": 1, "block": 0, "width": 1}
    kind = "struct<comp:long,block:long,width:int>"
    opened = spark.createDataFrame([(a, grp) for a in range(11, 16)], f"a long, grp {kind}")
    members = spark.createDataFrame([(n, grp) for n in (1, 2)], f"node long, grp {kind}")
    comps = spark.createDataFrame([(2, 0), (3, 0)], "node long, comp long")
    sets = spark.createDataFrame([(n, list(s)) for n, s in tokens.items()], "node long, tokens array<long>")
    met = jaccard_join._asked_blocks(opened, members, comps, sets)
    links = {(r.a, r.b) for r in components(met).select("node", "comp").toDF("a", "b").collect()}
    assert links == {(1, 1), (11, 1), (12, 1), (0, 0), (14, 0)}
