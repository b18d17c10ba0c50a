"""License scan against a direct search, the automaton against all substrings."""

import random
import re

import pytest

from lotgrid.llm.license_scan import BASE_PHRASES, TEMPLATES, build, scan, scan_licenses, words


@pytest.mark.parametrize("seed", range(20))
def test_automaton(seed):
    rng = random.Random(seed)
    templates = [("x", " ".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))) for _ in range(4)]
    phrases = {" ".join(rng.choice("abc") for _ in range(rng.randint(1, 3))): "l" for _ in range(3)}
    a, sizes = build(templates, phrases)
    doc = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(80)]
    places, _ = scan(doc, a, sizes)
    wanted = [p.encode().split() for p in phrases]
    assert sorted(places) == sorted((k, j) for j, p in enumerate(wanted) for k in range(len(doc)) if doc[k : k + len(p)] == p)
    sequences = [[a.vocabulary[w] for w in words(t)] for _, t in templates]
    for j, s in enumerate(sequences):
        for i in range(len(s)):
            state = 0
            for w in s[i:]:
                state = a.steps[state][w]
            n = len(s) - i
            assert a.ends[state][j] == [e for e in range(n, len(s) + 1) if s[e - n : e] == s[i:]]


def test_spans():
    a, sizes = build()
    text = re.sub("without restriction, including", "with no", TEMPLATES[2][1])
    places, spans = scan(words("Prose before. " + text + " prose after."), a, sizes)
    assert not places and [TEMPLATES[t][0] for t, *_ in spans] == ["mit"] and spans[0][1] == 2 and spans[0][3] > 0.9
    assert scan(words(" ".join(w for w in text.split()[::-1])), a, sizes) == ([], [])


def test_repeated_passages_are_read_in_their_turn():
    a, sizes = build()
    k = next(k for k, (label, t) in enumerate(TEMPLATES) if label == "bsd" and t.startswith("Redistribution and use"))
    text = TEMPLATES[k][1].replace("reproduce", "show").replace("forms", "shapes", 1)
    _, spans = scan(words("x y " + text), a, sizes)
    (span,) = [s for s in spans if s[0] == k]
    assert span[1] == 2 and span[3] >= 1 - 2 * 4 / sizes[k]


@pytest.mark.parametrize("seed", range(12))
def test_spans_hold_what_direct_matching_covers(seed):
    """Coverage of a changed template beside a longest common subsequence of runs of four words and more."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)]
    template = [rng.choice(vocabulary) for _ in range(60)]
    doc = list(template)
    for at in rng.sample(range(60), 3):
        doc[at] = "other"
    a, sizes = build([("x", " ".join(template))], {"none such": "n"})
    _, spans = scan([b"pre"] + [w.encode() for w in doc] + [b"post"], a, sizes, min_coverage=0.3)
    runs = [len(r.split()) for r in " ".join(doc).split("other")]
    assert spans and spans[0][3] >= sum(r for r in runs if r >= 4) / 60 - 1e-9 and spans[0][3] <= 57 / 60 + 1e-9


def test_rows(spark):
    rows = [
        (1, "Under the MIT License; see the MIT\nlicense and Apache-License."),
        (1, "Under the MIT License; see the MIT\nlicense and Apache-License."),
        (None, "Licensed under CC BY-NC 4.0."),
        (2, None),
        (3, ""),
        (4, "mit licenses, général public license, İmit license"),
        (5, "word " * 50_000 + "GENERAL PUBLIC LICENSE"),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_words int")
    got = {(r.doc_id, r.n_words): (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in scan_licenses(df).collect()}
    assert got[(1, 11)] == (3, 2, 9, "apache,mit", "apache,mit", 1.0)
    assert got[(None, 7)] == (0, None, None, "", "cc-by-nc", 1.0)
    assert got[(2, 0)] == got[(3, 0)] == (0, None, None, "", "", 0.0)
    assert got[(4, 7)] == (0, None, None, "", "", 0.0)
    assert got[(5, 50_003)] == (1, 50_000, 50_000, "gpl", "gpl", 1.0)
    assert scan_licenses(df).count() == len(rows) and set(BASE_PHRASES.values()) == {"mit", "apache", "gpl"}
    assert scan_licenses(df.limit(0)).collect() == []
