"""Line dedup by site frequency, on planted lines and awkward rows."""

import corpus_pipeline
from lotgrid.llm.line_dedup import drop_site_lines

SCHEMA = "doc_id long, source string, text string, __hot int, site string, key string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, "s", "k") for r in rows], SCHEMA)
    out = drop_site_lines(df, max_ratio=0.5, min_pages=2, n_lines="n", n_dropped="d", **kw)
    assert out.columns == [*df.columns, "n", "d"]
    return sorted(((r.doc_id, r.text, r.n, r.d) for r in out.collect()), key=lambda t: (t[0] is None, t[0] or 0, t[1] or ""))


def test_lines_of_one_site_only(spark):
    rows = [(1, "a", "top\none"), (2, "a", " top\t\ntwo\ntwo"), (3, "a", "three"), (4, "b", "top\nfour"), (5, "b", "x"), (6, "b", "y")]
    assert run(spark, rows) == [(1, "one", 2, 1), (2, "two\ntwo", 3, 1), (3, "three", 1, 0), (4, "top\nfour", 2, 0), (5, "x", 1, 0), (6, "y", 1, 0)]


def test_nulls_repeats_blanks(spark):
    rows = [(None, None, "foot\n\nown"), (None, None, "foot\n\nown"), (1, None, None), (2, None, ""), (3, "", "foot")]
    got = run(spark, rows)
    # five pages without a host are one site: "foot" is on three of them, "own" on two
    assert got == [(1, None, 0, 0), (2, "", 1, 0), (3, "", 1, 1), (None, "\nown", 3, 1), (None, "\nown", 3, 1)]


def test_one_page_repeating_a_line_is_one_page(spark):
    assert run(spark, [(1, "a", "x\nx\nx"), (2, "a", "y"), (3, "a", "z")])[0] == (1, "x\nx\nx", 3, 0)


def test_empty_and_long(spark):
    assert run(spark, []) == []
    long = "\n".join(f"line {i}" for i in range(50_000))
    assert run(spark, [(1, "a", long + "\nfoot"), (2, "a", "foot")]) == [(1, long, 50_001, 1), (2, "", 1, 1)]


def test_pipeline_drops_footers_of_small_sites(spark):
    rows = [(i, f"s{n}", f"own {n} {i}\nfoot") for n in (1, 2, 3, 9) for i in range(n)]
    out = corpus_pipeline.dedup_lines(spark, spark.createDataFrame([(*r, 7, "s", "k") for r in rows], SCHEMA), "")
    assert {(r.source, r.text) for r in out.collect()} == {(s, t if s == "s1" else t.removesuffix("\nfoot")) for _, s, t in rows}
