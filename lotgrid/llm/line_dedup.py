"""Site-relative line deduplication.

A line is boilerplate of a site when the share of the site's pages that hold it is above a
ratio.  Lines are counted by hash, so page texts are never shuffled by line; the boilerplate
of one site is at most (mean lines per page) / ratio hashes, and pages meet that list in one
join.  Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.llm.common import fresh, stored

# Production parameters.
MAX_RATIO = 0.02
MIN_PAGES = 2  # a line of a single page is no repetition; beyond that the ratio alone decides
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """Hash of the trimmed line; null for a blank one."""
    trimmed = F.btrim(line, F.lit(" \t\r"))
    return F.when(trimmed != "", F.xxhash64(trimmed))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """``site, hot``: for every site that has any, the hashes of its boilerplate lines.

    A repeated line counts once for a page; a repeated row is a page of its own.
    """
    slim = pages.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("site"),
        F.array_compact(F.array_distinct(F.transform(_lines(F.coalesce(F.col(text), F.lit(""))), _key))).alias("keys"),
    )
    # The page total travels with the lines as one more, null, key: one pass over the texts.
    counted = (
        slim.select("site", F.explode_outer(F.concat(F.array(F.lit(None).cast("bigint")), "keys")).alias("key"))
        .groupBy("site", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= min_pages) | F.col("key").isNull())
    )
    counted = stored(counted, "line_counts")
    totals = counted.where("key IS NULL").select("site", F.col("n").alias("pages"))
    return (
        counted.where("key IS NOT NULL")
        .join(totals, "site")
        .where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
        .groupBy("site")
        .agg(F.collect_list("key").alias("hot"))
    )


def drop_site_lines(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    n_lines: str | None = None,
    n_dropped: str | None = None,
) -> DataFrame:
    """Remove from ``text`` the lines that more than ``max_ratio`` of the site's pages hold.

    All columns and rows stay; ``n_lines`` and ``n_dropped`` name optional count columns.
    A line is compared without blanks, tabs and carriage returns at its ends; blank lines
    are never boilerplate.  A line of fewer than ``min_pages`` pages is no repetition.  Rows without a host form one site.  A null text stays null with zero lines;
    a page of boilerplate alone becomes the empty text.
    """
    if pages.where(F.col(text).isNotNull()).isEmpty():
        hot = None
    else:
        hot = stored(boilerplate(pages, host, text, max_ratio, min_pages), "line_hot")
    site, salt, mine, cut = fresh("site"), fresh("salt"), fresh("hot"), fresh("cut")
    out = pages
    none = F.array().cast("array<bigint>")
    if hot is None:
        out = out.withColumn(mine, none)
    else:
        # A site with a third of all pages is met in SALTS parts unless Spark broadcasts the list.
        hot = hot.select(F.col("site").alias(site), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.col("hot").alias(mine))
        out = (
            out.withColumn(site, F.coalesce(F.col(host).cast("string"), F.lit("")))
            .withColumn(salt, F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int"))
            .join(hot, [site, salt], "left")
            .drop(site, salt)
            .withColumn(mine, F.coalesce(F.col(mine), none))
        )
    out = out.withColumn(
        cut,
        F.when(F.col(text).isNull(), None).otherwise(
            F.filter(_lines(F.col(text)), lambda line: ~F.coalesce(F.array_contains(F.col(mine), _key(line)), F.lit(False)))
        ),
    )
    before = F.coalesce(F.size(_lines(F.col(text))), F.lit(0))
    if n_dropped:
        out = out.withColumn(n_dropped, F.when(F.col(text).isNull(), 0).otherwise(before - F.size(cut)).cast("bigint"))
    if n_lines:
        out = out.withColumn(n_lines, F.when(F.col(text).isNull(), 0).otherwise(before).cast("bigint"))
    changed = F.when(F.size(mine) == 0, F.col(text)).otherwise(F.array_join(cut, "\n"))
    extra = [c for c in (n_lines, n_dropped) if c]
    kept = [changed.alias(c) if c == text else F.col(c) for c in pages.columns]
    return out.select(*kept, *extra)


SQL = f"""
WITH lines AS (
  SELECT rid, site, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM (
    SELECT rid, site, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (
      SELECT row_number() OVER () AS rid, coalesce(source, '') AS site, string_split(text, chr(10)) AS ls FROM documents))
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS site, text FROM documents
), hot AS (
  SELECT site, bare FROM (SELECT site, bare, count(DISTINCT rid) AS n FROM lines WHERE bare <> '' GROUP BY site, bare)
  JOIN (SELECT site, count(*) AS pages FROM docs GROUP BY site) USING (site)
  WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * pages
), kept AS (
  SELECT l.rid, count(*) AS n_lines, count(h.bare) AS n_dropped,
         string_agg(CASE WHEN h.bare IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS text
  FROM lines l LEFT JOIN hot h ON h.site = l.site AND h.bare = l.bare GROUP BY l.rid
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped
FROM docs d LEFT JOIN kept k USING (rid)
"""
