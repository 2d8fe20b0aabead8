"""Line de-duplication by site-relative frequency.

A line is boilerplate on a host when the share of the host's pages that contain it exceeds a ratio. Pages with the
same text count once, on both sides of the division: a copied page is a matter for document de-duplication, and must not
make its own lines look like boilerplate. A line of one page is not repeated; from two pages on the ratio alone decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import documents, stored

#: Share of a host's pages above which a line is boilerplate, and pages that make a line repeated at all.
RATIO, REPEATED = 0.1, 2
_BLANK = " \t\r"


def _trimmed(line):
    return F.btrim(line, F.lit(_BLANK))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = REPEATED) -> DataFrame:
    """host_key, dropped: the 64-bit numbers of a host's boilerplate lines.

    The list of one host is short by arithmetic: the pages of all lines add up to the lines of its pages, so at most
    (mean lines of a page) / ratio lines can exceed the ratio.
    """
    pages = docs.where(F.col(text).isNotNull()).select(_key(host), F.xxhash64(text).alias("page"), F.col(text).alias("text"))
    total = pages.select("host_key", "page").distinct().groupBy("host_key").agg(F.count(F.lit(1)).alias("total"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: _trimmed(x) != ""), lambda x: F.xxhash64(_trimmed(x))))
    counted = (
        pages.select("host_key", "page", F.explode(lines).alias("line")).distinct()
        .groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return (
        counted.join(total, "host_key").where(F.col("pages") > F.col("total") * ratio)
        .groupBy("host_key").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    )


def _key(host: str):
    """Rows without a host form a site of their own, apart from the host ''."""
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")).alias("host_key")


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = REPEATED) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the columns n_lines and n_dropped.

    A null text stays null with 0 lines; blank lines are never boilerplate and stay; an empty text has one line. Every
    row stays, also where nothing of its text is left. All other columns pass through. An empty table gives no rows.
    The list of lines is stored first, so Spark broadcasts it when it is small and shuffles by host when it isn't.
    """
    names = docs.columns
    found = stored(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], _key(host))
    at = f"in_{names.index(text)}"
    keep = F.filter(F.split(at, "\n"), lambda x: ~F.coalesce(F.array_contains("dropped", F.xxhash64(_trimmed(x))), F.lit(False)))
    out = inner.join(found, "host_key", "left").withColumn("kept_lines", keep)
    n = F.coalesce(F.size(F.split(at, "\n")), F.lit(0))
    return out.select(
        *[(F.array_join("kept_lines", "\n") if c == text else F.col(f"in_{i}")).alias(c) for i, c in enumerate(names)],
        F.when(F.col(at).isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col(at).isNull(), 0).otherwise(n - F.size("kept_lines")).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with their source as the host."""
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "source", "text", "n_lines", "n_dropped")


SQL = f"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
total AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
lines AS (SELECT DISTINCT source, text, trim(l, chr(32) || chr(9) || chr(13)) AS line
          FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS l FROM pages)),
counted AS (SELECT source, line, count(*) AS k FROM lines WHERE line <> '' GROUP BY source, line),
boiler AS (SELECT c.source, list(c.line) AS ls FROM counted c JOIN total t ON c.source IS NOT DISTINCT FROM t.source
           WHERE k >= {REPEATED} AND k > {RATIO}::DOUBLE * n GROUP BY c.source),
kept AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS a,
         list_filter(string_split(d.text, chr(10)), lambda l: NOT list_contains(coalesce(b.ls, []), trim(l, chr(32) || chr(9) || chr(13)))) AS k
         FROM documents d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN a IS NOT NULL THEN array_to_string(k, chr(10)) END AS text,
       coalesce(len(a), 0) AS n_lines, coalesce(len(a) - len(k), 0) AS n_dropped FROM kept
"""
