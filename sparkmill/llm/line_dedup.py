"""Cross-site boilerplate: lines that spread over many sites are removed, with DataFrame operations only.

A line is known by two hashes of its trimmed text. Per line two HyperLogLog sketches, of the sites
it stands on and of the distinct texts it stands in, merge by aggregation. A line whose
estimates both reach the threshold by a margin is boilerplate, one that misses it by a margin isn't; the few in
between get exact distinct counts. Counting texts as well as sites keeps a document that was merely copied to
many sites: its lines stand in one text.

One copy of each boilerplate line stays: its first, in the row with the smallest id (then smallest
text hash, then position). So nothing vanishes from the corpus altogether.

Defined results: lines are trimmed of blanks (U+0020) only, so a line of a tab or a carriage return is a line; blank lines are neither counted nor removed. A null text stays null, with 0
lines; a null site counts as a site of its own. Rows that repeat both id and text keep or lose the
same lines. A text whose lines all go becomes the empty text. Columns of any name pass through, but for n_lines and
n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import written

#: Distinct sites, and distinct texts, from which on a line is boilerplate.
LEAST_SITES = 10
#: Estimates within this share of the threshold are counted exactly.
MARGIN = 0.25
#: log2 of the sketches' number of cells.
SKETCH_K = 10


def line_key(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("h"), F.hash(trimmed).alias("g"))


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row a line that isn't blank: doc_id, digest (of the text), site, pos, h, g."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(site_col).isNull(), "none").otherwise(F.concat(F.lit("="), F.col(site_col))).alias("site"), F.xxhash64(text_col).alias("digest"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    return rows.where(F.trim("line") != "").select("doc_id", "digest", "site", "pos", key.getField("h").alias("h"), key.getField("g").alias("g"))


def boilerplate(lines: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """h, g, n_sites (exact near the threshold, else estimated) and first (id, digest, pos) of each boilerplate line."""
    sketched = lines.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_K))).alias("sites"), F.hll_sketch_estimate(F.hll_sketch_agg("digest", F.lit(SKETCH_K))).alias("texts"), F.min(F.struct("doc_id", "digest", "pos")).alias("first")
    )
    reach = F.least("sites", "texts")
    likely = sketched.where(reach >= least * (1 - MARGIN))
    sure, near = likely.where(reach > least * (1 + MARGIN)), likely.where(reach <= least * (1 + MARGIN))
    # exact counts: distinct pairs first, so that a frequent line's rows shrink before they meet
    of_near = lines.join(near.select("h", "g"), ["h", "g"], "left_semi")
    sites = of_near.select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count("*").alias("n_sites"))
    texts = of_near.select("h", "g", "digest").distinct().groupBy("h", "g").agg(F.count("*").alias("n_texts"))
    exact = near.select("h", "g", "first").join(sites, ["h", "g"]).join(texts, ["h", "g"]).where((F.col("n_sites") >= least) & (F.col("n_texts") >= least))
    return sure.select("h", "g", F.col("sites").alias("n_sites"), "first").union(exact.select("h", "g", "n_sites", "first"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least: int = LEAST_SITES) -> DataFrame:
    """docs with text_col cleaned, and n_lines and n_removed added.

    Only the places of removed lines move between tasks, besides one pass of the documents themselves.
    """
    lines = lines_of(docs, id_col, text_col, site_col)
    found = written(boilerplate(lines, least), "boilerplate")
    places = lines.join(found.select("h", "g", "first"), ["h", "g"])
    others = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("digest") != F.col("first.digest")) | (F.col("pos") != F.col("first.pos"))
    gone = places.where(others).groupBy(F.col("doc_id").alias("id"), "digest").agg(F.collect_set("pos").alias("gone"))
    # the documents' own columns stay together, whatever their names
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    joined = base.join(gone, ["id", "digest"], "left")
    own = F.col("row").getField(text_col)
    split = F.split(own, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone")), lambda at: F.get(split, at))
    text = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(kept, "\n"))
    columns = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.coalesce(F.size(F.filter(split, lambda line: F.trim(line) != "")), F.lit(0)).cast("long")
    n_lines = F.when(own.isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def oracle_sql(least: int = LEAST_SITES) -> str:
    return f"""
WITH l AS (
  SELECT doc_id, source, text, CAST(i - 1 AS INTEGER) AS pos, trim(x[i], ' ') AS line
  FROM (SELECT doc_id, coalesce(source, chr(0)) AS source, text, string_split(text, chr(10)) AS x FROM documents) AS d,
       unnest(range(1, len(x) + 1)) AS r(i)
),
b AS (
  SELECT line, min({{'d': doc_id, 'p': pos}}) AS f
  FROM l WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT source) >= {least} AND count(DISTINCT text) >= {least}
),
m AS (
  SELECT l.doc_id, l.pos, l.line, (b.line IS NOT NULL AND NOT (l.doc_id = b.f.d AND l.pos = b.f.p)) AS gone
  FROM l LEFT JOIN b ON l.line = b.line
),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         list(pos) FILTER (WHERE gone) AS places
  FROM m GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN coalesce(a.n_removed, 0) = 0 THEN d.text
            ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda v, i: NOT list_contains(a.places, CAST(i - 1 AS INTEGER))), chr(10)) END AS text,
       CAST(coalesce(a.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""
