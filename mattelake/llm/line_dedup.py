"""Cross-site boilerplate lines by the spread of their sites (operator 1), native expressions only.

Every non-blank line is hashed. One aggregation merges a HyperLogLog sketch of the sites for each hash.
Estimates clear of the threshold decide; lines within ``BAND`` of it are counted exactly. A line found
on enough sites stays in the document of the smallest id and is removed from all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattelake.llm.common import materialise, renamed, restored

#: Sites from which on a line is boilerplate.
MIN_SITES = 5
LG_K = 12
#: Relative half-width of the exact zone: over nine standard errors (1.04 / sqrt(2**12) = 1.6 %).
BAND = 0.15


def occurrences(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, site, pos, h) of every non-blank line."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(site).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return whole.where(F.trim(F.translate("line", "\t\r", "  ")) != "").select("doc_id", "text_hash", "site", "pos", F.xxhash64("line").alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """(h, first_id) of the lines on at least ``min_sites`` distinct sites; null sites count as none."""
    spread = lines.groupBy("h").agg(F.hll_sketch_agg(F.col("site").cast("string"), lg_k).alias("sketch"), F.min("doc_id").alias("first_id"))
    rated = spread.select("h", "first_id", F.hll_sketch_estimate("sketch").alias("sites"))
    wide = materialise(rated.where(F.col("sites") >= min_sites * (1 - band)))
    near = wide.where(F.col("sites") <= min_sites * (1 + band)).select("h", "first_id")
    pairs = lines.join(near, "h").groupBy("h", "first_id", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("h", "first_id").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return wide.where(F.col("sites") > min_sites * (1 + band)).select("h", "first_id").unionByName(exact.select("h", "first_id"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with boilerplate lines taken out of ``text``, plus n_lines and n_removed.

    All rows stay, a document of nothing but boilerplate with an empty text. Blank lines and the order
    of lines stay. A null text stays null with no lines; an empty text is one blank line. Rows that
    repeat id and text are treated alike; a null id is larger than every other, and lines that only
    rows without an id have stay. Other columns pass through, but n_lines and n_removed are replaced.
    """
    lines = materialise(occurrences(docs, text, site, doc_id))
    found = boilerplate(lines, min_sites)
    hits = lines.join(found, "h").where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    gone = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    safe, new = renamed(docs.drop("n_lines", "n_removed"))
    body = new[text]
    whole = safe.withColumn("key", F.xxhash64(body))
    joined = whole.join(gone, whole[new[doc_id]].eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_hash")), "left")
    split = joined.withColumn("lines", F.split(body, "\n")).withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    cut = split.withColumn("n_removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long")).withColumn(body, F.when(F.col("gone").isNull(), F.col(body)).otherwise(rest))
    return cut.select(*restored(new), "n_lines", "n_removed")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The pipeline stage: the columns of docs, with n_chars (where it is) of the text that stays."""
    safe, new = renamed(docs)
    needed = {"text", "source", "doc_id"} & new.keys()
    named = safe.withColumnsRenamed({new[c]: c for c in needed})
    out = remove_boilerplate(named).select(*[F.col(c if c in needed else n).alias(c) for c, n in new.items()])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


ORACLE = f"""
WITH o AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), b AS (
  SELECT line, min(doc_id) AS first_id FROM o
  WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), k AS (
  SELECT o.doc_id, o.pos, o.line, b.line IS NOT NULL AND o.doc_id <> b.first_id AS gone
  FROM o LEFT JOIN b ON o.line = b.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM k GROUP BY doc_id
"""
