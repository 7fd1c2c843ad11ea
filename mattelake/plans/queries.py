"""Registered queries of the engine's operators over the adapters, each with its SQL for DuckDB where there is one."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mattelake.config import EdgeRules, MaskRules, Settings, fingerprint
from mattelake.functions import rasters as R
from mattelake.functions import scalars as S
from mattelake.operators import boxes as B
from mattelake.operators import compose, decision, edges, ledger, qc, regions
from mattelake.plans import adapters as A

#: 64 pixels need coarser part and band thresholds.
SMALL = replace(MaskRules(), min_component_ratio=0.05, max_components=2)


def s01_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images among paths, their suffix, sort key and output name."""
    p = A.paths(spark, sf_dir).where(S.is_image(F.col("path"), Settings().extensions))
    return p.select("doc_id", "path", S.suffix(F.col("path")).alias("suffix"), F.lower("path").alias("sort_key"), S.png_name(F.col("path")).alias("filename"))


S01 = f"""WITH {A.PATHS_SQL}
SELECT doc_id, path, lower(regexp_extract(path, '\\.[^./]+$')) AS suffix, lower(path) AS sort_key,
  regexp_replace(path, '\\.[^./]+$', '') || '.png' AS filename
FROM pt WHERE lower(regexp_extract(path, '\\.[^./]+$')) IN ('.jpg', '.jpeg', '.png', '.webp')"""


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def a01_mask_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, ratios and band contacts of every mask."""
    m = qc.measure(A.rasters(spark, sf_dir), SMALL)
    names = [f"{k}_{s}" if k == "span" else f"edge_{s}_ratio" for s in qc.SIDES for k in ("span", "edge")]
    out = m.select("image_id", "foreground_area", "foreground_ratio", "translucent_ratio", *names, *[f"touch_{s}" for s in qc.SIDES])
    return _six(out, "foreground_ratio", "translucent_ratio", *names)


_MEASURES = """m AS (SELECT image_id, count(*) FILTER (WHERE a >= 24) AS foreground_area,
  count(*) FILTER (WHERE a >= 24) / 64.0::DOUBLE AS foreground_ratio,
  count(*) FILTER (WHERE a > 24 AND a < 224) / greatest(1, count(*) FILTER (WHERE a >= 24))::DOUBLE AS translucent_ratio,
  count(*) FILTER (WHERE a >= 24 AND y < 2) / 16.0::DOUBLE AS edge_top_ratio, count(DISTINCT CASE WHEN a >= 24 AND y < 2 THEN x END) / 8.0::DOUBLE AS span_top,
  count(*) FILTER (WHERE a >= 24 AND y >= 6) / 16.0::DOUBLE AS edge_bottom_ratio, count(DISTINCT CASE WHEN a >= 24 AND y >= 6 THEN x END) / 8.0::DOUBLE AS span_bottom,
  count(*) FILTER (WHERE a >= 24 AND x < 2) / 16.0::DOUBLE AS edge_left_ratio, count(DISTINCT CASE WHEN a >= 24 AND x < 2 THEN y END) / 8.0::DOUBLE AS span_left,
  count(*) FILTER (WHERE a >= 24 AND x >= 6) / 16.0::DOUBLE AS edge_right_ratio, count(DISTINCT CASE WHEN a >= 24 AND x >= 6 THEN y END) / 8.0::DOUBLE AS span_right
  FROM px GROUP BY image_id)"""
A01 = f"""WITH {A.PIXELS_SQL}, {_MEASURES}
SELECT image_id, CAST(foreground_area AS INTEGER) AS foreground_area, round(foreground_ratio, 6) AS foreground_ratio, round(translucent_ratio, 6) AS translucent_ratio,
  {", ".join(f"round(span_{s}, 6) AS span_{s}, round(edge_{s}_ratio, 6) AS edge_{s}_ratio, span_{s} >= 0.08 AS touch_{s}" for s in qc.SIDES)} FROM m"""


def a02_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: 8-connected parts of at least five per cent of the pixels."""
    return regions.regions(A.rasters(spark, sf_dir), min_ratio=SMALL.min_component_ratio).select("image_id", "components")


_PARTS = """walk(image_id, root, i) AS (
  SELECT image_id, i, i FROM px WHERE a >= 24
  UNION SELECT w.image_id, w.root, n.i FROM walk w JOIN px p ON p.image_id = w.image_id AND p.i = w.i
    JOIN px n ON n.image_id = p.image_id AND n.a >= 24 AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1),
lab AS (SELECT image_id, i, min(root) AS root FROM walk GROUP BY image_id, i),
parts AS (SELECT image_id, root, count(*) AS n FROM lab GROUP BY image_id, root),
comp AS (SELECT ids.image_id, CAST(count(parts.root) FILTER (WHERE n / 64.0::DOUBLE >= 0.05) AS INTEGER) AS components
  FROM (SELECT DISTINCT image_id FROM px) ids LEFT JOIN parts ON parts.image_id = ids.image_id GROUP BY ids.image_id)"""
A02 = f"WITH RECURSIVE {A.PIXELS_SQL}, {_PARTS} SELECT image_id, components FROM comp"


def a04_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: pixels enclosed by the solid mask, and the hole ratio along the contour."""
    return _six(regions.regions(A.rasters(spark, sf_dir)).select("image_id", "hole_pixels", "hole_ratio"), "hole_ratio")


_HOLES = """out(image_id, i) AS (
  SELECT image_id, i FROM px WHERE a < 224 AND (x IN (0, 7) OR y IN (0, 7))
  UNION SELECT o.image_id, n.i FROM out o JOIN px p ON p.image_id = o.image_id AND p.i = o.i
    JOIN px n ON n.image_id = p.image_id AND n.a < 224 AND abs(n.x - p.x) + abs(n.y - p.y) = 1),
gap AS (SELECT p.* FROM px p ANTI JOIN out o ON o.image_id = p.image_id AND o.i = p.i WHERE p.a < 224),
hw(image_id, root, i) AS (
  SELECT image_id, i, i FROM gap
  UNION SELECT w.image_id, w.root, n.i FROM hw w JOIN gap p ON p.image_id = w.image_id AND p.i = w.i
    JOIN gap n ON n.image_id = p.image_id AND abs(n.x - p.x) + abs(n.y - p.y) = 1),
hl AS (SELECT image_id, i, min(root) AS root FROM hw GROUP BY image_id, i),
beside AS (SELECT g.image_id, l.root, count(DISTINCT p.i) AS b FROM gap g JOIN hl l ON l.image_id = g.image_id AND l.i = g.i
  JOIN px p ON p.image_id = g.image_id AND p.a >= 224 AND abs(p.x - g.x) + abs(p.y - g.y) = 1 GROUP BY g.image_id, l.root),
area AS (SELECT l.image_id, sum(c.n + beside.b / 2.0::DOUBLE - 1) AS area, sum(c.n) AS n FROM beside
  JOIN (SELECT image_id, root, count(*) AS n FROM hl GROUP BY image_id, root) c USING (image_id, root)
  JOIN (SELECT DISTINCT image_id, root FROM hl) l USING (image_id, root) GROUP BY l.image_id)"""
A04 = f"""WITH RECURSIVE {A.PIXELS_SQL}, {_HOLES}, fg AS (SELECT image_id, count(*) FILTER (WHERE a >= 24) AS n FROM px GROUP BY image_id)
SELECT fg.image_id, CAST(coalesce(area.n, 0) AS INTEGER) AS hole_pixels, round(coalesce(area.area, 0) / greatest(1, fg.n), 6) AS hole_ratio
FROM fg LEFT JOIN area ON area.image_id = fg.image_id"""


def d01_qc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask rules of every image. The flagship query."""
    m = qc.judge(qc.measure(regions.regions(A.rasters(spark, sf_dir), min_ratio=SMALL.min_component_ratio), SMALL), SMALL)
    return m.select(
        "image_id", S.joined(F.col("hard_reasons")).alias("hard_reasons"), F.size("hard_details").alias("n_details"), S.joined(F.col("triggers")).alias("triggers"), "cropped_source_signal",
        F.when(F.size("hard_reasons") > 0, "REVIEW").otherwise("READY").alias("status"),
    )


D01 = f"""WITH RECURSIVE {A.PIXELS_SQL}, {_MEASURES}, {_PARTS}, {_HOLES}, j AS (
  SELECT m.*, components, coalesce(area.area, 0) / greatest(1, foreground_area) AS hole_ratio FROM m JOIN comp USING (image_id) LEFT JOIN area USING (image_id)),
k AS (SELECT *, CAST(foreground_ratio < 0.015 AS INTEGER) + CAST(foreground_ratio > 0.94 AS INTEGER) + CAST(components > 2 AS INTEGER) AS n_details FROM j)
SELECT image_id, CASE WHEN n_details > 0 THEN 'mask_issue' ELSE '' END AS hard_reasons, n_details,
  concat_ws(';', CASE WHEN hole_ratio > 0.08 THEN 'large_internal_holes' END, CASE WHEN translucent_ratio > 0.42 THEN 'high_translucency' END) AS triggers,
  (edge_top_ratio >= 0.0015 AND span_top >= 0.12) OR (edge_bottom_ratio >= 0.0015 AND span_bottom BETWEEN 0.08 AND 0.28)
  OR (edge_left_ratio >= 0.0015 AND span_left >= 0.18) OR (edge_right_ratio >= 0.0015 AND span_right >= 0.18) AS cropped_source_signal,
  CASE WHEN n_details > 0 THEN 'REVIEW' ELSE 'READY' END AS status FROM k"""


def j10_mask_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU and mean difference of each mask and the next one."""
    r = A.rasters(spark, sf_dir).select("image_id", F.col("alpha").alias("alpha_a"))
    other = r.select((F.col("image_id") - 1).alias("image_id"), F.col("alpha_a").alias("alpha_b"))
    return _six(qc.similarity(r.join(other, "image_id")).select("image_id", "iou", "difference"), "iou", "difference")


J10 = f"""WITH {A.PIXELS_SQL} SELECT p.image_id,
  round(count(*) FILTER (WHERE p.a >= 127 AND q.a >= 127) / greatest(1, count(*) FILTER (WHERE p.a >= 127 OR q.a >= 127))::DOUBLE, 6) AS iou,
  round(sum(abs(p.a - q.a)) / 64.0::DOUBLE / 255.0::DOUBLE, 6) AS difference
FROM px p JOIN px q ON q.image_id = p.image_id + 1 AND q.i = p.i GROUP BY p.image_id"""


def i07_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask's own samples over white, grey and black, by their sums."""
    r = A.rasters(spark, sf_dir)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    for name, canvas in (("white", 255), ("grey", 136), ("black", 0)):
        r = compose.over(r, "alpha", canvas, name)
    return r.select("image_id", *[total(F.col(n)).alias(n) for n in ("white", "grey", "black")])


I07 = f"""WITH {A.PIXELS_SQL} SELECT image_id,
  {", ".join(f"CAST(sum(CAST(round_even((a * a + {c} * (255 - a)) / 255.0::DOUBLE, 0) AS INTEGER)) AS BIGINT) AS {n}" for n, c in (("white", 255), ("grey", 136), ("black", 0)))} FROM px GROUP BY image_id"""


def w07_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sobel derivatives at every pixel, borders mirrored, by checksums over the image; and its transition pixels."""
    s = edges.stencils(A.rasters(spark, sf_dir))
    # Weights by position tell derivatives apart that only change places.
    weighed = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda t, v: t + v).cast("long")
    return s.select("image_id", weighed("gx").alias("gx"), weighed("gy").alias("gy"), F.col("transition").cast("long").alias("transition"))


_MIRRORED = """CASE WHEN p.{c} + {d} < 0 THEN -(p.{c} + {d}) WHEN p.{c} + {d} > 7 THEN 14 - (p.{c} + {d}) ELSE p.{c} + {d} END"""
_Y, _X = _MIRRORED.format(c="y", d="dy"), _MIRRORED.format(c="x", d="dx")


def _around(reach: int) -> str:
    return f"nb AS (SELECT p.image_id, p.i, p.a, dy, dx, {_Y} AS ny, {_X} AS nx FROM px p, (SELECT unnest(range(-{reach}, {reach + 1})) AS dy), (SELECT unnest(range(-{reach}, {reach + 1})) AS dx))"


W07 = f"""WITH {A.PIXELS_SQL}, {_around(1)}, g AS (SELECT n.image_id, n.i, any_value(n.a) AS a,
  sum(dx * (2 - abs(dy)) * q.a) AS gx, sum(dy * (2 - abs(dx)) * q.a) AS gy
  FROM nb n JOIN px q ON q.image_id = n.image_id AND q.y = ny AND q.x = nx GROUP BY n.image_id, n.i)
SELECT image_id, CAST(sum(gx * (i + 1)) AS BIGINT) AS gx, CAST(sum(gy * (i + 1)) AS BIGINT) AS gy,
  count(*) FILTER (WHERE a > 0.035 * 255 AND a < 0.965 * 255 AND sqrt((gx * gx + gy * gy)::DOUBLE) > 0.015 * 255) AS transition FROM g GROUP BY image_id"""


def w08_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard deviation in the 5 x 5 window of every pixel, borders mirrored; its largest and mean per image."""
    s = edges.stencils(A.rasters(spark, sf_dir))
    mean = F.aggregate("deviation", F.lit(0.0), lambda t, v: t + v) / F.size("deviation")
    return s.select("image_id", F.round(F.array_max("deviation"), 6).alias("most"), F.round(mean, 6).alias("mean"))


W08 = f"""WITH {A.PIXELS_SQL}, {_around(2)}, v AS (SELECT n.image_id, n.i, (sum(q.a * q.a) * 25 - sum(q.a) * sum(q.a))::DOUBLE AS v
  FROM nb n JOIN px q ON q.image_id = n.image_id AND q.y = ny AND q.x = nx GROUP BY n.image_id, n.i)
SELECT image_id, round(max(sqrt(greatest(0, v)) / 25), 6) AS most, round(avg(sqrt(greatest(0, v)) / 25), 6) AS mean FROM v GROUP BY image_id"""


def j05_box_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident people among five detections of every mask, cut to the frame, and their coverage."""
    k = F.col("image_id") % 3
    given = [(k - 1, F.lit(0), F.lit(6), F.lit(9), 0.9, 1), (F.lit(2), k, F.lit(8), F.lit(7), 0.56, 1), (F.lit(5), F.lit(5), k + 5, F.lit(8), 0.99, 1), (F.lit(0), F.lit(0), F.lit(8), F.lit(8), 0.54, 1), (F.lit(1), F.lit(1), F.lit(7), F.lit(7), 0.99, 2)]
    found = F.array(*[F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"), F.lit(p).alias("score"), F.lit(label).alias("label")) for x1, y1, x2, y2, p, label in given])
    m = B.measured(A.rasters(spark, sf_dir).withColumn("found", found), "found", "alpha")
    flat = m.select("image_id", "missing", "uncertain", F.posexplode("boxes").alias("box_idx", "b")).select("image_id", "box_idx", "b.x1", "b.x2", "b.coverage", "b.center_coverage", "missing", "uncertain")
    return _six(flat, "coverage", "center_coverage")


J05 = f"""WITH {A.PIXELS_SQL}, b0 AS (SELECT vec_id AS image_id, 0 AS n, vec_id % 3 - 1 AS x1, 0 AS y1, 6 AS x2, 9 AS y2, 0.9 AS score, 1 AS label FROM embeddings
  UNION ALL SELECT vec_id, 1, 2, vec_id % 3, 8, 7, 0.56, 1 FROM embeddings UNION ALL SELECT vec_id, 2, 5, 5, vec_id % 3 + 5, 8, 0.99, 1 FROM embeddings
  UNION ALL SELECT vec_id, 3, 0, 0, 8, 8, 0.54, 1 FROM embeddings UNION ALL SELECT vec_id, 4, 1, 1, 7, 7, 0.99, 2 FROM embeddings),
b1 AS (SELECT image_id, n, greatest(0, x1) AS x1, greatest(0, y1) AS y1, least(8, x2) AS x2, least(8, y2) AS y2 FROM b0 WHERE label = 1 AND score >= 0.55),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n) - 1 AS box_idx FROM b1 WHERE x2 > x1 AND y2 > y1),
c AS (SELECT b.image_id, b.box_idx, any_value(b.x1) AS x1, any_value(b.x2) AS x2, avg(CAST(a >= 24 AS INTEGER)) AS coverage,
  coalesce(avg(CAST(a >= 24 AS INTEGER)) FILTER (WHERE x >= x1 + CAST(floor((x2 - x1) * 0.22::DOUBLE) AS INTEGER) AND x < x2 - CAST(floor((x2 - x1) * 0.22::DOUBLE) AS INTEGER)
    AND y >= y1 + CAST(floor((y2 - y1) * 0.10::DOUBLE) AS INTEGER) AND y < y2 - CAST(floor((y2 - y1) * 0.10::DOUBLE) AS INTEGER)), 0) AS center_coverage
  FROM b JOIN px ON px.image_id = b.image_id AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY b.image_id, b.box_idx)
SELECT image_id, CAST(box_idx AS INTEGER) AS box_idx, CAST(x1 AS INTEGER) AS x1, CAST(x2 AS INTEGER) AS x2, round(coverage, 6) AS coverage, round(center_coverage, 6) AS center_coverage,
  CAST(count(*) FILTER (WHERE coverage < 0.18 OR center_coverage < 0.30) OVER w AS INTEGER) AS missing,
  CAST(count(*) FILTER (WHERE coverage >= 0.18 AND center_coverage >= 0.30 AND coverage < 0.18 * 1.35::DOUBLE) OVER w AS INTEGER) AS uncertain
FROM c WINDOW w AS (PARTITION BY image_id)"""


def j09_mask_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mask against the next one's halves as two people; every third right half is unsure."""
    r = A.rasters(spark, sf_dir)
    nxt = r.select((F.col("image_id") - 1).alias("image_id"), F.transform("alpha", lambda v: (v >= 127).cast("int")).alias("m"))
    half = lambda x1, x2: F.struct(F.lit(x1).alias("x1"), F.lit(0).alias("y1"), F.lit(x2).alias("x2"), F.lit(8).alias("y2"))
    score = F.when(F.col("image_id") % 3 == 0, 0.5).otherwise(0.9)
    both = r.join(nxt, "image_id").withColumns({"prompts": F.array(half(0, 4), half(4, 8)), "masks": F.array("m", "m"), "scores": F.array(F.lit(0.95), score)})
    v = B.confirmed(both, mask="alpha")
    return _six(v.select("image_id", F.col("checked_people").cast("long").alias("checked_people"), S.joined(F.col("reasons")).alias("reasons"), F.size("details").alias("n_details"), "min_recall", "min_iou"), "min_recall", "min_iou")


J09 = f"""WITH {A.PIXELS_SQL}, z AS (SELECT p.image_id, p.x // 4 AS box_idx, p.y, p.x, p.a >= 24 AS cand, q.a >= 127 AS ref
    FROM px p JOIN px q ON q.image_id = p.image_id + 1 AND q.i = p.i WHERE p.x < 4 OR p.image_id % 3 <> 0),
gap AS (SELECT DISTINCT a.image_id, a.box_idx, a.y, a.x FROM z a JOIN z b ON a.image_id = b.image_id AND a.box_idx = b.box_idx AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 AND NOT b.ref),
ec AS (SELECT z.*, gap.x IS NULL AS core FROM z LEFT JOIN gap ON gap.image_id = z.image_id AND gap.box_idx = z.box_idx AND gap.y = z.y AND gap.x = z.x),
f AS (SELECT *, CASE WHEN bool_or(core) OVER w THEN core ELSE ref END AS own, bool_or(ref) OVER w AS seen FROM ec WINDOW w AS (PARTITION BY image_id, box_idx)),
r AS (SELECT image_id, box_idx, count(*) FILTER (WHERE own) AS core, count(*) FILTER (WHERE own AND cand) AS hit, count(*) FILTER (WHERE own OR cand) AS either, count(*) AS inside FROM f WHERE seen GROUP BY image_id, box_idx),
s AS (SELECT *, hit / greatest(1, core)::DOUBLE AS recall, hit / greatest(1, either)::DOUBLE AS iou, (core - hit) / inside::DOUBLE AS mr FROM r),
t AS (SELECT i.image_id, count(s.image_id) AS checked_people, count(*) FILTER (WHERE recall < 0.82 AND mr >= 0.02) AS n, round(min(recall), 6) AS min_recall, round(min(iou), 6) AS min_iou
  FROM (SELECT DISTINCT image_id FROM z) i LEFT JOIN s ON s.image_id = i.image_id GROUP BY i.image_id)
SELECT image_id, checked_people, CASE WHEN n = 0 THEN '' ELSE 'missing_body_part;human_mask_disagreement;multiple_people_uncertain' END AS reasons, CAST(n AS INTEGER) AS n_details, min_recall, min_iou FROM t"""


def d03_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which boxes deserve the strong verifier, and why."""
    out = B.select_prompts(A.box_arrays(spark, sf_dir))
    flat = out.select("image_id", F.explode(F.arrays_zip("idx", "chosen")).alias("z"))
    return flat.select("image_id", F.col("z.idx").alias("box_idx"), "z.chosen.area", "z.chosen.covered", "z.chosen.branch", "z.chosen.keep")


_COVERED = """sz AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, max((x2 - x1) * (y2 - y1)) OVER (PARTITION BY image_id) AS top,
  coverage100 >= 45 OR center100 >= 55 AS supported FROM bx),
pc AS (SELECT a.image_id, a.box_idx, greatest(a.x1, b.x1) AS px1, least(a.x2, b.x2) AS px2, greatest(a.y1, b.y1) AS py1, least(a.y2, b.y2) AS py2
  FROM sz a JOIN sz b ON a.image_id = b.image_id AND a.box_idx <> b.box_idx AND b.supported AND b.x1 < a.x2 AND b.x2 > a.x1 AND b.y1 < a.y2 AND b.y2 > a.y1),
ed AS (SELECT DISTINCT image_id, box_idx, unnest([px1, px2]) AS x FROM pc),
sl AS (SELECT *, lead(x) OVER (PARTITION BY image_id, box_idx ORDER BY x) AS x_next FROM ed),
iv AS (SELECT sl.*, py1, py2, max(py2) OVER (PARTITION BY sl.image_id, sl.box_idx, x ORDER BY py1, py2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM sl JOIN pc ON pc.image_id = sl.image_id AND pc.box_idx = sl.box_idx AND px1 <= x AND px2 >= x_next WHERE x_next IS NOT NULL),
cv AS (SELECT image_id, box_idx, sum(greatest(0, py2 - greatest(py1, coalesce(reach, py1))) * (x_next - x)) AS covered FROM iv GROUP BY image_id, box_idx),
pr AS (SELECT sz.*, coalesce(covered, 0) AS covered, CASE WHEN score100 < 80 THEN 'low_score' WHEN supported THEN 'supported'
    WHEN coalesce(covered, 0) * 2 >= area AND coverage100 * 100 < 2475 THEN 'duplicate'
    WHEN area * 10 >= top * 3 AND coverage100 >= 9 AND center100 * 100 < 1485 THEN 'partial'
    WHEN area * 10 >= top * 4 THEN 'significant' ELSE 'small' END AS branch FROM sz LEFT JOIN cv USING (image_id, box_idx))"""
D03 = f"""WITH {A.BOXES_SQL}, {_COVERED} SELECT image_id, box_idx, CAST(area AS BIGINT) AS area, CAST(covered AS BIGINT) AS covered, branch, branch IN ('supported', 'partial', 'significant') AS keep FROM pr"""


def d04_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of the kept boxes of every image, in order."""
    out = B.select_prompts(A.box_arrays(spark, sf_dir))
    return out.select("image_id", "kept", "filtered", F.size("filter_details").alias("n_details"), S.joined(F.col("human_triggers")).alias("triggers"))


D04 = f"""WITH {A.BOXES_SQL}, {_COVERED}, k AS (SELECT *, branch IN ('supported', 'partial', 'significant') AS keep FROM pr),
g AS (SELECT image_id, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS filtered, min(coverage100) FILTER (WHERE keep) AS least,
  min(box_idx) FILTER (WHERE keep AND coverage100 < 45) AS b, min(box_idx) FILTER (WHERE keep AND center100 < 55) AS c FROM k GROUP BY image_id)
SELECT image_id, kept, filtered, CAST(filtered AS INTEGER) AS n_details, concat_ws(';',
  CASE WHEN c < b THEN 'person_center_coverage' END, CASE WHEN b IS NOT NULL THEN 'person_box_coverage' END, CASE WHEN c >= b OR (b IS NULL AND c IS NOT NULL) THEN 'person_center_coverage' END,
  CASE WHEN kept > 1 AND least < 60 THEN 'multiple_people_coverage' END) AS triggers FROM g"""


_SCORE_NAMES = ("residual", "chromatic", "neutral", "loose", "compact", "hair", "instability", "semantic", "agreement", "total")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten scores of every embedding, in hundredths, and an edge sample; some ids have scores around the bounds of hard findings."""
    e = A.table(spark, sf_dir, "embeddings")

    def hundredth(i: int, name: str):
        size = F.abs(F.col("embedding")[i].cast("double"))
        usual = F.least(F.lit(100), F.floor(size * 500).cast("int"))
        spread = name in ("chromatic", "loose", "semantic", "agreement")
        torn = name in ("compact", "instability")
        close = F.when((F.col("vec_id") % 4 == 0) & F.lit(spread), 55 + F.floor(size * 400).cast("int") % 45).when((F.col("vec_id") % 4 == 1) & F.lit(torn), 84 + F.floor(size * 400).cast("int") % 16)
        return F.coalesce(close, usual) / 100

    relevant = F.when(F.col("vec_id") % 3 == 0, F.lit(True)).when(F.col("vec_id") % 3 == 1, F.lit(False))
    return e.select("vec_id", *[hundredth(i, n).alias(n) for i, n in enumerate(_SCORE_NAMES)], (F.col("vec_id") % 97 + 40).cast("int").alias("edge_pixels"), relevant.alias("semantic_relevant"))


def d08_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, severity and signals of synthetic edge scores under the default rules."""
    s = decision.edge_severity(_scores(spark, sf_dir), EdgeRules())
    return s.select("vec_id", "severity", F.size("edge_hard_details").alias("n_details"), *[S.joined(F.col(c)).alias(c) for c in ("flags", "edge_hard", "edge_weak", "edge_telemetry")])


def _score_sql(i: int, name: str) -> str:
    size = f"abs(embedding[{i + 1}]::DOUBLE)"
    near = {"chromatic": (0, 55, 45), "loose": (0, 55, 45), "semantic": (0, 55, 45), "agreement": (0, 55, 45), "compact": (1, 84, 16), "instability": (1, 84, 16)}.get(name)
    usual = f"least(100, CAST(floor({size} * 500) AS INTEGER))"
    return f"CASE WHEN vec_id % 4 = {near[0]} THEN {near[1]} + CAST(floor({size} * 400) AS INTEGER) % {near[2]} ELSE {usual} END AS {name}" if near else f"{usual} AS {name}"


D08 = f"""WITH s AS (SELECT vec_id, {", ".join(_score_sql(i, n) for i, n in enumerate(_SCORE_NAMES))}, vec_id % 97 + 40 AS edge_pixels, CASE vec_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS rel FROM embeddings),
f AS (SELECT *, edge_pixels < 48 AS small, concat_ws(';', CASE WHEN loose >= 45 THEN 'loose_edge_noise' END, CASE WHEN instability >= 85 THEN 'local_alpha_instability' END,
    CASE WHEN residual >= 35 AND loose / 100.0::DOUBLE >= 0.45::DOUBLE * 0.8::DOUBLE THEN 'semantic_edge_anomaly' END) AS weak,
  concat_ws(';', CASE WHEN residual >= 35 THEN 'residual_background_color' END, CASE WHEN loose >= 45 THEN 'loose_edge_noise' END, CASE WHEN compact >= 85 THEN 'overcut_compact_structure' END,
    CASE WHEN hair >= 85 THEN 'weak_hair_edge' END, CASE WHEN instability >= 85 THEN 'local_alpha_instability' END, CASE WHEN residual >= 35 AND loose / 100.0::DOUBLE >= 0.45::DOUBLE * 0.8::DOUBLE THEN 'semantic_edge_anomaly' END) AS every FROM s),
v AS (SELECT *, CASE WHEN small THEN '' ELSE every END AS flags, CASE WHEN small THEN 'none'
    WHEN rel IS DISTINCT FROM false AND ((chromatic BETWEEN 65 AND 90 AND loose BETWEEN 60 AND 90 AND semantic BETWEEN 55 AND 85 AND agreement BETWEEN 45 AND 90) OR (compact >= 90 AND instability >= 90)) THEN 'hard'
    WHEN weak <> '' THEN 'weak' WHEN every <> '' OR total >= 15 THEN 'telemetry' ELSE 'none' END AS severity FROM f)
SELECT vec_id, severity, CAST(severity = 'hard' AS INTEGER) AS n_details, flags, CASE WHEN severity = 'hard' THEN 'edge_artifact' ELSE '' END AS edge_hard, CASE WHEN severity = 'weak' THEN weak ELSE '' END AS edge_weak,
  concat_ws(';', CASE WHEN small THEN 'artifact_edge_sample_too_small' END, CASE WHEN severity = 'telemetry' THEN 'artifact_signal_observed' END,
    CASE WHEN NOT small AND rel = false AND every <> '' THEN 'artifact_semantic_suppression' END) AS edge_telemetry FROM v"""


def d09_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of checks and verifier answers that the order keys spell out."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    on = lambda bit, name: S.flags((F.floor(k / bit) % 2 == 1, name))
    rows = o.withColumns(
        {
            "hard_reasons": S.flags((k % 7 == 0, "mask_issue")), "edge_hard": S.flags((k % 11 == 0, "edge_artifact")), "triggers": on(2, "high_translucency"), "human_triggers": on(4, "person_box_coverage"),
            "qc_telemetry": on(8, "cropped_source_signal"), "edge_telemetry": F.array().cast("array<string>"), "edge_weak": on(16, "loose_edge_noise"),
            "person_count": (k % 3).cast("int"), "kept": F.least(k % 3, F.lit(1)).cast("long"), "ran": k % 5 != 0, "checked_people": (F.floor(k / 32) % 3).cast("int"),
            "reasons": on(64, "missing_body_part"), "sam_error": F.when(k % 13 == 0, "broken"), "error": F.when(k % 17 == 0, "unreadable"),
        }
    )
    d = decision.escalate(rows)
    return d.select("o_orderkey", "requested", "sam_result", "status", S.joined(F.col("final_reasons")).alias("final_reasons"), S.joined(F.col("final_details"), "; ").alias("final_details"), S.joined(F.col("telemetry")).alias("telemetry"))


D09 = """WITH b AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS mi, o_orderkey % 11 = 0 AS eh, (o_orderkey // 2) % 2 = 1 AS tr, (o_orderkey // 4) % 2 = 1 AS ht, (o_orderkey // 8) % 2 = 1 AS cr, (o_orderkey // 16) % 2 = 1 AS wk,
  o_orderkey % 3 AS pc, least(o_orderkey % 3, 1) AS kept, o_orderkey % 5 <> 0 AS ran, (o_orderkey // 32) % 3 AS cp, (o_orderkey // 64) % 2 = 1 AS rs, o_orderkey % 13 = 0 AS se, o_orderkey % 17 = 0 AS er FROM orders),
r AS (SELECT *, NOT mi AND NOT eh AND pc > 0 AND kept > 0 AND (tr OR ht) AS requested FROM b),
s AS (SELECT *, CASE WHEN mi OR eh THEN 'hard_review' WHEN requested AND se THEN 'error' WHEN requested AND (NOT ran OR cp < kept) THEN 'incomplete' WHEN requested AND rs THEN 'disagreement'
  WHEN requested THEN 'confirmed' WHEN tr OR ht THEN 'unavailable' ELSE 'not_requested' END AS sam_result FROM r),
f AS (SELECT *, concat_ws(';', CASE WHEN mi THEN 'mask_issue' END, CASE WHEN eh THEN 'edge_artifact' END, CASE WHEN sam_result IN ('error', 'incomplete', 'unavailable') THEN 'low_confidence' END,
  CASE WHEN sam_result IN ('incomplete', 'disagreement') AND rs THEN 'missing_body_part' END) AS final_reasons,
  CASE sam_result WHEN 'error' THEN 'strong verifier failed on a suspicious result' WHEN 'unavailable' THEN 'strong verification could not be requested for a suspicious result'
    WHEN 'incomplete' THEN 'strong verification did not evaluate every requested person prompt (' || cp || '/' || kept || ')' ELSE '' END AS final_details FROM s)
SELECT k AS o_orderkey, requested, sam_result, CASE WHEN er THEN 'FAILED' WHEN final_reasons = '' THEN 'READY' ELSE 'REVIEW' END AS status, final_reasons, final_details,
  concat_ws(';', CASE WHEN cr THEN 'cropped_source_signal' END, CASE WHEN wk THEN 'artifact:loose_edge_noise' END, CASE WHEN pc = 0 THEN 'person_detector_zero' END) AS telemetry FROM f"""


def j01_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line, as sources not done yet."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_file"), "o_orderpriority")
    return ledger.pending(o, A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_file")))


J01 = "SELECT o_orderkey AS source_file, o_orderpriority FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey"


def j02_reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows that need no second run: failed, or with their output there."""
    l = A.ledger(spark, sf_dir).withColumn("output_file", F.concat(F.lit("out/"), "source_file"))  # noqa: E741
    there = l.where("seq % 4 <> 0").select(F.col("output_file").alias("path"))
    return ledger.reusable(l, there).select("source_file", "status")


J02 = f"WITH {A.LEDGER_SQL} SELECT source_file, status FROM lg WHERE status = 'FAILED' OR seq % 4 <> 0"


def j04_offline_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals with their cut-out (ready before review) and report row."""
    from mattelake.plans.batch import validate

    p = A.paths(spark, sf_dir)
    originals = p.where(S.is_image(F.col("path"), Settings().extensions)).select(F.col("doc_id").alias("source_file"), "path")
    ready = p.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("ready/"), "path").alias("cutout"), F.lit(0).alias("rank"))
    review = p.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("review/"), "path").alias("cutout"), F.lit(1).alias("rank"))
    cutouts = ready.unionByName(review).groupBy(F.col("doc_id").alias("source_file")).agg(F.min_by("cutout", "rank").alias("cutout"))
    report = p.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("source_file"), F.when(F.col("doc_id") % 7 == 0, "").otherwise((F.col("doc_id") % 4).cast("string")).alias("person_count"))
    return validate(originals, report, cutouts).select("source_file", "cutout", "person_count")


J04 = f"""WITH {A.PATHS_SQL} SELECT doc_id AS source_file, CASE WHEN doc_id % 3 = 0 THEN 'ready/' ELSE 'review/' END || path AS cutout,
  CAST(CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 0 ELSE doc_id % 4 END AS INTEGER) AS person_count
FROM pt WHERE lower(regexp_extract(path, '\\.[^./]+$')) IN ('.jpg', '.jpeg', '.png', '.webp') AND (doc_id % 3 = 0 OR doc_id % 2 = 0)"""


def w02_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each user, with the position of the first."""
    return ledger.last_rows(A.ledger(spark, sf_dir).withColumn("key", F.col("user_id").cast("string")), "key", "seq").select("key", "source_file", "status", "seq", "first_position")


W02 = f"WITH {A.LEDGER_SQL} SELECT user_id::VARCHAR AS key, arg_max(source_file, seq) AS source_file, arg_max(status, seq) AS status, max(seq) AS seq, min(seq) AS first_position FROM lg GROUP BY user_id"


def w01_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean time so far within each user's run."""
    # A mean times its rows is a sum again, which both engines give to the cent.
    rows = ledger.running_mean(A.ledger(spark, sf_dir), "user_id", "seq")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    return rows.select("seq", F.rint(F.col("mean_so_far") * n * 100).cast("long").alias("cents_so_far"))


W01 = f"WITH {A.LEDGER_SQL} SELECT seq, CAST(round_even(100 * sum(processing_time) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS cents_so_far FROM lg"


def a18_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of resumed and new rows together."""
    l = A.ledger(spark, sf_dir)  # noqa: E741
    return ledger.status_counts(ledger.merge(l.where("seq % 2 = 0"), l.where("seq % 2 = 1")))


A18 = f"WITH {A.LEDGER_SQL} SELECT status, count(*) AS n FROM lg GROUP BY status"


def a19_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run's summary."""
    return ledger.summary(A.ledger(spark, sf_dir))


A19 = f"""WITH {A.LEDGER_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'READY') AS ready, count(*) FILTER (WHERE status = 'REVIEW') AS review, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  round(sum(processing_time), 6) AS total_time, round(avg(processing_time), 6) AS average_time, round(median(processing_time), 6) AS median_time, round(quantile_cont(processing_time, 0.95), 6) AS p95_time,
  count(*) FILTER (WHERE lower(trim(sam_requested)) IN ('1', 'true', 'yes')) AS sam_requests, count(*) FILTER (WHERE lower(trim(sam_ran)) IN ('1', 'true', 'yes')) AS sam_runs,
  round(count(*) FILTER (WHERE lower(trim(sam_ran)) IN ('1', 'true', 'yes')) * 100.0::DOUBLE / count(*), 6) AS sam_percent, count(*) FILTER (WHERE sam_error <> '') AS sam_errors FROM lg"""


def o02_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of fifty files on a contact sheet of four columns; the sample is the feature."""
    names = A.paths(spark, sf_dir).withColumn("path", F.concat("path", F.lit("-"), F.col("doc_id").cast("string")))
    return ledger.contact_sheet(ledger.sample_files(names, 50), 4, "path", "pick").select("doc_id", "path", "position", "pick", "cell_x", "cell_y", "caption")


def _positions(n: int) -> str:
    return ", ".join(f"({n}, {p}, {k})" for k, p in enumerate(random.Random(42).sample(range(n), 50)))


#: The seeded sample's positions are fixed numbers for each number of files.
O02 = f"""WITH {A.PATHS_SQL}, fl AS (SELECT doc_id, path || '-' || doc_id AS path FROM pt),
od AS (SELECT *, row_number() OVER (ORDER BY lower(path), path) - 1 AS position, count(*) OVER () AS n FROM fl),
pk(n, position, pick) AS (VALUES {", ".join(_positions(n) for n in (200, 1000, 10000))})
SELECT doc_id, path, od.position, CAST(pick AS INTEGER) AS pick, CAST(pick % 4 AS INTEGER) AS cell_x, CAST(pick // 4 AS INTEGER) AS cell_y, substr(path, 1, 38) AS caption
FROM od JOIN pk ON pk.n = od.n AND pk.position = od.position"""


def o03_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred runs with their durations as text; the limit is the history's length."""
    h = A.ledger(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "seq", "processing_time")
    return ledger.newest(h).select("seq", F.replace("timestamp", F.lit("T"), F.lit("  ")).alias("shown"), S.duration_text(F.col("processing_time")).alias("duration"))


O03 = f"""WITH {A.LEDGER_SQL}, h AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, seq, processing_time FROM lg ORDER BY t DESC, seq DESC LIMIT 100)
SELECT seq, replace(t, 'T', '  ') AS shown, CAST(trunc(processing_time) AS INTEGER) // 60 || ' min ' || CAST(trunc(processing_time) AS INTEGER) % 60 || ' s' AS duration FROM h"""


def k05_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output files by status; names that collide are numbered."""
    from mattelake.sinks.reports import routed

    images = A.paths(spark, sf_dir).where(S.is_image(F.col("path"), Settings().extensions)).select(F.col("path").alias("source_file"), "doc_id")
    named = ledger.colliding_outputs(images)
    status = F.when(F.col("doc_id") % 5 == 0, "FAILED").when(F.col("doc_id") % 3 == 0, "REVIEW").otherwise("READY")
    return routed(named.withColumn("status", status), "/out/").select("doc_id", "filename", "output_file")


K05 = f"""WITH {A.PATHS_SQL}, n AS (SELECT doc_id, path, regexp_replace(path, '\\.[^./]+$', '') AS stem FROM pt WHERE lower(regexp_extract(path, '\\.[^./]+$')) IN ('.jpg', '.jpeg', '.png', '.webp')),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS nth FROM n)
SELECT doc_id, CASE WHEN nth = 1 THEN stem || '.png' ELSE stem || '~' || nth || '.png' END AS filename,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '/out/review/' || stem || '.png' ELSE '/out/ready/' || stem || '.png' END AS output_file FROM r"""


def p09_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run fingerprint beside its text's own hash, for every region."""
    own = fingerprint(Settings())
    return A.table(spark, sf_dir, "region").select("r_regionkey", F.lit(own).alias("fingerprint"), F.sha2(F.concat(F.lit(own), "r_name"), 256).alias("hashed"))


#: The defaults as canonical JSON, written out.
_CANONICAL = (
    '{"artifacts":{"analysis_max_size":512,"enabled":true,"hard_combined_max_score":0.85,"hard_combined_score":0.55,"hard_local_agreement_max_score":0.9,"h'
    'ard_local_agreement_score":0.45,"hard_loose_edge_max_score":0.9,"hard_loose_edge_score":0.6,"hard_residual_max_score":0.9,"hard_residual_score":0.65,"'
    'hard_structural_score":0.9,"local_signal_weak_score":0.85,"loose_edge_weak_score":0.45,"min_edge_pixels":48,"normal_search_radius":14,"residual_weak_s'
    'core":0.35},"foreground":{"enabled":true,"method":"pymatting_ml"},"model":{"fallback":"ZhengPeng7/BiRefNet_HR-matting","fallback_image_size":2048,"fal'
    'lback_revision":"5d6b6f8adcb5b417c871b1d84ceaae9871355b7f","image_size":1024,"precision":"fp16","primary":"ZhengPeng7/BiRefNet-portrait","primary_revi'
    'sion":"ecdeb6240ef23557dbd48ff27c59c1a88cbcb755"},"qc":{"cropped_bottom_span_ratio":0.28,"cropped_side_span_ratio":0.18,"cropped_top_span_ratio":0.12,'
    '"edge_band_ratio":0.018,"edge_min_area_ratio":0.0015,"edge_min_span_ratio":0.08,"foreground_threshold":24,"halo_clipped_ratio":0.1,"halo_correction_p9'
    '5":0.32,"max_components":5,"max_foreground_ratio":0.94,"max_hole_ratio":0.08,"max_translucent_ratio":0.42,"min_component_ratio":0.002,"min_foreground_'
    'ratio":0.015,"min_person_center_coverage":0.3,"min_person_mask_coverage":0.18,"person_confidence":0.55,"solid_threshold":224},"schema":4,"verification'
    '":{"enabled":true,"model":"ssdlite320_mobilenet_v3_large","run_on_all":true,"sam_alpha_threshold":24,"sam_boundary_tolerance_ratio":0.006,"sam_enabled'
    '":true,"sam_mask_confidence":0.8,"sam_min_missing_box_ratio":0.02,"sam_min_person_recall":0.82,"sam_model":"facebook/sam2.1-hiera-small","sam_prompt_c'
    'onfidence":0.8,"sam_prompt_min_relative_area":0.4,"sam_prompt_overlap_suppression":0.5,"sam_revision":"ee5bba1d82bb8749febdf90f45e84b687142ba03","sam_'
    'trigger_box_coverage":0.45,"sam_trigger_center_coverage":0.55,"sam_trigger_multiple_coverage":0.6}}'
)
P09 = f"WITH c AS (SELECT sha256('{_CANONICAL}') AS fingerprint) SELECT r_regionkey, fingerprint, sha256(fingerprint || r_name) AS hashed FROM region, c"


def p03_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 and the scalar functions: analysis sizes, half-even rounding, colour formulas, guards."""
    t = A.table(spark, sf_dir, "lineitem")
    w, h = (F.col("l_partkey") % 3000 + 1).cast("int"), (F.col("l_suppkey") * 37 % 3000 + 1).cast("int")
    r, g, b = (F.col("l_partkey") % 256), (F.col("l_suppkey") % 256), (F.col("l_orderkey") % 256)
    longest = F.greatest(w, h)
    return t.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.analysis_size(w, longest, 512).alias("small_w"), S.analysis_size(h, longest, 512).alias("small_h"),
        F.rint(F.col("l_quantity") / 2).cast("int").alias("half_even"), F.round(S.luma(r, g, b), 6).alias("luma"), F.round(S.saturation(r, g, b), 6).alias("saturation"),
        F.round(S.clip(F.col("l_quantity") / 40), 6).alias("clipped"), F.round(F.hypot(r.cast("double"), g.cast("double")), 6).alias("length"), F.round(S.share(F.col("l_linenumber"), F.col("l_linenumber") - 3), 6).alias("guarded"),
    )


P03 = """WITH t AS (SELECT *, l_partkey % 3000 + 1 AS w, l_suppkey * 37 % 3000 + 1 AS h, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem),
u AS (SELECT *, least(1.0::DOUBLE, 512.0::DOUBLE / greatest(w, h)) AS k, greatest(r, g, b) AS top, least(r, g, b) AS low FROM t)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(greatest(1, round_even(w * k, 0)) AS INTEGER) AS small_w, CAST(greatest(1, round_even(h * k, 0)) AS INTEGER) AS small_h,
  CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS half_even, round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 6) AS luma,
  round(CASE WHEN top > 0 THEN (top - low) / top::DOUBLE ELSE 0 END, 6) AS saturation, round(least(greatest(l_quantity / 40, 0), 1), 6) AS clipped,
  round(sqrt((r * r + g * g)::DOUBLE), 6) AS length, round(l_linenumber / greatest(l_linenumber - 3, 1)::DOUBLE, 6) AS guarded FROM u"""


def a22_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far decontamination moves each edge pixel of every mask, over three channels."""
    p = A.pixels(spark, sf_dir)
    a = F.col("a") / 255.0
    before = [((F.col("x") * 31 + F.col("y") * 17 + 40 * k) % 256) / 255.0 for k in range(3)]
    moved = [compose.decontaminate(c, F.lit(b / 255.0), a) for c, b in zip(before, (220, 130, 40))]
    return compose.correction_metrics(p.select("image_id", F.col("a").alias("alpha"), F.array(*before).alias("before"), F.array(*[m[0] for m in moved]).alias("after"), F.array(*[m[1] for m in moved]).alias("estimate")))


A22 = f"""WITH {A.PIXELS_SQL}, c AS (SELECT image_id, i, a / 255.0::DOUBLE AS k, ((x * 31 + y * 17 + 40 * ch) % 256) / 255.0::DOUBLE AS c, CASE ch WHEN 0 THEN 220 WHEN 1 THEN 130 ELSE 40 END / 255.0::DOUBLE AS b
    FROM px, (SELECT unnest(range(3)) AS ch) WHERE a BETWEEN 8 AND 247),
es AS (SELECT *, (c - (1 - k) * b) / greatest(k, 0.12::DOUBLE) AS est, 0.85::DOUBLE * (1 - k) * least(greatest(k / 0.12::DOUBLE, 0), 1) AS mix FROM c),
m AS (SELECT image_id, i, sqrt(sum(power(c * (1 - mix) + least(greatest(est, 0), 1) * mix - c, 2))) / sqrt(3.0::DOUBLE) AS moved, max(CAST(est < 0 OR est > 1 AS INTEGER)) AS clipped FROM es GROUP BY image_id, i)
SELECT image_id, count(*) AS edge_pixels, round(avg(moved), 6) AS mean_correction, round(quantile_cont(moved, 0.95), 6) AS p95_correction, round(avg(clipped), 6) AS clipped_ratio FROM m GROUP BY image_id"""


def j07_edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge scores of an analytic cut-out for every nation."""
    images = A.leaves(A.table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    out = edges.artifact_scores(images)
    return out.select("n_nationkey", "edge_pixels", "score_error", *[F.round(F.col(c), 4).alias(c) for c in ("residual", "chromatic", "neutral", "loose", "compact", "hair", "instability", "semantic", "agreement", "total")])


def a23_edge_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline ratios of the analytic cut-outs."""
    out = edges.artifact_diagnostics(A.leaves(A.table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey"))
    return out.select("n_nationkey", *[F.round(F.col(c), 4).alias(c) for c in edges.DIAGNOSTICS])


QUERIES = {
    f.__name__: f
    for f in (
        d01_qc_status, s01_discover, a01_mask_measures, a02_components, a04_holes, j10_mask_similarity, i07_composites, w07_gradients, w08_texture, j05_box_coverage, j09_mask_recall,
        d03_prompts, d04_triggers, d08_severity, d09_escalation, j01_resume, j02_reusable, j04_offline_validation, w02_last_rows, w01_running_mean, a18_status_counts, a19_summary,
        o02_sample, o03_history, k05_routes, p09_fingerprint, p03_scalars, a22_corrections, j07_edge_scores, a23_edge_diagnostics,
    )
}

ORACLES = {
    "d01_qc_status": D01, "s01_discover": S01, "a01_mask_measures": A01, "a02_components": A02, "a04_holes": A04, "j10_mask_similarity": J10, "i07_composites": I07, "w07_gradients": W07, "w08_texture": W08,
    "j05_box_coverage": J05, "j09_mask_recall": J09, "d03_prompts": D03, "d04_triggers": D04, "d08_severity": D08, "d09_escalation": D09, "j01_resume": J01, "j02_reusable": J02, "j04_offline_validation": J04,
    "w02_last_rows": W02, "w01_running_mean": W01, "a18_status_counts": A18, "a19_summary": A19, "o02_sample": O02, "o03_history": O03, "k05_routes": K05, "p09_fingerprint": P09, "p03_scalars": P03, "a22_corrections": A22,
}
