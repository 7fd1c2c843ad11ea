"""Near-duplicate embeddings by collision-counting projections (operator 5).

Unit vectors are projected on many random directions. Within a group the members are sorted along every
direction; a query's window there is a run of ranks around its own value. A pair's collisions are the
directions whose window holds it; pairs with at least the calibrated count are verified in double
precision. The window and the count follow from the cosine alone: for a pair just at the threshold they
are passed with the probability ``RECALL`` or more, for closer pairs more often.

A label of more than ``CELL_SIZE`` vectors is dealt into cells several times over, each time by the signs
of other random projections. A pair meets in a deal with the probability that no sign tells it apart,
which follows from its angle; there are as many deals as it takes for all of them and the count together
to miss a threshold pair with the probability ``1 - RECALL`` at most. That number grows with the size
of the label far more slowly than the cells shrink: 10 deals for a hundred thousand vectors, 15 for two
million, 26 for two hundred million. A pair counts in its first common deal only. Cells of many members
are split into blocks that meet pair by pair, so a group's size is bounded whatever the data. Equal
vectors are one node with a multiplicity.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from mattelake.llm.common import materialise, spread
from mattelake.llm.components import connected_components, local_stars

COSINE = 0.98
DIRECTIONS = 24
#: Directions that are counted for all pairs of a group, before the rest is counted for those still in reach.
DENSE = 13
RECALL = 0.9999
#: Half-width of a window in standard deviations of a threshold pair's difference along a direction.
WINDOW = 2.5
#: Vectors of a cell, from which the number of signs follows, and of a block; both only deal out work.
CELL_SIZE = 1024


@lru_cache(maxsize=8)
def directions(dim: int, count: int = DIRECTIONS) -> np.ndarray:
    """(dim, count) random unit vectors, the same everywhere."""
    d = np.random.default_rng(1000 + dim).normal(size=(dim, count))
    return d / np.linalg.norm(d, axis=0)


def _calibrated(count: int, window: float, recall: float) -> tuple[int, float]:
    p = 2 * NormalDist().cdf(window) - 1
    tail, need = 0.0, count + 1
    while tail < recall and need > 0:
        need -= 1
        tail += math.comb(count, need) * p**need * (1 - p) ** (count - need)
    return need, tail


def calibrate(count: int = DIRECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """Largest number of collisions that a threshold pair reaches with probability ``recall``."""
    return _calibrated(count, window, recall)[0]


def deals(size: int, cosine: float = COSINE, cell_size: int = CELL_SIZE) -> tuple[int, int]:
    """(signs of a deal, deals) for a label of ``size`` vectors."""
    bits = max(0, math.ceil(math.log2(max(1.0, size / cell_size))))
    if not bits:
        return 0, 1
    together = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    if together >= 1:
        return bits, 1
    spare = _calibrated(DIRECTIONS, WINDOW, RECALL)[1] - RECALL
    return bits, math.ceil(math.log(spare) / math.log(1 - together))


@lru_cache(maxsize=8)
def planes(dim: int, bits: int, times: int) -> np.ndarray:
    """(dim, times * bits) normals of the planes whose sides deal, the same everywhere."""
    return np.random.default_rng([2000, dim, bits]).normal(size=(times * bits, dim)).T.copy()


def cell_codes(vectors: np.ndarray, bits: int, times: int) -> np.ndarray:
    """(vectors, deals): the cell of each vector in each deal."""
    if not bits:
        return np.zeros((len(vectors), 1), np.int32)
    side = (vectors @ planes(vectors.shape[1], bits, times) >= 0).reshape(len(vectors), times, bits)
    return (side @ (1 << np.arange(bits))).astype(np.int32)


def step(cosine: float, dim: int) -> float:
    """Standard deviation, along a random direction, of the difference of unit vectors at this cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine) / dim)


def verified(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float, chunk: int = 100_000) -> np.ndarray:
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), chunk):
        a, b = x[i[lo : lo + chunk]], y[j[lo : lo + chunk]]
        out[lo : lo + chunk] = np.einsum("nd,nd->n", a, b) / (np.sqrt(np.einsum("nd,nd->n", a, a)) * np.sqrt(np.einsum("nd,nd->n", b, b))) >= cosine
    return out


def colliding(queries: np.ndarray, members: np.ndarray, cosine: float = COSINE, block: int = 128, tile: int = 2048):
    """(query, member) positions of candidate pairs, block by block. Both are plain double vectors.

    Blocks and tiles keep the counts of a step within a core's cache.
    """
    dim, n = members.shape[1], len(members)
    need, half = calibrate(), WINDOW * step(cosine, dim) + 1e-12
    along_q = (queries @ directions(dim) / np.linalg.norm(queries, axis=1)[:, None]).T
    along_m = (members @ directions(dim) / np.linalg.norm(members, axis=1)[:, None]).T
    kind = np.uint16 if n < 1 << 16 else np.uint32
    rank = np.empty((DIRECTIONS, n), kind)
    first, width = np.empty((DIRECTIONS, len(queries), 1), kind), np.empty((DIRECTIONS, len(queries), 1), kind)
    for d in range(DIRECTIONS):
        order = np.argsort(along_m[d], kind="stable")
        rank[d, order] = np.arange(n)
        line = along_m[d, order]
        lo = np.searchsorted(line, along_q[d] - half, "left")
        first[d, :, 0], width[d, :, 0] = lo, np.searchsorted(line, along_q[d] + half, "right") - lo
    for lo in range(0, len(queries), block):
        size = min(block, len(queries) - lo)
        for at in range(0, n, tile):
            own = rank[:, None, at : at + tile]
            apart, inside = np.empty((size, own.shape[2]), kind), np.empty((size, own.shape[2]), bool)
            hits = np.zeros((size, own.shape[2]), np.uint8)
            for d in range(DENSE):
                # Ranks before the window wrap round to large numbers.
                np.subtract(own[d], first[d, lo : lo + size], out=apart)
                np.less(apart, width[d, lo : lo + size], out=inside)
                hits += inside.view(np.uint8)
            # Few pairs can still reach the count; only theirs is finished.
            i, j = np.nonzero(hits >= need - (DIRECTIONS - DENSE))
            total = hits[i, j]
            i, j = i + lo, j + at
            for d in range(DENSE, DIRECTIONS):
                total += ((rank[d, j] - first[d, i, 0]) < width[d, i, 0]).view(np.uint8)
            enough = total >= need
            yield i[enough], j[enough]


def _usable(vector: str, label: str):
    v = F.col(vector)
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(label).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & (square > 0)


def _dealt(nodes: DataFrame, cosine: float, cell_size: int) -> DataFrame:
    """nodes (rid, label, dim, mult, vec, n: vectors of the label) once for each deal: deal, cell and codes, the cells in all deals."""
    schema = nodes.drop("n").schema.add("codes", ArrayType(IntegerType())).add("deal", "integer").add("cell", "integer")

    def run(batches):
        for b in batches:
            sizes, dims = b.column("n").to_numpy(zero_copy_only=False), b.column("dim").to_numpy(zero_copy_only=False)
            part = b.drop_columns(["n"])
            # Batches hold few kinds of length and number of signs.
            ways = np.array([deals(int(n), cosine, cell_size) for n in sizes], np.int64).reshape(-1, 2)
            for dim, bits, times in np.unique(np.column_stack([dims, ways]), axis=0).tolist():
                at = np.flatnonzero((dims == dim) & (ways == (bits, times)).all(axis=1))
                own = part.take(pa.array(at))
                codes = cell_codes(np.array(own.column("vec").to_pylist(), np.float64).reshape(len(at), dim), bits, times)
                listed = pa.array(codes.tolist(), pa.list_(pa.int32()))
                for t in range(times):
                    yield pa.RecordBatch.from_arrays([*own.columns, listed, pa.array(np.full(len(at), t, np.int32)), pa.array(codes[:, t])], names=schema.names)

    return nodes.mapInArrow(run, schema)


def linked(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of a cell, or of two of its blocks, that no earlier deal has: counts by vector, and stars that connect them."""
    none = pd.DataFrame({"rid": np.empty(0, np.int64), "root": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
    deal, a, b, side = int(pdf["deal"].iloc[0]), int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0]), pdf["mine"].to_numpy()
    rows = np.flatnonzero(side == a), np.flatnonzero(side == b)
    if not len(rows[0]) or not len(rows[1]):
        return none
    x = np.stack(pdf["vec"].to_list()).astype(np.float64)
    rid, mult = pdf["rid"].to_numpy(), pdf["mult"].to_numpy()
    codes = np.array(pdf["codes"].to_list(), np.int32)[:, :deal]
    links = np.zeros(len(x), np.int64)
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for i, j in colliding(x[rows[0]], x[rows[1]], cosine):
        i, j = rows[0][i], rows[1][j]
        once = i < j if a == b else slice(None)
        i, j = i[once], j[once]
        good = verified(x, x, i, j, cosine)
        i, j = i[good], j[good]
        fresh = ~(codes[i] == codes[j]).any(axis=1)
        i, j = i[fresh], j[fresh]
        if len(i):
            links += np.bincount(i, mult[j], len(x)).astype(np.int64) + np.bincount(j, mult[i], len(x)).astype(np.int64)
            u, v = local_stars(np.concatenate([u, rid[i]]), np.concatenate([v, rid[j]]))
    some = links > 0
    counts = pd.DataFrame({"rid": rid[some], "root": rid[some], "links": links[some]})
    return pd.concat([counts, pd.DataFrame({"rid": u, "root": v, "links": np.zeros(len(u), np.int64)})], ignore_index=True)


def near_duplicates(table: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cell_size: int = CELL_SIZE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal non-null labels and equal lengths are compared. Vectors that are null, zero or
    hold null or non-finite components link with nothing. A null vec_id counts as a link of others but
    has no component (null) and is not kept. Repeated rows are vectors of their own. Other columns are
    ignored; no rows give no rows.
    """
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    able = spread(rows).where(_usable("vec", "label"))
    classes = able.groupBy("label", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("mult"))
    reps = materialise(classes.withColumn("dim", F.size("vec")).withColumn("rid", F.monotonically_increasing_id()))
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n"))
    nodes = reps.select("rid", "label", "dim", "mult", "vec").join(sizes, ["label", "dim"])
    dealt = materialise(_dealt(nodes, cosine, cell_size))
    keys = ["label", "dim", "deal", "cell"]
    blocks = dealt.groupBy(*keys).agg(F.ceil(F.count("*") / cell_size).cast("int").alias("blocks"))
    placed = dealt.join(blocks, keys).withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("a", F.least("mine", "other")).withColumn("b", F.greatest("mine", "other"))
    groups = met.select(*keys, "a", "b", "mine", "rid", "mult", "vec", "codes").groupBy(*keys, "a", "b")
    found = materialise(groups.applyInPandas(lambda pdf: linked(pdf, cosine), "rid long, root long, links long"))
    roots = connected_components(found.where("links = 0").select(F.col("rid").alias("u"), F.col("root").alias("v")))
    counts = found.where("links > 0").groupBy("rid").agg(F.sum("links").alias("links"))
    rooted = reps.select("rid", "first_id").join(materialise(roots), F.col("rid") == F.col("node"), "left").select("rid", "first_id", F.coalesce("root", "rid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(reps.join(rooted.join(least, "root").select("rid", "component_id"), "rid").join(counts, "rid", "left").select("label", "vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    together = able.join(named, ["label", "vec"]).select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = rows.where(~F.coalesce(_usable("vec", "label"), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return together.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {COSINE}
), r(vec_id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.w FROM r JOIN p ON p.u = r.seen),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.u = c.vec_id
"""
