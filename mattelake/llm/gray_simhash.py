"""SimHash near-duplicates over a hierarchical index of Gray-ordered fingerprints (operator 6).

Fingerprints are sorted by their rank in the reflected Gray sequence, so neighbours share bits. A node
above a run of neighbours keeps the bits on which all of them agree (a mask and a pattern). A search
adds up, level by level, the differing bits among those newly fixed and leaves a whole group as soon as
the sum passes the radius; at the leaves the sum is the Hamming distance, so the result is exact.

Over a cluster the same index has two parts. Its upper part stands over groups of the Gray order, cut
at prefixes that follow the quantiles of all distinct fingerprints; it tells for each fingerprint which groups can hold partners.
Its lower part is built within each group. Equal fingerprints are one node, so copies are no work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattelake.llm import near_copies
from mattelake.llm.common import materialise, spread
from mattelake.llm.components import connected_components, local_stars

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Distinct fingerprints of a group, and the fewest groups; both only deal out work.
GROUP_SIZE = 16_384
LEAST_GROUPS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
SIGN = np.uint64(1 << 63)


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the n-word shingles; 0 without words, the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), len(words) - n + 1
    for lo in range(0, count, 1 << 16):
        hi = min(count, lo + (1 << 16))
        h = np.array([digest(line[s : e - 1], SEED) for s, e in zip(starts[lo:hi], ends[lo + n - 1 : hi + n - 1])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


class GrayIndex:
    """Levels of (mask, pattern) nodes over leaves in Gray order; ``fan`` children below each node."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None, fan: int = 4):
        masks = np.full(len(patterns), FULL) if masks is None else masks
        self.fan, self.levels = fan, [(masks, patterns & masks)]
        while len(self.levels[-1][0]) > 1:
            m, p = self.levels[-1]
            at = np.arange(0, len(m), fan)
            same = np.bitwise_and.reduceat(m, at) & ~(np.bitwise_or.reduceat(p, at) ^ np.bitwise_and.reduceat(p, at))
            self.levels.append((same, p[at] & same))
        self.fresh = []
        for k, (m, _) in enumerate(self.levels):
            above = self.levels[k + 1][0][np.arange(len(m)) // fan] if k + 1 < len(self.levels) else np.uint64(0)
            self.fresh.append(m & ~above)

    def search(self, queries: np.ndarray, radius: int = RADIUS, block: int = 2048, planes: tuple[np.ndarray, ...] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query position, leaf position) of all leaves whose bound is within the radius, block by block.

        A differing bit counts 1, or with ``planes`` its weight for that query, whose binary digits they are.
        """
        if not len(self.levels[0][0]):
            return
        for lo in range(0, len(queries), block):
            words = queries[lo : lo + block]
            q, node = np.arange(len(words)), np.zeros(len(words), np.int64)
            gone = np.zeros(len(words), np.uint8 if planes is None else np.uint16)
            digits = [p[lo : lo + block] for p in planes or ()]
            for k in range(len(self.levels) - 1, -1, -1):
                if k < len(self.levels) - 1:
                    q, gone = np.repeat(q, self.fan), np.repeat(gone, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    there = node < len(self.levels[k][0])
                    q, node, gone = q[there], node[there], gone[there]
                differ = (words[q] ^ self.levels[k][1][node]) & self.fresh[k][node]
                if planes is None:
                    gone = gone + np.bitwise_count(differ)
                for b, digit in enumerate(digits):
                    gone = gone + (np.bitwise_count(differ & digit[q]).astype(np.uint16) << np.uint16(b))
                near = gone <= radius
                q, node, gone = q[near], node[near], gone[near]
            yield q + lo, node


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long."""
    wanted = docs.select(*keep, F.col(text).alias("text"))
    schema = wanted.drop("text").schema.add("fp", "long")

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    return wanted.mapInArrow(run, schema)


#: Quantiles for each group, from which the prefixes are cut.
QUANTILES = 4


def _bounds(distinct: DataFrame, groups: int) -> np.ndarray:
    """Upper Gray ranks (as unsigned) of groups that are whole prefixes of the rank, split where fingerprints are dense.

    All members of such a group agree in the bits of its prefix, so few other groups are within reach.
    """
    cut = [k / (QUANTILES * groups) for k in range(1, QUANTILES * groups)]
    got = distinct.agg(F.percentile_approx("rank", cut, 20 * QUANTILES * groups)).first()[0] or []
    points = np.sort(np.array(got, np.int64).view(np.uint64) ^ SIGN)
    ends, todo = [], [(0, 0, 0, len(points))]
    while todo:
        prefix, depth, lo, hi = todo.pop()
        if hi - lo < 2 * QUANTILES or depth == 48:
            ends.append(((prefix + 1) << (64 - depth)) - 1)
            continue
        middle = ((2 * prefix + 1) << (63 - depth)) - 1
        at = int(np.searchsorted(points, np.uint64(middle), side="right"))
        todo += [(2 * prefix, depth + 1, lo, at), (2 * prefix + 1, depth + 1, at, hi)]
    return np.array(sorted(ends)[:-1], np.uint64)


def _group_nodes(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits that all Gray codes of a group's rank range share."""
    low = np.concatenate([np.zeros(1, np.uint64), bounds + np.uint64(1)])
    high = np.concatenate([bounds, np.array([FULL])])
    differ = low ^ high
    for s in (1, 2, 4, 8, 16, 32):
        differ |= differ >> np.uint64(s)
    # Ranks equal in their leading bits have Gray codes equal in these bits.
    return ~differ, gray_code(low) & ~differ


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, group_size: int = GROUP_SIZE, least_groups: int = LEAST_GROUPS) -> DataFrame:
    """Distinct ``fp`` -> star links (u, v) that connect all fingerprints within the radius."""

    def ranked(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array((gray_rank(fp.view(np.uint64)) ^ SIGN).view(np.int64))], names=["fp", "rank"])

    ranks = materialise(distinct.select("fp").mapInArrow(ranked, "fp long, rank long"))
    groups = max(least_groups, -(-ranks.count() // group_size))
    bounds = _bounds(ranks, groups)
    masks, patterns = _group_nodes(bounds)

    def routed(batches):
        upper = GrayIndex(patterns, masks)
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False).view(np.uint64) ^ SIGN
            own = np.searchsorted(bounds, rank, side="left")
            for q, g in upper.search(fp.view(np.uint64), radius):
                # Of two groups, the members of the lower one visit the higher one.
                up = g >= own[q]
                q, g = q[up], g[up]
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(fp[q]), pa.array(own[q] == g)], names=["g", "fp", "member"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        words = pdf["fp"].to_numpy().view(np.uint64)
        members = words[pdf["member"].to_numpy()]
        rank = gray_rank(members)
        members = members[np.argsort(rank)]
        rank = np.sort(rank)
        asked_rank = gray_rank(words)
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for q, leaf in GrayIndex(members).search(words, radius):
            up = asked_rank[q] < rank[leaf]
            a.append(words[q[up]])
            b.append(members[leaf[up]])
        u, v = local_stars(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
        return pd.DataFrame({"u": u, "v": v})

    return ranks.mapInArrow(routed, "g int, fp long, member boolean").groupBy("g").applyInPandas(joined, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest doc_id reachable, itself included. Null, empty and blank texts have fingerprint zero and
    link like others. Repeated rows stay repeated. A null doc_id stays null and is never a
    component_id unless a whole component has no id. A text of any length is read whole, its shingles in
    bounded blocks. Other columns are ignored; no rows give no rows.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = materialise(fingerprints(spread(plain)))
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = materialise(connected_components(fingerprint_links(classes, radius)))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", "component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies, by the pipeline's rule (``near_copies``), which is not the query's."""
    return near_copies.keep_one(docs)
