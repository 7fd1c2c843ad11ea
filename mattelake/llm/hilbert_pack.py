"""Packing along a space-filling curve (operator 7).

Each document's token ids are hashed into a vector, projected to a few dimensions, and the documents are
range-sorted by the Hilbert key of that point. The sorted stream of tokens is cut at every multiple of
the sequence length, so only its last sequence has room left. Offsets come from sums per partition; the
driver holds one number for each partition.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import compress, count, islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mattelake.llm.common import materialise, spread

LENGTH = 2048
SEPARATOR = 1
DIMS, BITS = 4, 12
HASHED = 1024
SPREAD = 8.0
#: Order along the curve; rows equal in all but the last have equal pieces.
ORDER = ("key", "doc_id", "tie", "row")
CACHED_WORDS = 300_000
CACHED_CHARS = 8_000_000
#: Bounds of the texts that are taken together; a longer text is taken alone.
ROWS_AT_ONCE, CHARS_AT_ONCE = 256, 2_000_000
#: Characters that composition, lower-casing in context or unusual white space may treat otherwise.
BEYOND = re.compile("[\u0300-\U0010ffff]")
UNSTEADY = re.compile("[^\x00-\u02ff\u0400-\u04ff\u2010-\u2027\u2030-\u205e\u4e00-\u9fff\uac00-\ud7a3]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own would each hold memory
    return Tokenizer.from_file(path)


def id_bytes(path: str) -> int:
    """Bytes of a stored id: two where the vocabulary allows it, else four."""
    return 2 if max(tokenizer(path).get_vocab_size(), SEPARATOR + 1) <= 1 << 16 else 4


def _low_class(kind: str) -> str:
    """The characters below U+0300 of a general category, as ranges of a character class."""
    own = [c for c in range(0x300) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c in own if c - 1 not in own]
    stops = [c for c in own if c + 1 not in own]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, stops))


@lru_cache(maxsize=2)
def word_rule(path: str) -> tuple[re.Pattern, regex.Pattern, np.ndarray] | None:
    """The pattern of the tokenizer's words and which ids end a word, where it lower-cases and marks word ends.

    The first form of the pattern is for texts below U+0300, with its classes written out.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    lowers = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
    mark = spec["model"].get("end_of_word_suffix")
    if not (lowers and mark and steps[0].get("type") == "Split" and steps[0].get("invert") and len(steps) == 2):
        return None
    ends = np.zeros(tokenizer(path).get_vocab_size() + 1, bool)
    ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(mark)]] = True
    rule = steps[0]["pattern"]["Regex"]
    plain = rule.replace(r"\p{L}", _low_class("L")).replace(r"\p{N}", _low_class("N")).replace(r"\s", "\t-\r \x85\xa0")
    return re.compile(plain), regex.compile(rule), ends


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> Tokenizer:
    """The tokenizer for words found by ``word_rule``, normalised already: it parts them at spaces instead of searching for them again."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"][0] = None, {"type": "CharDelimiterSplit", "delimiter": " "}
    return Tokenizer.from_str(json.dumps(spec))


def _gathered(ids: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some rows of a ragged list behind each other, and each row's size."""
    start = ends[rows]
    size = ends[rows + 1] - start
    before = np.cumsum(size) - size
    return ids[np.arange(int(size.sum())) + np.repeat(start - before, size)], size


class WordIds(defaultdict):
    """Word in lower case -> number, in the order in which words are met; new words have no ids until ``settle``.

    A text's ids are its words' ids in a row. Words are found by the tokenizer's own pattern and go to it
    joined by spaces, many in one call; the ids that end a word tell them apart. Texts with characters
    that normalisation may join or change in other ways, or with the beginning of a special token, go to
    the tokenizer whole.
    """

    def __init__(self, path: str):
        super().__init__(count().__next__)
        self.tok, self.rule, self.chars = tokenizer(path), word_rule(path), 0
        self.word_tok = word_tokenizer(path) if self.rule else self.tok
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.old, self.old_ids, self.old_ends = {}, self.ids, self.ends

    def _encoded(self, texts: list[str], tok: Tokenizer) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _looked_up(self, words: list[str], step: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words behind each other, and where each word's end."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        groups = [words[lo : lo + step] for lo in range(0, len(words), step)]
        for group, own in zip(groups, self._encoded([" ".join(g) for g in groups], self.word_tok)):
            cut = np.flatnonzero(self.rule[2][own]) + 1
            if len(cut) != len(group) or cut[-1] != len(own):  # not told apart: one by one
                each = self._encoded(group, self.word_tok)
                own, cut = np.concatenate(each), np.cumsum([len(e) for e in each])
            ids.append(own)
            sizes.append(np.diff(cut, prepend=0))
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def settle(self) -> None:
        """Gives the new words their ids: from the older half of the cache, else from the tokenizer."""
        waiting = len(self) + 1 - len(self.ends)
        if not waiting:
            return
        fresh = list(islice(reversed(self), waiting))[::-1]
        self.chars += sum(map(len, fresh))
        origin = np.fromiter(map(self.old.get, fresh, repeat(-1)), np.int64, waiting)
        ids, ends = self._looked_up(list(compress(fresh, (origin < 0).tolist())))
        rows = np.where(origin >= 0, origin, len(self.old_ends) - 2 + np.cumsum(origin < 0))
        all_ids, all_ends = np.concatenate([self.old_ids, ids]), np.concatenate([self.old_ends, self.old_ends[-1] + ends])
        own, size = _gathered(all_ids, all_ends, rows)
        self.ids = np.concatenate([self.ids, own])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])

    def _relax(self) -> None:
        """Past half of the bound the words become the older half, and the half before goes."""
        if 2 * len(self) > CACHED_WORDS or 2 * self.chars > CACHED_CHARS:
            self.old, self.old_ids, self.old_ends = dict(self), self.ids, self.ends
            self.clear()
            self.default_factory = count().__next__
            self.chars, self.ids, self.ends = 0, self.ids[:0].copy(), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out, own, sizes, whole = [None] * len(texts), [], [], []
        for i, t in enumerate(texts):
            if self.rule is None or "<|" in t or not (t.isascii() or not UNSTEADY.search(t)):
                whole.append(i)
                sizes.append(0)
            else:
                low = t.lower()
                words = self.rule[0 if low.isascii() or not BEYOND.search(low) else 1].findall(low)
                own.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
                sizes.append(len(words))
        self.settle()
        if own:
            ids, size = _gathered(self.ids, self.ends, np.concatenate(own))
            ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *sizes])].tolist()
            out = [ids[lo:hi] for lo, hi in zip(ends, ends[1:])]
        for i, ids in zip(whole, self._encoded([texts[i] for i in whole], self.tok)):
            out[i] = ids
        self._relax()
        return out


def _groups(texts: list[str]) -> list[slice]:
    """Runs of texts of at most ``ROWS_AT_ONCE`` texts and ``CHARS_AT_ONCE`` characters, or of one text."""
    out, lo, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo == ROWS_AT_ONCE or held + len(t) > CHARS_AT_ONCE):
            out.append(slice(lo, i))
            lo, held = i, 0
        held += len(t)
    return [*out, slice(lo, len(texts))] if texts else []


def projection(size: int, dims: int = DIMS, hashed: int = HASHED) -> np.ndarray:
    """(ids, dims): every id's signed hash bucket, taken through a fixed Gaussian projection."""
    h = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    plane = np.random.default_rng(7).normal(size=(hashed, dims))
    return (plane[(h % np.uint64(hashed)).astype(np.int64)] * sign[:, None]).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, dims) of ``bits`` bits each."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tie, key, n, ids): ids as 16- or 32-bit words, with the separator at the end; tie hashes the text."""

    def run(batches):
        # Each task has its own cache, so that workers that wait hold none.
        words, width, stop = WordIds(path), id_bytes(path), np.array([SEPARATOR], np.uint32)
        kind = f"<u{width}"
        table = projection(max(words.tok.get_vocab_size(), SEPARATOR + 1))
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for group in _groups(texts):
                part = b.slice(group.start, group.stop - group.start)
                own = words.encode(texts[group])
                size = np.array([len(x) + 1 for x in own])
                ids = np.concatenate([x for each in own for x in (each, stop)])
                ends = np.cumsum([0, *size])
                points, cut = table[ids], ends.tolist()
                mid = (np.array([np.add.reduce(points[lo:hi], axis=0) for lo, hi in zip(cut, cut[1:])], np.float64) / size[:, None]).astype(np.float32).astype(np.float64)
                unit = 0.5 + 0.5 * np.tanh(SPREAD * mid)
                keys = hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
                packed = [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(ids.astype(kind))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tie"), pa.array(keys), pa.array(size, pa.int64()), pa.Array.from_buffers(pa.binary(), len(size), packed)],
                    names=["doc_id", "tie", "key", "n", "ids"],
                )

    wanted = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return wanted.mapInArrow(run, wanted.drop("text").schema.add("key", "long").add("n", "long").add("ids", "binary"))


def offsets(sizes: DataFrame) -> DataFrame:
    """(row, doc_id, tie, key, n) -> (row, first): tokens before the row in the order of ``ORDER``."""
    spark = sizes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(sizes.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()))
    before, sums = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n")).collect()):
        sums.append((part, before))
        before += n
    base = F.broadcast(spark.createDataFrame(sums, "part int, base long"))  # a row for each partition
    earlier = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("inner", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(base, "part").select("row", (F.col("base") + F.col("inner")).alias("first"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the separator alone. Repeated rows and null ids are documents of their own.
    Documents of equal key follow by id (null first), then by a hash of the text, so the result does not
    depend on partitioning. A text of any length is read whole and cut wherever a sequence is full; a row
    must fit a Python worker's memory. Other columns are ignored. No documents give no pieces.
    """
    path = path or default_tokenizer()
    tokens = materialise(tokenised(spread(docs.select("doc_id", "text")), path).withColumn("row", F.monotonically_increasing_id()))
    first = offsets(tokens.select("row", "doc_id", "tie", "key", "n"))
    placed = tokens.join(first, "row").select("doc_id", "n", "ids", "first")
    wide = id_bytes(path)

    def cut(batches):
        for b in batches:
            out = {k: [] for k in ("at", "start", "length", "crc", "tokens", "seq", "offset")}
            sizes, firsts = b.column("n").to_pylist(), b.column("first").to_pylist()
            for i, (n, g, raw) in enumerate(zip(sizes, firsts, b.column("ids").to_pylist())):
                ids = np.frombuffer(raw, f"<u{wide}").astype("<u4")
                lo = 0
                while lo < n:
                    seq, off = divmod(g + lo, length)
                    hi = min(n, lo + length - off)
                    for k, v in zip(out, (i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), n, seq, off)):
                        out[k].append(v)
                    lo = hi
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(out["at"], pa.int64())), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "tokens", "seq", "offset"))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = docs.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    return placed.mapInArrow(cut, schema)

