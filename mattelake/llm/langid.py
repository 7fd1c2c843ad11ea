"""Language identification by segmentation-marginalised unigrams (operator 2).

Each language has a probability for every piece of a fixed public vocabulary. A text is its letter runs
in lower case, each with the vocabulary's word mark before it; the probability of a run is the sum over
all its segmentations, by the forward algorithm. Probabilities are fitted by EM (forward-backward) on
word counts of a bounded sample of labelled rows; each round is one pass over the counts on the
executors. Distinct words of a batch are scored once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattelake.llm.common import discard, id_bucket, materialise, renamed, restored, spread

MARK = "▁"
LETTERS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"
#: Bound of the fitting sample: expected documents, in equal parts of each language.
SAMPLE_DOCS = 2048
EM_ROUNDS = 3
#: Up to this length plain products over a word stay above the smallest double; longer ones are added up as logarithms.
PLAIN_CHARS = 24
#: Unit of the expected uses.
UNIT = 2.0**-24
#: Weight of the pooled distribution, in pieces, and the probability of a character no piece covers.
PRIOR_PIECES = 2000.0
UNKNOWN = 1e-7
#: Log probability of a word that no segmentation gives; below that of any word that has one.
IMPOSSIBLE = -1e15
CACHED_WORDS = 400_000
CACHED_CHARS = 8_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Piece -> index, of the ordinary pieces in lower case (bytes, controls and unknown left out)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    body = [p for p in pieces if p == p.lower() and (p.strip(MARK) == "" or LETTERS.fullmatch(p.lstrip(MARK)))]
    return {p: i for i, p in enumerate(body)}


class Pieces:
    """Finds all vocabulary pieces in words of one length, by rolling hashes of their substrings."""

    BASE, SPICE, SLOTS = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 20

    def __init__(self, vocab: dict[str, int]):
        self.n, self.longest = len(vocab), max(map(len, vocab), default=1)
        self.hash = np.zeros(self.n + 1, np.uint64)
        self.table = np.zeros(1 << self.SLOTS, np.int32)
        self.depth = 1
        for piece, i in vocab.items():
            h = 0
            for c in piece:
                h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.hash[i + 1] = h
            slot, probes = ((h * int(self.SPICE)) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.SLOTS), 1
            while self.table[slot]:
                slot, probes = (slot + 1) % len(self.table), probes + 1
            self.table[slot] = i + 1
            self.depth = max(self.depth, probes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece index of each hash, or the number of pieces where there is none."""
        slot = ((h * self.SPICE) >> np.uint64(64 - self.SLOTS)).astype(np.int32)
        out = np.full(h.shape, self.n, np.int32)
        for _ in range(self.depth):
            at = self.table[slot]
            hit = (at > 0) & (self.hash[at] == h)
            out[hit] = at[hit] - 1
            if not ((at > 0) & ~hit).any():
                break
            slot = (slot + 1) % len(self.table)
        return out

    def ending(self, words: list[str]) -> np.ndarray:
        """(words, end position, length - 1) -> piece that ends there.

        All words have one length. The number of pieces stands for none, the next number for a single
        character that no piece covers.
        """
        size = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size).astype(np.uint64) + np.uint64(1)
        out = np.full((len(words), size + 1, min(self.longest, size)), self.n, np.int32)
        h = np.zeros((len(words), size), np.uint64)
        for length in range(1, out.shape[2] + 1):
            h = h[:, : size - length + 1] * self.BASE + codes[:, length - 1 :]
            out[:, length:, length - 1] = self.find(h)
        out[:, 1:, 0][out[:, 1:, 0] == self.n] = self.n + 1
        return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(vocabulary(path))


def _by_length(words: list[str], cells: int = 400_000) -> list[list[int]]:
    """Positions of words in groups of equal length and bounded size."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    out = []
    for size, rows in groups.items():
        step = max(1, cells // (16 * (size + 1)))
        out += [rows[lo : lo + step] for lo in range(0, len(rows), step)]
    return out


def _padded(probs: np.ndarray) -> np.ndarray:
    return np.vstack([probs, np.zeros(probs.shape[1]), np.full(probs.shape[1], UNKNOWN)])


def word_scores(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log probability (words, languages) of each word, summed over its segmentations. probs: (pieces, languages)."""
    out, weights = np.zeros((len(words), probs.shape[1])), _padded(probs)
    for rows in _by_length(words):
        found = pieces.ending([MARK + words[i] for i in rows])
        n, size, width = found.shape
        alpha, scale = np.zeros((n, size + width, probs.shape[1])), np.zeros((n, probs.shape[1]))
        alpha[:, width] = 1
        for pos in range(1, size):
            before = alpha[:, pos : pos + width][:, ::-1]
            alpha[:, pos + width] = np.einsum("nlk,nlk->nk", before, weights[found[:, pos]])
            if pos % 8 == 0:  # keep long words within the range of doubles
                window = alpha[:, pos + 1 : pos + 1 + width]
                top = window.max(axis=1)
                top[top == 0] = 1
                window /= top[:, None]
                scale += np.log(top)
        with np.errstate(divide="ignore"):
            out[rows] = np.log(alpha[:, -1]) + scale
    return np.where(np.isneginf(out), IMPOSSIBLE, out)


def _expected(found: np.ndarray, tally: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses (words, end position, length - 1, languages) of pieces in ``tally`` words of one length."""
    (n, size, width), k = found.shape, weights.shape[1]
    if size <= PLAIN_CHARS:
        alpha, beta = np.zeros((n, size + width, k)), np.zeros((n, size + width, k))
        alpha[:, width], beta[:, -1] = 1, 1
        for pos in range(1, size):
            alpha[:, pos + width] = np.einsum("nlk,nlk->nk", alpha[:, pos : pos + width][:, ::-1], weights[found[:, pos]])
        share = tally / np.maximum(alpha[:, -1], 1e-300)
        out = np.zeros((n, size, width, k))
        for pos in range(size - 1, 0, -1):
            step = weights[found[:, pos]] * beta[:, pos + width][:, None]
            beta[:, pos : pos + width][:, ::-1] += step
            out[:, pos] = step * alpha[:, pos : pos + width][:, ::-1] * share[:, None]
        return out
    # Products over long words leave the range of doubles, so these are summed as logarithms.
    with np.errstate(divide="ignore"):
        logs = np.log(weights)
    alpha, beta = np.full((n, size + width, k), -np.inf), np.full((n, size + width, k), -np.inf)
    alpha[:, width], beta[:, -1] = 0, 0
    for pos in range(1, size):
        alpha[:, pos + width] = np.logaddexp.reduce(alpha[:, pos : pos + width][:, ::-1] + logs[found[:, pos]], axis=1)
    out = np.zeros((n, size, width, k))
    whole = alpha[:, -1]
    base = np.where(np.isneginf(whole), 0, whole)[:, None]
    for pos in range(size - 1, 0, -1):
        step = logs[found[:, pos]] + beta[:, pos + width][:, None]
        beta[:, pos : pos + width][:, ::-1] = np.logaddexp(beta[:, pos : pos + width][:, ::-1], step)
        out[:, pos] = np.exp(step + alpha[:, pos : pos + width][:, ::-1] - base) * tally[:, None]
    return out


def expected_uses(words: list[str], tally: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """(pieces, languages): how often each piece is used in ``tally`` (words, languages) words, in units of ``UNIT``.

    The uses are whole numbers, so sums over tasks do not depend on their order.
    """
    weights, m, k = _padded(probs), len(probs), probs.shape[1]
    total = np.zeros((m + 2, k))
    for rows in _by_length(words):
        found = pieces.ending([MARK + words[i] for i in rows])
        use = np.rint(_expected(found, tally[rows], weights) / UNIT)
        flat = found.ravel()
        for j in range(k):
            total[:, j] += np.bincount(flat, use[..., j].ravel(), m + 2)
    return total[:m]


def maximised(expected: np.ndarray) -> np.ndarray:
    """Probabilities (pieces, languages) from expected uses, each language drawn towards the pooled ones."""
    pooled = expected.sum(axis=1) + 0.05
    expected = expected + PRIOR_PIECES * (pooled / pooled.sum())[:, None]
    return expected / expected.sum(axis=0)


def fit(counts: dict[str, dict[str, int]], vocab: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities (pieces, languages), from word counts by language, in one process."""
    langs, pieces = sorted(counts), Pieces(vocab)
    words = sorted({w for c in counts.values() for w in c})
    tally = np.array([[counts[lang].get(w, 0) for lang in langs] for w in words], float).reshape(len(words), len(langs))
    probs = np.full((len(vocab), len(langs)), 1 / max(1, len(vocab)))
    for _ in range(rounds if words else 0):
        probs = maximised(expected_uses(words, tally, pieces, probs) * UNIT)
    return langs, probs


def _expected_column(words: DataFrame, path: str, probs: np.ndarray) -> np.ndarray:
    """``expected_uses`` of a table (word, tally array<double>), summed over its tasks."""
    m, k = probs.shape

    def run(batches):
        pieces = pieces_of(path)
        for b in batches:
            tally = np.array(b.column("tally").to_pylist(), float).reshape(b.num_rows, k)
            total = expected_uses(b.column("word").to_pylist(), tally, pieces, probs)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], names=["piece", "lang", "uses"])

    # At most a row for each piece and language.
    got = words.mapInArrow(run, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
    out = np.zeros((m, k))
    out[got["piece"], got["lang"]] = got["uses"] * UNIT
    return out


def learn(docs: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Fit on about ``sample_docs`` labelled rows outside the held-out fold, the same number of each language.

    Rows are taken by a hash of their ids, whole; a language with fewer rows gives all. All words of these
    rows count. The driver holds the probabilities: a number for each piece and language.
    """
    path = path or default_vocabulary()
    fold = docs.where((id_bucket("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("lang"), "text")
    sizes = sorted(tuple(r) for r in fold.groupBy("lang").count().collect())
    langs = [lang for lang, _ in sizes]
    probs = np.full((len(vocabulary(path)), len(langs)), 1 / max(1, len(vocabulary(path))))
    if not langs:
        return langs, probs
    shares = [(lang, i, min(1.0, sample_docs / len(langs) / n)) for i, (lang, n) in enumerate(sizes)]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, at int, share double"))  # a row for each language
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 40)) < F.col("share") * float(1 << 40)
    sample = fold.join(chosen, "lang").where(drawn)
    words = sample.select("at", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = words.groupBy("word", "at").count()
    tally = F.array(*[F.sum(F.when(F.col("at") == i, F.col("count")).otherwise(0)).cast("double") for i in range(len(langs))])
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    table = materialise(counted.groupBy("word").agg(tally.alias("tally")).repartition(tasks, "word"))
    for _ in range(EM_ROUNDS):
        probs = maximised(_expected_column(table, path, probs))
    discard(table)
    return langs, probs


class _Scorer(dict):
    """White-space token -> row of the score table; tokens not met before wait until ``settle``.

    The table has a token's log probability in each language and the number of its letter runs.
    """

    def __init__(self, path: str, probs: np.ndarray):
        super().__init__()
        self.pieces, self.probs = pieces_of(path), probs
        self.fresh: list[str] = []
        self.table, self.chars = np.empty((0, probs.shape[1] + 1)), 0

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.fresh.append(token)
        self.chars += len(token)
        return at

    def settle(self) -> None:
        if not self.fresh:
            return
        runs = [LETTERS.findall(t.lower()) for t in self.fresh]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for r in runs for w in r))}
        rows = np.zeros((len(runs), self.table.shape[1]))
        if distinct:
            scores = word_scores(list(distinct), self.pieces, self.probs)
            own = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            at = np.array([distinct[w] for r in runs for w in r])
            for j in range(scores.shape[1]):
                rows[:, j] = np.bincount(own, scores[at, j], len(runs))
            rows[:, -1] = np.bincount(own, minlength=len(runs))
        self.table, self.fresh = np.vstack([self.table, rows]), []

    def relax(self) -> None:
        if len(self) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self.clear()
            self.table, self.chars = self.table[:0], 0


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, path: str | None = None, column: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of that language under equal priors).

    A text that is null or has no letter, and any text where no language was learned, is ``und`` with
    score 0. Ties go to the first language in code-point order. Texts are read whole whatever their length;
    repeated rows get equal answers. Other columns pass through.
    """
    path = path or default_vocabulary()
    names = docs.columns
    schema = docs.select("*").schema.add("lang_pred", "string").add("score", "double")
    probs = probs.astype(np.float32).astype(np.float64)

    def run(batches):
        scorer = _Scorer(path, probs)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = []
                for text in part.column(column).to_pylist():
                    tokens = text.split() if text and langs else []
                    rows.append(np.fromiter(map(scorer.__getitem__, tokens), np.int64, len(tokens)))
                scorer.settle()
                found, scores = [], []
                for ids in rows:
                    total = scorer.table[ids].sum(axis=0)
                    if not total[-1]:
                        found.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = total[:-1]
                    odds = np.exp(total - total.max())
                    found.append(langs[int(total.argmax())])
                    scores.append(float(odds.max() / odds.sum()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])
                scorer.relax()

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. A null doc_id is in no fold: held_out is false."""
    langs, probs = learn(docs, path)
    marked = spread(docs.select("doc_id", "text")).withColumn("held_out", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)))
    return predict(marked, langs, probs, path).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, path: str | None = None, least: float = 0.5) -> DataFrame:
    """docs without those that are ``und`` or whose language has a posterior under ``least``."""
    langs, probs = learn(docs, path)
    safe, new = renamed(docs)
    rated = predict(spread(safe), langs, probs, path, new["text"])
    return rated.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*restored(new))
