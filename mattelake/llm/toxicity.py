"""Toxicity by a weighted lexicon and an Aho-Corasick automaton (operator 9).

Texts are folded first: lower case, homoglyphs and accented letters to plain Latin, digits and signs that
stand for letters inside words to these letters, all else to single spaces. Lexicon entries are words or
beginnings of words; their weights are log odds from a bounded sample of labelled rows. Hits inside an
exception phrase do not count. A token whose digits or signs touch a letter on one side only is matched
both as it is and folded. The weights' sum and its share of the text's length give the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattelake.llm.common import discard, id_bucket, materialise, spread

#: Words that count without being learned, with their weight.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "imbecile", "dumbass", "bastard", "asshole", "bitch", "vermin", "filth")
SEED_WEIGHT = 2.0
#: Phrases around seed words in which these do not count; more are learned.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash collection", "not an idiot", "not a moron", "not stupid", "not worthless", "stupid question", "sore loser", "rat vermin")
#: Cyrillic, Greek and other look-alikes, in pairs of look-alike and plain letter.
LOOKALIKES = "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ӏl ԛq ԝw вb кk мm нh тt αa βb εe ιi κk νv οo ρp τt υu χx ηn ωw ıi łl øo đd ħh"
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Bound of the learning sample, in documents.
SAMPLE_DOCS = 6000
#: Documents of label 1 and log odds from which on an entry is taken, and those of label 0 that make a phrase an exception.
LEAST_DOCS, LEAST_ODDS, LEAST_CLEAN = 4, 2.5, 4
PREFIXES = (4, 5, 6, 7)


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    """Letter folds, by rule for accented and full-width letters; every other sign becomes a space."""

    class Fold(dict):
        def __missing__(self, code: int) -> str:
            c = chr(code)
            plain = unicodedata.normalize("NFKD", c)[:1].lower()
            if unicodedata.category(c) == "Mn" or c in "​‌‍﻿­":
                out = ""
            elif plain in pairs:
                out = pairs[plain]
            else:
                out = plain if plain.isalnum() else " "
            self[code] = out
            return out

    pairs = dict(LOOKALIKES.split(" ")[i] for i in range(len(LOOKALIKES.split(" "))))
    return Fold()


LEET_RUN = re.compile("[" + re.escape("".join(LEET)) + "]+")


def _leet(m: re.Match) -> str:
    s, a, b = m.string, m.start(), m.end()
    if b < len(s) and s[b].isalpha() and (a == 0 or s[a - 1].isalpha() or s[a - 1].isspace()):
        return "".join(map(LEET.get, m.group()))
    return m.group()


def fold(text: str | None) -> str:
    """The folded text, its words between single spaces, with a space at both ends."""
    if not text:
        return " "
    return f" {' '.join(LEET_RUN.sub(_leet, text).lower().translate(_table()).split())} "


#: White-space tokens with a digit or sign that may stand for a letter.
LEET_TOKEN = re.compile(r"(?<!\S)[^\s" + re.escape("".join(LEET)) + r"]*[" + re.escape("".join(LEET)) + r"]\S*")
CLOSING = "!|.,;:?)]}>\"'’”»*_-"


def _loose(m: re.Match) -> str:
    s, a, b = m.string, m.start(), m.end()
    if (b < len(s) and s[b].isalpha()) or (a > 0 and s[a - 1].isalpha()):
        return "".join(map(LEET.get, m.group()))
    return m.group()


def _worth(folded: str, auto: ahocorasick.Automaton) -> float:
    return sum(w for _, (_, w, exception) in auto.iter(folded) if not exception)


def _best(token: str, auto: ahocorasick.Automaton) -> str:
    """The token, or the form of it that weighs more: runs that touch a letter on one side folded, closing signs left out."""
    own = fold(token)
    best, top = token, _worth(own, auto)
    for end in dict.fromkeys((len(token), len(token.rstrip(CLOSING)), len(token.rstrip(CLOSING + "@$")))):
        form = LEET_RUN.sub(_loose, token[:end])
        folded = fold(form)
        if folded != own and (worth := _worth(folded, auto)) > top:
            best, top = form, worth
    return best


_best_of_short = lru_cache(maxsize=100_000)(_best)


def unmasked(text: str, auto: ahocorasick.Automaton) -> str:
    """text with each token in the form that weighs most; plain numbers and punctuation stay."""

    def form(m: re.Match) -> str:
        token = m.group()
        if token.isascii() and not any(map(str.isalpha, token)):
            return token
        return (_best_of_short if len(token) <= 64 else _best)(token, auto)

    return LEET_TOKEN.sub(form, text)


def automaton(weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
    """Entries and exception phrases in one automaton; an entry that is an exception itself is an exception."""
    out = ahocorasick.Automaton()
    for entry, w in weights.items():
        out.add_word(entry, (len(entry), w, False))
    for phrase in exceptions:
        out.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
    out.make_automaton()
    return out


def uncovered(hits: list[tuple[int, int, float]], safe: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The hits (start, end, weight) that lie in none of the safe spans, by one sweep over both."""
    safe = sorted(safe)
    starts, reach = [a for a, _, _ in safe], list(accumulate((b for _, b, _ in safe), max))
    out = []
    for h in hits:
        before = bisect_right(starts, h[0])
        if not before or reach[before - 1] < h[1]:
            out.append(h)
    return out


def weigh(text: str | None, auto: ahocorasick.Automaton) -> tuple[float, int]:
    """Sum of the weights of all hits, masked words in the form that weighs more, and the number of words."""
    folded = fold(unmasked(text, auto) if text else text)
    hits, safe = [], []
    for end, (size, w, exception) in auto.iter(folded):
        (safe if exception else hits).append((end + 1 - size, end + 1, w))
    if safe:
        hits = uncovered(hits, safe)
    return math.fsum(w for _, _, w in hits), max(1, folded.count(" ") - 1)


def _features(total: float, words: int) -> list[float]:
    return [1.0, math.log1p(max(0.0, total)), math.log1p(max(0.0, 1000.0 * total / words)), float(total > 0)]


def score(text: str | None, auto: ahocorasick.Automaton, combine: list[float]) -> float:
    z = sum(a * b for a, b in zip(_features(*weigh(text, auto)), combine))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def sample(docs: DataFrame, labels: DataFrame, column: str, fold_mod: int, fold_out: int, size: int) -> DataFrame:
    """(text, label) of about ``size`` labelled rows outside the held-out fold, taken by a hash of their ids."""
    known = labels.where(F.col(column).isin(0, 1) & (id_bucket("doc_id", fold_mod) != fold_out)).groupBy("doc_id").agg(F.max(column).alias("label"))
    n = known.count()
    share = min(1.0, size / n) if n else 0.0
    if share < 1:
        taken = lambda c: F.xxhash64(c.cast("string"), F.lit(column)) < F.lit(int(-(2**63) + 2**64 * share))
        known, docs = known.where(taken(F.col("doc_id"))), docs.where(taken(F.col("doc_id")))
    return docs.select("doc_id", "text").join(known, "doc_id").select("text", "label")


def candidates(rows: DataFrame) -> DataFrame:
    """(entry, pos, neg): documents of either label that have the word or beginning."""

    def run(batches):
        for b in batches:
            counts = (Counter(), Counter())
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                words = set(fold(text).split())
                own = {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}
                counts[label].update(own)
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], names=["entry", "pos", "neg"])

    return rows.mapInArrow(run, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose(found: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Entry -> weight. A beginning stays only where no single longer entry accounts for most of it."""
    odds = {e: math.log((p + 0.5) / (n_pos + 1)) - math.log((q + 0.5) / (n_neg + 1)) for e, p, q in found}
    count = {e: p for e, p, _ in found}
    longer: Counter = Counter()
    for e in count:
        word = e.strip()
        for n in PREFIXES:
            if len(word) > n:
                longer[f" {word[:n]}"] = max(longer[f" {word[:n]}"], count[e])
    whole = {e for e in count if e.endswith(" ") or count[e] >= 1.5 * longer[e]}
    out = {}
    for e in sorted(whole, key=len):
        covered = any(f" {e.strip()[:n]}" in out for n in PREFIXES if len(e.strip()) > n)
        if not covered:
            out[e] = odds[e]
    return out


def phrases(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(phrase, pos, neg): documents of either label that have an entry's word beside a given next or last word."""

    def run(batches):
        heads = {e.strip() for e in weights if e.endswith(" ")}
        stems = tuple(e.strip() for e in weights if not e.endswith(" "))
        for b in batches:
            counts = (Counter(), Counter())
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                words = fold(text).split()
                at = [i for i, w in enumerate(words) if w in heads or (stems and w.startswith(stems))]
                own = {f"{words[i]} {words[i + 1]}" for i in at if i + 1 < len(words)} | {f"{words[i - 1]} {words[i]}" for i in at if i}
                counts[label].update(own)
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], names=["phrase", "pos", "neg"])

    return rows.mapInArrow(run, "phrase string, pos long, neg long").groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def combine(features: np.ndarray, label: np.ndarray, rounds: int = 25) -> list[float]:
    """Logistic weights of the document features, by Newton steps with a small ridge."""
    w, ridge = np.zeros(features.shape[1]), 0.5 * np.eye(features.shape[1])
    ridge[0, 0] = 0.01
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (p - label) + ridge @ w
        hess = (features * (p * (1 - p))[:, None]).T @ features + ridge
        w -= np.linalg.solve(hess, grad)
    return [float(x) for x in w]


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> tuple[dict[str, float], tuple[str, ...], list[float]]:
    """Lexicon, exception phrases and feature weights. Without labelled rows of both kinds the seed words decide alone.

    Every entry that reaches the least count and odds is taken. Two-word phrases around an entry that clean
    documents have and toxic ones have not are exceptions.
    """
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    rows = materialise(sample(docs, labels, "toxic", 5, 0, size).repartition(tasks))
    n = dict(rows.groupBy("label").count().collect())
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    weights = {f" {w} ": SEED_WEIGHT for w in SEED_WORDS}
    if not n_pos or not n_neg:
        return weights, EXCEPTIONS, [-3.0, 3.0, 0.0, 1.0]
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    best = candidates(rows).where((F.col("pos") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).orderBy("entry")
    weights |= choose([tuple(r) for r in best.collect()], n_pos, n_neg)
    clean = phrases(rows, weights).where((F.col("neg") >= LEAST_CLEAN) & (F.col("pos") == 0)).select("phrase").orderBy("phrase")
    exceptions = tuple(dict.fromkeys((*EXCEPTIONS, *(r[0] for r in clean.collect()))))

    def run(batches):
        auto = automaton(weights, exceptions)
        for b in batches:
            got = [weigh(t, auto) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), b.column("label").cast(pa.int32())], names=["total", "words", "label"])

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "total double, words long, label int").collect())
    discard(rows)
    return weights, exceptions, combine(np.array([_features(r[0], r[1]) for r in got]), np.array([r[2] for r in got], float))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text has no hits and gets the score of a clean text. Texts are scanned whole, in time
    that grows with their length. Where several entries match the same place, all count. A document with both labels counts as toxic. A null
    doc_id is in no fold: held_out is false. Repeated rows are rated alike; other columns are ignored.
    """
    weights, exceptions, weight_of = learn(docs, labels)

    def run(batches):
        auto = automaton(weights, exceptions)
        for b in batches:
            s = [score(t, auto, weight_of) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    marked = spread(docs.select("doc_id", "text")).withColumn("held_out", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)))
    return marked.mapInArrow(run, marked.drop("text").schema.add("score", "double").add("predicted", "integer"))
