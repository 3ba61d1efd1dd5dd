"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings counts their common gapped subsequences of three characters, each weighted by a decay to the
power of the span it covers (spans of up to five characters), so inserted and missing characters cost weight and not the match.
Words are folded first: lower case, look-alike digits as letters, other signs dropped, runs of spaced-out letters joined.
The Nyström map over landmark words makes the kernel linear. Landmarks are the words that tell the toxic sentences
best, and the words of clean sentences that are nearest to those.

A sentence's decision value is that of its worst word, and a squared-hinge machine is trained on labelled sentences:
those of clean documents are clean, and of those that only toxic documents have, the ones that the machine itself finds
toxic are toxic, in turns. Each sentence speaks through its worst word of the turn, clean ones through those of all turns.
A document's score is a logistic rule over its sentences' decision values (all that are above zero, the worst one) and its length.

The trained machine is linear in the subsequences, so it is kept as one weight per subsequence (of 2**TABLE_BITS places
that codes share) and scores any text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.textops import bounded_sample, by_bytes, fold_of, texts_of
from waraq.runtime import bound_batches, free_name

DECAY, SPAN, TABLE_BITS = 0.6, 5, 20
LANDMARKS, NEAREST = 96, 32
#: Words of a sentence; longer ones count as several. Characters after which a sentence without an end is cut.
SENTENCE_WORDS, SENTENCE_CHARS = 24, 1 << 16
MEMO_WORDS = 120_000
SCORE_CHARS = 1 << 18
SCORE_BYTES = 2 << 20
#: Words below which a document's length counts little.
SHORT = 64
#: Digits and signs that stand for letters inside a word.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_FOLD = {ord(c): None for c in map(chr, range(33, 127)) if not c.isalpha()} | {ord(a): b for a, b in LOOK_ALIKES.items()}
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")
_SENTENCE = re.compile(r"[\n.!?]+(?=\s|$)")


def fold(word: str) -> str:
    low = word.lower()
    if low.isalpha():
        return low
    return low.translate(_FOLD) if any(c.isalpha() for c in low) else ""


def words_of(sentence: str) -> list[str]:
    """The words of a sentence, with spaced-out ones ("i d i o t") joined as further words at its end."""
    found = sentence.split()
    if list(map(len, found)).count(1) >= 3:
        found += ["".join(m.group().split()) for m in _SPACED.finditer(sentence)]
    return found


def sentences_of(text: str) -> Iterator[str]:
    """The sentences of a text; what is learned from and what is scored are both read this way."""
    for sentence in _SENTENCE.split(text):
        at = 0
        while len(sentence) - at > SENTENCE_CHARS:
            space = sentence.rfind(" ", at + 1, at + SENTENCE_CHARS)
            end = space if space > 0 else at + SENTENCE_CHARS
            yield sentence[at:end]
            at = end
        if at < len(sentence):
            yield sentence[at:] if at else sentence


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (index into words), code and weight of every gapped subsequence of three characters; words are marked at the start."""
    pad = "\0" * (SPAN - 1)
    codes = np.frombuffer(pad.join("^" + w for w in words).encode("utf-32-le") + bytes(4 * (SPAN - 1)), np.uint32)
    lengths = np.array([len(w) + SPAN for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)[: len(codes)]
    n = len(codes) - SPAN + 1
    owners, keys, weights = [], [], []
    with np.errstate(over="ignore"):
        for k in range(2, SPAN):
            third = codes[k : n + k]
            for j in range(1, k):
                good = np.flatnonzero((third > 0) & (codes[:n] > 0))
                key = (codes[good] * np.uint32(0x9E3779B1) + codes[good + j]) * np.uint32(0x85EBCA6B) + codes[good + k]
                key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                owners.append(owner[good])
                keys.append((key >> np.uint32(32 - TABLE_BITS)).astype(np.int64))
                weights.append(np.full(len(good), DECAY ** (k + 1)))
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(weights)


class KernelMachine:
    """A weight per subsequence code and a bias score a word; a logistic rule over a document's sentences decides."""

    def __init__(self, table: np.ndarray, bias: float, rule: np.ndarray | None = None):
        self.table, self.bias = table, bias
        self.rule = np.zeros(4) if rule is None else rule

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision values of folded words; words too short for a subsequence get the bias alone."""
        if not words:
            return np.zeros(0)
        owner, key, weight = subsequences(words)
        value = np.bincount(owner, weights=weight * self.table[key], minlength=len(words))
        norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=len(words)))
        return value / np.maximum(norm, 1e-9) + self.bias

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.rule, -40, 40)))


class Evidence:
    """What is summed up of a document's sentences: decision values above zero (1 at most each), the worst, and words."""

    __slots__ = ("best", "hits", "words")

    def __init__(self):
        self.hits, self.best, self.words = 0.0, -1.0, 0

    def add(self, values: list[float]) -> None:
        """The decision values of a sentence's words."""
        n = len(values)
        self.words += n
        for k in range(0, n, SENTENCE_WORDS):
            top = max(values[k : k + SENTENCE_WORDS] if n > SENTENCE_WORDS else values)
            if top > self.best:
                self.best = min(top, 1.0)
            if top > 0:
                self.hits += min(top, 1.0)


def evidence_of(documents: list[Evidence]) -> np.ndarray:
    """(documents, 4): the toxic sentences in all, the worst one, the length, and 1.

    Lengths under ``SHORT`` words tell little, so they count almost alike and short clean texts stay clean.
    """
    rows = np.array([(d.hits, d.best, d.words) for d in documents]).reshape(-1, 3)
    return np.column_stack([np.log1p(rows[:, 0]), rows[:, 1], np.log1p(rows[:, 2] / SHORT), np.ones(len(rows))])


def fit_rule(evidence: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(evidence.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(evidence @ w, -40, 40)))
        h = (evidence * (p * (1 - p))[:, None]).T @ evidence + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, evidence.T @ (p - y) + ridge * w)
    return w


def fit_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-4, steps: int = 30) -> np.ndarray:
    """Weights and bias of the squared-hinge machine, by Newton's method over the rows within the margin."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-9])
    for _ in range(steps):
        square, pull = penalty.copy(), np.zeros(len(w))
        for at in range(0, len(x), 4096):
            part, sign, c = x[at : at + 4096].astype(np.float64), y[at : at + 4096], cost[at : at + 4096]
            active = sign * (part @ w) < 1
            part, c = part[active], c[active]
            square += (part * c[:, None]).T @ part
            pull += part.T @ (c * sign[active])
        new = np.linalg.solve(square, pull)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


class Landmarks:
    """Normalised subsequence weights of the landmark words, as a dense row for each code that occurs in one."""

    def __init__(self, words: list[str]):
        owner, key, weight = subsequences(words)
        self.codes, row = np.unique(key, return_inverse=True)
        self.rows = np.zeros((len(self.codes), len(words)), np.float32)
        np.add.at(self.rows, (row, owner), weight)
        self.rows /= np.sqrt(np.bincount(owner, weights=weight * weight, minlength=len(words))).astype(np.float32)

    def kernel(self, words: list[str], block: int = 2048) -> np.ndarray:
        """(words, landmarks) normalised kernel values, made in blocks of words."""
        out = np.zeros((len(words), self.rows.shape[1]), np.float32)
        for first in range(0, len(words), block):
            part = words[first : first + block]
            owner, key, weight = subsequences(part)
            norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=len(part)))
            at = np.minimum(np.searchsorted(self.codes, key), len(self.codes) - 1)
            used = np.flatnonzero(self.codes[at] == key)
            used = used[np.argsort(owner[used], kind="stable")]
            if not len(used):
                continue
            cuts = np.flatnonzero(np.r_[True, owner[used][1:] != owner[used][:-1]])
            sums = np.add.reduceat(weight[used].astype(np.float32)[:, None] * self.rows[at[used]], cuts)
            held = owner[used][cuts]
            out[first + held] = sums / np.maximum(norm[held], 1e-9)[:, None]
        return out


class Documents:
    """Documents as sentences, a sentence as the numbers of its folded words; words are kept once."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def read(self, text: str) -> list[list[int]]:
        """The sentences, as :func:`sentences_of` gives them; those without a word are left out."""
        read = ([self.number.setdefault(name, len(self.number)) for name in map(fold, words_of(s)) if name] for s in sentences_of(text))
        return [s for s in read if s]

    @property
    def words(self) -> list[str]:
        return list(self.number)


def _cut(documents: list) -> dict[tuple[int, ...], None]:
    """The distinct sentences, in order, cut as :class:`Evidence` cuts them."""
    return dict.fromkeys(tuple(s[k : k + SENTENCE_WORDS]) for d in documents for s in d for k in range(0, len(s), SENTENCE_WORDS))


class Sentences:
    """Sentences as one array of their distinct words, and the worst word of each under given values."""

    def __init__(self, sentences: list[tuple[int, ...]]):
        distinct = [sorted(set(s)) for s in sentences]
        sizes = np.array([len(s) for s in distinct], np.int64)
        self.words = np.fromiter((w for s in distinct for w in s), np.int64, int(sizes.sum()))
        self.starts = sizes.cumsum() - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def count(self, size: int) -> np.ndarray:
        return np.bincount(self.words, minlength=size).astype(np.float64)

    def worst(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each sentence's worst word, and its value; of ties the first."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0)
        own = values[self.words]
        top = np.maximum.reduceat(own, self.starts)
        hit = np.flatnonzero(own == top[self.owner])
        first = np.r_[True, self.owner[hit][1:] != self.owner[hit][:-1]]
        return self.words[hit[first]], top


def choose_landmarks(toxic: np.ndarray, clean: np.ndarray, sentences: tuple[int, int], documents: int, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that stand in toxic sentences far more often than in clean ones, the most telling first, and
    how telling they are. ``toxic`` and ``clean`` count each word's sentences, each of which counts once however often it is copied."""
    p, q = (toxic + 0.1) / (sentences[0] + 1), (clean + 0.1) / (sentences[1] + 1)
    least = max(2, math.ceil(0.01 * documents))
    gain = np.where((toxic >= least) & (p > 3 * q), toxic * np.log(p / q), 0)
    telling = [i for i in np.flatnonzero(gain) if len(words[i]) >= 3]
    picked = np.array(sorted(telling, key=lambda i: (-gain[i], words[i]))[:LANDMARKS], np.int64)
    return picked, gain[picked]


def _by_block(words: list[str], of, width: int, block: int = 4096) -> np.ndarray:
    """``of`` each block of words, in half precision, so that the driver holds two bytes a value."""
    out = np.empty((len(words), width), np.float16)
    for at in range(0, len(words), block):
        out[at : at + block] = of(words[at : at + block])
    return out


def train(toxic: list, clean: list, words: list[str], rounds: int = 6, clean_weight: float = 3.0) -> KernelMachine | None:
    """``toxic`` and ``clean``: documents as made by :class:`Documents`, whose words are ``words``."""
    known = _cut(clean)
    bad, good = Sentences([s for s in _cut(toxic) if s not in known]), Sentences(list(known))
    in_clean = good.count(len(words))
    picked, gain = choose_landmarks(bad.count(len(words)), in_clean, (len(bad.starts), len(good.starts)), len(toxic), words)
    if not len(picked):
        return None
    telling = Landmarks([words[i] for i in picked])
    near = _by_block(words, lambda part: telling.kernel(part).max(axis=1, initial=0, keepdims=True), 1)[:, 0].astype(np.float64)
    rivals = np.setdiff1d(np.flatnonzero(in_clean), picked)
    rivals = sorted(rivals, key=lambda i: (-near[i], words[i]))[:NEAREST]
    names = [words[i] for i in [*picked, *rivals]]
    landmarks = Landmarks(names)
    gram = landmarks.kernel(names).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > 1e-3
    half = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)  # Nyström: features = k(words, landmarks) @ half
    features = _by_block(words, lambda part: landmarks.kernel(part) @ half, half.shape[1])
    # First turn: a sentence with a telling word is toxic, and its most telling one speaks for it.
    worth = near - 1.0
    worth[picked] = 1 + gain / gain.max()
    spoken = np.zeros(len(words))
    weights = np.zeros(features.shape[1] + 1)
    for _ in range(rounds):
        speaker, top = bad.worst(worth)
        chosen = np.bincount(speaker[top > 0], minlength=len(words))
        spoken += np.bincount(good.worst(worth)[0], minlength=len(words))
        one, other = np.flatnonzero(chosen), np.flatnonzero(spoken)
        x = features[np.r_[one, other]]
        y = np.r_[np.ones(len(one)), -np.ones(len(other))]
        cost = np.r_[chosen[one] / max(1, chosen.sum()), clean_weight * spoken[other] / max(1, spoken.sum())] / 2
        weights = fit_machine(x, y, cost)
        worth = np.concatenate([features[at : at + 4096] @ weights[:-1].astype(np.float32) for at in range(0, len(words), 4096)]) + weights[-1]
    table = np.zeros(1 << TABLE_BITS)
    table[landmarks.codes] = landmarks.rows @ (half @ weights[:-1])
    machine = KernelMachine(table, float(weights[-1]))

    def evidence(documents: list) -> np.ndarray:
        out = [Evidence() for _ in documents]
        for e, d in zip(out, documents):
            for s in d:
                e.add(worth[s].tolist())
        return evidence_of(out)

    machine.rule = fit_rule(np.r_[evidence(toxic), evidence(clean)], np.r_[np.ones(len(toxic)), np.zeros(len(clean))])
    return machine


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = 3000, train_bytes: int = 12_000) -> KernelMachine | None:
    """Train on about ``train_docs`` / 2 documents of either label with crc32(doc_id) mod 5 <> 0; None without both.

    Documents of more than ``train_bytes`` bytes are not learned from, and of rows that repeat an id one is, so the
    driver holds at most about ``train_docs * train_bytes`` bytes of text.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("y in (0, 1)").filter(fold_of(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    sample = None
    for y, n in sizes.items():
        part = bounded_sample(known.filter(F.col("y") == y), F.col("doc_id"), n, train_docs // 2)
        sample = part if sample is None else sample.unionByName(part)
    if sample is None:
        return None
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= train_bytes)
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text").distinct().toPandas()
    rows = rows.sort_values(["y", "text"])
    bags = Documents()
    toxic, clean = ([bags.read(t) for t in rows["text"][rows["y"] == y]] for y in (1, 0))
    del rows
    return train(toxic, clean, bags.words) if toxic and clean else None


_memo: dict[str, float | None] = {}  # None: nothing is left of the word when folded, so it is not counted
_memo_of: list[int] = []


def document_scores(machine: KernelMachine | None, texts: list[str]) -> np.ndarray:
    """Probability that a text is toxic, from all its sentences. Words already seen by this worker are remembered.

    Sentences are worked on about ``SCORE_CHARS`` characters at a time, so the words held are bounded whatever the texts.
    """
    if machine is None:
        return np.zeros(len(texts))
    stamp = hash((float(machine.table.sum()), machine.bias, *machine.rule.tolist()))
    if _memo_of != [stamp]:
        _memo.clear()
        _memo_of[:] = [stamp]
    return machine.probability(evidence_of(_evidence(machine, texts)))


def _evidence(machine: KernelMachine, texts: list[str]) -> list[Evidence]:
    out = [Evidence() for _ in texts]
    held: list[tuple[int, list[str]]] = []
    chars = 0

    def flush() -> None:
        if len(_memo) > MEMO_WORDS:
            _memo.clear()
        folded: dict[str, list[str]] = {}
        for w in set().union(*(words for _, words in held)).difference(_memo):
            folded.setdefault(fold(w), []).append(w)
        names = list(folded)
        for at in range(0, len(names), 4096):
            part = names[at : at + 4096]
            for name, value in zip(part, machine.decide(part).tolist()):
                for w in folded[name]:
                    _memo[w] = value if name else None
        for i, words in held:
            values = [v for v in map(_memo.__getitem__, words) if v is not None]
            if values:
                out[i].add(values)
        held.clear()

    for i, text in enumerate(texts):
        for sentence in sentences_of(text):
            held.append((i, words_of(sentence)))
            chars += len(sentence)
            if chars > SCORE_CHARS:
                flush()
                chars = 0
    flush()
    return out


def _score_rows(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, SCORE_BYTES):
            score = document_scores(machine.value, texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, from whole texts only.

    Null and empty texts: no words, scored by the rule's constant alone. Null ids, ties and repeated rows: scored alike. If either
    label is missing nothing can be learned, and the score is 0. Empty table: no rows.
    """
    bound_batches(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **options))  # at most 2**20 weights
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    scored = rows.mapInArrow(_score_rows(machine), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay.

    Null and empty texts stay unless the rule's constant alone reaches the threshold. Null ids, ties and repeated rows:
    each row by its text. Very long texts are scored whole. No labels to learn from, or an empty table: nothing goes.
    """
    bound_batches(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **options))
    column = free_name(docs, "toxic_score")

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = by_bytes(iter([pa.RecordBatch.from_arrays([text], ["text"])]), 0, SCORE_BYTES)
        return pa.array(np.concatenate([document_scores(machine.value, texts_of(p.column(0))) for p in parts] or [np.zeros(0)]))

    return docs.withColumn(column, score("text")).filter(F.col(column) < threshold).drop(column)
