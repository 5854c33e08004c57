"""Toxicity by weak supervision.

Voters look at a text and vote toxic, clean or abstain: fixed lexicons of
insults in four languages, patterns, and lexicons mined from the labelled
sample (words and word beginnings that occur far more often in texts labelled
toxic). A generative label model estimates by EM how often each voter gives
each vote under either class. The correlations of the votes that the class
does not explain group the voters, and a group's evidence counts as that of
its effective number of independent voters. The posterior labels train a
linear classifier on the rates of words and word beginnings, which scores
every text.

Only the bounded sample reaches the driver; the model has a fixed size.

Rows: null and empty texts get the score of a text without any evidence;
repeated rows get equal scores; an empty table or no labels at all give the
scores of the fixed lexicons alone; extra columns are ignored or, in
``drop_toxic``, kept.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assetloom.llm.arrow import bound_batches, give_back, map_chunks
from assetloom.llm.labelled import fold, labelled_sample

FOLDS, HELD_OUT = 5, 0
SAMPLE = 4_000
CUT = 0.5
MINED = 48
FEATURES = 1_500
WORD_CACHE = 100_000
#: Rate of a mined feature at which its voter speaks.
DENSE = 0.008
WORD = re.compile(r"\w+")
#: A word's beginnings of these lengths are features, besides the word itself.
STEMS = range(4, 9)
#: Hashed features.
BUCKETS = 1 << 20

#: Fixed word lists of the lexicon voters.
LEXICONS = {
    "person": "idiot idiots moron morons imbecile fool fools loser losers clown clowns dumbass jerk jerks creep creeps freak freaks",
    "slight": "stupid dumb pathetic worthless disgusting useless ridiculous brainless hopeless repulsive vile filthy",
    "waste": "trash garbage scum filth vermin pig pigs rat rats cockroach parasite parasites",
    "curse": "damn bastard bastards bitch asshole crap shit bullshit fuck fucking",
    "threat": "kill hurt destroy die hate burn hang beat punish",
    "spanish": "idiota imbécil estúpido estúpida tonto basura inútil patético asqueroso escoria payaso",
    "french": "idiot idiote imbécile stupide crétin ordure minable pathétique dégoûtant débile salaud clown",
    "german": "idiot dumm dummkopf trottel abschaum erbärmlich wertlos müll ekelhaft versager arschloch",
}
PATTERNS = {
    "insult-address": re.compile(r"\b(?:you|your|tu|du|vous|eres)\b(?:\s+\w+){0,3}\s+(?:stupid|dumb|idiot\w*|moron|loser|trash|scum|pathetic|worthless)\b", re.I),
    "shouting": re.compile(r"!{3,}"),
    "masked": re.compile(r"\b\w[*@#$%]{2,}\w\b"),
}


def stems(word: str) -> list[int]:
    """Hashed features of a word: itself, and its beginnings marked as such."""
    whole = word.encode()
    return [crc32(whole) % BUCKETS, *(crc32(word[:n].encode(), 1) % BUCKETS for n in STEMS if len(word) >= n)]


class Sample:
    """The sample's distinct texts as rates of hashed features, by feature.

    ``rows(f)`` and ``hits(f)`` are the texts with feature ``f`` and how often
    each has it. Texts themselves are not kept.
    """

    def __init__(self, texts: list[str], labels: list[int]):
        first: dict[str, int] = {}
        for text, label in zip(texts, labels):
            first[text] = max(first.get(text, 0), label)
        self.y = np.array(list(first.values()), float)
        listed = {name: set(words.split()) for name, words in LEXICONS.items()}
        of_word: dict[str, array] = {}
        doc, feature, count, words = array("i"), array("i"), array("i"), []
        lexicon, pattern = [], []
        for i, text in enumerate(first):
            counts = Counter(WORD.findall(text.lower()))
            words.append(max(1, counts.total()))
            lexicon.append([sum(counts[w] for w in own if w in counts) for own in listed.values()])
            pattern.append([1 if p.search(text) else 0 for p in PATTERNS.values()])
            for word, n in counts.items():
                own = of_word.get(word)
                if own is None:
                    if len(of_word) > WORD_CACHE:
                        of_word.clear()
                    own = of_word[word] = array("i", stems(word))
                feature.extend(own)
                doc.extend([i] * len(own))
                count.extend([n] * len(own))
        self.n = len(first)
        self.words = np.array(words, float)
        self.lexicon, self.pattern = np.array(lexicon, float).reshape(self.n, -1), np.array(pattern, int).reshape(self.n, -1)
        key = np.frombuffer(feature, np.int32).astype(np.int64) * self.n + np.frombuffer(doc, np.int32)
        del feature, doc, of_word
        order = np.argsort(key)
        key, count = key[order], np.frombuffer(count, np.int32)[order]
        del order
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
        self.count = np.add.reduceat(count, begin) if len(begin) else np.empty(0, np.int32)
        key = key[begin]
        self.doc, owner = (key % self.n).astype(np.int32), (key // self.n).astype(np.int32)
        self.starts = np.searchsorted(owner, np.arange(BUCKETS + 1))

    def rows(self, f: int) -> np.ndarray:
        return self.doc[self.starts[f] : self.starts[f + 1]]

    def hits(self, f: int) -> np.ndarray:
        return self.count[self.starts[f] : self.starts[f + 1]]


def ranked_features(sample: Sample, target: np.ndarray) -> list[tuple[float, int]]:
    """Features by how sure it is that their rate differs between the classes, the surest first."""
    used = np.flatnonzero(np.diff(sample.starts) >= 4)
    owner = np.repeat(np.arange(BUCKETS), np.diff(sample.starts))
    rate = np.minimum(sample.count / sample.words[sample.doc], 0.05)
    t = target[sample.doc]
    total = np.array([(1 - target).sum(), target.sum()]) + 1
    sums = lambda w: np.bincount(owner, w, BUCKETS)[used]
    share = [(sums(1 - t) + 0.5) / total[0], (sums(t) + 0.5) / total[1]]
    sure = np.abs(share[1] - share[0]) / np.sqrt(sum(x * (1 - np.minimum(x, 0.99)) / n for x, n in zip(share, total)))
    lift = np.log((sums(rate * t) / total[1] + 1e-6) / (sums(rate * (1 - t)) / total[0] + 1e-6))
    gain = lift * sure
    order = np.lexsort((used, -np.abs(gain)))
    return list(zip(gain[order].tolist(), used[order].tolist()))


def mine(sample: Sample, ranked: list[tuple[float, int]], size: int, enough: int = 3) -> list[int]:
    """Toxic features for voters: the surest ones that still reach texts with fewer than ``enough`` of them."""
    covered = np.zeros(sample.n, int)
    out: list[int] = []
    seen: set[bytes] = set()
    for gain, f in ranked:
        if gain <= 0 or len(out) == size:
            continue
        at = sample.rows(f)
        dense = at[sample.hits(f) / sample.words[at] >= DENSE]
        hits = dense[sample.y[dense] > 0]
        if len(hits) >= 4 and dense.tobytes() not in seen and 2 * len(hits) > len(dense) and (covered[hits] < enough).mean() >= 0.3:
            out.append(f)
            seen.add(dense.tobytes())
            covered[hits] += 1
    return out


def votes(sample: Sample, mined: list[int]) -> np.ndarray:
    """Matrix of votes: 1 toxic, -1 clean, 0 abstains."""
    columns = [np.where(sample.lexicon >= 1, 1, 0), sample.pattern]
    any_hit = sample.lexicon.sum(axis=1)
    for f in mined:
        hits = np.zeros(sample.n)
        hits[sample.rows(f)] = sample.hits(f)
        any_hit += hits
        columns.append(np.where((hits >= 1) & (hits / sample.words >= DENSE), 1, 0))
    rate = any_hit / sample.words
    columns += [np.where((rate >= 1.5 * DENSE) & (any_hit >= 2), 1, 0), np.where(any_hit == 0, -1, 0), np.where((any_hit > 0) & (rate < DENSE), -1, 0)]
    return np.column_stack(columns)


class LabelModel:
    """Class-conditional votes by EM; correlated voters share their evidence."""

    def __init__(self, rounds: int = 200, linked: float = 0.35, settled: float = 1e-4):
        self.rounds, self.linked, self.settled = rounds, linked, settled

    def fit(self, v: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Posterior of class 1 per row. ``start`` begins the EM (labels or a guess)."""
        n, m = v.shape
        one_hot = np.stack([v == k for k in (-1, 0, 1)], axis=2).astype(float)
        p = np.clip(start, 0.02, 0.98)
        self.share = np.ones(m)
        for step in range(self.rounds):
            both = np.stack([1 - p, p])
            prior = np.clip(both.sum(axis=1) / n, 0.01, 0.99)
            table = np.einsum("cn,nmk->cmk", both, one_hot) + 0.5
            self.table = table / table.sum(axis=2, keepdims=True)
            if step in (0, 10):
                self.share = self._shares(v, p)
            ratio = np.log(self.table[1]) - np.log(self.table[0])
            z = math.log(prior[1] / prior[0]) + np.einsum("nmk,mk,m->n", one_hot, ratio, self.share)
            last, p = p, 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            if step > 10 and np.abs(p - last).max() < self.settled:
                break
        self.prior = prior
        return p

    def _shares(self, v: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Weight of each voter: one over the effective size of its correlated group."""
        left = v.astype(float)
        for weight in (p, 1 - p):
            left -= weight[:, None] * (weight[:, None] * v).sum(axis=0) / max(weight.sum(), 1e-9)
        scale = np.sqrt((left**2).mean(axis=0)) + 1e-9
        self.correlation = np.abs((left.T @ left) / len(v) / np.outer(scale, scale))
        near = np.where(self.correlation > self.linked, self.correlation, 0.0)
        np.fill_diagonal(near, 1.0)
        return 1 / near.sum(axis=1)


class Linear:
    """Logistic score of the rates of words, as one weight per feature."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        value = self.known[word] = sum(self.weights.get(f, 0.0) for f in stems(word))
        return value

    def score(self, text: str) -> float:
        words = WORD.findall(text.lower())
        known, total = self.known, 0.0
        for w in words:
            value = known.get(w)
            total += self.word(w) if value is None else value
        z = self.bias + 100 * total / max(1, len(words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train_linear(sample: Sample, chosen: list[int], target: np.ndarray, rounds: int = 400, l2: float = 2e-4) -> Linear:
    """Logistic regression on soft labels by accelerated gradient steps."""
    rows = np.concatenate([sample.rows(f) for f in chosen])
    cols = np.repeat(np.arange(len(chosen)), [len(sample.rows(f)) for f in chosen])
    vals = 100 * np.minimum(np.concatenate([sample.hits(f) for f in chosen]) / sample.words[rows], 0.05)
    n, k = len(target), len(chosen)
    spread = np.sqrt(np.bincount(cols, vals**2, k) / n) + 0.05
    vals = vals / spread[cols]
    prior = np.clip(target.mean(), 0.01, 0.99)
    w, b, last_w, last_b = np.zeros(k), math.log(prior / (1 - prior)), np.zeros(k), math.log(prior / (1 - prior))
    # steps below the inverse of the curvature's bound, found by power iteration
    u = np.ones(k)
    for _ in range(12):
        u = np.bincount(cols, vals * np.bincount(rows, vals * u[cols], n)[rows], k)
        top = np.linalg.norm(u)
        u /= top
    rate = 1 / (0.25 * (top / n + 1) + l2)
    for step in range(rounds):
        pull = step / (step + 3)
        yw, yb = w + pull * (w - last_w), b + pull * (b - last_b)
        z = np.bincount(rows, vals * yw[cols], n) + yb
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        last_w, last_b = w, b
        w = yw - rate * (np.bincount(cols, vals * err[rows], k) / n + l2 * yw)
        b = yb - rate * err.mean()
    return Linear(dict(zip(chosen, (w / spread).tolist())), float(b))


def lexicon_model() -> Linear:
    """The scorer without a sample: any insult of the fixed lists."""
    words = {w for name, x in LEXICONS.items() if name != "threat" for w in x.split()}
    return Linear({stems(w)[0]: 4.0 for w in words}, -3.0)


def fit(texts: list[str], labels: list[int], mined: int = MINED, features: int = FEATURES) -> Linear:
    """The linear classifier of a labelled sample; see the module's text."""
    if len(set(labels)) < 2:
        return lexicon_model()
    sample = Sample(texts, labels)
    if len(set(sample.y)) < 2:
        return lexicon_model()
    v = votes(sample, mine(sample, ranked_features(sample, sample.y), mined))
    # the given label is a voter too, with an accuracy of its own
    v = np.column_stack([v, np.where(sample.y > 0, 1, -1)])
    posterior = LabelModel().fit(v, sample.y)
    chosen = [f for gain, f in ranked_features(sample, posterior) if gain][:features]
    return train_linear(sample, chosen, posterior) if chosen else lexicon_model()


def _scorer(weights: dict[str, float], bias: float):
    def make():
        model = Linear(weights, bias)

        def step(batch):
            texts = batch.column("text").to_pylist()
            return {"doc_id": batch.column("doc_id"), "score": [model.score(t or "") for t in texts]}

        return step

    return make


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Linear:
    return fit(*labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, sample))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Return ``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    ``sample`` bounds the labelled rows that train; rows of the held-out fold
    never do.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_documents(given, labels, sample)
    scored = map_chunks(given, _scorer(model.weights, model.bias), "doc_id long, score double")
    held_out = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose text scores at or above the cut."""
    model = fit_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, sample)
    weights, bias = model.weights, model.bias

    def run(batches):
        scorer = Linear(weights, bias)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([scorer.score(t or "") < CUT for t in texts], pa.bool_()))
        del scorer
        give_back()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
