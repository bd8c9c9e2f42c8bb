"""Toxicity scores from a lexicon that also matches misspelled terms, in context.

* The lexicon is learned: words, and word beginnings of 5 to 7 letters, whose document frequency
  in labelled toxic texts is far above that in clean ones: all of them, so that its size is bounded by
  the labelled rows' words.
* A text's words meet the lexicon directly, by their beginning, or misspelled: a Levenshtein
  automaton of the word (bit-parallel, one error) runs through the trie of the terms. All whole
  terms are in it but weak ones under 5 letters, as those are one error away from too many words.
* Each hit is seen in its context: a window of words around it that adds up the weights of other
  hits, and whether it stands inside quotation marks, however long the quotation, or after a word of reporting.
* A logistic regression on these few numbers gives the score.

Labels are learned from at most ``max_rows`` labelled rows, in the order of a hash of the id.
A text without words, null text included, gets the score of no hits. With no labelled row, or
only one class, every score is that class's rate (0 without rows). Repeated rows give repeated
rows, an empty table none. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import ddl_of, map_batches
from strandweave.plans.settle import table

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = "\"“”„«»‘’‹›"
_REPORTING = frozenset({"said", "wrote", "quoted", "called", "quote", "says", "write", "writes"})
_WINDOW = 10
#: weight above which a term is strong
_STRONG = 3
#: words a worker remembers; more are matched each time
_LIMIT = 300_000


def _prefixes(word: str) -> list[str]:
    return [word[:k] + "*" for k in (5, 6, 7) if len(word) > k]


@dataclass
class Lexicon:
    """Term weights, and tries of the whole words, those under 5 letters if they are strong.

    A single error leaves one half of a term untouched, so ``front`` holds, for each first half,
    the trie of the second halves, and ``back``, for each second half, the trie of the first
    halves read backwards. The automaton then runs over the other half only.
    """

    weight: dict[str, float]
    front: dict[str, dict] = field(default_factory=dict)
    back: dict[str, dict] = field(default_factory=dict)
    lengths: frozenset[int] = frozenset()
    met: dict[str, tuple[float, bool]] = field(default_factory=dict)

    @classmethod
    def build(cls, weight: dict[str, float], fuzzy_terms: int | None = None) -> "Lexicon":
        whole = [t for t in weight if not t.endswith("*") and (len(t) >= 5 or weight[t] > _STRONG)]
        tried = sorted(whole, key=lambda t: (-weight[t], t))[:fuzzy_terms]
        front: dict[str, dict] = {}
        back: dict[str, dict] = {}
        for term in tried:
            half = len(term) // 2
            for tries, key, rest in (
                (front, term[:half], term[half:]),
                (back, term[half:], term[:half][::-1]),
            ):
                node = tries.setdefault(key, {})
                for c in rest:
                    node = node.setdefault(c, {})
                node[""] = term
        return cls(weight, front, back, frozenset(len(t) + d for t in tried for d in (-1, 0, 1)))

    def __getstate__(self):
        return self.__dict__ | {"met": {}}

    def misspelled(self, word: str) -> str | None:
        """The heaviest term within one insertion, deletion or substitution of ``word``."""
        n, found = len(word), []
        for length in (n - 1, n, n + 1):
            half = length // 2
            trie = self.front.get(word[:half])
            if trie is not None:
                found += within_one(trie, word[half:])
            rest = length - half
            trie = self.back.get(word[n - rest :]) if rest <= n else None
            if trie is not None:
                found += within_one(trie, word[: n - rest][::-1])
        return max(found, key=lambda t: (self.weight[t], t), default=None)

    def look(self, word: str) -> tuple[float, bool]:
        """Weight of a lower-case word (0 if it is no hit) and whether it was misspelled."""
        found = self.met.get(word)
        if found is None:
            own = self.weight.get(word)
            if own is not None:
                found = own, False
            else:
                starts = [self.weight[p] for p in _prefixes(word) if p in self.weight]
                term = self.misspelled(word) if len(word) in self.lengths else None
                if term is not None:
                    found = self.weight[term], True
                else:
                    found = (max(starts), False) if starts else (0.0, False)
            if len(self.met) < _LIMIT:
                self.met[word] = found
        return found


def within_one(trie: dict, word: str) -> list[str]:
    """Terms of a trie at most one insertion, deletion or substitution away: its intersection with
    the Levenshtein automaton of ``word``. Bit i of a state says that i letters of the word are
    read, with no error or with at most one."""
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        at[c] = at.get(c, 0) | (1 << i)
    accept, found = 1 << len(word), []
    stack = [(trie, 1, 0b11 & (2 * accept - 1))]
    while stack:
        node, none, one = stack.pop()
        for c, child in node.items():
            if c == "":
                if (none | one) & accept:
                    found.append(child)
                continue
            mask = at.get(c, 0)
            none_next = (none & mask) << 1
            one_next = (((one & mask) << 1) | (none << 1) | none | (none_next << 1)) & (2 * accept - 1)
            if none_next or one_next:
                stack.append((child, none_next, one_next))
    return found


def features(lexicon: Lexicon, text: str | None) -> list[float]:
    """Numbers a text is judged by; all 0 but the length where nothing hits."""
    words = _WORD.findall((text or "").lower())
    get, look = lexicon.met.get, lexicon.look
    hits = []
    for i, w in enumerate(words):
        found = get(w) or look(w)
        if found[0]:
            hits.append((i, *found))
    if not hits:
        return [0.0] * 7 + [float(np.log1p(len(words)))]
    quoted = _quoted(text, {words[i] for i, _, _ in hits})
    total = top = aside = 0.0
    strong = fuzzy = 0
    first = 0
    for n, (i, weight, wrong) in enumerate(hits):
        while hits[first][0] < i - _WINDOW:
            first += 1
        near = sum(h[1] for h in hits[first : n + 1])
        reported = words[i] in quoted or any(w in _REPORTING for w in words[max(0, i - 4) : i])
        aside += weight if reported else 0.0
        total += weight
        top = max(top, 0.0 if reported else near)
        strong += weight > _STRONG and not wrong
        fuzzy += wrong
    return [
        float(np.log1p(strong)),
        float(np.log1p(total)),
        float(np.log1p(top)),
        float(np.log1p(aside)),
        float(np.log1p(fuzzy)),
        float(max(h[1] for h in hits)),
        float(np.log1p(100 * total / len(words))),
        float(np.log1p(len(words))),
    ]


def _quoted(text: str, words: set[str]) -> set[str]:
    """Those of ``words`` that stand inside quotation marks wherever they occur."""
    if not any(q in text for q in _QUOTES):
        return set()
    low = text.lower()
    inside = {
        w for part in re.findall(r"[\"“„«][^\"”“«»]+[\"”“»]", low) for w in _WORD.findall(part)
    }
    outside = set(_WORD.findall(re.sub(r"[\"“„«][^\"”“«»]+[\"”“»]", " ", low)))
    return (inside - outside) & words


def term_counts(labelled: DataFrame) -> DataFrame:
    """``term, bad, good``: in how many toxic and other texts each term occurs."""

    def count(batch: dict[str, list]) -> dict[str, list]:
        by = (Counter(), Counter())
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = set(_WORD.findall((text or "").lower()))
            by[1 if toxic == 1 else 0].update(words.union(*map(_prefixes, words)))
        terms = list(by[1].keys() | by[0].keys())
        return {"term": terms, "bad": [by[1][t] for t in terms], "good": [by[0][t] for t in terms]}

    counted = map_batches(labelled.select("text", "toxic"), count, "term string, bad bigint, good bigint")
    return counted.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    rate: float

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return self.rate
        z = float(np.dot(features(self.lexicon, text), self.weights[:-1]) + self.weights[-1])
        return 1.0 / (1.0 + float(np.exp(-max(-30.0, min(30.0, z)))))


def regression(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept. The ridge acts on
    standardised columns, so one that never changes in training has no weight."""
    middle, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = np.inf
    rows = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve(
            (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w)), rows.T @ (y - p) - ridge * w
        )
        w += step
        if np.abs(step).max() < 1e-6:
            break
    scaled = w[:-1] / spread
    return np.append(scaled, w[-1] - scaled @ middle)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 12_000,
    least: int = 4,
    odds: float = 4.0,
) -> Model:
    """Learn from rows of ``docs`` (``doc_id, text``) with a label (``doc_id, toxic``)."""
    spark = docs.sparkSession
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    chosen = table(chosen, "labelled-ids")
    rows = table(docs.select("doc_id", "text").join(chosen, "doc_id"), "labelled")
    sizes = {r["toxic"] == 1: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(True, 0), sum(n for t, n in sizes.items() if not t)
    if not bad or not good:
        return Model(Lexicon.build({}), np.zeros(0), float(bool(bad)))
    ratio = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    best = (
        term_counts(rows)
        .withColumn("weight", F.log(ratio))
        .filter((F.col("bad") >= least) & (ratio >= odds))
        .select("term", "weight")
        .collect()
    )
    lexicon = Lexicon.build({r["term"]: float(r["weight"]) for r in best})
    shared = spark.sparkContext.broadcast(lexicon)  # words of max_rows texts

    def measure(batch: dict[str, list]) -> dict[str, list]:
        return {
            "x": [features(shared.value, t) for t in batch["text"]],
            "y": [1.0 if t == 1 else 0.0 for t in batch["toxic"]],
        }

    # max_rows rows of a few numbers
    seen = map_batches(rows.select("text", "toxic"), measure, "x array<double>, y double").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen])
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order rows arrive in
    return Model(lexicon, regression(x[order], y[order]), bad / (bad + good))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` added, by the columns ``doc_id`` and ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: dict[str, list]) -> dict[str, list]:
        scores = [shared.value.score(t) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id bigint, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def rows(batch: dict[str, list]) -> dict[str, list]:
        stay = [shared.value.score(t) < threshold for t in batch["text"]]
        return {n: [v for v, s in zip(batch[n], stay, strict=True) if s] for n in names}

    return map_batches(docs, rows, ddl_of(docs))
