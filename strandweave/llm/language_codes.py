"""Language identification with error-correcting output codes.

Each language has a codeword. For every bit a binary classifier says which half of the
languages a text belongs to: the mean log odds of its byte trigrams (lower case, hashed to
``BUCKETS``) between the two halves. A language's loss is the sum over bits of the logistic
loss of its code bit against that margin, weighted by how far the bit's halves lie apart in
training; the codeword with the least loss wins. Two codewords with nearly the same loss mark
the answer as ambiguous.

Training counts trigrams of all training rows and keeps one number per language and bucket. Trigrams are
those of one text each, so the model does not depend on how rows are dealt to batches and partitions.
With no usable training row every text is ``und``. Text that is null or has no letter is ``und``
with score 0. Repeated rows give repeated rows, an empty table none. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import map_batches

BUCKETS = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")
#: bytes whose trigrams are looked up at once
_SLICE = 1 << 20


def buckets(text: bytes) -> np.ndarray:
    """Hashed trigrams of a byte string."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return ((b[:-2] * np.uint32(31_337) + b[1:-1] * np.uint32(257) + b[2:]) % BUCKETS).astype(np.int64)


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """``k`` rows of -1 and 1. Up to 6 classes every split is a bit; above, random splits with
    15 log2 k bits and the best smallest distance of 50 draws."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 6:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1) if -1 in rest]
        return np.array(bits, dtype=float).T
    rng, length = np.random.default_rng(seed), int(15 * np.log2(k))
    best, most = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(k, length))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        gap = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if gap > most:
            best, most = code, gap
    return best


def count_trigrams(rows: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``lang, text``."""

    def count(batch: dict[str, list]) -> dict[str, list]:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if text:
                by.setdefault(lang, []).append(text.lower().encode("utf-8", "replace"))
        out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
        for lang, texts in by.items():
            n = np.zeros(BUCKETS, np.int64)
            for text in texts:
                n += np.bincount(buckets(text), minlength=BUCKETS) if len(text) > BUCKETS else 0
            short = [t for t in texts if len(t) <= BUCKETS]
            met = buckets(b"\n".join(short))
            # no trigram reaches over the end of a text
            ends = np.cumsum([len(t) + 1 for t in short])[:-1] - 1
            over = (ends[:, None] + np.arange(-2, 1)).ravel()
            own = np.ones(len(met), bool)
            own[over[(over >= 0) & (over < len(met))]] = False
            n += np.bincount(met[own], minlength=BUCKETS)
            at = np.flatnonzero(n)
            out["lang"] += [lang] * len(at)
            out["bucket"] += at.tolist()
            out["n"] += n[at].tolist()
        return out

    counted = map_batches(rows.select("lang", "text"), count, "lang string, bucket int, n bigint")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Code, bit weights and bucket weights, fitted from trigram counts."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(max(len(self.languages), 1))
        rates = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in self.languages])
        weight, apart = [], []
        for bit in self.code.T[: len(self.code.T) if len(self.languages) > 1 else 0]:
            yes, no = rates[bit > 0].mean(axis=0), rates[bit < 0].mean(axis=0)
            odds = np.log(yes / no)
            weight.append(odds)
            apart.append(((yes - no) * odds).sum())
        self.weight = np.array(weight, dtype=np.float32).reshape(len(weight), BUCKETS).T.copy()
        self.loss_weight = np.array(apart) / np.mean(apart) if apart else np.zeros(0)

    def margins(self, text: bytes) -> np.ndarray:
        total, at = np.zeros(self.weight.shape[1]), 0
        while at < max(len(text) - 2, 1):
            total += self.weight[buckets(text[at : at + _SLICE + 2])].sum(axis=0)
            at += _SLICE
        return 8 * total / max(len(text) - 2, 1)

    def losses(self, margin: np.ndarray) -> np.ndarray:
        return (np.log1p(np.exp(-self.code * margin)) * self.loss_weight).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether two languages are about as likely."""
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(self.margins(text.lower().encode("utf-8", "replace")))
        chance = np.exp(loss.min() - loss)
        chance /= chance.sum()
        order = np.argsort(loss, kind="stable")
        return (
            self.languages[order[0]],
            float(min(1.0, chance[order[0]])),
            bool(chance[order[0]] < 2 * chance[order[1]]),
        )


def fit(rows: DataFrame) -> Model:
    """Fit on all rows of ``lang, text`` with a language."""
    counts: dict[str, np.ndarray] = {}
    # at most BUCKETS rows a language
    for lang, bucket, n in count_trigrams(rows.filter(F.col("lang").isNotNull())).toPandas().itertuples(
        index=False
    ):
        counts.setdefault(lang, np.zeros(BUCKETS))[bucket] = n
    return Model(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers

    def rows(batch: dict[str, list]) -> dict[str, list]:
        found = [shared.value.predict(t) for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"],
            "lang_pred": [x[0] for x in found],
            "score": [x[1] for x in found],
            "ambiguous": [x[2] for x in found],
        }

    return map_batches(
        docs.select("doc_id", "text"),
        rows,
        "doc_id bigint, lang_pred string, score double, ambiguous boolean",
    )
