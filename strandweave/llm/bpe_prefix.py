"""Exact BPE by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last one of its encoding: the token
that ends there and is compatible with the last token of the prefix before it. So one pass
stores the last token of each prefix, and following these back gives the ids.

* Tokens that end at a place come from an automaton of all vocabulary strings with suffix links.
* Two tokens are compatible when no merge across their boundary would come before the merges
  that build them. Each token is built in a few merges, so the test replays both in the order
  of merge ranks.
* A token that its own string does not encode to can never occur and is left out.

Words recur, so each worker stores the answers for the first ``LIMIT`` words and runs without
white space it meets; others are encoded each time. Null text counts as empty: no ids, empty decoded text. Repeated rows give
repeated rows, an empty table none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

from pyspark.sql import DataFrame

from strandweave.llm.common import map_batches
from strandweave.llm.wordpieces import byte_letters

LIMIT = 350_000
_END = "</w>"
_NEVER = 1 << 60
_LAST = 0xE000  # a word's last letter with its end mark, as one symbol
#: white space as the library sees it; ``str.split`` also takes the separators \x1c to \x1f
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATOR = re.compile("[\x1c-\x1f]")
_OPEN: dict[str, "PrefixBpe"] = {}


class PrefixBpe:
    """Encoder and decoder for a vocabulary with word ends, lower case and dropped white space."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.id_of = model["vocab"]
        self.token_of = {i: t for t, i in self.id_of.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pattern = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.words = regex.compile(pattern)
        self.letters = byte_letters()
        # symbols: a base letter, or a last letter moved to a range of its own
        self.rank: dict[tuple[str, str], int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault((self._folded(a), self._folded(b)), r)
        self._chains()
        self.matches = ahocorasick.Automaton()
        for text, i in self.known.items():
            self.matches.add_word(text, (len(text), i))
        self.matches.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words_met: dict[str, tuple[int, str, str]] = {}
        self.chunks_met: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def _folded(token: str) -> str:
        if token.endswith(_END) and len(token) > len(_END):
            body = token[: -len(_END)]
            return body[:-1] + chr(_LAST + ord(body[-1]))
        return token

    def _merged(self, text: str) -> list[tuple[int, str, str]] | None:
        """How ``text`` becomes one token, or None: the first and last symbol before each merge
        with that merge's rank, and those at the end with a rank above all."""
        parts, steps = list(text), []
        while len(parts) > 1:
            r, i = min(
                (self.rank.get((a, b), _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
            )
            if r == _NEVER:
                return None
            steps.append((r, parts[0], parts[-1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [*steps, (_NEVER, parts[0], parts[0])]

    def _chains(self) -> None:
        self.known, self.steps = {}, {}
        for token, i in self.id_of.items():
            text = self._folded(token)
            steps = self._merged(text)
            if steps is not None:
                self.known[text] = i
                self.steps[i] = steps

    def _joinable(self, first: int, second: int) -> bool:
        """Whether ``first`` and ``second`` stay two tokens when they stand side by side.

        Each builds itself in its own order; of all merges possible the lowest rank comes next,
        and of equal ranks the leftmost. They stay apart unless a merge over the boundary comes up.
        """
        key = first, second
        answer = self.compatible.get(key)
        if answer is None:
            a, b, i, j = self.steps[first], self.steps[second], 0, 0
            while True:
                own, _, x = a[i]
                other, y, _ = b[j]
                over = self.rank.get((x, y), _NEVER)
                if over < own and over <= other:
                    answer = False
                    break
                if own == other == _NEVER:
                    answer = True
                    break
                if own <= other:
                    i += 1
                else:
                    j += 1
            if len(self.compatible) < 4 * LIMIT:
                self.compatible[key] = answer
        return answer

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in byte letters."""
        text = word[:-1] + chr(_LAST + ord(word[-1]))
        last: list[int] = [-1] * (len(text) + 1)
        size: list[int] = [0] * (len(text) + 1)
        for end, (n, token) in self.matches.iter(text):
            end += 1
            before = end - n
            if last[end] < 0 and (before == 0 or (last[before] >= 0 and self._joinable(last[before], token))):
                last[end], size[end] = token, n
        if last[-1] < 0:
            raise ValueError(f"no compatible tokens for {word!r}")
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.encode_word(word.encode().decode("latin-1").translate(self.letters))
        found = len(ids), " ".join(map(str, ids)), " ".join([self.token_of[i] for i in ids])
        if len(self.words_met) < LIMIT and len(word) <= 64:
            self.words_met[word] = found
        return found

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, ids and tokens of a run without white space."""
        if chunk.isalpha():
            return self.words_met.get(chunk) or self._word(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,":
            words = [chunk[:-1], chunk[-1]]
        else:
            words = self.words.findall(chunk)
        each = [self.words_met.get(w) or self._word(w) for w in words]
        found = sum([x[0] for x in each]), " ".join([x[1] for x in each]), " ".join([x[2] for x in each])
        if len(self.chunks_met) < LIMIT // 2 and len(chunk) <= 64:
            self.chunks_met[chunk] = found
        return found

    def coded(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal and the decoded text, both joined by one space."""
        if not text:
            return 0, "", ""
        parts = self.split_special.split(text) if "<|" in text else [text]
        found: list[tuple[int, str, str]] = []
        for part in parts:
            if part in self.special:
                found.append((1, str(self.special[part]), part))
                continue
            if not part.isascii():
                # letter by letter: no rule here looks at a letter's neighbours
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            chunks = _SPACE.split(part) if _SEPARATOR.search(part) else part.split()
            met, chunk_of = self.chunks_met.get, self._chunk
            found += [met(c) or chunk_of(c) for c in chunks if c]
        found = [x for x in found if x[0]]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.coded(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)


def codec(path: str) -> PrefixBpe:
    """The worker's codec of a vocabulary file, built once per process."""
    if path not in _OPEN:
        _OPEN[path] = PrefixBpe(path)
    return _OPEN[path]


def encode_documents(docs: DataFrame, vocabulary: str, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``ids`` the ids and decoded text too."""
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>, decoded string" if ids else ""
    )

    def rows(batch: dict[str, list]) -> dict[str, list]:
        code = codec(vocabulary)
        found = [code.coded(t) for t in batch["text"]]
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        out = {
            "doc_id": batch["doc_id"],
            "n_tokens": [x[0] for x in found],
            "ids_sha256": [sha(x[1]) for x in found],
            "decoded_sha256": [sha(x[2]) for x in found],
        }
        if ids:
            out["ids"] = [[int(i) for i in x[1].split()] for x in found]
            out["decoded"] = [x[2] for x in found]
        return out

    return map_batches(docs.select("doc_id", "text"), rows, ddl)
