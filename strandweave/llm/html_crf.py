"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags. Each block has features
of its ancestors (tags, words of ``class`` and ``id``) and of its text (length, links, sentence
marks). The chain scores features and neighbouring labels together; Viterbi finds the best
labels, and the blocks labelled as main text are the result.

Training pages are at most ``max_pages`` of the table, in the order of a hash of their id. Their
blocks are labelled by their landmarks (inside ``article`` or ``main`` and not inside navigation,
asides, forms, notices or comments). Each also gives pages with known labels in other layouts:
the same texts set into containers a page may use for content and for its surroundings.

Null html is empty: no text. Broken markup is read as far as it goes: open tags end with
their parents, a cut-off tag ends the page. Repeated rows give repeated rows, an empty table none.
Columns other than ``page_id, url, html`` are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import map_batches

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: elements whose content is no text of the page
_RAW = frozenset(
    "script style noscript template title svg math iframe object textarea select head audio video canvas".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: an open element of the key ends where one of these begins
_ENDS = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"},
         "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
_ENDED_BY: dict[str, list[str]] = {}
for _open, _names in _ENDS.items():
    for _name in _names:
        _ENDED_BY.setdefault(_name, []).append(_open)
_AROUND = frozenset(
    "ad ads advert advertisement sponsored promo banner sidebar nav navigation menu breadcrumb breadcrumbs footer header "
    "cookie cookies notice consent popup comment comments reply replies discussion related share social newsletter "
    "subscribe login signup form widget toolbar copyright pagination tags".split()
)


@dataclass
class Block:
    text: str
    features: list[str]
    tags: frozenset[str]
    names: frozenset[str]


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, white space turned into single spaces."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    # what is open, counted as it is opened and closed: tags that tell something, and names
    tags: Counter[str] = Counter()
    names: Counter[str] = Counter()
    around: list[str] = [""]  # the open block elements
    parts: list[str] = []
    linked = 0

    def close(to: int) -> None:
        for tag, own in stack[to:]:
            for count, keys in ((tags, (tag,)), (names, own)):
                for key in keys:
                    count[key] -= 1
                    if not count[key]:
                        del count[key]
            if tag in _BLOCK:
                around.pop()
        del stack[to:]
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            if "&" in raw:
                raw = entities.unescape(raw)
            text = " ".join(raw.split())
            if text:
                out.append(_block(text, tags, names, around[-1], linked))
        linked = 0

    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            parts.append(page[at:start])
            if tags["a"]:
                linked += start - at
        if start == end:
            break
        m = _TAG.match(page, start)
        if m is None:
            if re.match(r"</?[a-zA-Z]", page[start : start + 3]):  # a tag that never ends well
                ending = page.find(">", start)
                at = end if ending < 0 else ending + 1
            else:
                parts.append("<")
                at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1) if tags[name] else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if name not in _BLOCK and stack[i][0] in _BLOCK:
                    break
            continue
        if name in _RAW and not m[3].endswith("/"):
            ending = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
            if name in ("textarea", "select", "svg"):
                parts.append(" ")
            at = ending.end() if ending else (end if name != "head" else at)
            continue
        if name in _BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1) if any(tags[t] for t in _ENDED_BY.get(name, ())) else ():
                if name in _ENDS.get(stack[i][0], ()):
                    close(i)
                    break
                if stack[i][0] in ("table", "ul", "ol", "div", "article", "section", "td"):
                    break
        elif name in ("br", "img", "input"):
            parts.append(" ")
        if name not in _VOID:
            own = ()
            if "=" in m[3]:
                own = tuple(
                    w.lower() for x in _NAMED.finditer(m[3]) for w in _PART.findall(x[1] or x[2] or x[3] or "")
                )
            stack.append((name, own))
            tags[name] += 1
            names.update(own)
            if name in _BLOCK:
                around.append(name)
    flush()
    for i, block in enumerate(out):
        block.features.append(f"from:{min(i, 4)}")
        block.features.append(f"to:{min(len(out) - 1 - i, 3)}")
    return out


def _block(text: str, open_tags: Counter[str], open_names: Counter[str], parent: str, linked: int) -> Block:
    tags, names = frozenset(open_tags), frozenset(open_names)
    found = [f"in:{t}" for t in tags if t in _BLOCK or t == "a"]
    found += [f"named:{w}" for w in names]
    words = text.count(" ") + 1
    found.append(f"parent:{parent}")
    found.append(f"words:{min(words.bit_length(), 8)}")
    found.append(f"links:{min(4, 4 * linked // len(text))}")
    found.append(f"end:{text[-1] if text[-1] in '.!?:;,' else 'x'}")
    found.append(f"commas:{min(3, text.count(','))}")
    found.append(f"stops:{min(3, text.count('. '))}")
    if "©" in text or "·" in text or "|" in text:
        found.append("mark")
    found.append("any")
    return Block(text, found, tags, names)


def landmark_labels(page: list[Block]) -> list[int] | None:
    """1 for blocks inside the page's landmark for content and no other; None without one."""
    if not any({"article", "main"} & b.tags for b in page):
        return None
    return [
        int(
            bool({"article", "main"} & b.tags)
            and not {"nav", "aside", "footer", "form", "button", "header"} & b.tags
            and not _AROUND & b.names
        )
        for b in page
    ]


# layouts for training pages: (opening, closing) around content and around its surroundings
_CONTENT = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div id="main">', "</div>"),
    ('<section class="article-body">', "</section>"), ('<div class="entry-content">', "</div>"),
    ('<div class="story">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>"),
]
_SURROUNDINGS = [
    ("<nav><ul><li><a>", "</a></li></ul></nav>"), ("<header><div>", "</div></header>"), ("<footer><p>", "</p></footer>"),
    ('<div class="ad">', "</div>"), ('<div class="advert banner">', "</div>"), ("<aside><p>", "</p></aside>"),
    ('<div class="sidebar"><p>', "</p></div>"), ('<div class="cookie-notice">', "</div>"),
    ("<form><label>", "</label></form>"), ('<ul class="menu"><li>', "</li></ul>"), ('<div class="notice"><p>', "</p></div>"),
    ('<div class="comments"><div class="comment"><p>', "</p></div></div>"), ('<section id="comments"><p>', "</p></section>"),
    ('<div class="related"><a>', "</a></div>"), ('<div class="newsletter"><form><p>', "</p></form></div>"),
    ('<div class="share">', "</div>"), ('<div id="footer">', "</div>"), ('<div class="reader-comments"><article><p>', "</p></article></div>"),
]


def laid_out(content: list[str], around: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page of these texts in a random layout, with the label of each text."""
    pages, labels = [], []

    def surroundings(most: int) -> None:
        for _ in range(rng.randint(0, most)):
            left, right = rng.choice(_SURROUNDINGS)
            pages.append(left + entities.escape(rng.choice(around)) + right)
            labels.append(0)

    surroundings(3)
    left, right = rng.choice(_CONTENT)
    pages.append(left)
    if rng.random() < 0.7:
        pages.append(f"<h1>{entities.escape(content[0])}</h1>")
        labels.append(1)
    tag = rng.choice(["p", "p", "p", "div", "li", "blockquote"])
    for text in content[1:] or content:
        pages.append(f"<{tag}>{entities.escape(text)}</{tag}>")
        labels.append(1)
        if rng.random() < 0.08:
            inner = rng.choice(_SURROUNDINGS)
            pages.append(inner[0] + entities.escape(rng.choice(around)) + inner[1])
            labels.append(0)
    if rng.random() < 0.3:
        surroundings(2)
    pages.append(right)
    surroundings(3)
    return f"<html><body>{''.join(pages)}</body></html>", labels


@dataclass
class Crf:
    """Weights of features for the label 1, and of neighbouring and first labels."""

    weight: dict[str, float]
    step: list[list[float]]
    first: list[float]

    def decode(self, page: list[Block]) -> list[int]:
        """The best labels (Viterbi)."""
        if not page:
            return []
        w, (s00, s01), (s10, s11) = self.weight.get, *self.step
        zero, one = self.first
        one += sum([w(f, 0.0) for f in page[0].features])
        back: list[tuple[int, int]] = []
        for block in page[1:]:
            own = sum([w(f, 0.0) for f in block.features])
            to0 = (0, zero + s00) if zero + s00 >= one + s10 else (1, one + s10)
            to1 = (0, zero + s01) if zero + s01 > one + s11 else (1, one + s11)
            back.append((to0[0], to1[0]))
            zero, one = to0[1], to1[1] + own
        labels = [int(one > zero)]
        for before in reversed(back):
            labels.append(before[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 160, ridge: float = 5e-4) -> Crf:
    """Maximum likelihood with a ridge, by Adam; all pages go forward and backward together."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for page, _ in pages for b in page for f in b.features})
    number = {f: i for i, f in enumerate(names)}
    longest = max(len(p) for p, _ in pages)
    n = len(pages)
    y, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    owner, feature = [], []
    for i, (page, labels) in enumerate(pages):
        y[i, : len(page)], real[i, : len(page)] = labels, True
        for j, b in enumerate(page):
            owner += [i * longest + j] * len(b.features)
            feature += [number[f] for f in b.features]
    owner, feature = np.array(owner), np.array(feature)
    size = len(names) + 6
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    both = real[:, 1:]

    def soft(a, b):
        top = np.maximum(a, b)
        return top + np.log(np.exp(a - top) + np.exp(b - top))

    for t in range(1, rounds + 1):
        emit = np.bincount(owner, theta[feature], minlength=n * longest).reshape(n, longest)
        score = np.stack([np.zeros_like(emit), emit], axis=2)
        step, first = theta[-6:-2].reshape(2, 2), theta[-2:]
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = first + score[:, 0]
        for j in range(1, longest):
            for b in (0, 1):
                new = soft(ahead[:, j - 1, 0] + step[0, b], ahead[:, j - 1, 1] + step[1, b]) + score[:, j, b]
                ahead[:, j, b] = np.where(real[:, j], new, ahead[:, j - 1, b])
        behind = np.zeros((n, longest, 2))
        for j in range(longest - 2, -1, -1):
            for a in (0, 1):
                new = soft(*(step[a, b] + score[:, j + 1, b] + behind[:, j + 1, b] for b in (0, 1)))
                behind[:, j, a] = np.where(real[:, j + 1], new, 0.0)
        total = soft(ahead[:, -1, 0], ahead[:, -1, 1])
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * real
        grad = np.zeros(size)
        grad[: len(names)] = np.bincount(feature, (y * real - one).ravel()[owner], minlength=len(names))
        for a in (0, 1):
            for b in (0, 1):
                pair = ahead[:, :-1, a] + step[a, b] + score[:, 1:, b] + behind[:, 1:, b] - total[:, None]
                hoped = (np.exp(np.minimum(pair, 0)) * both).sum()
                grad[-6 + 2 * a + b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() - hoped
        begin = np.exp(ahead[:, 0] + behind[:, 0] - total[:, None]).sum(axis=0)
        grad[-2:] = [(y[:, 0] == 0).sum() - begin[0], (y[:, 0] == 1).sum() - begin[1]]
        grad = grad / n - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf(
        {f: float(theta[i]) for f, i in number.items()}, theta[-6:-2].reshape(2, 2).tolist(), theta[-2:].tolist()
    )


def labelled_pages(sample: list[str | None], most_blocks: int = 200) -> list[tuple[list[Block], list[int]]]:
    """Training pages from a sample: each as it is, by its landmarks, and in three other layouts."""
    out, rng = [], random.Random(17)
    for page in sample:
        own = blocks(page)
        labels = landmark_labels(own)
        if labels is None or len(own) > most_blocks:
            continue
        out.append((own, labels))
        content = [b.text for b, y in zip(own, labels, strict=True) if y]
        around = [b.text for b, y in zip(own, labels, strict=True) if not y]
        if content and around:
            for _ in range(3):
                text, known = laid_out(content[:30], around, rng)
                found = blocks(text)
                if len(found) == len(known):
                    out.append((found, known))
    return out


def fit(pages: DataFrame, max_pages: int = 240) -> Crf:
    sample = (
        pages.filter(F.col("html").isNotNull())
        .select("page_id", "html")
        .orderBy(F.xxhash64("page_id"), "page_id", "html")
        .limit(max_pages)
        .collect()
    )
    found = labelled_pages([r["html"] for r in sample])
    if not found:  # no page with a landmark: layouts alone still teach the containers
        rng = random.Random(17)
        for _ in range(400):
            text, known = laid_out(["A line of text, with a stop."] * 4, ["Menu", "Other line."], rng)
            made = blocks(text)
            if len(made) == len(known):
                found.append((made, known))
    return train(found)


def main_text(crf: Crf, page: str | None) -> tuple[str, int, int]:
    """The main text, how many blocks it has and how many the page has."""
    own = blocks(page)
    labels = crf.decode(own)
    kept = [b.text for b, y in zip(own, labels, strict=True) if y]
    return "\n".join(kept), len(kept), len(own)


def extract(pages: DataFrame, crf: Crf) -> DataFrame:
    """``page_id, url, text, n_chars, n_main, n_blocks`` for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(crf)

    def rows(batch: dict[str, list]) -> dict[str, list]:
        found = [main_text(shared.value, h) for h in batch["html"]]
        return {
            "page_id": batch["page_id"],
            "url": batch["url"],
            "text": [x[0] for x in found],
            "n_chars": [len(x[0]) for x in found],
            "n_main": [x[1] for x in found],
            "n_blocks": [x[2] for x in found],
        }

    return map_batches(
        pages.select("page_id", "url", "html"),
        rows,
        "page_id bigint, url string, text string, n_chars bigint, n_main int, n_blocks int",
    )
