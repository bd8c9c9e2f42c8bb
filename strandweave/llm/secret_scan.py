"""Secrets in texts: patterns find candidates, structure confirms more of them.

Base spans are pattern matches (``assign``, ``access``, ``hex``), leftmost and non-overlapping
per kind. Structural confirmation adds spans that decode to something only a secret looks like:

* ``jwt``: three base64url parts with a dot between them, the first a JSON object that names ``alg``; white space around
  that object and letters before it, up to a ``-`` or ``_``, do not hide it. A header nested too deep for a JSON
  parser is none;
* ``der``: base64 or hex that decodes to nested DER lengths filling it exactly, with an integer
  or an object identifier inside, as keys are encoded;
* ``sshkey``: base64 that decodes to length-prefixed fields of an SSH key;
* ``pem``: a PEM private key block whose body passes one of the last two tests, or says that it is encrypted, with
  how, and has whole cipher blocks.

Base64 is tried from the beginning of its run and after each sign that may stand before it (``/ + - _``); its own
lengths tell where it ends. Lines may be broken, also by a written ``\\n``. All tests read a text a few times at most.

Spans are ``kind:start:end`` in code points, end exclusive. Null text counts as empty; such
rows have no spans and the digest of the empty string. Repeated rows give repeated rows,
an empty table none. Other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from strandweave.llm.common import ddl_of, map_batches

KINDS = ("assign", "access", "hex", "jwt", "der", "sshkey", "pem")
# fixed values: the patterns of the contract
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs of [0-9a-f]+ with 24 or more
_RUN = r"[A-Za-z0-9+/_-]"
_BREAK = r"(?:\r?\n|\\r\\n|\\n)[ \t]*"
#: runs of 24 signs or more, over line breaks between parts of 8 or more
_BASE64 = re.compile(rf"{_RUN}{{8,}}(?:{_BREAK}{_RUN}{{8,}})*(?:{_BREAK}{_RUN}{{1,7}}(?![A-Za-z0-9+/_-]))?={{0,2}}")
_LINE = re.compile(_BREAK)
_FROM = re.compile(r"(?:^|[/+_-])(?=M[A-P]|AAAA|b3BlbnNzaC1rZXkt)")
_DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
_HEX_RUN = re.compile(r"[0-9a-fA-F]{48,}")
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr]|Proc-Type: 4,ENCRYPTED|DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]+)+)"
    r"-----END \1-----"
)
_ENCRYPTED = re.compile(r"Proc-Type: 4,ENCRYPTED(?:\s|\\[nr])+DEK-Info: [A-Z0-9-]+,(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})(?:\s|\\[nr])")
#: deepest nesting of DER values that is followed
_DEPTH = 6


def decode64(text: str) -> bytes | None:
    """Base64 or base64url with or without padding; None where it is neither."""
    plain = re.sub(r"\s+|\\[nr]", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_values(data: bytes, depth: int = 0) -> list[int] | None:
    """Tags of nested DER values that fill ``data`` exactly, or None."""
    tags, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > _DEPTH:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > len(data):
            return None
        tags.append(tag)
        if tag in (0x30, 0x31):
            inner = der_values(data[at : at + length], depth + 1)
            if inner is None:
                return None
            tags += inner
        at += length
    return tags


def is_der_key(data: bytes) -> bool:
    """A sequence that holds an integer or an object identifier and at least one more value."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    tags = der_values(data)
    return tags is not None and len(tags) > 2 and bool({0x02, 0x06} & set(tags[1:]))


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH private key magic, or length-prefixed fields that start with a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    fields, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) > 1 and fields[0].startswith((b"ssh-", b"ecdsa-"))


def _header(part: str) -> bool:
    """Whether a part is base64url of one JSON object that names ``alg``.

    It is decoded piece by piece, and no further than it can be the beginning of such an object.
    """
    if len(part) % 4 == 1:
        return False
    size = 256
    while True:
        piece = part[:size]
        whole = len(piece) == len(part)
        data = decode64(piece)
        if data is None:
            return False
        try:
            text = data.decode("utf-8") if whole else data.decode("utf-8", "ignore")
            found = json.loads(text)
            return whole and isinstance(found, dict) and isinstance(found.get("alg"), str)
        except json.JSONDecodeError as e:
            cut = e.pos >= len(text) - 8 or "Unterminated" in e.msg
            if whole or not cut or not text.lstrip().startswith("{"):
                return False
        except (UnicodeDecodeError, RecursionError):
            return False
        size *= 2


def signed_tokens(run: str) -> list[tuple[int, int]]:
    """Places of signed tokens in a run of base64url letters and dots."""
    found, at, parts = [], 0, run.split(".")
    starts = []
    for part in parts:
        starts.append(at)
        at += len(part) + 1
    i = 0
    while i + 2 < len(parts):
        head, taken = parts[i], False
        if parts[i + 1]:
            # a JSON object begins with a brace or white space
            for m in re.finditer(r"(?:^|[_-])(?=e[w-z0-9_-]|I|C[ent]|DQ)", head):
                if _header(head[m.end() :]):
                    found.append((starts[i] + m.end(), starts[i + 2] + len(parts[i + 2])))
                    taken = True
                    break
        i += 3 if taken else 1
    return found


def _key_at(run: str, start: int) -> tuple[str, int] | None:
    """Kind and end of the key whose base64 begins at ``start`` of ``run``, told by its own lengths."""
    head = decode64(run[start : start + 40][: len(run[start : start + 40]) // 4 * 4]) or b""
    if head[:1] == b"\x30" and len(head) > 6:
        if head[1] < 0x80:
            size = 2 + head[1]
        elif 1 <= (n := head[1] & 0x7F) <= 4:
            size = 2 + n + int.from_bytes(head[2 : 2 + n], "big")
        else:
            return None
        end = start + -(-size * 4 // 3)
        if size < 16 or end > len(run) or end < len(run) and run[end] not in "/+_-=":
            return None
        data = decode64(run[start:end])
        return ("der", end) if data is not None and is_der_key(data) else None
    if head.startswith(b"openssh-key-v1\0") or re.match(rb"\0\0\0[\x07-\x24](?:ssh-|ecdsa-)", head):
        data = decode64(run[start:])
        return ("sshkey", len(run)) if data is not None and is_ssh_key(data) else None
    return None


def encoded_keys(run: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of keys in a run of base64 letters; the padding belongs to a key that ends the run."""
    found, after, body = [], 0, len(run.rstrip("="))
    for m in _FROM.finditer(run):
        if m.end() < after or body - m.end() < 20:
            continue
        key = _key_at(run[:body], m.end())
        if key is not None:
            after = len(run) if key[1] == body else key[1]
            found.append((key[0], m.end(), after))
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the pattern matches."""
    spans = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        spans += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [
            (m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20
        ]
    spans += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return spans


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of candidates whose structure was confirmed."""
    spans = []
    if "." in text:
        for m in _DOTTED.finditer(text):
            spans += [(m.start() + a, "jwt", m.start() + b) for a, b in signed_tokens(m[0])]
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            body, locked = m[2], _ENCRYPTED.search(m[2])
            data = decode64(body[locked.end() :] if locked else body)
            if data and (len(data) % 8 == 0 if locked else is_der_key(data) or is_ssh_key(data)):
                spans.append((m.start(), "pem", m.end()))
    for m in _BASE64.finditer(text):
        if len(m[0]) < 24 or not _FROM.search(m[0]):
            continue
        breaks = [(b.start(), b.end() - b.start()) for b in _LINE.finditer(m[0])]
        plain = _LINE.sub("", m[0]) if breaks else m[0]

        def place(at: int, last: bool) -> int:
            """Place in the text of place ``at`` of the run without breaks."""
            for start, size in breaks:
                if at < start or last and at == start:
                    break
                at += size
            return m.start() + at

        spans += [(place(a, False), kind, place(b, True)) for kind, a, b in encoded_keys(plain)]
    for m in _HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and m[0].startswith("30") and is_der_key(bytes.fromhex(m[0])):
            spans.append((m.start(), "der", m.end()))
    return list(dict.fromkeys(spans))


def written(spans: list[tuple[int, str, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed`` for every row."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")}
        for text in batch["text"]:
            base, more = base_spans(text or ""), confirmed_spans(text or "")
            kinds = [k for _, k, _ in base]
            out["n_assign"].append(kinds.count("assign"))
            out["n_access"].append(kinds.count("access"))
            out["n_hex"].append(kinds.count("hex"))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(base + more))
            out["n_confirmed"].append(len(more))
        return {"doc_id": batch["doc_id"], **out}

    return map_batches(
        docs.select("doc_id", "text"),
        rows,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "spans string, n_confirmed bigint",
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans become one.

    All columns stay as they are, null text stays null.
    """

    names = docs.columns

    def rows(batch: dict[str, list]) -> dict[str, list]:
        return batch | {"text": [_without(t, mark) for t in batch["text"]]}

    return map_batches(docs.select(*[f"`{n}`" for n in names]), rows, ddl_of(docs))


def _without(text: str | None, mark: str) -> str | None:
    if not text:
        return text
    spans = sorted((s, e) for s, _, e in base_spans(text) + confirmed_spans(text))
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text
