"""Secret scan by assignment-aware lexing.

Three plain patterns give the base spans (assignment to a sensitive word, access keys, long hex runs). The method
adds to them. Source and configuration syntax is lexed into names and literals: ``name = value``, ``name: value``,
``"name": "value"``, ``name := value``, ``name => value`` and ``<name>value</name>``, with quoted, triple-quoted, bare
and ``+``-joined values, block scalars (``name: |`` and lines indented deeper), and the literals that a call is given
beside its first argument (``get("KEY", "default")``) or as its only one. A name in a value stands for the value it was
bound to last before, or if only bound later, first after, through any number of steps. A literal is scored by how
sensitive its target name is and how much it looks like key material, and is a secret from ``THRESHOLD`` on.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_texts, map_batches, prepare

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 32 or more: the same spans as runs of one or more of which shorter ones are dropped.
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

#: The text of a joined value of more characters is not kept; it is scored by its characters' shares.
LONGEST = 4096
#: How sensitive a part of a name is; a name's score is the largest of its parts and of neighbouring parts joined.
NAME_PARTS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0, "authkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "connectionstring": 0.8, "auth": 0.7, "bearer": 0.9, "private": 0.5, "key": 0.5, "salt": 0.6, "mnemonic": 1.0, "seedphrase": 1.0}
#: Names whose literals may be several words.
PHRASES = ("passphrase", "mnemonic", "seedphrase")
STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "private", "salt", "connection", "mnemonic", "seed")
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|_+|none|null|nil|true|false|undefined|todo|changeme|change_me|example|placeholder|dummy|redacted|your[_-].*|<.*>|\$\{.*\}|\$\(.*\)|%\(.*\).|\{\{.*\}\})$", re.IGNORECASE)
THRESHOLD = 0.5

_PAIR = re.compile(r"""(?<![\w.-])["']?(?P<name>[A-Za-z_][\w.-]*+)["']?[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*(?=\S)""", re.ASCII)
_TERM = re.compile(r"""(?P<triple>\"{3}|'{3})(?P<long>(?s:.*?))(?P=triple)|(?P<quote>["'`])(?P<text>(?:[^"'`\\\n]|\\.|(?!(?P=quote))["'`])*)(?P=quote)|(?P<bare>[A-Za-z0-9_+/.@%$~!^&*-]+(?:={1,2}(?![\w=]))?)""", re.ASCII)
_PLUS = re.compile(r"[ \t]*\+[ \t]*\n?[ \t]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME = re.compile(r"[A-Za-z_][\w.-]*", re.ASCII)
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*(?:#[^\n]*)?\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)\n?")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>]+)</\1\s*>", re.ASCII)
_KEYWORD = re.compile(r"\s*(?:[A-Za-z_]\w*\s*=(?!=)\s*)?", re.ASCII)
_COMMA = re.compile(r"\s*(?:,|(?=\)))")


def name_parts(name: str) -> list[str]:
    parts = [p.lower() for p in _WORDS.findall(name)]
    return parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]


def name_score(name: str) -> float:
    return max((NAME_PARTS.get(p, 0.0) for p in name_parts(name)), default=0.0)


def literal_score(value: str, spaces: bool = False) -> float:
    """0 to 1: length, entropy and variety of characters; 0 for placeholders, short values and (unless ``spaces``) several words."""
    n = len(value)
    if n < 8 or not spaces and any(c.isspace() for c in value) or PLACEHOLDER.match(value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, n / 16) * 0.3 + min(1.0, entropy / 3.5) * 0.4 + min(1.0, kinds / 2) * 0.3


class Value:
    """What a name is bound to: a literal's span, or other values joined. These are referred to, not copied."""

    def __init__(self, span: tuple[int, int] | None, text: str | None, parts: list[Value] = ()):
        self.span, self.text, self.parts = span, text, parts
        self.name: str | None = None
        self.known: dict[bool, float] = {}
        self.shape: tuple[float, dict[str, float], str, str] | None = None

    def profile(self) -> tuple[float, dict[str, float], str, str]:
        """Length, share of each character, first and last characters; parts have theirs from when they were joined."""
        if self.shape is None:
            n = len(self.text)
            self.shape = (float(n), {c: k / n for c, k in Counter(self.text).items()}, self.text[:16], self.text[-2:])
        return self.shape

    def score(self, spaces: bool = False) -> float:
        if spaces not in self.known:
            self.known[spaces] = literal_score(self.text, spaces) if self.text is not None else profile_score(*self.shape, spaces)
        return self.known[spaces]


def join(parts: list[Value]) -> Value:
    """The parts one after another; the first of them itself if it is alone."""
    if len(parts) == 1:
        return parts[0]
    if all(p.text is not None for p in parts) and sum(len(p.text) for p in parts) <= LONGEST:
        return Value(None, "".join(p.text for p in parts), parts)
    out = Value(None, None, parts)
    shapes = [x for p in parts if (x := p.profile())[0]]
    n = sum(x[0] for x in shapes)
    shares: dict[str, float] = {}
    for size, own, _, _ in shapes:
        for c, share in own.items():
            shares[c] = shares.get(c, 0.0) + share * (size / n)
    head = "".join(x[2] for x in shapes[:16])[:16]
    tail = "".join(x[3] for x in shapes[-2:])[-2:]
    out.shape = (min(n, 1e300), shares, head, tail)  # names may stand for names, so a length may double with each
    return out


def profile_score(n: float, shares: dict[str, float], head: str, tail: str, spaces: bool = False) -> float:
    """``literal_score`` of a value of over ``LONGEST`` characters."""
    if not spaces and any(c.isspace() for c in shares) or PLACEHOLDER.match(f"{head}~a~{tail}"):
        return 0.0
    entropy = -sum(p * math.log2(p) for p in shares.values() if p > 0)
    kinds = sum(any(f(c) for c in shares) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, n / 16) * 0.3 + min(1.0, entropy / 3.5) * 0.4 + min(1.0, kinds / 2) * 0.3


def terms(text: str, at: int) -> tuple[list[Value], int, bool]:
    """Values joined by ``+`` from ``at`` on, where they end, and whether a call comes instead of the last."""
    found: list[Value] = []
    while t := _TERM.match(text, at):
        if t["bare"] and text[t.end() : t.end() + 1] == "(":
            return found, t.end(), True
        part = "text" if t["quote"] else "long" if t["triple"] else "bare"
        found.append(Value(t.span(part), t[part]))
        found[-1].name = t["bare"] if t["bare"] and _NAME.fullmatch(t["bare"]) else None
        at = t.end()
        if not (p := _PLUS.match(text, at)) or not _TERM.match(text, p.end()):
            break
        at = p.end()
    return found, at, False


def arguments(text: str, at: int) -> list[Value]:
    """Quoted literals of a call whose arguments start at ``at``: its only argument, or those beside the first."""
    found: list[Value] = []
    while True:
        values, at, call = terms(text, _KEYWORD.match(text, at).end())
        if call or not values:
            break
        found.append(values[0] if len(values) == 1 else None)
        if not (c := _COMMA.match(text, at)) or text[c.end() - 1] != ",":
            break
        at = c.end()
    chosen = found[1:] if len(found) > 1 else found
    return [v for v in chosen if v is not None and text[v.span[0] - 1 : v.span[0]] in ("'", '"', "`")]


def block_scalar(text: str, name: int, at: int) -> tuple[list[Value], int]:
    """Lines below ``at`` that are indented deeper than the line of the name, without their indent, and where they end."""
    start = text.rfind("\n", 0, name) + 1
    least = len(text[start:name]) - len(text[start:name].lstrip(" \t-"))
    lines: list[Value] = []
    while at < len(text):
        m = _LINE.match(text, at)
        if m[2].strip():
            if len(m[1]) <= least:
                break
            lines.append(Value((m.start(2), m.start(2) + len(m[2].rstrip())), m[2].rstrip()))
        at = m.end()
    return lines, at


def statements(text: str) -> list[tuple[str, list[Value]]]:
    """Name and terms of every assignment, in the order of the text; the literals given to a call are one each."""
    found: list[tuple[int, str, list[Value]]] = [(m.start(), m[1], [Value(m.span(2), m[2])]) for m in _ELEMENT.finditer(text)] if "</" in text else []
    at = 0
    while m := _PAIR.search(text, at):
        if b := _BLOCK.match(text, m.end()):
            values, at = block_scalar(text, m.start("name"), b.end())
            if values:
                found.append((m.start(), m["name"], values))
            at = max(at, b.end())
            continue
        values, end, call = terms(text, m.end())
        if call:
            found += [(m.start(), m["name"], [v]) for v in arguments(text, end + 1)]
            end += 1  # keywords of the call are assignments too
        elif values:
            found.append((m.start(), m["name"], values))
            # A nested name such as  a: b = c  is read again from its value.
            if len(values) == 1 and _PAIR.match(text, m.end()):
                end = m.end()
        at = max(end, m.end())
    return [(name, values) for _, name, values in sorted(found, key=lambda x: x[0])]


def pairs(text: str) -> list[tuple[str, Value]]:
    """Name and value of every assignment, the values of other names put in for these.

    Literal spans leave out the quotes. A name stands for the last value it was bound to before, else for the first
    after; names that stand for each other are their own text.
    """
    lexed = statements(text)
    bound: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(lexed):
        bound.setdefault(name, []).append(k)

    def binding(name: str | None, k: int) -> int | None:
        at = bound.get(name, ())
        i = bisect_left(at, k)
        if i:
            return at[i - 1]
        return next((x for x in at[:2] if x != k), None)

    value: list[Value | None] = [None] * len(lexed)
    for k in range(len(lexed)):
        # Statements that wait for others, each with its terms so far; what is waited for already is a circle.
        todo: list[tuple[int, list[Value]]] = [(k, [])] if value[k] is None else []
        waiting = {k}
        while todo:
            j, done = todo[-1]
            given = lexed[j][1]
            if len(done) == len(given):
                value[j] = join(done)
                waiting.discard(j)
                todo.pop()
                continue
            term = given[len(done)]
            other = binding(term.name, j) if term.name else None
            if other is None or value[other] is not None or other in waiting:
                done.append(term if other is None or value[other] is None else value[other])
            else:
                waiting.add(other)
                todo.append((other, []))
    return [(name, v) for (name, _), v in zip(lexed, value, strict=True)]


def literal_spans(values: list[Value]) -> set[tuple[int, int]]:
    """Spans of all literals that the values are made of; each value is visited once."""
    seen, todo, out = set(), list(values), set()
    while todo:
        v = todo.pop()
        if id(v) not in seen:
            seen.add(id(v))
            todo += v.parts
            if v.span:
                out.add(v.span)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three plain patterns, by start and then kind."""
    low = text.lower()
    out = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with the literals that the method adds where no base span overlaps."""
    base = base_spans(text)
    if not ("=" in text or ":" in text or "</" in text) or not any(s in text.lower() for s in STEMS):
        return base, base
    secret = [v for name, v in pairs(text) if (s := name_score(name)) >= THRESHOLD and s * v.score(any(p in PHRASES for p in name_parts(name))) >= THRESHOLD]
    added = {(a, 3, b) for a, b in literal_spans(secret) if b > a}
    ends = [0]  # the largest end of the base spans so far, by start
    for _, _, b in base:
        ends.append(max(ends[-1], b))
    starts = [a for a, _, _ in base]
    new = [x for x in added if ends[bisect_left(starts, x[2])] <= x[0]]
    return base, sorted(base + new)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text; offsets are code points, ends exclusive.

    Returns ``doc_id``, the numbers of base spans ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` of the
    base spans, ``spans`` (all, comma-joined ``kind:start:end``) and ``n_literal``, those the method added.
    Null and empty texts have none. Each row is scanned by itself, in time linear in its text. A literal that touches a
    base span is not added.
    """
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        got = [scan(t) for t in batch.column(1).to_pylist()]
        count = lambda k: [sum(s[1] == k for s in both) for _, both in got]
        return {
            "doc_id": batch.column(0),
            "n_assign": count(0),
            "n_access": count(1),
            "n_hex": count(2),
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got],
            "spans": [joined(s) for _, s in got],
            "n_literal": count(3),
        }

    return map_batches(doc_texts(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")
