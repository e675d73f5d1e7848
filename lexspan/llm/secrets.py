"""Secret scan: base patterns, and assignment-aware lexing of source and configuration text.

The lexer reads a text that holds ``=`` or ``:`` as tokens (names, string and bare literals,
operators, line breaks) and builds name-literal pairs: ``name = literal``, ``name: literal``,
``name: type = literal``, ``"name": "literal"``, ``--name=literal``,
``<name>literal</name>``, lists of literals, joined literals ``"a" + "b"``, values on the
line below, and ``name = other`` with ``other`` bound before; the keys of enclosing braces and
of lines with less indentation stand before the name. Names are bound until they are bound
anew or their block ends, so that constants propagate to later uses. A call is no literal, but
strings among its arguments count, a little less. A literal's score comes from the words of
the name that it reaches: secret words add, harmless words (hash, id, path ...) take off, and
its own length and variety count. Literals at or above ``threshold`` are secrets of kind
``literal``.

Values are shared, not copied: what a name is bound to is a node that knows the length and
the characters of all that it joins, and a literal is reported once, so a text takes time in
proportion to its length however often its names use one another.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexspan.llm.blocks import numbered, quoted
from lexspan.session import ship, table

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: How much a word of a name says about its literal.
WORD_SCORES = {
    "password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "secret": 4, "token": 3, "apikey": 4, "credential": 4, "credentials": 4,
    "bearer": 3, "auth": 2, "authorization": 3, "private": 2, "key": 2, "api": 1, "access": 1, "client": 1, "signing": 2, "session": 1,
    "pass": 3, "cookie": 1, "salt": 2, "encryption": 2, "webhook": 1, "dsn": 2,
    "public": -3, "name": -3, "path": -3, "file": -3, "url": -2, "uri": -2, "id": -2, "hash": -3, "checksum": -4, "sha": -4, "md5": -4,
    "type": -3, "count": -4, "length": -4, "max": -3, "min": -3, "limit": -4, "expiry": -4, "ttl": -4, "field": -3, "label": -3, "example": -4,
}
_DUMMIES = {"changeme", "password", "secret", "example", "placeholder", "undefined", "redacted", "required", "optional"}
THRESHOLD = 4.0
#: What an argument of a call counts less than a literal that is assigned itself.
ARGUMENT = 1.0

_TOKEN = re.compile(
    r"""(?P<string>\"""[\s\S]*?\"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<word>(?:--?)?[A-Za-z_$][\w$.-]*|[\w/][\w+/=.-]*)|(?P<op>:=|=>|==|!=|[-+*/%]=|[=:+,;(){}\[\]])|(?P<line>\n[\x20\t]*)""",
    re.ASCII,
)
#: A bare value runs to white space, a quote, a bracket or a sign that ends it.
_BARE = re.compile(r"""[\w$/][^\s"'`,;()\[\]{}<>]*""")
_BINDS = ("=", ":", ":=", "=>")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>([^<>\s]{8,}+)</\1>", re.ASCII)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) of the base patterns, leftmost and not overlapping in each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


class NameScore:
    """What the words of one or more names say: their scores, and pairs of neighbours that are one word (``api key``)."""

    __slots__ = ("total", "pairs", "first", "last")
    _JOINED = ("apikey", "passphrase")

    def __init__(self, name: str = ""):
        words = [w.lower() for w in _SPLIT.findall(name)]
        self.total = sum(WORD_SCORES.get(w, 0) for w in words)
        self.pairs = frozenset(p for p in (a + b for a, b in zip(words, words[1:])) if p in self._JOINED)
        self.first, self.last = (words[0], words[-1]) if words else ("", "")

    def __add__(self, other: NameScore) -> NameScore:
        """Of the names in a row."""
        out = NameScore()
        out.total, out.pairs = self.total + other.total, self.pairs | other.pairs
        if self.last + other.first in self._JOINED:
            out.pairs |= {self.last + other.first}
        out.first, out.last = self.first or other.first, other.last or self.last
        return out

    @property
    def score(self) -> float:
        return float(self.total + sum(WORD_SCORES.get(p, 0) for p in self.pairs))


def name_score(name: str) -> float:
    return NameScore(name).score


class Value:
    """One literal, or several joined: the parts are shared, never copied; figures of the whole are sums of the parts' own."""

    __slots__ = ("parts", "span", "counts", "length", "short", "found")
    #: Joined values up to this length are kept as text, to know well-known dummies.
    SHORT = 16

    def __init__(self, parts: tuple[Value, ...] = (), span: tuple[int, int] | None = None, text: str = ""):
        self.parts, self.span, self.found = parts, span, False
        if span is not None:
            text = text.replace("\\\n", "")  # a continued line
            self.counts, self.length, self.short = Counter(text), len(text), text if len(text) <= self.SHORT else None
            return
        self.counts, self.length = Counter(), sum(p.length for p in parts)
        for p in parts:
            self.counts.update(p.counts)
        self.short = "".join(p.short for p in parts) if self.length <= self.SHORT else None

    @property
    def score(self) -> float:
        return _score(self.counts, self.length, self.short)

    def mark(self, spans: list[tuple[int, int]]) -> None:
        """Add the spans of all literals in it that were not added before: each is visited once for the whole text."""
        open_ = [self]
        while open_:
            value = open_.pop()
            if value.found:
                continue
            value.found = True
            if value.span is not None:
                spans.append(value.span)
            open_ += value.parts


def _score(counts: Counter, length: int, short: str | None) -> float:
    if length < 8 or len(counts) < 5 or any(c.isspace() for c in counts) or short is not None and short.lower() in _DUMMIES:
        return -8.0
    kinds = sum((any("a" <= c <= "z" for c in counts), any("A" <= c <= "Z" for c in counts), any("0" <= c <= "9" for c in counts), any(not (c.isascii() and c.isalnum()) for c in counts)))
    entropy = -sum(n / length * math.log2(n / length) for n in counts.values())
    return min(3.0, (kinds - 1) * 0.75 + (entropy - 2.5) * 0.75)


def literal_score(value: str) -> float:
    """From -8 (surely none) to 3: length and variety of a literal's characters."""
    return _score(Counter(value), len(value), value)


class _Scopes:
    """What names are bound to; a closing brace takes back what was bound since the opening one."""

    def __init__(self):
        self.bound: dict[str, Value] = {}
        self.undo: list[list[tuple[str, Value | None]]] = []

    def open(self) -> None:
        self.undo.append([])

    def close(self) -> None:
        if self.undo:
            for name, before in reversed(self.undo.pop()):
                self._put(name, before)

    def bind(self, name: str, value: Value | None) -> None:
        if self.undo:
            self.undo[-1].append((name, self.bound.get(name)))
        self._put(name, value)

    def _put(self, name: str, value: Value | None) -> None:
        if value is None:
            self.bound.pop(name, None)
        else:
            self.bound[name] = value


def assignments(text: str) -> Iterator[tuple[NameScore, Value, bool]]:
    """The names that reach a value, outermost first, the value, and whether it is only an argument of a call.

    In the order of the text, so that constants propagate; each token is passed once.
    """
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    scopes = _Scopes()
    braces: list[NameScore] = []  # of the keys of all open braces
    above: list[tuple[int, NameScore]] = []  # indentation and keys of the lines that this one belongs to
    indent, i, n = 0, 0, len(tokens)
    of = lambda k: tokens[k][1] if k < n else ""
    kind_of = lambda k: tokens[k][0] if k < n else ""

    def literal(k: int) -> tuple[Value, int]:
        """The value of one token, and the last token that it takes: a bare one may hold signs that part names."""
        what, raw, start, end = tokens[k]
        if what == "string":
            inside, skip = _inner(raw)
            return Value(span=(start + skip, end - skip), text=inside), k
        bare = _BARE.match(text, start)
        end = max(end, bare.end() if bare else end)
        while k + 1 < n and tokens[k + 1][2] < end:
            k += 1
        return Value(span=(start, end), text=text[start:end]), k

    while i < n:
        kind, raw, _, _ = tokens[i]
        if kind == "line":
            if kind_of(i + 1) != "line":
                indent = len(raw) - 1
                while above and above[-1][0] >= indent:
                    above.pop()
        elif raw == "{":
            braces.append(braces[-1] if braces else NameScore())
            scopes.open()
        elif raw == "}" and braces:
            braces.pop()
            scopes.close()
        elif kind in ("string", "word") and of(i + 1) in _BINDS:
            name = _inner(raw)[0] if kind == "string" else raw.lstrip("-$")
            own = NameScore(name)
            k = i + 2
            if of(i + 1) in ("=", ":") and kind_of(k) == "line":
                k += 1
            elif of(i + 1) == ":" and kind_of(k) == "word" and of(k + 1) == "=" and text[tokens[k][3] : tokens[k + 1][2]].isspace():
                k += 2  # a type
            if of(k) == "{":
                braces.append((braces[-1] if braces else NameScore()) + own)
                scopes.open()
                i = k + 1
                continue
            if kind_of(k) in ("string", "word") and kind_of(k - 1) == "line" and (of(k + 1) in _BINDS or len(tokens[k - 1][1]) - 1 <= indent and of(i + 1) == ":" and above):
                above.append((indent, (above[-1][1] if above else NameScore()) + own))  # the lines below belong to this key
                i += 2
                continue
            path = (braces[-1] if braces else NameScore()) + (above[-1][1] if above else NameScore()) + own
            parts: list[Value] = []
            if of(k) == "[":  # a list: every element by itself
                k += 1
                while k < n and of(k) != "]" and (kind_of(k) in ("string", "word", "line") or of(k) == ","):
                    if kind_of(k) in ("string", "word"):
                        value, k = (scopes.bound[of(k)], k) if of(k) in scopes.bound else literal(k)
                        yield path, value, False
                    k += 1
            while kind_of(k) in ("string", "word"):
                if kind_of(k) == "word" and of(k) in scopes.bound:
                    parts.append(scopes.bound[of(k)])
                elif kind_of(k) == "word" and of(k + 1) == "(":  # a call gives no literal, but may hold a default
                    parts, depth, k = [], 1, k + 2
                    while k < n and depth and of(k) not in "{}":
                        depth += (of(k) == "(") - (of(k) == ")")
                        if kind_of(k) == "string":
                            yield path, literal(k)[0], True
                        k += 1
                    break
                else:
                    value, k = literal(k)
                    parts.append(value)
                k += 1
                if of(k) == "+" or of(k) == "(" and not parts:
                    k += 2 if kind_of(k + 1) == "line" else 1
                    continue
                break
            value = parts[0] if len(parts) == 1 else Value(tuple(parts)) if parts else None
            if value is not None:
                yield path, value, False
            scopes.bind(name, value)
            i = max(k, i + 2)
            continue
        i += 1
    for m in _ELEMENT.finditer(text):
        yield NameScore(m.group(1)), Value(span=m.span(2), text=m.group(2)), False


def _inner(raw: str) -> tuple[str, int]:
    """A string literal's contents and the size of its quotes."""
    size = 3 if len(raw) >= 6 and raw[:3] in ('"' * 3, "'" * 3) else 1
    return raw[size:-size], size


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    spans: list[tuple[int, int]] = []
    for name, value, argument in assignments(text):
        score = name.score
        if score > 0 and not value.found and score + value.score - (ARGUMENT if argument else 0) >= threshold:
            value.mark(spans)
    return [("literal", *s) for s in dict.fromkeys(spans)]


def scan_text(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans of a whole text, by start, then by kind as listed in ``KINDS``."""
    text = text or ""
    return sorted(base_spans(text) + literal_spans(text, threshold), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key and ``spans``, an array of (kind, start, end) in code points, by start and kind.

    Null and empty texts have none. Repeated or null keys are rows like any other, and
    other columns are not read. One pass, no shuffle.
    """
    ship(docs.sparkSession)
    named = docs.select(docs[quoted(key)].alias("key"), docs[quoted(text)].alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t.as_py(), threshold)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, spans)], ["key", "spans"])

    return named.mapInArrow(run, f"key {kind}, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("key", key)


def masked_text(text: str | None, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones as one) replaced; null stays null, empty stays empty."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end in scan_text(text, threshold):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets in ``text`` masked, all rows and columns kept; ``length``, if there, counts code points anew.

    Null and empty texts stay; repeated rows are masked alike, and an empty table stays empty.
    """
    ship(docs.sparkSession)
    names = docs.columns
    at = f"c{names.index(text)}"
    sized = f"c{names.index(length)}" if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [masked_text(t, threshold) for t in old]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if sized:
                sizes = [n if a == b else len(b) for a, b, n in zip(old, new, columns[sized].to_pylist())]
                columns[sized] = pa.array(sizes, batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    told = numbered(docs)
    return told.mapInArrow(run, told.schema).toDF(*names)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number("literal").alias("n_literal"),
    )


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    """What the query's ``base_sha256`` must be, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k != "literal").encode()).hexdigest()
