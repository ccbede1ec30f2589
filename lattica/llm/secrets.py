"""Secret scans by assignment-aware lexing.

Three base kinds come from patterns. Beyond them, source and configuration text is lexed: a tokeniser finds comments and string
literals (escapes, triple quotes, back quotes, prefixes) and leaves a shadow of the text in which neither can be taken for
syntax; a parser reads name-literal pairs off the shadow: assignments, `key: value` of JSON, YAML and INI, keyword
arguments, typed declarations, lists (each item by itself), YAML blocks, XML elements and attributes. Constants are propagated, wherever they are defined: a
name set to other names and literals has their literals. A literal's score grows with how sensitive its target name is
and how random it looks; those that reach `THRESHOLD` are spans. Comments and the insides of strings are lexed by themselves
and define nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, bounded, column, documents, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")
#: A name is sensitive by its parts; weights are of this operator's own choosing.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "privatekey": 3, "accesskey": 3, "auth": 2, "bearer": 2, "authorization": 2, "pass": 2, "signature": 2, "salt": 1, "key": 1, "pin": 1, "session": 1, "cookie": 1, "dsn": 1}
THRESHOLD = 4.0
#: Comments, and string literals in one line, or in several if in three quotes or in back quotes. What stands right before a letter or digit
#: is no closing quote, and what stands right after one no opening single quote.
BODY = {q: rf"(?:\\[\s\S]|[^{q}\\\n])*{q}(?![A-Za-z0-9_])" for q in "\"'"}
QUOTED = rf"""(?:\"{{3}}(?:\\[\s\S]|[^\\])*?\"{{3}}|'{{3}}(?:\\[\s\S]|[^\\])*?'{{3}}|"{BODY['"']}|%s'{BODY["'"]})"""
TOKEN = re.compile(rf"(?P<comment>/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|(?<!\S)(?:#|//)[^\n]*)|(?P<string>(?<![A-Za-z0-9_])[rRbBuUfF]{{1,2}}{QUOTED % ''}|{QUOTED % '(?<![A-Za-z0-9_])'}|`(?:\\[\s\S]|[^`\\])*`)")
#: In the shadow a string literal is a mark, fillers, and a mark; other quotes are no syntax.
FILLER, MARK = "\x01", "\x02"
LITERAL = f"{MARK}{FILLER}*{MARK}"
NO_MARKS = {1: " ", 2: " "}
#: A type between a name and `=`: `str`, `string | null`, `Optional[str]`, `String?`, `&'static str`, `"Final[str]"`.
KIND_OF = r"""&?(?:'[a-z_]+[\x20\t]+)?[A-Za-z_][A-Za-z0-9_.]*(?:(?:\[[A-Za-z0-9_.,|?&'<>\[\]\x20\t]*\]|<[A-Za-z0-9_.,|?&'<>\[\]\x20\t]*>))?[?!]?"""
TYPE = rf"(?:{KIND_OF}(?:[\x20\t]*\|[\x20\t]*{KIND_OF})*|{LITERAL})"
#: What a value is made of: literals side by side (in parentheses on further lines too) or joined by `+`, `.` or `..`, and names.
JOINED = rf"\s*(?:\+|\.\.?)\s*(?:{LITERAL}|[A-Za-z_][A-Za-z0-9_.]*)"
VALUE = rf"(?:\(\s*{LITERAL}(?:{JOINED}|\s*{LITERAL})*|{LITERAL}(?:{JOINED}|[\x20\t]*(?:\\\n\s*)?{LITERAL}(?![\x20\t]*[:=]))*|[A-Za-z0-9+/_.=@$!%-]+(?:[\x20\t]*\+?[\x20\t]*{LITERAL}|[\x20\t]*\+[\x20\t]*[A-Za-z_][A-Za-z0-9_.]*)*)"
#: A list of literals: `["a", "b"]`, `{"a", "b"}`, `("a", "b")`, `[]string{"a"}`; or YAML items, one a line.
ITEMS = rf"{LITERAL}\s*(?:,\s*{LITERAL}\s*)*(?:,\s*)?"
LIST = rf"(?:\[\][A-Za-z_][A-Za-z0-9_.]*\s*)?[\[{{]\s*{ITEMS}[\]}}]|\(\s*{LITERAL}\s*,\s*(?:{ITEMS})?\)"
ITEM = re.compile(rf"[\x20\t]*-[\x20\t]+({LITERAL}|[A-Za-z0-9+/_.=@$!%-]+)[\x20\t]*(?:\n|\Z)", re.A)
DASHED = rf"\n(?:[\x20\t]*-[\x20\t]+(?:{LITERAL}|[A-Za-z0-9+/_.=@$!%-]+)[\x20\t]*(?:\n|\Z))+"
PAIR = re.compile(
    rf"""(?:(?<![A-Za-z0-9_.-])|(?<=\s--))(?:(?P<quoted>{LITERAL})|(?P<name>[A-Za-z_][A-Za-z0-9_.-]*))(?:[\x20\t]*:[\x20\t]*(?P<type>{TYPE})(?=[\x20\t]+=[\x20\t]|[\x20\t]*=[\x20\t]*[({MARK}]))?[\x20\t]*(?::=|=>|[:=](?!=))[\x20\t]*(?:(?P<block>[|>][+-]?\d?[\x20\t]*\n)|(?P<list>{LIST})|(?P<dashed>{DASHED})|(?P<value>{VALUE}))""",
    re.A,
)
ATOM = re.compile(rf"{LITERAL}|[A-Za-z0-9+/_.=@$!%-]+", re.A)
ANY_LITERAL = re.compile(LITERAL)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*", re.A)
QUOTED_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\x20-]*", re.A)
BLOCK_LINE = re.compile(r"([\x20\t]*)([^\n]*)(?:\n|\Z)")
#: An element with text and nothing else in it; a tag with attributes.
ELEMENT = re.compile(r"<([A-Za-z][A-Za-z0-9_.:-]*)(\s[^<>]*)?>([^<>]+)</\1\s*>", re.A)
TAG = re.compile(r"<[A-Za-z][A-Za-z0-9_.:-]*(\s[^<>]*)>", re.A)
ATTRIBUTE = re.compile(rf"([A-Za-z_][A-Za-z0-9_.:-]*)\s*=\s*({LITERAL})", re.A)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A)
#: Values that stand for "fill this in".
PLACEHOLDERS = frozenset({"changeme", "example", "placeholder", "none", "null", "true", "false", "undefined", "redacted", "xxxxxx", "your_password", "your-password", "todo", "required", "optional"})


def name_weight(name: str) -> float:
    """The largest weight of a part of the name, or of two parts side by side (api_key, PrivateKey)."""
    parts = [p.lower() for p in PARTS.findall(name)]
    return max([0, *(SENSITIVE.get(p, 0) for p in parts), *(SENSITIVE.get(a + b, 0) for a, b in zip(parts, parts[1:]))])


def singular(name: str) -> str:
    """The name of a list as that of an item: API_KEYS, passwords."""
    return name if name[-2:].lower() == "ss" else name.rstrip("sS")


def randomness(literal: str) -> float:
    """0 to 3: entropy in bits a character, with what it gains by mixing kinds of characters."""
    if len(literal) < 6:
        return 0.0
    counts = Counter(literal)
    entropy = -sum(c / len(literal) * math.log2(c / len(literal)) for c in counts.values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(3.0, max(0.0, entropy - 2.0) + 0.5 * (kinds - 1))


Span = tuple[int, int]


def tokenised(text: str) -> tuple[str, dict[int, Span], list[Span]]:
    """The shadow, the insides of string literals by where the literal starts, and comments."""
    parts, at, strings, comments = [], 0, {}, []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        parts.append(text[at:s].translate(NO_MARKS))
        if m["comment"] is not None:
            comments.append((s, e))
            parts.append("".join("\n" if c == "\n" else " " for c in m[0]))
        else:
            quotes = next(i for i in range(3) if m[0][i] in "\"'`")
            width = 3 if m[0][quotes : quotes + 3] in ('"' * 3, "'" * 3) and e - s >= quotes + 6 else 1
            strings[s] = s + quotes + width, e - width
            parts.append(MARK + FILLER * (e - s - 2) + MARK)
        at = e
    return "".join([*parts, text[at:].translate(NO_MARKS)]), strings, comments


class Name(NamedTuple):
    """A bare word of a value: what the name was set to, or, if it is none that is set, perhaps a literal."""

    name: str
    literal: Span | None


class Definition(NamedTuple):
    """A name that is set to literals (their spans) and to other names, in order."""

    name: str
    at: int
    parts: list[Span | Name]


def block(shadow: str, name_at: int, at: int) -> list[Span]:
    """Lines of a YAML block that begins at `at`: those indented more than the line of its name."""
    line = shadow.rfind("\n", 0, name_at) + 1
    outer = len(shadow[line:name_at]) - len(shadow[line:name_at].lstrip(" \t-"))
    found = []
    for m in BLOCK_LINE.finditer(shadow, at):
        if m[2].strip() and len(m[1]) <= outer or m.start() == len(shadow):
            break
        if m[2].strip():
            found.append((m.start(2), m.start(2) + len(m[2].rstrip())))
    return found


def definitions(text: str, shadow: str, strings: dict[int, Span]) -> list[Definition]:
    """All name-literal pairs, in the order of the text."""
    found, at = [], 0
    while m := PAIR.search(shadow, at):
        at = m.end()
        if m["quoted"] is not None:
            name = text[slice(*strings[m.start("quoted")])]
            if not QUOTED_NAME.fullmatch(name):
                at = m.end("quoted")
                continue
        else:
            name = m["name"]
        if m["block"] is not None:
            found.append(Definition(name, m.start(), block(shadow, m.start(), m.end())))
            continue
        if m["list"] is not None:
            start, end = m.span("list")
            found += [Definition(singular(name), m.start(), [strings[x.start()]]) for x in ANY_LITERAL.finditer(shadow, start, end)]
            continue
        if m["dashed"] is not None:
            for x in ITEM.finditer(shadow, m.start("dashed") + 1, m.end("dashed")):
                if x[1][0] == MARK:
                    found.append(Definition(singular(name), m.start(), [strings[x.start(1)]]))
                elif any(map(str.isdigit, x[1])):  # bare words without one are taken for prose
                    found.append(Definition(singular(name), m.start(), [x.span(1)]))
            continue
        atoms, parts, base = [*ATOM.finditer(m["value"])], [], m.start("value")
        for a in atoms:
            word = a[0].rstrip("+") if len(atoms) > 1 else a[0]
            literal = (base + a.start(), base + a.end()) if len(atoms) == 1 else None
            if a[0][0] == MARK:
                parts.append(strings[base + a.start()])
            elif NAME.fullmatch(word):
                parts.append(Name(word, literal))
            elif literal:
                parts.append(literal)
        found.append(Definition(name, m.start(), parts))
        if m["type"] and any(map(str.isdigit, m["type"])):  # may as well be a bare value that ends in =
            found.append(Definition(name, m.start(), [m.span("type")]))
    for m in ELEMENT.finditer(shadow):
        inside = m[3].strip()
        if inside:
            s = m.start(3) + m[3].index(inside)
            literal = strings[s] if inside[0] == MARK and s in strings and len(inside) == strings[s][1] - s + 1 else (s, s + len(inside))
            names = [m[1], *(text[slice(*strings[m.start(2) + a.start(2)])] for a in ATTRIBUTE.finditer(m[2] or "") if a[1].lower() in ("key", "name", "id"))]
            found += [Definition(n, m.start(), [literal]) for n in names]
    for m in TAG.finditer(shadow):
        own = {a[1].lower(): strings[m.start(1) + a.start(2)] for a in ATTRIBUTE.finditer(m[1])}
        if "value" in own:
            found += [Definition(text[slice(*own[k])], m.start(), [own["value"]]) for k in ("key", "name", "id") if k in own]
    return sorted(found, key=lambda d: d.at)


def lexed(text: str, depth: int = 2) -> list[Span]:
    """Spans of literals whose target names make them secrets. A name stands for what it was set to last before, or else first after."""
    shadow, strings, comments = tokenised(text)
    every = definitions(text, shadow, strings)
    places: dict[str, list[int]] = {}
    for k, d in enumerate(every):
        places.setdefault(d.name, []).append(k)
    found: set[Span] = set()

    def meant(name: str, of: int) -> int | None:
        own = places.get(name, ())
        j = bisect_left(own, of)
        return own[j - 1] if j else next((i for i in own if i != of), None)

    def literals_of(k: int) -> list[Span]:
        """Literals that definition k reaches, in order and each once, so that a = a + a doesn't grow."""
        out: dict[Span, None] = {}
        stack, seen = [(k, iter(every[k].parts))], {k}
        while stack:
            of, rest = stack[-1]
            part = next(rest, None)
            if part is None:
                stack.pop()
            elif not isinstance(part, Name):
                out.setdefault(part)
            elif (i := meant(part.name, of)) is None:
                if part.literal:
                    out.setdefault(part.literal)
            elif i not in seen:
                seen.add(i)
                stack.append((i, iter(every[i].parts)))
        return [*out]

    for k, d in enumerate(every):
        if weight := name_weight(d.name):
            found.update(secret(text, weight, literals_of(k)))
    if depth:
        for s, e in (*comments, *strings.values()):
            inside = text[s:e]
            if (":" in inside or "=" in inside or "</" in inside) and MAY_LEX.search(inside.lower()):
                skip = len(inside) - len(inside.lstrip("#/*<!-")) if (s, e) in comments else 0
                found.update((s + skip + x, s + skip + y) for x, y in lexed(inside[skip:], depth - 1))
    return sorted(found)


def secret(text: str, weight: float, literals: list[Span]) -> list[Span]:
    """The literals, if together they look like a secret of a name of this weight."""
    value = "".join(re.sub(r"\\(.)", r"\1", text[s:e]) for s, e in literals)
    if len(value) >= 6 and value.lower() not in PLACEHOLDERS and not value.startswith(("${", "$", "<", "http:", "https:")) and weight + randomness(value) >= THRESHOLD:
        return [(s, e) for s, e in literals if e > s]
    return []


#: A pair needs one of these, whatever stands around it; texts without any aren't lexed.
MAY_LEX = re.compile("|".join(sorted({"pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "sign", "salt", "pin", "session", "cookie", "dsn"})))
MAY_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points. Base kinds are leftmost and don't overlap within their kind."""
    if not text:
        return []
    low = text.lower()  # only for tests of what may be there
    found = []
    separated = ":" in text or "=" in text or "</" in text
    if separated and any(w in low for w in MAY_ASSIGN):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if separated and MAY_LEX.search(low):
        found += [("lexed", s, e) for s, e in lexed(text)]
    return found


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"]
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text), whatever its doc_id: counts of each base kind, digest of the base spans, all spans as text.

    Null or empty text: no spans. Repeated rows give repeated results. One narrow pass; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in column(b, "text"):
                spans = scan(text)
                n = Counter(k for k, _, _ in spans)
                base = joined(x for x in spans if x[0] != "lexed")
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), joined(spans), n["lexed"]))
            yield batch_of(NAMES, [column(b, "doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 6)], [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()])

    return documents(docs).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret span's text replaced by `[SECRET]`; overlapping spans are replaced as one; n_chars, where there is one,
    follows. All rows and columns stay; null and empty texts stay as they are."""
    fields = docs.schema

    def clean(text: str | None) -> str | None:
        spans = sorted((s, e) for _, s, e in scan(text))
        if not spans:
            return text
        out, at = [], 0
        merged: list[list[int]] = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            out += [text[at:s], "[SECRET]"]
            at = e
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            cleaned = [clean(t) for t in b.column(i).to_pylist()]
            b = b.set_column(i, b.schema.field(i), pa.array(cleaned, type=b.schema.field(i).type))
            if (j := b.schema.get_field_index("n_chars")) >= 0:
                b = b.set_column(j, b.schema.field(j), pa.array([None if t is None else len(t) for t in cleaned], type=b.schema.field(j).type))
            yield b

    return bounded(docs).mapInArrow(run, fields)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`secret_spans` of documents: a row per row. Null and empty texts have no spans; an empty table gives no row."""
    return secret_spans(table(spark, sf_dir, "documents"))
