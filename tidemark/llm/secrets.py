"""Secret scans: three base patterns and an assignment-aware lexer.

The lexer reads source and configuration syntax (Python, shell, JSON, YAML, INI, XML, call arguments,
subscripts, typed names, lists, labelled values, setters) into pairs of a name and the literals assigned to it. Names that get a constant are remembered, so
that `k = "…"; password = k` and `"…" + k` lead back to the literals. Each literal that reaches a
sensitive name is scored by that name and by how random it looks; spans of literals that pass are
added to the base spans, unless a base span holds them already.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

# The base patterns and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")
BASE_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Weights of name parts; a name takes its greatest.
NAMES = {
    "password": 0.7, "passwd": 0.7, "passphrase": 0.7, "secret": 0.7, "apikey": 0.7, "api_key": 0.7, "private_key": 0.7, "privatekey": 0.7,
    "access_key": 0.65, "accesskey": 0.65, "secret_key": 0.7, "client_secret": 0.7, "credential": 0.6, "token": 0.6, "pwd": 0.6, "auth": 0.45, "signing": 0.5, "salt": 0.4,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change[_-]?me|example|sample|dummy|test|todo|none|null|true|false|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|env|redacted|placeholder|password|secret|token)$")
THRESHOLD = 0.8

SKIP = r"(?P<skip>[ \t\r]+|\\\n%s)|(?P<comment>%s)|(?P<fence>```+)|"
STRING = r"""(?P<string>(?:[rbuf]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`(?!`)|(?:(?<=[=(+:])|(?<=[=(+:][ ]))`(?:[^`\\]|\\.)*`(?!`)))|"""
PLAIN = r"""(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|->|-)[A-Za-z_$][\w$]*)*)|(?P<op>:=|=>|==|!=|<=|>=|[=:+,;(){}\[\]])|(?P<line>\n)|(?P<bare>[^\s"'`,;(){}\[\]=:+]+)|(?P<other>.)"""


def grammar(skip: str, comment: str, strings: bool = True) -> re.Pattern:
    return re.compile(SKIP % (skip, comment) + (STRING if strings else "") + PLAIN, re.DOTALL)


# By whether a block comment can still end, and whether a string can.
LINES, REGIONS = r"(?:\#|//)[^\n]*", r"(?:\#|//)[^\n]*|/\*.*?\*/"
TOKEN = {(block, strings): grammar("", REGIONS if block else LINES, strings) for block in (False, True) for strings in (False, True)}
# Inside a comment, its marks are skipped, and there are no comments.
REMARK = {(block, strings): grammar(r"|\#+|//+|/?\*+/?", r"(?!)", strings) for block in (False, True) for strings in (False, True)}
LEAD = re.compile(r"\s*(?:(?:\#+|//+|/?\*+)\s*)?(?:export\s+|set\s+|-\s+|ENV\s+)?[\"']?")
BARE = re.compile(r"[^\s\"'`,;(){}\[\]#]+")
MEMBER = re.compile(r"\??(?:\.|->)[A-Za-z_$][\w$.]*")
SETTER = re.compile(r"(?:set|with|use)(?=[_A-Z])")
PUTTER = re.compile(r"(?i)define|set|put|add|append")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>\s*(?:<!\[CDATA\[)?([^\s<>]+?)(?:\]\]>)?\s*</\1\s*>")


# Words that only hold a sensitive one, and last words of names for what is about a secret, not the secret.
INNOCENT = re.compile(r"authors?(?![a-z])|secretar(?:y|ies)|tokeni[sz][a-z]*|(?:de|as)signing|basalt")
ABOUT = re.compile(r"(?:name|type|url|uri|path|file|field|label|length|limit|count|size|header|endpoint|hint|prefix|regex|pattern|policy)s?")


def name_weight(name: str) -> float:
    low = re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower())
    low = INNOCENT.sub("", low)
    if ABOUT.fullmatch(low.rstrip("_").rpartition("_")[2]):
        return 0.0
    return max((w for part, w in NAMES.items() if part in low or part in low.replace("_", "")), default=0.0)


def randomness(value: str) -> float:
    """0 to 0.4 by length, kinds of characters and entropy; negative for placeholders and prose."""
    if len(value) < 6 or PLACEHOLDER.match(value) or len(set(value)) < 4:
        return -1.0
    if re.search(r"\s", value):
        return -1.0 if len(value.split()) > 3 else 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return 0.1 * (n >= 8) + 0.1 * (kinds >= 2) + 0.1 * (kinds >= 3) + 0.1 * (entropy >= 2.75)


Tokens = list[tuple[str, str, int, int]]
Part = tuple[str, int, int]  # content, start and end of a string


def scan(rules: dict[tuple[bool, bool], re.Pattern], text: str, at: int, end: int) -> Iterator[re.Match]:
    """Tokens of text[at:end] in one pass: where a comment or a string was found not to end, none of its kind is tried again."""
    last = text.rfind("*/", at, end)
    dead = {'"': -1, "'": -1, "`": -1}  # up to these places no quote of the kind has a partner on its line
    while at < end:
        quote = next((c for c in text[at : min(at + 3, end)] if c in dead), "")
        m = rules[at < last, at >= dead.get(quote, -1)].match(text, at, end)
        if m.lastgroup == "other" and m.group() in dead:
            stop = text.find("\n", at, end)
            dead[m.group()] = end if stop < 0 else stop
        at = m.end()
        yield m


def lex(text: str) -> list[Tokens]:
    """The tokens (kind, token, start, end) of the text without comments, then those of each run of comments: what comes
    before a comment goes on behind it, and remarks of neighbouring lines are one text."""
    streams: list[Tokens] = [[]]
    stop = -1
    for m in scan(TOKEN, text, 0, len(text)):
        if m.lastgroup == "comment":
            if stop < 0 or not text[stop : m.start()].isspace():
                streams.append([])
            elif streams[-1]:
                streams[-1].append(("line", "\n", stop, stop))
            stop = m.end()
            streams[-1] += [(r.lastgroup, r.group(), r.start(), r.end()) for r in scan(REMARK, text, m.start(), stop) if r.lastgroup != "skip"]
        elif m.lastgroup != "skip":
            streams[0].append((m.lastgroup, m.group(), m.start(), m.end()))
    return streams


def string_body(token: str, start: int) -> tuple[str, int, int]:
    """Content of a string literal and its span without prefix and quotes."""
    head = len(token) - len(token.lstrip("rbufRBUF"))
    quote = 3 if token[head : head + 3] in ('"""', "'''") else 1
    return token[head + quote : len(token) - quote], start + head + quote, start + len(token) - quote


def literals(text: str) -> list[tuple[int, int, float]]:
    """Spans of literals that reach a sensitive name, with their scores."""
    constants: dict[str, list[Part]] = {}
    found: dict[tuple[int, int], float] = {}
    breaks = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
    for tokens in lex(text):
        Walk(text, breaks, tokens, constants, found).run()
    if "</" in text:
        for m in ELEMENT.finditer(text):
            judge(m[1], [(m[2], m.start(2), m.end(2))], found)
    return [(s, e, v) for (s, e), v in sorted(found.items())]


def judge(name: str, parts: list[Part], found: dict[tuple[int, int], float]) -> None:
    """Add the spans of `parts`, which are one value of `name`, to `found` if the two together score enough."""
    weight = name_weight(name)
    if weight:
        score = weight + randomness("".join(p[0] for p in parts))
        if score >= THRESHOLD:
            for _, s, e in parts:
                if e > s:
                    found[s, e] = max(score, found.get((s, e), 0.0))


class Walk:
    """One pass over the tokens of a text or of a run of comments. Constants go to `constants`, and literals that reach a
    sensitive name to `found`; both are shared by the runs of a text.

    Targets are names, strings (keys), subscripts (`a["key"] = ..`), names with a type, the label of a labelled value
    (`name: KEY`, `value: ..`), setters and calls of a key and a value. Values are literals, lists of them in brackets, or lines
    of dashes; each item of a list is judged by itself. `breaks` are the places of line feeds, with one before and one after
    the text.
    """

    def __init__(self, text: str, breaks: list[int], tokens: Tokens, constants: dict[str, list[Part]], found: dict[tuple[int, int], float]):
        self.text, self.breaks, self.tokens, self.constants, self.found = text, breaks, tokens, constants, found
        self.n = len(tokens)
        self.label = ("", -9)  # the last label, and the token behind it

    def run(self) -> None:
        i = 0
        while i < self.n - 1:
            i = self.step(i)

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if i < self.n else ""

    def op(self, i: int) -> str:
        return self.tokens[i][1] if self.kind(i) == "op" else ""

    def skip(self, i: int) -> int:
        """The next token that is not a line feed."""
        while self.kind(i) == "line":
            i += 1
        return i

    def step(self, i: int) -> int:
        """Read what starts with token `i`; the token to go on with."""
        kind, token, start, _ = self.tokens[i]
        if kind not in ("name", "string"):
            return i + 1
        if kind == "name" and self.op(i + 1) == "(":
            self.call(token, self.skip(i + 2))
            return i + 1
        name, j = (token, i + 1) if kind == "name" else (string_body(token, start)[0], i + 1)
        if kind == "name" and self.op(j) == "[":
            name, j = self.subscripts(name, j)
        op = self.op(j)
        if op not in ("=", ":", ":=", "=>"):
            return i + 1
        j = self.behind_type(j + 1) if op == ":" else j + 1
        parts, end = self.literal(j, start)
        target = self.label[0] if name.lower() == "value" and i - self.label[1] <= 3 else name
        if name.lower() in ("name", "key"):
            self.label = ("".join(p[0] for p in parts) or (self.tokens[j][1] if self.kind(j) == "name" else ""), max(end, j + 1))
        if parts:
            parts = list(dict.fromkeys(parts))
            self.constants[name] = parts
            judge(target, parts, self.found)
            return max(end, j)
        for item in self.items(j):
            judge(target, item, self.found)
        return j

    def literal(self, j: int, start: int = -1) -> tuple[list[Part], int]:
        """Parts of the literal at `j` (strings and constants, added up or side by side) and the token behind it. An
        unquoted value counts where the pair, which begins at place `start`, stands alone on its line."""
        parts: list[Part] = []
        expects = True
        while j < self.n:
            k, t, s, _ = self.tokens[j]
            if not expects:
                if k == "op" and t == "+":
                    j, expects = j + 1, True
                    continue
                if k != "string":  # neighbouring strings are one literal
                    break
            if k == "string":
                parts.append(string_body(t, s))
            elif k == "name" and t in self.constants and (j + 1 >= self.n or self.tokens[j + 1][1] not in ("(", "=", ":")):
                parts += self.constants[t]
            else:
                if k in ("name", "bare") and not parts and start >= 0:
                    parts = self.unquoted(start, s)
                break
            j, expects = j + 1, False
        return parts, j

    def unquoted(self, start: int, s: int) -> list[Part]:
        line = self.breaks[bisect_left(self.breaks, start) - 1] + 1
        if not LEAD.fullmatch(self.text, line, start):
            return []
        rest = self.text[s : self.breaks[bisect_left(self.breaks, s)]].rstrip()
        open_end = rest[:-1].rstrip("*") if rest.endswith("/") else rest
        rest = open_end.rstrip() if len(open_end) < len(rest) - 1 else rest
        m = BARE.match(rest)
        return [(m.group(), s, s + m.end())] if m and m.end() == len(rest) and re.search("[0-9]", m.group()) else []

    def subscripts(self, name: str, j: int) -> tuple[str, int]:
        """The name with its subscripts (`a["key"][0].part`) where an `=` follows them, and its place; else the name alone."""
        names, at = [name], j
        while self.op(at) == "[":
            if self.op(at + 1) == "]":
                at += 2
            elif self.op(at + 2) == "]" and self.kind(at + 1) in ("name", "string", "bare"):
                token, s = self.tokens[at + 1][1:3]
                names.append(string_body(token, s)[0] if self.kind(at + 1) == "string" else token)
                at += 3
            else:
                break
        if self.kind(at) == "bare" and MEMBER.fullmatch(self.tokens[at][1]):
            names.append(self.tokens[at][1])
            at += 1
        return ("_".join(names), at) if self.op(at) == "=" else (name, j)

    def behind_type(self, j: int) -> int:
        """The place of the value in `name: type = value`, else `j`."""
        e = j
        while self.kind(e) == "name":
            e += 1
            if self.op(e) == "[":
                while self.kind(e) == "name" or self.op(e) in ("[", ","):
                    e += 1
                while self.op(e) == "]":
                    e += 1
            if self.kind(e) != "bare" or self.tokens[e][1] != "|":
                break
            e += 1
        return e + 1 if e > j and self.op(e) == "=" else j

    def items(self, j: int) -> Iterator[list[Part]]:
        """The literals of the list at `j`, if there is one. A list ends, for now, where another target begins in it."""
        if self.op(j) == "[" and self.op(j + 1) == "]" and self.kind(j + 2) == "name":
            j += 3  # a type before the brackets
        if self.op(j) in ("[", "(", "{"):
            j = self.skip(j + 1)
            while j < self.n and self.op(j) not in ("]", ")", "}"):
                parts, end = self.literal(j)
                if end == j:  # no literal: numbers and other names are passed over
                    if self.op(j) not in ("", ",", ";"):
                        return
                    j = self.skip(j + 1)
                    continue
                j = self.skip(end)
                if self.op(j) not in ("", ",", ";", "]", ")", "}"):
                    return
                if parts:
                    yield parts
        else:
            while self.kind(j) == "line" and self.kind(j + 1) == "bare" and self.tokens[j + 1][1] == "-" and j + 2 < self.n:
                j += 2
                parts, _ = self.literal(j, self.tokens[j][2])
                while j < self.n and self.kind(j) != "line":
                    if self.op(j) in ("=", ":", ":=", "=>"):
                        return
                    j += 1
                if parts:
                    yield parts

    def call(self, name: str, j: int) -> None:
        """Arguments, from token `j`, of a setter (`setPassword(value)`) or of a call with a key and a value."""
        last = re.split(r"\.|->", name)[-1]
        setter = SETTER.match(last)
        parts, end = self.literal(j)
        if setter:
            for item in [parts] if parts and self.op(self.skip(end)) == ")" else self.items(j):
                judge(last, item, self.found)
        if PUTTER.match(last) and self.kind(j) == "string" and self.op(j + 1) == ",":
            key = string_body(self.tokens[j][1], self.tokens[j][2])[0]
            parts, end = self.literal(self.skip(j + 2))
            if parts and self.op(self.skip(end)) in (",", ")"):
                judge(f"{last}_{key}" if setter else key, parts, self.found)


def base_spans(text: str, low: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret part) of the base patterns."""
    found = []
    if any(w in low for w in BASE_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


SENSITIVE = tuple(sorted({p.replace("_", "") for p in NAMES}))
APART = re.compile("[^a-z0-9]+")


def sensitive(low: str) -> bool:
    """Whether a lower-case text can hold a name with a weight, whatever separates the name's parts."""
    return any(p in low for p in SENSITIVE) or any(map(APART.sub("", low).__contains__, SENSITIVE))


def find(text: str) -> list[tuple[int, int, int, int]]:
    """All spans of one text, as (start, kind, end, start of the secret part), by start and kind."""
    low = text.lower()
    found = base_spans(text, low)
    if any(c in text for c in "=:(<") and sensitive(low):
        starts, reach = [s for s, _, _, _ in found], list(accumulate((e for _, _, e, _ in found), max))
        inside = lambda s, e: (i := bisect_right(starts, s)) and reach[i - 1] >= e
        found += [(s, 3, e, s) for s, e, _ in literals(text) if not inside(s, e)]
    return sorted(found)


SPANS = "array<struct<kind:string,start:int,`end`:int,secret_start:int>>"


def secret_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with a column of spans (code points, end exclusive; `secret_start` is where the secret part begins).

    A map without a shuffle. Null and empty texts have no spans. Long texts are read whole. A column
    of `docs` that is named like `out` is replaced; all others stay, repeated rows too.
    """
    docs = docs.drop(out)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{out}` {SPANS}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "secret_start": at} for s, k, e, at in find(t or "")] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with the secret parts of all spans in `text` replaced by `mark`; overlapping parts by one mark.

    Null texts stay null. Columns, rows and their order in a partition stay as they are.
    """

    def clean(t: str | None) -> str | None:
        spans = find(t) if t else []
        if not spans:
            return t
        out, at, stop = [], 0, 0
        for s, e in sorted((at, e) for _, _, e, at in spans):
            if s >= stop:
                out += [t[at:s], mark]
            at = stop = max(stop, e)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array([clean(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_spans(docs).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), count("literal").alias("n_literal"))


QUERIES: dict[str, Callable] = {"op9_secret_scans": op9_secret_scans}
