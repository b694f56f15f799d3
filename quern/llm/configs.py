"""Parsers of configuration formats that keep places: every scalar with its key path and its offsets in the text.

JSON (with comments), YAML, TOML, XML, and files of key = value lines (INI, properties, .env). They are tolerant: what doesn't
fit the format is passed over, and the next line or token is read as usual, so fragments and damaged files still give their
scalars. Nothing is evaluated. Each parser is linear in the text and keeps its own stack, so depth is no limit.

In a mapping with a name (or key, id) and a value, the value is also given under the name.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

NAMES, VALUE = ("name", "key", "id"), "value"


class Leaf(NamedTuple):
    path: tuple[str, ...]
    #: Where the key stands, or -1 if it is a name beside the value.
    key_at: int
    #: Places of the value, without its quotes; several if it has pieces or lines.
    spans: tuple[tuple[int, int], ...]
    quoted: bool
    #: What may stand in place of the value: "text", or "bare" where it needs quotes of its own, or "lines" for a plain scalar of several lines.
    form: str


class _Mapping:
    """Names and values that stand side by side, whatever lies between them."""

    def __init__(self) -> None:
        self.name: str | None = None
        self.value: Leaf | None = None

    def see(self, text: str, leaf: Leaf) -> Iterator[Leaf]:
        yield leaf
        key = leaf.path[-1].lower() if leaf.path else ""
        if key in NAMES and self.name is None and len(leaf.spans) == 1:
            self.name = text[slice(*leaf.spans[0])]
        elif key == VALUE and self.value is None:
            self.value = leaf
        else:
            return
        if self.name is not None and self.value is not None:
            yield self.value._replace(path=(*self.value.path[:-1], self.name), key_at=-1)
            self.value = None


_FLOW = {
    ":": re.compile(r"""[^\S\n]+\#[^\n]*|//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[{}\[\],]|:(?=[\s"'{\[]|$)|(?:[^\s{}\[\],"':\#/]|[:/\#](?=\S))(?:[^{}\[\],:\n\#]|:(?=[^\s,{}\[\]"'])|(?<=\S)\#)*""", re.S),
    "=": re.compile(r"""\#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'[^'\n]*'|[{}\[\],=]|[^\s{}\[\],"'=\#]+""", re.S),
}


def _scalar(token: str, at: int) -> tuple[tuple[int, int], bool]:
    for quote in ('"""', "'''", '"', "'"):
        if token.startswith(quote) and token.endswith(quote) and len(token) >= 2 * len(quote):
            return (at + len(quote), at + len(token) - len(quote)), True
    return (at, at + len(token.rstrip())), False


def _flow(text: str, at: int, path: tuple[str, ...], sign: str, whole: bool = False) -> Iterator[Leaf | int]:
    """Scalars of the brackets that open at a place; lastly where they end. whole: until the end of the text, for JSON."""
    frames: list[list] = [[False, path, None, None, _Mapping()]] if whole else []  # list?, path, key, candidate, mapping
    end = at
    for m in _FLOW[sign].finditer(text, at):
        token, end = m[0], m.end()
        first = token[0]
        if first in "{[" and len(token) == 1:
            above = frames[-1] if frames else None
            own = above[1] if above and (above[0] or above[2] is None) else (*above[1], above[2][0]) if above else path
            frames.append([first == "[", own, None, None, _Mapping()])
        elif first in "}]" and len(token) == 1:
            if len(frames) > whole:
                frames.pop()
                if frames:
                    frames[-1][2] = frames[-1][3] = None
            if not frames:
                break
        elif token == ",":
            frames[-1][2] = frames[-1][3] = None
        elif token == sign:
            if frames[-1][3] is not None:
                frames[-1][2] = frames[-1][3]
        elif first in "#" or token.startswith(("//", "/*")) or first.isspace():
            continue
        else:
            span, quoted = _scalar(token, m.start())
            frame = frames[-1]
            if frame[0] or frame[2] is not None:
                key_at = -2 if frame[0] else frame[2][1]
                leaf = Leaf(frame[1] if frame[0] else (*frame[1], frame[2][0]), key_at, (span,), quoted, "text" if quoted else "bare")
                yield from (leaf,) if frame[0] else frame[4].see(text, leaf)
                if not frame[0]:
                    frame[2] = None
            else:
                frame[3] = (text[slice(*span)], m.start())
    yield end


def json_leaves(text: str) -> Iterator[Leaf]:
    for x in _flow(text, 0, (), ":", whole=True):
        if not isinstance(x, int):
            yield x


_YAML_KEY = re.compile(r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\n]|'')*)'|([^\s\-?:,\[\]{}\#&*!|>'"%@`][^\n:\#{}\[\],"']*?|-[^\s\n:\#{}\[\],"']+))[^\S\n]*:(?=\s|$)""")
_YAML_PROPERTY = re.compile(r"(?:[!&][^\s,{}\[\]]*[^\S\n]+)+")
_YAML_BLOCK = re.compile(r"[|>][+\-\d]*[^\S\n]*(?:#[^\n]*)?\r?(?:\n|$)")
_COMMENT = re.compile(r"(?:^|(?<=\s))#")


def _lines(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each line, without carriage return."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line) - line.endswith("\r")))
        at += len(line) + 1
    return out


def yaml_leaves(text: str) -> Iterator[Leaf]:
    lines = _lines(text)
    indents = [len(text[a:b]) - len(text[a:b].lstrip(" ")) if text[a:b].strip() else -1 for a, b in lines]
    stack: list[list] = [[-1, None, _Mapping()]]  # column, key (null for an item), mapping of what is below
    n = 0

    def path() -> tuple[str, ...]:
        return tuple(k for _, k, _ in stack if k is not None)

    def plain_end(p: int, end: int) -> int:
        m = _COMMENT.search(text, p, end)
        return p + len(text[p : m.start() if m else end].rstrip())

    def value(p: int, end: int, column: int, key_at: int, mapping: _Mapping) -> Iterator[Leaf]:
        """The value that begins at p, in line n - 1; takes the lines that belong to it."""
        nonlocal n
        if m := _YAML_PROPERTY.match(text, p, end):
            p = m.end()
        first = text[p : p + 1] if p < end else ""
        if first in "{[" and first:
            at = p
            for x in _flow(text, p, path(), ":"):
                if isinstance(x, int):
                    at = x
                else:
                    yield x
            while n < len(lines) and lines[n][0] < at:
                n += 1
            return
        if first in "|>" and first and _YAML_BLOCK.match(text, p):
            spans = []
            while n < len(lines) and (indents[n] > column or indents[n] < 0):
                a, b = lines[n]
                if indents[n] >= 0:
                    spans.append((a + indents[n], a + len(text[a:b].rstrip())))
                n += 1
            if spans:
                yield from mapping.see(text, Leaf(path(), key_at, tuple(spans), True, "text"))
            return
        if first in "\"'" and first:
            quote, at, spans = first, p + 1, []
            while True:
                stop = at
                while stop < end and text[stop] != quote:
                    stop += 2 if text[stop] == "\\" and quote == '"' else 1
                closed = stop < end
                if closed and quote == "'" and text[stop + 1 : stop + 2] == "'" and stop + 1 < end:
                    own = at
                    while stop < end and text[stop] == "'" and text[stop + 1 : stop + 2] == "'":
                        stop = text.find("'", stop + 2, end)
                        if stop < 0:
                            stop, closed = end, False
                            break
                    at = own
                stop = min(stop, end)
                if stop > at:
                    spans.append((at, stop))
                if closed or n >= len(lines) or 0 <= indents[n] <= column or spans and len(spans) == 1 and not _closes(text, lines, indents, n, column, quote):
                    break
                a, end = lines[n]
                at = a + max(indents[n], 0)
                n += 1
            if spans:
                yield from mapping.see(text, Leaf(path(), key_at, tuple(spans), True, "text"))
            return
        if not first or first == "#":  # nested, or a scalar on the next line
            k = n
            while k < len(lines) and (indents[k] < 0 or text[lines[k][0] + indents[k]] == "#"):
                k += 1
            if k >= len(lines) or indents[k] <= column:
                return
            a, b = lines[k]
            p = a + indents[k]
            if text[p] == "-" and text[p + 1 : p + 2] in (" ", "\t", "\r", "\n", "") or _YAML_KEY.match(text, p, b) or text[p] in "{[|>?":
                return
            n = k + 1
            yield from value(p, b, column, key_at, mapping)
            return
        spans = [(p, plain_end(p, end))]
        while n < len(lines) and indents[n] > column:
            a, b = lines[n]
            q = a + indents[n]
            if text[q] in "#-?" or _YAML_KEY.match(text, q, b):
                break
            spans.append((q, plain_end(q, b)))
            n += 1
        if spans[0][1] > spans[0][0]:
            yield from mapping.see(text, Leaf(path(), key_at, tuple(spans), False, "bare" if len(spans) == 1 else "lines"))

    while n < len(lines):
        a, end = lines[n]
        column = indents[n]
        n += 1
        if column < 0 or text[a + column] == "#":
            continue
        p = a + column
        if column == 0 and text.startswith(("---", "..."), p):
            del stack[1:]
            continue
        while text[p : p + 1] == "-" and (text[p + 1 : p + 2] in (" ", "\t") or p + 1 >= end):
            while len(stack) > 1 and (stack[-1][0] > column or stack[-1][0] == column and stack[-1][1] is None):
                stack.pop()
            stack.append([column, None, _Mapping()])
            q = p + 1
            while q < end and text[q] in " \t":
                q += 1
            column += q - p
            p = q
            if p >= end:
                break
        if p >= end or text[p] == "#":
            continue
        if m := _YAML_KEY.match(text, p, end):
            while len(stack) > 1 and stack[-1][0] >= column:
                stack.pop()
            mapping = stack[-1][2]
            stack.append([column, next(x for x in m.groups() if x is not None).strip(), _Mapping()])
            q = m.end()
            while q < end and text[q] in " \t":
                q += 1
            depth, given = len(stack), False
            for leaf in value(q, end, column, p, mapping):
                given = True
                yield leaf
            if given:  # nothing lies below a key that has a value
                del stack[depth - 1 :]
        elif stack[-1][0] >= 0 and any(k is not None for _, k, _ in stack) or text[p] in "{[":
            yield from value(p, end, max(stack[-1][0], 0), -2, _Mapping())


def _closes(text: str, lines: list, indents: list, n: int, column: int, quote: str) -> bool:
    """Whether an open quote is closed on the lines from n on that are deeper than a column."""
    while n < len(lines) and (indents[n] > column or indents[n] < 0):
        if quote in text[slice(*lines[n])]:
            return True
        n += 1
    return False


_TOML_KEY = re.compile(r"""[^\S\n]*((?:"[^"\n]*"|'[^'\n]*'|[\w\-À-ÿ]+)(?:[^\S\n]*\.[^\S\n]*(?:"[^"\n]*"|'[^'\n]*'|[\w\-À-ÿ]+))*)[^\S\n]*=[^\S\n]*""")
_TOML_SECTION = re.compile(r"[^\S\n]*\[+([^\]\n]+)\]+")
_TOML_PART = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'|([\w\-À-ÿ]+)")
_TOML_VALUE = re.compile(r"""\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'[^'\n]*'|[^\s\#,{}\[\]"'][^\n\#]*""", re.S)


def _parts(dotted: str) -> tuple[str, ...]:
    return tuple(next(x for x in m.groups() if x is not None) for m in _TOML_PART.finditer(dotted))


def toml_leaves(text: str) -> Iterator[Leaf]:
    section: tuple[str, ...] = ()
    mapping = _Mapping()
    at = 0
    while 0 <= at < len(text):
        if m := _TOML_SECTION.match(text, at):
            section, mapping = _parts(m[1]), _Mapping()
        elif m := _TOML_KEY.match(text, at):
            key_at, path, p = m.start(1), section + _parts(m[1]), m.end()
            if text[p : p + 1] in ("{", "["):
                for x in _flow(text, p, path, "="):
                    if isinstance(x, int):
                        at = x
                    else:
                        yield x
            elif v := _TOML_VALUE.match(text, p):
                span, quoted = _scalar(v[0], p)
                spans = (span,) if "\n" not in text[slice(*span)] else tuple((a, b) for a, b in _pieces(text, *span))
                if spans:
                    yield from mapping.see(text, Leaf(path, key_at, spans, quoted, "text" if quoted else "bare"))
                at = v.end()
        at = text.find("\n", at) + 1 or len(text)


def _pieces(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Lines between two places that aren't blank, without their indent and trailing blanks."""
    for m in re.finditer(r"[^\n]+", text[a:b]):
        own = m[0].strip()
        if own:
            p = a + m.start() + m[0].index(own[0])
            yield p, p + len(own)


_PAIR = re.compile(r"^[^\S\n]*(?:export[^\S\n]+|set[^\S\n]+|-[^\S\n]+)?([A-Za-z_À-ÿ][\wÀ-ÿ.\-]*(?:\[[^\]\n]*\])?)[^\S\n]*[=:][^\S\n]*")
_SECTION = re.compile(r"^[^\S\n]*\[([^\]\n]+)\][^\S\n]*(?:[#;].*)?$")
_END = re.compile(r"\s+[#;](?=\s|$)|\s+//\s|\s+--\s|\s+\\?\s*$")


def pair_leaves(text: str) -> Iterator[Leaf]:
    """INI, properties and .env."""
    lines = _lines(text)
    section: tuple[str, ...] = ()
    n = 0
    while n < len(lines):
        a, end = lines[n]
        n += 1
        line = text[a:end]
        if m := _SECTION.match(line):
            section = tuple(m[1].strip().strip("\"'").split("."))
            continue
        m = _PAIR.match(line.lstrip("\ufeff"))
        if not m:
            continue
        shift = len(line) - len(line.lstrip("\ufeff"))
        p, key_at = a + shift + m.end(), a + shift + m.start(1)
        path = section + (m[1],)
        quote = text[p : p + 1] if p < end else ""
        if quote in "\"'`" and quote:
            stop = p + 1
            while stop < end and text[stop] != quote:
                stop += 2 if text[stop] == "\\" and quote == '"' else 1
            if stop >= end and quote != "`":  # goes on below, if the quote is closed before another pair begins
                k = n
                while k < len(lines) and quote not in text[slice(*lines[k])] and not _PAIR.match(text[slice(*lines[k])]):
                    k += 1
                if k < len(lines) and quote in text[slice(*lines[k])] and not _PAIR.match(text[slice(*lines[k])]):
                    stop, n = text.index(quote, lines[k][0]), k + 1
                else:
                    continue
            spans = tuple(_pieces(text, p + 1, min(stop, len(text))))
            if spans:
                yield Leaf(path, key_at, spans, True, "text")
            continue
        spans = []
        while True:
            cut = _END.search(text, p, end)
            stop = min(cut.start() if cut and cut.start() >= p else end, end)
            goes_on = text[p:end].rstrip().endswith("\\")
            stop = p + len(text[p:stop].rstrip().rstrip("\\;,\"'`").rstrip())
            if stop > p:
                spans.append((p, stop))
            if not goes_on or n >= len(lines) or _PAIR.match(text[slice(*lines[n])]):
                break
            a, end = lines[n]
            p = a + len(text[a:end]) - len(text[a:end].lstrip())
            n += 1
        if spans:
            yield Leaf(path, key_at, tuple(spans), False, "text")


_XML = re.compile(r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|</\s*([\w.\-:]+)\s*>|<([A-Za-z_][\w.\-:]*)((?:\s+[\w.\-:]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([\w.\-:]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def xml_leaves(text: str) -> Iterator[Leaf]:
    stack: list[list] = []  # name, place, pieces of text, has children, mapping of children
    at = 0
    for m in _XML.finditer(text):
        if stack and not stack[-1][3]:
            stack[-1][2].extend(_pieces(text, at, m.start()))
        at = m.end()
        if m[1] is not None:
            if stack:
                stack[-1][2].extend(_pieces(text, *m.span(1)))
        elif m[3]:
            path = (*(x[0] for x in stack), m[3])
            mapping = _Mapping()
            for x in _ATTRIBUTE.finditer(text, *m.span(4)):
                k = 2 if x[2] is not None else 3
                leaf = Leaf((*path, x[1]), x.start(1), (x.span(k),), True, "text")
                yield from mapping.see(text, leaf)
            if stack:
                stack[-1][3] = True
            if not m[5]:
                stack.append([m[3], m.start(), [], False, _Mapping(), mapping.name])
        elif m[2]:
            depth = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 200), -1) if stack[i][0] == m[2]), None)
            if depth is None:
                continue
            name, place, spans, children, _, attribute = stack[depth]
            path = tuple(x[0] for x in stack[: depth + 1])
            del stack[depth:]
            if spans and not children:
                leaf = Leaf(path, place, tuple(spans), True, "text")
                if stack:
                    yield from stack[-1][4].see(text, leaf)
                else:
                    yield leaf
                if attribute is not None:
                    yield leaf._replace(path=(*path[:-1], attribute), key_at=-1)


PARSERS = {"json": json_leaves, "yaml": yaml_leaves, "toml": toml_leaves, "pairs": pair_leaves, "xml": xml_leaves}
EXTENSIONS = {
    "json": "json", "jsonc": "json", "json5": "json", "ipynb": "json", "tfstate": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "config": "xml", "csproj": "xml", "plist": "xml", "xsd": "xml", "pom": "xml",
    "ini": "pairs", "cfg": "pairs", "conf": "pairs", "properties": "pairs", "env": "pairs", "cnf": "pairs",
}
_SHAPES = (
    ("xml", re.compile(r"\s*<(?:\?xml|[A-Za-z_][\w.\-]*[\s>])")),
    ("json", re.compile(r"\s*(?:\{\s*[\"}]|\[\s*[\[{\"\d])")),
)
_PAIR_LINE = re.compile(r"(?m)^[A-Za-z_][\w.\-]*=\S*$")
_YAML_LINE = re.compile(r"(?m)^\s*(?:- )?[A-Za-z_][\w.\-]*:(?: \S.*)?$")


def format_of(path: str, kind: str, text: str) -> str | None:
    """The configuration format of a file by its name, or where that tells nothing by its kind and its beginning; null for code
    and prose."""
    name = path.rsplit("/", 1)[-1].lower()
    if name.startswith(".env") or ".env." in name:
        return "pairs"
    if "." in name:
        return EXTENSIONS.get(name.rsplit(".", 1)[-1])
    if "python" in kind or "markdown" in kind:
        return None
    for shape, pattern in _SHAPES:
        if pattern.match(text):
            return shape
    lines = text.count("\n") + 1
    if len(_PAIR_LINE.findall(text)) * 2 > lines:
        return "pairs"
    return "yaml" if len(_YAML_LINE.findall(text)) * 2 > lines else None


def leaves(text: str, shape: str | None) -> list[Leaf]:
    return list(PARSERS[shape](text)) if shape else []
