"""Literal credentials in source code, notes and configuration: where they are, and the text without them.

Configuration (JSON, YAML, TOML, XML, INI, properties, .env; by the name of the file, or where that tells nothing by its kind
and its beginning) is parsed into key paths with the places of their values (configs.py): a value is a finding if the last words
of its key are sensitive and the value is literal: no placeholder, no reference to environment, vault or file, no name of a
secret, no switch or small number. Code and prose, comments, and texts inside values have no such structure; there assignments
are found by the shape of a line, in Python, JavaScript, SQL and Terraform only with a quoted literal. Beside them stand, in
every file, the places where a credential needs no key: tokens with a known head, logins within addresses, Basic and Bearer
headers, options of commands, SQL users, words of a comment, and PEM blocks. Redaction splices a mark into the original text at
the values; every other byte stays, the lines of a PEM block keep their number and indent, quotes are never touched, and a value
without quotes gets them where its format would read the mark as something else, so a file that could be parsed still can.

Null and empty texts give no row. A line on which several credentials begin counts once. Repeated file_ids are separate files.
Lines are separated by \\n and counted from 1; a carriage return or byte order mark is part of its line. The scan is linear in
the text, row by row, without a shuffle.
"""

import bisect
import base64
import binascii
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import configs, langwords
from quern.session import spread

MARK = "[REDACTED]"


class Finding(NamedTuple):
    line_no: int
    kind: str
    key: str
    #: Places in the text, to be redacted; the first one begins on line_no.
    spans: tuple
    #: What comes in place of each of the spans, if it isn't the mark alone.
    marks: tuple = ()


#: Heads of tokens that name their issuer, with the shape that follows (hyk. stands in the test tables; no public issuer is known).
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_\-/+])(?:"
    r"sk-(?:[a-z]+-)?[A-Za-z0-9_\-]{20,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|gh[opsur]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w\-]{18,}|xox[abeoprs]-[\w\-]{16,}"
    r"|A(?:KIA|SIA)[0-9A-Z]{16}(?![0-9A-Z])|AIza[\w\-]{30,}|eyJ[\w\-]{8,}={0,2}\.eyJ[\w\-]{4,}={0,2}\.[\w\-]{16,}|hyk\.[A-Za-z0-9]{6,}\.[A-Za-z0-9]{16,}|hf_[A-Za-z0-9]{30,}|npm_[A-Za-z0-9]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}"
    r")"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
LOGIN_IN_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.\-]*://[^\s/@:\"'`<>]*:([^\s/\"'`<>]+)@")
HEADER = re.compile(r"(?i)\b(basic|bearer|token)\s+([A-Za-z0-9._~+/\-]{8,}={0,2})")
OPTION = re.compile(r"(?<![\w\-])--?([A-Za-z][\w.\-]*)(?:=|[ \t]+)(\"[^\"\n]*\"|'[^'\n]*'|[^\s\"'`\\]+)")
SSHPASS = re.compile(r"\bsshpass\s+-p\s*(\"[^\"\n]*\"|'[^'\n]*'|[^\s\"'`]+)")
SQL_USER = re.compile(r"(?i)\b(?:identified\s+(?:with\s+\S+\s+)?by|(?:with\s+|encrypted\s+)password)\s+(?:password\s+)?'([^'\n]*)'")
_WORD = r"(\"[^\"\n]*\"|'[^'\n]*'|[^\s\"'`;|&]+)"
#: Options of commands that take a login or a password: what has to be in the line, and the value with its quotes.
COMMANDS = (
    ("sshpass", SSHPASS),
    ("by", SQL_USER),
    ("password", SQL_USER),
    ("curl", re.compile(r"\bcurl\b[^\n|;]*?\s(?:-u|--user|--proxy-user|-U)[ =]?[\"']?[^\s:\"'$]+:([^\s\"'`]+)")),
    ("wget", re.compile(rf"\bwget\b[^\n|;]*?\s--(?:http-|ftp-|proxy-)?password[ =]{_WORD}")),
    ("mysql", re.compile(rf"\bmysql(?:dump|admin|import|show)?\b[^\n|;]*?\s-p{_WORD}")),
    ("mariadb", re.compile(rf"\bmariadb(?:-dump|-admin)?\b[^\n|;]*?\s-p{_WORD}")),
    ("redis-cli", re.compile(rf"\bredis-cli\b[^\n|;]*?\s-a\s+{_WORD}")),
    (" login", re.compile(rf"\b(?:docker|podman|helm|az|oc)\s+(?:registry\s+)?login\b[^\n|;]*?\s-p\s+{_WORD}")),
    ("pass:", re.compile(r"\s-(?:pass|passin|passout|k)\s+[\"']?pass:([^\s\"'`]+)")),
    ("htpasswd", re.compile(rf"\bhtpasswd\s+-\w*b\w*\s+\S+\s+\S+\s+{_WORD}")),
)
XML_TAG = re.compile(r"<([A-Za-z_][\w.\-:]*)(?:\s[^<>]*)?>\s*([^<>]*?)\s*</\1\s*>")
XML_PAIR = re.compile(r"""<[^<>]*?\b(?:name|key|id)\s*=\s*["']([^"']*)["'][^<>]*?\bvalue\s*=\s*["']([^"'\n]*)["']""")
#: key, then = : := or =>, then an opening quote with its prefix or the rest of the line.
ASSIGNMENT = re.compile(
    r"""(?P<key>["']?[A-Za-z_À-ÿ][\wÀ-ÿ.\-]*["']?\]?)\s*(?::\s*(?:str|string|bytes|String|Optional\[str\])\s*)?(?:=>|:=|=(?!=)|:(?![:/\\]))\s*"""
    r"""(?:\(\s*)?(?:(?:[bBrRuUfF]{1,2})?(?P<quote>\"\"\"|'''|["'`])|(?P<bare>[^\s"'`,;(){}\[\]][^\n]*))"""
)
OPERATOR = re.compile(r"=>|:=|=(?!=)|:(?![:/\\])")
PROSE = re.compile(
    r"(?i)\b(?:password|passwd|passphrase|pwd|token|secret|api[ _-]?key|clave|contrase[ñn]a|passwort|kennwort|schl[üu]ssel|mot de passe|senha|contrasenya|chave|chiave)\b"
    r"(?:\s+(?:for|de|of|para|pour|für|per|del|da|do|di|von)\s+[\w.\-]+)?\s*(?:\s(?:is|es|est|ist|é|è)\s|[:=/]|\s)\s*[\"'`]?([^\s\"'`,;]+)"
)
JSON_PAIR = re.compile(r"""["'](?:name|key|id)["']\s*:\s*["']([^"'\n]*)["'][^{}\n]*?["']value["']\s*:\s*["']([^"'\n]*)["']""")
#: A key whose value is on the lines below: a YAML block, or quoted pieces.
BLOCK_KEY = re.compile(r"""^\s*(?:-\s+)?["']?([A-Za-z_À-ÿ][\wÀ-ÿ.\-]*)["']?\s*:\s*[|>][+\-\d]*\s*(?:#.*)?$""")
OPEN_KEY = re.compile(r"""(["']?[A-Za-z_À-ÿ][\wÀ-ÿ.\-]*["']?\]?)\s*(?::\s*str\s*=|=>|:=|=|:)\s*\(?\s*\\?\s*$""")
YAML_NAME = re.compile(r"^(\s*-?\s*)name:\s*[\"']?([\w.\-]+)[\"']?\s*$")
YAML_VALUE = re.compile(r"^\s*value:\s*(\"[^\"\n]*\"|'[^'\n]*'|[^\s#].*?)\s*$")
PIECE = re.compile(r"""^\s*[+.]?\s*[bBrRuUfF]{0,2}(["'`])([^"'`\n]*)\1\s*(?:\+|\\|\)|;|,|$)""")
#: Parts of every line that can hold a finding, in small letters.
INTERESTING = ("pass", "pwd", "clave", "contra", "secret", "token", "key", "cred", "auth", "bearer", "basic", "login", "senha", "kennwort", "chave", "chiave", "begin", "://", "value", "sk-", "sk_", "rk_", "pk_", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat", "glpat", "xox", "akia", "asia", "aiza", "eyj", "hyk.", "hf_", "npm_", "sg.", "identified", "parola", "schl", "jwt", "session", "cookie", "pat", "phrase", "frase", "mnemonic", "curl", "mysql", "mariadb", "redis-cli")
_K = re.compile(r"\b[kK]\b")
#: Keys whose value may be a phrase of plain words.
PHRASES = ("passphrase", "mnemonic", "seedphrase", "recoveryphrase", "frasesecreta", "fraseclave", "wachtwoordzin")

#: Last words of a key that name a credential, without separators and accents.
STRONG = (
    "password", "passwd", "pwd", "passphrase", "passcode", "passwort", "kennwort", "clave", "contrasena", "contrasenya", "senha", "motdepasse", "parola",
    "secret", "token", "apikey", "accesskey", "servicekey", "secretkey", "privatekey", "signingkey", "encryptionkey", "authkey", "masterkey", "sharedkey", "accountkey", "appkey", "clientkey", "sshkey", "tlskey", "sslkey",
    "bearer", "authorization", "credentials", "credential", "dbpass", "userpass", "rootpass", "adminpass", "ftppass", "smtppass",
)
#: Keys that may hold a credential; the value has to look random.
WEAK = ("key", "auth", "login", "cred", "creds", "pat", "jwt", "session", "cookie")
#: Keys that end in a sensitive word and hold none.
HARMLESS = ("publickey", "pubkey", "primarykey", "foreignkey", "cachekey", "sortkey", "partitionkey", "indexkey", "groupkey", "hashkey", "rowkey", "mapkey", "dictkey", "keytoken", "nexttoken", "pagetoken", "palabraclave", "padtoken", "eostoken", "bostoken", "unktoken", "stoptoken", "keyword", "bypass")
QUALIFIERS = ("prod", "production", "staging", "stage", "dev", "test", "old", "new", "live", "value", "default", "plain", "literal", "base64", "b64")
LITERAL_LANGUAGES = ("py", "js", "ts", "jsx", "tsx", "mjs", "tf", "sql", "go", "java", "rb", "php", "rs", "c", "cpp", "cs", "kt", "scala", "swift", "hcl")

#: Words that stand where a credential is to be put.
PLACEHOLDERS = {
    "changeme", "change", "changeit", "example", "sample", "todo", "fixme", "tbd", "redacted", "removed", "hidden", "masked", "dummy", "fake", "placeholder", "none", "null", "nil", "undefined", "empty", "unset", "true", "false",
    "yes", "no", "on", "off", "string", "str", "text", "bytes", "required", "optional", "default", "password", "passwd", "secret", "token", "key", "apikey", "foo", "bar", "foobar", "test", "testing", "replace", "replaceme", "insert", "value", "user", "username", "admin", "root", "somepassword", "mypassword", "yourpassword", "notasecret", "xxx",
}
_SENSITIVE_WORD = re.compile(r"(?i)pass|token|secret|key|cred|clave|contrase|auth")
_REFERENCE = re.compile(r"(?i)^(?:\$|%[\w.]+%$|\{\{|<|@\w+@$|#\{|__\w+__$|\[|(?:env|vault|secret|secrets|file|ref|ssm|arn|keyring|op|aws|gcp|azure|sops|kms|config|var|local|data|process|os|self|this|settings|args|options|params)[:.]|enc\()")
_STAND_IN = re.compile(r"(?i)^(?:your|my|insert|replace|put|enter|add|paste|some|the)[\W_].*|.*(?:[\W_]here|_goes_here|placeholder|change[\W_]?me|example|redacted|dummy)$|^[x*.#?•\-_]+$|^x{3,}.*x$|^0+$|^(.)\1+$|^<.*>$|^\*+.*\*+$|^\.\.\.|…$")


def _flat(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower().replace("ñ", "n").replace("ç", "c").replace("é", "e"))


@lru_cache(maxsize=100_000)
def sensitivity(key: str) -> int:
    """2 for a key that names a credential, 1 for one that may hold one, else 0."""
    words = [w for w in re.split(r"[^A-Za-z0-9À-ÿ]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key.strip("\"'`]"))) if w]
    while len(words) > 1 and (words[-1].lower() in QUALIFIERS or words[-1].isdigit()):
        words.pop()
    if not words:
        return 0
    flat = re.sub(r"\d+$", "", _flat("".join(words)))
    if flat.endswith(HARMLESS) or "public" in flat:
        return 0
    if flat.endswith(STRONG) or words[-1].lower() == "pass":
        return 2
    return 1 if flat.endswith("key") or words[-1].lower() in WEAK or flat == "k" else 0


def entropy(value: str) -> float:
    counts = [value.count(c) / len(value) for c in set(value)]
    return -sum(p * math.log2(p) for p in counts)


def random_like(value: str, least: int = 12) -> bool:
    if len(value) < least or re.search(r"\s", value):
        return False
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return bool(re.search("[0-9]", value)) and kinds >= 2 and entropy(value) >= 2.8


def literal(value: str) -> bool:
    """Neither a placeholder nor a reference, a name, a path, a switch or a small number."""
    bare = value.strip()
    if len(bare) < 4 or _REFERENCE.match(bare) or _STAND_IN.match(bare) or "{{" in bare or "${" in bare or "$(" in bare:
        return False
    if _flat(bare) in PLACEHOLDERS or not _flat(bare):
        return False
    if re.fullmatch(r"[\d.,_\s]+", bare) and len(bare) < 8:
        return False
    if bare.startswith(("ssh-", "data:", "ecdsa-", "/", "./", "../", "~/")) or re.fullmatch(r"[a-z][a-z0-9_\-]*(?:/[a-z][a-z0-9_\-.]*)+", bare) or re.match(r"^[A-Za-z]:\\", bare):
        return False
    if re.match(r"(?i)^[a-z][a-z0-9+.\-]*://", bare):
        return False
    if re.fullmatch(r"[A-Za-z]+(?:[_\-. ][A-Za-z]+)*", bare) and _SENSITIVE_WORD.search(bare):
        return False  # the name of a secret
    if bare.startswith("-----BEGIN") or "-----BEGIN" in bare:
        return False
    return True


_FUNCTION_WORDS = frozenset(w for text in langwords.WORDS.values() for w in text.split() if len(w) > 1)
_WORD_OF_PHRASE = re.compile(r"[^\W_]+(?:[-_.][^\W_]+)*")


def _phrase(value: str) -> bool:
    """Plain words without a function word: no sentence."""
    ws = value.split()
    return all(_WORD_OF_PHRASE.fullmatch(w) for w in ws) and not any(w.lower() in _FUNCTION_WORDS for w in ws)


def accepts(level: int, value: str, quoted: bool, key: str = "") -> bool:
    if not literal(value) or re.match(r"(?i)^(?:basic|bearer|token)\s", value):
        return False
    if level == 2:
        if re.search(r"\s", value.strip()):
            words = value.split()
            if re.search(r"\d", value):
                return quoted and (len(words) <= 6 or _phrase(value))
            return len(words) >= 3 and _flat(key).endswith(PHRASES) and _phrase(value)
        if re.search(r"[(){}\[\]]", value) and not quoted:
            return False
        return quoted or bool(re.search(r"[^a-z]", value))
    return level == 1 and random_like(value)


def _basic(value: str) -> bool:
    try:
        login = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, password = login.partition(":")
    return bool(colon) and login.isprintable() and literal(password)


def _closing(text: str, start: int, quote: str, limit: int) -> int:
    """Where the string that opened before start ends, or -1."""
    if len(quote) == 3:
        return text.find(quote, start)
    i = start
    while i < limit:
        c = text[i]
        if c == "\\" and quote != "`":
            i += 2
            continue
        if c == quote:
            return i
        i += 1
    return -1


def _bare_end(text: str, start: int, end: int) -> int:
    """End of an unquoted value: before a comment, a closing mark or a line continuation."""
    value = text[start:end]
    value = re.split(r"\s+(?:#|//|--|<!--|\\)|\s*\\\s*$|[`\"';,]\s*$|(?<=\S)[ \t]+$|\r$", value, maxsplit=1)[0].rstrip(" \t\r`\"';,\\")
    return start + len(value)


_HEADING = re.compile(r"^\s*\[+([^\]\"']+)\]+\s*(?:#.*)?$")
_OPENING = re.compile(r"""^(\s*)(?:-\s+)?["']?([\w.\-]+)["']?\s*(?::\s*\{?|\s*(?:=\s*)?\{|:\s*[|>][+-]?)\s*$""")


class _Path:
    """The key path of the current line: nesting by indent, or by section header."""

    def __init__(self) -> None:
        self.section, self.stack = "", []

    def enter(self, line: str) -> None:
        if "[" in line and (m := _HEADING.match(line)):
            self.section, self.stack = m[1].strip(), []
        elif (":" in line or "{" in line) and (m := _OPENING.match(line)):
            depth = len(m[1])
            while self.stack and self.stack[-1][0] >= depth:
                self.stack.pop()
            self.stack.append((depth, m[2]))

    def of(self, line: str, key: str) -> str:
        depth = len(line) - len(line.lstrip())
        above = [name for d, name in self.stack if d < depth]
        return ".".join([*([self.section] if self.section else []), *above, key.strip("\"'`]")])


_BODY = re.compile(r"(?:[^\S\n]*(?:#|//|--)?[^\S\n]*[A-Za-z0-9+/=:,\- ]+\r?(?:\n|$)|\\n|[A-Za-z0-9+/=])*")


def _pem_spans(text: str, start: int, stop: int) -> tuple:
    """The body of the private key whose BEGIN mark ends at start, line by line, up to its END mark; where that is missing
    (stop is negative), as far as lines look like a body."""
    if stop < 0:
        m = _BODY.match(text, start, -stop)
        stop = m.end() if m else start
    spans = []
    for line in re.finditer(r"[^\n]+", text[start:stop]):
        m = re.search(r"(?:\\[rn]|[A-Za-z0-9+/=]).*(?<![\s\"'`,;])", line[0]) if line.start() == 0 else re.search(r"[A-Za-z0-9+/=].*(?<![\s\"'`,;])", line[0])
        if m:
            head = 2 if m[0].startswith(("\\n", "\\r")) else 0
            if len(m[0]) > head:
                spans.append((start + line.start() + m.start() + head, start + line.start() + m.end()))
    return tuple(spans)


def _key_ahead(line: str, at: int) -> int:
    """Where the key begins that ends before an operator, or -1."""
    i = at
    while i > 0 and line[i - 1] in " \t":
        i -= 1
    if i > 0 and line[i - 1] == "]":
        i -= 1
    quote = line[i - 1] if i > 0 and line[i - 1] in "\"'" else ""
    i -= bool(quote)
    end = i
    while i > 0 and (line[i - 1].isalnum() or line[i - 1] in "_.-"):
        i -= 1
    while i < end and not (line[i].isalpha() or line[i] == "_"):
        i += 1
    if i == end:
        return -1
    return i - 1 if quote and i > 0 and line[i - 1] == quote else i


def _structured(text: str, shape: str | None, line_of) -> tuple[list[Finding], list[tuple[int, int]]]:
    """Findings by the parser of a format, and (begin, begin of the value) of all keys that it read."""
    out, keys = [], []
    for leaf in configs.leaves(text, shape):
        if leaf.key_at >= 0:
            keys.append((leaf.key_at, leaf.spans[0][0]))
        key = leaf.path[-1] if leaf.path else ""
        level = sensitivity(key) if leaf.key_at != -2 else 0  # members of lists have no key of their own
        if not level:
            continue
        value = "".join(text[a:b] for a, b in leaf.spans)
        if not accepts(level, value if len(leaf.spans) == 1 or not leaf.quoted or " " not in value else " ".join(text[a:b] for a, b in leaf.spans), leaf.quoted, key):
            continue
        if leaf.form == "bare" and shape in ("json", "toml"):
            marks = (f'"{MARK}"',)
        elif leaf.form == "lines":
            marks = (f'"{MARK}', *[MARK] * (len(leaf.spans) - 2), f'{MARK}"')
        else:
            marks = ()
        out.append(Finding(line_of(leaf.spans[0][0]), "assignment", ".".join(leaf.path), leaf.spans, marks))
    return out, keys


def scan(text: str, path: str = "", source_kind: str = "") -> list[Finding]:
    """Findings in the order of their lines."""
    kind = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path else ""
    quoted_only = kind in LITERAL_LANGUAGES
    out: list[Finding] = []
    taken: list[tuple[int, int]] = []
    where, at, line_no = _Path(), 0, 0
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    shape = configs.format_of(path, source_kind, text)
    parsed, keys = _structured(text, shape, lambda at: bisect.bisect_right(starts, at)) if shape else ([], [])
    keys.sort()
    by_line: dict[int, list[tuple[int, int]]] = {}
    for f in parsed:
        for span in f.spans:
            by_line.setdefault(bisect.bisect_right(starts, span[0]), []).append(span)
    pem = [(m.start(), m.end(), True) for m in PEM.finditer(text)] if "PRIVATE KEY" in text else []
    marks = sorted(pem + [(m.start(), m.end(), False) for m in PEM_END.finditer(text)]) if pem else []
    pending: tuple[str, int] | None = None  # the name of a YAML name/value pair
    inside_pem = -1

    def add(no: int, what: str, key: str, *spans: tuple[int, int]) -> None:
        if any(a < y and x < b for a, b in spans[:1] for x, y in taken):
            return  # found already
        taken.extend(spans)
        out.append(Finding(no, what, key, tuple(spans)))

    for line_no, line in enumerate(lines, 1):
        begin, at = at, at + len(line) + 1
        end = begin + len(line)
        where.enter(line)
        if begin < inside_pem:
            continue
        paired, pending = pending, None
        if shape in (None, "yaml") and (m := YAML_NAME.match(line)):
            pending = (m[2], line_no)
            continue
        low = line.lower()
        if not any(map(low.__contains__, INTERESTING)) and not _K.search(line):
            continue
        taken = list(by_line.get(line_no, ()))
        for m in PEM.finditer(line) if "PRIVATE KEY" in line else ():
            k = bisect.bisect_right(marks, (begin + m.start(), len(text) + 1, True))
            following = marks[k] if k < len(marks) else None
            closed = following is not None and not following[2]
            spans = _pem_spans(text, begin + m.end(), following[0] if closed else -(following[0] if following else len(text)))
            inside_pem = following[0] if closed else max([end, *(b for _, b in spans)])
            out.append(Finding(line_no, "private_key", where.of(line, ""), spans or ((begin + m.end(), begin + m.end()),)))
            taken.extend([(begin + m.start(), end)])
            if spans and all(MARK.strip("[]") in text[a:b] for a, b in spans):
                out.pop()  # redacted already
        for m in LOGIN_IN_URL.finditer(line) if "://" in line else ():
            if literal(m[1]):
                add(line_no, "url_login", "", (begin + m.start(1), begin + m.end(1)))
        for m in HEADER.finditer(line) if "basic" in low or "bearer" in low or "token" in low else ():
            value = m[2]
            if m[1].lower() == "basic" and _basic(value) or m[1].lower() != "basic" and literal(value) and (TOKEN.match(value) or random_like(value, 16)):
                add(line_no, "header", m[1].lower(), (begin + m.start(2), begin + m.end(2)))
        for m in TOKEN.finditer(line):
            if literal(m[0]) and len(set(m[0])) > 6:
                add(line_no, "token", "", (begin + m.start(), begin + m.end()))
        for sign, rx in COMMANDS:
            for m in rx.finditer(line) if sign in low else ():
                value = m[1].strip("\"'")
                shift = 1 if m[1][:1] in "\"'" and m[1][:1] else 0
                if literal(value):
                    add(line_no, "command", "", (begin + m.start(1) + shift, begin + m.start(1) + shift + len(value)))
        for m in OPTION.finditer(line) if "-" in line else ():
            value = m[2].strip("\"'")
            shift = 1 if m[2][0] in "\"'" else 0
            if accepts(sensitivity(m[1]), value, shift == 1, m[1]):
                add(line_no, "option", m[1], (begin + m.start(2) + shift, begin + m.start(2) + shift + len(value)))
        for rx, sign in ((XML_PAIR, "<"), (XML_TAG, "<"), (JSON_PAIR, "value")):
            for m in rx.finditer(line) if sign in low else ():
                if accepts(sensitivity(m[1]), m[2], True, m[1]):
                    add(line_no, "assignment", where.of(line, m[1]), (begin + m.start(2), begin + m.end(2)))
        if paired and (m := YAML_VALUE.match(line)):
            value = m[1].strip("\"'")
            shift = 1 if m[1][0] in "\"'" else 0
            if accepts(sensitivity(paired[0]), value, shift == 1):
                add(line_no, "assignment", where.of(line, paired[0]), (begin + m.start(1) + shift, begin + m.start(1) + shift + len(value)))
        m = None
        if shape is None and (m := BLOCK_KEY.match(line)) is None and line.rstrip(" \t\r\\(").endswith(("=", ":", "=>")):
            tail = line.rstrip(" \t\r\\(").rstrip("=:> \t")
            tail = tail[: -len("str")].rstrip(" :") if tail.endswith(": str") else tail
            at_key = _key_ahead(line, len(tail))
            m = OPEN_KEY.match(line, at_key) if at_key >= 0 else None
        if m and sensitivity(m[1]):
            block, first, spans, follow, f_at = m.re is BLOCK_KEY, 0, [], at, line_no
            depth = len(line) - len(line.lstrip())
            while f_at < len(lines):
                own = lines[f_at]
                if block and own.strip() and len(own) - len(own.lstrip()) <= depth or not block and not PIECE.match(own):
                    break
                if own.strip():
                    p = None if block else PIECE.match(own)
                    a, b = (len(own) - len(own.lstrip()), len(own.rstrip())) if block else p.span(2)
                    first = first or f_at + 1
                    spans.append((follow + a, follow + b))
                follow, f_at = follow + len(own) + 1, f_at + 1
                if not block and not re.search(r"[\"'`]\s*[+\\]?\s*$", own):
                    break
            value = "".join(text[a:b] for a, b in spans)
            if spans and accepts(sensitivity(m[1]), value, True, m[1]) and not TOKEN.search(value):
                add(first, "assignment", where.of(line, m[1]), *spans)
        position = 0
        for op in OPERATOR.finditer(line):
            if op.start() < position:
                continue
            at_key = _key_ahead(line, op.start())
            if at_key < 0 or not (m := ASSIGNMENT.match(line, at_key)):
                continue
            k = bisect.bisect_right(keys, (begin + at_key, len(text))) - 1
            if k >= 0 and begin + at_key < keys[k][1]:
                continue
            position = m.end()
            key = m["key"]
            level = sensitivity(key)
            if m["quote"] is None:
                start = begin + m.start("bare")
                stop = _bare_end(text, start, end)
                position = m.start("bare") if level == 0 else max(stop - begin, m.start("bare") + 1)
                if level and not quoted_only and accepts(level, text[start:stop], False, key) and not re.match(r"(?i)^\s*(?:if|while|for|elif|return|case)\b", line):
                    add(line_no, "assignment", where.of(line, key), (start, stop))
                continue
            start = begin + m.end()
            stop = _closing(text, start, m["quote"], len(text) if len(m["quote"]) == 3 else end)
            if stop < 0:
                continue
            position = max(position, min(stop, end) + len(m["quote"]) - begin)
            value = text[start:stop]
            spans = [(start, stop)]
            rest, no = line[stop + len(m["quote"]) - begin :].strip(), line_no
            follow, f_at = at, no
            if stop < end and (rest in ("", "+", "\\", ".") and (rest or line[: m.end()].rstrip().endswith(("(" + m["quote"], "(b" + m["quote"])) or "(" in line[m.start() : m.end()])):
                while f_at < len(lines) and (p := PIECE.match(lines[f_at])):  # further pieces
                    spans.append((follow + p.start(2), follow + p.end(2)))
                    value += p[2]
                    follow, f_at = follow + len(lines[f_at]) + 1, f_at + 1
                    if not re.search(r"[\"'`]\s*[+\\]?\s*$", lines[f_at - 1]):
                        break
            if accepts(level, value, True, key) or len(spans) > 1 and literal(value) and (TOKEN.match(value) or level and random_like(value)):
                ahead = value[: len(value) - len(value.lstrip())].count("\n") if len(m["quote"]) == 3 else 0
                add(line_no + ahead, "assignment", where.of(line, key), *spans)
        for m in PROSE.finditer(line):
            value = m[1].rstrip(".)")
            if literal(value) and (TOKEN.match(value) or random_like(value, 8) or re.search(r"\d", value) and re.search(r"[A-Za-z]", value) and len(value) >= 8) and not re.match(r"^[\w.\-]+\(", value):
                if not quoted_only or re.match(r"^\s*(?:#|//|--|\*|/\*|<!--)", line):
                    add(line_no, "prose", "", (begin + m.start(1), begin + m.start(1) + len(value)))
    closed = [(a, b) for f in out if f.kind == "private_key" for a, b in f.spans]
    return sorted(out + [f for f in parsed if not any(a <= x < b for x, _ in f.spans for a, b in closed)], key=lambda f: (f.line_no, f.spans[0]))


def redact(text: str, found: list[Finding]) -> str:
    """text with a mark in place of every value; the rest stays byte by byte."""
    parts, at = [], 0
    for a, b, mark in sorted({(*span, mark) for f in found for span, mark in zip(f.spans, f.marks or (MARK,) * len(f.spans))}):
        if a < at:
            a = at
        if b > a:
            parts += [text[at:a], mark]
            at = b
    return "".join([*parts, text[at:]])


def _files(files: DataFrame) -> DataFrame:
    return spread(files.where("file_id is not null and text <> ''").select(*_columns(files)))


def _columns(files: DataFrame) -> list:
    kind = files["kind"].cast("string") if "kind" in files.columns else F.lit(None).cast("string")
    return [files["file_id"].cast("bigint"), files["path"].cast("string"), kind.alias("kind"), files["text"].cast("string")]


def findings(files: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, key_path, byte_start, byte_end): each literal credential; bytes are of the UTF-8 text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for file_id, path, kind, text in zip(df["file_id"], df["path"], df["kind"], df["text"]):
                at = before = 0
                for f in sorted(scan(text, path or "", kind or ""), key=lambda f: f.spans[0]):
                    a, b = f.spans[0][0], f.spans[-1][1]
                    before += len(text[at:a].encode("utf-8"))
                    at = a
                    rows.append((file_id, f.line_no, f.kind, f.key, before, before + len(text[a:b].encode("utf-8"))))
            yield pd.DataFrame(rows, columns=["file_id", "line_no", "kind", "key_path", "byte_start", "byte_end"])

    return _files(files).mapInPandas(run, "file_id bigint, line_no int, kind string, key_path string, byte_start bigint, byte_end bigint")


def found(files: DataFrame) -> DataFrame:
    """(file_id, line_no), once for each line on which a literal credential begins. Rows of one file come from one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(file_id, n) for file_id, path, kind, text in zip(df["file_id"], df["path"], df["kind"], df["text"]) for n in sorted({f.line_no for f in scan(text, path or "", kind or "")})]
            yield pd.DataFrame(rows, columns=["file_id", "line_no"])

    return _files(files).mapInPandas(run, "file_id bigint, line_no int")


def redacted(files: DataFrame) -> DataFrame:
    """(file_id, text, n_redacted): every file; a null text stays null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            text, n = [], []
            for path, kind, t in zip(df["path"], df["kind"], df["text"]):
                f = scan(t, path or "", kind or "") if t else []
                text.append(redact(t, f) if f else t)
                n.append(len(f))
            yield pd.DataFrame({"file_id": df["file_id"], "text": pd.Series(text, index=df.index, dtype=object), "n_redacted": n})

    return spread(files.select(*_columns(files))).mapInPandas(run, "file_id bigint, text string, n_redacted int")
