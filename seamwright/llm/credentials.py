"""Credentials in source code, configuration and prose, and their redaction.

A text is searched in three ways.  *Layers*: base64, hex, percent and escape runs are decoded,
again and again as long as they get shorter, key containers among the bytes are parsed by
their binary grammar (DER, OpenSSH), and what comes out is searched the same way; a find
inside a layer counts for the literal that encloses it.  *Formats*: issuer prefixes, JSON web
tokens, logins in URLs and headers, private keys in armour, whose body is parsed as a
container.  *Contexts*: a name, call, header or remark that says "password", "token", ...
with a literal value that is no placeholder and no reference.  Where several ways find a
value, its kind names the first of them in this order.

A value that is written as several literals (side by side, with ``+``, with a backslash at the
line's end) is joined before it is judged, and masked in all its pieces.

``redact`` puts asterisks in place of the values (of the whole enclosing literal for a find
in a layer) and leaves names, quotes, line breaks and key armour as they are.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import suffix
from .texts import map_texts


class Find(NamedTuple):
    start: int  # of the value in the text
    end: int
    kind: str
    pieces: tuple[tuple[int, int], ...] = ()  # its parts, if it is written as several literals


# How issuers begin their tokens.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+])(?:gh[pousr]_[A-Za-z0-9]{14,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[A-Za-z0-9-]{10,}|xapp-[\w-]{20,}|npm_[A-Za-z0-9]{30,}"
    r"|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{12,}|sk-(?:proj-|ant-)?[\w-]{24,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[\w-]{35}|ya29\.[\w-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|pypi-[\w-]{30,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{60,}|shp(?:at|ss|ca|pa)_[a-fA-F0-9]{30,}|AGE-SECRET-KEY-1[A-Z0-9]{50,}|eyJ[\w-]{10,}\.eyJ[\w-]{6,}\.[\w-]{16,})"
)
ISSUED_HINTS = ("gh", "glpat", "xox", "xapp", "npm_", "sk_", "rk_", "sk-", "AKIA", "ASIA", "AIza", "ya29", "SG.", "pypi-", "hf_", "dop_", "shp", "AGE-", "eyJ")
ARMOUR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL_LOGIN = re.compile(r"(?i)\b[a-z][a-z0-9+.-]*://([^\s/:@'\"`<>]*):([^\s/@'\"`<>]+)@[\w.\[-]")
#: what a name must hold to name a credential; digests, labels of types and public halves are none
_SECRET = (
    r"(?:pass(?:word|wd|wort|phrase|code|wrd)?s?|pwd?s?|psw|secrets?|tokens?|api[_\- ]?keys?|access[_\- ]?keys?|priv(?:ate)?[_\- ]?keys?|secret[_\- ]?keys?|(?:encrypt(?:ion)?|signing|auth|master|account|"
    r"storage|shared|service|deploy|consumer|license|ssh|hmac|jwt|session|root|admin|client|app|application|webhook)[_\- ]?keys?|credentials?|creds?|auth|authorization|bearer|login|x-auth|signing)"
)
_NOT_NAME = re.compile(
    r"(?i)public|tokeni[sz]|(?:^|[^a-z])(?:max|num|n)_?tokens?|tokens?_?(?:count|limit|type|len|length|size|index|id|ids|per|budget|used|total)|passed|passing|passes|bypass|compass|passage|passenger|passive|author(?!iz)|authent\w*_?(?:type|method|mode)"
    r"|(?:password|token|secret|key)[_-]?(?:hash|field|label|type|name|file|path|url|uri|regex|pattern|policy|length|min|max|ttl|expiry|expires|input|column|header|prefix)$|secretar|login_?(?:url|path|page|form|count)|auth_?(?:url|type|method|mode|enabled|header|required)"
)
_QUOTED = re.compile(r"""(?:[rRbBuUfF]{0,2})("{3}|'{3}|["'`])((?:(?!\1)[^\\\n]|\\.)*?)\1""")
_ASSIGN = re.compile(
    r"""(?ix)(?<![\w$.\-/:@])(?P<name>["'`]?[\w$@/.\-][\w$.\-/:@]*["'`]?\]?)\s*(?::\s*[\w<>\[\]|., ]{1,40}?\s*)?(?P<op>=>|:=|\?\?=|\|\|=|=(?!=)|:(?!:|/)|,)\s*"""
)
_REFERENCE = re.compile(
    r"(?i)^(?:\$|%[a-z_]+%$|!(?:secret|vault|ref)|(?:vault|env|ssm|kms|sops|op|ref\+\w+|secretref|arn|keychain|gcp|azure|file|https?|data|sha\d+|md5)[:/]|os\.|process\.|env\.|config[.\[]|settings[.\[]|self\.|this\.|read_|get_?|load_|fetch_|none$|null$|true$|false$|undefined$)"
)
_PLACEHOLDER = re.compile(
    r"(?ix)^(?:[x*.\-_?#0]+|.*(?:change|replace|fill|insert|enter|paste|put|set)[-_ ]?(?:me|this|here|it|in)\b.*|.*your[-_ ].*|.*[-_ ]here|<.*>|\[.*\]|\(.*\)|.*\$\{.*|.*\{\{.*|\{.*\}|.*%\(.*|.*<[a-z_ -]+>.*"
    r"|(?:my|the|some|a|an|any|test|dummy|sample|example|fake|mock|default|user|db|new|old|bad|wrong|invalid|correct)?[-_ ]?(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|api[-_ ]?key|value|string|credentials?)s?[-_ ]?(?:here|value|goes|string|example|placeholder|\d{0,3})?"
    r"|changeit|placeholder|redacted|masked|hidden|removed|todo|tbd|fixme|none|null|nil|undefined|unset|empty|example|sample|dummy|foo(?:bar)?|bar|baz|qux|abc|asdf|bearer|basic|digest|required|optional|text|string|hidden|session|anonymous|guest|n/?a|…)$"
)


def placeholder(value: str) -> bool:
    """Whether a value stands for a credential without being one."""
    v = value.strip()
    return not v or len(set(v.lower())) < 4 or bool(_PLACEHOLDER.match(v)) or bool(_REFERENCE.match(v))


def plausible(value: str, sure: bool) -> bool:
    """Whether a literal can be a credential; ``sure``: its context names it as one."""
    v = value.strip()
    if len(v) < (6 if sure else 8) or re.search(r"\s", v) or placeholder(v):
        return False
    digit = any(c.isdigit() for c in v)
    letter = any(c.isalpha() for c in v)
    if any(ord(c) > 127 for c in v):
        return False
    special = re.search(r"[^A-Za-z0-9_\-./:+=,]", v) is not None
    turns = len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", v))
    if re.fullmatch(r"[a-z_]+\([^)]*\)|[\w.]+\[[^\]]*\]|[A-Za-z_][\w]*\.[A-Za-z_][\w.]*\(?.*\)?", v) and not digit:
        return False
    if re.fullmatch(r"/?[\w.~-]+(?:/[\w.~-]+)+/?", v) and not (sure and digit and turns >= 2):
        return False  # a path
    if not digit and not special:
        return turns >= 3 and len(v) >= 12
    if not letter:
        return sure and len(v) >= 8
    if sure:
        return digit or special
    mixed = len(re.findall(r"(?=[A-Za-z]\d|\d[A-Za-z])", v)) >= 4 and len(v) >= 10 and v.lower() != v != v.upper()
    return digit and (special or mixed or turns >= 2 or len(v) >= 16) or (special and turns >= 1 and len(v) >= 10)


# ---------------------------------------------------------------------------- key containers
def _der(data: bytes, at: int, end: int):
    """(tag, start, end) of the element at ``at``; None if it does not fit."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        at += k
    return (tag, at, at + n) if at + n <= end else None


# Object identifiers of password-based encryption, under which keys and no digests lie, and of PKCS 7 data.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_PKCS7 = bytes.fromhex("2a864886f70d0107")


def _openssh(data: bytes) -> bool:
    """Whether the bytes are an openssh-key-v1 container, every length fitting."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, kdf, options = field(), field(), field()
    if cipher is None or kdf is None or options is None or at + 4 > len(data) or (cipher == b"none") != (kdf == b"none"):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= len(data) // 4 or any(not field() for _ in range(keys)):
        return False
    body = field()
    if not body or len(body) % 8:
        return False
    return cipher != b"none" or body[:4] == body[4:8]


def container(data: bytes) -> str | None:
    """``private``, ``public`` or ``certificate`` if the bytes are a key container, by its grammar.

    PrivateKeyInfo and EncryptedPrivateKeyInfo (PKCS 8), RSAPrivateKey (PKCS 1), ECPrivateKey
    (SEC 1), DSA keys, PFX (PKCS 12), SubjectPublicKeyInfo, X.509 certificates, openssh-key-v1.
    """
    if _openssh(data):
        return "private"
    top = _der(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return None
    parts, at = [], top[1]
    while at < top[2] and len(parts) < 12:
        e = _der(data, at, top[2])
        if not e:
            return None
        parts.append(e)
        at = e[2]
    tags = [p[0] for p in parts]
    first = int.from_bytes(data[parts[0][1] : parts[0][2]], "big") if tags and tags[0] == 2 and parts[0][2] - parts[0][1] <= 2 else None

    def oid(p) -> bytes | None:
        """The object identifier an algorithm begins with."""
        e = _der(data, p[1], p[2])
        return data[e[1] : e[2]] if e is not None and e[0] == 6 else None

    if tags[:3] == [2, 0x30, 4] and first in (0, 1) and oid(parts[1]):
        return "private"  # PKCS 8
    if tags[:9] == [2] * 9 and first in (0, 1) or (tags == [2] * 6 and first == 0):
        return "private"  # PKCS 1, DSA
    if tags[:2] == [2, 4] and first == 1 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "private"  # SEC 1
    if tags == [0x30, 4] and (oid(parts[0]) or b"").startswith(_PBE):
        return "private"  # PKCS 8, encrypted
    if tags[:2] == [2, 0x30] and len(tags) <= 3 and first == 3 and (oid(parts[1]) or b"").startswith(_PKCS7):
        return "private"  # PKCS 12
    if tags == [0x30, 3] and oid(parts[0]) or tags == [2, 2]:
        return "public"
    if tags == [0x30, 0x30, 3]:
        return "certificate"
    return None


# ---------------------------------------------------------------------------- layers
_RUN64 = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
_RUN_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0x)?(?:[0-9a-fA-F]{2}){12,}(?![0-9A-Za-z])")
_RUN_PERCENT = re.compile(r"(?<![\w.~-])(?:[\w.~-]*%[0-9a-fA-F]{2}){4,}[\w.~%-]*")
_ESCAPE = re.compile(r"\\x([0-9a-fA-F]{2})|\\u00([0-9a-fA-F]{2})|\\([0-3][0-7]{2})")
_RUN_ESCAPE = re.compile(r"(?<![^\\\s\"'`])(?:[^\\\s\"'`]*(?:\\x[0-9a-fA-F]{2}|\\u00[0-9a-fA-F]{2}|\\[0-3][0-7]{2})){6,}[^\\\s\"'`]*")


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\r\n\t" for c in text) else None


def decoded(run: str, kind: str) -> bytes | None:
    """Bytes of an encoded run; None if it is not sound."""
    try:
        if kind == "base64":
            body = run.rstrip("=").replace("-", "+").replace("_", "/")
            return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        if kind == "hex":
            return bytes.fromhex(run.removeprefix("0x"))
        if kind == "percent":
            return unquote_to_bytes(re.sub(r"%(?:25)+(?=[0-9a-fA-F]{2})", "%", run))  # percent signs encoded again and again come off at once
        out, at = [], 0
        for m in _ESCAPE.finditer(run):
            out.append(run[at : m.start()].encode())
            out.append(bytes([int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8) & 255]))
            at = m.end()
        return b"".join(out) + run[at:].encode()
    except (ValueError, binascii.Error):
        return None


def _layers(text: str):
    """(start, end, kind, bytes) of the encoded runs of a text."""
    if max(map(len, re.split(r"[\s\"'`]", text)), default=0) >= 24:
        for m in _RUN64.finditer(text):
            run = m[0]
            if run.isalpha() and (run.islower() or run.isupper()) or "_" in run and run.replace("_", "").isalpha():
                continue
            data = decoded(run, "hex") if _RUN_HEX.fullmatch(run) else None
            if data is not None:
                yield m.start(), m.end(), "hex", data
            data = decoded(run, "base64")
            if data:
                yield m.start(), m.end(), "base64", data
    if "%" in text:
        for m in _RUN_PERCENT.finditer(text):
            yield m.start(), m.end(), "percent", decoded(m[0], "percent")
    if "\\" in text:
        for m in _RUN_ESCAPE.finditer(text):
            yield m.start(), m.end(), "escape", decoded(m[0], "escape")


def layer_holds(data: bytes) -> str | None:
    """Kind of the credential inside decoded bytes, looked for through all further layers."""
    todo, seen = [data], {data}
    while todo:
        data = todo.pop()
        if container(data) == "private":
            return "private key"
        text = _printable(data)
        if text is None or len(text) < 8:
            continue
        if ARMOUR.search(text):
            return "private key"
        m = ISSUED.search(text)
        if m and len(set(m[0])) > 8:
            return "token"
        m = URL_LOGIN.search(text)
        if m and not placeholder(m[2]):
            return "login"
        if re.search(r"(?i)" + _SECRET + r"\W{1,3}\S{8,}", text) and _plain_finds(text, ""):
            return "password"
        for _, _, _, inner in _layers(text):
            if inner and len(inner) < len(data) and inner not in seen:
                seen.add(inner)
                todo.append(inner)
    return None


# ---------------------------------------------------------------------------- literals in pieces
_SPACE = r"(?:\s|#[^\n]*\n|//[^\n]*\n|/\*(?:(?!\*/).)*\*/)*"
_PLUS = re.compile(rf"{_SPACE}\+{_SPACE}|[ \t]*\\\r?\n\s*")
_BESIDE = re.compile(r"(?:\s|#[^\n]*\n)*")
_PLUS_HINT = re.compile(r"[\"'`]\s*(?:\+|\\\r?\n|#|//|/\*)|\+\s*[rRbBuUfF]{0,2}[\"'`]")
_BESIDE_HINT = re.compile(r"[\"'](?:\s|#[^\n]*\n)+[rRbBuUfF]{0,2}[\"']|[^\s\"'](?:\"\"|''|\"'|'\")[^\s\"',;:)\]}]")
_OPEN = re.compile(r"[(\[{](?:\s|#[^\n]*\n)*$")
_CLOSE = re.compile(r"(?:\s|#[^\n]*\n)*[)\]},:.%]")
#: code in prose may be Python
_PROSE = frozenset(["", "md", "markdown", "rst", "txt"])


def _chains(text: str, suffix: str) -> list[list[re.Match]]:
    """Literals that are one value: joined by ``+``, by a backslash at the line's end or, in Python, by standing side by side.

    Side by side over a line's end they are one value only within brackets, else the second
    is a statement of its own.
    """
    python, prose = suffix in ("py", "pyi"), suffix in _PROSE
    if not (_PLUS_HINT.search(text) or (python or prose) and _BESIDE_HINT.search(text)):
        return []
    chains: list[list[re.Match]] = []
    run: list[re.Match] = []
    loose = False  # whether the run has to be within brackets

    def close() -> None:
        if len(run) > 1:
            opened = _OPEN.search(text, max(0, run[0].start() - 200), run[0].start()) is not None
            closed = _CLOSE.match(text, run[-1].end()) is not None
            if not loose or (opened or closed if python else opened and closed):
                chains.append(list(run))

    for m in _QUOTED.finditer(text):
        if run:
            a, b = run[-1].end(), m.start()
            if _PLUS.fullmatch(text, a, b):
                run.append(m)
                continue
            if (python or prose) and m[1] != "`" != run[-1][1] and m[2] and run[-1][2] and _BESIDE.fullmatch(text, a, b):
                loose = loose or prose or "\n" in text[a:b]
                run.append(m)
                continue
        close()
        run, loose = [m], False
    close()
    return chains


def _joined(text: str, suffix: str) -> tuple[str, list[int], list[int]]:
    """The text with each chain of literals as one literal, and where its stretches begin: there and in the text."""
    out, there, here, at, n = [], [0], [0], 0, 0

    def keep(stretch: str) -> None:
        nonlocal n
        out.append(stretch)
        n += len(stretch)

    for chain in _chains(text, suffix):
        first = chain[0]
        keep(text[at : first.end(2)])
        for m in chain[1:]:
            there.append(n)
            here.append(m.start(2))
            keep(m[2].replace(first[1][0], "!"))  # a quote of the other kind must not end the literal
        there.append(n)
        here.append(chain[-1].end(2) + len(chain[-1][1]) - len(first[1]))
        keep(first[1])
        at = chain[-1].end()
    keep(text[at:])
    return "".join(out), there, here


def _placed(f: Find, there: list[int], here: list[int]) -> Find:
    """A find in the joined text as one in the text."""
    k = bisect_right(there, f.start) - 1
    pieces, at = [], f.start
    while at < f.end:
        stop = min(f.end, there[k + 1] if k + 1 < len(there) else f.end)
        if stop > at:
            pieces.append((here[k] + at - there[k], here[k] + stop - there[k]))
        at, k = stop, k + 1
    return Find(pieces[0][0], pieces[-1][1], f.kind, tuple(pieces) if len(pieces) > 1 else ())


# ---------------------------------------------------------------------------- contexts
_LINE_HINTS = (
    "pass", "pwd", "psw", "secret", "token", "apikey", "api_key", "api-key", "api key", "_key", "-key", "accesskey", "privatekey", "signing", "credential", "creds",
    "auth", "login", "pw:", "pw ", "pw=", "verify(", "-u ", "--user", "bearer", "connect(", "口令", "密码", "密钥", "令牌",
)
_REMARK = re.compile(
    r"(?i)(?:\b(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|api[ _-]?key|access[ _-]?key|login|credentials?|key)|口令|密码|密钥|令牌)\s*(?:\([^)]{0,30}\)\s*)?(?:is|was|are|were|now|[:=：为是])+\s*(?:now |still |set to |[:=：]\s*)?[\"'`]?([^\s\"'`,;，。；]{8,})"
)
_COMMENT_AT = re.compile(r"(?:^|\s)(?:#|//|/\*|\*|--|;|<!--|>)\s|(?:^\s*)(?:[A-Z一-鿿].{15,})")
_SHELL = re.compile(r"(?:^|\s)(?:-u|--user|--basic)[ =]['\"]?([\w.@-]+):([^\s'\"]+)|--?(?:password|passwd|pass|token|secret|api-key|apikey|auth-token|access-key|secret-key)[ =]+(?:'([^']+)'|\"([^\"]+)\"|([^\s'\"]+))")
_SCHEME = re.compile(r"(?i)^(bearer|basic|token|apikey|api-key|digest|negotiate|key|jwt|oauth)\s+(?=\S)")
_CALL = re.compile(r"(?i)(?<![\w.])(?:[\w$]+\.)*(?:log_?in|sign_?in|authenticate|auth|verify|check_?password|set_?password|basic_?auth|unlock|open_?session|connect|attach|credentials?)\s*\(")
_HEADER_TEXT = re.compile(r"(?i)\b(?:proxy-)?authorization\s*[:=]\s*(?:(?:bearer|basic|token|apikey|digest)\s+)?([^\s\"'`,;<>{}$]{8,})|\bx-(?:auth|api)[\w-]*\s*[:=]\s*(?:(?:bearer|token)\s+)?([^\s\"'`,;<>{}$]{8,})")

CODE_SUFFIXES = frozenset("py js jsx ts tsx json toml css html".split())


def _is_name(name: str) -> bool:
    bare = name.strip("\"'`] ")
    if len(bare) > 80:
        bare = re.split(r"[./:@]", bare)[-1]  # of a long path what it ends with
    if not bare:
        return False
    if _NOT_NAME.search(bare):
        return False
    return _TAIL.search(bare) is not None


#: a credential word as a part of its own in a name: snake, kebab or camel case
_TAIL = re.compile(
    rf"(?:^|[^A-Za-z]|(?<=[a-z])(?=[A-Z]))(?:(?i:{_SECRET}))(?:$|[^A-Za-z]|(?<=[a-z])(?=[A-Z]))|(?i:(?:^|[^a-z])(?:_authtoken|dbpass|mypass|userpass|rootpass|sshpass|pgpass|auth_?token|oauth_?token|client_?secret|api_?secret|app_?secret|apikey|secretkey|accesskey|privatekey|privatetoken))"
)


def _literals(line: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of the values of the quoted literals of a line."""
    return [(m.start(2), m.end(2), m[2]) for m in _QUOTED.finditer(line)]


def unwrapped(value: str) -> tuple[str, list[str]]:
    """A literal's value without the layers it lies in as a whole, and their kinds from the outside in."""
    kinds: list[str] = []
    while len(value) >= 12:
        for kind, form in (("hex", r"(?:0x)?(?:[0-9a-fA-F]{2})+"), ("base64", r"[A-Za-z0-9+/_-]+={0,2}"), ("percent", r"(?:[^%\s]*%[0-9a-fA-F]{2})+[^%\s]*"), ("escape", r"(?:[^\\\s]*\\(?:x[0-9a-fA-F]{2}|u00[0-9a-fA-F]{2}|[0-3][0-7]{2}))+[^\\\s]*")):
            data = decoded(value, kind) if re.fullmatch(form, value) else None
            text = _printable(data) if data else None
            if text and len(text) >= 4 and len(text) < len(value):
                kinds.append(kind)
                value = text
                break
        else:
            break
    return value, kinds


def _by_layer(text: str, f: Find) -> Find | None:
    """A find of a context judged by what its value decodes to: None if that is a placeholder."""
    if f.kind != "secret":
        return f
    core = text[f.start : f.end]
    s = _SCHEME.match(core)
    inner, kinds = unwrapped(core[s.end() :] if s else core)
    if not kinds:
        return f
    user, colon, password = inner.partition(":")
    if placeholder(password if colon and re.fullmatch(r"[\w.@-]+", user) else inner):
        return None
    return f._replace(kind=f"{'login' if colon else 'secret'} in {' in '.join(reversed(kinds))}")


def scan(text: str, suffix: str) -> list[Find]:
    """The credentials of a text, in order, without overlaps.

    A value written as several literals is judged as one.
    """
    whole, there, here = _joined(text, suffix)
    finds = [g for f in _plain_finds(whole, suffix) if (g := _by_layer(whole, f))]
    for start, end, kind, data in _layers(whole):
        held = layer_holds(data) if data else None
        if held:
            finds.append(Find(start, end, f"{held} in {kind}"))
    finds = _apart(finds)
    return finds if len(there) == 1 else [_placed(f, there, here) for f in finds]


def _apart(finds: list[Find]) -> list[Find]:
    """Finds in order without overlaps: what overlaps is one, of the kind of a layer if there is one."""
    out: list[Find] = []
    for f in sorted(finds, key=lambda f: (f.start, -f.end)):
        if out and f.start < out[-1].end:
            last = out[-1]
            kind = f.kind if " in " in f.kind and " in " not in last.kind else last.kind
            if f.end <= last.end or " in " in f.kind:  # a find over the edge of another is none of its own
                out[-1] = Find(last.start, max(last.end, f.end), kind)
            continue
        out.append(f)
    return out


#: a line of the body of a key in armour, also as a literal: base64, or a header
_BODY_LINE = re.compile(r"[\s\"'`,+;|#*/>]*(?:(?:[A-Za-z0-9+/=]|\\[nr])*|[A-Z][\w-]+: [^\n]*)[\s\"'`,+;()\]}\\]*")


def _armour_end(text: str, at: int) -> int:
    """Where the body of an armour that is not closed ends: before the first line that cannot belong to it."""
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        if not _BODY_LINE.fullmatch(text, at, stop):
            return at
        at = stop + 1
    return len(text)


def _plain_finds(text: str, suffix: str) -> list[Find]:
    """The credentials that formats and contexts show."""
    finds: list[Find] = []
    low = text.lower() if text.isascii() or len(text.lower()) == len(text) else text
    code = suffix in CODE_SUFFIXES

    def add(start: int, end: int, kind: str) -> None:
        if end > start:
            finds.append(Find(start, end, kind))

    # formats
    if "-----BEGIN" in text:
        for m in ARMOUR.finditer(text):
            stop = text.find("-----END", m.end())
            if stop < 0:
                stop = _armour_end(text, m.end())
            body = re.sub(r"[^A-Za-z0-9+/=]", "", re.sub(r"\\[nr]|[A-Z][\w-]+: [^\n]*", "", text[m.end() : stop]))
            if len(body) >= 40:
                data = decoded(body, "base64")
                add(m.start(), stop, "private key container" if data and container(data) == "private" else "private key")
    if any(h in text for h in ISSUED_HINTS):
        for m in ISSUED.finditer(text):
            if len(set(m[0])) > 8 and not re.search(r"(?i)x{6,}|example|your", m[0]):
                add(m.start(), m.end(), "token")
    if "://" in text and "@" in text:
        for m in URL_LOGIN.finditer(text):
            if not placeholder(m[2]) and not re.match(r"[{$<%]", m[2]):
                add(m.start(2), m.end(2), "login")

    # contexts, line by line where a word of the trade occurs
    at_lines: set[int] = set()
    for hint in _LINE_HINTS:
        at = low.find(hint)
        while at >= 0:
            begin = text.rfind("\n", 0, at) + 1
            at_lines.add(begin)
            stop = text.find("\n", at)
            if stop < 0:
                break
            at = low.find(hint, stop)
    for begin in sorted(at_lines):
        stop = text.find("\n", begin)
        stop = len(text) if stop < 0 else stop
        _scan_line(text, begin, text[begin:stop], code, add)
    return finds


def _scan_line(text: str, begin: int, line: str, code: bool, add) -> None:
    bare = line.rstrip("\r")
    for m in _ASSIGN.finditer(bare):
        name = m["name"]
        if not _is_name(name):
            continue
        op, rest_at = m["op"], m.end()
        rest = bare[rest_at:]
        if op == "," and name[:1] not in "\"'`":
            continue
        if op == ":" and name[:1] not in "\"'`" and re.match(r"\s*(?:str|string|any|bytes|Optional|number|boolean)\b", rest):
            continue
        q = _QUOTED.match(rest)
        if q:
            value = q[2]
            s = _SCHEME.match(value)
            core = value[s.end() :] if s else value
            shift = s.end() if s else 0
            if plausible(core, True):
                add(begin + rest_at + q.start(2) + shift, begin + rest_at + q.end(2), "secret")
                continue
            h = _HEADER_TEXT.search(value)
            if h and plausible(h[1] or h[2], True):
                g = 1 if h[1] else 2
                add(begin + rest_at + q.start(2) + h.start(g), begin + rest_at + q.start(2) + h.end(g), "secret")
            continue
        if re.match(r"[(\[]\s*(?:$|[\"'`])", rest):  # a pair, or a value on the lines below
            literals = _literals(rest)
            if len(literals) >= 2 and re.search(r"(?i)cred|login|auth|account", name):
                a, b, v = literals[-1]
                if plausible(v, True):
                    add(begin + rest_at + a, begin + rest_at + b, "secret")
            elif len(literals) == 1 and plausible(literals[0][2], True):
                a, b, _ = literals[0]
                add(begin + rest_at + a, begin + rest_at + b, "secret")
            elif not literals:
                m2 = re.compile(r"[(\[]\s*\n\s*([\"'`])([^\"'`\n]+)\1").match(text, begin + rest_at)
                if m2 and plausible(m2[2], True):
                    add(m2.start(2), m2.end(2), "secret")
            continue
        d = re.match(r"(?:os\.(?:environ\.get|getenv)|(?:\w+\.)*(?:getenv|get_env|get|env|config))\(\s*([\"'`])[^\"'`]*\1\s*,\s*(?:default\s*=\s*)?([\"'`])([^\"'`]+)\2", rest)
        e = re.match(r"[\w.\[\]\"'?]+\s*(?:\|\||\?\?|\bor\b|:)\s*([\"'`])([^\"'`]+)\1", rest)
        if d and plausible(d[3], True):
            add(begin + rest_at + d.start(3), begin + rest_at + d.end(3), "secret")
        elif e and plausible(e[2], True):
            add(begin + rest_at + e.start(2), begin + rest_at + e.end(2), "secret")
        elif not code and op in ("=", ":"):
            u = re.match(r"[^\s#][^\s;,'\"`]+", rest)
            if u and plausible(u[0], True) and not rest.startswith(("[", "{", "(")):
                tail = rest[u.end() :].strip()
                if not tail or tail[0] in "#;,":
                    add(begin + rest_at, begin + rest_at + u.end(), "secret")
    # defaults of variables that name a credential
    for m in re.finditer(
        r"(?:environ\.get|getenv|get_env)\(\s*([\"'])([\w.\-]+)\1\s*,\s*(?:default\s*=\s*)?([\"'])([^\"']+)\3|(?:process\.env|import\.meta\.env|Deno\.env)(?:\.|\[[\"'])(\w+)(?:[\"']\])?\s*(?:\|\||\?\?)\s*([\"'`])([^\"'`]+)\6",
        bare,
    ):
        name, g = (m[2], 4) if m[2] else (m[5], 7)
        if _is_name(name) and plausible(m[g], True):
            add(begin + m.start(g), begin + m.end(g), "secret")
    # calls that take a credential
    for m in _CALL.finditer(bare):
        depth, k = 1, m.end()
        while k < len(bare) and depth:
            depth += {"(": 1, ")": -1}.get(bare[k], 0)
            k += 1
        inside = bare[m.end() : k]
        literals = _literals(inside)
        keyed = [x for x in literals if re.search(r"\w\s*[=:]\s*$", inside[: x[0] - 1])]
        plain = [x for x in literals if x not in keyed]
        if plain:
            a, b, v = plain[-1]
            if plausible(v, re.search(r"(?i)pw|pass|secret|token", inside[:a]) is not None):
                add(begin + m.end() + a, begin + m.end() + b, "secret")
    for m in _SHELL.finditer(bare):
        g = next(k for k in (2, 3, 4, 5) if m[k])
        if plausible(m[g], True) or (g == 2 and not placeholder(m[2]) and len(m[2]) >= 6):
            add(begin + m.start(g), begin + m.end(g), "secret")
    for m in _HEADER_TEXT.finditer(bare):
        g = 1 if m[1] else 2
        if plausible(m[g], True):
            add(begin + m.start(g), begin + m.end(g), "secret")
    if not code or _COMMENT_AT.search(bare):
        c = re.search(r"#|//|/\*|<!--|--|^\s*\*", bare) if code else None
        start = c.start() if c else 0
        if not code or c:
            for m in _REMARK.finditer(bare, start):
                if plausible(m[1].rstrip(".)"), False):
                    add(begin + m.start(1), begin + m.start(1) + len(m[1].rstrip(".)")), "secret")


def redact(text: str, finds: list[Find]) -> str:
    """The text with asterisks for the values; line breaks and key armour stay."""
    out, at = [], 0
    for f in finds:
        for k, (start, end) in enumerate(f.pieces or [(f.start, f.end)]):
            value = text[start:end]
            head = ""
            if k == 0 and value.startswith("-----BEGIN"):
                stop = value.find("-----", 11)
                head = value if stop < 0 else value[: stop + 5]
            out.append(text[at:start] + head + re.sub(r"[^\r\n]", "*", value[len(head) :]))
            at = end
    out.append(text[at:])
    return "".join(out)


def line_rows(text: str, suffix: str) -> list[tuple]:
    """(line_no, kind, start, end) of the credentials, one row per line."""
    rows, seen = [], set()
    for f in scan(text, suffix):
        line = text.count("\n", 0, f.start) + 1
        if line not in seen:
            seen.add(line)
            rows.append((line, f.kind, f.start, f.end))
    return rows


def redacted_rows(text: str, suffix: str) -> list[tuple]:
    finds = scan(text, suffix)
    return [(len(finds), redact(text, finds))]


def credential_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, start_char, end_char): the lines on which a credential begins.

    Reads ``id, path, content``; null contents give no rows, a null path is taken as prose.
    """
    texts = files.select("id", "content", F.coalesce(suffix(F.col("path")), F.lit("")).alias("suffix"))
    return map_texts(
        texts, ["id"], "content", "suffix", line_rows, "file_id long, line_no long, kind string, start_char long, end_char long", "credentials"
    )


def redacted_files(files: DataFrame) -> DataFrame:
    """(file_id, n_redacted, content): every text with its credentials masked."""
    texts = files.select("id", "content", F.coalesce(suffix(F.col("path")), F.lit("")).alias("suffix"))
    return map_texts(texts, ["id"], "content", "suffix", redacted_rows, "file_id long, n_redacted int, content string", "redacted")
