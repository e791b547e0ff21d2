"""Credentials embedded in source code and configuration (problem 7).

Method: a *keyword automaton* passes over each text and names the detectors worth running; *issuer-format
regular expressions* and a name-and-value rule find values; *structure checks* (decoded JWT headers,
decoded basic authorisation, alphabets and lengths, placeholder and reference shapes) drop what cannot be a
live secret; values are replaced by placeholders of the same length and alphabet, so quoting, escapes, column
positions and the code around stay as they were. Published checksums (the CRC-32 in base 62 at the end of two issuers'
tokens) are computed and told in ``proof``; a token of the right structure whose checksum fails is still reported, for
it may be an older format, only with the weaker proof. A placeholder is never found again.

String literals continued on the next line are joined before matching, so split secrets are found; places
are reported in the original text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Public formats of issuers' keys.
ISSUERS = {
    "cloud_access_id": r"(?<![A-Za-z0-9])((?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16})(?![A-Za-z0-9])",
    "repository_token": r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "repository_pat": r"(?<![A-Za-z0-9])(github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,})",
    "payment_key": r"(?<![A-Za-z0-9])([sr]k_(?:live|prod)_[A-Za-z0-9]{16,})(?![A-Za-z0-9])",
    "chat_token": r"(?<![A-Za-z0-9])(xox[abeoprs]-[A-Za-z0-9-]{10,})",
    "model_key": r"(?<![A-Za-z0-9_-])(pa-[A-Za-z0-9_-]{40,})",
    "other_issuer": r"(?<![A-Za-z0-9_-])(AIza[A-Za-z0-9_-]{35}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z]{30,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9_-])",
    "signed_token": r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})",
    "private_key": r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)",
    "connection_string": r"(?<![A-Za-z0-9+.-])([A-Za-z][A-Za-z0-9+.-]{0,40}://[^\s:/@\"'`<>]*:([^\s@\"'`/]+)@)",
    "account_key": r"(?i:AccountKey|SharedAccessKey|SharedSecret)=([A-Za-z0-9+/]{20,}={0,2})",
    "basic_auth": r"\b[Bb]asic\s+([A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])",
    "user_option": r"(?:^|\s)(?:-u|--user)[ =]*[\"']?[^\s:\"'$<{]+:([^\s\"']{4,})",
    "bearer_auth": r"\b[Bb]earer\s+([A-Za-z0-9._~+/-]{16,}=*)",
}
# Keyword (lower case) to the detectors it calls for.
KEYWORDS = {
    "akia": "cloud_access_id", "asia": "cloud_access_id", "abia": "cloud_access_id", "acca": "cloud_access_id",
    "ghp_": "repository_token", "gho_": "repository_token", "ghu_": "repository_token",
    "ghs_": "repository_token", "ghr_": "repository_token",
    "github_pat_": "repository_pat", "glpat-": "repository_pat",
    "k_live_": "payment_key", "k_prod_": "payment_key", "xox": "chat_token",
    '"pa-': "model_key", "'pa-": "model_key", "=pa-": "model_key", " pa-": "model_key", ":pa-": "model_key", "`pa-": "model_key",
    "aiza": "other_issuer", "sg.": "other_issuer", "npm_": "other_issuer", "hf_": "other_issuer", "sk-": "other_issuer",
    "eyj": "signed_token", "private key": "private_key", "://": "connection_string",
    "accountkey=": "account_key", "sharedaccesskey=": "account_key", "sharedsecret=": "account_key",
    " -u ": "user_option", "--user ": "user_option", "--user=": "user_option",
    "basic ": "basic_auth", "bearer ": "bearer_auth",
    "passw": "named", "passphrase": "named", "pwd": "named", "_pass": "named", "smtppass": "named", "dbpass": "named",
    "pass_": "named", "-pass": "named", 'pass"': "named", "pass'": "named", "pass=": "named", "pass:": "named", "pass =": "named", "senha": "named", "contrase": "named", "clave": "named", "motdepasse": "named", "mot_de_passe": "named",
    "kennwort": "named", "geheim": "named", "secret": "named", "api_key": "named", "apikey": "named", "api-key": "named",
    "token": "named", "accesskey": "named", "access_key": "named", "access-key": "named", "auth_key": "named",
    "signing_key": "named", "credential": "named",
}
_SECRET_NAME = re.compile(
    r"((?:passw(?:or)?[dt]|passphrase|(?<![A-Za-z])pass(?![A-Za-z])|(?-i:(?<=[a-z])Pass(?![a-z]))|pwd|senha|contrase(?:n|ñ)a|clave"
    r"|mot_?de_?passe|kennwort|geheimnis|secret|api[_-]?key|access[_-]?key|auth[_-]?key|signing[_-]?key|token|credentials?)"
    r"([A-Za-z0-9_\-]{0,80}))[\"'\]]*[ \t]*(?::[ \t]*&?(?:'static )?(?:str|String|string)[ \t]*=|=>|:=|:|=|,)[ \t]*\(?[ \t]*"
    r"(?:\"([^\"\n]*)\"|'([^'\n]*)'|`([^`\n]*)`|([^\s\"'`,;)]+))",
    re.IGNORECASE,
)
_BEFORE = re.compile(r"[A-Za-z0-9_.\-]*\Z")
_NO_SECRET_SUFFIX = re.compile(
    r"(?:^|[_-]|(?<=[a-z])(?=[A-Z]))(?:label|name|url|uri|hint|policy|path|file|field|prompt|len|length|ttl|type|header|param|"
    r"count|limit|placeholder|id|ref|expiry|expires|endpoint|env|var|manager|store|provider|hash|digest)(?![a-z])",
    re.IGNORECASE,
)
_PLACEHOLDER = re.compile(
    r"^(?:<.*>?|\$.*|%.*%?|\{\{.*|\{.*|\[.*|#\{.*|x{3,}|\*+|\.{2,}|-+|_+|0+|(?:your|my|the|some|insert|enter|put|replace|change|example|sample|dummy|fake|test|placeholder|redacted|todo|tbd|fixme|none|null|nil|true|false|undefined|default|empty|secret|password|passwd|passwort|pass|user|admin|token|key|hunter2|foo|bar|string|here)(?:[_\-. ].*|\d*)?|(?:change|replace|insert|enter|put)me.*)$"
    r"|(?i:your[_-]|change[_-]?me|placeholder|_here$|redacted|xxxx|<[a-z_ -]+>|not[_-]?a[_-]?(?:real|secret))",
    re.IGNORECASE,
)
_REFERENCE = re.compile(
    r"^(?:vault|env|ssm|secretsmanager|secret|secrets|file|ref\+?\w*|arn|op|keyring|kms|gcp|aws|azure|sops|config|https?|s3|gs|var|local|data)[:/.]|"
    r"^(?:os\.|process\.|System\.|std::|ENV|getenv|self\.|this\.|config\.|settings\.|args\.|env\.)",
    re.IGNORECASE,
)
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_SPLICE = re.compile(r"([\"'])[ \t]*(?:\+|\.\.|\.|\\|<<)?[ \t]*\r?\n[ \t]*(?:\+|\.\.|\.)?[ \t]*\1")
_PREFIX = re.compile(r"(?:AKIA|ASIA|ABIA|ACCA|gh[pousr]_|github_pat_|glpat-|[sr]k_(?:live|prod)_|xox[a-z]-|pa-|AIza|SG\.|npm_|hf_|sk-)")
_MASKED = re.compile(r"[^A-Za-z0-9]*(?:(?:[xX0]+[^A-Za-z0-9]*)+|(?:[aA0]+[^A-Za-z0-9]*)+)")
#: What follows the frame of a key whose end is missing, and the lines that precede an end without its beginning.
_KEY_BODY = re.compile(r"(?:(?:[\s\"'`+,]|\\[rnt\\])*(?:[A-Za-z0-9+/=]{24,}|[A-Za-z0-9+/=]+\Z|(?:Proc-Type|DEK-Info):[^\n\\\"']*))*")
_KEY_LINE_END = re.compile(r"\r?\n|\\r\\n|\\n")
_KEY_TAIL = re.compile(r"[\"'`]([A-Za-z0-9+/=]{24,})[ \t\"'`+,]*$")
_KEY_LINE = re.compile(r"[ \t\"'`+,]*([A-Za-z0-9+/=]+)[ \t\"'`+,]*")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)|[^\\]+|\\", re.DOTALL)
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

_COMPILED = {k: re.compile(v) for k, v in ISSUERS.items()}
_automaton = None


def automaton():
    """The keyword automaton, one per Python worker; values are detectors' names."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for word, detector in KEYWORDS.items():
            made.add_word(word, detector)
        made.make_automaton()
        _automaton = made
    return _automaton


def _decoded(value: str) -> bytes | None:
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_" if "-" in value or "_" in value else None, validate=False)
    except (binascii.Error, ValueError):
        return None


def _basic_ok(value: str) -> bool:
    raw = _decoded(value)
    if not raw or b":" not in raw or not all(32 <= c < 127 for c in raw):
        return False
    password = raw.split(b":", 1)[1].decode()
    return len(password) > 2 and not _PLACEHOLDER.match(password)


def _jwt_ok(value: str) -> bool:
    raw = _decoded(value.split(".", 1)[0])
    try:
        return raw is not None and "alg" in json.loads(raw)
    except ValueError:
        return False


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_ok(value: str) -> bool:
    """Do the last six characters of ``prefix_payload`` hold the CRC-32 of the payload in base 62?"""
    payload, want = value.split("_", 1)[-1][:-6], value[-6:]
    n, digits = zlib.crc32(payload.encode()), ""
    while n:
        n, r = divmod(n, 62)
        digits = _BASE62[r] + digits
    return digits.rjust(6, "0") == want


def proof(value: str, kind: str) -> str:
    """What speaks for a value: ``checksum``, ``structure`` (decoded), ``format`` (an issuer's) or ``name``."""
    if kind == "repository_token" or value.startswith("npm_"):
        return "checksum" if checksum_ok(value) else "format"
    if kind in ("signed_token", "basic_auth", "private_key", "connection_string"):
        return "structure"
    return "name" if kind in ("named_secret", "user_option", "bearer_auth") else "format"


def masked(value: str) -> bool:
    """Is it one of our own placeholders?"""
    return _MASKED.fullmatch(_PREFIX.sub("", value, count=1)) is not None


def plausible(value: str, quoted: bool = True) -> bool:
    """Can ``value``, given to a secret's name, be a live secret rather than a placeholder or reference?"""
    if len(value) < 6 or any(c.isspace() for c in value) or _PLACEHOLDER.search(value) or _REFERENCE.search(value):
        return False
    if "${" in value or "{{" in value or "%(" in value or "$(" in value or _UUID.match(value) or "://" in value:
        return False
    if not quoted and ("(" in value or "[" in value or value.endswith(("{", "&", "*"))):
        return False
    if len(set(value)) < 5 or masked(value):
        return False
    digit = any(c.isdigit() for c in value)
    letter = any(c.isalpha() for c in value)
    upper = any(c.isupper() for c in value)
    lower = any(c.islower() for c in value)
    if "/" in value and not (digit and upper and lower):
        return False
    if not quoted and re.fullmatch(r"[A-Za-z_][\w.]*", value) and not (digit and len(value) >= 10):
        return False
    return letter and (digit or (upper and lower and len(value) >= 14))


def find(text: str) -> list[tuple[int, int, str]]:
    """Places of credential values in ``text``: (start, end, kind), in order, without overlaps."""
    detectors = {d for _, d in automaton().iter(text.lower())} if len(text) == len(text.lower()) else set(KEYWORDS.values())
    if not detectors:
        return []
    joined, back = text, None
    if "\n" in text:
        pieces, at, removed, starts = [], 0, 0, [(0, 0)]
        for m in _SPLICE.finditer(text):
            pieces.append(text[at : m.start()])
            removed += m.end() - m.start()
            starts.append((m.end() - removed, m.end()))
            at = m.end()
        if at:
            joined = "".join([*pieces, text[at:]])
            back = starts
    found: list[tuple[int, int, str]] = []
    for kind in sorted(detectors):
        if kind == "named":
            for m in _SECRET_NAME.finditer(joined):
                name, rest = _BEFORE.search(joined, max(0, m.start() - 64), m.start()).group() + m.group(1), m.group(2)
                k = next((i for i in (3, 4, 5, 6) if m.group(i) is not None), 0)
                if k and "public" not in name.lower() and not _NO_SECRET_SUFFIX.search(rest) and plausible(m.group(k), k != 6):
                    found.append((*m.span(k), "named_secret"))
            continue
        for m in _COMPILED[kind].finditer(joined):
            value = m.group(1)
            if kind == "connection_string":
                user = value[value.index("://") + 3 :].split(":", 1)[0]
                secret = m.group(2)
                if _PLACEHOLDER.match(secret) or masked(secret) or "$" in secret and secret.startswith("$") or user.startswith(("$", "{", "<", "%")):
                    continue
            elif kind == "basic_auth" and not _basic_ok(value):
                continue
            elif kind == "signed_token" and not _jwt_ok(value):
                continue
            elif kind in ("bearer_auth", "user_option") and not plausible(value):
                continue
            elif kind in ("account_key", "other_issuer") and (len(set(value)) < 8 or masked(value) or not any(c.isdigit() for c in value)):
                continue
            elif kind in ("cloud_access_id", "payment_key", "chat_token", "repository_token", "model_key") and (
                len(set(value)) < 8 or masked(value) or "EXAMPLE" in value or _PLACEHOLDER.search(value)
            ):
                continue
            start, end = m.span(1)
            if kind == "private_key":
                close, again = _BLOCK_END.search(joined, end), _COMPILED[kind].search(joined, end)
                if close and not (again and again.start() < close.start()):
                    body, end = joined[end : close.start()], close.end()
                else:  # cut off: the body as far as it goes
                    body = _KEY_BODY.match(joined, end).group()
                    end += len(body)
                body = re.sub(r"\\[rnt]", " ", body)
                if body.strip() and masked(body):
                    continue
            found.append((start, end, kind))
    found.sort(key=lambda f: (f[0], f[2] == "named_secret", -f[1]))
    out: list[tuple[int, int, str]] = []
    for s, e, kind in found:
        if out and s < out[-1][1]:
            continue
        out.append((s, e, kind))
    if back:
        heads = [j for j, _ in back]

        def original(p: int, end: bool) -> int:
            i = bisect_right(heads, p - end) - 1
            return back[i][1] + p - back[i][0]

        out = [(original(s, False), original(e, True), kind) for s, e, kind in out]
    return out


def _mask(text: str) -> str:
    """Digits become 0, letters x or X; in hexadecimal text a or A, so it stays a number; escapes and marks stay."""
    parts = _ESCAPE.findall(text)
    plain = "".join(p for p in parts if p[0] != "\\")
    letters = {c.lower() for c in plain if c.isalpha()}
    low, high = ("a", "A") if letters <= set("abcdef") else ("x", "X")
    swap = lambda c: "0" if c.isdigit() else high if c.isupper() else low if c.isalpha() else c
    return "".join(p if p[0] == "\\" else "".join(map(swap, p)) for p in parts)


def placeholder(value: str, kind: str) -> str:
    """A text of the same length and alphabet; line ends, issuers' prefixes and key frames stay."""
    if kind == "connection_string":
        head, rest = value.split("://", 1)
        user, secret = rest.split(":", 1)
        return f"{head}://{user}:{_mask(secret)}"
    if kind == "private_key":
        body = re.split(r"(-----(?:BEGIN|END)[A-Z0-9 ]+-----|\\r|\\n|\\t)", value)
        return "".join(p if i % 2 else _mask(p) for i, p in enumerate(body))
    prefix = _PREFIX.match(value)
    keep = prefix.end() if prefix else 0
    return value[:keep] + _mask(value[keep:])


def key_rests(text: str, places: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Bodies of private keys whose beginning lies in another text; nothing starts there, but they are secret."""
    out: list[tuple[int, int, str]] = []
    for close in _BLOCK_END.finditer(text) if "-----END" in text else ():
        if any(s <= close.start() < e for s, e, _ in places):
            continue
        ends = [(0, 0), *(m.span() for m in _KEY_LINE_END.finditer(text, 0, close.start()))]
        lines = [(e, s) for (_, e), (s, _) in zip(ends, [*ends[1:], (close.start(), 0)])]
        begin = None
        for nth, (s, e) in enumerate(reversed(lines)):  # whole lines of the body, the last and the first of any length
            held = _KEY_LINE.fullmatch(text, s, e)
            if held and (len(held.group(1)) >= 24 or begin is None or s == 0):
                begin = held.start(1)
            elif s < e or nth:
                opened = _KEY_TAIL.search(text[s:e])  # the body begins behind a quote
                if opened:
                    begin = s + opened.start(1)
                break
        if begin is not None and not masked(text[begin : close.start()]):
            out.append((begin, close.start(), "private_key"))
    return out


def redact(text: str, places: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in sorted(places):
        out += [text[at:s], placeholder(text[s:e], kind)]
        at = e
    return "".join([*out, text[at:]])


def _scan(texts: DataFrame, id_col: str, text_col: str, schema: str, rows) -> DataFrame:
    narrow = texts.select(id_col, text_col)
    kind = narrow.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: list[int] = []
            columns: list[list] = [[] for _ in names]
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    for row in rows(text):
                        index.append(i)
                        for c, v in zip(columns, row):
                            c.append(v)
            ids = batch.column(0).take(pa.array(index, type=pa.int64()))
            kinds = {"int": pa.int32(), "string": pa.string()}
            arrays = [pa.array(c, type=kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "))]
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=["id", *names])

    return narrow.mapInArrow(run, f"id {kind}, {schema}")


def find_credentials(texts: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``(id, line_no, kind, start, length, proof)`` for each credential; lines from 1, ``start`` from 0.

    Null and empty texts have none. Repeated input rows give repeated rows. A narrow map: no shuffle, and
    texts of any length are scanned whole. Extra columns are ignored.
    """
    def rows(text: str):
        for s, e, kind in find(text):
            yield text.count("\n", 0, s) + 1, kind, s, e - s, proof(text[s:e], kind)

    return _scan(texts, id_col, text_col, "line_no int, kind string, start int, length int, proof string", rows)


def redact_credentials(texts: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``(id, content)`` of the texts that hold credentials, their values replaced; all else unchanged.

    Of a key cut in two by the end of a text both parts are replaced.
    """
    def rows(text: str):
        places = find(text)
        places += key_rests(text, places)
        if places:
            yield (redact(text, places),)

    return _scan(texts, id_col, text_col, "content string", rows)
