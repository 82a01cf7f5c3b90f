"""Credentials in texts and source code: finding and masking (problem 1).

A text is scanned for tokens with an issuer's prefix, private key blocks,
credentials in addresses, headers, commands and prose, and values assigned to
names that mean a secret.  Every literal that may be an encoding (base64, hex,
percent, backslash escapes) is decoded and scanned again, layer by layer;
decoded bytes are also read by the grammar of key containers (DER private keys,
OpenSSH, PKCS#12, Java key stores).  A hit in an inner layer masks the enclosing literal, so the
code around it stays intact.

Defined results: null and empty texts hold nothing; exact duplicate rows give
one finding; a value that is a placeholder, a plain word, masked, empty, a
reference to a variable or a name of something is no secret.
"""

from __future__ import annotations

import base64
import binascii
import re
import sys
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import spread

MASK = "REDACTED"


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    kind: str
    layers: int = 0
    #: Further parts of the same value, on later lines.
    rest: tuple[tuple[int, int], ...] = ()


# Prefixes by which issuers mark their tokens.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:"
    r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{16,}|xox[abeoprs]-[A-Za-z0-9\-]{18,}"
    r"|(?:AKIA|ASIA|AGPA|AROA)[A-Z0-9]{16}(?![A-Z0-9])|AIza[A-Za-z0-9_\-]{30,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-|or-)?[A-Za-z0-9_\-]{20,}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{20,}|npm_[A-Za-z0-9]{20,}|pypi-[A-Za-z0-9_\-]{30,}|hf_[A-Za-z0-9]{24,}|dop_v1_[a-f0-9]{40,}|ya29\.[A-Za-z0-9_\-]{20,}"
    r"|shp(?:at|ss|ca|pa)_[a-fA-F0-9]{24,}|EAAC[A-Za-z0-9]{30,}|(?:key|tok)[_\-][A-Za-z0-9]{22,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,})"
)
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_PEM_PUBLIC = re.compile(r"-----BEGIN (?:(?!PRIVATE)[A-Z0-9 ])+-----[\s\S]*?-----END [A-Z0-9 ]+-----")
#: Fixed value: the lines of a key file of PuTTY, down to its private part.
_PUTTY = re.compile(r"^[ \t]*PuTTY-User-Key-File-\d: \S+\r?\n(?:[ \t]*(?:[A-Z][\w\-]*: [^\n]*|[A-Za-z0-9+/=]+)\r?\n)*?[ \t]*Private-Lines: (?P<n>\d+)\r?\n", re.M)

# The last words of names that mean a secret.
_SECRET_NAME = (
    r"(?:api|access|secret|signing|encryption|private|master|account|storage|auth|session|service|shared|deploy|consumer|client|app|application|subscription|license|webhook|host|ssh|hmac|jwt|crypt|cipher)[_\-. ]?key(?:[_\-. ]?id)?"
    r"|(?:auth|access|bearer|refresh|id|api|index|session|csrf|personal|security|registry|deploy|bot|oauth|npm|github|gitlab|slack|private|service|device|app|user|web|push|login)?[_\-. ]?token"
    r"|(?:client|app|api|webhook|shared|consumer|oauth|aws|jwt|session|cookie|signing|hmac|service|user|db)?[_\-. ]?secret"
    r"|(?:[a-z]+[_\-. ]?)?(?:password|passwd|passphrase|pwd)|(?:db|smtp|ftp|ssh|root|mysql|pg|redis|admin|user|login|mail|imap)[_\-. ]?pass|pgpassword|pass|passcode|kennwort|passwort|contraseña|mot de passe|пароль|密码|パスワード|비밀번호"
    r"|_?auth|_authtoken|credentials?|connection[_\-. ]?string|dsn"
)
_NAME = rf"(?<![A-Za-z])(?P<name>(?:[A-Za-z0-9]+[_\-.])*?(?:{_SECRET_NAME})|[A-Za-z0-9_]*?(?:_|(?<=[a-z0-9])(?=[A-Z]))(?:{_SECRET_NAME}))(?![A-Za-z0-9_])"
_TYPE = r"(?:\s*:\s*&?\s*(?:'static\s+)?[A-Za-z_][\w.<>\[\]?| ]{0,40}?(?=\s*=))?"
#: name = "value", name: 'value', "name": "value", name("value", name => value, with parts on later lines
_QUOTED = re.compile(
    rf"{_NAME}[\"'`\]]{{0,2}}(?:\[\])?{_TYPE}\s*(?:=>|:=|==|=|:|,(?=\s*[\"']))\s*(?:\\\s*\n\s*)?[\(\[]?\s*(?:[bBrRuUfF]{{1,2}}|@|L)?(?P<q>\"\"\"|'''|[\"'`])(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)",
    re.I | re.S,
)
_BARE = re.compile(rf"{_NAME}[\"'`\]]{{0,2}}(?:[ \t]*(?:=>|:=|=|:)[ \t]*(?:[>|][\-+]?[ \t]*\n[ \t]+)?|[ \t]+(?=\S+[ \t]*(?:\n|$)))(?P<v>[^\s\"'`<>(){{}}\[\],;]+(?:[^\s\"'`,;)}}]*[^\s\"'`,;.)}}])?)", re.I)
_NAME_WORD = re.compile(r"key|token|secret|pass|pwd|auth|cred|dsn|connection|kennwort|contrase|пароль|密码|パスワード|비밀번호", re.I)
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_ATTRIBUTE = re.compile(rf"(?:key|name|id)\s*=\s*[\"']{_NAME}[\"']\s+value\s*=\s*(?P<q>[\"'])(?P<v>[^\"'\n]*)(?P=q)", re.I)
_ELEMENT = re.compile(rf"<{_NAME}>(?P<v>[^<>\n]+)</", re.I)
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://(?P<user>[^\s:/@\"'<>]*):(?P<v>[^\s/\"'<>]+?)@(?=[\w\[$.\-])")
_BASIC = re.compile(r"\bBasic[ \t]+(?P<v>[A-Za-z0-9+/_\-]{8,}={0,2})")
_BEARER = re.compile(r"\b(?:Bearer|Token)[ \t]+(?P<v>[A-Za-z0-9._~+/\-]{12,}={0,2})(?![\w$])")
_HEADER = re.compile(r"\b(?:X-[A-Za-z\-]*(?:Key|Token|Secret|Auth)|Private-Token|Api-Key|Ocp-Apim-Subscription-Key)[ \t]*[:=][ \t]*(?P<v>[^\s\"',;]{8,})", re.I)
_NETRC = re.compile(r"\blogin[ \t]+\S+[ \t]+password[ \t]+(?P<v>\S+)")
_SHORT_P = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb|sshpass|psql|mongo|mongosh|redis-cli|sqlcmd|ldapsearch)\b[^\n]*?[ \t](?:-p|-a[ \t]+|-P[ \t]+|-w[ \t]+|--password[= ])(?P<v>[^\s\-\"'][^\s\"']*)")
_CURL_U = re.compile(r"\b(?:curl|wget|http)\b[^\n]*?[ \t](?:-u|--user)[ \t=]+[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)")
_FLAG = re.compile(r"[ \t]--(?:password|passwd|token|secret|api-key|access-key|auth-token|client-secret)(?:[ \t]+|=)[\"']?(?P<v>[^\s\"']+)")
#: Any flag with a name for a secret.
_LONG_FLAG = re.compile(rf"(?:^|(?<=[\s\"'`=(\[]))--?(?P<name>(?:[A-Za-z0-9]+[_\-.])*?(?!_?auth[ \t=]|credentials?[ \t=])(?:{_SECRET_NAME}))[ \t]+[\"']?(?P<v>[^\s\"']+)", re.I | re.M)
_CALL = re.compile(r"\b(?P<callee>[A-Za-z_][\w.:]*(?:client|connect|login|auth\w*|signin|session|credential)\w*(?:::\w+|\.\w+)?|(?:client|connect|login|authenticate|signin|credentials?)(?:::\w+|\.\w+)?)\s*\((?P<args>[^()\n]*?[\"'`][^()\n]*)\)", re.I)
_STRING = re.compile(r"(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)")
_PROSE = re.compile(
    r"\b(?:account|login|log in|credentials?|sign in|user(?:name)?)\b[^.\n]{0,40}?\b(?:is|are|with|as|:)\s+[`\"']?[\w.@\-]+[`\"']?\s*(?:/|:|with|and|,)\s*(?:(?:the )?pass(?:word|phrase)?\s+(?:is\s+)?)?[`\"']?(?P<a>[^\s`\"']{8,}?)[`\"']?(?=[.,;)]?(?:\s|$))"
    r"|\b(?:password|passphrase|passcode|pwd|secret|token|api[ \-]?key|access key|credential)\b[^.\n:=]{0,40}?\b(?:is|was|remains|still|to|use|enter|type|set to|of)\s+[`\"'“]?(?P<b>[^\s`\"'“”]{8,}?)[`\"'”]?(?=[.,;)]?(?:\s|$))"
    r"|\b(?:we|they|you|still|please|just|always)\s+(?:still\s+)?(?:use|uses|using|enter|paste)\s+[`\"'“]?(?P<c>[^\s`\"'“”]{8,}?)[`\"'”]?\s+(?:until|as|for|when|to|before)\b[^.\n]{0,30}?\b(?:rotat\w*|password|token|key|log in|login|secret|renew\w*)",
    re.I,
)
# Signs without which a pattern can't match; looking for them is many times cheaper.
_NAME_SIGNS = ("key", "token", "secret", "pass", "pwd", "auth", "cred", "dsn", "connection", "kennwort", "contrase", "пароль", "密码", "パスワード", "비밀번호")
_ISSUED_SIGNS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "AKIA", "ASIA", "AGPA", "AROA", "AIza", "k_live", "k_test", "sk-", "SG.", "npm_", "pypi-", "hf_", "dop_v1_", "ya29.", "shpat", "shpss", "shpca", "shppa", "EAAC", "key_", "key-", "tok_", "tok-", "eyJ")
_COMMAND_SIGNS = ("mysql", "maria", "sshpass", "psql", "mongo", "redis-cli", "sqlcmd", "ldapsearch")
_PROSE_SIGNS = ("account", "login", "log in", "sign in", "credential", "user", "password", "passphrase", "passcode", "pwd", "secret", "token", "api key", "api-key", "apikey", "access key", "rotat", "renew")
_ESCAPES = ("\\x", "\\u", "\\0", "\\1", "&#")


_PLACEHOLDER = re.compile(
    r"^(?:<[^>]*>|\[[^\]]*\]|\{[^}]*\}|x{3,}|X{3,}|\*+|\.+|-+|_+|#+|•+|0+|1234567?8?9?0?|(?:your|my|some|the|a|an|insert|enter|put|add|replace|change|set|fill)[-_ ].*|.*(?:changeme|change[-_]me|placeholder|redacted|example|dummy|sample|todo|fixme|replace[-_ ]?me|set[-_]me|notset|not[-_]set|your[-_]|goes[-_]here|\bhere\b|masked|hidden[-_]value|removed).*|none|null|nil|undefined|true|false|n/?a|empty|test(?:ing)?|foo(?:bar)?|bar|default|secret|password|passwd|token|string|str|bytes|optional|required)$",
    re.I | re.S,
)
_REFERENCE = re.compile(r"\$\{|\$\(|^\$[A-Za-z_]|\{\{|\}\}|^%[A-Za-z_]+%|^%\(|<%|^@[A-Za-z_.]+$|^&[A-Za-z_]|\b(?:os\.environ|process\.env|env::var|getenv|System\.getenv|ENV\[|secrets\.|vault[:.]|var\.|config\.|settings\.|self\.|this\.|args\.|options\.|params\.)|^ref\+|^!(?:Ref|Sub|vault)|^\w+\(.*\)$|^(?:env|file|vault|ssm|sops|keyring|secretsmanager):", re.I)
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_HEXED = re.compile(r"^(?:[0-9a-fA-F]{2}){12,}$")
_B64 = re.compile(r"^[A-Za-z0-9+/_\-]{16,}={0,2}$")
_ENCODED = re.compile(r"[A-Za-z0-9+/_\-]{20,}={0,2}|(?:%[0-9A-Fa-f]{2}|[\w.~\-]){8,}|(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}|[\w.+/=\-]){8,}|(?:&#x?[0-9a-fA-F]+;){6,}")
#: An encoded literal wrapped over lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_\-=])[A-Za-z0-9+/_\-]{20,}(?:[ \t]*(?:\\?\r?\n|\\r\\n|\\n)[ \t]*[A-Za-z0-9+/_\-]{2,})+={0,2}")
_WRAPPED_PIECE = re.compile(r"(?<!\\)[A-Za-z0-9+/_\-]+={0,2}|(?<=\\n)[A-Za-z0-9+/_\-]+={0,2}")
_CODE_NAME = re.compile(r"^(?:[A-Za-z]+(?:[-_. ][A-Za-z]+)*|[a-z_]+(?:\.[a-z_\d]+)+|[\w\-./~]+\.(?:pem|key|crt|cer|pub|txt|json|ya?ml|toml|ini|env|conf|py|js|ts|go|rs|md|sh)|(?:[.~]{0,2}/)[\w\-./ ]*|[A-Za-z_]\w*\(\)?|--?[a-z\-]+)$")
_ADDRESS = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s@]*$|^[\w.\-]+@[\w\-]+(?:\.[\w\-]+)+$|^[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,10}(?::\d+)?(?:/\S*)?$")
#: Words that, in a name, say that its value is no secret.
_PUBLIC_NAME = re.compile(r"public|(?:count|limit|length|size|name|path|file|url|uri|type|field|column|header|ttl|pattern|regex|label|prefix|version|status|policy|hint|_id)$", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _distinct(v: str) -> int:
    return len(set(v))


def _drawn(v: str) -> bool:
    """Letters in so irregular a mix of cases that they are no words."""
    letters = re.sub(r"[^A-Za-z]", "", v)
    return len(v) >= 10 and len(letters) >= 0.8 * len(v) and letters.lower() != letters != letters.upper() and len(letters) < 3.2 * len(_PARTS.findall(letters)) and not re.search(r"[\s/.]", v) and _distinct(v) >= 7


def _explicit(v: str) -> bool:
    """Whether a value where only a password can stand is one, and no stand-in."""
    return len(v) >= 8 and re.search(r"[\dA-Z]", v) is not None and _distinct(v) >= 5 and not _PLACEHOLDER.match(v) and not _REFERENCE.search(v) and "/" not in v


def usable(value: str, strict: bool = False) -> bool:
    """Whether a value can serve as a credential; strict asks for figures or signs besides letters."""
    v = value.strip()
    if len(v) < 6 or _PLACEHOLDER.match(v) or _REFERENCE.search(v) or _ADDRESS.match(v):
        return False
    if _drawn(v):
        return True
    if _CODE_NAME.match(v):
        return False
    if _distinct(v) < 5 or re.search(r"(.)\1{7,}", v) or any(c.isspace() for c in v):
        return False
    if re.fullmatch(r"[\d.,:]+", v) or v[0] in "<{" and v[-1] in ">}":
        return False
    kinds = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if not re.search(r"\d", v) and not (kinds >= 3 or len(v) >= 20 and kinds >= 2):
        return False
    return kinds >= 3 or len(v) >= 12 if strict else kinds >= 2


# --- encodings -------------------------------------------------------------


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.97 * len(text) else None


def decodings(literal: str) -> Iterator[tuple[str, bytes]]:
    """(encoding, decoded bytes) of a literal, for each encoding that it may be in."""
    body = re.sub(r"\\?\s", "", literal)
    if len(body) >= 16 and _HEXED.match(body):
        yield "hex", bytes.fromhex(body)
    elif _B64.match(body) and len(body.rstrip("=")) % 4 != 1:
        try:
            yield "base64", base64.b64decode(body.replace("-", "+").replace("_", "/").rstrip("=") + "=" * (-len(body.rstrip("=")) % 4), validate=True)
        except (binascii.Error, ValueError):
            pass
    if "%" in literal and re.search(r"%[0-9A-Fa-f]{2}", literal):
        yield "percent", urllib.parse.unquote_to_bytes(literal)
    if "\\" in literal and re.search(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3}|[nrt\"'/\\])", literal):
        put = {"n": "\n", "r": "\r", "t": "\t"}
        yield "escape", re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|([0-7]{3})|(.))", lambda m: chr(int(m.group(1) or m.group(2), 16)) if m.group(1) or m.group(2) else chr(int(m.group(3), 8)) if m.group(3) else put.get(m.group(4), m.group(4)), literal, flags=re.S).encode("utf-8", "surrogatepass")
    if "&#" in literal:
        import html

        yield "entity", html.unescape(literal).encode("utf-8", "surrogatepass")


# --- key containers by their binary grammar ----------------------------------


def _der(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, its end) of the DER element at a place, or None."""
    if at + 2 > len(data):
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > len(data):
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + length) if at + length <= len(data) else None


def _strings(data: bytes, at: int, width: int = 4) -> Iterator[tuple[bytes, int]]:
    """(bytes, end) of the strings with their length in front that follow one another; stops where one runs past the end."""
    while at + width <= len(data):
        end = at + width + int.from_bytes(data[at : at + width], "big")
        if end > len(data):
            return
        yield data[at + width : end], end
        at = end


def _openssh(data: bytes) -> bool:
    """Cipher, derivation and its options, the number of keys, so many public keys, then one private section."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    head = [part for _, part in zip(range(3), _strings(data, len(magic)))]
    if len(head) < 3 or not head[0][0] or not head[1][0]:
        return False
    at = head[2][1]
    n = int.from_bytes(data[at : at + 4], "big")
    keys = [part for _, part in zip(range(n + 1), _strings(data, at + 4))] if 1 <= n <= len(data) else []
    return len(keys) == n + 1 and n > 0 and len(keys[-1][0]) >= 16 and len(keys[-1][0]) % 8 == 0 and next(_strings(keys[0][0], 0), (b"", 0))[0].isascii()


def _java_store(data: bytes) -> bool:
    """A Java key store with at least one entry for a private key, the entries being well formed down to it."""
    if data[:4] not in (bytes.fromhex("feedfeed"), bytes.fromhex("cececece")) or int.from_bytes(data[4:8], "big") not in (1, 2):
        return False
    at = 12
    for _ in range(int.from_bytes(data[8:12], "big")):
        tag = int.from_bytes(data[at : at + 4], "big")
        alias = next(_strings(data, at + 4, 2), None)
        if alias is None:
            return False
        at = alias[1] + 8  # its date
        if tag == 1:
            key = next(_strings(data, at), None)
            return key is not None and key[0][:1] == b"\x30"
        kind = next(_strings(data, at, 2), None) if tag == 2 else None
        trusted = next(_strings(data, kind[1]), None) if kind else None
        if trusted is None:
            return tag == 3 and data[:4] == bytes.fromhex("cececece")  # a secret key, whose length isn't written down
        at = trusted[1]
    return False


def key_container(data: bytes) -> str | None:
    """The kind of private key container in the bytes, if they follow the grammar of one."""
    if _openssh(data):
        return "openssh private key"
    if _java_store(data):
        return "java key store"
    outer = _der(data, 0)
    if not outer or outer[0] != 0x30 or len(data) < 40:
        return None
    parts, at = [], outer[1]
    while at < outer[2]:
        e = _der(data[: outer[2]], at)
        if e is None:
            return None
        parts.append(e)
        at = e[2]
    tags = [p[0] for p in parts]
    first = int.from_bytes(data[parts[0][1] : parts[0][2]], "big") if parts and tags[0] == 2 else -1
    if len(tags) >= 9 and tags[:9] == [2] * 9 and first in (0, 1):
        return "rsa private key"
    if tags[:3] == [2, 0x30, 4] and first in (0, 1):
        return "pkcs8 private key"
    if tags == [2] * 6 and first == 0:
        return "dsa private key"
    if tags[:2] == [2, 4] and first == 1:
        return "ec private key"
    if tags == [0x30, 4]:
        inner = _der(data, parts[0][1])
        # The identifiers of password-based encryption, PKCS#5 and PKCS#12
        if inner and inner[0] == 6 and data[inner[1] : inner[1] + 8] in (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c")):
            return "encrypted pkcs8 private key"
    if tags[:2] == [2, 0x30] and first == 3:
        return "pkcs12 store"
    return None


# --- the scan ------------------------------------------------------------------


def _pem_block(text: str, m: re.Match) -> Finding | None:
    """A private key block with a body; the body's lines are what is masked."""
    head = m.group(1)
    stop = text.find(f"-----END {head}-----", m.end())
    other = text.find("-----BEGIN ", m.end())
    if stop < 0 or (0 <= other < stop):
        run = re.compile(r"(?:\s|\\[nr]|[A-Za-z0-9+/=:,.\-]{20,})*").match(text, m.end())
        stop = run.end() if run else m.end()
    body = text[m.end() : stop]
    chars = re.sub(r"\\[nr]|[^A-Za-z0-9+/]", "", re.sub(r"^[ \t]*[A-Za-z\-]+: .*$", "", body, flags=re.M))
    if len(chars) < 40 or _distinct(chars) < 12:
        return None
    parts = tuple((m.end() + x.start(), m.end() + x.end()) for x in re.finditer(r"(?<![A-Za-z0-9+/=\\])(?:(?<=\\n))?[A-Za-z0-9+/=]{4,}", body))
    return Finding(m.start(), m.end(), "private key block", 0, parts or ((m.end(), stop),))


def _later_parts(text: str, end: int, q: str) -> list[tuple[int, int]]:
    """String parts that continue a literal on the next lines: "a" "b", "a" + "b"."""
    out, at = [], end
    more = re.compile(r"\s*(?:\+|\.|\.\.|&|\\)?\s*\n\s*(?:\+|\.)?\s*(?P<q>[\"'`])(?P<v>[^\"'`\n]*)(?P=q)|\s*\+\s*(?P<q2>[\"'`])(?P<v2>[^\"'`\n]*)(?P=q2)")
    while m := more.match(text, at):
        g = "v" if m.group("v") is not None else "v2"
        after = text[m.end() : m.end() + 3].lstrip()
        if after[:1] in (":", "=") and not after.startswith("=="):
            break
        out.append(m.span(g))
        at = m.end()
    return out


def _openable(value: str, depth: int) -> tuple[str, int] | None:
    """(kind, layers) if a literal holds a secret in an inner layer."""
    if depth == 200:  # each layer is shorter than the last, so this many can follow; scan and this function are two frames a layer
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(value) + 2000))
    for _, data in decodings(value):
        if kind := key_container(data):
            return kind, depth + 1
        inner = _printable(data)
        if inner is None or len(inner) >= len(value):
            continue
        found = scan(inner, depth + 1)
        if found:
            return found[0].kind, max(depth + 1, found[0].layers)
    return None


def _name_places(text: str) -> list[tuple[int, int]]:
    """(place, start of the run of name characters) where names may begin that hold a word for a secret.

    No sign of assignment can follow within a run, so a name ends with its run and its last word for a secret; it begins
    in that word's part or at most two before it, or is the whole run.
    """
    last: dict[int, int] = {}  # by run, the last word's place
    begin = done = -1
    for m in _NAME_WORD.finditer(text):
        at = m.start()
        while at > max(done, 0) and text[at - 1] in _NAME_CHARS:
            at -= 1
        if at != done:  # else the last word's run goes on
            begin = at
            while begin < m.start() and text[begin] in "-.":
                begin += 1
        last[begin] = m.start()
        done = m.end()
    places = set()
    for begin, at in last.items():
        places.add((begin, begin))
        for _ in range(3):
            at = max(text.rfind("-", begin, at), text.rfind(".", begin, at))
            if at < 0:
                break
            places.add((at + 1, begin))
    return sorted(places)


def _matches(pattern: re.Pattern, text: str, places: list[tuple[int, int]]) -> Iterator[re.Match]:
    for at, begin in places:
        if (m := pattern.match(text, at)) and not _PUBLIC_NAME.search(text[begin : m.end("name")]):
            yield m


def _wrapped(text: str, depth: int) -> Iterator[tuple[list[tuple[int, int]], tuple[str, int]]]:
    """Encoded literals over several lines of one length and a last of at most that: (their pieces, what they hold)."""
    for m in _WRAPPED.finditer(text):
        pieces = [(m.start() + x.start(), m.start() + x.end()) for x in _WRAPPED_PIECE.finditer(m.group())]
        width = pieces[0][1] - pieces[0][0]
        even = next((i for i, (a, b) in enumerate(pieces) if b - a != width), len(pieces))
        for n in (even + 1, even):
            run = pieces[:n]
            if 2 <= n <= len(pieces) and run[-1][1] - run[-1][0] <= width:
                joined = "".join(text[a:b] for a, b in run)
                if (inner := _openable(joined, depth)) and not all(_openable(text[a:b], depth) for a, b in run):
                    yield run, inner
                    break


def _putty_file(text: str, m: re.Match) -> Finding | None:
    """A key file of PuTTY; its private lines are what is masked."""
    at, parts = m.end(), []
    for line in re.compile(r"[ \t]*([A-Za-z0-9+/=]+)[ \t]*(?:\r?\n|\Z)").finditer(text, at):
        if line.start() != at or len(parts) == int(m.group("n")):
            break
        parts.append(line.span(1))
        at = line.end()
    return Finding(m.start() + len(m.group()) - len(m.group().lstrip()), m.end(), "private key block", 0, tuple(parts)) if sum(b - a for a, b in parts) >= 40 else None


def scan(text: str, depth: int = 0, gated: bool = True) -> list[Finding]:
    """The secrets of a text, by place; overlapping findings are merged to the first.

    A pattern is tried only where the text has a sign without which it can't match; without ``gated`` all are.
    """
    if not text:
        return []
    low = text.lower()
    has = lambda signs: not gated or any(x in low for x in signs)
    # words long enough to be a value or an encoding, with a figure or mixed cases in them
    words = [w for w in text.split() if len(w) >= 8]
    long = [w for w in words if any(map(str.isdigit, w)) or len(w) >= 12 or not (w.islower() or w.isupper() or w.istitle())]
    if not gated:
        long = words = ["x" * 40]
    quoted = not gated or '"' in text or "'" in text or "`" in text
    named = has(_NAME_SIGNS)
    found: list[Finding] = []
    public = [m.span() for m in _PEM_PUBLIC.finditer(text)] if "-----BEGIN" in text else []

    def add(a: int, b: int, kind: str, rest: tuple = (), layers: int = depth) -> None:
        if not any(x <= a < y for x, y in public):
            found.append(Finding(a, b, kind, layers, rest))

    for m in _PEM.finditer(text) if "-----BEGIN" in text else ():
        if block := _pem_block(text, m):
            found.append(block)
            public.append((m.end(), block.rest[-1][1]))
    for m in _PUTTY.finditer(text) if "PuTTY-User-Key-File-" in text else ():
        if block := _putty_file(text, m):
            found.append(block)
            public.append((m.end(), block.rest[-1][1]))
    for m in _ISSUED.finditer(text) if not gated or any(x in text for x in _ISSUED_SIGNS) else ():
        v = m.group()
        body = re.split(r"[_\-.]", v)[-1]
        if _distinct(v) >= 10 and not re.search(r"(.)\1{7,}", v) and re.search(r"\d|[A-Z]", body + v[4:]) and not _PLACEHOLDER.match(body) and not re.fullmatch(r"(?:sk|key|tok)[-_][a-z\-_]+", v):
            add(*m.span(), "issued token")
    if "://" in text and "@" in text:
        for m in _URL.finditer(text):
            v = m.group("v")
            plain = urllib.parse.unquote(v)
            if usable(plain) or _explicit(plain):
                add(*m.span("v"), "address password")
    for m in _BASIC.finditer(text) if "Basic" in text else ():
        for name, data in decodings(m.group("v")) if len(m.group("v")) >= 16 else [("base64", _b64(m.group("v")))]:
            user, colon, password = (_printable(data) or "").partition(":")
            if colon and usable(password):
                add(*m.span("v"), "basic credentials", layers=depth + 1)
    simple = (
        (_BEARER, "bearer token", not gated or "Bearer" in text or "Token" in text), (_HEADER, "header value", named and has(("x-", "private-token", "api-key", "subscription-key"))), (_NETRC, "login password", not gated or "login" in text and "password" in text),
        (_SHORT_P, "command password", has(_COMMAND_SIGNS)), (_CURL_U, "command password", has(("curl", "wget", "http")) and ":" in text), (_FLAG, "command password", not gated or " --" in text or "\t--" in text),
    )
    for pattern, kind, possible in simple:
        for m in pattern.finditer(text) if possible else ():
            if usable(m.group("v"), strict=kind in ("bearer token", "header value")) or kind in ("login password", "command password") and pattern is not _FLAG and _explicit(m.group("v")):
                add(*m.span("v"), kind)
    places = _name_places(text) if named else []
    for pattern, possible in ((_QUOTED, quoted and places), (_ATTRIBUTE, places and "value" in low), (_ELEMENT, places and "</" in text)):
        for m in () if not possible else _matches(pattern, text, places) if pattern is _QUOTED else pattern.finditer(text):
            if pattern is not _QUOTED and _PUBLIC_NAME.search(m.group("name")):
                continue
            rest = tuple(_later_parts(text, m.end(), m.groupdict().get("q") or "")) if pattern is _QUOTED else ()
            v = m.group("v") + "".join(text[a:b] for a, b in rest)
            if usable(v) and _inner_usable(v):
                add(*m.span("v"), "assigned value", rest)
    for m in _matches(_BARE, text, places):
        v = m.group("v")
        if usable(v, strict=True) and _inner_usable(v) and not _prose_word(text, m):
            add(*m.span("v"), "assigned value")
    for m in _LONG_FLAG.finditer(text) if places and "-" in text else ():
        if not _PUBLIC_NAME.search(m.group("name")) and usable(m.group("v"), strict=True) and _inner_usable(m.group("v")):
            add(*m.span("v"), "command password")
    for m in _CALL.finditer(text) if quoted and "(" in text and has(("client", "connect", "login", "auth", "signin", "session", "credential")) else ():
        strings = list(_STRING.finditer(m.group("args")))
        if len(strings) >= 2 or re.search(r"(?i)auth|login|credential|signin", m.group("callee")):
            s = strings[-1] if strings else None
            if s and usable(s.group("v"), strict=True) and not _UUID.match(s.group("v")) and (len(strings) >= 2 or len(s.group("v")) >= 16):
                base = m.start("args")
                add(base + s.start("v"), base + s.end("v"), "call argument")
    for m in _PROSE.finditer(text) if long and has(_PROSE_SIGNS) else ():
        g = next(k for k in "abc" if m.group(k))
        v = m.group(g).rstrip(".,;)")
        if _drawn(v) or usable(v, strict=True) and not re.fullmatch(r"[\w.\-]*[a-z]{2}\.?(?:['’]s)?", v.split("-")[0]) or (usable(v, strict=True) and re.search(r"\d", v) and not re.fullmatch(r"v?\d+(?:[.,]\d+)*%?(?:[A-Za-z]{1,3})?", v)):
            add(m.start(g), m.start(g) + len(v), "secret in prose")
    covered = sorted((f.start, f.end) for f in found)
    for run, inner in _wrapped(text, depth) if "\n" in text or "\\n" in text else ():
        if not any(x < b and a < y for a, b in run for x, y in [*covered, *public]):
            add(*run[0], inner[0], tuple(run[1:]), inner[1])
    for m in _ENCODED.finditer(text) if any(len(w) >= 16 for w in long) or any(len(w) >= 40 for w in words) or "%" in text or has(_ESCAPES) else ():
        a, b = m.span()
        if b - a >= 16 and not any(x < b and a < y for x, y in covered) and not any(x <= a < y for x, y in public):
            inner = _openable(m.group(), depth)
            if inner:
                add(a, b, inner[0], layers=inner[1])
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Finding] = []
    taken: list[tuple[int, int]] = []
    for f in found:
        if not any(a < f.end and f.start < b for a, b in taken):
            out.append(f)
            taken += [(f.start, f.end), *f.rest]
    return out


def _b64(v: str) -> bytes:
    try:
        return base64.b64decode(v.rstrip("=") + "=" * (-len(v.rstrip("=")) % 4))
    except (binascii.Error, ValueError):
        return b""


def _inner_usable(v: str) -> bool:
    """A value that decodes to readable text is judged by that text."""
    short = [("base64", _b64(v))] if 8 <= len(v) < 16 and len(v) % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v) else []
    for _, data in [*decodings(v), *short]:
        inner = _printable(data)
        if inner is not None and len(inner) >= 4 and (_PLACEHOLDER.match(inner.strip()) or _REFERENCE.search(inner)):
            return False
    return True


def _prose_word(text: str, m: re.Match) -> bool:
    """Whether name and value are only words of a sentence, such as "token 7,595 of"."""
    between = text[m.end("name") : m.start("v")]
    v = m.group("v")
    if between.strip(" \t\"'`]") == "":  # no sign in between: a directive such as ENV NAME value
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        return not re.fullmatch(r"\s*(?:ENV|ARG|SET|export|setx?|env|machine .*)\s+", line, re.I) or not re.search(r"\d|[^\w\-]", v)
    return bool(re.fullmatch(r"[a-z]+[.,]?", v)) or (between.strip() == ":" and bool(re.match(r"[a-z]+[:\[&]", v)))


def redact(text: str | None) -> str | None:
    """The text with each secret value masked; quotes, escapes and line structure stay."""
    if not text:
        return text
    spans = []
    for f in scan(text):
        spans += list(f.rest) if f.kind == "private key block" else [(f.start, f.end), *f.rest]
    for a, b in sorted(set(spans), reverse=True):
        text = text[:a] + MASK + text[b:]
    return text


def find_secrets(df: DataFrame, tab: str, id_col: str, text_col: str) -> DataFrame:
    """Rows (tab, record_id, line_no, kind, start_char, end_char, layers) of the secrets in a column; a narrow pass, then distinct on the few findings."""
    source = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("length(_text) > 0"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["_id"], batch["_text"]):
                rows += [(tab, key, text.count("\n", 0, f.start) + 1, f.kind, f.start, f.end, f.layers) for f in scan(text)]
            yield pd.DataFrame(rows, columns=["tab", "record_id", "line_no", "kind", "start_char", "end_char", "layers"])

    return source.mapInPandas(run, "tab string, record_id string, line_no int, kind string, start_char int, end_char int, layers int").distinct()


def redacted(df: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``df`` with the secrets in one column masked; all other columns as they are."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    return df.withColumn(text_col, F.when(F.length(text_col) > 0, mask(F.col(text_col))).otherwise(F.col(text_col)))
