"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds are email, ip, card (Luhn) and phone. The method adds iban (mod-97), ssn,
national phone numbers (phone_local), ipv6 (which must parse), mac, coin (addresses with a
double SHA-256 checksum) and secret: keys of known form, private key blocks, and values that
a name such as token or password is set to, if their characters are as varied as a random
value's. Every span has a score: a kind's prior, raised by a passed validator, raised or
lowered by words within ``reach`` characters. Base spans stay whatever their score; added
ones need ``threshold`` and overlap nothing found before.

Matching is linear in the text: an address is looked for around each '@' only, digit runs
use possessive quantifiers, found places are marked in a mask, so neither long runs nor
texts full of numbers cost more.

Defined cases: null and empty texts have no spans; positions are code points, end
exclusive; repeated rows are reported each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "phone_local", "ipv6", "mac", "coin", "secret")
#: Least bits a character of a value that a secret's name is set to.
LEAST_ENTROPY = 2.8

_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:])")
_MAC = re.compile(r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])")
_COIN = re.compile(r"(?<![0-9A-Za-z])[13][1-9A-HJ-NP-Za-km-z]{25,34}(?![0-9A-Za-z])")
_KEYS = re.compile(
    r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|xox[abprs]-[0-9A-Za-z-]{10,250}|sk_live_[0-9A-Za-z]{16,250}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,2000}\.eyJ[0-9A-Za-z_-]{10,4000}\.[0-9A-Za-z_-]{10,1000})(?![0-9A-Za-z])"
)
_BLOCK_START, _BLOCK_END = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"), re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_SET = re.compile(
    r"(?<![A-Za-z0-9])(?:api[_ -]?key|apikey|access[_ -]?key|secret[_ -]?key|private[_ -]?key|client[_ -]?secret|secret|auth[_ -]?token|access[_ -]?token|token|password|passwd|pwd|passphrase)[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}[\"']?([0-9A-Za-z+/_.~=-]{12,512})(?![0-9A-Za-z])",
    re.I,
)
#: What a text must hold for a kind to occur in it: looked for first, since most texts lack most of it.
_DIGIT = re.compile(r"[0-9]")
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza", "eyJ")
_SECRET_NAMES = re.compile(r"key|secret|token|passw|passphrase|pwd", re.I)
_WORD = re.compile(r"[a-z]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.4, "phone_local": 0.3, "ipv6": 0.4, "mac": 0.6, "coin": 0.3, "secret": 0.4}
CHECKSUM_GAIN = {"card": 0.3, "iban": 0.5, "ipv6": 0.3, "coin": 0.5, "secret": 0.4}
FOR_IT = {
    "email": {"mail", "email", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "login"},
    "card": {"card", "visa", "credit", "debit", "payment", "mastercard", "amex"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "dial"},
    "iban": {"iban", "bank", "account", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "phone_local": {"phone", "call", "tel", "telephone", "mobile", "fax", "dial"},
    "ipv6": {"ip", "host", "server", "address", "login"},
    "mac": {"mac", "device", "address", "wifi", "ethernet"},
    "coin": {"wallet", "bitcoin", "btc", "address", "pay"},
    "secret": {"key", "token", "secret", "password", "auth", "credential", "credentials"},
}
AGAINST_IT = {"version", "release", "isbn", "order", "build", "serial", "example", "invoice", "test"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and not _LOCAL_END.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def coin(text: str) -> bool:
    n = 0
    for c in text:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes(max(25, -(-n.bit_length() // 8)))
    return len(raw) == 25 and hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def varied(value: str) -> bool:
    """Whether a value's characters are as varied as a random one's, and not letters alone."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= LEAST_ENTROPY and any("0" <= c <= "9" for c in value) and any(c.isalpha() for c in value)


def _ipv6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(map(bool, text.split(":"))) > 2


def _digits(s: str) -> str:
    return _NOT_DIGITS.sub("", s)


def _small(part: str) -> bool:
    s = part.lstrip("0")
    return len(s) < 4 and int(s or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's base spans, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _added(text: str) -> list[tuple[str, int, int]]:
    out = []
    digits = _DIGIT.search(text) is not None
    for m in _IBAN.finditer(text) if digits else ():
        # groups of upper-case words may follow the number: the longest prefix that passes counts
        end = m.end()
        while end - m.start() >= 15 and not mod97(text[m.start() : end]):
            end = text.rfind(" ", m.start(), end)
        if end - m.start() >= 15:
            out.append(("iban", m.start(), end))
    if digits:
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        out += [("phone_local", *m.span()) for m in _LOCAL.finditer(text)]
    if ":" in text:
        out += [("ipv6", *m.span()) for m in _IPV6.finditer(text) if _ipv6(m[0])]
    if text.count(":") >= 5 or text.count("-") >= 5:
        out += [("mac", *m.span()) for m in _MAC.finditer(text)]
    if digits:
        out += [("coin", *m.span()) for m in _COIN.finditer(text) if coin(m[0])]
    secrets = [m.span() for m in _KEYS.finditer(text)] if any(x in text for x in _KEY_STARTS) else []
    if ("=" in text or ":" in text) and _SECRET_NAMES.search(text):
        secrets += [m.span(1) for m in _SET.finditer(text) if varied(m[1])]
    at = 0
    while m := _BLOCK_START.search(text, at):
        end = _BLOCK_END.search(text, m.end())
        at = end.end() if end else m.end()
        secrets.append((m.start(), at))
        if not end:
            secrets += [x.span() for x in _BLOCK_START.finditer(text, at)]
            break
    return out + [("secret", a, b) for a, b in sorted(set(secrets))]


def score(text: str, kind: str, start: int, end: int, reach: int) -> float:
    near = set(_WORD.findall(text[max(0, start - reach) : start].lower())) | set(_WORD.findall(text[end : end + reach].lower()))
    value = PRIOR[kind] + CHECKSUM_GAIN.get(kind, 0) + 0.3 * bool(near & FOR_IT[kind]) - 0.2 * bool(near & AGAINST_IT)
    return round(min(1.0, max(0.0, value)), 3)


def spans_of(text: str | None, reach: int = 40, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """All spans with their scores: base ones, then added ones that overlap none of them."""
    if not text:
        return []
    base = base_spans(text)
    out = [(k, a, b, score(text, k, a, b, reach)) for k, a, b in base]
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    for k, a, b in _added(text):
        if taken.find(1, a, b) < 0 and (s := score(text, k, a, b, reach)) >= threshold:
            out.append((k, a, b, s))
            taken[a:b] = b"\1" * (b - a)
    return out


SPANS = "array<struct<kind:string,start:int,end:int,score:double,text:string>>"


def find_pii(docs: DataFrame, reach: int = 40, threshold: float = 0.6) -> DataFrame:
    """doc_id, spans: kind, start, end, score and text of each."""
    element = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("text"):
                t = text.as_py() or ""
                found.append([{"kind": k, "start": a, "end": b, "score": s, "text": t[a:b]} for k, a, b, s in spans_of(t, reach, threshold)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.list_(element))], ["doc_id", "spans"])

    corpus.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(corpus.trimmed(run), f"doc_id long, spans {SPANS}")


def _digest(found: DataFrame) -> DataFrame:
    place = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(F.array_join(F.transform(base, place), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", place), ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return _digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def base_sha256(text: str | None) -> str:
    """The digest of a text's base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text or "")).encode()).hexdigest()
