"""Extraction: personal data, indicators, secrets and encoded blocks as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import text as T

#: Patterns with the characters next to a match as part of it, in place of lookarounds: the borders are cut off after.
EDGE = r"(?:^|[^A-Za-z0-9_])"
#: The same in Java's short form, which it searches ten times as fast.
BORDER = r"(?:^|\W)"
CARD = r"(?:4[0-9]{3}|5[1-5][0-9]{2}|2[2-7][0-9]{2}|6011|65[0-9]{2})[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,200}\.[A-Za-z]{2,20}"
PHONE = r"(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}"
AWS = r"AKIA[0-9A-Z]{16}"
GITHUB = r"gh[ps]_[A-Za-z0-9_]{36,255}"
HEX = r"[0-9a-fA-F]{40,}"
BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
PRIVATE = r"^(?:0\.0\.0\.0|127\..*|10\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|192\.168\..*|169\.254\..*)$"

DEFANGED = (
    (r"\[:\]|\(:\)", ":"), (r"\[//?\]|\[/\]/", "/"), (r"(?i)hxxp", "http"), (r"\[\.\]|\(\.\)|\{\.\}|(?i:\[dot\]|\(dot\))", "."), (r" (?:DOT|dot) ", "."), (r"\[@\]|(?i:\[at\]|\(at\))", "@"), (r" AT ", "@"),
)

SECRETS = (
    AWS, r"sk-[a-zA-Z0-9]{20,}", r"ghp_[a-zA-Z0-9]{36,}", r"xox[bp]-[a-zA-Z0-9-]+", r"(?i)(?:password|passwd|secret|token|api[_-]?key)[ ]*[:=][ ]*[^ \t\n\r]+", r"(?i)bearer [a-zA-Z0-9._~+/=-]{8,}",
    r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}", r"/etc/passwd",
)


def found(c: Column, pattern: str) -> Column:
    """Matches between non-word characters."""
    got = F.regexp_extract_all(c, F.lit(BORDER + "(" + pattern + ")"), F.lit(1))
    return got


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def kinds_of_chars(c: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))


def cards(c: Column) -> Column:
    return F.filter(found(c, CARD), lambda m: F.call_function("luhn_check", digits(m)))


def ssns(c: Column) -> Column:
    return F.filter(found(c, SSN), lambda m: ~m.rlike("^(?:000|666|9)") & ~m.contains("-00-") & ~m.endswith("-0000"))


def phones(c: Column) -> Column:
    got = F.regexp_extract_all(c, F.lit(r"(?:^|[^0-9])(" + PHONE + r")(?:[^0-9]|$)"), F.lit(1))
    return got


def hexes(c: Column) -> Column:
    return F.filter(found(c, HEX), lambda m: kinds_of_chars(F.lower(m)) >= 6)


def blobs(c: Column) -> Column:
    return F.filter(found(c, BASE64), lambda m: (kinds_of_chars(m) >= 10) & m.rlike("[0-9+=]"))


def addresses(c: Column) -> Column:
    legal = lambda m: ~F.exists(F.split(m, r"\."), lambda p: p.cast("int") > 255)
    return F.filter(found(c, IPV4), lambda m: legal(m) & ~m.rlike(PRIVATE))


def pii(c: Column) -> dict[str, Column]:
    """Arrays of matches by type."""
    return {"credit_card": cards(c), "ssn": ssns(c), "email": found(c, MAIL), "phone": phones(c), "aws_key": found(c, AWS), "github_token": found(c, GITHUB), "generic_hex": hexes(c), "generic_base64": blobs(c), "ipv4": addresses(c)}


def redacted(matches: Column) -> Column:
    return F.transform(matches, T.redact)


def refang(c: Column) -> Column:
    """Defanged indicators made whole."""
    for pattern, to in DEFANGED:
        c = F.regexp_replace(c, pattern, to)
    return c


def iocs(c: Column) -> dict[str, Column]:
    """Indicators by type, in a refanged text."""
    return iocs_of(refang(c))


def iocs_of(r: Column) -> dict[str, Column]:
    """Indicators by type, of a text that is refanged already."""
    many = lambda n: lambda m: kinds_of_chars(F.lower(m)) >= n
    exact = lambda n: F.regexp_extract_all(r, F.lit(BORDER + f"([0-9a-fA-F]{{{n}}})(?:\\W|$)"), F.lit(1))
    return {
        "url": F.regexp_extract_all(r, F.lit(r"https?://[^ \t\n\r\"'<>)\]]+"), F.lit(0)),
        "ip": addresses(r),
        "email": found(r, MAIL),
        "sha256": F.filter(exact(64), many(8)),
        "sha1": F.filter(exact(40), many(7)),
        "md5": F.filter(exact(32), many(6)),
    }


def secret_count(c: Column) -> Column:
    return sum((T.count(c, p) for p in SECRETS), F.lit(0).cast("long"))


def embedded_base64(c: Column) -> Column:
    """Texts that blocks of 20 or more base64 characters decode to, if they are UTF-8 and mostly printable."""
    blocks = F.regexp_extract_all(c, F.lit("[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))
    padded = F.transform(blocks, lambda b: F.rpad(F.regexp_replace(b, "=+$", ""), (F.ceil(F.length(F.regexp_replace(b, "=+$", "")) / 4) * 4).cast("int"), "="))
    return _readable(F.transform(padded, lambda b: T.strict_utf8(T.from_base64(b))))


def embedded_hex(c: Column) -> Column:
    """The same for even runs of 16 or more hexadecimal digits."""
    blocks = F.filter(F.regexp_extract_all(c, F.lit("[0-9a-fA-F]{16,}"), F.lit(0)), lambda b: F.length(b) % 2 == 0)
    return _readable(F.transform(blocks, lambda b: T.strict_utf8(F.unhex(b))))


def _readable(texts: Column) -> Column:
    printable = lambda t: F.length(F.regexp_replace(t, r"[^\x20-\x7E\n\r\t]", ""))
    return F.filter(texts, lambda t: t.isNotNull() & (printable(t) >= 3) & (printable(t) > F.length(t) * 0.7))
