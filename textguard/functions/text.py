"""Column expressions over texts. All are built-in functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: White space, spelt out so that every engine agrees.
WS = r"[ \t\n\r\f\x0B]"
NOT_WS = r"[^ \t\n\r\f\x0B]"

LEET_FROM, LEET_TO = "013457@$!", "oieastasi"
ROT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT_TO = ROT_FROM[13:26] + ROT_FROM[:13] + ROT_FROM[39:] + ROT_FROM[26:39]

#: Relative frequency (percent) of a-z in English prose.
ENGLISH = (8.167, 1.492, 2.782, 4.253, 12.702, 2.228, 2.015, 6.094, 6.966, 0.153, 0.772, 4.025, 2.406, 6.749, 7.507, 1.929, 0.095, 5.987, 6.327, 9.056, 2.758, 0.978, 2.360, 0.150, 1.974, 0.074)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(c: Column) -> Column:
    """A column that is computed once a row, however often later steps name it: the optimizer writes an expression over an
    Arrow function again wherever it is named, but merges no generator. One to a select."""
    return F.explode(F.array(c))


def text(c: str | Column) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def occurrences(c: Column, s: str) -> Column:
    """How often a single character occurs."""
    return (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))).cast("long")


def words(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


_GAPS = bytes.maketrans(b"\t\n\r\f\x0B", b"     ")


def words_of(t: str) -> list[bytes]:
    """As `words`, in UTF-8."""
    return [w for w in t.encode().translate(_GAPS).split(b" ") if w]


def letters(c: Column) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(c, r"\P{L}+", "")).cast("long")


def thrice(c: Column, one: str) -> Column:
    """Whether three characters of a class are in a text; the search ends with the third."""
    other = f"[^{one[1:-1]}]*+"
    return c.rlike(one + other + one + other + one)


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, F.round(a / b, digits)).otherwise(F.lit(0.0))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def entropy_of(t: str) -> float:
    n = len(t)
    return sum(-k / n * math.log2(k / n) for k in Counter(t).values()) if n else 0.0


def _entropies(texts: pa.Array) -> pa.Array:
    return pa.array([entropy_of(t or "") for t in texts.to_pylist()], pa.float64())


def entropy(c: Column) -> Column:
    """Shannon entropy (bits) of the characters; one pass over a text in an Arrow batch."""
    return F.arrow_udf(_entropies, DoubleType())(c)


def kl_of(t: str) -> float:
    """Divergence of the letters a-z of a lower-case text from English, 0 for fewer than five letters."""
    c = Counter(t)
    counts = [c[x] for x in "abcdefghijklmnopqrstuvwxyz"]
    n, share = sum(counts), sum(ENGLISH)
    if n < 5:
        return 0.0
    return max(0.0, sum((k + 0.5) / (n + 13) * math.log2((k + 0.5) / (n + 13) / (f / share)) for k, f in zip(counts, ENGLISH)))


def _divergences(texts: pa.Array) -> pa.Array:
    return pa.array([kl_of(t or "") for t in texts.to_pylist()], pa.float64())


def kl_english(c: Column) -> Column:
    """Kullback-Leibler divergence of the letters a-z from English, with half a count added to each letter; one pass over
    a text in an Arrow batch."""
    return F.arrow_udf(_divergences, DoubleType())(F.lower(c))


def casing_transitions(c: Column) -> Column:
    """Changes between upper and lower case along the letters."""
    letters = F.regexp_replace(c, r"\P{L}+", "")
    return count(letters, r"\p{Lu}(?=\P{Lu})") + count(letters, r"\p{Lu}(?<=\P{Lu}\p{Lu})")


def rot13(c: Column) -> Column:
    return F.translate(c, ROT_FROM, ROT_TO)


def unleet(c: Column) -> Column:
    return F.translate(c, LEET_FROM, LEET_TO)


def reverse_words(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.reverse(w)), " ")


def b64(c: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[\r\n]", "")


def hexed(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c, "UTF-8")))


def utf8(binary: Column) -> Column:
    """A text of bytes in which invalid ones are replaced."""
    return F.call_function("make_valid_utf8", binary.cast("string"))


def strict_utf8(binary: Column) -> Column:
    """The text, or null if the bytes aren't UTF-8."""
    s = binary.cast("string")
    return F.when(F.call_function("is_valid_utf8", s), s)


def from_base64(c: Column) -> Column:
    """The bytes, or null if the text isn't base64."""
    return F.call_function("try_to_binary", c, F.lit("base64"))


def from_hex(c: Column) -> Column:
    return F.when(c.rlike(r"^(?:[0-9a-fA-F]{2})+\z"), F.unhex(c))


def from_percent(c: Column) -> Column:
    """Percent escapes and + resolved; a % that starts no escape stays. Null if the bytes aren't UTF-8."""
    fixed = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    broken = F.lit("\ufffd")
    return let(F.try_url_decode(fixed), lambda d: F.when(~F.contains(d, broken) | F.contains(c, broken), d))


def redact(c: Column) -> Column:
    """At most the first four characters."""
    keep = F.when(F.length(c) <= 3, 1).when(F.length(c) <= 7, 2).otherwise(4)
    return F.concat(F.substr(c, F.lit(1), keep), F.lit("***"))


def ngrams(ws: Column, n: int) -> Column:
    """Word n-grams of an array of words, empty if there are fewer words."""

    def of(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(ws, of)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


LN2 = math.log(2)
