"""Decoders of obfuscated payloads. Each gives the decoded text, or null where the text isn't so encoded."""

from __future__ import annotations

import base64
import binascii
import re
import string
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textguard.functions import text as T

KEYWORDS = r"(?:ignore|disregard|override|bypass|reveal|instructions?|system|prompt|secret|password|jailbreak|unrestricted)"
LEET_SYMBOL = r"[013457@$!]"
MORSE = dict(zip(".- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. ----- .---- ..--- ...-- ....- ..... -.... --... ---.. ----.".split(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", strict=True))
DEPTH = 4


def keyword_kinds(c: Column) -> Column:
    """How many different attack words a text holds."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(KEYWORDS), F.lit(0)))).cast("long")


def base64_text(c: Column) -> Column:
    """At least 16 base64 characters and nothing else but white space; the bytes must be UTF-8."""

    def of(s: Column) -> Column:
        return F.when((F.length(s) >= 16) & (F.length(s) % 4 == 0) & s.rlike(r"^[A-Za-z0-9+/]+={0,2}\z"), T.strict_utf8(T.from_base64(s)))

    return T.let(F.regexp_replace(c, T.WS + "+", ""), of)


def hex_text(c: Column) -> Column:
    """At least 8 hexadecimal digits, an even number, and nothing else but white space; the bytes must be UTF-8."""
    return T.let(F.regexp_replace(c, T.WS + "+", ""), lambda s: F.when(F.length(s) >= 8, T.strict_utf8(T.from_hex(s))))


def percent_text(c: Column) -> Column:
    return F.when(c.rlike("%[0-9A-Fa-f]{2}"), T.let(T.from_percent(c), lambda d: F.when(d != c, d)))


def _telling(c: Column, decoded: Column) -> Column:
    """The decoded text if it tells two attack words that the text itself doesn't."""
    return F.when(F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 10, T.let(decoded, lambda d: F.when((keyword_kinds(d) >= 2) & (keyword_kinds(c) < 2), d)))


def rot13_text(c: Column) -> Column:
    return _telling(c, T.rot13(c))


def reversed_text(c: Column) -> Column:
    return _telling(c, F.reverse(c))


def leet_text(c: Column) -> Column:
    """Symbols that stand for letters make up at least a tenth of the characters that aren't blank."""
    n = F.length(F.regexp_replace(c, T.WS, ""))
    return F.when((n >= 10) & (F.regexp_count(c, F.lit(LEET_SYMBOL)) >= 0.1 * n), _telling(c, T.unleet(c)))


def morse_text(c: Column) -> Column:
    """Texts of dots, dashes, blanks and slashes alone; words are apart by ` / ` or three blanks, unknown codes drop."""
    table = F.create_map(*[F.lit(x) for kv in MORSE.items() for x in kv])
    words = F.split(c, " / |   ")
    read = F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, " "), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(""))), "")), " ")
    return F.when((F.length(F.regexp_replace(c, "[^.-]", "")) >= 10) & c.rlike(r"^[./ -]+\z"), read)


def binary_text(c: Column) -> Column:
    """At least five groups of 7 or 8 binary digits and nothing else."""
    groups = F.split(c, "[ ,|\n]+")
    return F.when(c.rlike(r"^(?:[01]{7,8}[ ,|\n]+){4,}[01]{7,8}\z"), F.array_join(F.transform(groups, lambda g: F.chr(F.conv(g, 2, 10).cast("long"))), ""))


DECODERS = {"base64": base64_text, "hex": hex_text, "url": percent_text, "rot13": rot13_text, "reversed": reversed_text, "leet": leet_text}


def peel(c: Column) -> Column:
    """struct(enc, text) of the first decoder that applies, null if none does."""

    def of(t: Column) -> Column:
        return F.coalesce(*[T.let(f(t), named(k)) for k, f in DECODERS.items()])

    def named(k: str):
        return lambda d: F.when(d.isNotNull() & (d != ""), F.struct(F.lit(k).alias("enc"), d.alias("text")))

    return T.let(c, of)


LABEL = r"(?i)(?:rot[ -]?13|caesar)[ ]*[:=][ ]*"
DOTS, STROKES = "·•․∙", "–—−‐‑"
MODE = r"(?i)(?:chmod|mode|permissions?)[ ]*[:=]?[ ]*[0-7]{3,4}"


def labelled_rot13(c: Column) -> Column:
    """The rest of a text after a label that names the cipher, decoded; else as `rot13_text`."""
    rest = F.regexp_extract(c, "(?s)" + LABEL + "(.+)", 1)
    return F.coalesce(F.when(rest != "", T.rot13(rest)), rot13_text(c))


def reversed_words_text(c: Column) -> Column:
    return _telling(c, T.reverse_words(c))


def morse_plain(c: Column) -> Column:
    """Look-alike dots and dashes as . and -, without a label before them."""
    return F.regexp_replace(F.translate(c, DOTS + STROKES, "." * len(DOTS) + "-" * len(STROKES)), "(?i)^[^a-z]*morse(?: code)?[ ]*[:=][ ]*", "")


def morse_density(c: Column) -> Column:
    """Share of Morse signs among the characters that aren't blank."""
    n = F.length(F.regexp_replace(c, T.WS, ""))
    return F.when(n > 0, F.length(F.regexp_replace(c, "[^./|-]", "")) / n).otherwise(0.0)


def morse(c: Column) -> Column:
    """struct(text, confidence) of a text of Morse signs, labelled or at least 0.8 of the signs; null for rules, addresses,
    dots and for fewer than three letters."""
    table = F.create_map(*[F.lit(x) for kv in MORSE.items() for x in kv])
    label = c.rlike("(?i)^[^a-z]*morse(?: code)?[ ]*[:=]")

    def of(s: Column) -> Column:
        lines = F.array_join(F.filter(F.split(s, "\n"), lambda x: ~x.rlike(r"^[ ]*(?:[-=_]{3,}|\.{3,}|[0-9]+(?:\.[0-9]+){3})[ ]*$")), " / ")
        codes = F.split(lines, r" */ *|   +")
        read = F.array_join(F.transform(codes, lambda w: F.array_join(F.transform(F.split(F.trim(w), "[ |]+"), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(""))), "")), " ")
        asked = F.size(F.filter(F.split(lines, "[ |/]+"), lambda x: x != ""))
        known = F.length(F.replace(read, F.lit(" "), F.lit("")))
        density = morse_density(s)
        sure = F.when(label, F.greatest(F.lit(0.85), density)).otherwise(density) * known / asked
        enough = (label | (density >= 0.8)) & (F.length(F.regexp_replace(s, T.WS, "")) >= 10) & (known >= 3)
        return F.when(enough, F.struct(F.trim(read).alias("text"), F.round(sure, 4).alias("confidence")))

    return T.let(morse_plain(c), of)


def _numbers(c: Column, digits: str, base: int, low: int, high: int) -> Column:
    """The text of groups of digits that are characters' numbers, null if a group isn't one."""
    groups = F.filter(F.split(F.regexp_replace(c, "(?i)^[^0-9]*(?:ascii|decimal|octal|numbers?)[ ]*[:=][ ]*", ""), r"[ ,;|\n\t]+"), lambda g: g != "")
    return T.let(groups, lambda g: F.when((F.size(g) >= 5) & F.forall(g, lambda x: x.rlike(f"^{digits}$") & F.conv(x, base, 10).cast("int").between(low, high)), F.array_join(F.transform(g, lambda x: F.chr(F.conv(x, base, 10).cast("long"))), "")))


def numeric(c: Column) -> Column:
    """struct(kind, text): binary groups first, else octal or decimal ones, whichever reads with more letters, octal on a
    tie. Texts that are mostly letters, file modes, addresses and versions aren't numbers."""
    off = (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) > 0.5 * F.length(c)) | c.rlike(MODE) | c.rlike(r"[0-9]+\.[0-9]+\.[0-9]+")
    letters = lambda t: F.length(F.regexp_replace(t, "[^A-Za-z ]", "")) / F.length(t)

    def of(s: Column) -> Column:
        octal, decimal = s.o, s.d
        better = F.coalesce(letters(octal) >= letters(decimal), octal.isNotNull())
        kind = F.when(s.b.isNotNull(), "binary").when(octal.isNotNull() & better, "octal").when(decimal.isNotNull(), "decimal")
        text = F.coalesce(s.b, F.when(better, octal), decimal)
        return F.when(kind.isNotNull() & (F.length(F.regexp_replace(text, r"[^\x20-\x7E]", "")) >= 0.7 * F.length(text)), F.struct(kind.alias("kind"), text.alias("text")))

    each = F.struct(binary_text(c).alias("b"), _numbers(c, "[0-7]{2,3}", 8, 9, 126).alias("o"), _numbers(c, "[0-9]{2,3}", 10, 9, 126).alias("d"))
    return F.when(~off, T.let(each, of))


#: Decodes of a text that a scan follows, and how long a layer may be by the original's length.
BUDGET, GROWTH = 8, 10

_GAP = re.compile(r"[ \t\n\r\f\x0B]+")
_KEYWORDS = re.compile(KEYWORDS)
_BLOCK_64, _BLOCK_HEX = re.compile(b"[A-Za-z0-9+/]{20,}={0,2}"), re.compile(b"[0-9a-fA-F]{16,}")
_ESCAPE, _LABEL = re.compile("%[0-9A-Fa-f]{2}"), re.compile("(?s)" + LABEL + "(.+)")
_MORSE_LABEL, _NUMBER_LABEL = re.compile("(?i)[^a-z]*morse(?: code)?[ ]*[:=][ ]*"), re.compile("(?i)[^0-9]*(?:ascii|decimal|octal|numbers?)[ ]*[:=][ ]*")
_ROT, _LEET = bytes.maketrans(T.ROT_FROM.encode(), T.ROT_TO.encode()), bytes.maketrans(T.LEET_FROM.encode(), T.LEET_TO.encode())
#: Sets of characters as bytes: what a set leaves of a text's bytes is counted, as that needs no step for each character.
_BLANKS, _PRINTABLE, _LETTERS, _DIGITS = b" \t\n\r\f\x0B", bytes([9, 10, 13, *range(32, 127)]), string.ascii_letters.encode(), string.digits.encode()
_DIGITS_64, _DIGITS_16, _SYMBOLS, _SIGNS, _GROUPS = _LETTERS + _DIGITS + b"+/", string.hexdigits.encode(), LEET_SYMBOL.strip("[]").encode(), b"./|-", _DIGITS + b" ,;|\n\t"
#: What every match of KEYWORDS holds one of, as it stands, in ROT13 and backwards.
_WORDS = [w.encode() for w in re.sub(r"^\(\?:|s\?|\)$", "", KEYWORDS).split("|")]
_WORDS_ROT, _WORDS_BACK = [w.translate(_ROT) for w in _WORDS], [w[::-1] for w in _WORDS]
#: Letters that lower case or a search without case turns into ASCII ones; texts that hold one are searched as they are.
_ODD = "\u0130\u0131\u017f\u212a"


def _utf8(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def _from_base64(s: bytes) -> str | None:
    bare = s.rstrip(b"=")
    try:
        return _utf8(base64.b64decode(bare + b"=" * (-len(bare) % 4), validate=True))
    except (binascii.Error, ValueError):
        return None


def _readable(t: str | None) -> bool:
    n = _count(t.encode(), _PRINTABLE) if t else 0
    return n >= 3 and n > len(t or "") * 0.7


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def _run(data: bytes, of: bytes) -> int:
    """Length of the longest run of some bytes."""
    other = np.ones(256, bool)
    other[list(of)] = False
    ends = np.flatnonzero(other[np.frombuffer(data, np.uint8)])
    return int(np.diff(ends, prepend=-1, append=len(data)).max()) - 1


def _kinds(t: str) -> int:
    """How many different attack words a text holds. One that stands alone can't be hidden by another that it overlaps."""
    if not t.isascii() and any(x in t for x in _ODD):
        return len(set(_KEYWORDS.findall(t.lower())))
    low = t.encode().lower()
    here = sum(w in low for w in _WORDS)
    return here if here < 2 and b"instruction" not in low else len(set(_KEYWORDS.findall(t.lower())))


def morse_of(t: str) -> str | None:
    """As `morse`, the text alone."""
    data = t.encode()
    odd = not t.isascii() and any(x in t for x in _ODD)
    solid = len(t) - _count(data, _BLANKS)
    signs = _count(data, _SIGNS) + (0 if t.isascii() else sum(t.count(x) for x in DOTS + STROKES))
    if not odd and (solid < 10 or signs < 0.8 * solid) and b"morse" not in data.lower():
        return None
    s = t.translate(str.maketrans(DOTS + STROKES, "." * len(DOTS) + "-" * len(STROKES)))
    label = _MORSE_LABEL.match(s)
    bare = s[label.end() :] if label else s
    if len(_GAP.sub("", bare)) < 10 or (bare == s and signs < 0.8 * solid):
        return None
    kept = " / ".join(x for x in bare.split("\n") if not re.match(r"[ ]*(?:[-=_]{3,}|\.{3,}|[0-9]+(?:\.[0-9]+){3})[ ]*\Z", x))
    words = ["".join(MORSE.get(x, "") for x in re.split("[ |]+", w.strip())) for w in re.split(r" */ *|   +", kept)]
    return " ".join(words).strip() if sum(map(len, words)) >= 3 else None


def numeric_of(t: str) -> tuple[str, str] | None:
    """As `numeric`: (kind, text)."""
    data = t.encode()
    if _count(data, _LETTERS) > 0.5 * len(t):
        return None
    if _count(data, _GROUPS) < len(data):  # other characters can only stand in a label
        low = data.lower()
        if not (not t.isascii() and any(x in t for x in _ODD) or any(w in low for w in (b"ascii", b"decimal", b"octal", b"number"))) or not _NUMBER_LABEL.match(t):
            return None
    if re.search(MODE, t) or re.search(r"[0-9]\.[0-9]+\.[0-9]", t):
        return None
    found: dict[str, str] = {}
    if re.match(r"(?:[01]{7,8}[ ,|\n]+){4,}[01]{7,8}\Z", t):
        found["binary"] = "".join(chr(int(g, 2)) for g in re.split("[ ,|\n]+", t))
    groups = [g for g in re.split(r"[ ,;|\n\t]+", _NUMBER_LABEL.sub("", t, 1) if _NUMBER_LABEL.match(t) else t) if g]
    for kind, digits, base in (("octal", "[0-7]{2,3}", 8), ("decimal", "[0-9]{2,3}", 10)):
        if len(groups) >= 5 and all(re.fullmatch(digits, g) and 9 <= int(g, base) <= 126 for g in groups):
            found[kind] = "".join(chr(int(g, base)) for g in groups)
    share = {k: sum(x.isascii() and (x.isalpha() or x == " ") for x in v) / len(v) for k, v in found.items()}
    kind = "binary" if "binary" in found else max(sorted(found, reverse=True), key=lambda k: share[k], default=None)
    if kind is None or sum(" " <= x <= "~" for x in found[kind]) < 0.7 * len(found[kind]):
        return None
    return kind, found[kind]


def pairs_of(t: str) -> list[tuple[str, str]]:
    """(encoding, text) of all that one layer of a text decodes to, in the order of the decoders. Blocks inside a text
    count where the whole isn't encoded."""
    out: list[tuple[str, str | None]] = []
    data = t.encode()
    odd, low, bare = not t.isascii() and any(x in t for x in _ODD), data.lower(), data.translate(None, _BLANKS)
    run, body = _run(data, _DIGITS_64), bare.rstrip(b"=")
    whole = _from_base64(bare) if len(bare) >= 16 and len(bare) % 4 == 0 and body and len(bare) - len(body) <= 2 and not body.translate(None, _DIGITS_64) else None
    out += [("base64", whole)] if whole else [("base64", x) for x in map(_from_base64, _BLOCK_64.findall(data) if run >= 20 else ()) if _readable(x)]
    whole = _utf8(bytes.fromhex(bare.decode())) if len(bare) >= 8 and len(bare) % 2 == 0 and not bare.translate(None, _DIGITS_16) else None
    blocks = _BLOCK_HEX.findall(data) if not whole and run >= 16 and _run(data, _DIGITS_16) >= 16 else ()
    out += [("hex", whole)] if whole else [("hex", x) for x in (_utf8(bytes.fromhex(b.decode())) for b in blocks if len(b) % 2 == 0) if _readable(x)]
    if "%" in t and _ESCAPE.search(t):
        decoded = _utf8(unquote_to_bytes(t.replace("+", " ")))
        out.append(("url_encoded", decoded if decoded != t else None))
    label = _LABEL.search(t) if odd or any(w in low for w in (b"caesar", b"rot13", b"rot 13", b"rot-13")) else None
    if label:
        out.append(("rot13", label[1].encode().translate(_ROT).decode()))
    if _count(data, _LETTERS) >= 10 and _kinds(t) < 2:
        turned = odd or any(w in low for w in _WORDS_BACK)
        if not label and (odd or any(w in low for w in _WORDS_ROT)):
            out.append(("rot13", r if _kinds(r := data.translate(_ROT).decode()) >= 2 else None))
        if turned:
            out.append(("full_reverse", r if _kinds(r := t[::-1]) >= 2 else None))
            out.append(("word_reverse", r if _kinds(r := " ".join(w[::-1] for w in t.split(" "))) >= 2 else None))
        solid = len(t) - (len(data) - len(bare))
        if solid >= 10 and _count(data, _SYMBOLS) >= 0.1 * solid:
            out.append(("leetspeak", r if _kinds(r := data.translate(_LEET).decode()) >= 2 else None))
    out.append(("morse", morse_of(t)))
    if number := numeric_of(t):
        out.append(number)
    return [(e, x) for e, x in out if x]


def tree_of(t: str, depth: int = DEPTH, budget: int = BUDGET) -> list[tuple[str, str]]:
    """(encodings from the outermost, text) of the decoded views of a text, depth first, at most `budget`.

    Each view's own layers are followed to `depth`. A text that was followed before isn't again; a layer of fewer than
    two characters, or of more than GROWTH times the original's length, drops.
    """
    found: list[tuple[str, str]] = []
    seen: set[str] = set()

    def follow(text: str, above: str, left: int) -> None:
        if not left or text in seen or len(found) >= budget:
            return
        seen.add(text)
        for enc, inner in pairs_of(text):
            if len(found) >= budget:
                return
            if len(inner) <= GROWTH * max(len(t), 1) and len(inner.strip(" ")) >= 2:
                found.append((above + enc, inner))
                follow(inner, above + enc + ",", left - 1)

    follow(t, "", depth)
    return found


def peel_of(t: str) -> tuple[str, str] | None:
    """As `peel`: (encoding, text)."""
    data = t.encode()
    bare = data.translate(None, _BLANKS)
    body = bare.rstrip(b"=")
    if len(bare) >= 16 and len(bare) % 4 == 0 and body and len(bare) - len(body) <= 2 and not body.translate(None, _DIGITS_64) and (d := _from_base64(bare)):
        return "base64", d
    if len(bare) >= 8 and len(bare) % 2 == 0 and not bare.translate(None, _DIGITS_16) and (d := _utf8(bytes.fromhex(bare.decode()))):
        return "hex", d
    if "%" in t and _ESCAPE.search(t):
        raw = unquote_to_bytes(t.replace("+", " "))
        d = raw.decode(errors="replace") if "\ufffd" in t else _utf8(raw)
        if d and d != t:
            return "url", d
    if _count(data, _LETTERS) >= 10 and _kinds(t) < 2:
        if _kinds(d := data.translate(_ROT).decode()) >= 2:
            return "rot13", d
        if _kinds(d := t[::-1]) >= 2:
            return "reversed", d
        solid = len(t) - (len(data) - len(bare))
        if solid >= 10 and _count(data, _SYMBOLS) >= 0.1 * solid and _kinds(d := data.translate(_LEET).decode()) >= 2:
            return "leet", d
    return None


def unwrap_of(t: str, depth: int = DEPTH) -> tuple[list[str], str]:
    """As `unwrap`: (chain, text)."""
    chain, seen = [], [t]
    while len(chain) < depth and (p := peel_of(seen[-1])) and p[1] not in seen and len(p[1]) <= 10 * len(t):
        chain.append(p[0])
        seen.append(p[1])
    return chain, seen[-1]


def unwrap(c: Column, depth: int = DEPTH) -> Column:
    """struct(chain ARRAY<STRING>, text): the encodings that are peeled off one after another, at most `depth`, and
    the innermost text. A layer that gives a text of the chain again, or more than ten times the original, ends it."""
    @F.arrow_udf(Ty.StructType().add("chain", Ty.ArrayType(Ty.StringType())).add("text", Ty.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        rows = [unwrap_of(t, depth) if t is not None else ([], None) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in rows], pa.list_(pa.string())), pa.array([x for _, x in rows], pa.string())], names=["chain", "text"])

    return run(c)


def _trees(texts: pa.Array) -> pa.Array:
    return pa.array([[{"enc": e, "text": x} for e, x in tree_of(t)] if t else [] for t in texts.to_pylist()], pa.list_(pa.struct([("enc", pa.string()), ("text", pa.string())])))


_TREE = Ty.ArrayType(Ty.StructType().add("enc", Ty.StringType()).add("text", Ty.StringType()))


def tree(c: Column) -> Column:
    """ARRAY<STRUCT<enc, text>> of `tree_of`. The search branches, so it runs in an Arrow batch and not as an expression."""
    return F.arrow_udf(_trees, _TREE)(c)


def layer_flags(c: Column, views: Column) -> Column:
    """Flags of a text: what its characters show, and the encodings of its `tree`."""
    from textguard.operators import signals as S

    own = F.array(F.when(S.high_entropy(c), F.lit("high_entropy")), F.when(S.punctuation_flood(c), F.lit("punctuation_flood")), F.when(S.weird_casing(c), F.lit("weird_casing")))
    last = F.transform(views, lambda n: F.element_at(F.split(n.enc, ","), -1))
    return F.concat(F.array_compact(own), F.array_distinct(F.transform(last, lambda e: F.when(e.isin("full_reverse", "word_reverse"), "reversed_text").otherwise(e))))
