"""Signals of obfuscation: entropy votes, punctuation, casing, hidden whitespace, selectors and character pictures."""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textguard.functions import text as T

ENTROPY, KL, PACKED, PACKED_FROM, FENCED = 4.5, 0.8, 1.05, 120, 5.0
PUNCTUATION, TRANSITIONS, CASING = 0.4, 6, 0.12
FENCE = r"(?:^|\n)[ ]*(?:```|~~~)"
TABLE = r"(?:^|\n)[ ]*\|[^\n]*\|[ ]*\n[ ]*\|[ :|-]*-[ :|-]*\|"


def _ratios(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        data = (t or "").encode()
        out.append(len(data) / len(zlib.compress(data, 6)) if data else 0.0)
    return pa.array(out, pa.float64())


def compression_ratio(c: Column) -> Column:
    """Bytes of a text by the bytes of its deflated form; 0 for an empty text."""
    return F.arrow_udf(_ratios, Ty.DoubleType())(c)


def structured(c: Column) -> Column:
    """Whether a text has a fenced block or a table, whose signs say nothing."""
    return c.rlike(FENCE) | c.rlike(TABLE)


def entropy_vote(t: str) -> bool:
    """Two of three: high entropy, letters unlike English, and a longer text that deflate can't shorten. Fenced texts
    need a higher entropy alone; texts below ten characters never vote."""
    if len(t) < 10:
        return False
    e = T.entropy_of(t)
    if re.search(FENCE, t):
        return e >= FENCED
    votes = (e >= ENTROPY) + (T.kl_of(t.lower()) >= KL)
    if votes == 1 and len(t) >= PACKED_FROM:
        data = t.encode()
        votes += len(data) / len(zlib.compress(data, 6)) <= PACKED
    return votes >= 2


def _votes(texts: pa.Array) -> pa.Array:
    return pa.array([entropy_vote(t or "") for t in texts.to_pylist()], pa.bool_())


def high_entropy(c: Column) -> Column:
    return F.arrow_udf(_votes, Ty.BooleanType())(c)


def punctuation_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, T.count(c, r"[^\p{L}\p{N}_ \t\n\r\f\x0B]") / F.length(c)).otherwise(0.0)


def punctuation_flood(c: Column) -> Column:
    return (punctuation_ratio(c) >= PUNCTUATION) & ~structured(c)


def weird_casing(c: Column) -> Column:
    """Many changes of case along the letters, as counted in letters of one alphabet."""
    n, letters = T.casing_transitions(c), T.letters(c)
    return (n >= TRANSITIONS) & (n >= CASING * letters) & ~structured(c)


SELECTOR = "[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]"
_PRINTABLE = [9, 10, 13, *range(32, 127)]
_SELECTORS = "".join(chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in _PRINTABLE)


def selector_payload(c: Column) -> Column:
    """The printable ASCII that variation selectors spell, one byte each; other bytes drop."""
    found = F.array_join(F.regexp_extract_all(c, F.lit(SELECTOR), F.lit(0)), "")
    return F.regexp_replace(F.translate(found, _SELECTORS, "".join(map(chr, _PRINTABLE))), SELECTOR, "")


def strip_selectors(c: Column) -> Column:
    return F.regexp_replace(c, SELECTOR, "")


TRAILING = "(?:[ \t]\r*(?:\n|$))"
LEAST_BYTES, STATISTICAL_BYTES, VOLUME_BYTES, READABLE = 8, 24, 48, 0.6
_SNOW = re.compile(r"\t {0,7}\t(?: {0,7}\t)* {0,7}\t?\Z")
_STEGO = Ty.StructType().add("method", Ty.StringType()).add("confidence", Ty.DoubleType()).add("payload", Ty.StringType())


def _bits_to_text(bits: str) -> str:
    """Bytes of a string of bits, up to the first zero byte."""
    out = []
    for eight in zip(*[iter(bits)] * 8):
        b = int("".join(eight), 2)
        if not b:
            break
        out.append(b)
    return bytes(out).decode("ascii", "replace")


def _snow_text(tails: list[str]) -> str:
    """Each tab ends a run of up to seven spaces, which counts three bits, the lowest first."""
    bits = []
    for tail in tails:
        if tail[:1] == "\t":
            runs = tail[1:].split("\t")
            if runs[-1] == "":
                runs.pop()
            bits += [f"{len(r):03b}"[::-1] for r in runs if len(r) <= 7]
    return _bits_to_text("".join(bits))


def _readable(t: str) -> float:
    return sum(32 <= ord(x) <= 126 or x in "\n\r" for x in t) / len(t) if t else 0.0


def trailing_stego(text: str) -> tuple[str, float, str] | None:
    """(method, confidence, payload) of data hidden in blanks at the ends of lines."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    tails = [x[len(x.rstrip(" \t")) :] for x in lines]
    tails = ["" if t == "  " else t for t in tails]  # a line break of markdown
    joined = "".join(tails)
    tabs, spaces = joined.count("\t"), joined.count(" ")
    if len(joined) < LEAST_BYTES or not tabs or not spaces:
        return None
    share = sum(t != "" for t in tails) / len(lines)
    snow = _snow_text(tails)
    good = len(snow) >= 3 and _readable(snow) >= READABLE
    if sum(bool(_SNOW.match(t)) for t in tails) >= 2 and good:
        return "snow", 0.95, snow
    entropy = -sum(n / len(joined) * math.log2(n / len(joined)) for n in (tabs, spaces))
    if share >= 0.3 and entropy >= 0.5 and len(joined) >= STATISTICAL_BYTES and (good or len(joined) >= VOLUME_BYTES):
        return "statistical", 0.7, snow if good else ""
    plain = _bits_to_text("".join("01"[x == "\t"] for x in joined))
    if plain and _readable(plain) >= READABLE:
        return "binary", 0.6, plain
    return ("anomaly", 0.5, "") if share >= 0.5 else None


def _tails(texts: pa.Array) -> pa.Array:
    found = (trailing_stego(t) if t else None for t in texts.to_pylist())
    return pa.array([None if f is None else dict(zip(("method", "confidence", "payload"), f)) for f in found], pa.struct([("method", pa.string()), ("confidence", pa.float64()), ("payload", pa.string())]))


def whitespace_stego(c: Column) -> Column:
    """struct(method, confidence, payload), null if nothing is hidden. Texts without blanks at a line's end aren't sent
    to Python."""
    return F.when(c.rlike(TRAILING), F.arrow_udf(_tails, _STEGO)(F.when(c.rlike(TRAILING), c).otherwise("")))


ART_LEVEL, ART_LINES = 0.3, 3
_ART, _UPRIGHT = frozenset("|/\\_-+*#.:"), frozenset("|/\\_-*#=+")
_RUN = re.compile(r"(?:[-|/\\_.+*#=]\s{0,3}){3,80}[-|/\\_.+*#=]")
_EDGE = re.compile(r"\+[-=]{2,80}\+")
_BOX, _BRAILLE, _BLOCK = (lambda x: "─" <= x <= "╿"), (lambda x: "⠀" <= x <= "⣿"), (lambda x: "▀" <= x <= "▟")


def _fenced(lines: list[str]) -> set[int]:
    inside, out = False, set()
    for i, x in enumerate(lines):
        mark = x.strip().startswith(("```", "~~~"))
        if mark or inside:
            out.add(i)
        inside ^= mark
    return out


def _art_line(x: str) -> bool:
    solid = [c for c in x if not c.isspace()]
    if len(solid) < 3:
        return False
    share = sum(c in _ART or _BOX(c) or _BRAILLE(c) or _BLOCK(c) for c in solid) / len(solid)
    return share >= 0.5 or bool(_RUN.search(x))


def picture_level(text: str) -> float:
    """How much a text looks like a picture made of characters, 0 to 1: five weighted signals, a bonus for drawing
    characters, and less where a table, prose or code explains them."""
    lines = text.split("\n")
    boxes, dots, bars = (sum(map(f, text)) for f in (_BOX, _BRAILLE, _BLOCK))
    if len(lines) < ART_LINES and not boxes + dots + bars:
        return 0.0
    fenced, blocks, at = _fenced(lines), [], 0
    while at < len(lines):
        end = at
        while end < len(lines) and _art_line(lines[end]):
            end += 1
        if end - at >= ART_LINES and sum(not c.isspace() for x in lines[at:end] for c in x) >= 10:
            blocks.append((at, end))
        at = max(end, at + 1)
    mass = 0.0
    if blocks:
        mass = min(1.0, 1 - math.exp(-0.15 * sum(b - a for a, b in blocks)) + 0.1 * (len(blocks) - 1))
        inside = sum(all(i in fenced for i in range(a, b)) for a, b in blocks)
        mass *= 0.4 if inside == len(blocks) else 0.7 if inside else 1.0
    even = 0.0
    for a, b in blocks:
        sizes = [len(x) for x in lines[a:b]]
        mean = sum(sizes) / len(sizes)
        even = max(even, 1 - 2 * math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)) / mean)
    solid = [c for c in text if not c.isspace()]
    drawn = (boxes + dots + bars) / len(solid) if solid else 0.0
    dense = min(1.0, (sum(c in _ART for c in solid) / len(solid) + drawn) * 1.5 + drawn * 0.5) if solid else 0.0
    full = [x for x in lines if x.strip()]
    columns = []
    if len(full) >= 3:
        for k in range(min(200, max(map(len, full)))):
            best = run = 0
            for x in full:
                run = run + 1 if k < len(x) and x[k] in _UPRIGHT else 0
                best = max(best, run)
            if best >= 2:
                columns.append(best)
    upright = min(1.0, (min(1.0, len(columns) / 5) + min(1.0, (max(columns) - 1) / 4)) / 1.5) if columns else 0.0
    sides = sum(len(s) >= 3 and s[0] == s[-1] == "|" for s in map(str.strip, lines))
    box = min(0.5, 0.15 * len(_EDGE.findall(text))) + min(0.6, 0.05 * boxes) + (min(0.3, 0.08 * sides) if sides >= 2 else 0) + min(0.4, 0.1 * len(re.findall("[─-╿]{2,80}", text)))
    bonus = max(0.3 if dots >= 3 else 0, 0.25 if bars >= 3 else 0, 0.2 if boxes >= 3 else 0)
    shown = "\n".join(x for a, b in blocks for x in lines[a:b]) if blocks else text
    prose = sum(c.isalnum() or c.isspace() for c in shown) / len(shown) if shown else 0.0
    less = (0.15 if re.search(TABLE, text) else 1.0) * (0.2 if prose > 0.85 else 0.5 if prose > 0.75 else 1.0) * (0.5 if len(fenced) > 0.5 * len(lines) else 1.0)
    return max(0.0, min(1.0, round((0.35 * mass + 0.2 * max(0.0, even) + 0.2 * dense + 0.15 * upright + 0.1 * min(1.0, box) + bonus) * less, 4)))


def _pictures(texts: pa.Array) -> pa.Array:
    return pa.array([picture_level(t) if t else 0.0 for t in texts.to_pylist()], pa.float64())


def ascii_art(c: Column) -> Column:
    """The level of `picture_level`; a picture from ART_LEVEL on. Texts without a sign that pictures are made of aren't sent to
    Python."""
    may = c.rlike(r"[|/\\_+*#=─-▟⠀-⣿-]")
    return F.when(may, F.arrow_udf(_pictures, Ty.DoubleType())(F.when(may, c).otherwise(""))).otherwise(0.0)
