"""Intake: row guards, normalisation, content types and the whitelist."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import text as T

MAX_CHARS, MAX_BYTES, MEMORY_MB, MAX_DEPTH, EXPANSION = 50_000, 200_000, 50.0, 100, 10.0

#: Spaces other than the ordinary one.
SPACES = "                 　﻿\x0b\x0c"
FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALFWIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: Letters of other scripts and the Latin letters they look like.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅ" + "αορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "օսհոցյԼՍՕ", "aeopcyxijshdqwABEKMHOPCTXIJS" + "aopvikABEZHIKMNOPTYX" + "ounngjLSO", strict=False))
OTHER_SCRIPT = "[Ͱ-ϿЀ-ӿԀ-֏]"
ANGLES_FROM, ANGLES_TO = "‹›〈〉⟨⟩＜＞《》❮❯", "<><><><><><>"
TAGS_FROM = "".join(chr(0xE0000 + c) for c in range(1, 128))
TAGS_TO = "".join(chr(c) for c in range(1, 128))
#: Texts of these characters hold none that `strip_invisible` would take; a quick test, as the classes it names are slow.
VISIBLE = r"^[\t\n\r\x20-\x7E\u00A0-\u00AC\u00AE-\u0377\u0400-\u052F\u2010-\u2027\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FEF]*\z"
DASHES = "‐‑‒–—―−﹘﹣－⁃"

SCRIPTS = {"cyrillic": "[Ѐ-ӿ]", "arabic": "[؀-ۿ]", "cjk": "[一-鿿぀-ヿ]", "devanagari": "[ऀ-ॿ]", "hebrew": "[֐-׿]", "thai": "[฀-๿]", "greek": "[Ͱ-Ͽ]"}

#: (hexadecimal prefix, type, family, risk) in order; the first that fits decides.
MAGIC = (
    ("89504e470d0a1a0a", "png", "image", "medium"), ("ffd8ff", "jpeg", "image", "medium"), ("474946383761", "gif", "image", "medium"), ("474946383961", "gif", "image", "medium"),
    ("49492a00", "tiff", "image", "medium"), ("4d4d002a", "tiff", "image", "medium"), ("38425053", "psd", "image", "medium"), ("255044462d", "pdf", "document", "high"), ("d0cf11e0a1b11ae1", "ole2", "document", "high"),
    ("7b5c727466", "rtf", "document", "high"), ("504b0304", "zip", "archive", "high"), ("1f8b", "gzip", "archive", "high"), ("377abcaf271c", "7z", "archive", "high"), ("526172211a07", "rar", "archive", "high"),
    ("425a68", "bzip2", "archive", "high"), ("fd377a585a00", "xz", "archive", "high"), ("4d5a", "exe", "executable", "critical"), ("7f454c46", "elf", "executable", "critical"), ("feedface", "macho", "executable", "critical"),
    ("feedfacf", "macho", "executable", "critical"), ("cffaedfe", "macho", "executable", "critical"), ("0061736d", "wasm", "executable", "critical"), ("2321", "shebang", "executable", "critical"), ("494433", "mp3", "audio", "medium"),
    ("664c6143", "flac", "audio", "medium"), ("4f676753", "ogg", "audio", "medium"), ("4d546864", "midi", "audio", "medium"), ("1a45dfa3", "webm", "video", "medium"), ("464c5601", "flv", "video", "medium"), ("3026b2758e66cf11", "wmv", "video", "medium"),
)

QUESTION_START = r"^(?:what|who|where|when|why|how|which|whose|is|are|was|were|do|does|did|can|could|should|would|will|may)[^a-z]"
FAMILY = {"image/png": "image", "image/jpeg": "image", "image/gif": "image", "application/pdf": "document", "application/zip": "archive", "application/gzip": "archive", "application/x-msdownload": "executable", "audio/mpeg": "audio", "text/plain": "text", "text/html": "text"}


def rejection(raw: Column) -> Column:
    """Why a text is rejected, null if it isn't: missing, blank, too many characters or too many bytes."""
    return (
        F.when(raw.isNull(), "not a text")
        .when(F.length(T.trim_all(raw)) == 0, "empty input")
        .when(F.length(raw) > MAX_CHARS, "too many characters")
        .when(F.octet_length(raw) > MAX_BYTES, "too many bytes")
    )


def guard(raw: Column, depth: Column, admitted: Column | None = None) -> Column:
    """The first entry guard that fails: rate (of streaming.limiter, if given), size, memory, depth."""
    c = T.text(raw)
    first = F.when(F.lit(False) if admitted is None else ~admitted, "rate_limit")
    return first.when(F.octet_length(c) > MAX_BYTES, "raw_bytes_oversized").when(F.octet_length(c) * 4 / 1048576.0 > MEMORY_MB, "memory_budget").when(depth > MAX_DEPTH, "html_depth")


def html_depth(c: Column) -> Column:
    """Deepest nesting of open tags; void tags count, as nothing closes them."""
    tags = F.regexp_extract_all(c, F.lit("</?[a-zA-Z]"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("deep"))

    def step(a: Column, t: Column) -> Column:
        at = F.when(t.startswith("</"), F.greatest(a.at - 1, F.lit(0))).otherwise(a.at + 1)
        return F.struct(at.alias("at"), F.greatest(a.deep, at).alias("deep"))

    return F.aggregate(tags, start, step, lambda a: a.deep).cast("long")


def canonical_spaces(c: Column) -> Column:
    """Other spaces become ordinary ones; runs of spaces, blank lines and tabs shorten; ends are trimmed."""
    c = F.when(has_other_spaces(c), F.translate(c, SPACES, " " * len(SPACES))).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "^[ \t\n\r]+|[ \t\n\r]+\\z", "")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "\t{3,}", "\t")


def has_other_spaces(c: Column) -> Column:
    return c.rlike("[" + SPACES + "]")


def fold_lookalikes(c: Column) -> Column:
    """Tokens that mix Latin letters with letters of another script get the Latin look-alikes; others stay."""
    parts = F.regexp_extract_all(c, F.lit("[^ \t\n\r]+|[ \t\n\r]+"), F.lit(0))
    fold = lambda w: F.when(w.rlike("[A-Za-z]") & w.rlike(OTHER_SCRIPT), F.translate(w, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))).otherwise(w)
    return F.when(c.rlike(OTHER_SCRIPT), F.array_join(F.transform(parts, fold), "")).otherwise(c)


def tag_payload(c: Column) -> Column:
    """The text hidden in Unicode tag characters."""
    found = F.array_join(F.regexp_extract_all(c, F.lit("[\\x{E0001}-\\x{E007F}]"), F.lit(0)), "")
    return F.translate(found, TAGS_FROM, TAGS_TO)


def strip_invisible(c: Column) -> Column:
    """Format, control and unassigned characters go; between three word characters on either side a space stays."""
    gap = r"[\p{Cf}\p{Cn}\p{Cc}&&[^\n\r\t]]+"
    wide = F.regexp_replace(c, rf"(?<=[\p{{L}}\p{{Nd}}]{{3}}){gap}(?=[\p{{L}}\p{{Nd}}]{{3}})", " ")
    return F.when(c.rlike(VISIBLE), c).otherwise(F.regexp_replace(wide, gap, ""))


def invisible_count(c: Column) -> Column:
    return T.count(c, r"[\p{Cf}\p{Cn}\p{Cc}&&[^\n\r\t]]")


def fullwidth_fold(c: Column) -> Column:
    return F.translate(c, FULLWIDTH, HALFWIDTH)


def fold_angles(c: Column) -> Column:
    return F.translate(c, ANGLES_FROM, ANGLES_TO)


def plus_decoded(c: Column) -> Column:
    """Plus signs become spaces where there are three or more and no space."""
    return F.when((T.occurrences(c, "+") >= 3) & ~c.contains(" "), F.replace(c, F.lit("+"), F.lit(" "))).otherwise(c)


def dehyphenated(c: Column) -> Column:
    """Words that dashes split are joined."""
    return F.regexp_replace(F.translate(c, DASHES, "-" * len(DASHES)), r"([A-Za-z]+)-(?=[A-Za-z])", "$1")


def script_profile(c: Column) -> Column:
    """Scripts other than Latin with three letters or more, comma separated in order of name."""
    found = F.array_compact(F.array(*[F.when(T.thrice(c, p), F.lit(k)) for k, p in sorted(SCRIPTS.items())]))
    return F.when(c.rlike("[\u0370-\u9FFF]"), F.array_join(found, ",")).otherwise("")


def content_type(content: Column) -> Column:
    """The detected type of bytes, null for text."""
    head = F.lower(F.hex(F.substr(content, F.lit(1), F.lit(16))))
    riff = F.substr(head, F.lit(17), F.lit(8))
    out = F.when(head.startswith("52494646"), F.when(riff == "57415645", "wav").when(riff == "41564920", "avi").when(riff == "57454250", "webp").otherwise("riff"))
    out = out.when(F.substr(head, F.lit(9), F.lit(8)) == "66747970", "mp4")
    for prefix, kind, _, _ in MAGIC:
        out = out.when(head.startswith(prefix), kind)
    return out


def type_risk(kind: Column) -> Column:
    risk = {k: r for _, k, _, r in MAGIC} | {"wav": "medium", "avi": "medium", "webp": "medium", "riff": "medium", "mp4": "medium"}
    out = F.when(kind.isNull(), "none")
    for level in ("critical", "high"):
        out = out.when(kind.isin(*[k for k, r in risk.items() if r == level]), level)
    return out.otherwise("medium")


def type_family(kind: Column) -> Column:
    family = {k: f for _, k, f, _ in MAGIC} | {"wav": "audio", "avi": "video", "webp": "image", "riff": "audio", "mp4": "video"}
    out = F.when(kind.isNull(), "text")
    for f in sorted(set(family.values())):
        out = out.when(kind.isin(*[k for k, x in family.items() if x == f]), f)
    return out


def is_polyglot(content: Column, kind: Column) -> Column:
    """A second archive header inside a non-archive, or a PDF header inside a non-PDF."""
    body = F.hex(F.substr(content, F.lit(5)))
    return ((F.coalesce(kind, F.lit("")) != "zip") & body.contains("504B0304")) | ((F.coalesce(kind, F.lit("")) != "pdf") & body.contains("255044462D"))


def whitelist_reason(c: Column) -> Column:
    """The first condition of a plain question that fails, null if all hold."""
    low = F.lower(T.trim_all(c))
    return (
        F.when(~(low.rlike(QUESTION_START) | low.endswith("?")), "not a question")
        .when(c.rlike(r"(?i)\[/?(?:system|inst)\]|<\|[a-z_]+\|>|-{3,}|={3,}"), "boundary marker")
        .when(c.rlike(r"[A-Za-z0-9+/]{20}") | c.rlike("[0-9a-fA-F]{16}") | c.rlike("(?:%[0-9a-fA-F]{2}){2}"), "encoded data")
        .when(F.length(c) > 1000, "too long")
        .when(F.regexp_count(c, F.lit(r"[.!?]+(?:[ \t\n\r]|\z)")) > 3, "too many sentences")
        .when(low.rlike(r"you are (?:now|a|an) |act as |pretend "), "role assignment")
    )


def url_verdict(url: Column) -> Column:
    """What the fetch policy says of a URL: https only, no private, loopback or link-local address."""
    host = F.regexp_extract(F.lower(url), r"^[a-z]+://(?:[^@/]*@)?([^/:?#]+)", 1)
    private = r"^(?:0\.0\.0\.0|127\.[0-9.]+|10\.[0-9.]+|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9.]+|192\.168\.[0-9.]+|169\.254\.[0-9.]+|localhost)$"
    return F.when(~F.lower(url).startswith("https://"), "scheme").when(host == "", "no host").when(host.rlike(private), "private address").otherwise("allowed")


def path_verdict(path: Column) -> Column:
    """What the file policy says of a path: no parent folder, no device."""
    return F.when(path.rlike(r"(?:^|/)\.\.(?:/|$)"), "parent folder").when(path.rlike("^/(?:dev|proc|sys)/"), "device").otherwise("allowed")
