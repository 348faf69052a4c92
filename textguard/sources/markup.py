"""HTML and e-mail as tables, by the standard library's parsers in Arrow batches."""

from __future__ import annotations

import email
import email.policy
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = re.compile(r"display\s*:\s*none|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)|font-size\s*:\s*0", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Visible(HTMLParser):
    """Text outside scripts, styles and hidden elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped: list[str] = []
        self.parts: list[str] = []
        self.hidden = self.odd_comment = False

    def handle_starttag(self, tag, attrs):
        style = next((v or "" for k, v in attrs if k == "style"), "")
        concealed = bool(HIDDEN.search(style))
        self.hidden |= concealed
        if tag not in VOID and (self.skipped or concealed or tag in ("script", "style")):
            self.skipped.append(tag)

    def handle_endtag(self, tag):
        if self.skipped and self.skipped[-1] == tag:
            self.skipped.pop()

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)

    def handle_comment(self, data):
        self.odd_comment |= bool(re.search(r"ignore|instruction|system|prompt|override", data, re.I))


#: Texts that are taken out of an Arrow batch at once.
SLICE = 32
_SEEN = T.StructType().add("visible_text", T.StringType()).add("hidden_html_content", T.BooleanType()).add("suspicious_html_comment", T.BooleanType())


def _seen(html: str | None) -> tuple[str, bool, bool]:
    if not html:
        return "", False, False
    p = _Visible()
    p.feed(html)
    p.close()
    return " ".join(" ".join(p.parts).split()), p.hidden, p.odd_comment


def _visible(pages: pa.Array) -> pa.Array:
    parts = []
    for at in range(0, len(pages), SLICE):
        rows = [_seen(html) for html in pages.slice(at, SLICE).to_pylist()]
        parts.append(pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.bool_(), pa.bool_()))], names=_SEEN.names))
    pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batches took
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("visible_text", pa.string()), ("hidden_html_content", pa.bool_()), ("suspicious_html_comment", pa.bool_())]))


def visible_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows with visible_text, hidden_html_content and suspicious_html_comment in place of the markup, which alone goes
    to Python."""
    d = df.withColumn("seen_", F.explode(F.array(F.arrow_udf(_visible, _SEEN)(html_col))))
    return d.select(*[c for c in df.columns if c != html_col], "seen_.*")


_MAIL = T.StructType().add("body", T.StringType()).add("attachments", T.ArrayType(T.StructType().add("filename", T.StringType()).add("content_type", T.StringType()).add("size", T.LongType())))
_MAIL_ARROW = pa.struct([("body", pa.string()), ("attachments", pa.list_(pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("size", pa.int64())])))])


def _mails(contents: pa.Array) -> pa.Array:
    rows = []
    for content in contents.to_pylist():
        body, attachments = [], []
        for part in email.message_from_bytes(content or b"", policy=email.policy.default).walk():
            if part.is_multipart():
                continue
            data = part.get_payload(decode=True) or b""
            if part.get_content_type() in ("text/plain", "text/html") and not part.get_filename():
                body.append(data.decode(part.get_content_charset() or "utf-8", "replace"))
            else:
                attachments.append({"filename": part.get_filename() or "", "content_type": part.get_content_type(), "size": len(data)})
        rows.append({"body": "\n".join(body), "attachments": attachments})
    return pa.array(rows, _MAIL_ARROW)


def parse_mail(content):
    """struct(body, attachments) of an e-mail's bytes, in Arrow batches; null counts as empty bytes."""
    return F.arrow_udf(_mails, _MAIL)(content)


def looks_like_mail(content):
    """Two of six header names in the first 2 KiB."""
    head = F.lower(F.substr(content, F.lit(1), F.lit(2048)).cast("string"))
    found = sum((F.when(head.rlike(rf"(?:^|\n){h}:"), 1).otherwise(0) for h in ("from", "to", "subject", "date", "mime-version", "content-type")), F.lit(0))
    return found >= 2
