"""Sources of texts as tables: text files, JSON lines and arrays, CSV, Parquet, e-mail, office documents and images, bytes by
type; and a registry that plans several of them at once."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textguard.functions import text as T
from textguard.operators import intake as I

MAX_FILE, MAX_DOCUMENT, MAX_TEXT = 10 << 20, 50 << 20, 1 << 20


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", T.utf8(F.col("content")).alias("text"))


def json_lines(spark: SparkSession, path: str, text_col: str = "text", schema: str | None = None) -> DataFrame:
    """The lines with `error`: null, or why a line has no text (bad JSON, no text, empty text). Blank lines are skipped; a bad line
    is a row and no failure."""
    fields = Ty.StructType.fromDDL(schema) if schema else Ty.StructType().add(text_col, Ty.StringType())
    raw = spark.read.text(path).where(F.trim("value") != "")
    read = raw.withColumn("j_", F.from_json("value", Ty.StructType([*fields.fields, Ty.StructField("_corrupt_record", Ty.StringType())]), {"mode": "PERMISSIVE"}))
    t = F.col(f"j_.{text_col}")
    error = F.when(F.col("j_").isNull() | F.col("j_._corrupt_record").isNotNull(), "invalid json").when(t.isNull(), "missing text").when(F.trim(t) == "", "empty text")
    return read.select(*[F.col(f"j_.{f.name}").alias(f.name) for f in fields], error.alias("error"))


def labelled_lines(spark: SparkSession, path: str, default: int = 0, max_samples: int | None = None) -> DataFrame:
    """(text, label) of JSON lines; bad lines are left out, a missing label is the default; `max_samples` is the caller's."""
    d = json_lines(spark, path, schema="text string, label int").where("error is null")
    d = d.select("text", F.coalesce("label", F.lit(default)).alias("label"))
    return d if max_samples is None else d.limit(max_samples)


def training_csv(spark: SparkSession, path: str, text_col: str = "text", label: int | None = None) -> DataFrame:
    """(text, label) of a CSV file with a header and quoted line breaks; `label` for files that have none. Rows without a text are
    left out."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    own = F.lit(label) if label is not None else F.col("label").try_cast("int")
    return d.select(F.col(text_col).alias("text"), own.cast("int").alias("label")).where("text is not null")


def shards(spark: SparkSession, path: str, text_col: str, label_col: str, source: str, category: str = "") -> DataFrame:
    """(text, label, source, category) of Parquet files."""
    return spark.read.parquet(path).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.lit(source).alias("source"), F.lit(category).alias("category"))


def instructions(spark: SparkSession, path: str, source: str, sample: int | None = None, seed: int = 7) -> DataFrame:
    """(text, label, source) of a JSON array of instructions: the instruction and its input, if any, on a line of its own. Empty
    instructions drop; the sample is the first ones in the order of a hash."""
    d = spark.read.schema("instruction string, input string").option("multiLine", True).json(path)
    own = F.concat_ws("\n", F.trim("instruction"), F.when(F.trim("input") != "", F.trim("input")))
    d = d.where(F.trim("instruction") != "").select(own.alias("text"), F.lit(0).alias("label"), F.lit(source).alias("source"))
    return d if sample is None else d.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "text")), "text").limit(sample)


def registered(spark: SparkSession, registry: list[dict]) -> DataFrame:
    """(text, label, source): the union of the registry's entries.

    An entry: name, format (parquet, csv, json), path, text (its column), one of label (a number), label_col with an
    optional label_map, and optionally where (column: value, all equal) and max_samples with seed. Null texts and labels
    outside the map drop.
    """
    out = None
    for e in registry:
        d = spark.read.option("header", True).format(e["format"]).load(e["path"])
        for c, v in (e.get("where") or {}).items():
            d = d.where(F.col(c) == v)
        if "label" in e:
            label = F.lit(e["label"])
        elif e.get("label_map"):
            label = F.try_element_at(F.create_map(*[F.lit(x) for k, v in e["label_map"].items() for x in (str(k), v)]), F.col(e["label_col"]).cast("string"))
        else:
            label = F.col(e["label_col"])
        d = d.select(F.col(e["text"]).alias("text"), label.cast("int").alias("label"), F.lit(e["name"]).alias("source")).where("text is not null and label is not null")
        if e.get("max_samples"):
            d = d.orderBy(F.md5(F.concat(F.lit(f"{e.get('seed', 0)}|"), "text")), "text").limit(e["max_samples"])
        out = d if out is None else out.union(d)
    return spark.createDataFrame([], "text string, label int, source string") if out is None else out


def lock(rows: DataFrame) -> DataFrame:
    """(source, rows, digest) of registered rows: a digest that doesn't depend on their order says whether a source changed."""
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.hex(F.expr("bit_xor(xxhash64(text, label))")).alias("digest"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, content, reason): files as bytes; `reason` says why one is refused (its path, or more
    than MAX_FILE bytes), and its content is null then."""
    d = spark.read.format("binaryFile").load(path)
    why = F.when(F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)"), "path").when(F.col("length") > MAX_FILE, "too large")
    return d.withColumn("reason", why).withColumn("content", F.when(F.col("reason").isNull(), F.col("content")))


_BOMS = (("efbbbf", "utf-8-sig", "UTF-8", 3), ("fffe0000", "utf-32-le", "UTF-32LE", 4), ("0000feff", "utf-32-be", "UTF-32BE", 4), ("fffe", "utf-16-le", "UTF-16LE", 2), ("feff", "utf-16-be", "UTF-16BE", 2))


def encoding(content: Column) -> Column:
    """The encoding that the first bytes name, else utf-8 if all are valid, else windows-1252; there is no statistical guess."""
    head = F.lower(F.hex(F.substr(content, F.lit(1), F.lit(4))))
    out = F.when(content.isNull(), F.lit(None).cast("string"))
    for prefix, name, _, _ in _BOMS:
        out = out.when(head.startswith(prefix), name)
    return out.when(F.call_function("is_valid_utf8", content.cast("string")), "utf-8").otherwise("windows-1252")


def _decode_bytes(data: pa.Array, names: pa.Array) -> pa.Array:
    codec = {"utf-8-sig": "utf-8-sig", "windows-1252": "cp1252"}
    skip = {"utf-16-le": 2, "utf-16-be": 2, "utf-32-le": 4, "utf-32-be": 4}
    return pa.array([None if b is None else bytes(b)[skip.get(n, 0) :].decode(codec.get(n, n), "replace") for b, n in zip(data.to_pylist(), names.to_pylist())], pa.string())


def decoded(content: Column) -> Column:
    """struct(text, encoding, flags): bytes as text; a byte order mark is left out and flagged, as is the fallback."""
    name = encoding(content)
    plain = F.call_function("make_valid_utf8", content.cast("string"))
    text = F.when(name == "utf-8", plain).otherwise(F.arrow_udf(_decode_bytes, Ty.StringType())(F.when(name != "utf-8", content), name))
    flags = F.array_compact(F.array(F.when(name.rlike("^utf-(?:8-sig|16|32)"), F.concat(F.lit("bom_detected_"), name)), F.when(name == "windows-1252", F.lit("encoding_fallback_utf8"))))
    return F.struct(text.alias("text"), name.alias("encoding"), flags.alias("flags"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _paragraphs(xml: bytes, paragraph: str, run: str) -> list[str]:
    return ["".join(t.text or "" for t in p.iter(run)) for p in ElementTree.fromstring(xml).iter(paragraph)]


def office_text(data: bytes) -> tuple[str | None, str | None]:
    """(kind, text) of a docx, pptx or xlsx file; (None, None) of any other bytes. Entities are refused, and no part is
    unpacked beyond MAX_DOCUMENT bytes."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = z.namelist()
        kind = next((k for k, f in (("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml"), ("xlsx", "xl/workbook.xml")) if f in names), None)
        if not kind:
            return None, None

        def part(name: str) -> bytes:
            with z.open(name) as f:
                xml = f.read(MAX_DOCUMENT + 1)
            if len(xml) > MAX_DOCUMENT or b"<!ENTITY" in xml or b"<!DOCTYPE" in xml:
                raise ValueError(name)
            return xml

        number = lambda n: int(re.findall(r"\d+", n)[-1])
        if kind == "docx":
            lines = _paragraphs(part("word/document.xml"), f"{_W}p", f"{_W}t")
        elif kind == "pptx":
            slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
            lines = [x for n in slides for x in _paragraphs(part(n), f"{_A}p", f"{_A}t")]
        else:
            shared = _paragraphs(part("xl/sharedStrings.xml"), f"{_S}si", f"{_S}t") if "xl/sharedStrings.xml" in names else []
            lines = []
            for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number):
                for row in ElementTree.fromstring(part(n)).iter(f"{_S}row"):
                    cells = [(c.get("t"), "".join(v.text or "" for v in c.iter() if v.tag in (f"{_S}v", f"{_S}t"))) for c in row.iter(f"{_S}c")]
                    lines.append("\t".join(shared[int(v)] if t == "s" and v.isdigit() and int(v) < len(shared) else v for t, v in cells))
        return kind, "\n".join(x for x in lines if x.strip())
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, RuntimeError, EOFError, NotImplementedError):
        return None, None


def rtf_text(data: bytes) -> str | None:
    """The text of an RTF file: its control words and groups of settings left out."""
    t = data.decode("latin-1")
    if not t.startswith("{\\rtf"):
        return None
    t = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", " ", t)
    t = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), t)
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), t)
    t = re.sub(r"\\(?:par|line)\b ?", "\n", t)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", t).strip()


_DOCUMENT = Ty.StructType().add("kind", Ty.StringType()).add("text", Ty.StringType())


def _documents(data: pa.Array) -> pa.Array:
    rows = []
    for b in data.to_pylist():
        kind, text = office_text(bytes(b)) if b else (None, None)
        if b and kind is None and (rtf := rtf_text(bytes(b))) is not None:
            kind, text = "rtf", rtf
        rows.append({"kind": kind, "text": text})
    return pa.array(rows, pa.struct([("kind", pa.string()), ("text", pa.string())]))


def document_text(content: Column) -> Column:
    """struct(kind, text) of docx, pptx, xlsx and rtf files; nulls for other bytes and for files beyond MAX_DOCUMENT. PDF text needs a
    parser that isn't part of the standard library and has none here."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(4)))
    may = head.isin("504B0304", "7B5C7274") & (F.octet_length(content) <= MAX_DOCUMENT)
    return F.arrow_udf(_documents, _DOCUMENT)(F.when(may, content))


def pdf_flags(content: Column) -> Column:
    """Flags of a PDF's action names: scripts, actions that run by themselves, and actions that reach outside."""
    body = F.decode(content, "ISO-8859-1")
    name = lambda *n: body.rlike("/(?:" + "|".join(n) + ")(?:[^A-Za-z]|$)")
    found = F.array_compact(F.array(F.when(name("JavaScript", "JS"), F.lit("pdf_javascript")), F.when(name("OpenAction", "AA"), F.lit("pdf_auto_action")), F.when(name("Launch", "URI", "SubmitForm"), F.lit("pdf_external_action"))))
    return F.when(F.hex(F.substr(content, F.lit(1), F.lit(5))) == "255044462D", found).otherwise(F.array().cast("array<string>"))


def image_text(content: Column) -> Column:
    """Texts in an image's XMP packet and in PNG text chunks. Reading the picture itself needs a model, which isn't here."""
    body = F.when(I.type_family(I.content_type(content)) == "image", F.decode(content, "ISO-8859-1")).otherwise("")
    packet = F.regexp_extract(body, r"(?s)<x:xmpmeta.*?</x:xmpmeta>", 0)
    found = F.regexp_extract_all(packet, F.lit(r"(?s)<rdf:li[^>]*>([^<]*)</rdf:li>"), F.lit(1))
    chunks = F.regexp_extract_all(body, F.lit(r"(?s)tEXt([ -~]{1,79}\x00[\x09\x0A\x0D\x20-\x7E\xA0-\xFF]+)"), F.lit(1))
    notes = F.transform(chunks, lambda x: F.regexp_replace(x, r"^[^\x00]*\x00", ""))
    return F.array_join(F.filter(F.concat(found, notes), lambda x: F.trim(x) != ""), "\n")


def extracted(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds kind, text and flags: each row's bytes by their type, read as an image's notes, a document's text, or plain text; null
    in `text` for executables and other types that hold none."""
    c = F.col(content_col)
    d = df.withColumn("kind", I.content_type(c)).withColumn("doc_", document_text(c)).withColumn("plain_", decoded(F.when(F.col("kind").isNull(), c)))
    family = I.type_family(F.col("kind"))
    note = image_text(c)
    text = F.when(F.col("doc_.kind").isNotNull(), F.col("doc_.text")).when(family == "image", F.when(note != "", note)).when(F.col("kind").isNull(), F.col("plain_.text"))
    own = F.array_compact(F.array(F.when(family != "text", F.concat(F.lit("embedded_"), family)), F.when((family == "image") & (note != ""), F.lit("image_metadata_text"))))
    d = d.withColumn("text", text).withColumn("flags", F.concat(own, pdf_flags(c), F.coalesce(F.col("plain_.flags"), F.array().cast("array<string>"))))
    return d.withColumn("kind", F.coalesce("doc_.kind", "kind")).drop("doc_", "plain_")
