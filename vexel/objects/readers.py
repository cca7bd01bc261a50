"""Readers: where objects and their attributes come from."""

from __future__ import annotations

import io
import mimetypes
import re
import zipfile
from abc import ABC, abstractmethod
from fnmatch import fnmatch
from functools import reduce
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ObjectReader(ABC):
    """objects(): (external_id, ...) what is embedded and given back; metadata(): (external_id, ...) attributes to filter by, or None."""

    def __init__(self, **kwargs):
        self.kwargs = kwargs

    @abstractmethod
    def objects(self, spark: SparkSession) -> DataFrame: ...

    def metadata(self, spark: SparkSession) -> DataFrame | None:
        return None

    def by_ids(self, spark: SparkSession, ids: DataFrame) -> DataFrame:
        """The objects of (external_id)."""
        return self.objects(spark).join(ids.select("external_id").distinct(), "external_id", "left_semi")


class TableReader(ObjectReader):
    """The rows of a Parquet table; `attributes` are its metadata columns, all others belong to the object."""

    def __init__(self, path: str, id_column: str = "external_id", attributes: list[str] | None = None):
        super().__init__(path=path, id_column=id_column, attributes=attributes or [])

    def _table(self, spark):
        df = spark.read.parquet(self.kwargs["path"])
        return df.withColumn("external_id", F.col(self.kwargs["id_column"]).cast("long"))

    def objects(self, spark):
        return self._table(spark).drop(*[a for a in self.kwargs["attributes"] if a != self.kwargs["id_column"]])

    def metadata(self, spark):
        return self._table(spark).select("external_id", *self.kwargs["attributes"]) if self.kwargs["attributes"] else None


def match_uri(uri: str, include: str | None = "*", exclude: list[str] | None = None, suffixes: list[str] | None = None) -> bool:
    """Whether a file's name matches the include pattern, none of the exclude patterns, and has one of the suffixes."""
    name = uri.rstrip("/").rsplit("/", 1)[-1]
    return (include is None or fnmatch(name, include)) and not any(fnmatch(name, p) for p in exclude or ()) and (not suffixes or any(name.endswith(s) for s in suffixes))


def _regex(pattern: str) -> str:
    """The regular expression of a file name pattern, as match_uri() takes it."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inner = pattern[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else r"\^" + inner[1:] if inner[0] == "^" else inner) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.sub(r"([^A-Za-z0-9_])", r"\\\1", c))
        i += 1
    return f"(?s)^{out}$"


def split_text(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """Chunks of at most `size` characters, cut at paragraphs, lines or words where one is near; each repeats up to `overlap` characters of the one before."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for sep in ("\n\n", "\n", " "):
                at = text.rfind(sep, start + size // 2, end)
                if at > start:
                    end = at + len(sep)
                    break
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


class _Html(HTMLParser):
    """Collects what a page shows: no scripts, styles or tags; blocks end lines."""

    HIDDEN = {"script", "style", "template", "noscript", "head"}
    BLOCKS = {"p", "div", "br", "li", "tr", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "pre", "blockquote", "hr", "dd", "dt"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def _html(content: bytes) -> str:
    p = _Html()
    p.feed(content.decode("utf-8", "replace"))
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def _markdown(content: bytes) -> str:
    t = content.decode("utf-8", "replace")
    t = re.sub(r"(?m)^(?:```|~~~).*$|^\s{0,3}(?:[-*_]\s*){3,}$", "", t)
    t = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", t)
    t = re.sub(r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", "", t)
    return re.sub(r"(\*\*|__|`)(.+?)\1", r"\2", t)


def _pdf(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("PDF files need the library pypdf") from e
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


def _docx(content: bytes) -> str:
    """The paragraphs of a .docx file, which is a zip of XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(w + "t")) for p in root.iter(w + "p"))


#: How the text of a file is had, by its MIME type; others are taken as UTF-8.
PARSERS = {
    "text/html": _html,
    "application/xhtml+xml": _html,
    "text/markdown": _markdown,
    "application/pdf": _pdf,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": _docx,
}


def text_of(content: bytes, uri: str) -> str:
    """The text of a file, by the MIME type that its name stands for."""
    kind = {".md": "text/markdown", ".markdown": "text/markdown", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}.get("." + uri.rsplit(".", 1)[-1].lower()) or mimetypes.guess_type(uri)[0]
    return PARSERS.get(kind, lambda c: c.decode("utf-8", "replace"))(bytes(content))


class DirectoryTextReader(ObjectReader):
    """Text, HTML, Markdown, PDF and docx files under a directory, in chunks: (external_id, uri, chunk, text). The id is a hash of the address and the chunk's number."""

    def __init__(self, path: str, include: str = "*", exclude: list[str] | None = None, suffixes: list[str] | None = None, max_files: int | None = None, chunk_size: int = 1000, chunk_overlap: int = 100):
        super().__init__(path=path, include=include, exclude=exclude, suffixes=suffixes, max_files=max_files, chunk_size=chunk_size, chunk_overlap=chunk_overlap)

    def files(self, spark: SparkSession) -> DataFrame:
        k = self.kwargs
        name = F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1)

        def like(pattern: str):
            return name.rlike(_regex(pattern))

        wanted = F.lit(True) if k["include"] is None else like(k["include"])
        for p in k["exclude"] or ():
            wanted = wanted & ~like(p)
        if k["suffixes"]:
            wanted = wanted & reduce(lambda a, b: a | b, [name.endswith(s) for s in k["suffixes"]])
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(k["path"])
        names = df.select("path").where(wanted)
        if k["max_files"] is not None:
            names = names.orderBy("path").limit(k["max_files"])
        return df.join(names, "path", "left_semi")

    def objects(self, spark):
        size, overlap = self.kwargs["chunk_size"], self.kwargs["chunk_overlap"]

        @F.pandas_udf("array<string>")
        def chunked(content, uri):
            import pandas as pd

            return pd.Series([split_text(text_of(c, u), size, overlap) for c, u in zip(content, uri)])

        chunked.func.__annotations__.clear()
        d = self.files(spark).select(F.col("path").alias("uri"), F.posexplode(chunked("content", "path")).alias("chunk", "text"))
        return d.select(F.xxhash64("uri", "chunk").alias("external_id"), "uri", "chunk", "text")

    def metadata(self, spark):
        return self.objects(spark).select("external_id", "uri", "chunk")


class DirectoryImageReader(DirectoryTextReader):
    """Image files under a directory, undecoded: (external_id, uri, image, bytes); an embedding decodes what it needs."""

    def __init__(self, path: str, include: str = "*", exclude: list[str] | None = None, suffixes: list[str] | None = None, max_files: int | None = None):
        super().__init__(path, include, exclude, [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff"] if suffixes is None else suffixes, max_files)
        self.kwargs = {k: self.kwargs[k] for k in ("path", "include", "exclude", "suffixes", "max_files")}

    def objects(self, spark):
        return self.files(spark).select(F.xxhash64("path").alias("external_id"), F.col("path").alias("uri"), F.col("content").alias("image"), F.col("length").alias("bytes"))

    def metadata(self, spark):
        return self.files(spark).select(F.xxhash64("path").alias("external_id"), F.col("path").alias("uri"), F.col("length").alias("bytes"))
