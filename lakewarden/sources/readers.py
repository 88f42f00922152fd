"""Readers of documents and logs: text, Markdown, DOCX, HTML, JSON lines, pattern feeds, and files by tenant folder."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = "path string, page int, type string, content string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Non-blank paragraphs of a word-processor document, one a line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" if t.tag == f"{_W}t" else "\t" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab")) for p in root.iter(f"{_W}p"))
    return "\n".join(x for x in lines if x.strip())


class _Html(HTMLParser):
    SKIPPED, BLOCKS = {"script", "style", "nav", "head", "footer", "noscript"}, {"p", "div", "li", "tr", "table", "section", "article", "br", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.SKIPPED
        if tag in self.BLOCKS:
            self.parts.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else ""))

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self.SKIPPED))
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


def html_text(page: str) -> str:
    """Visible text of a page, a block a line, headings marked by number signs."""
    p = _Html()
    p.feed(page)
    p.close()
    return "\n".join(x for x in (y.strip() for y in "".join(p.parts).split("\n")) if x)


#: Extension -> (kind, bytes to text). Formats that need a library this project does not have are added here by the caller.
FORMATS: dict[str, tuple[str, Callable[[bytes], str]]] = {
    "txt": ("text", lambda raw: raw.decode("utf-8", "replace")),
    "md": ("text", lambda raw: raw.decode("utf-8", "replace")),
    "docx": ("docx", docx_text),
    "html": ("html", lambda raw: html_text(raw.decode("utf-8", "replace"))),
    "htm": ("html", lambda raw: html_text(raw.decode("utf-8", "replace"))),
}


def files(spark: SparkSession, folder: str, formats: dict[str, tuple[str, Callable[[bytes], str]]] | None = None) -> DataFrame:
    """(path, page, type, content, error) of every file below a folder, one document a file; unknown types and unreadable files carry an error.

    Files are read where the task runs; a PDF or OCR reader is one more entry of ``formats``.
    """
    readers = dict(FORMATS) | (formats or {})
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                kind, read = readers.get(path.rsplit(".", 1)[-1].lower(), (None, None))
                if read is None:
                    rows.append((path, 1, None, None, "unsupported file type"))
                    continue
                try:
                    rows.append((path, 1, kind, read(bytes(data)), None))
                except Exception as e:  # a broken file must not end the job
                    rows.append((path, 1, kind, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "page", "type", "content", "error"])

    return raw.mapInPandas(run, PAGE)


def by_tenant(df: DataFrame, root: str, default: str = "default_tenant") -> DataFrame:
    """Files with the tenant of the first folder below ``root``, the default for files in ``root`` itself."""
    rest = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")
    return df.withColumn("tenant_id", F.when(rest.contains("/"), F.regexp_extract(rest, "^([^/]+)/", 1)).otherwise(F.lit(default)))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """Records of JSON lines under a schema; malformed lines are left out (or fail the job, if strict), a missing path is empty."""
    parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(parsed).option("mode", "FAILFAST").json(path)
    from pyspark.errors import AnalysisException

    bad = "_malformed"
    try:
        rows = spark.read.schema(T.StructType([*parsed.fields, T.StructField(bad, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], parsed)
    return rows.where(F.col(bad).isNull()).drop(bad)


def pattern_feed(path: str, required: bool = True) -> dict[str, tuple[float, str]]:
    """id -> (severity, regex) of a YAML feed; each regex is compiled once to fail early. A missing file is an error, or an empty feed."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except FileNotFoundError:
        if required:
            raise
        return {}
    feed = {p["id"]: (float(p["severity"]), p["regex"]) for p in found["patterns"]}
    for _, regex in feed.values():
        re.compile(regex)
    return feed


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase) of a YAML list of attack phrases."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    values = found if isinstance(found, list) else next(v for v in found.values() if isinstance(v, list))
    return spark.createDataFrame([(str(v),) for v in values], "phrase string")
