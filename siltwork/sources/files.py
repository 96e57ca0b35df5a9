"""Files as rows: discovery, digests, texts by kind of file, dates with their provenance."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.functions.text import matches_glob

TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".csv", ".json", ".html", ".log")
SUFFIXES = (*TEXT_SUFFIXES, ".pdf", ".docx", ".xlsx", ".pptx")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def discover(spark: SparkSession, root: str, exclude_dirs: tuple[str, ...] = schema.EXCLUDE_DIRS, exclude_files: tuple[str, ...] = schema.EXCLUDE_FILES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, modificationTime, length, content) of the files to read. Hidden and excluded folders are left out, and excluded names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(_kept(F.col("path"), root, exclude_dirs) & ~matches_glob(_name(F.col("path")), exclude_files) & _supported(F.col("path"), suffixes))


def skipped(spark: SparkSession, root: str, exclude_dirs: tuple[str, ...] = schema.EXCLUDE_DIRS, exclude_files: tuple[str, ...] = schema.EXCLUDE_FILES) -> DataFrame:
    """Names left out for their pattern, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    rows = files.where(_kept(F.col("path"), root, exclude_dirs) & matches_glob(_name(F.col("path")), exclude_files))
    return rows.select(_name(F.col("path")).alias("name")).distinct().orderBy("name")


def _kept(path: Column, root: str, exclude_dirs: tuple[str, ...]) -> Column:
    base = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")
    inside = F.split(F.replace(F.regexp_replace(path, r"^[a-z0-9]+:/*", "/"), F.lit(base + "/"), F.lit("")), "/")
    return ~F.exists(F.slice(inside, F.lit(1), F.size(inside) - 1), lambda d: d.startswith(".") | d.isin(*exclude_dirs)) & ~_name(path).startswith(".")


def _supported(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(path).rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$")


def digested(files: DataFrame) -> DataFrame:
    return files.withColumn("digest", F.sha2("content", 256))


# ---- readers: bytes to (text, locator) pairs -------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def read_docx(data: bytes) -> list[tuple[str, int]]:
    """Paragraphs, then the rows of tables with their cells joined."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml").find(f"{_W}body")
    say = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    parts = [s for p in body.findall(f"{_W}p") if (s := say(p))]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        if cells := [s for c in row.findall(f"{_W}tc") if (s := say(c))]:
            parts.append(" | ".join(cells))
    return [("\n".join(parts), 1)] if parts else []


def _until_silence(rows: Iterator[list[str]], most: int) -> Iterator[list[str]]:
    """Rows with content, up to the first run of more than most rows without."""
    last = 0
    for k, cells in enumerate(rows, 1):
        if any(cells):
            last = k
            yield cells
        elif k - last > most:
            return


def sheet_lines(title: str, rows: Iterator[list[str]], blank_run: int = schema.BLANK_RUN) -> list[str]:
    """A sheet as text: its first row that isn't empty names the fields of the later ones."""
    plain = lambda cells: " | ".join(c for c in cells if c)
    content = _until_silence(rows, blank_run)
    fields = next(content, [])
    records = ("; ".join(": ".join(pair) for pair in zip(fields, cells, strict=False) if all(pair)) or plain(cells) for cells in content)
    return [f"Sheet: {title}", *([plain(fields)] if fields else []), *records]


def _place(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(data: bytes) -> list[tuple[str, int]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in _xml(z, "xl/sharedStrings.xml").findall(f"{_X}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}

        def rows(part: str) -> Iterator[list[str]]:
            last = 0
            for row in _xml(z, part).iter(f"{_X}row"):
                number = int(row.get("r", last + 1))
                yield from ([] for _ in range(number - last - 1))
                last, cells = number, []
                for k, c in enumerate(row.findall(f"{_X}c")):
                    at = _place(c.get("r")) if c.get("r") else k
                    value = c.findtext(f"{_X}v") or "".join(t.text or "" for t in c.iter(f"{_X}t"))
                    cells += [""] * (at - len(cells)) + [(shared[int(value)] if c.get("t") == "s" and value else value or "").strip()]
                yield cells

        out = []
        for k, sheet in enumerate(_xml(z, "xl/workbook.xml").iter(f"{_X}sheet"), 1):
            target = targets[sheet.get(_R)].lstrip("/")
            lines = sheet_lines(sheet.get("name"), rows(target if target.startswith("xl/") else f"xl/{target}"))
            if len(lines) > 1:
                out.append(("\n".join(lines), k))
        return out


def read_pptx(data: bytes) -> list[tuple[str, int]]:
    """Texts of each slide, its tables row by row, and its notes."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted((int(m[1]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))))
        for k, number in enumerate(slides, 1):
            root, parts = _xml(z, f"ppt/slides/slide{number}.xml"), []
            tables = list(root.iter(f"{_A}tbl"))
            inside = {p for t in tables for p in t.iter(f"{_A}p")}
            parts += [s for p in root.iter(f"{_A}p") if p not in inside and (s := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip())]
            for row in (r for t in tables for r in t.iter(f"{_A}tr")):
                if cells := [s for c in row.iter(f"{_A}tc") if (s := "".join(t.text or "" for t in c.iter(f"{_A}t")).strip())]:
                    parts.append(" | ".join(cells))
            if f"ppt/notesSlides/notesSlide{number}.xml" in names:
                notes = " ".join(t.text or "" for t in _xml(z, f"ppt/notesSlides/notesSlide{number}.xml").iter(f"{_A}t")).strip()
                parts += [f"Notes: {notes}"] if notes else []
            if parts:
                out.append(("\n".join(parts), k))
    return out


def read_pdf(data: bytes, ocr: Callable[[bytes, list[int]], list[tuple[str, int]]] | None = None) -> list[tuple[str, int]]:
    """Texts of pages in order; pages with hardly any text go to ocr, OCR_MAX_PAGES of them at most."""
    from pypdf import PdfReader

    read, poor = [], []
    for k, page in enumerate(PdfReader(io.BytesIO(data)).pages, 1):
        text = page.extract_text() or ""
        if len("".join(text.split())) < schema.OCR_MIN_CHARS:
            poor.append(k)
        else:
            read.append((text, k))
    if ocr is not None and poor:
        read += [(t, k) for t, k in ocr(data, poor[: schema.OCR_MAX_PAGES]) if t.strip()]
    return sorted(read, key=lambda x: x[1])


def read_bytes(name: str, data: bytes, ocr=None) -> list[tuple[str, int]]:
    suffix = name[name.rfind(".") :].lower()
    if suffix == ".pdf":
        return read_pdf(data, ocr)
    reader = {".docx": read_docx, ".xlsx": read_xlsx, ".pptx": read_pptx}.get(suffix)
    return reader(data) if reader else [(data.decode("utf-8", "replace"), 1)]


def read_documents(files: DataFrame, ocr=None) -> DataFrame:
    """(path, digest, page, text, error): one row per page, sheet or slide; a file that can't be read has one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, digest, content in zip(batch["path"].to_pylist(), batch["digest"].to_pylist(), batch["content"], strict=True):
                try:
                    rows = [(t, p, None) for t, p in read_bytes(path, content.as_py(), ocr)]
                except Exception as error:  # a bad file never ends the run
                    rows = [(None, None, f"{type(error).__name__}: {error}")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([digest] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["path", "digest", "page", "text", "error"])

    rows = files if "digest" in files.columns else digested(files)
    return rows.select("path", "digest", "content").mapInArrow(run, "path string, digest string, page int, text string, error string")


def dated(files: DataFrame) -> DataFrame:
    """(path, date, date_source): the day that an Office file or a PDF names itself, else the file system's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                day, data = None, content.as_py()
                if re.search(r"\.(docx|xlsx|pptx)$", path, re.IGNORECASE) and zipfile.is_zipfile(io.BytesIO(data)):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        if "docProps/core.xml" in z.namelist() and (m := re.search(rb"<dcterms:created[^>]*>(\d{4}-\d\d-\d\d)", z.read("docProps/core.xml"))):
                            day = m[1].decode()
                elif path.lower().endswith(".pdf") and (m := re.search(rb"/CreationDate\s*\(D:(\d{4})(\d\d)(\d\d)", data)):
                    day = b"-".join(m.groups()).decode()
                days.append(day)
            yield pa.RecordBatch.from_arrays([batch["path"], batch["modificationTime"], pa.array(days, pa.string())], ["path", "modificationTime", "own"])

    rows = files.select("path", "modificationTime", "content").mapInArrow(run, "path string, modificationTime timestamp, own string")
    day = F.date_format("modificationTime", "yyyy-MM-dd")
    return rows.select("path", F.coalesce("own", day).alias("date"), F.when(F.col("own").isNotNull(), "document").otherwise("filesystem").alias("date_source"))
