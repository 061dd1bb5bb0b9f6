"""File contents to blocks: plain text, Markdown, DOCX; others can be registered."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.files import check_archive

# (type, text, section path) or, where pages are known, (type, text, section path, page number).
Block = tuple[str, str, list[str]] | tuple[str, str, list[str], int]
PARSED = "source_path string, sequence int, block_type string, text string, section_path array<string>, page_number int, error string"
# What a document without text becomes.
EMPTY, EMPTY_DOCX = "(empty document)", "(empty docx document)"


def decode(data: bytes) -> str:
    """By byte order mark, else as UTF-8, else as the Korean code page if it fits, else UTF-8 with replacements."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    for name in ("utf-8", "cp949"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def parse_text(data: bytes) -> list[Block]:
    text = decode(data).replace("\r\n", "\n").replace("\r", "\n")
    return [("paragraph", p.strip(), []) for p in text.split("\n\n") if p.strip()] or [("paragraph", EMPTY, [])]


def parse_markdown(data: bytes) -> list[Block]:
    """Fences, headings with their path, runs of list items, paragraphs."""
    out: list[Block] = []
    path: list[tuple[int, str]] = []
    held: list[str] = []
    kind = "paragraph"
    fence = False

    def flush() -> None:
        nonlocal held
        text = (" " if kind == "paragraph" else "\n").join(held)
        text = text.strip("\n") if kind == "code" else text.strip()  # the indentation of code stays
        if text.strip():
            out.append((kind, text, [t for _, t in path]))
        held = []

    for line in decode(data).splitlines():
        if line.strip().startswith("```"):
            flush()
            fence, kind = not fence, "paragraph" if fence else "code"
            continue
        if fence:
            held.append(line)
            continue
        heading = re.match(r"^(#{1,6})\s+(.+)$", line.strip())
        item = re.match(r"^\s*([*+-]|\d+\.)\s+", line)
        now = "list" if item else "paragraph"
        if heading or not line.strip() or now != kind:
            flush()
        kind = now
        if heading:
            level = len(heading[1])
            path = [x for x in path if x[0] < level] + [(level, heading[2].strip())]
            out.append(("title" if level == 1 else "heading", heading[2].strip(), [t for _, t in path]))
        elif line.strip():
            held.append(line.strip())
    flush()
    return out or [("paragraph", EMPTY, [])]


def parse_docx(data: bytes) -> list[Block]:
    """Paragraphs, headings and tables of a DOCX body, in order; an archive beyond the limits is an error."""
    check_archive(data)
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    out: list[Block] = []
    path: list[str] = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    for e in body if body is not None else []:
        if e.tag == f"{w}p" and text(e):
            style = e.find(f"{w}pPr/{w}pStyle")
            level = re.match(r"Heading\s*(\d)", style.get(f"{w}val", "") if style is not None else "")
            if level:
                path = [*path[: int(level[1]) - 1], text(e)]
            out.append(("heading" if level else "paragraph", text(e), list(path)))
        elif e.tag == f"{w}tbl":
            rows = [" | ".join(text(c).replace("\n", " ") for c in r.iter(f"{w}tc")) for r in e.iter(f"{w}tr")]
            out.append(("table", "\n".join(rows), list(path)))
    return out or [("paragraph", EMPTY_DOCX, [])]


def parse_pdf(data: bytes) -> list[Block]:
    """The parts of every page with its number, and headings: short lines in capitals or that start with a digit. Needs the pypdf package."""
    import pypdf

    out: list[Block] = []
    path: list[str] = []
    reader = pypdf.PdfReader(io.BytesIO(data))
    if reader.is_encrypted and not reader.decrypt(""):
        raise ValueError("the file is encrypted")
    for number, page in enumerate(reader.pages, 1):
        for part in (page.extract_text() or "").split("\n\n"):
            line = part.strip()
            if not line:
                continue
            heading = len(line) < 100 and "\n" not in line and (line.isupper() or line[0].isdigit())
            path = [line] if heading else path
            out.append(("heading" if heading else "paragraph", line, list(path), number))
    return out or [("paragraph", EMPTY, [])]


PARSERS: dict[str, Callable[[bytes], list[Block]]] = {".txt": parse_text, ".md": parse_markdown, ".markdown": parse_markdown, ".docx": parse_docx, ".pdf": parse_pdf}


def parse_files(files: DataFrame, parsers: dict[str, Callable[[bytes], list[Block]]] | None = None) -> DataFrame:
    """One row for each block of (source_path, file_type, content); a file that fails gives one row with ``error``.

    Where ``files`` has ``md5_hash``, content with another hash has changed since it was listed and is an error, so that
    a hash always belongs to the blocks.
    """
    known = dict(PARSERS if parsers is None else parsers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, kind, data, stable in zip(pdf["source_path"], pdf["file_type"], pdf["content"], pdf["stable"]):
                error = None if stable else "changed while it was read"
                error = error if kind in known else f"unsupported file type {kind}"
                try:
                    blocks = known[kind](bytes(data)) if error is None else []
                    rows += [(path, i, *b[:3], b[3] if len(b) > 3 else None, None) for i, b in enumerate(blocks)]
                except Exception as e:  # one bad file must not stop the others
                    error = f"{type(e).__name__}: {e}"[:500]
                if error is not None:
                    rows.append((path, 0, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=["source_path", "sequence", "block_type", "text", "section_path", "page_number", "error"]).astype({"page_number": "Int32"})

    stable = F.md5("content") == F.col("md5_hash") if "md5_hash" in files.columns else F.lit(True)
    return files.select("source_path", F.lower("file_type").alias("file_type"), "content", stable.alias("stable")).mapInPandas(run, PARSED)
