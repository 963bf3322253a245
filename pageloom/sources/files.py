"""Files that hold tables or texts inside: zip members, spreadsheets, mailboxes, JSON pages. A file is
read by one task; many files are read in parallel."""

from __future__ import annotations

import email
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession


def _each_file(spark: SparkSession, path: str, schema: str, f: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    def run(batches):
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                rows = list(f(p, content))
                if rows:
                    yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def zip_member(spark: SparkSession, path: str, member: int = 0, encoding: str = "latin-1") -> DataFrame:
    """(path, name, text) of one member of each archive; a broken archive gives nothing."""

    def f(p: str, content: bytes):
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
            name = z.namelist()[member]
        except (zipfile.BadZipFile, IndexError):
            return
        yield {"path": p, "name": name, "text": z.read(name).decode(encoding, "replace")}

    return _each_file(spark, path, "path string, name string, text string", f)


def _cells(p: str, sheet: int, rows: Iterator[list[str]]):
    for i, r in enumerate(rows):
        yield {"path": p, "sheet": sheet, "row": i, "cells": r}


def xlsx_sheet(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """(path, sheet, row, cells) of a sheet of each workbook."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def f(p: str, content: bytes):
        z = zipfile.ZipFile(io.BytesIO(content))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        names = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        if sheet >= len(names):
            return

        def rows():
            for r in ElementTree.fromstring(z.read(names[sheet])).iter(f"{ns}row"):
                out = []
                for c in r.iter(f"{ns}c"):
                    v = c.find(f"{ns}v")
                    inline = c.find(f"{ns}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{ns}t")) if inline is not None else (v.text or "" if v is not None else "")
                    out.append(shared[int(text)] if c.get("t") == "s" and text else text)
                yield out

        yield from _cells(p, sheet, rows())

    return _each_file(spark, path, "path string, sheet int, row int, cells array<string>", f)


def ods_sheet(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """(path, sheet, row, cells) of a sheet of each document; repeated cells are repeated."""
    table, text = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"

    def f(p: str, content: bytes):
        tables = list(ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("content.xml")).iter(f"{table}table"))
        if sheet >= len(tables):
            return

        def rows():
            for r in tables[sheet].iter(f"{table}table-row"):
                out = []
                for c in r.iter(f"{table}table-cell"):
                    v = "\n".join("".join(x.itertext()) for x in c.iter(f"{text}p"))
                    out += [v] * (int(c.get(f"{table}number-columns-repeated", "1")) if v else 1)
                yield out

        yield from _cells(p, sheet, rows())

    return _each_file(spark, path, "path string, sheet int, row int, cells array<string>", f)


def mails(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, sender, subject, date, body) of mailboxes."""

    def f(p: str, content: bytes):
        for i, raw in enumerate(re.split(rb"(?:\A|\r?\n\r?\n)From [^\n]*\n", content)[1:]):
            m = email.message_from_bytes(raw)
            part = next((x for x in m.walk() if x.get_content_type() == "text/plain"), m)
            body = part.get_payload(decode=True)
            yield {"path": p, "position": i, "sender": m["from"], "subject": m["subject"], "date": m["date"], "body": (body or b"").decode(part.get_content_charset() or "utf-8", "replace")}

    return _each_file(spark, path, "path string, position int, sender string, subject string, date string, body string", f)


def json_pages(spark: SparkSession, path: str, base: list | None = None) -> DataFrame:
    """(path, metadata) of JSON files: the text leaves below a path of keys, under joined names."""
    from pageloom.sources.dumps import json_tree

    def f(p: str, content: bytes):
        try:
            v = json.loads(content)
            for k in base or []:
                v = v[k]
        except (ValueError, KeyError, IndexError, TypeError):
            return
        yield {"path": p, "metadata": json_tree(v)}

    return _each_file(spark, path, "path string, metadata map<string,string>", f)
