"""Texts of resumes in files: plain text, DOCX and PDF, from spark.read.format("binaryFile") or any table of bytes.

Bytes are read in an Arrow UDF; what is left is cleaned and judged by column expressions (see operators.resume).
"""

from __future__ import annotations

import re
import zipfile
import zlib
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators import resume

from . import pdf

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# A run of seven words or more in the open bytes of a file.
_RUNS = re.compile(r"[A-Za-z0-9@._+()&,:%$#'\"][A-Za-z0-9@._+\-/()&,:%$#'\"]{1,}(?:\s+[A-Za-z0-9@._+\-/()&,:%$#'\"]{2,}){6,}")


def docx_text(data: bytes) -> str:
    """The paragraphs of a document, a line each. A file that is none raises ValueError."""
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error) as e:
        raise ValueError(f"not a DOCX file: {e}") from e
    lines = ["".join(t.text or "" for t in p.iter(f"{W}t")).strip() for p in root.iter(f"{W}p")]
    return "\n".join(x for x in lines if x) or " ".join(t.text or "" for t in root.iter(f"{W}t"))


def pdf_texts(data: bytes) -> list[str]:
    """What several ways of reading a PDF find: its pages as they are laid out and in the order of showing, all streams
    that show text, operators in the open, runs of readable words."""
    document = pdf.Document(data)
    pages = pdf.page_pieces(document)
    out = ["\n".join(pdf.laid_out(p) for p in pages), "\n".join(pdf.flow(p) for p in pages), pdf.flow(pdf.stray_pieces(document))]
    if b"BT" in data:
        out.append(pdf.flow(list(pdf.Interpreter().run(data))))
    return [*out, " ".join(_RUNS.findall(data.decode("latin-1")))]


def kind_of(path: Column, mime: Column | None = None) -> Column:
    p, m = F.lower(path), F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")
    return (
        F.when(p.endswith(".txt") | m.contains("text/plain"), "txt").when(p.endswith(".docx") | m.contains("officedocument.wordprocessingml.document"), "docx")
        .when(p.endswith(".pdf") | m.contains("pdf"), "pdf").otherwise("txt")
    )


def _read(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = []
    for k, data in zip(kind, content, strict=True):
        data = bytes(data) if data is not None else b""
        try:
            rows.append(([docx_text(data)] if k == "docx" else pdf_texts(data) if k == "pdf" else [data.decode("utf-8", "replace")], None))
        except ValueError as e:
            rows.append(([], str(e)))
    return pd.DataFrame(rows, columns=["texts", "error"])


def resume_texts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files with their kind, text, and what went wrong (null text) where it did."""
    read = F.pandas_udf(_read, "texts array<string>, error string")
    df = files.withColumn("kind", kind_of(F.col(path))).withColumn("_r", read("kind", content))
    pdf = resume.best_text(F.transform("_r.texts", resume.sanitize_pdf))
    text = F.when(F.col("_r.error").isNotNull(), None).when(F.col("kind") == "pdf", F.nullif(pdf, F.lit(""))).otherwise(resume.normalize_resume(F.get("_r.texts", F.lit(0))))
    df = df.withColumn("text", text)
    error = F.coalesce("_r.error", F.when(F.col("text").isNull(), F.lit("no readable text")))
    return df.withColumn("error", error).drop("_r", content)


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    return resume_texts(spark.read.format("binaryFile").load(path).select("path", "content"))
