"""Receipt files: the text of PDF files and, by an OCR library, of images; text boxes as lines."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import receipts

#: Characters of text from which a PDF file counts as more than a scan.
LEAST_TEXT = 20
#: Left edge, middle, height and text of a piece of text in an image.
Box = tuple[float, float, float, str]


def pdf_text(content: bytes) -> str:
    """The text that a PDF file holds, page by page."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf library, which is not installed") from e
    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)


def ocr_boxes(content: bytes) -> list[Box]:
    """The pieces of text that an OCR library finds in an image."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("reading images needs the pytesseract and Pillow libraries, which are not installed") from e
    found = pytesseract.image_to_data(Image.open(io.BytesIO(content)), output_type=pytesseract.Output.DICT)
    return [(x, y + h / 2, h, t) for x, y, h, t in zip(found["left"], found["top"], found["height"], found["text"], strict=True) if t.strip()]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def file_texts(files: DataFrame, from_pdf: Callable[[bytes], str] = pdf_text, from_image: Callable[[bytes], list[Box]] = ocr_boxes) -> DataFrame:
    """(path, text, problem) of files (path, content): text files as they are, PDF files by their text, images by OCR.

    problem says why a file has no text: a missing library, a scan within a PDF file, or a file that cannot be read. A
    file's fault never stops the others.
    """

    @F.pandas_udf("text string, problem string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            rows = []
            for content in contents:
                data = bytes(content) if content is not None else b""
                try:
                    if data[:5] == b"%PDF-":
                        text = from_pdf(data)
                        rows.append((text, None) if len(text.strip()) >= LEAST_TEXT else (None, "a PDF file of scans: save its pages as images"))
                    elif data[:2] == b"\xff\xd8" or data[:8] == b"\x89PNG\r\n\x1a\n":
                        rows.append((receipts.assembled(from_image(data)), None))
                    else:
                        rows.append((data.decode("utf-8"), None))
                except Exception as e:
                    rows.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["text", "problem"])

    return files.select("path", read("content").alias("r")).select("path", "r.*")


def box_lines(boxes: DataFrame) -> DataFrame:
    """(path, text) of text boxes (path, left, middle, height, text): boxes of one line from left to right, lines
    downward. An image's boxes come together in one task; they are few."""

    def joined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["left", "middle", "height", "text"]].itertuples(index=False, name=None))
        return pd.DataFrame({"path": [key[0]], "text": [receipts.assembled(rows)]})

    return boxes.groupBy("path").applyInPandas(joined, "path string, text string")


def file_fields(files: DataFrame, day_first: bool = True, **readers) -> DataFrame:
    """(path, problem, and the invoice fields) of receipt files."""
    rows = file_texts(files, **readers)
    return rows.select("path", "problem", receipts.fields(F.col("text"), day_first).alias("f")).select("path", "problem", "f.*")
