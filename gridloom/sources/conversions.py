"""What a file is by its name or its type, what it can become, and documents turned into text, DOCX or PDF."""

from __future__ import annotations

import mimetypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import files, pdf

# Extensions by category, what documents, images and sounds can become, formats known but not converted.
EXTENSIONS = {
    "DOCUMENT": ("txt", "text", "pdf", "docx"),
    "IMAGE": ("jpg", "jpeg", "png", "webp", "bmp", "gif", "heic", "heif"),
    "AUDIO": ("mp3", "wav", "m4a", "aac", "ogg", "oga", "flac", "wma", "opus", "amr"),
    "VIDEO": ("mp4", "mov", "mkv", "webm", "avi", "3gp", "3gpp", "3g2", "m4v"),
}
TARGETS = {"DOCUMENT": ("txt", "pdf", "docx"), "IMAGE": ("jpg", "png", "webp", "bmp"), "AUDIO": ("wav", "m4a"), "VIDEO": ("m4a",)}
NOT_CONVERTED = {
    "doc": "Word 97–2003 (.doc)", "rtf": "Rich Text (.rtf)", "odt": "OpenDocument Text (.odt)", "pages": "Apple Pages", "xls": "Excel 97–2003 (.xls)",
    "xlsx": "Excel spreadsheet — try the Excel/CSV tool", "xlsm": "Excel spreadsheet — try the Excel/CSV tool", "csv": "CSV spreadsheet — try the Excel/CSV tool", "tsv": "TSV spreadsheet — try the Excel/CSV tool",
    "ods": "OpenDocument Spreadsheet (.ods)", "numbers": "Apple Numbers", "ppt": "PowerPoint 97–2003 (.ppt)", "pptx": "PowerPoint (.pptx)", "odp": "OpenDocument Presentation (.odp)", "key": "Apple Keynote",
    "epub": "EPUB e-book", "zip": "ZIP archive", "rar": "RAR archive", "7z": "7-Zip archive", "apk": "Android app package (.apk)",
}
# End of fixed values.
CATEGORY = {e: c for c, row in EXTENSIONS.items() for e in row}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.coalesce(key, F.lit("")))


def detected(extension: Column, mime: Column) -> Column:
    """struct(category, extension, unsupported): by the extension, else by that of the type, else by the type's kind.

    Formats that are known but not converted have their name as ``unsupported``; nulls count as empty.
    """
    own = F.lower(F.trim(F.coalesce(extension, F.lit(""))))
    kind = F.trim(F.split_part(F.lower(F.trim(F.coalesce(mime, F.lit("")))), F.lit(";"), F.lit(1)))
    known = {m: e[1:] for m in dict.fromkeys(mimetypes.types_map.values()) if (e := mimetypes.guess_extension(m)) and (e[1:] in CATEGORY or e[1:] in NOT_CONVERTED)}
    recovered = _looked_up(known, kind)
    by_kind = F.when((kind == "text/plain") | (kind == "application/pdf") | F.contains(kind, F.lit("wordprocessingml")), "DOCUMENT")
    for c in ("IMAGE", "AUDIO", "VIDEO"):
        by_kind = by_kind.when(kind.startswith(f"{c.lower()}/"), c)
    named, found = _looked_up(CATEGORY, own), _looked_up(CATEGORY, recovered)
    return F.struct(
        F.coalesce(named, found, by_kind, F.lit("UNKNOWN")).alias("category"),
        F.when(named.isNotNull(), own).when(found.isNotNull(), recovered).when(by_kind.isNotNull(), F.coalesce(recovered, own)).otherwise(own).alias("extension"),
        F.when(named.isNull() & found.isNull() & by_kind.isNull(), F.coalesce(_looked_up(NOT_CONVERTED, own), _looked_up(NOT_CONVERTED, recovered))).alias("unsupported"),
    )


def targets(category: str, extension: str) -> list[str]:
    """What a file can become: not what it is."""
    own = {"jpeg": "jpg"}.get(extension.lower(), extension.lower())
    return [t for t in TARGETS.get(category, ()) if t != own or category == "VIDEO"]


def document_text(data: bytes, extension: str) -> str:
    if extension == "pdf":
        return "\n".join(pdf.page_texts(data))
    return files.docx_text(data) if extension == "docx" else files.decode_text(data)


def convert(spark: SparkSession, path: str, target: str, folder: str) -> DataFrame:
    """Turn the documents under ``path`` into ``target`` (txt, docx, pdf) files in ``folder``, all tasks at work.

    Gives (path, output, replaced, error): letters that PDF does not have are replaced; a file that cannot be read, has no text
    or is no document has an error and no output. Tasks write the files. Files of one name in several
    folders get a part of the path's digest.
    """
    if target not in TARGETS["DOCUMENT"]:
        raise ValueError(f"{target} is no document format")

    def made(data: bytes, extension: str) -> tuple[bytes, int]:
        text = document_text(data, extension)
        if not text.strip():
            raise ValueError("no text")
        if target == "pdf":
            return pdf.text_pdf(text)
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        return (files.docx_bytes(lines) if target == "docx" else text.encode()), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, extension, category, content in zip(*(c.to_pylist() for c in batch.columns)):
                data, replaced, error = None, 0, None
                try:
                    if category != "DOCUMENT":
                        raise ValueError("not a document")
                    data, replaced = made(content, extension)
                except Exception as e:  # one file's error is its own result
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([data], pa.binary()), pa.array([replaced], pa.int32()), pa.array([error], pa.string())], names=["path", "data", "replaced", "error"])

    found = spark.read.format("binaryFile").load(path).withColumn("d", detected(F.regexp_extract("path", r"\.([^./]*)\z", 1), F.lit(None).cast("string")))
    done = cut(found.select("path", "d.extension", "d.category", "content").mapInArrow(run, "path string, data binary, replaced int, error string"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    often = done.where("data is not null").groupBy(stem.alias("stem")).agg(F.count("*").alias("n")).where("n > 1").select("stem", F.lit(True).alias("often"))
    named = done.withColumn("stem", stem).join(often, "stem", "left")
    name = F.concat("stem", F.when(F.col("often"), F.concat(F.lit("-"), F.left(F.sha2("path", 256), F.lit(12)))).otherwise(""), F.lit(f".{target}"))
    named = cut(named.select("path", F.when(F.col("data").isNotNull(), name).alias("output"), "data", "replaced", "error"))
    files.put_files(named.where("data is not null").select(F.col("output").alias("name"), "data"), folder)
    return named.drop("data")
