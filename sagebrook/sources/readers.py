"""Readers of documents, data sets and question sets."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title_of

TEXT_TYPES = ("txt", "text", "md", "markdown")
#: A folder that repeats what others hold.
DUPLICATE_FOLDER = "All docs"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

ENTITIES = "id string, type string, name string, properties map<string,string>"
RELATIONSHIPS = "id string, source_id string, target_id string, type string, properties map<string,string>"
RULES = "id string, name string, type string, expression struct<condition:string>, description string, priority int, applies_to array<string>"
DOCUMENTS = "id string, type string, title string, content string, metadata map<string,string>"
QUESTION = "id string, question string, expected_answer string, category string, difficulty string"


def docx_text(data: bytes) -> str:
    """The non-blank paragraphs of a word-processor file, one per line."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))
    return "\n".join(p for p in paragraphs if p.strip())


def pdf_text(data: bytes) -> str:
    """The pages of a PDF, with blank lines between them; needs the pypdf package."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package") from e
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def _decoded(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows = []
    for content, suffix in zip(data, kind):
        try:
            if suffix in TEXT_TYPES:
                rows.append((content.decode("utf-8"), None))
            elif suffix == "docx":
                rows.append((docx_text(content), None))
            elif suffix == "pdf":
                rows.append((pdf_text(content), None))
            else:
                rows.append((None, f"unsupported file type: {suffix}"))
        except Exception as e:  # noqa: BLE001 - a bad file is a row of errors, not of a job
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["text", "error"])


def read_documents(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(document_id, title, document_type, path, text, error) of the files at a path.

    Ids depend on file names, so a file keeps its id; an unknown type is a row with an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    read = files.select("path", name.alias("name"), suffix.alias("kind"), F.pandas_udf(_decoded, "struct<text:string,error:string>")("content", suffix).alias("r"))
    return read.select(
        F.md5("name").alias("document_id"), title_of(F.col("path")).alias("title"), F.col("kind").alias("document_type"), "path", F.col("r.text").alias("text"), F.col("r.error").alias("error")
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All markdown files below a folder; the folder of duplicates only where it is the root."""
    docs = read_documents(spark, path, "*.md", recursive=True)
    if path.rstrip("/").endswith(DUPLICATE_FOLDER):
        return docs
    marked = F.replace(F.col("path"), F.lit("%20"), F.lit(" "))
    return docs.filter(~F.contains(marked, F.lit(f"/{DUPLICATE_FOLDER}/")))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def documents_of(spark: SparkSession, payload: list[dict]) -> DataFrame:
    """Documents handed over as objects."""
    return spark.createDataFrame([{k: d.get(k) for k in ("id", "type", "title", "content", "metadata")} for d in payload], DOCUMENTS)


def _questions(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "question", F.col("expected_answer").alias("expected"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("difficulty", F.lit("")).alias("difficulty")
    )


def read_questions_json(spark: SparkSession, path: str) -> DataFrame:
    """Questions under the key ``questions``, or a bare array of them."""
    wrapped = spark.read.schema(f"questions array<struct<{','.join(':'.join(p.split()) for p in QUESTION.split(', '))}>>").json(path, multiLine=True)
    inner = wrapped.filter("questions is not null").select(F.explode("questions").alias("q")).select("q.*")
    bare = read_json(spark, path, QUESTION).filter("question is not null")
    return _questions(inner.unionByName(bare))


def read_questions_array(spark: SparkSession, path: str) -> DataFrame:
    return _questions(read_json(spark, path, QUESTION))


def read_questions_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Blocks under ``### Q<n>`` with bold Question, Answer, Type and Difficulty lines; a block
    counts only with a question and an answer."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.posexplode(F.split("value", r"(?m)^### Q(?=\d)")).alias("pos", "block")).filter("pos > 0")

    def field(name: str, what: str = ".+"):
        found = F.trim(F.regexp_extract("block", rf"\*\*{name}:\*\*\s*({what})", 1))
        return F.when(found != "", found)

    rows = blocks.select(
        F.regexp_extract("block", r"^(\d+)", 1).alias("id"),
        field("Question").alias("question"),
        field("Answer").alias("expected_answer"),
        field("Type", r"\w+").alias("category"),
        field("Difficulty", r"\w+").alias("difficulty"),
    )
    return _questions(rows.filter("question is not null and expected_answer is not null"))


QUESTION_READERS = {"json_questions": read_questions_json, "json_array": read_questions_array, "markdown": read_questions_markdown}


def read_questions(spark: SparkSession, path: str, format_: str) -> DataFrame:
    if format_ not in QUESTION_READERS:
        raise ValueError(f"unknown question format: {format_}")
    return QUESTION_READERS[format_](spark, path)


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


