"""Files through Spark's own file systems: discovery, PDF parsing, a root-confined browser, JSON tables, snapshots.

Nothing here opens a path in Python: listings, reads and writes go through Spark or Hadoop file systems, so
paths may lie in any store that the session can reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# Limits of the browser and of a page that counts as text, and suffixes of files that it reads.
MOST_ENTRIES, MOST_BYTES, LEAST_BYTES = 500, 50_000, 1_000
LEAST_LETTERS = 25
HEADING_LINES = 16
TEXT_SUFFIXES = [".cfg", ".csv", ".env.example", ".ini", ".json", ".log", ".md", ".py", ".ps1", ".toml", ".txt", ".yaml", ".yml"]

PAGES = "doc_id string, source_path string, title string, page_count int, checksum string, page_number int, text string"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def discovered(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """(path, modificationTime, length, content): the one file, which must have the suffix, or all below a folder.

    Only columns that are asked for are read, so a listing reads no content.  Order by path for a sorted list."""
    fs, where = _fs(spark, path)
    if fs.getFileStatus(where).isFile() and not path.lower().endswith(suffix):
        raise ValueError(f"{path} is not a {suffix} file")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.filter(F.lower("path").endswith(suffix))


def pypdf_reader(content: bytes) -> tuple[str, list[str]]:
    """Title and page texts of a PDF, if pypdf is installed."""
    import io

    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(content))
    return getattr(reader.metadata, "title", None) or "", [page.extract_text() or "" for page in reader.pages]


def parsed(found: DataFrame, reader: Callable[[bytes], tuple[str, list[str]]] = pypdf_reader, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """(doc_id, source_path, title, page_count, checksum, page_number, text) of the pages of discovered files.

    reader: content to title and page texts; the file's stem stands in for an empty title.  ocr: content and page number to the text of a
    page that has too little; a failure leaves it empty.  doc_id is the start of the content's sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.string()), ("source_path", pa.string()), ("title", pa.string()), ("page_count", pa.int32()), ("checksum", pa.string()), ("page_number", pa.int32()), ("text", pa.string())]
        for batch in batches:
            for path, checksum, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                title, pages = reader(content)
                if ocr is not None:
                    pages = [t if _searchable(t) else _attempt(ocr, content, i) for i, t in enumerate(pages, 1)]
                title = title or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows = [(checksum[:16], path, title, len(pages), checksum, i, t) for i, t in enumerate(pages, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return found.select("path", F.sha2("content", 256).alias("checksum"), "content").mapInArrow(run, PAGES)


def _searchable(page: str) -> bool:
    return sum(not c.isspace() for c in page) >= LEAST_LETTERS


def _attempt(ocr: Callable[[bytes, int], str], content: bytes, page: int) -> str:
    try:
        return ocr(content, page) or ""
    except Exception:
        return ""


def with_sections(pages: DataFrame, refuse: bool = True) -> DataFrame:
    """Pages with section_title: the first heading among a page's first lines, else that of the page before.

    A document without a page that can be searched is refused: an error, or without ``refuse`` pages without a title
    and with the reason in column refused, which is null for others."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    ends = F.transform(lines, text.is_terminal)
    before_end = F.when(F.array_position(ends, True) > 0, F.slice(lines, 1, F.greatest(F.array_position(ends, True).cast("int") - 1, F.lit(0)))).otherwise(lines)
    clean = F.slice(F.filter(before_end, lambda x: ~text.is_boilerplate(x)), 1, HEADING_LINES)
    heading = F.get(F.filter(clean, text.is_heading), F.lit(0))
    own = Window.partitionBy("doc_id")
    letters = F.length(F.regexp_replace("text", r"\s+", ""))
    filled = pages.withColumns({"heading": heading, "most": F.max(letters).over(own)})
    why = F.concat(F.lit("no text that can be searched in "), F.col("doc_id"))
    title = F.last("heading", ignorenulls=True).over(own.orderBy("page_number"))
    good = F.coalesce(F.col("most") >= LEAST_LETTERS, F.lit(False))
    if refuse:
        return filled.withColumn("section_title", F.when(good, title).otherwise(F.raise_error(why))).drop("heading", "most")
    return filled.withColumn("section_title", F.when(good, title)).withColumn("refused", F.when(~good, why)).drop("heading", "most")


def listed(spark: SparkSession, root: str, path: str = "", limit: int = 100) -> DataFrame:
    """(name, is_dir, size_bytes, modified_at) of a folder below ``root``: folders first, by name, hidden ones left out."""
    fs, where = _fs(spark, _inside(root, path))
    rows = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if not name.startswith("."):
            rows.append((name, status.isDirectory(), int(status.getLen()), int(status.getModificationTime())))
    rows.sort(key=lambda r: (not r[1], r[0].lower()))
    kept = spark.createDataFrame(rows[: min(MOST_ENTRIES, max(1, limit))], "name string, is_dir boolean, size_bytes long, at long")
    return kept.select("name", "is_dir", "size_bytes", F.timestamp_millis("at").alias("modified_at"))


def read_text(spark: SparkSession, root: str, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, size_bytes, returned_bytes, truncated, content) of a text file below ``root``: its first bytes, undecodable ones replaced."""
    name = path.rsplit("/", 1)[-1].lower()
    if any(part.startswith(".") for part in path.split("/")) or name in text.fixed.SENSITIVE_FILES or name.endswith(tuple(text.fixed.SENSITIVE_SUFFIXES)):
        raise PermissionError("hidden or sensitive files are not readable")
    if "." in name and not name.endswith(tuple(TEXT_SUFFIXES)):
        raise ValueError("only files of text are readable")
    width = min(MOST_BYTES, max(LEAST_BYTES, most))
    found = spark.read.format("binaryFile").load(_inside(root, path))
    body = F.substring("content", 1, width)
    return found.select(F.lit(path).alias("path"), F.col("length").alias("size_bytes"), F.length(body).cast("long").alias("returned_bytes"), (F.col("length") > width).alias("truncated"), F.make_valid_utf8(body.cast("string")).alias("content"))


def file_info(spark: SparkSession, root: str, path: str) -> DataFrame:
    status = _fs(spark, _inside(root, path))
    status = status[0].getFileStatus(status[1])
    row = [(path, status.isDirectory(), status.isFile(), int(status.getLen()), int(status.getModificationTime()))]
    return spark.createDataFrame(row, "path string, is_dir boolean, is_file boolean, size_bytes long, at long").withColumn("modified_at", F.timestamp_millis("at")).drop("at")


def _inside(root: str, path: str) -> str:
    parts: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not parts:
                raise PermissionError("the path is outside the root")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join([root.rstrip("/"), *parts])


_POINTER = "_current"


def _put(spark: SparkSession, path: str, body: str) -> None:
    """Write a small file under another name and move it over ``path`` in one step."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    fs, where = _fs(spark, fresh)
    out = fs.create(where, True)
    out.write(bytearray(body.encode()))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(where, jvm.org.apache.hadoop.fs.Path(path), over)


def _get(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return ""
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions of a published table, oldest first; those that were begun and not finished are none."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("v") and exists(spark, f"{path}/{n}/_SUCCESS"))


def current(spark: SparkSession, path: str) -> str | None:
    """The version that readers of a published table see now."""
    return _get(spark, f"{path.rstrip('/')}/{_POINTER}") or None


def publish(df: DataFrame, path: str, kind: str = "json") -> str:
    """Write ``df`` as a new version of the table at ``path`` and return the version's name.

    The version is whole before the pointer to it is swapped, in one step and last; the versions before it stay. A reader
    sees the old table or the new one, and a writer that fails leaves the old one."""
    spark, path = df.sparkSession, path.rstrip("/")
    numbers = [int(v[1:9]) for v in versions(spark, path)]
    name = f"v{max(numbers, default=0) + 1:08d}-{uuid.uuid4().hex[:8]}"
    df.write.format(kind).save(f"{path}/{name}")
    _put(spark, f"{path}/{_POINTER}", name)
    return name


def restore_version(spark: SparkSession, path: str, version: str) -> None:
    """Point readers of a published table at one of its versions."""
    if version not in versions(spark, path):
        raise ValueError(f"{path} has no version {version}")
    _put(spark, f"{path.rstrip('/')}/{_POINTER}", version)


def logged(spark: SparkSession, path: str, entry: dict) -> None:
    """Add a line to a log of jobs: a file of its own, named by time, so writers do not meet and no line is half there."""
    import json
    import time

    _put(spark, f"{path.rstrip('/')}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.jsonl", json.dumps(entry, sort_keys=True) + "\n")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, version: str | None = None) -> DataFrame:
    """A JSON array, lines of JSON, or a published table (its current version, or the one given), by a declared schema; no file is an empty table."""
    version = version or current(spark, path)
    if version is not None:
        return spark.read.schema(schema).json(f"{path.rstrip('/')}/{version}")
    if not exists(spark, path):
        return spark.createDataFrame([], schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema))
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` by ``df``, for readers of ``read_json``: see ``publish``."""
    publish(df, path)


def backed_up(spark: SparkSession, tables: dict[str, DataFrame], folder: str, created_at: str) -> str:
    """Write each table and a description below a new folder and return its path; the description comes last, as a sign that all is there."""
    home = f"{folder.rstrip('/')}/{created_at.replace(':', '')}-{uuid.uuid4().hex[:8]}"
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{home}/{name}")
    rows = [json.dumps({"path": home, "created_at": created_at, "tables": sorted(tables)})]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{home}/metadata")
    return home


def backups(spark: SparkSession, folder: str) -> DataFrame:
    """(path, created_at, tables) of whole backups, the newest first."""
    schema = "path string, created_at string, tables array<string>"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.txt").json(folder)
    return found.orderBy(F.desc("created_at"), F.desc("path"))


def restored(spark: SparkSession, home: str) -> dict[str, DataFrame]:
    names = backups(spark, home).select("tables").first()
    if names is None:
        raise FileNotFoundError(f"no whole backup at {home}")
    return {name: spark.read.parquet(f"{home}/{name}") for name in names.tables}


def prune_backups(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Delete all but the newest ``keep`` backups and return their paths."""
    gone = [r.path for r in backups(spark, folder).select("path").collect()][max(0, keep) :]  # one row a backup
    for path in gone:
        fs, where = _fs(spark, path)
        fs.delete(where, True)
    return gone
