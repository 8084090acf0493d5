"""Documents from files: plain text, JSON, and PDF through a decoder that the caller brings.

Every row keeps its own error; a bad file never stops the job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import schema
from cloakframe.functions.text import S, barrier, let, line_number, metadata_block, normalise_columns, strip_icons

SUFFIXES = {"pdf": "pdf", "txt": "text", "json": "json"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files (path, modificationTime, length, content) below a path: a file, a folder or a glob."""
    return spark.read.format("binaryFile").load(path)


def listing(files: DataFrame) -> DataFrame:
    """(doc_id, filename, format, bytes) of the supported ones of files (path, length), by name. Reads no content."""
    named = _named(files.select("path", "length"))
    return named.where(F.col("suffix").isin(*SUFFIXES)).select("doc_id", "filename", F.col("suffix").alias("format"), F.col("length").alias("bytes")).orderBy("filename")


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "/"), -1)
    return files.withColumn("filename", name).withColumn("doc_id", F.regexp_replace("filename", r"(?<=.)\.[^.]*$", "")).withColumn("suffix", F.lower(F.regexp_extract("filename", r"(?<=.)\.([^.]*)$", 1)))


def by_stem(files: DataFrame) -> DataFrame:
    """(doc_id, filename, path): the first file, by name, of each stem, whatever its suffix."""
    return _named(files.select("path")).groupBy("doc_id").agg(F.min(F.struct("filename", "path")).alias("f")).select("doc_id", "f.*")


def find(files: DataFrame, doc_id: str) -> DataFrame:
    """The first file, by name, with this stem."""
    return by_stem(_named(files.select("path")).where(F.col("doc_id") == doc_id))


_NOTES, _META = "array<string>", "map<string,string>"


def _row(files: DataFrame, form: Column, text: Column, error: Column, warnings: Column | None = None, metadata: Column | None = None, spans: Column | None = None) -> DataFrame:
    empty = lambda c, none, kind: none.cast(kind) if c is None else F.coalesce(c, none.cast(kind))
    return files.select(
        "doc_id",
        F.col("path").alias("source_path"),
        form.alias("source_format"),
        F.when(error.isNull(), text).alias("text"),
        empty(warnings, F.array(), _NOTES).alias("warnings"),
        empty(metadata, F.create_map(), _META).alias("metadata"),
        (F.lit(None) if spans is None else spans).cast(schema.SPANS).alias("value_spans"),
        error.alias("error"),
    )


def _made(text: Column, error: Column, warnings: Column | None = None, metadata: Column | None = None, spans: Column | None = None) -> Column:
    or_null = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(text.alias("text"), or_null(warnings, _NOTES).alias("warnings"), or_null(metadata, _META).alias("metadata"), or_null(spans, schema.SPANS).alias("spans"), error.cast("string").alias("error"))


def text_made(content: Column) -> Column:
    """Plain text: UTF-8, with a warning that counts replaced sequences and names the first line."""
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.make_valid_utf8(raw))

    def of(text: Column) -> Column:
        bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
        note = F.format_string("%d undecodable sequence(s) replaced, the first on line %d", bad, line_number(text, F.locate("�", text) - 1))
        return _made(text, F.when(text.rlike(rf"^[{S}]*$"), F.lit("empty file")), F.when(~F.is_valid_utf8(raw), F.array(note)))

    return let(text, of)


def serialised(parsed: object) -> tuple[str, list[tuple[int, int, str]], int]:
    """(text, value spans, leaves) of a parsed document: indented JSON in source order.

    A stack holds what is still to be written; strings are spanned inside their quotes, numbers as they
    stand, null and booleans not at all."""
    out: list[str] = []
    spans: list[tuple[int, int, str]] = []
    length = leaves = 0
    todo: list[tuple[str, object, str, int]] = [("value", parsed, "", 0)]
    while todo:
        what, node, path, depth = todo.pop()
        if what == "raw":
            piece = node
        elif isinstance(node, (dict, list)) and node:
            keyed = isinstance(node, dict)
            inner, last = "  " * (depth + 1), len(node) - 1
            children = node.items() if keyed else enumerate(node)
            steps: list[tuple[str, object, str, int]] = [("raw", "{\n" if keyed else "[\n", "", 0)]
            for i, (key, child) in enumerate(children):
                steps.append(("raw", inner + (json.dumps(key, ensure_ascii=False) + ": " if keyed else ""), "", 0))
                steps.append(("value", child, (f"{path}.{key}" if path else str(key)) if keyed else f"{path}[{key}]", depth + 1))
                steps.append(("raw", "\n" if i == last else ",\n", "", 0))
            steps.append(("raw", "  " * depth + ("}" if keyed else "]"), "", 0))
            todo.extend(reversed(steps))
            continue
        elif isinstance(node, (dict, list)):
            piece = "{}" if isinstance(node, dict) else "[]"
        else:
            leaves += 1
            piece = json.dumps(node, ensure_ascii=False)
            quote = int(isinstance(node, str))
            if node is not None and not isinstance(node, bool):
                spans.append((length + quote, length + len(piece) - quote, path))
        out.append(piece)
        length += len(piece)
    return "".join(out) + "\n", spans, leaves


def _json_rows(raw: pd.Series) -> pd.DataFrame:
    def one(value: str | None) -> tuple:
        if value is None:  # another kind of file
            return None, None, None, None
        try:
            text, spans, leaves = serialised(json.loads(value))
        except (ValueError, RecursionError) as e:
            return None, None, None, f"malformed JSON: {e}"
        if not spans:
            return None, None, leaves, "no data values"
        return text, [{"start": s, "end": e, "path": p} for s, e, p in spans], leaves, None

    return pd.DataFrame([one(v) for v in raw], columns=["text", "spans", "leaves", "error"])


def json_parsed(content: Column) -> Column:
    """JSON in source order with the spans of its values. Python, as order is lost in variants."""
    return F.pandas_udf(_json_rows, f"struct<text:string,spans:{schema.SPANS},leaves:int,error:string>")(F.make_valid_utf8(content.cast("string")))


def json_made(parsed: Column) -> Column:
    counts = F.create_map(F.lit("leaves"), parsed["leaves"].cast("string"), F.lit("values"), F.size(parsed["spans"]).cast("string"))
    return _made(parsed["text"], parsed["error"], metadata=F.when(parsed["error"].isNull(), counts), spans=parsed["spans"])


#: A decoder turns a file into pages of (text, [(font, run)]) and a dictionary of metadata, or raises.
Decoder = Callable[[bytes], tuple[list[tuple[str, list[tuple[str, str]]]], dict[str, str]]]
_PAGES = f"struct<pages:array<struct<text:string,runs:array<struct<font:string,text:string>>,error:string>>,metadata:{_META},failure:string>"


#: Bytes of files after which a task passes on their pages, rather than hold those of a whole batch.
PASSED_BYTES = 2 << 20


def pdf_decoded(content: Column, decoder: Decoder | None) -> Column:
    """Pages of a PDF file through a decoder; a page may carry its own failure as an exception in place of its text."""

    def one(raw: bytes | None) -> tuple:
        if raw is None:  # another kind of file
            return None, None, None
        try:
            if decoder is None:
                raise RuntimeError("no PDF decoder is configured")
            pages, metadata = decoder(bytes(raw))
            made = [
                {"text": None, "runs": [], "error": str(text)} if isinstance(text, Exception) else {"text": text, "runs": [{"font": f.split("+", 1)[-1], "text": r} for f, r in runs if r.strip()], "error": None}
                for text, runs in pages
            ]
            return made, {k: str(v) for k, v in metadata.items() if v}, None
        except Exception as e:  # noqa: BLE001  a bad file is a row with an error
            return [], {}, str(e)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raw in batches:
            rows, size = [], 0
            for v in raw:
                rows.append(one(v))
                size += len(v or b"")
                if size >= PASSED_BYTES:
                    yield pd.DataFrame(rows, columns=["pages", "metadata", "failure"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["pages", "metadata", "failure"])

    return F.pandas_udf(run, _PAGES)(content)


def pdf_made(decoded: Column, clean: Column) -> Column:
    """decoded: of pdf_decoded(); clean: its pages without icons, of pdf_cleaned()."""
    body = F.array_join(F.filter(F.transform(clean, lambda c: normalise_columns(c["text"])), lambda t: t.isNotNull() & ~t.rlike(rf"^[{S}]*$")), "\n")

    def of(body: Column) -> Column:
        meta = metadata_block(decoded["metadata"])
        text = F.when(body.rlike(rf"^[{S}]*$"), F.coalesce(meta, F.lit(""))).otherwise(F.concat_ws("\n\n", body, meta))
        numbered = lambda i, *note: F.concat(F.lit("page "), (i + 1).cast("string"), F.lit(": "), *note)
        some = lambda notes: F.filter(notes, lambda x: x.isNotNull())
        failed = some(F.transform(decoded["pages"], lambda p, i: F.when(p["error"].isNotNull(), numbered(i, p["error"]))))
        icons = lambda field, what: some(F.transform(clean, lambda c, i: F.when(c[field] > 0, numbered(i, c[field].cast("string"), F.lit(what)))))
        blank = F.when(decoded["failure"].isNull() & body.rlike(rf"^[{S}]*$"), F.array(F.lit("no text in the file"))).otherwise(F.array().cast(_NOTES))
        warnings = F.concat(failed, icons("removed", " icon run(s) removed"), icons("ambiguous", " icon run(s) kept, as they stand elsewhere too"), blank)
        return _made(text, decoded["failure"], warnings, decoded["metadata"])

    return let(body, of)


def pdf_cleaned(decoded: Column) -> Column:
    return F.transform(decoded["pages"], lambda p: strip_icons(p["text"], p["runs"]))


def documents(files: DataFrame, decoder: Decoder | None = None) -> DataFrame:
    """Documents of files (path, content), each read once; unsupported files become rows with an error, and their content and
    that of files of other kinds goes to no decoder."""
    files = _named(files)
    form = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair)), F.col("suffix")), F.lit("unsupported"))
    files = files.select("doc_id", "path", "suffix", form.alias("_form"), F.when(form != "unsupported", F.col("content")).alias("_content"))
    of = lambda kind: F.when(F.col("_form") == kind, F.col("_content"))
    rows = files.withColumn("_json", json_parsed(of("json"))).withColumn("_pdf", pdf_decoded(of("pdf"), decoder))
    rows = barrier(rows, "_clean", pdf_cleaned(F.col("_pdf")))
    refused = F.concat(F.lit("unsupported file type ."), F.col("suffix"), F.lit("; supported: " + ", ".join(f".{s}" for s in sorted(SUFFIXES))))
    made = {"text": text_made(F.col("_content")), "json": json_made(F.col("_json")), "pdf": pdf_made(F.col("_pdf"), F.col("_clean"))}
    one = _made(F.lit(None).cast("string"), refused)
    for kind, what in made.items():
        one = F.when(F.col("_form") == kind, what).otherwise(one)
    rows = barrier(rows, "_m", one)
    return _row(rows, F.col("_form"), F.col("_m.text"), F.col("_m.error"), F.col("_m.warnings"), F.col("_m.metadata"), F.col("_m.spans"))


def load(spark: SparkSession, path: str, decoder: Decoder | None = None) -> DataFrame:
    """Documents below a path (a file, a folder or a glob). Where nothing is there, one row says so."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        missing = _named(spark.createDataFrame([(path,)], "path string"))
        return _row(missing, F.lit("missing"), F.lit(None).cast("string"), F.lit("no such file or folder"))
    return documents(read(spark, path), decoder)


def label_files(spark: SparkSession, folder: str) -> DataFrame:
    """Label files, one row each."""
    return spark.read.schema(schema.LABEL_FILE).option("pathGlobFilter", "*_labels.json").json(folder, multiLine=True)


def parsed_labels(bodies: DataFrame) -> DataFrame:
    """Label files of rows (body), which hold them as text."""
    return bodies.select(F.from_json("body", schema.LABEL_FILE).alias("f")).select("f.*")


def labels(label_rows: DataFrame) -> DataFrame:
    """Label files as rows: one for each span, with its document."""
    return label_rows.select("doc_id", "source_file", F.explode("spans").alias("s")).select("doc_id", "source_file", "s.*")


def label_values(label_rows: DataFrame) -> DataFrame:
    """(doc_id, id, value) of labels with a value."""
    return labels(label_rows).where(~F.col("value").rlike(rf"^[{S}]*$")).select("doc_id", "id", "value")


def negative_controls(label_rows: DataFrame) -> DataFrame:
    """(doc_id, value): what must not be detected."""
    return label_rows.select("doc_id", F.explode("negative_controls").alias("c")).select("doc_id", "c.value")


def paired(files: DataFrame, label_rows: DataFrame) -> DataFrame:
    """(filename, path, doc_id): files with the label file that names them as its source."""
    named = _named(files.select("path")).select("filename", "path")
    return named.join(label_rows.select("doc_id", F.col("source_file").alias("filename")), "filename")
