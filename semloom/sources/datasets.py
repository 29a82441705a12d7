"""Root datasets. Each knows its schema and loads itself as a DataFrame; files are read by Spark's own readers."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import types as S
from ..dataset import Dataset
from ..operators.relational import fitted, with_places
from ..plans.logical import scan, token
from .html_text import MAX_WORDS, first_words, html_to_text
from .udfs import read_workbook

IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff")
AUDIO = (".wav",)
PAGES = (".html", ".htm")
PDFS = (".pdf",)
BOOKS = (".xls", ".xlsx")


class Source:
    """What a scan node holds: an id, and how to load the frame. Sources of equal ``content`` are the same one."""

    def __init__(self, id: str, load: Callable[[SparkSession], DataFrame], content: str = "", ordered: Callable[[SparkSession, str], DataFrame | None] | None = None):
        self.id, self._load, self.content, self._ordered = id, load, content, ordered

    def load(self, spark: SparkSession) -> DataFrame:
        return self._load(spark)

    def ordered(self, spark: SparkSession, name: str) -> DataFrame | None:
        """The frame with a column that tells the records' own order however they are dealt, if the source has one."""
        return self._ordered(spark, name) if self._ordered else None

    def __repr__(self) -> str:
        return f"Source({self.id})"


class RootDataset(Dataset):
    def __init__(self, id: str, schema: T.StructType, load: Callable[[SparkSession], DataFrame], content: str = "", ordered: Callable[[SparkSession, str], DataFrame | None] | None = None):
        super().__init__(scan(Source(id, load, content, ordered), schema), id)

    def with_source_ids(self, name: str = "source_id") -> "RootDataset":
        """The dataset with each record's origin, ``{dataset id}-{place}``, as a column that further verbs carry along."""
        load = self.node["source"].load

        def identified(spark: SparkSession) -> DataFrame:
            df = with_places(load(spark), "__at")
            return df.withColumn(name, F.concat(F.lit(f"{self.id}-"), F.col("__at"))).drop("__at")

        return RootDataset(self.id, T.StructType([*self.schema.fields, S.field(name, str, "where the record comes from")]), identified)


class FrameDataset(RootDataset):
    """Any DataFrame: parquet, CSV, JSON, JDBC, tables and streams all come in by Spark's readers. Without an id it gets one of its own."""

    def __init__(self, df: DataFrame, id: str | None = None):
        super().__init__(id or f"frame-{token(df)}", df.schema, lambda spark: df, "", lambda spark, name: _file_order(df, name))


def _file_order(df: DataFrame, name: str) -> DataFrame | None:
    """``df`` with each row's file and place in it, which Spark's readers of row-numbered files tell."""
    try:
        return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(name))
    except AnalysisException:  # not read from such files, or no longer known after what was done to it
        return None


def table(spark: SparkSession, path: str, name: str) -> FrameDataset:
    """A parquet table of a folder."""
    return FrameDataset(spark.read.parquet(f"{path}/{name}.parquet"), name)


class MemoryDataset(RootDataset):
    """A list of scalars (a ``value`` column), a list of dicts, or a pandas frame."""

    def __init__(self, id: str, vals: list | pd.DataFrame, schema: list[dict] | T.StructType | None = None):
        if isinstance(vals, pd.DataFrame):
            frame = vals.rename(columns={c: f"column_{c}" for c in vals.columns if isinstance(c, int)})
            shape = S.make_schema(schema) if schema is not None else None
            rows = [tuple(_item(v) for v in r) for r in frame.itertuples(index=False, name=None)]
            shape = shape or _guess([dict(zip(frame.columns, r, strict=True)) for r in rows], S.schema_of_pandas(frame))
            rows = [tuple(dict(zip(frame.columns, r, strict=True)).get(n) for n in shape.names) for r in rows]
        elif vals and isinstance(vals[0], dict):
            shape = S.make_schema(schema) if schema is not None else _guess(vals, None)
            rows = [tuple(v.get(n) for n in shape.names) for v in vals]
        else:
            shape = S.make_schema(schema) if schema is not None else _guess([{"value": v} for v in vals], None) if vals else S.DefaultSchema
            rows = [(v,) for v in vals]
        super().__init__(id, shape, lambda spark: spark.createDataFrame(rows, shape, verifySchema=False), f"{id}-{S.hash_for_id(repr((shape, rows)), 32)}", lambda spark, name: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType([*shape.fields, T.StructField(name, T.LongType())]), verifySchema=False))
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> dict:
        return dict(zip(self.schema.names, self.rows[i], strict=True))


def _item(v: Any) -> Any:
    v = v.item() if hasattr(v, "item") and not isinstance(v, (list, tuple, bytes)) and getattr(v, "ndim", 0) == 0 else v
    return None if isinstance(v, float) and v != v else v


def _guess(rows: list[dict], known: T.StructType | None) -> T.StructType:
    """Column types from the values; a column of mixed numbers is double, of other mixtures text."""
    out = []
    for n in rows[0] if rows else (known.names if known else []):
        kinds = {type(v) for r in rows if (v := r.get(n)) is not None}
        kind: Any = known[n].dataType if known is not None and not kinds else str
        if len(kinds) == 1:
            (k,) = kinds
            if k is list:
                inner = {type(x) for r in rows if r.get(n) for x in r[n]}
                kind = list[next(iter(inner))] if len(inner) == 1 and inner <= {int, float, str, bool} else list[float] if inner and inner <= {int, float} else list[str]
            else:
                kind = k if k in (int, float, bool, str, bytes) else str
        elif kinds and kinds <= {int, float}:
            kind = float
        out.append(S.field(n, kind))
    return T.StructType(out)


class IterDataset(RootDataset):
    """A user's dataset: override ``__len__`` and ``__getitem__``; items are read in parallel ranges of indexes.

    The object is pickled to the executors, so it must open what it reads there.
    """

    #: Tasks at least, and items that a task reads at most.
    PARTITIONS, TASK_ITEMS = 8, 10_000

    def __init__(self, id: str, schema: list[dict] | T.StructType):
        super().__init__(id, S.make_schema(schema), self._frame, "", self._frame)

    def __len__(self) -> int:
        raise NotImplementedError

    def __getitem__(self, idx: int) -> dict:
        raise NotImplementedError

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "node"}

    def _frame(self, spark: SparkSession, ordinal: str | None = None) -> DataFrame:
        """Ranges of indexes, mapped to their items where they are; on demand with the index."""
        items, size = self, len(self)
        kinds = [(f.name, to_arrow_type(f.dataType)) for f in self.schema.fields]
        shape = T.StructType([*self.schema.fields, *([T.StructField(ordinal, T.LongType())] if ordinal else [])])

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000).column(0)
                    found = [items[i] for i in part.to_pylist()]
                    columns = [fitted([x[n] for x in found], k) for n, k in kinds]
                    yield pa.RecordBatch.from_arrays([*columns, *([part] if ordinal else [])], shape.names)

        parts = max(self.PARTITIONS, -(-size // self.TASK_ITEMS))
        return spark.range(0, size, 1, parts).mapInArrow(run, shape)


def _binary(spark: SparkSession, path: str, endings: tuple[str, ...] | None, deep: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if deep:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(path).select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    if endings:
        df = df.where(F.lower("filename").rlike(f"({'|'.join(e.replace('.', chr(92) + '.') for e in endings)})$"))
    return df


class TextFileDataset(RootDataset):
    """A file or a flat folder of texts: filename and contents, whatever their endings."""

    def __init__(self, id: str, path: str):
        super().__init__(id, S.TextFile, lambda spark: spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("contents")))


class HTMLFileDataset(RootDataset):
    """HTML files: the page and its text, both as their first ``max_words`` words (None: all); links are written ``text (href)``."""

    def __init__(self, id: str, path: str, max_words: int | None = MAX_WORDS):
        def load(spark):
            text = F.pandas_udf(lambda s: s.map(lambda page: html_to_text(page, max_words)), "string")
            words = F.pandas_udf(lambda s: s.map(lambda page: first_words(page, max_words)), "string")
            page = F.decode("content", "UTF-8")
            return _binary(spark, path, PAGES).select("filename", words(page).alias("html"), text(page).alias("text"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))

        super().__init__(id, S.WebPage, load)


def _encoded(id: str, path: str, schema: T.StructType, endings: tuple[str, ...], deep: bool):
    return id, schema, lambda spark: _binary(spark, path, endings, deep).select("filename", F.regexp_replace(F.base64("content"), "\\s", "").alias("contents"))


class ImageFileDataset(RootDataset):
    """Images of a folder, base64-encoded."""

    def __init__(self, id: str, path: str):
        super().__init__(*_encoded(id, path, S.ImageFile, IMAGES, False))


class AudioFileDataset(RootDataset):
    """Wav files of a folder tree, base64-encoded."""

    def __init__(self, id: str, path: str):
        super().__init__(*_encoded(id, path, S.AudioFile, AUDIO, True))


def _pdf_text(data: bytes) -> str:
    try:
        import io

        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF text needs pypdf, or another extractor given to PDFFileDataset") from e
    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)


class PDFFileDataset(RootDataset):
    """PDF files with their text; ``extract`` turns a file's bytes into text."""

    def __init__(self, id: str, path: str, extract: Callable[[bytes], str] = _pdf_text):
        def load(spark):
            text = F.pandas_udf(lambda s: s.map(lambda b: extract(bytes(b))), "string")
            return _binary(spark, path, PDFS).select("filename", F.col("content").alias("contents"), text("content").alias("text_contents"))

        super().__init__(id, S.PDFFile, load)


class XLSFileDataset(RootDataset):
    """Workbooks with the number and names of their sheets."""

    def __init__(self, id: str, path: str):
        def load(spark):
            names = F.pandas_udf(lambda s: s.map(lambda b: [n for n, _ in read_workbook(bytes(b), 0)]), "array<string>")
            return _binary(spark, path, BOOKS).withColumn("sheet_names", names("content")).select("filename", F.col("content").alias("contents"), F.size("sheet_names").cast("long").alias("number_sheets"), "sheet_names")

        super().__init__(id, S.XLSFile, load)


def get_local_source(id: str, path: str) -> RootDataset:
    """A file is a text; a folder is images, PDFs, workbooks or pages if all its files are, else texts."""
    if os.path.isfile(path):
        return TextFileDataset(id, path)
    if not os.path.isdir(path):
        raise ValueError(f"no file or folder at {path}")
    names = [f.lower() for f in sorted(os.listdir(path))]
    for endings, kind in ((IMAGES, ImageFileDataset), (PDFS, PDFFileDataset), (BOOKS, XLSFileDataset), (PAGES, HTMLFileDataset)):
        if names and all(n.endswith(endings) for n in names):
            return kind(id, path)
    return TextFileDataset(id, path)


def resolve_datasource(id: str, source: Any) -> RootDataset:
    """A path, a list, a pandas frame or a Spark frame as a root dataset."""
    if isinstance(source, (str, os.PathLike)):
        return get_local_source(id, os.fspath(source))
    if isinstance(source, (list, pd.DataFrame)):
        return MemoryDataset(id, source)
    if isinstance(source, DataFrame):
        return FrameDataset(source, id)
    raise ValueError(f"no source in {type(source).__name__}")
