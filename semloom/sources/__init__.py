"""Sources: tables, memory, files of several kinds, and user-defined datasets."""

from .datasets import (
    AudioFileDataset,
    FrameDataset,
    HTMLFileDataset,
    ImageFileDataset,
    IterDataset,
    MemoryDataset,
    PDFFileDataset,
    TextFileDataset,
    XLSFileDataset,
    get_local_source,
    resolve_datasource,
    table,
)
from .udfs import file_to_xls, url_to_file, xls_to_tables

__all__ = [
    "AudioFileDataset", "FrameDataset", "HTMLFileDataset", "ImageFileDataset", "IterDataset", "MemoryDataset", "PDFFileDataset",
    "TextFileDataset", "XLSFileDataset", "file_to_xls", "get_local_source", "resolve_datasource", "table", "url_to_file", "xls_to_tables",
]
