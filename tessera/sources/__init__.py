"""Catalog entries over files, memory and other sources."""

from tessera.sources.base import CatalogEntry, Dataset, ReadOnlyDataset, ReadOnlyError, ReadOnlyObject, SingleObject
from tessera.sources.catalog import Catalog, NoData, entry
from tessera.sources.objects import BinaryObject, FileType, JsonObject, MemoryObject, TextObject, detect_file_type
from tessera.sources.tables import CsvDataset, ExcelDataset, FrameSource, JsonDataset, MemoryDataset, NullDataset, ParquetDataset

__all__ = [
    "BinaryObject", "Catalog", "CatalogEntry", "CsvDataset", "Dataset", "ExcelDataset", "FileType", "FrameSource", "JsonDataset",
    "JsonObject", "MemoryDataset", "MemoryObject", "NoData", "NullDataset", "ParquetDataset", "ReadOnlyDataset", "ReadOnlyError",
    "ReadOnlyObject", "SingleObject", "TextObject", "detect_file_type", "entry",
]
