"""The graph of a pipeline as data, JSON and Mermaid."""

from tessera.meta.dag import dag, dag_frames, from_json, to_json, to_mermaid
from tessera.meta.exporters import MetadataOptions, export

__all__ = ["MetadataOptions", "dag", "dag_frames", "export", "from_json", "to_json", "to_mermaid"]
