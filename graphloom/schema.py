"""Schemas of the three relations and the vocabularies of their columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

NODES = (
    "id string, label string, file_type string, source_file string, source_location string, origin_file string, type string, "
    "_origin string, repo string, local_id string, community bigint, community_name string, norm_label string, metadata map<string,string>, _ord bigint"
)
EDGES = (
    "source string, target string, relation string, confidence string, confidence_score double, weight double, context string, source_file string, "
    "source_location string, external boolean, deferred boolean, _src string, _tgt string, _origin string, metadata map<string,string>, _ord bigint"
)
HYPEREDGES = "id string, label string, relation string, confidence string, source_file string, nodes array<string>"

# Fixed values of the data model.
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
NODE_REQUIRED = ("id", "label", "file_type", "source_file")
EDGE_REQUIRED = ("source", "target", "relation", "confidence", "source_file")
OUTCOMES = ("useful", "dead_end", "corrected")


@dataclass(frozen=True)
class Graph:
    """A property graph: node and edge tables, optional hyperedges, and its kind."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None
    directed: bool = True
    multi: bool = False

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)
