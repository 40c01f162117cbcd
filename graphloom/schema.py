"""The graph's tables: nodes, edges, flows. A graph is all rows of one ``file``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NODE_TYPES = ("INGRESS", "EGRESS", "TRANSFORM", "CONTROL", "AUTH", "STORAGE", "EXTERNAL", "STRUCTURAL", "META", "RESOURCE")
EDGE_TYPES = ("CALLS", "RETURNS", "READS", "WRITES", "DEPENDS", "CONTAINS", "DATA_FLOW")
FLOW_EDGES = ("CALLS", "RETURNS", "READS", "WRITES", "DATA_FLOW")
SENSITIVITIES = ("NONE", "PII", "SECRET", "AUTH", "FINANCIAL")
SEVERITIES = ("low", "medium", "high", "critical")

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}


def _struct(fields: str) -> T.StructType:
    kinds = dict(_TYPES)
    if "RANGE" in globals():
        kinds["range"] = RANGE
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


RANGE = _struct("min double, max double, bounded boolean, source_node_id string")
NODES = _struct(
    "file string, id string, sequence bigint, label string, node_type string, node_subtype string, language string, line_start bigint, line_end bigint, "
    "code_snapshot string, analysis_snapshot string, algorithm_name string, callee_chain strings, attack_surface strings, trust_boundary string, tags strings, buffer_size range"
)
EDGES = _struct("file string, src string, dst string, edge_type string, ord bigint")
FLOWS = _struct("file string, node_id string, direction string, pos bigint, name string, source string, target string, data_type string, tainted boolean, sensitivity string, range range, write_size range")


@dataclass(frozen=True)
class Graph:
    """Three tables that share ``file``; (file, id) names a node."""

    nodes: DataFrame
    edges: DataFrame
    flows: DataFrame

    def flow_edges(self) -> DataFrame:
        return self.edges.where(self.edges.edge_type.isin(*FLOW_EDGES))

    def inputs(self) -> DataFrame:
        return self.flows.where("direction = 'in'")

    def outputs(self) -> DataFrame:
        return self.flows.where("direction = 'out'")
