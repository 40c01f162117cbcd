"""Python source to graph tables through the standard syntax tree.

A function becomes a STRUCTURAL node that contains its calls; a call's type
comes from a vocabulary of callee names; names that calls assign and use make
DATA_FLOW edges and flow rows.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame

# Callee to (node type, subtype, whether its result is tainted).
VOCABULARY = {
    "input": ("INGRESS", "user_input", True),
    "request.args.get": ("INGRESS", "http_request", True),
    "request.form.get": ("INGRESS", "http_request", True),
    "os.environ.get": ("INGRESS", "env_read", True),
    "os.getenv": ("INGRESS", "env_read", True),
    "sys.stdin.read": ("INGRESS", "user_input", True),
    "open": ("STORAGE", "file_access", False),
    "cursor.execute": ("STORAGE", "sql_query", False),
    "db.execute": ("STORAGE", "sql_query", False),
    "os.system": ("EXTERNAL", "system_exec", False),
    "subprocess.run": ("EXTERNAL", "system_exec", False),
    "subprocess.Popen": ("EXTERNAL", "system_exec", False),
    "eval": ("EXTERNAL", "code_eval", False),
    "exec": ("EXTERNAL", "code_eval", False),
    "requests.get": ("EXTERNAL", "http_request", True),
    "requests.post": ("EXTERNAL", "http_request", True),
    "pickle.loads": ("EXTERNAL", "deserialize", True),
    "yaml.load": ("EXTERNAL", "deserialize", True),
    "print": ("EGRESS", "display", False),
    "render_template_string": ("EGRESS", "template_render", False),
    "logging.info": ("STORAGE", "log_write", False),
    "hashlib.md5": ("TRANSFORM", "hash", False),
    "hashlib.sha1": ("TRANSFORM", "hash", False),
    "hashlib.sha256": ("TRANSFORM", "hash", False),
    "html.escape": ("TRANSFORM", "escape", False),
    "shlex.quote": ("TRANSFORM", "sanitize_shell", False),
    "int": ("TRANSFORM", "parse", False),
    "authenticate": ("AUTH", "auth_check", False),
    "login_required": ("AUTH", "auth_check", False),
}
COLUMNS = {"kind": pa.string(), "file": pa.string(), "id": pa.string(), "sequence": pa.int64(), "node_type": pa.string(), "node_subtype": pa.string(), "label": pa.string(), "line_start": pa.int64(), "line_end": pa.int64(), "code_snapshot": pa.string(), "src": pa.string(), "dst": pa.string(), "edge_type": pa.string(), "name": pa.string(), "tainted": pa.bool_()}


def chain(node: ast.AST) -> str:
    """The dotted name of a callee; empty if it isn't one."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def lookup(callee: str) -> tuple[str, str, bool] | None:
    """By the whole chain, its last two names, then the last one where the chain is that name."""
    return VOCABULARY.get(callee) or VOCABULARY.get(".".join(callee.split(".")[-2:]))


class _Walker(ast.NodeVisitor):
    def __init__(self, file: str, source: str):
        self.file, self.source, self.rows, self.n = file, source, [], 0
        self.scopes: list[tuple[str | None, dict]] = [(None, {})]

    def _row(self, **values):
        self.rows.append({"file": self.file} | values)

    def _node(self, tree, node_type, subtype, label):
        self.n += 1
        name = f"n{self.n}"
        code = ast.get_source_segment(self.source, tree) or ""
        self._row(kind="node", id=name, sequence=self.n, node_type=node_type, node_subtype=subtype, label=label, line_start=tree.lineno, line_end=tree.end_lineno, code_snapshot=code)
        if self.scopes[-1][0]:
            self._row(kind="edge", src=self.scopes[-1][0], dst=name, edge_type="CONTAINS")
        return name

    def visit_FunctionDef(self, tree):
        name = self._node(tree, "STRUCTURAL", "function", tree.name)
        self.scopes.append((name, {}))
        self.generic_visit(tree)
        self.scopes.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_If(self, tree):
        self._node(tree.test, "CONTROL", "branch", "if")
        self.generic_visit(tree)

    def visit_Assign(self, tree):
        made = self._value(tree.value)
        for target in tree.targets:
            for x in ast.walk(target):
                if isinstance(x, ast.Name):
                    self.scopes[-1][1][x.id] = made

    def visit_Expr(self, tree):
        self._value(tree.value)

    visit_Return = lambda self, tree: self._value(tree.value) if tree.value else None

    def visit_Call(self, tree):
        self._value(tree)

    def _value(self, tree) -> tuple[set, bool]:
        """(nodes the value comes from, whether it is tainted)."""
        if isinstance(tree, ast.Call):
            sources, dirty = set(), False
            inner = tree.func.value if isinstance(tree.func, ast.Attribute) and not chain(tree.func) else None
            for arg in [*([inner] if inner is not None else []), *tree.args, *(k.value for k in tree.keywords)]:
                s, d = self._value(arg)
                sources |= s
                dirty |= d
            known = lookup(chain(tree.func))
            if known is None:
                return sources, dirty
            node_type, subtype, makes = known
            name = self._node(tree, node_type, subtype, chain(tree.func))
            for s in sorted(sources):
                self._row(kind="edge", src=s, dst=name, edge_type="DATA_FLOW")
                self._row(kind="flow", id=name, src=s, dst=name, name="arg", tainted=dirty)
            return {name}, makes or (dirty and node_type != "TRANSFORM")
        if isinstance(tree, ast.Name):
            for _, names in reversed(self.scopes):
                if tree.id in names:
                    return names[tree.id]
            return set(), False
        sources, dirty = set(), False
        for child in ast.iter_child_nodes(tree):
            if isinstance(child, ast.expr | ast.FormattedValue):
                s, d = self._value(child)
                sources |= s
                dirty |= d
        return sources, dirty


def parse(file: str, source: str | None) -> list[dict]:
    """Node, edge and flow rows of one file; a file that doesn't parse gives one META node."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return [{"kind": "node", "file": file, "id": "n1", "sequence": 1, "node_type": "META", "node_subtype": "parse_error", "label": "parse error", "line_start": 1, "line_end": 1, "code_snapshot": ""}]
    walker = _Walker(file, source or "")
    walker.visit(tree)
    return walker.rows


def tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, flows) of (file, source_code)."""

    def run(batches):
        for batch in batches:
            rows = [r for f, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in parse(f, s)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in COLUMNS.items()], list(COLUMNS))

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
    rows = files.select("file", "source_code").mapInArrow(run, ", ".join(f"`{c}` {kinds[t]}" for c, t in COLUMNS.items()))
    nodes = rows.where("kind = 'node'").select("file", "id", "sequence", "node_type", "node_subtype", "label", "line_start", "line_end", "code_snapshot")
    edges = rows.where("kind = 'edge'").select("file", "src", "dst", "edge_type")
    flows = rows.where("kind = 'flow'").selectExpr("file", "id as node_id", "'in' as direction", "name", "src as source", "dst as target", "tainted")
    return nodes, edges, flows
