"""Markup to graph nodes: scripts, styles, handlers, forms, frames, inputs, links, metas, comments."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

NAMES = ["file", "sequence", "id", "node_type", "node_subtype", "label", "line_start"]
#: Elements that become nodes.
ELEMENTS = {
    "script": ("EXTERNAL", "script"),
    "style": ("META", "style"),
    "form": ("INGRESS", "form"),
    "iframe": ("EXTERNAL", "iframe"),
    "input": ("INGRESS", "input"),
    "textarea": ("INGRESS", "input"),
    "select": ("INGRESS", "input"),
    "meta": ("META", "meta"),
    "link": ("EXTERNAL", "stylesheet"),
    "a": ("EGRESS", "link"),
    "img": ("EXTERNAL", "image"),
    "base": ("META", "base"),
    "object": ("EXTERNAL", "embed"),
    "embed": ("EXTERNAL", "embed"),
}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str, int]] = []

    def handle_starttag(self, tag, attrs):
        line, given = self.getpos()[0], dict(attrs)
        if tag in ELEMENTS and (tag != "a" or "href" in given):
            kind, subtype = ELEMENTS[tag]
            self.found.append((kind, subtype, given.get("src") or given.get("href") or given.get("action") or given.get("name") or tag, line))
        for name, value in attrs:
            if name.startswith("on"):
                self.found.append(("CONTROL", "event_handler", f"{name}={value or ''}", line))
            elif name == "style":
                self.found.append(("META", "inline_style", (value or ""), line))

    def handle_decl(self, decl):
        self.found.append(("META", "doctype", decl, self.getpos()[0]))

    def handle_comment(self, data):
        kind = "conditional_comment" if data.strip().startswith("[if") else "comment"
        self.found.append(("META", kind, data.strip(), self.getpos()[0]))


def read(source: str | None) -> list[tuple[str, str, str, int]]:
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    return reader.found


def nodes(pages: DataFrame) -> DataFrame:
    """Node rows of (file, source_code)."""

    def run(batches):
        for batch in batches:
            rows = [(f, k, f"n{k}", *x) for f, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, x in enumerate(read(source))]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], NAMES)

    return pages.select("file", "source_code").mapInArrow(run, "file string, sequence long, id string, node_type string, node_subtype string, label string, line_start long")
