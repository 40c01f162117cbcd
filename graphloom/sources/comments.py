"""Comment stripping: strings and templates are respected, so it is a character machine and not a pattern."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

HASH_LANGUAGES = frozenset({"python", "ruby", "php", "shell"})


def strip_comments(code: str, language: str) -> str:
    """The code without comments; line breaks stay, so line numbers hold."""
    out, i, n, quote = [], 0, len(code), ""
    hashes, slashes = language in HASH_LANGUAGES, language not in ("python", "ruby", "shell")
    while i < n:
        c = code[i]
        if quote:
            out.append(c)
            if c == "\\" and i + 1 < n:
                out.append(code[i + 1])
                i += 1
            elif code.startswith(quote, i):
                out.append(quote[1:])
                i += len(quote) - 1
                quote = ""
            elif c == "\n" and quote in ("'", '"'):
                quote = ""
        elif c in "'\"`":
            quote = c * 3 if language == "python" and code.startswith(c * 3, i) else c
            out.append(quote)
            i += len(quote) - 1
        elif (slashes and code.startswith("//", i)) or (hashes and c == "#"):
            i = code.find("\n", i)
            if i < 0:
                break
            out.append("\n")
        elif slashes and code.startswith("/*", i):
            end = code.find("*/", i + 2)
            end = n if end < 0 else end + 2
            out.append("\n" * code.count("\n", i, end))
            i = end - 1
        else:
            out.append(c)
        i += 1
    return "".join(out)


def without_comments(files: DataFrame) -> DataFrame:
    """(file, language, source_code) with the comments gone."""

    def run(batches):
        for batch in batches:
            code = [strip_comments(s or "", lang or "") for lang, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string())], ["file", "language", "source_code"])

    return files.select("file", "language", "source_code").mapInArrow(run, "file string, language string, source_code string")
