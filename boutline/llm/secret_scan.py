"""Spark side of the secret scan: spans per document, and documents with their secrets masked. Method: secrets.py."""

import hashlib

from pyspark.sql import DataFrame

from boutline.llm.common import arrow_map
from boutline.llm.secrets import scan, told

MASK = "[SECRET]"


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal`` per row of ``docs``.

    Whole texts, null as empty; spans are code points, end exclusive. Repeated rows give repeated results, an empty table
    none; other columns are not read."""

    def run(batch):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal")}
        for text in batch.column("text").to_pylist():
            base, every = scan(text or "")
            kinds = [k for _, k, _ in every]
            for i, name in enumerate(("n_assign", "n_access", "n_hex", "n_literal")):
                out[name].append(kinds.count(i))
            out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
            out["spans"].append(told(every))
        return out | {"doc_id": batch.column("doc_id")}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_literal bigint")


def masked(text: str | None) -> str | None:
    """The text with each secret replaced by MASK; spans that touch or overlap are one."""
    if text is None:
        return None
    out, at = [], 0
    for s, _, e in scan(text)[1]:
        if s > at or not out:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text`` masked and ``n_chars``, if there and not null, counted again."""
    names = docs.columns
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(batch):
        out = {name: batch.column(i) for i, name in enumerate(names)}
        texts = out["text"].to_pylist()
        new = [masked(t) for t in texts]
        if "n_chars" in out:
            out["n_chars"] = [len(b) if n is not None and b is not None and a != b else n for a, b, n in zip(texts, new, out["n_chars"].to_pylist())]
        out["text"] = new
        return out

    return arrow_map(docs, run, ", ".join(kept))
