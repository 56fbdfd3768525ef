"""Token counts by section: documents are encoded once, and token spans are joined to section spans by character offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import encoder, ids_of
from .shared import map_batches, pieces, table

#: Who gets a token that crosses a boundary: the section of its first character, of its last, the one that holds most
#: of its characters (the first of equals), or each by its share of them.
RULES = ("first", "last", "most", "share")


def line_spans(text: str) -> np.ndarray:
    """Starts of the lines of a text and its length; a line has its newline."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] != len(text) or len(cuts) == 1:
        cuts.append(len(text))
    return np.array(cuts, np.int64)


def token_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character, and the one after the last, of each token. Tokens within a character all have that character."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def allocate(cuts: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that begin in it cross its end. Sections lie end to end."""
    n = len(cuts) - 1
    first = np.clip(np.searchsorted(cuts, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(cuts, ends - 1, "right") - 1, 0, n - 1)
    crossing = first != last
    crossed = np.bincount(first[crossing], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossed
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float), crossed
    counts = np.bincount(first[~crossing], minlength=n).astype(float)
    for f, x, s, e in zip(first[crossing], last[crossing], starts[crossing], ends[crossing], strict=True):
        own = np.minimum(cuts[f + 1 : x + 2], e) - np.maximum(cuts[f : x + 1], s)
        if rule == "most":
            counts[f + int(own.argmax())] += 1
        else:
            counts[f : x + 1] += own / (e - s)
    return counts, crossed


@lru_cache(maxsize=1)
def token_lengths() -> np.ndarray:
    """Bytes of each token."""
    encode = encoder()
    return np.array([len(encode.decode_single_token_bytes(i)) for i in range(encode.n_vocab)], np.int64)


NAMES = ["id", "section", "start", "end", "n_tokens", "crossing", "doc_tokens"]


def _attribute(rows: DataFrame, rule: str, read: Callable[[pa.RecordBatch], Iterator[tuple[str | None, np.ndarray]]], id_col: str) -> DataFrame:
    """NAMES for each section of each row (id, ...); read gives the whole text of each row of a batch and its sections' boundaries."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at, found = [], []
            for i, (text, cuts) in enumerate(read(b)):
                ids, n = ids_of(text), len(cuts) - 1
                counts, crossed = allocate(cuts, *token_spans(text, ids, token_lengths()), rule) if len(ids) else (np.zeros(n), np.zeros(n))
                at.append(np.full(n, i))
                found.append(np.column_stack([np.arange(n), cuts[:-1], cuts[1:], counts, crossed, np.full(n, len(ids))]))
            if found:
                x = np.concatenate(found)
                whole = [pa.array(x[:, k].astype(np.int64)) for k in (0, 1, 2, 4, 5)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), *whole[:3], pa.array(x[:, 3]), *whole[3:]], NAMES)

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, section long, start long, end long, n_tokens double, crossing long, doc_tokens long").withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, rule: str = "first", spans: Callable[[str], np.ndarray] = line_spans, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, start, end, n_tokens, crossing, doc_tokens) for each section of each row of docs.

    spans gives the boundaries of a text's sections: 0, ascending, its length. A text is encoded whole and once, so
    the counts of its sections sum to doc_tokens, whatever the rule. A null or empty text is one empty section
    without tokens. An empty section between two others gets none. Repeated rows each give their rows; null ids are
    kept; other columns aren't read. An empty table gives no rows.
    """

    def read(b: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray]]:
        for text in b.column(1).to_pylist():
            yield text, spans(text) if text else np.zeros(2, np.int64)

    return _attribute(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rule, read, id_col)


def count_field_tokens(rows: DataFrame, fields: list[str], id_col: str, rule: str = "first", separator: str = "\n") -> DataFrame:
    """count_tokens for rows whose text is made of several string columns, one after the other with a separator, which counts
    with the field before it. section is the field's place in fields; a null field is empty. Repeated rows each give
    their rows, null ids are kept, an empty table gives no rows, and other columns aren't read."""

    def read(b: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray]]:
        for values in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
            parts = [(v or "") + separator for v in values]
            parts[-1] = values[-1] or ""
            yield "".join(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    return _attribute(rows.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(fields)]), rule, read, id_col)


def op5_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token counts where it begins."""
    return count_tokens(table(spark, sf_dir, "documents"))
