"""Documents to passages and paragraphs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPH = r"\n\s*\n+"


def truncated(text: Column, max_chars: int = 100_000) -> Column:
    return F.substring(text, 1, max_chars)


def stripped_blocks(text: str, separators: tuple[str, ...] = (PARAGRAPH, r"\n")) -> list[str]:
    """The parts of a text that are not blank, by the first separator that gives two of them, else by the last."""
    parts: list[str] = []
    for separator in separators:
        parts = list(filter(None, map(str.strip, re.split(separator, text))))
        if len(parts) > 1:
            break
    return parts


def passage_list(text: str, limit: int) -> list[str]:
    """Greedy packing of blocks up to ``limit`` characters.

    Blocks are paragraphs, or lines where there are fewer than two paragraphs; a block
    longer than the limit is cut by length. Short texts stay whole.
    """
    if len(text) <= limit:
        return [text]
    out: list[str] = []
    held: list[str] = []
    size = 0  # of the held blocks with line ends between them

    def flush() -> None:
        nonlocal size
        if held:
            out.append("\n".join(held))
        held.clear()
        size = 0

    for block in stripped_blocks(text):
        if len(block) > limit:
            flush()
            whole = (len(block) - 1) // limit
            out.extend(block[k * limit : (k + 1) * limit] for k in range(whole))
            block = block[whole * limit :]
        if held and size + 1 + len(block) > limit:
            flush()
        size += len(block) + (1 if held else 0)
        held.append(block)
    flush()
    return out


def split_passages(docs: DataFrame, limit: int = 8000, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``passage_no`` and ``passage`` in place of the text; null texts have none."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        few = (texts.slice(k, 100) for k in range(0, len(texts), 100))  # as Python strings a few texts at a time
        return pa.concat_arrays([pa.array([], kind), *(pa.array([[] if t is None else passage_list(t, limit) for t in x.to_pylist()], kind) for x in few)])

    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode(cut(text)).alias("passage_no", "passage"))


def paragraphs(passages: DataFrame, text: str = "passage", pattern: str = PARAGRAPH) -> DataFrame:
    """One row for each paragraph, with its place and its stripped text."""
    kept = [c for c in passages.columns if c != text]
    return passages.select(*kept, F.posexplode(F.split(text, pattern)).alias("paragraph_no", "paragraph"))


def sharded(rows: DataFrame, index: str, shards: int) -> DataFrame:
    """``shard`` of each row: its index modulo the number of shards."""
    return rows.withColumn("shard", F.pmod(F.col(index), F.lit(shards)))
