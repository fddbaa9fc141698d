"""Table functions for SQL: windows, passages and token packing.

``register`` names them in a session. Windows and packing take a table argument with
``PARTITION BY``, so that Spark deals the documents, or the groups that are packed apart, over the
cluster and orders them; a function then sees its rows one after the other and holds a few numbers.

    SELECT * FROM token_windows(TABLE(tokens) PARTITION BY (doc_id), 512, 128)
    SELECT * FROM passages(TABLE(documents), 8000)
    SELECT * FROM packed(TABLE(sizes) PARTITION BY (shard) ORDER BY (seq), 510)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from spanloom.operators.passages import passage_list


@udtf(returnType="doc_id bigint, win int, first bigint, last bigint")
class TokenWindows:
    """Overlapping windows of a partition's tokens; see ``sequence.windows``. The partition is one ``doc_id``.

    A row is a token, or stands for ``n_tokens`` of them where the table has that column: whoever counts
    tokens first has one call a document instead of one a token.
    """

    def __init__(self) -> None:
        self.n, self.doc, self.content, self.stride = 0, None, 0, 0

    def eval(self, row: Row, max_length: int, stride: int) -> None:
        if self.doc is None:
            self.doc, self.content, self.stride = row["doc_id"], max_length - 2, stride
            if self.content < 1 or not 0 <= stride < self.content:
                raise ValueError(f"stride must be between 0 and {self.content - 1}")
        self.n += row["n_tokens"] if "n_tokens" in row else 1

    def terminate(self) -> Iterator[tuple]:
        win = first = 0
        while self.n and (not win or first + self.stride < self.n):
            yield self.doc, win, first, min(first + self.content, self.n)
            win, first = win + 1, first + self.content - self.stride


@udtf(returnType="doc_id bigint, passage_no int, passage string")
class Passages:
    """The passages of each ``text``, with its ``doc_id``; see ``passages.passage_list``. Null texts have none."""

    def eval(self, row: Row, limit: int) -> Iterator[tuple]:
        for k, passage in enumerate(passage_list(row["text"], limit) if row["text"] is not None else []):
            yield row["doc_id"], k, passage


@udtf(returnType='seq bigint, block bigint, "from" bigint, to bigint'.replace('"', "`"))
class Packed:
    """Where each row's ``n_tokens`` lie when those of a partition are joined in its order and cut every ``content``; see ``sequence.blocks``."""

    def __init__(self) -> None:
        self.at = 0

    def eval(self, row: Row, content: int) -> Iterator[tuple]:
        start, stop = self.at, self.at + row["n_tokens"]
        while self.at < stop:
            block = self.at // content
            end = min(stop, (block + 1) * content)
            yield row["seq"], block, self.at - start, end - start
            self.at = end


def register(spark: SparkSession) -> None:
    for name, f in (("token_windows", TokenWindows), ("passages", Passages), ("packed", Packed)):
        spark.udtf.register(name, f)
