"""WARC derivative builder: metadata and plain-text conversion records from responses.

``derive`` turns every response record into two records that refer to it by identifier:
a ``metadata`` record (warc-fields: title, outgoing links, the response's own WARC and
HTTP headers and its digests) and a ``conversion`` record with the page's plain text.
Both are made of built-in functions only, row by row, without a shuffle. ``read_warc``
and ``write_warc`` take records from and to files.

Plain text: comments, scripts, styles, noscripts and templates go; block tags become
line ends and other tags nothing; named entities of markup and a few signs are decoded;
spaces and line ends are folded. A tag that the page's end cuts off goes too.

Defined results: a null page is an empty one, a null address an empty one; pages of any
length are taken whole; repeated rows give repeated records with equal identifiers; an
empty table gives no rows; further columns of the input are kept by ``derive`` only under
``page_id``, the caller's key, and a null in any of the others is empty. Entities other than those listed stay as they are.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table
from spanloom.llm.registry import ORACLES, QUERIES

DATE = "2024-01-01T00:00:00Z"
HIDDEN = r"(?is)<!--.*?-->|<(?:script|style|noscript|template)\b[^>]*>.*?</(?:script|style|noscript|template)\s*>"
BLOCK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li"
    r"|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
)
TAG = r"<[!/?a-zA-Z][^>]*>|<[!/?a-zA-Z][^<>]*\z"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
#: addresses of anchors and areas, in double, single or no quotes
LINK = r"""(?i)<(?:a|area)\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
CHARSET = re.compile(rb"""(?i)charset\s*=\s*["']?\s*([A-Za-z0-9._:-]+)""")
QUOTES = r"""^["']|["']\z"""
#: fixed values: entities and what they stand for; the ampersand comes last
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&#160;", " "),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&amp;", "&"),
)


def plain_text(html: Column) -> Column:
    """The text of a page, lines parted by single line ends."""
    x = F.regexp_replace(html, HIDDEN, "")
    x = F.regexp_replace(x, r"[ \t\r\n\f\x0b]+", " ")
    x = F.regexp_replace(x, BLOCK, "\n")
    x = decoded(F.regexp_replace(x, TAG, ""))
    x = F.regexp_replace(F.regexp_replace(x, " +", " "), r" ?\n[ \n]*", "\n")
    return F.btrim(x, F.lit(" \n"))


def decoded(x: Column) -> Column:
    """``x`` with its entities as signs; texts are cut at the ampersands, and names looked up between these."""
    signs = F.create_map(*[F.lit(y) for entity, sign in ENTITIES for y in (entity[1:-1], sign)])

    def part(rest: Column, k: Column) -> Column:
        name = F.substring_index(rest, ";", 1)
        sign = F.when((k > 0) & F.contains(rest, F.lit(";")), F.element_at(signs, name))
        return F.coalesce(F.concat(sign, F.substr(rest, F.length(name) + 2)), F.when(k > 0, F.concat(F.lit("&"), rest)).otherwise(rest))

    return F.array_join(F.transform(F.split(x, "&"), part), "")  # x stands here once: it is computed once


def one_line(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[ \t\r\n\f\x0b]+", " "), r"^ | \z", "")


def identifier(*parts: Column) -> Column:
    """A record identifier made from the parts' digest, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages: what a crawler would have stored for each row."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n")
    )
    return pages.select(
        "page_id",
        identifier(F.lit("response"), url, F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        http.alias("http_headers"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
        digest(F.concat(http, html)).alias("block_digest"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: ``record_type`` metadata and conversion.

    ``headers`` is the record's header as written to a file, ``block`` its content. Where
    ``source`` has ``warc_headers``, the metadata record lists all of these lines.
    """
    known = [c for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest", "block_digest", "warc_headers") if c in source.columns]
    source = source.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in known])

    def lines(name: str, before: str) -> Column:
        x = F.regexp_replace(name, r"(?:\r\n)+\z", "")
        return F.when(x != "", F.concat(F.regexp_replace(x, r"(?m)^", before), F.lit("\r\n"))).otherwise("")

    links = F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), lambda x: decoded(F.regexp_replace(x, QUOTES, "")))
    fields = F.concat(
        F.lit("title: "), one_line(decoded(F.regexp_extract("payload", TITLE, 1))), F.lit("\r\nlinks: "), F.size(links).cast("string"), F.lit("\r\n"),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), one_line(x), F.lit("\r\n"))), ""),
        F.lit("source-record-id: "), F.col("record_id"), F.lit("\r\nsource-date: "), F.col("warc_date"),
        F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\nsource-block-digest: "), F.col("block_digest"), F.lit("\r\n"),
        lines("http_headers", "source-http: "), *([lines("warc_headers", "source-warc: ")] if "warc_headers" in source.columns else []),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    flat = source.withColumn("made", F.explode(made))
    out = flat.select(
        "page_id",
        F.col("made.record_type"),
        identifier(F.col("made.record_type"), F.col("record_id")).alias("derived_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("made.content_type"),
        F.col("made.block"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("block_digest").alias("source_block_digest"),
    )
    out = out.withColumn("content_length", F.octet_length("block").cast("long")).withColumn("block_digest", digest(F.col("block")))
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("derived_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    return out.withColumn("headers", header).withColumnRenamed("derived_id", "record_id")


def write_warc(records: DataFrame, path: str) -> None:
    """Records with ``headers`` and ``block`` as WARC files, one for each partition."""
    lines = records.select(F.concat("headers", F.lit("\r\n"), "block").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").text(path)


class Reader:
    """Records of one WARC file from its lines, which come one after the other and may be cut anywhere."""

    def __init__(self) -> None:
        self.headers: dict[str, str] = {}
        self.head: list[bytes] = []
        self.block: list[bytes] = []
        self.left = -1  # bytes that the block still lacks; below zero outside a block

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
        """The records that ``data`` (a whole line of the header, or any bytes of a block) ends."""
        while data:
            if self.left >= 0:
                self.block.append(data[: self.left])
                self.left, data = self.left - len(self.block[-1]), data[self.left :]
            else:
                line, end, data = data.partition(b"\n")
                text = line.rstrip(b"\r")
                if text:
                    if not self.head and not text.startswith(b"WARC/"):
                        raise ValueError(f"not a WARC record: {text[:40]!r}")
                    self.head.append(text)
                    if len(self.head) > 1:
                        name, _, value = text.decode("utf-8", "replace").partition(":")
                        self.headers[name.strip().lower()] = value.strip()
                elif self.head:
                    self.left = int(self.headers.get("content-length", 0))
            if self.left == 0:
                yield self.headers, [x.decode("utf-8", "replace") for x in self.head[1:]], b"".join(self.block)
                self.__init__()  # type: ignore[misc]


RECORDS = (
    "path string, record_type string, record_id string, refers_to string, target_uri string, warc_date string, headers map<string,string>, "
    "header_lines array<string>, block binary"
)


def _batches(records: Iterator[tuple[str, dict[str, str], list[str], bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Records as batches of about ``limit`` bytes."""
    names = {"record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "warc_date": "warc-date"}
    held: list[tuple[str, dict[str, str], list[str], bytes]] = []

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"path": [x[0] for x in held]}
            | {k: pa.array([x[1].get(n) for x in held], pa.string()) for k, n in names.items()}
            | {
                "headers": pa.array([list(x[1].items()) for x in held], pa.map_(pa.string(), pa.string())),
                "header_lines": pa.array([x[2] for x in held], pa.list_(pa.string())),
                "block": pa.array([x[3] for x in held], pa.binary()),
            }
        )

    size = 0
    for record in records:
        held.append(record)
        size += len(record[3])
        if size > limit:
            yield emit()
            held, size = [], 0
    if held:
        yield emit()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: headers as a map and as lines, and the block.

    Compressed files (``.gz``, any number of members) are streamed line by line, each on one
    task, which holds a record at a time. Other files are loaded whole, below 2 GB each.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("path not like '%.gz'").select("path", "content")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[str, dict[str, str], list[str], bytes]]:
            reader, last = Reader(), None
            for batch in batches:
                for where, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()):
                    if where != last:
                        reader, last = Reader(), where
                    for record in reader.feed(line + b"\n"):
                        yield where, *record

        return _batches(records())

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[str, dict[str, str], list[str], bytes]]:
            for batch in batches:
                for where, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                    reader, stream = Reader(), io.BytesIO(data.as_py())
                    while piece := (stream.read(reader.left) if reader.left > 0 else stream.readline()):
                        for record in reader.feed(piece):
                            yield where, *record

        return _batches(records())

    return lines.mapInArrow(stream, RECORDS).unionByName(files.mapInArrow(load, RECORDS))


def charset(head: bytes, body: bytes) -> str:
    """The codec that the HTTP head names, or else the page's first bytes; UTF-8 where none is known."""
    for part in (head, body[:1024]):
        if m := CHARSET.search(part):
            try:
                return codecs.lookup(m[1].decode("ascii")).name
            except LookupError:
                pass
    return "utf-8"


def from_warc(records: DataFrame) -> DataFrame:
    """Response records read by ``read_warc`` in the columns that ``derive`` takes; texts by their charset."""
    schema = (
        "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string, "
        "block_digest string, warc_headers string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                block, own = r["block"] or b"", dict(r["headers"] or ())
                head, gap, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                made = lambda x: "sha256:" + hashlib.sha256(x).hexdigest()
                out.append((
                    None, r["record_id"], r["target_uri"] or "", r["warc_date"], (head + gap).decode("utf-8", "replace"),
                    body.decode(charset(head, body), "replace"), own.get("warc-payload-digest") or made(body),
                    own.get("warc-block-digest") or made(block), "\r\n".join(r["header_lines"] or ()),
                ))
            kinds = [pa.int64(), *[pa.string()] * 8]
            yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array([x[k] for x in out], kinds[k]) for k, c in enumerate(schema.split(", "))})

    fresh = records.where("record_type = 'response'").select("record_id", "target_uri", "warc_date", "headers", "header_lines", "block")
    return fresh.mapInArrow(run, schema)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(table(spark, sf_dir, "pages")))
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest",
        "source_payload_digest", "source_block_digest", "headers", "block",
    )


QUERIES["op1_warc_derivatives"] = op1_warc_derivatives


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"

    def entities(x: str) -> str:
        for entity, sign in ENTITIES:
            x = f"replace({x}, {q(entity)}, {q(sign)})"
        return x

    def swap(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {q(pattern)}, {to}, 'g')"

    def line(x: str) -> str:
        return swap(swap(x, r"[ \t\r\n\f\x0b]+", "' '"), r"^ | \z", "''")

    def ident(*parts: str) -> str:
        h = f"md5(concat_ws('|', {', '.join(parts)}))"
        cuts = " || '-' || ".join(f"substr({h}, {s}, {n})" for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'<urn:uuid:' || {cuts} || '>'"

    text = swap(swap("payload", HIDDEN, "''"), r"[ \t\r\n\f\x0b]+", "' '")
    text = entities(swap(swap(text, BLOCK, "chr(10)"), TAG, "''"))
    text = swap(swap(swap(text, " +", "' '"), r" ?\n[ \n]*", "chr(10)"), r"^[ \n]+|[ \n]+\z", "''")
    links = f"list_transform(regexp_extract_all(payload, {q(LINK)}, 1), lambda x: {entities(swap('x', QUOTES, chr(39) * 2))})"
    outlinks = f"coalesce(array_to_string(list_transform({links}, lambda x: 'outlink: ' || {line('x')} || {crlf}), ''), '')"
    fields = " || ".join(
        [
            "'title: '", line(entities(f"regexp_extract(payload, {q(TITLE)}, 1)")), crlf, "'links: '", f"len({links})::VARCHAR", crlf, outlinks,
            "'source-record-id: '", "record_id", crlf, "'source-date: '", "warc_date", crlf, "'source-payload-digest: '", "payload_digest", crlf,
            "'source-block-digest: '", "block_digest", crlf, "'source-http: HTTP/1.1 200 OK'", crlf,
            "'source-http: Content-Type: text/html; charset=utf-8'", crlf, "'source-http: Content-Length: '", "strlen(payload)::VARCHAR", crlf,
        ]
    )
    named = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length::VARCHAR"),
    )
    header = " || ".join([f"'WARC/1.1' || {crlf}", *(f"'{name}: ' || {x} || {crlf}" for name, x in named)])
    return f"""
WITH page AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
), response AS (
  SELECT page_id, target_uri, payload, '{DATE}' AS warc_date,
    {ident("'response'", "target_uri", "coalesce(page_id::VARCHAR, '')")} AS record_id,
    'sha256:' || sha256(payload) AS payload_digest,
    'sha256:' || sha256('HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: '
      || strlen(payload)::VARCHAR || {crlf} || {crlf} || payload) AS block_digest
  FROM page
), made AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {fields} AS block FROM response
  UNION ALL
  SELECT *, 'conversion' AS record_type, 'text/plain' AS content_type, {text} AS block FROM response
), record AS (
  SELECT page_id, record_type, {ident("record_type", "record_id")} AS record_id, record_id AS refers_to, target_uri, warc_date, content_type,
    strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest AS source_payload_digest,
    block_digest AS source_block_digest, block
  FROM made
)
SELECT *, {header} AS headers FROM record
"""


ORACLES["op1_warc_derivatives"] = _sql()
