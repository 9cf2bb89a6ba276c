"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives one metadata record (application/warc-fields: facts about the page
and the source's headers) and one conversion record (text/plain). Both name the
response in WARC-Refers-To, carry its target and date, and have their own identifiers,
block and payload digests. Identifiers follow from the response's identifier, so a repeated run
writes the same records. Records are complete WARC/1.1 bytes; `write_warc` writes them as .warc.gz files,
`read_warc` reads such files in splits, and `responses_of_records` takes the HTTP responses of an archive apart.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

CRLF = "\r\n"
RESPONSE = "page_id bigint, record_id string, target_uri string, warc_date string, http_headers string, payload string"
DERIVED = "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, source_digest string, n_bytes bigint, record binary"
READ = "path string, place bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, block binary"
#: Bytes of a compressed file that one task reads.
SPLIT_BYTES = 64 << 20
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")
HIDDEN = {"script", "style", "noscript", "template", "svg", "head"}
# Elements that begin a line of their own.
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "aside", "main", "pre", "blockquote", "form", "title"}
HEAD_PARTS = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template", "noframes"}
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)")
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class PageText(HTMLParser):
    """Visible text, a line for each block element, and the facts of a page.

    A head ends at the first tag or text that cannot stand in one. Other hidden elements end with their parent, and an svg
    at a block element; what neither its own end tag nor that of a parent closes hides nothing.
    """

    def __init__(self, payload: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.title, self.lang, self.links, self.hidden, self.in_title = "", "", 0, 0, False
        self.open: list[tuple[str, bool]] = []  # elements, and whether they hide
        self.places: dict[str, list[int]] = defaultdict(list)
        self.left = Counter(x.lower() for x in _END_TAG.findall(payload))  # end tags to come
        self.past_head = False

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            tag, hides = self.open.pop()
            self.places[tag].pop()
            self.hidden -= hides

    def last_place(self, tag: str) -> int:
        return self.places[tag][-1] if self.places[tag] else -1

    def is_closed(self, tag: str) -> bool:
        """Script, style and head end by rules of their own, others by an end tag of theirs or of a parent in the body."""
        return tag in ("script", "style", "head") or self.left[tag] > 0 or any(n > 0 and self.places[x] for x, n in self.left.items() if x not in ("html", "body"))

    def leave_head(self) -> None:
        self.past_head = True
        if self.places["head"]:
            self.close_from(self.places["head"][0])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            self.lang = dict(attrs).get("lang") or ""
        if tag == "a" and dict(attrs).get("href"):
            self.links += 1
        if tag == "body":
            self.close_from(0)  # an unclosed head ends here
        if tag not in HEAD_PARTS and self.hidden <= len(self.places["head"]):
            self.leave_head()
        if tag in BLOCKS and tag != "title" and self.last_place("svg") > max(self.last_place("foreignobject"), self.last_place("template"), self.last_place("noscript")):
            self.close_from(self.last_place("svg"))
        if tag == "noscript" and self.places["noscript"]:
            self.close_from(self.last_place("noscript"))
        if tag == "title":
            self.in_title = True
        if tag not in VOID and not (tag == "head" and self.past_head):
            hides = tag in HIDDEN and self.is_closed(tag)
            self.places[tag].append(len(self.open))
            self.open.append((tag, hides))
            self.hidden += hides
        if tag not in HIDDEN and tag in BLOCKS:
            self.lines.append("")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.left[tag] += 1  # not among the end tags counted
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.left[tag] -= 1
        if tag == "title":
            self.in_title = False
        if tag == "head":
            self.leave_head()
        place = self.last_place(tag)
        # a template that its own end tag closes keeps stray end tags to itself
        if place >= 0 and not (self.last_place("template") > place and self.left["template"] > 0):
            self.close_from(place)
        if tag not in HIDDEN and tag in BLOCKS:
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
            return
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.leave_head()
        if not self.hidden:
            self.lines[-1] += data

    def text(self) -> str:
        return "\n".join(x for x in (_BLANKS.sub(" ", line).strip(" ") for line in self.lines) if x)


def page_text(payload: str) -> PageText:
    """Markup that the parser refuses counts as text."""
    page = PageText(payload)
    try:
        page.feed(payload)
        page.close()
    except (AssertionError, ValueError):
        page = PageText("")
        page.lines = [html.unescape(re.sub(r"<[^>]*>", " ", payload))]
    return page


def one_line(value: str) -> str:
    return _BLANKS.sub(" ", value).strip(" ")


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {one_line(v)}{CRLF}" for k, v in fields)
    return f"WARC/1.1{CRLF}{head}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block + b"\r\n\r\n"


def derive(row: dict) -> Iterator[tuple]:
    """The metadata and the conversion record of one response."""
    payload = row["payload"] or ""
    raw = payload.encode("utf-8", "surrogatepass")
    page = page_text(payload)
    source_digest = digest(raw)
    text = page.text().encode("utf-8", "surrogatepass")
    headers = [x for x in (row["http_headers"] or "").split(CRLF) if x]
    facts = [("title", page.title), ("language", page.lang), ("outlinks", str(page.links)), ("sourcePayloadDigest", source_digest), ("sourcePayloadLength", str(len(raw))), ("textLength", str(len(text)))]
    facts += [("httpStatus" if i == 0 else "httpHeader", h) for i, h in enumerate(headers)]
    meta = "".join(f"{k}: {one_line(v)}{CRLF}" for k, v in facts if one_line(v)).encode("utf-8", "surrogatepass")
    uri, date, source = row["target_uri"] or "", row["warc_date"] or "", row["record_id"] or ""
    for kind, content_type, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=UTF-8", text)):
        name = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {source}')}>"
        found = digest(block)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", found), ("WARC-Payload-Digest", found), ("Content-Type", content_type)]
        yield (row["page_id"], kind, name, row["record_id"], row["target_uri"], row["warc_date"], content_type, found, found, source_digest, len(block), record_bytes([f for f in fields if f[1]], block))


def derivative_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), *[pa.string()] * 9, pa.int64(), pa.binary())
    names = [f.split()[0] for f in DERIVED.split(", ")]
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            rows = [x for row in batch.slice(a, 256).to_pylist() for x in derive(row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def responses_of_pages(pages: DataFrame, warc_date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html): one row for each, all columns of RESPONSE.

    The identifier follows from id and url; a null url gives a null target.
    """
    seed = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), "url"))
    name = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(seed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit(CRLF))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), name.alias("record_id"), F.col("url").alias("target_uri"), F.lit(warc_date).alias("warc_date"), headers.alias("http_headers"), F.col("html").alias("payload"))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for every response, with complete records.

    A null payload counts as empty; null headers, targets and dates leave their fields out. A null page_id is carried
    along; a null record_id leaves the reference out, and such records share one identifier. Repeated
    responses give repeated records; an empty table gives none; other columns are ignored.
    """
    columns = [f.split()[0] for f in RESPONSE.split(", ")]
    return responses.select(*columns).mapInArrow(derivative_batches, DERIVED)


def split_http(block: bytes) -> tuple[str, bytes]:
    """The head (CRLF line ends) and the body of an HTTP response; without an empty line all is head."""
    found = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: found.start()], block[found.end() :]) if found else (block, b"")
    return CRLF.join(head.decode("utf-8", "replace").splitlines()) + CRLF, body


def unchunked(body: bytes) -> bytes:
    """A body of chunks put together; what follows a broken chunk head is dropped with it."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def decoded_body(head: str, body: bytes) -> tuple[bytes, str]:
    """The body without transfer and content encodings, and its character set.

    Truncated streams give what they hold; a body that is not what its header says, and one in an encoding
    this library has no decoder for, stays as it is.
    """
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split(CRLF)[1:])}
    if "chunked" in fields.get("transfer-encoding", "").lower() and re.match(rb"[0-9A-Fa-f]+\s*(;[^\r]*)?\r\n", body):
        body = unchunked(body)
    for coding in reversed([x.strip().lower() for x in fields.get("content-encoding", "").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                body = zlib.decompressobj(31).decompress(body)
            elif coding == "deflate":
                body = zlib.decompressobj(15 if body[:1] == b"\x78" else -15).decompress(body)
            elif coding == "zstd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except (zlib.error, zstandard.ZstdError):
            break
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I) or re.search(r"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", body[:4096].decode("latin-1"), re.I)
    return body, named.group(1) if named else "utf-8"


def response_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RESPONSE.split(", ")]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            head, body = split_http(r["block"] or b"")
            body, charset = decoded_body(head, body)
            try:
                payload = body.decode(charset, "replace")
            except LookupError:  # no such character set
                payload = body.decode("utf-8", "replace")
            rows.append((None, r["record_id"], r["target_uri"], r["warc_date"], head, payload))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.string()] * 5))], names)


def responses_of_records(records: DataFrame) -> DataFrame:
    """The RESPONSE rows of a table of WARC records (as `read_warc` gives): its response records, HTTP head and decoded text apart.

    Records of other types are passed over; page_id is null, since the archive has none (record_id names the response).
    """
    responses = records.filter(F.lower("record_type") == "response")
    return responses.select("record_id", "target_uri", "warc_date", "block").mapInArrow(response_batches, RESPONSE)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-case names) and block of every record of uncompressed WARC bytes."""
    stream = io.BytesIO(data)
    while (record := next_record(stream)) is not None:
        yield record


def next_record(stream) -> tuple[dict[str, str], bytes] | None:
    """The next record of a stream of uncompressed WARC bytes, or None at its end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    while (line := stream.readline()).strip():
        k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, stream.read(int(fields["content-length"]))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it: plain paths are local, URIs are those pyarrow knows."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Split(InputPartition):
    """The members that begin in bytes begin..end of a file."""

    path: str
    begin: int
    end: int


MEMBER = b"\x1f\x8b\x08"


def member(data: bytes, more: Callable[[], bytes]) -> tuple[bytes, bytes]:
    """One gzip member at the start of data: its content, and the bytes after it. Raises zlib.error if there is none."""
    unzip, parts = zlib.decompressobj(31), []
    while True:
        parts.append(unzip.decompress(data))
        if unzip.eof:
            return b"".join(parts), unzip.unused_data
        data = more()
        if not data:
            raise zlib.error("the file ends inside a member")


def members(file, begin: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
    """Contents of the members that begin in [begin, end). A place that only looks like a member start is passed over."""
    file.seek(begin)
    data, at = file.read(step), begin  # data begins at byte `at` of the file
    synced = begin == 0
    while at < end:
        if not synced:
            found = data.find(MEMBER)
            if found < 0:
                skip = max(0, len(data) - 2)
                data, at = data[skip:], at + skip
                more = file.read(step)
                if not more:
                    return
                data += more
                continue
            data, at = data[found:], at + found
            if at >= end:
                return
        elif not data:
            data = file.read(step)
            if not data:
                return
        held = [data]

        def more() -> bytes:
            held.append(file.read(step))
            return held[-1]

        try:
            content, rest = member(data, more)
            good = synced or content[:5] == b"WARC/"
        except zlib.error:
            if synced:
                raise
            good = False
        read = b"".join(held)
        if not good:
            data, at = read[1:], at + 1
            continue
        synced = True
        yield content
        data, at = rest, at + len(read) - len(rest)


class WarcReader(DataSourceReader):
    """.warc.gz files by byte ranges, a gzip member belongs to the range it begins in; .warc files whole, record by record."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.path)
        found = system.get_file_info(path)
        files = system.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            name = f.path.rpartition("/")[2]
            if f.type == fs.FileType.File and f.size and not name.startswith(("_", ".")):
                step = self.split if name.endswith(".gz") else f.size
                out += [Split(f.path, a, min(a + step, f.size)) for a in range(0, f.size, step)]
        return out

    def read(self, split: Split) -> Iterator[tuple]:
        keys = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-payload-digest", "warc-block-digest")
        system, _ = file_system(self.path)
        with system.open_input_file(split.path) as file:
            place = split.begin << 20
            if split.path.endswith(".gz"):
                found = (r for content in members(file, split.begin, split.end) for r in parse_records(content))
            else:
                stream = io.BufferedReader(file)
                found = iter(lambda: next_record(stream), None)
            for i, (fields, block) in enumerate(found):
                yield (split.path, place + i, *(fields.get(k) for k in keys), block)


@dataclass
class Written(WriterCommitMessage):
    made: str
    final: str


class WarcWriter(DataSourceWriter):
    """A .warc.gz file per partition, a gzip member per record; files get their names when the whole job commits."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, path = file_system(self.path)
        context = TaskContext.get()
        system.create_dir(path, recursive=True)
        final = f"{path.rstrip('/')}/part-{context.partitionId():05d}.warc.gz"
        made = f"{path.rstrip('/')}/_part-{context.partitionId():05d}-{context.taskAttemptId()}"
        with system.open_output_stream(made, compression=None) as out:
            for row in iterator:
                out.write(gzip.compress(bytes(row["record"]), 6, mtime=0))
        return Written(made, final)

    def commit(self, messages: list) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                system.move(m.made, m.final)

    def abort(self, messages: list) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.made)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").save(path) for tables with a column `record`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"])


def write_warc(records: DataFrame, path: str) -> None:
    """A .warc.gz file for each partition of the records below path, which must not hold files of an earlier job.

    Records with a null `record` are an error. An empty table writes files without members.
    """
    records.sparkSession.dataSource.register(WarcSource)
    records.select("record").write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the .warc and .warc.gz files below path, in splits of about split_bytes.

    place orders the records of a file. Missing fields are null; a file without records gives no rows; repeated records are read as often as they occur.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("split_bytes", str(split_bytes)).load(path)
