"""Web archives, and their index by an external merge.

1. Pages become WARC 1.1 records, one gzip member each, in archives of bounded size. Of equal payloads the
   page with the largest id is a response, the others are revisits of it.
2. Archives are read back record by record; every task's captures, sorted by URL key, timestamp and id,
   are written as a run.
3. The key space is cut into ranges, and the place of each cut in each run is found. A task per range opens the runs that have rows
   of it, and merges these by a loser tree, reading a few rows of a run at a time. Where there are more than ``FAN_IN`` runs, they
   are merged in groups first. The ranges are the partitions of the result, in their order.

Archives get a new name in each attempt of a task, and only those that a committed row names are read, so that
a task may run again at any time.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import files_of, fresh_path, materialize, open_store, read_table, small_batches

ARCHIVE_BYTES = 64 << 20
FAN_IN = 64
ROWS_PER_RANGE = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges of the merge at most, beyond which they hold more rows, and keys that the cuts between them are chosen from.
MOST_RANGES, SAMPLED_KEYS = 20_000, 200_000
#: Pages have no time of capture: page n counts as fetched n seconds after this. Timestamps of 14 digits end with the year
#: 9999; ids beyond, and negative ones, start over.
FIRST_CAPTURE = datetime(2020, 1, 1, tzinfo=timezone.utc)
CYCLE = 250 * 10**9
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, archive string, record_at long"
_FIELDS = [x.split()[0] for x in CAPTURES.split(", ")]
_ARROW = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type", "url_key", "captured", "archive") else pa.int64()) for n in _FIELDS])


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: the host backwards, then path and sorted query; no scheme, port 80/443 or fragment."""
    if not url or not url.strip():
        return ""
    url = url.strip()
    try:
        parts = urlsplit(url if "://" in url else f"http://{url}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    port_ = f":{port}" if port and port not in (80, 443) else ""
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return (",".join(reversed(host.split("."))) + port_ + ")" + (parts.path or "/") + (f"?{query}" if query else "")).lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _captured(page_id: int | None) -> datetime:
    return FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % CYCLE)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_captured(page_id):%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    else:
        block += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class _Inflated(io.RawIOBase):
    """The text of gzip members in a row, in bounded memory; ``ended`` counts whole members' bytes."""

    def __init__(self, source, chunk: int = 1 << 20) -> None:
        self.source, self.chunk = source, chunk
        self.raw, self.held, self.at, self.z = b"", bytearray(), 0, None

    def member(self) -> Iterator[tuple[int, bytes]]:
        """Where each member starts, and its text."""
        while True:
            if not self.raw:
                self.raw = self.source.read(self.chunk)
                if not self.raw:
                    return
            start, z, out = self.at, zlib.decompressobj(31), []
            while not z.eof:
                if not self.raw:
                    self.raw = self.source.read(self.chunk)
                    if not self.raw:
                        raise ValueError("an archive ends within a record")
                out.append(z.decompress(self.raw))
                self.at += len(self.raw) - len(z.unused_data)
                self.raw = z.unused_data
            yield start, b"".join(out)


def decode_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and the payload, by the stated lengths."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}, payload


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page into archives of ``folder``; (archive, records) of those that count."""
    payload = F.coalesce("_html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("_page"), F.col("url").cast("string").alias("_url"), F.col("html").cast("string").alias("_html"))
    digests = rows.select("_page", F.sha1(payload.cast("binary")).alias("_hex"))
    copies = digests.groupBy("_hex").agg(F.max("_page").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # joined by the binary form: the join gets exchanges of its own, and a hot digest can be split
    copies = copies.select(F.unhex("_hex").alias("_digest"), "_keep")
    decided = rows.withColumn("_digest", F.unhex(F.sha1(payload.cast("binary")))).join(copies, "_digest", "left")
    decided = decided.select("_page", "_url", "_html", "_digest", "_keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out, name, held, n = None, "", 0, 0
        for batch in batches:
            for page, url, html, digest, keep in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, held, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                raw = _member(encode_record(page, url, (html or "").encode(), base64.b32encode(digest).decode(), keep, keep is not None and page != keep))
                out.write(raw)
                held, n = held + len(raw), n + 1
                if held >= archive_bytes:
                    out.close()
                    done, out = [*done, (name, n)], None
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["archive", "records"])

    return materialize(decided.mapInArrow(run, "archive string, records long"), "warc")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives that ``archives`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n = [], 0
                with fs.open_input_stream(f"{root}/{archive}", compression=None) as source:
                    for at, record in _Inflated(source).member():
                        fields, http, payload = decode_record(record)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(http["content-length"])
                        if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"record at {at} of {archive} is damaged")
                        when = datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%SZ")
                        rows.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), url_key(fields.get("warc-target-uri")), f"{when:%Y%m%d%H%M%S}", archive, at))
                        n += 1
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                if n != records:
                    raise ValueError(f"{archive} has {n} records, not {records}")
                if rows:
                    yield _batch(rows)

    return archives.mapInArrow(run, CAPTURES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class LoserTree:
    """Merges sorted iterators: an inner node holds the loser of the match below it, so that the next
    winner takes one comparison a level on the way up from the leaf that was read."""

    def __init__(self, sources: Iterable[Iterator[tuple]]) -> None:
        self.sources = [iter(s) for s in sources]
        self.k = len(self.sources)
        self.heads = [next(s, None) for s in self.sources]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        """Ended sources lose; ties go to the first source."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, node: int) -> int:
        # nodes 1..k-1 are matches and k..2k-1 leaves; filled from below without recursion
        best = [-1] * self.k + list(range(self.k))
        for i in range(self.k - 1, 0, -1):
            a, b = best[2 * i], best[2 * i + 1]
            best[i], self.losers[i] = (a, b) if self._less(a, b) else (b, a)
        return best[node] if self.k > 1 else 0

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            leaf = self.winner
            self.heads[leaf] = next(self.sources[leaf], None)
            node = (leaf + self.k) // 2
            while node:
                if self._less(self.losers[node], leaf) if self.k > 1 else False:
                    self.losers[node], leaf = leaf, self.losers[node]
                node //= 2
            self.winner = leaf


_LEAST = -(2**63) - 1
_KEY = ["url_key", "captured", "page_id", "archive", "record_at"]


def _key(url: str, captured: str, page: int | None, archive: str, at: int) -> tuple:
    return url, captured, _LEAST if page is None else page, archive, at


def segments(spark, files: list[tuple[int, int, str]], cuts: list[tuple]) -> DataFrame:
    """Which rows of each sorted file fall in which range of keys: (range_id, run, part, file, lo, hi).

    Range i + 1 begins with the key ``cuts[i]``; the place of each cut in a file is found by bisection. ``files`` are
    (run, part of the run, path); a file that is not in order fails here or in the merge.
    """
    shared = spark.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for run_, part, uri in (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)):
            fs, path = open_store(uri)
            out, i, start, base, last = [], 0, 0, 0, None
            with fs.open_input_file(path) as f:
                for rows in pq.ParquetFile(f).iter_batches(1 << 16, columns=_KEY):
                    columns, n = [rows.column(c) for c in _KEY], rows.num_rows
                    key = lambda j, columns=columns: _key(*[c[j].as_py() for c in columns])
                    if last is not None and key(0) < last:
                        raise ValueError(f"{uri} is not in order")
                    last, j = key(n - 1), 0
                    while i < len(cuts) and cuts[i] <= last:
                        j = bisect_left(range(n), cuts[i], lo=j, key=key)
                        if base + j > start:
                            out.append((i, run_, part, uri, start, base + j))
                        start, i = base + j, i + 1
                    base += n
            if base > start:
                out.append((i, run_, part, uri, start, base))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["range_id", "run", "part", "file", "lo", "hi"])

    given = spark.createDataFrame(files, "run int, part int, file string").repartition(max(1, len(files)))
    return materialize(given.mapInArrow(run, "range_id int, run int, part int, file string, lo long, hi long"), "segments")


def _segment_rows(parts: list[tuple[int, str, int, int]]) -> Iterator[tuple]:
    """(key, row) of a run's parts (part, file, first row, end) in their order, a few rows at a time."""
    last = None
    for _, uri, lo, hi in sorted(parts):
        fs, path = open_store(uri)
        with fs.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            groups, base, at = [], 0, 0
            for g in range(file.num_row_groups):
                end = at + file.metadata.row_group(g).num_rows
                if at < hi and lo < end:
                    base = base if groups else at
                    groups.append(g)
                at = end
            for batch in file.iter_batches(1024, row_groups=groups, columns=_FIELDS):
                first, end = max(0, lo - base), min(hi - base, batch.num_rows)
                base += batch.num_rows
                batch = batch.slice(first, max(0, end - first))
                for row in zip(*[batch.column(c).to_pylist() for c in _FIELDS], strict=True):
                    key = _key(*[row[i] for i in _KEY_AT])
                    if last is not None and key < last:
                        raise ValueError(f"{uri} is not in order")
                    last = key
                    yield key, row


_KEY_AT = [_FIELDS.index(c) for c in _KEY]


def merge_segments(found: DataFrame, units: int, unit, starts: list[int] | None = None) -> DataFrame:
    """Merge the segments of each unit by a loser tree over its runs; the rows of unit i are partition i, in order.

    ``unit`` is an expression of (range_id, run). With the number of the first row of each unit, rows get range_id and position.
    """
    dealt = found.select(unit.cast("int").alias("unit"), "run", "part", "file", "lo", "hi").repartitionById(units, "unit")
    schema = _ARROW if starts is None else _ARROW.append(pa.field("range_id", pa.int32())).append(pa.field("position", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, dict[int, list]] = {}
        for batch in batches:
            for i, run_, *segment in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                runs.setdefault(i, {}).setdefault(run_, []).append(tuple(segment))
        for i in sorted(runs):
            rows, n = [], starts[i] if starts is not None else 0
            for _, row in LoserTree([_segment_rows(runs[i][r]) for r in sorted(runs[i])]):
                rows.append(row if starts is None else (*row, i, n))
                n += 1
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, CAPTURES if starts is None else CAPTURES + ", range_id int, position long")


def capture_histories(captures: DataFrame, fan_in: int = FAN_IN, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Captures in the order of URL key, timestamp and page id, by an external merge of sorted runs.

    Partition i of the result holds range i of the keys, in order, so that the rows of all partitions in a row are in one global
    order; ``position`` numbers them from 0. More than ``fan_in`` runs are merged in groups first, all groups in one job.
    """
    spark = captures.sparkSession
    folder = fresh_path(spark, "runs")
    # small row groups, so that a range reads little more than its own rows of a run
    captures.sortWithinPartitions("url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "record_at").write.option("parquet.block.size", 1 << 20).parquet(folder)
    stored = spark.read.schema(captures.schema).parquet(folder)
    files = [(i, 0, f) for i, f in enumerate(files_of(spark, folder))]
    total = stored.count()
    n = min(MOST_RANGES, max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1000), -(-total // rows_per_range)))
    # cuts from a bounded sample: they balance the ranges, every row is in one of them
    keys = sorted({_key(*r) for r in stored.sample(min(1.0, min(64 * n, SAMPLED_KEYS) / max(1, total)), seed=11).select(*_KEY).collect()})
    cuts = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    runs = len(files)
    while runs > fan_in:
        groups = -(-runs // fan_in)
        step = max(1, (len(cuts) + 1) * groups // max(n, groups))
        coarse = cuts[step - 1 :: step]
        found = segments(spark, files, coarse)
        folder = fresh_path(spark, "runs")
        unit = F.floor(F.col("run") / fan_in) * (len(coarse) + 1) + F.col("range_id")
        merge_segments(found, groups * (len(coarse) + 1), unit).write.option("parquet.block.size", 1 << 20).parquet(folder)
        # files are named by their partition, which is the unit
        files = [(*divmod(int(re.search(r"part-(\d+)-", f.rsplit("/", 1)[1])[1]), len(coarse) + 1), f) for f in files_of(spark, folder)]
        runs = groups
    found = segments(spark, files, cuts)
    sizes = {r.range_id: r.n for r in found.groupBy("range_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    starts = [0]
    for i in range(len(cuts)):
        starts.append(starts[-1] + sizes.get(i, 0))
    return merge_segments(found, len(starts), F.col("range_id"), starts)


def archive_and_index(pages: DataFrame) -> DataFrame:
    """Archives of all pages (page_id, url, html), read back as capture histories.

    Null html is an empty payload, a null url has an empty key, other columns are ignored. A null page_id
    is smaller than any other and is never referred to. Rows that repeat an id and a payload are
    records of the same type, next to each other in the history. Payloads of any length are one record. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = fresh_path(spark, "archives")
    archives = write_archives(pages, folder)
    return capture_histories(read_archives(archives.repartition(max(1, min(archives.count(), 10_000))), folder))


def op1_warc_index(spark, sf_dir: str) -> DataFrame:
    """One row per page, in the order of the index: what its record says, its URL key and time, and its place among all captures."""
    return archive_and_index(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


ORACLE = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, coalesce(url, '') AS u, strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS captured FROM pages
), parts AS (
    SELECT *, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[0-9]*\.', '') AS host,
           regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?([^#]*)', 1) AS query FROM p
), keyed AS (
    SELECT page_id, payload, captured, lower(CASE WHEN u = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
           || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END) AS url_key FROM parts
)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(sha1(payload), 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to,
       url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position
FROM keyed WINDOW g AS (PARTITION BY payload)
"""
