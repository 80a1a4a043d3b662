"""WARC archives and their capture index, merged from sorted runs.

Each task sorts its pages by (URL key, time, id) and writes them as one archive of gzip members: a locally sorted run.
A sparse index keeps every run's key and offset once in STEP bytes, and its last. Keys picked from it cut the key
space into ranges of about RANGE_BYTES; a range is a contiguous slice of each run, and one task merges its slices
through a loser tree, reading members as it goes. The ranges in turn are the captures in global order. A range holds
its share of bytes and no more, whatever the number of runs, and a URL that a third of all captures share is cut by
time and id. Captures that are equal in all three stay in one range.

No more than FAN_IN runs are merged at once: of more runs, each FAN_IN are first merged into new archives by ranges,
whose members are copied as they are, and so on. New archives of one group follow one another, so that a later range
meets one or two of them.

Of records with equal payloads of REVISIT_BYTES or more, that with the largest page_id is the response and the others
are revisits of it, which keep the HTTP header but no payload.

Nulls: a null html is an empty payload; a null page_id sorts below all others and comes back as null; a null url
has no target URI and the empty key. Records that share both payload and the largest page_id are all responses.
Repeated rows are repeated records. Very long payloads are held one at a time. Empty tables give an empty result.
Columns besides page_id, url, html are not read. Files go to the shared folder by pyarrow's file systems, under a
name of their own for each attempt; files of lost attempts are never referred to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, new_folder, ship, written

REVISIT_BYTES = 1000
STEP = 256 << 10
RANGE_BYTES = 16 << 20
#: Ranges are wider than RANGE_BYTES where there would be more of them; so many keys are on the driver at most, PICKED
#: for each.
MOST_RANGES = 100_000
PICKED = 8
#: Runs that are merged at once.
FAN_IN = 256
#: Of the buffers that a task reads its slices through.
BUFFERS = 64 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """A sort-friendly key: host labels reversed, lower case, no scheme, port, user, www or fragment."""
    if not url:
        return ""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    host, rest = m.groups() if m else ("", url.partition("#")[0])
    host = re.sub(r":\d+$", "", host.rpartition("@")[2]).lower().removeprefix("www.")
    path, mark, query = rest.partition("?")
    query = "&".join(sorted(query.split("&"))) if mark else ""
    return f"{','.join(reversed(host.split('.')))}){(path or '/').lower()}{mark}{query}"


def captured_at(page_id: int | None) -> str:
    """Pages have no time of their own: one second for each id from EPOCH on."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 1_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def sort_key(key: str, time: str, page_id: int | None) -> tuple:
    return (key, time, page_id is not None, page_id or 0)


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _header_value(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as it stands in an archive before compression."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {captured_at(page_id)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}


def _page(urn: str) -> int | None:
    n = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(n) if n else None


def key_of(raw: bytes) -> tuple:
    """The sort key of one record."""
    w = _fields(raw.partition(b"\r\n\r\n")[0])
    return sort_key(url_key(w.get("warc-target-uri")), w["warc-date"], _page(w["warc-record-id"]))


def parse(raw: bytes) -> tuple:
    """(sort key, page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    w = _fields(head)
    block = rest[: int(w["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(w["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(_fields(http)["content-length"])
    if w["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{w['warc-record-id']}: the payload doesn't match its digest")
    page, key = _page(w["warc-record-id"]), url_key(w.get("warc-target-uri"))
    return sort_key(key, w["warc-date"], page), page, size, digest, w["warc-type"], _page(w["warc-refers-to"]) if "warc-refers-to" in w else None, key, w["warc-date"]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def members(uri: str, start: int, end: int, chunk: int = 64 << 10) -> Iterator[tuple[bytes, bytes]]:
    """The gzip members that begin in [start, end), one at a time, unpacked and as they are."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        left, parts, packed, unzip = b"", [], [], None
        at = start  # of the first byte in left
        while True:
            if not left:
                left = f.read(chunk)
                if not left:
                    return
            if unzip is None:
                if at >= end:
                    return
                unzip, parts, packed = zlib.decompressobj(31), [], []
            parts.append(unzip.decompress(left))
            used = len(left) - len(unzip.unused_data)
            packed.append(left[:used])
            at += used
            left = unzip.unused_data
            if unzip.eof:
                yield b"".join(parts), b"".join(packed)
                unzip = None


class LoserTree:
    """k-way merge of sorted iterators of tuples by their first item: one comparison a level for each item taken."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = len(runs)
        self.losers = [-1] * k
        winners = [-1] * k + list(range(k))
        for i in range(k - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            winners[i], self.losers[i] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def __iter__(self):
        k = len(self.runs)
        if not k:
            return
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            i = (at + k) // 2
            while i:
                if self._first(self.losers[i], at):
                    self.losers[i], at = at, self.losers[i]
                i //= 2
            self.winner = at


def _kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, and for revisits the page that is the response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.select("page_id", "url", payload.alias("payload")).withColumns({"size": F.octet_length("payload"), "digest": F.sha1("payload")})
    # only payloads that occur twice go on; written, so that the join's strategy follows their size
    twice = seen.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1 and first is not null")
    twice = written(twice.select("digest", "first"), "warc-payloads")
    return seen.join(twice, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


INDEX = "run string, size bigint, offset bigint, key string, time string, page_id bigint"


class Archive:
    """One file of members, and the entries of its sparse index."""

    def __init__(self, folder: str):
        self.uri, self.out, self.offset, self.last, self.rows = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, -STEP, []
        self.latest: tuple | None = None

    def add(self, packed: bytes, key: str, time: str, page_id: int | None) -> None:
        if self.out is None:
            system, path = _open(self.uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = system.open_output_stream(path, compression=None)
        self.latest = (self.offset, key, time, page_id)
        if self.offset - self.last >= STEP:
            self.rows.append(self.latest)
            self.last = self.offset
        self.out.write(packed)
        self.offset += len(packed)

    def index(self):
        """A batch of INDEX, of one row at least where there is a record."""
        import pyarrow as pa

        if self.out is not None:
            self.out.close()
        if self.latest is not None and self.rows[-1] != self.latest:
            self.rows.append(self.latest)
        m = len(self.rows)
        cols = list(zip(*self.rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([self.uri] * m, pa.string()), pa.array([self.offset] * m, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["run", "size", "offset", "key", "time", "page_id"])


def _placed(pages: DataFrame) -> DataFrame:
    """The pages with `key` and `time`, taken in Arrow; payloads aren't sent for it."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def key(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: "" if u is None else url_key(_header_value(u)))

    # ids as text: a null among them would make them floats
    @F.pandas_udf("string")
    def time(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: captured_at(None if i is None else int(i)))

    return pages.withColumns({"key": key("url"), "time": time(F.col("page_id").cast("string"))})


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives in folder; gives the sparse index: run, size (of the run's file), place, offset, key columns."""

    def run(batches):
        archive = Archive(folder)
        for b in batches:
            for page_id, url, payload, refers_to, key, time in zip(*(c.to_pylist() for c in b.columns)):
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                archive.add(pack.compress(record(page_id, url, payload, refers_to, refers_to is not None)) + pack.flush(), key, time, page_id)
        yield archive.index()

    placed = _placed(_kinds(pages)).sortWithinPartitions("key", "time", F.col("page_id").asc_nulls_first())
    return in_arrow(placed.select("page_id", "url", "payload", "refers_to", "key", "time"), run, INDEX)


def _cuts(index: DataFrame, ranges: int, total: int) -> list[tuple]:
    """Keys that cut the key space into so many ranges of about equal bytes, at most."""
    # a sample that the number of ranges bounds, thinned where the index is kept
    share = min(1.0, PICKED * ranges * STEP / max(1, total))
    picked = index.where(F.xxhash64("run", "offset") <= min(2**63 - 1, int(share * 2**64) - 2**63)).select("key", "time", "page_id").collect()
    keys = sorted(sort_key(r["key"], r["time"], r["page_id"]) for r in picked)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _slices(index: DataFrame, cuts) -> DataFrame:
    """(lot, range, run, start, end): the part of each run that a range of its lot reads."""

    def slices(key, table):
        import pyarrow as pa

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("offset", "key", "time", "page_id"))))
        size, lot, own, bounds = table.column("size")[0].as_py(), table.column("lot")[0].as_py(), [sort_key(*r[1:]) for r in rows], cuts.value
        found = []
        # only ranges between the run's first key and its last
        for n in range(bisect.bisect_right(bounds, own[0]), bisect.bisect_right(bounds, own[-1]) + 1):
            # from the last entry below the range on: records that are equal to its cut may lie before the next entry
            start = rows[max(0, bisect.bisect_left(own, bounds[n - 1]) - 1)][0] if n else 0
            after = bisect.bisect_left(own, bounds[n]) if n < len(bounds) else len(own)
            end = rows[after][0] if after < len(rows) else size
            if start < end:
                found.append((lot, n, key[0].as_py(), start, end))
        cols = list(zip(*found)) or [()] * 5
        return pa.table({"lot": pa.array(cols[0], pa.int64()), "range": pa.array(cols[1], pa.int32()), "run": pa.array(cols[2], pa.string()), "start": pa.array(cols[3], pa.int64()), "end": pa.array(cols[4], pa.int64())})

    return index.groupBy("run").applyInArrow(lambda key, t: slices(key, t), "lot bigint, range int, run string, start bigint, end bigint")


def _merged(given: DataFrame, cuts, tasks: int, each, schema: str) -> DataFrame:
    """Batches of each(lot, range, captures) for every lot and range; captures: (key, record, its member as it is)."""

    def within(n, run, start, end, chunk):
        bounds = cuts.value
        low, high = bounds[n - 1] if n else None, bounds[n] if n < len(bounds) else None
        for raw, packed in members(run, start, end, max(4096, min(chunk, end - start))):
            key = key_of(raw)
            if high is not None and key >= high:
                return
            if low is None or key >= low:
                yield key, raw, packed

    def merge(batches):
        def one(lot, n, found):
            yield from each(lot, n, iter(LoserTree([within(n, *g, min(64 << 10, BUFFERS // len(found))) for g in found])))

        now, found = None, []
        for b in batches:
            for lot, n, run, start, end in zip(*(c.to_pylist() for c in b.columns)):
                if (lot, n) != now and found:
                    yield from one(*now, found)
                    found = []
                now = (lot, n)
                found.append((run, start, end))
        if found:
            yield from one(*now, found)

    dealt = given.select("lot", "range", "run", "start", "end").repartition(tasks, "lot", "range").sortWithinPartitions("lot", "range", "run")
    return in_arrow(dealt, merge, schema)


def fewer(index: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The index, with `lot`: archives of one lot don't overlap. There are FAN_IN lots at most: of more, each FAN_IN
    are merged into one, whose archives are ranges of the key space."""
    spark = index.sparkSession
    index = index.withColumn("lot", F.xxhash64("run"))
    while True:
        lots, total = index.groupBy("lot", "run").agg(F.max("size").alias("size")).agg(F.countDistinct("lot"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if lots <= FAN_IN:
            return index
        groups = -(-lots // FAN_IN)
        ranges = max(1, min(MOST_RANGES, -(-total // (range_bytes * groups))))
        cuts = spark.sparkContext.broadcast(_cuts(index, ranges, total))

        def copied(lot, n, captures):
            archive = Archive(folder)
            for (key, time, known, page_id), _, packed in captures:
                archive.add(packed, key, time, page_id if known else None)
            b = archive.index()
            yield b.append_column("lot", pa_longs(lot, b.num_rows))

        given = _slices(index.withColumn("lot", F.pmod(F.xxhash64("lot"), F.lit(groups))), cuts)
        index = written(_merged(given, cuts, ranges * groups, copied, f"{INDEX}, lot bigint"), "warc-index")


def pa_longs(value: int, n: int):
    import pyarrow as pa

    return pa.array([value] * n, pa.int64())


def merged(index: DataFrame, range_bytes: int = RANGE_BYTES, folder: str | None = None) -> DataFrame:
    """Every capture of the runs in global order of (url_key, captured, page_id): by `range`, and by `place` in it."""
    spark = index.sparkSession
    index = fewer(index, folder or new_folder(spark, "warc-merged"), range_bytes)
    total = index.groupBy("run").agg(F.max("size").alias("size")).agg(F.sum("size")).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, -(-total // range_bytes)))
    cuts = spark.sparkContext.broadcast(_cuts(index, ranges, total))

    def told(_, n, captures):
        import pyarrow as pa

        def out(rows, place):
            cols = list(zip(*rows))
            m = len(rows)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[1:], kinds)] + [pa.array([n] * m, pa.int32()), pa.array(range(place, place + m), pa.int64())], names=NAMES)

        rows, place = [], 0
        for _, raw, _ in captures:
            rows.append(parse(raw))
            if len(rows) == 5000:
                yield out(rows, place)
                place, rows = place + 5000, []
        if rows:
            yield out(rows, place)

    given = _slices(index.withColumn("lot", F.lit(0).cast("long")), cuts)
    return _merged(given, cuts, ranges, told, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, captured string, range int, place bigint")


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range", "place"]


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, merge their runs, and give what the records say in the order of captures."""
    folder = new_folder(pages.sparkSession, "warc")
    return merged(written(write(pages, folder), "warc-index"))
