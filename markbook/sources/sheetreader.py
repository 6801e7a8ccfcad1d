"""Workbooks (.xlsx) as frames (S1-S4): many files, sheets of any length, from any store that Spark reads.

A first pass opens each file and deals out its entries as they are, compressed, in pieces. Then a task an entry decompresses it
as a stream, so it holds one block, whatever the sheet, and cuts blocks of whole rows. Rows in the plain form that most cells
have (no references, styles or runs) are told apart over the bytes of a block at once (``plain_rows``); blocks in any other
form are written as text in small ones, dealt by their numbers and parsed by Spark's own XML reader. Rows are numbered within
their entry; sheets that continue others (``sheetwriter``) add the rows before them, and are read without their header.
Shared strings are a table, joined by their number, never a list in a task: broadcast up to a counted bound; beyond it strings
that very many cells name are broadcast and the rest are joined by shuffle.

Blocks of text are small, since Spark's Parquet reader takes thousands of rows at a time, of any width: BLOCK bounds what a task holds.

Files that are no workbooks, and blocks that are no XML, are rows of the rejects, not errors.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from xml.etree import ElementTree as ET

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.operators.reshape import cell_positions
from markbook.session import importable, written
from markbook.sources.sheetwriter import CONTINUES

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BLOCK, READ, GATHER = 1 << 13, 1 << 13, 1 << 20
PLAIN, PIECE = 1 << 18, 1 << 18
MOST_BROADCAST, OFTEN = 200_000, 100_000

ENTRIES = "path string, place int, seq int, head string, data binary"
CUT = "path string, kind string, sheet string, sheet_no int, part int, first int, n int, xml string, values array<string>"
UNREADABLE = (zipfile.BadZipFile, zlib.error, KeyError, EOFError, ET.ParseError, UnicodeDecodeError, NotImplementedError, RuntimeError)
TEXT = "struct<t:string,r:array<struct<t:string>>>"
SHEET = f"struct<sheetData:struct<row:array<struct<c:array<struct<_r:string,_t:string,v:string,is:{TEXT}>>>>>>"
STRINGS = f"struct<si:array<{TEXT}>>"
XML = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


class Workbooks(NamedTuple):
    """rows: path, sheet, sheet_no, _row_no (from 0), cells (array of text); rejects: path, sheet, why."""

    rows: DataFrame
    rejects: DataFrame


def _bodies(stream, item: str, container: str, skip: int, block: int, read: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(first item's number, head, body, tail) of runs of whole ``item`` elements inside ``container``: head and tail make a body a
    document with the part's root.

    The first ``skip`` items are left out.
    Markup can't stand in text, so tags are found by their names; a name may have a prefix.
    """
    start = _starts(item)
    held, head, n = b"", None, 0
    while True:
        more = stream.read(max(read, len(held)))  # a long item is looked through a few times only
        held += more
        if head is None:
            root = re.search(rb"<(?:(\w+):)?(\w+)[^>]*[^/?]>(?=.|$)", held, re.S)
            first = start.search(held)
            if first is None and more:
                continue
            if first is None or root is None:
                return
            prefix = (root[1] + b":") if root[1] else b""
            outer = prefix + container.encode()
            wrap = outer != prefix + root[2]
            head = root[0] + (b"<" + outer + b">" if wrap else b"")
            tail = (b"</" + outer + b">" if wrap else b"") + b"</" + prefix + root[2] + b">"
            end = b"</" + outer + b">"
            held = held[first.start() :]
        closed = held.find(end)
        if closed >= 0:
            body, held, more = held[:closed], b"", b""
        elif len(held) >= block and more:
            at = _last(start, held)
            body, held = held[:at], held[at:]
        elif more:
            continue
        else:
            raise ET.ParseError(f"{container} has no end")
        if skip and body:
            at = [m.start() for m in start.finditer(body)]
            body, skip = (body[at[skip] :], 0) if len(at) > skip else (b"", skip - len(at))
        if body:
            yield n, head, body, tail
            n += len(start.findall(body))
        if closed >= 0:
            return


def _starts(item: str) -> re.Pattern:
    return re.compile(rb"<(?:\w+:)?%s[\s/>]" % item.encode())


def _last(start: re.Pattern, held: bytes) -> int:
    """Where the last item of ``held``, which begins with one, starts."""
    back = 1 << 12
    while True:
        at = [m.start() for m in start.finditer(held, max(0, len(held) - back))]
        if at:
            return at[-1]
        back *= 8


def blocks_of(stream, item: str, container: str, skip: int = 0) -> Iterator[tuple[int, str]]:
    """(first item's number, XML) of runs of whole ``item`` elements inside ``container``, each a document with the part's root."""
    for n, head, body, tail in _bodies(stream, item, container, skip, BLOCK, READ):
        yield n, (head + body + tail).decode()


# Characters that XML can't hold stand for what a plain row has: the order of the replacements matters, longer ones come first.
TEXTS = ((b"&lt;", b"\x01", b"<"), (b"&gt;", b"\x02", b">"), (b"&quot;", b"\x03", b'"'), (b"&apos;", b"\x04", b"'"), (b"&#13;", b"\x05", b"\r"), (b"&amp;", b"\x0b", b"&"))
MARKS = (
    (b'<c t="b"><v>1</v></c>', b"\x10True\x11"), (b'<c t="b"><v>0</v></c>', b"\x10False\x11"), (b'<c t="inlineStr"><is><t xml:space="preserve">', b"\x12"), (b'<c t="inlineStr"><is><t>', b"\x12"), (b"</t></is></c>", b"\x13"),
    (b"<c><v>", b"\x10"), (b"</v></c>", b"\x11"), (b"<c/>", b"\x14"), (b"<row>", b"\x15"), (b"</row>", b"\x16"), (b"<row/>", b"\x15\x16"),
)
OPEN_V, SHUT_V, OPEN_T, SHUT_T, NONE, ROW, END = range(0x10, 0x17)
UNHOLY = bytes(sorted({*range(32)} - {9, 10}))
AS_TEXT = bytes({b[0]: c[0] for _, b, c in TEXTS}.get(i, i) for i in range(256))
IS_MARK = np.array([OPEN_V <= i <= END for i in range(256)])
FOLLOWS = np.zeros((256, 256), bool)
for _a, _b in ((ROW, (OPEN_V, OPEN_T, NONE, END)), (OPEN_V, (SHUT_V,)), (OPEN_T, (SHUT_T,)), *((x, (OPEN_V, OPEN_T, NONE, END)) for x in (SHUT_V, SHUT_T, NONE)), (END, (ROW,))):
    FOLLOWS[_a, list(_b)] = True


def plain_rows(body: bytes, blank: str | None = None) -> pa.ListArray | None:
    """The cells of whole rows whose cells are numbers, truth values or inline texts one after another, all in the plain form;
    None if there is anything else, which may be no XML. Empty cells are null, or "" if that is the ``blank``."""
    if len(body.translate(None, UNHOLY)) < len(body) or b"\xef\xbf\xbe" in body or b"\xef\xbf\xbf" in body:
        return None
    for was, mark, _ in TEXTS:
        body = body.replace(was, mark)
    for was, mark in MARKS:
        body = body.replace(was, mark)
    if b"<" in body or b">" in body or b"&" in body:
        return None
    data = np.frombuffer(body, np.uint8)
    is_mark = IS_MARK[data]
    at = np.flatnonzero(is_mark)
    marks = data[at]
    if not len(at) or at[0] or at[-1] != len(data) - 1 or marks[0] != ROW or marks[-1] != END or not FOLLOWS[marks[:-1], marks[1:]].all():
        return None
    gaps = np.diff(at, append=len(data)) - 1
    opens = (marks == OPEN_V) | (marks == OPEN_T)
    if gaps[~opens].any() or not gaps[marks == OPEN_V].all():
        return None
    cells = opens | (marks == NONE)
    ends = np.zeros(int(cells.sum()) + 1, np.int32)
    np.cumsum(gaps[cells], out=ends[1:])
    text = data[~is_mark].tobytes().translate(AS_TEXT)
    none = marks[cells] == NONE
    valid = None if blank == "" or not none.any() else pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
    values = pa.StringArray.from_buffers(len(none), pa.py_buffer(ends), pa.py_buffer(text), valid)
    before = np.concatenate([[0], np.cumsum(cells)]).astype(np.int32)  # cells before each mark
    return pa.ListArray.from_arrays(pa.array(np.append(before[:-1][marks == ROW], before[-1]), pa.int32()), values)


class _Entry(io.RawIOBase):
    """An entry's bytes out of its pieces, as a stream; at its end its length and checksum are tested."""

    def __init__(self, pieces: Iterator[memoryview], method: int, size: int, crc: int):
        self.pieces, self.size, self.crc = pieces, size, crc
        self.flow = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        self.rest, self.n, self.sum, self.over = b"", 0, 0, False

    def _some(self, most: int) -> bytes:
        while not self.over:
            if self.flow is None or not self.rest:
                piece = next(self.pieces, None)
                if piece is None:
                    self.over = True
                    out = self.flow.flush() if self.flow else b""
                    if self.flow and not self.flow.eof:
                        raise EOFError("an entry has no end")
                    return out
                self.rest = piece
            if self.flow is None:
                out, self.rest = bytes(self.rest), b""
            else:
                out = self.flow.decompress(self.rest, most)
                self.rest = self.flow.unconsumed_tail
            if out:
                return out
        return b""

    def read(self, most: int = -1) -> bytes:
        """About ``most`` bytes; none at the end."""
        made, n = [], 0
        while n < most and (some := self._some(most - n)):
            made.append(some)
            n += len(some)
            self.sum = zlib.crc32(some, self.sum)
        self.n += n
        if self.over and not n and (self.n != self.size or self.sum != self.crc):
            raise zipfile.BadZipFile("Bad CRC-32 of an entry")
        return b"".join(made)


def _pieces(z: zipfile.ZipFile, data: memoryview, name: str) -> Iterator[tuple[list[int], bytes]]:
    """[method, length, checksum] and bytes, as they are stored, of an entry."""
    info = z.getinfo(name)
    with z.open(info) as s:  # tests the header
        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            while some := s.read(PIECE):
                yield [zipfile.ZIP_STORED, info.file_size, info.CRC], some
            return
    at = info.header_offset
    at += 30 + int.from_bytes(data[at + 26 : at + 28], "little") + int.from_bytes(data[at + 28 : at + 30], "little")
    for i in range(0, max(info.compress_size, 1), PIECE):
        yield [info.compress_type, info.file_size, info.CRC], bytes(data[at + i : at + min(i + PIECE, info.compress_size)])


def _parts(z: zipfile.ZipFile) -> Iterator[tuple[str, str | None, int, int, str]]:
    """kind, sheet, sheet_no, part and entry of shared strings and sheets; parts of a sheet are those that continue it."""
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
    if "xl/sharedStrings.xml" in z.namelist():
        yield "shared", None, -1, 0, "xl/sharedStrings.xml"
    book = ET.parse(z.open("xl/workbook.xml")).getroot()
    sheets = list(book.iter(f"{NS}sheet"))
    ties = {int(d.get("localSheetId", -1)): (d.text or "").rpartition("!")[0][1:-1].replace("''", "'") for d in book.iter(f"{NS}definedName") if d.get("name") == CONTINUES}
    numbers, parts = {}, {}  # of first sheets by name; parts so far, by number
    for place, sheet in enumerate(sheets):
        target = links[sheet.get(REL)]
        name = ties[place] if ties.get(place) in numbers else sheet.get("name")
        no = numbers.setdefault(name, len(numbers))
        yield "rows", name, no, parts.get(no, 0), target if target.startswith("xl/") else f"xl/{target}"
        parts[no] = parts.get(no, 0) + 1


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of workbooks in pieces; ``head`` says how to read them, or why not."""
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()))], names=["path", "place", "seq", "head", "data"])
    for batch in batches:
        for i in range(batch.num_rows):
            path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
            data, held, size, place = memoryview(content), [], 0, 0
            try:
                with zipfile.ZipFile(pa.BufferReader(content)) as z:
                    for place, (kind, sheet, no, part, name) in enumerate(_parts(z)):
                        try:
                            for seq, (how, piece) in enumerate(_pieces(z, data, name)):
                                held.append((path, place, seq, json.dumps([kind, sheet, no, part, *how]), piece))
                                size += len(piece)
                                if size >= GATHER:
                                    yield packed(held)
                                    held, size = [], 0
                        except UNREADABLE as e:
                            held.append((path, place, -1, json.dumps(["error", f"{type(e).__name__}: {e}"]), b""))
            except UNREADABLE as e:
                held.append((path, -1, -1, json.dumps(["error", f"{type(e).__name__}: {e}"]), b""))
            if held:
                yield packed(held)


def _cut(every: bool, blank: str | None):
    """Rows of entries, which come with their pieces in order; blocks as XML where they aren't plain; a row of kind ``part`` for each sheet's entry."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("part", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("xml", pa.string()), ("values", pa.list_(pa.string()))])

    def one(path, kind, sheet=None, no=-1, part=0, first=0, n=0, xml=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, kind, sheet, no, part, first, n, xml, None), schema)], schema=schema)

    def many(path, sheet, no, part, first, values: pa.ListArray) -> pa.RecordBatch:
        n = len(values)
        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
        numbers = pa.array(np.arange(first, first + n, dtype=np.int32))
        return pa.RecordBatch.from_arrays([same(path, pa.string()), same("row", pa.string()), same(sheet, pa.string()), same(no, pa.int32()), same(part, pa.int32()), numbers, same(1, pa.int32()), pa.nulls(n, pa.string()), values], schema=schema)

    def rows_of(stream, path, sheet, no, part) -> Iterator[pa.RecordBatch]:
        start, n, width = _starts("row"), 0, 0
        for first, head, body, tail in _bodies(stream, "row", "sheetData", int(part > 0), PLAIN, PLAIN):
            body.decode()
            values = plain_rows(body, blank)
            if values is not None:
                n, width = first + len(values), max(width, int(np.diff(values.offsets.to_numpy()).max()))
                yield many(path, sheet, no, part, first, values)
                continue
            n, at, done = first, [*(m.start() for m in start.finditer(body)), len(body)], 0
            for i in range(1, len(at)):
                if at[i] - at[done] >= BLOCK or i == len(at) - 1:
                    yield one(path, "xml", sheet, no, part, n, i - done, (head + body[at[done] : at[i]] + tail).decode())
                    n, done = n + i - done, i
        yield one(path, "part", sheet, no, part, width, n) if n or part else one(path, "empty", sheet, no)

    def entry(path, head, pieces) -> Iterator[pa.RecordBatch]:
        kind, sheet, no, part, method, size, crc = head
        stream = _Entry(pieces, method, size, crc)
        try:
            if kind == "shared":
                for first, xml in blocks_of(stream, "si", "sst"):
                    yield one(path, kind, None, -1, 0, first, 0, xml)
            else:
                for made in rows_of(stream, path, sheet, no, part):
                    if every or no == 0:
                        yield made
            while stream.read(PLAIN):  # to its checksum
                pass
        except UNREADABLE as e:
            yield one(path, "error", xml=f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*(batch.column(k)[i].as_py() for k in range(4)), batch.column(4)[i]) for batch in batches for i in range(batch.num_rows))
        for (path, _), own in itertools.groupby(rows, lambda r: r[:2]):
            for failed, pieces in itertools.groupby(own, lambda r: r[2] < 0):
                first = next(pieces)
                head = json.loads(first[3])
                if failed:
                    yield one(path, "error", xml=head[1])
                    break
                yield from entry(path, head, (memoryview(r[4].as_buffer()) for r in itertools.chain([first], pieces)))

    return run


def _text(c: Column) -> Column:
    """The text of a string item: its own, or that of its runs."""
    return F.coalesce(c["t"], F.array_join(F.transform(c["r"], lambda r: F.coalesce(r["t"], F.lit(""))), ""))


def column_number(ref: Column) -> Column:
    """0 for A1, 26 for AA1."""
    letters = F.regexp_extract_all(ref, F.lit("[A-Z]"), F.lit(0))
    return F.aggregate(letters, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64) - 1


def _placed(cells: Column) -> Column:
    """Columns (from 0) of a row's cells: as their references say, or one after another."""
    given = F.transform(cells, lambda c: column_number(c["_r"]))
    fold = cell_positions(F.transform(cells, lambda c: F.struct((column_number(c["_r"]) + 1).alias("index"), F.lit(0).alias("span"))))
    return F.when(F.forall(cells, lambda c: c["_r"].isNotNull()), given).when(F.exists(cells, lambda c: c["_r"].isNotNull()), fold).otherwise(F.sequence(F.lit(0), F.size(cells) - 1))


def _dense(at: Column, values: Column, n: Column) -> Column:
    """``values`` at the places ``at`` (one after another if it is null) of an array of ``n``; null elsewhere."""
    full = F.concat(values, F.array_repeat(F.lit(None).cast("string"), F.greatest(n - F.size(values), F.lit(0))))
    dense = at.isNull() | (F.element_at(at, -1) == F.size(at) - 1)
    sparse = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, (F.array_position(at, i) - 1).cast("int")))
    return F.when(F.size(at) == 0, F.array_repeat(F.lit(None).cast("string"), n)).when(dense, full).otherwise(sparse)


def _with_strings(rows: DataFrame, strings: DataFrame) -> DataFrame:
    """The rows whose cells name shared strings, with their texts."""
    cells = rows.select("path", "sheet_no", "part", "_row_no", F.posexplode("values").alias("i", "v"), F.get("shared", F.col("i")).alias("no"))
    n = strings.count()
    if n <= MOST_BROADCAST:
        met = cells.join(F.broadcast(strings), ["path", "no"], "left")
    else:
        often = written(cells.where("no is not null").groupBy("path", "no").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select("path", "no"), "often")
        hot = F.broadcast(strings.join(F.broadcast(often), ["path", "no"]).withColumnRenamed("text", "hot"))
        rest = strings.join(F.broadcast(often), ["path", "no"], "left_anti")
        first = cells.join(hot, ["path", "no"], "left")
        found = first.where("hot is null and no is not null").join(rest, ["path", "no"], "left")
        met = found.select("path", "sheet_no", "part", "_row_no", "i", "v", "text").union(first.where("hot is not null or no is null").select("path", "sheet_no", "part", "_row_no", "i", "v", F.col("hot").alias("text")))
    packed = met.groupBy("path", "sheet_no", "part", "_row_no").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("text", "v").alias("v")))).alias("c"))
    return packed.select("path", "sheet_no", "part", "_row_no", F.transform("c", lambda x: x["v"]).alias("values"))


def read(spark: SparkSession, paths: str | Sequence[str], every_sheet: bool = False, blank: str | None = None, pattern: str | None = None) -> Workbooks:
    """Reads workbooks by path (or those below a folder that match ``pattern``): the first sheet of each, or all.

    Cells are text as stored, truth values ``True`` or ``False``; an absent cell is ``blank``. Rows of a sheet all have its width.
    """
    files = importable(spark).read.format("binaryFile")
    files = files.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern) if pattern else files
    files = files.load(paths if isinstance(paths, str) else list(paths))
    size = files.agg(F.sum("length")).first()[0] or 0
    entries = files.select("path", "content").mapInArrow(_deal, ENTRIES).repartition(max(1, min(size >> 18, 256), size >> 28), "path", "place")
    cut = written(entries.sortWithinPartitions("path", "place", "seq").mapInArrow(_cut(every_sheet, blank), CUT), "rows")
    plain = cut.where("kind = 'row'").select("path", "sheet", "sheet_no", "part", F.col("first").alias("_row_no"), F.lit(None).cast("array<int>").alias("at"), "values")
    parsed = cut.where("kind = 'xml'").repartition("path", "sheet_no", "part", "first").withColumn("doc", F.from_xml(F.col("xml"), SHEET, XML)["sheetData"]["row"])
    parts = cut.where("kind = 'part'").select("path", "sheet_no", "part", F.col("first").alias("width"), "n")
    keys = ["path", "sheet_no", "part"]
    if cut.where("kind = 'xml'").limit(1).count():
        other = _other_rows(cut, parsed)
        parts = parts.union(other.groupBy(*keys).agg(F.max(F.coalesce(F.array_max("at") + 1, F.lit(0))).alias("width"), F.lit(0).alias("n"))).groupBy(*keys).agg(F.max("width").alias("width"), F.max("n").alias("n"))
        plain = plain.union(other.select(plain.columns))
    # An entry that broke off has rows, but none of kind ``part``.
    seen = cut.where("kind in ('row', 'xml')").groupBy(*keys).agg(F.max(F.col("first") + F.col("n")).alias("seen"), F.max(F.when(F.col("kind") == "row", F.size("values"))).alias("own")) if cut.where("kind = 'error'").limit(1).count() else None
    if seen is not None:
        parts = parts.join(seen, keys, "full").select(*keys, F.greatest("width", "own", F.lit(0)).alias("width"), F.coalesce("n", "seen").alias("n"))
    sheet = Window.partitionBy("path", "sheet_no")
    before = F.coalesce(F.sum("n").over(sheet.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    parts = written(parts.select(*keys, F.max("width").over(sheet).alias("width"), before.alias("before")), "parts")  # a row an entry
    full = plain.join(F.broadcast(parts) if parts.count() <= MOST_BROADCAST else parts, keys)
    cells = _dense(F.col("at"), F.col("values"), F.col("width"))
    if blank is not None:
        cells = F.transform(cells, lambda v: F.coalesce(v, F.lit(blank)))
    whole = F.col("at").isNull() & (F.size("values") == F.col("width"))
    cells = F.when(whole, F.col("values")).otherwise(cells) if not blank else cells
    full = full.select("path", "sheet", "sheet_no", (F.col("_row_no") + F.col("before")).alias("_row_no"), cells.alias("cells"))
    none = cut.where("kind = 'empty'").select("path", "sheet", "sheet_no", F.lit(0).alias("_row_no"), F.array().cast("array<string>").alias("cells"))
    broken = parsed.where("doc is null").select("path", "sheet", F.concat(F.lit("rows from "), "first", F.lit(" are no XML")).alias("why"))
    return Workbooks(full.union(none), cut.where("kind = 'error'").select("path", "sheet", F.col("xml").alias("why")).union(broken))


def _other_rows(cut: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows of the blocks that were parsed as XML."""
    rows = parsed.select("path", "sheet", "sheet_no", "part", "first", F.posexplode("doc").alias("i", "row")).select("path", "sheet", "sheet_no", "part", (F.col("first") + F.col("i")).alias("_row_no"), F.coalesce("row.c", F.array().cast("array<struct<_r:string,_t:string,v:string,is:" + TEXT + ">>")).alias("c"))
    value = lambda c: F.when(c["_t"] == "inlineStr", _text(c["is"])).when(c["_t"] == "b", F.when(c["v"] == "1", "True").when(c["v"] == "0", "False")).when(c["_t"] == "s", F.lit(None).cast("string")).otherwise(c["v"])
    rows = rows.select("path", "sheet", "sheet_no", "part", "_row_no", _placed(F.col("c")).alias("at"), F.transform("c", value).alias("values"), F.transform("c", lambda c: F.when(c["_t"] == "s", c["v"].cast("int"))).alias("shared"))
    rows = written(rows, "others")
    shared = cut.where("kind = 'shared'").repartition("path", "first").select("path", "first", F.posexplode(F.from_xml("xml", STRINGS, XML)["si"]).alias("i", "si"))
    strings = shared.select("path", (F.col("first") + F.col("i")).alias("no"), F.coalesce(_text(F.col("si")), F.lit("")).alias("text"))
    if not cut.where("kind = 'shared'").limit(1).count():
        return rows
    named = F.exists("shared", lambda x: x.isNotNull())
    texts = _with_strings(rows.where(named), written(strings, "strings"))
    return rows.where(~named).drop("shared").unionByName(rows.where(named).drop("shared", "values").join(texts, ["path", "sheet_no", "part", "_row_no"]))
