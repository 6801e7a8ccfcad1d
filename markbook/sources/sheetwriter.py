"""Workbooks (.xlsx) written by executors (K1-K7), in two phases; no row passes the driver.

First the rows of every sheet are dealt in ranges of their order, become XML in column expressions and are compressed in
fragments, each a run of rows of one sheet that ends on a byte, with its lengths and checksum. Spark commits them as a
table. Then one task a workbook streams its fragments, in order, into one container: deflated fragments may stand one after
the other, and their checksums combine. A container gets a name of its own for each attempt; the driver renames those that
Spark committed, so a lost executor or a repeated task leaves nothing under the final name.

A sheet holds ``MOST_ROWS`` rows by the format. More are refused, or go on in sheets of their own right after it, each with
the header, which a hidden name of the sheet (``CONTINUES``, a reference to the first one) ties together: ``sheetreader`` reads
them as one. The entries beside the sheets stand last, when the number of sheets is known.
Numbers and truth values are cells of their kind, null is an empty cell, all else is text; characters that XML can't hold
are dropped. Containers are written through ``pyarrow.fs``, which must know the target's scheme.
"""

from __future__ import annotations

import io
import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import BinaryIO
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markbook.operators.schema import unique_names
from markbook.session import importable, written

MOST_ROWS = 1_048_576
CONTINUES = "_continues"
BOOK = "_workbook of the row"  # a column beside those of a sheet
FRAGMENT = 1 << 20
# Names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
MARKUP = r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}&<>]"
LEVEL = 3  # of compression

FRAGMENTS = "book string, sheet_no int, part int, seq int, n_rows long, raw long, crc long, data binary"
WRITTEN = "book string, path string, n_rows long, n_bytes long"


@dataclass(frozen=True)
class Sheet:
    """Rows of one sheet, over all workbooks: ``order`` sorts them, ``hidden`` columns aren't written; if it ``continues``, rows
    beyond those of a sheet go on in further ones, else they are refused."""

    df: DataFrame
    order: Sequence[str] = ()
    hidden: Sequence[str] = field(default_factory=tuple)
    continues: bool = False


def sheet_names(names: Sequence[str]) -> list[str]:
    """Names that a workbook allows, each once."""
    return unique_names([re.sub(r"[\\/*?:\[\]]", "", n)[:31] or "Sheet" for n in names])


def cell_xml(value: Column, kind: T.DataType) -> Column:
    """A cell's XML."""
    shown = value.cast("string")
    clean = F.regexp_replace(shown, NOT_XML, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        clean = F.replace(clean, F.lit(a), F.lit(b))
    clean = F.when(shown.rlike(MARKUP), clean).otherwise(shown)
    inline = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), clean, F.lit("</t></is></c>"))
    plain = F.concat(F.lit("<c><v>"), shown, F.lit("</v></c>"))
    if isinstance(kind, T.BooleanType):
        made = F.when(value, '<c t="b"><v>1</v></c>').when(~value, '<c t="b"><v>0</v></c>')
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        made = F.when(F.isnan(value) | (F.abs(value) == float("inf")), inline).otherwise(plain)
    else:
        made = plain if isinstance(kind, T.NumericType) else inline
    return F.coalesce(made, F.lit("<c/>"))


def row_xml(df: DataFrame, columns: Sequence[str]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat(F.lit("<row>"), *(cell_xml(F.col(f"`{c}`"), kinds[c]) for c in columns), F.lit("</row>"))


def header_xml(columns: Sequence[str]) -> str:
    return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x1f]", " ", c))}</t></is></c>' for c in columns) + "</row>"


def deflated(raw: bytes, last: bool = False) -> bytes:
    """A fragment of a deflated stream, which ends on a byte; others may follow but for the last."""
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return press.compress(raw) + press.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, highest power in the lowest bit."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings one after the other, by those of each and the second's length."""
    shift, power = 0x80000000, 0x00800000  # 1, and eight zero bits
    while length:
        if length & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        length >>= 1
    return _times(shift, first) ^ second


class Container:
    """A zip file written front to back: entries of deflated fragments, lengths after the data."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        self.name, self.start, self.raw, self.crc = name.encode(), self.at, 0, 0
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 8, 8, 0, 33, 0, 0, 0, len(self.name), 0) + self.name)
        self.body = self.at

    def add(self, data: bytes, raw: int, crc: int) -> None:
        self._put(data)
        self.crc = joined_crc(self.crc, crc, raw)
        self.raw += raw

    def close(self, tail: bytes) -> None:
        self.add(deflated(tail, last=True), len(tail), zlib.crc32(tail))
        sizes = (self.crc, self.at - self.body, self.raw)
        if max(sizes[1:]) >= 1 << 32:
            raise ValueError(f"{self.name.decode()}: an entry is over 4 GB")
        self._put(struct.pack("<IIII", 0x08074B50, *sizes))
        self.entries.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, 8, 8, 0, 33, *sizes, len(self.name), 0, 0, 0, 0, 0, self.start) + self.name)

    def whole(self, name: str, text: str) -> None:
        self.open(name)
        self.close(text.encode())

    def finish(self) -> int:
        start = self.at
        for e in self.entries:
            self._put(e)
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(self.entries), len(self.entries), self.at - start, start, 0))
        return self.at


def package_parts(names: Sequence[str], of: Sequence[int | None] = ()) -> dict[str, str]:
    """The entries of a workbook beside its sheets; ``of``: for each sheet the place of the one that it continues, if any."""
    n = range(1, len(names) + 1)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{KIND}.worksheet+xml"/>' for i in n)
    links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
    sheets = "".join(f'<sheet name={quoteattr(x)} sheetId="{i}" r:id="rId{i}"/>' for i, x in zip(n, names))
    place = lambda x: "'" + x.replace("'", "''") + "'!$A$1"
    ties = "".join(f'<definedName name="{CONTINUES}" localSheetId="{i}" hidden="1">{escape(place(names[x]))}</definedName>' for i, x in enumerate(of) if x is not None)
    ties = f"<definedNames>{ties}</definedNames>" if ties else ""
    defaults = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>'
    return {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="{PACKAGE}/content-types">{defaults}{kinds}</Types>',
        "_rels/.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
        "xl/workbook.xml": f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{sheets}</sheets>{ties}</workbook>',
    }


def _fragmenter(sheet_no: int, most_rows: int):
    """Runs of rows of one sheet of one workbook, compressed. The XML of a batch's rows stands in one buffer, out of which runs are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size, n, of = TaskContext.get().partitionId(), 0, [], 0, 0, None

        def out() -> pa.RecordBatch:
            raw = b"".join(held)
            row = [of, sheet_no, part, seq, n, len(raw), zlib.crc32(raw), deflated(raw)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["book", "sheet_no", "part", "seq", "n_rows", "raw", "crc", "data"])

        for batch in batches:
            book, xml = batch.column(0), batch.column(1).cast(pa.large_string())
            rows = batch.num_rows
            if not rows:
                continue
            ends = np.frombuffer(xml.buffers()[1], np.int64)[xml.offset : xml.offset + rows + 1]
            text = memoryview(xml.buffers()[2] or b"")
            changes = np.flatnonzero(pc.not_equal(book[1:], book[:-1]).to_numpy(zero_copy_only=False)) + 1
            for start, stop in itertools.pairwise([0, *changes.tolist(), rows]):
                own = book[start].as_py()
                if n and own != of:
                    yield out()
                    held, size, n, seq = [], 0, 0, seq + 1
                of = own
                while start < stop:
                    if n and (size >= FRAGMENT or n >= most_rows - 1):
                        yield out()
                        held, size, n, seq = [], 0, 0, seq + 1
                    full = int(np.searchsorted(ends, ends[start] + FRAGMENT - size))  # the row that makes a fragment full ends there
                    upto = min(stop, max(full, start + 1), start + most_rows - 1 - n)
                    held.append(bytes(text[ends[start] : ends[upto]]))
                    size, n, start = size + len(held[-1]), n + upto - start, upto
        if n:
            yield out()

    return run


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    try:
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and "://" not in path else path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"workbooks can't be written at {path}: no file system for its scheme") from e


def further_name(names: Sequence[str], of: str, n: int) -> str:
    """A name for the ``n``-th sheet of those that hold the rows of ``of``, which ``names`` doesn't have."""
    taken, end = {x.lower() for x in names}, f" ({n})"
    while (name := of[: 31 - len(end)] + end).lower() in taken:
        end += "_"
    return name


def _assembler(folder: str, names: Sequence[str], heads: Sequence[str], continues: Sequence[bool], most_rows: int):
    """Streams the fragments of workbooks, in order, into containers."""
    before = f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'

    def begin(box: Container, no: int, made: list) -> None:
        """Opens a sheet: the first for ``names[no]``, or a further one. ``made``: name, number and place of the first, of every sheet so far."""
        own = [i for i, x in enumerate(made) if x[1] == no]
        made.append((further_name([*names, *(x[0] for x in made)], names[no], len(own) + 1) if own else names[no], no, own[0] if own else None))
        box.open(f"xl/worksheets/sheet{len(made)}.xml")
        raw = (before + heads[no]).encode()
        box.add(deflated(raw), len(raw), zlib.crc32(raw))

    def end(box: Container) -> None:
        box.close(b"</sheetData></worksheet>")

    def upto(box: Container, now: int, wanted: int, made: list) -> int:
        """Closes and opens sheets until ``wanted`` is open."""
        while now < wanted:
            if now >= 0:
                end(box)
            now += 1
            if now < len(names):
                begin(box, now, made)
        return now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = box = path = None
        now, rows, held, made = -1, 0, 0, []

        def done() -> pa.RecordBatch:
            upto(box, now, len(names), made)
            for name, text in package_parts([x[0] for x in made], [x[2] for x in made]).items():
                box.whole(name, text)
            size = box.finish()
            box.out.close()
            return pa.RecordBatch.from_pydict({"book": [book], "path": [path], "n_rows": pa.array([rows], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for own, sheet_no, n, raw, crc, data in (tuple(batch.column(i)[k].as_py() for i in range(6)) for k in range(batch.num_rows)):
                if own != book:
                    if box is not None:
                        yield done()
                    book, now, rows, held, made = own, -1, 0, 0, []
                    path = f"{folder}/.{uuid.uuid4().hex}.part"
                    where, place = _opened(path)
                    where.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    box = Container(where.open_output_stream(place))
                if now < sheet_no:
                    now, held = upto(box, now, sheet_no, made), 0
                if held + n >= most_rows:
                    if not continues[sheet_no]:
                        raise ValueError(f"{book}, {names[sheet_no]}: a sheet holds {most_rows - 1} rows and a header")
                    end(box)
                    begin(box, sheet_no, made)
                    held = 0
                if n:
                    box.add(data, raw, crc)
                held += n
                rows += n
        if box is not None:
            yield done()

    return run


def write_workbooks(folder: str, sheets: Mapping[str, Sheet], by: str | None = None, name: str = "book", most_rows: int = MOST_ROWS) -> DataFrame:
    """Writes ``<folder>/<book>.xlsx`` for every value of column ``by`` (one workbook called ``name`` without it); each has all sheets.

    Without an order a sheet keeps that of the frame, if it is the only workbook. A sheet has ``most_rows``, its header included.

    Returns (book, path, n_rows, n_bytes), a row a workbook. Null is the workbook ``null``; ``/`` in a name becomes ``_``.
    """
    folder, names = folder.rstrip("/"), sheet_names(list(sheets))
    shown = [[c for c in s.df.columns if c != by and c not in set(s.hidden)] for s in sheets.values()]
    parts = []
    for no, (sheet, columns) in enumerate(zip(sheets.values(), shown)):
        book = F.lit(name) if by is None else F.replace(F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("null")), F.lit("/"), F.lit("_"))
        keys = [F.col(BOOK), *(F.col(f"`{c}`").asc_nulls_first() for c in sheet.order)]
        rows = sheet.df.select(book.alias(BOOK), *(F.col(f"`{c}`") for c in dict.fromkeys([*columns, *sheet.order])))
        dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if sheet.order else rows if by is None else rows.sortWithinPartitions(BOOK)
        parts.append(dealt.select(BOOK, row_xml(dealt, columns).alias("xml")).mapInArrow(_fragmenter(no, most_rows), FRAGMENTS))
    spark = importable(parts[0].sparkSession)
    if by is None:  # a workbook without rows has its headers
        parts.append(spark.range(1).select(F.lit(name).alias("book"), F.lit(0).alias("sheet_no"), F.lit(-1).alias("part"), F.lit(0).alias("seq"), *(F.lit(0).cast("long").alias(c) for c in ("n_rows", "raw", "crc")), F.lit(b"").alias("data")))
    table = written(reduce(DataFrame.union, parts), "fragments")
    dealt = table.repartition("book").sortWithinPartitions("book", "sheet_no", "part", "seq").select("book", "sheet_no", "n_rows", "raw", "crc", "data")
    made = written(dealt.mapInArrow(_assembler(folder, names, [header_xml(c) for c in shown], [s.continues for s in sheets.values()], most_rows), WRITTEN), "workbooks")
    for r in made.select("book", "path").toLocalIterator():  # a row a workbook
        _renamed(spark, r.path, f"{folder}/{r.book}.xlsx")
    return made.withColumn("path", F.concat(F.lit(f"{folder}/"), "book", F.lit(".xlsx")))


def _renamed(spark, path: str, final: str) -> None:
    """Puts a container under its final name, in place of an older one."""
    place, to = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, final))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(to, False)
    if not files.rename(place, to):
        raise OSError(f"{final} can't be written")


def to_workbook(sheets: Mapping[str, Sequence[Sequence[str | None]]]) -> bytes:
    """A workbook of text cells in memory, for fixtures."""
    out = io.BytesIO()
    box, names = Container(out), sheet_names(list(sheets))
    for name, text in package_parts(names).items():
        box.whole(name, text)
    for i, rows in enumerate(sheets.values(), 1):
        cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
        box.whole(f"xl/worksheets/sheet{i}.xml", f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
    box.finish()
    return out.getvalue()


def torn_copies(spark, folder: str, to: str, torn: Column) -> None:
    """Copies a folder's workbooks, by tasks; those for which ``torn`` (over their ``name``) holds lose their second half."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
                where, place = _opened(f"{to}/{name}")
                where.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(place) as f:
                    f.write(data[: len(data) // 2] if half else data)
            yield batch.select(["name"])

    files = importable(spark).read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    written(named.select("name", "content", torn.alias("torn")).mapInArrow(copy, "name string"), "copies")
