"""Workbooks, SpreadsheetML, types and prefix scans: odd files, bounds and brute force."""

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from markbook.operators import lattice, scan
from markbook.sources import sheetreader, sheetwriter, spreadsheetml, xlsx
from markbook.sources.sheetwriter import Sheet, write_workbooks

MAIN = sheetwriter.MAIN


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def package(sheet_xml, strings=None, names=("S",)):
    """A workbook whose first sheet is the given XML."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in sheetwriter.package_parts(list(names)).items():
            z.writestr(name, text)
        for i in range(len(names)):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", sheet_xml)
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", strings)
    return out.getvalue()


def read(spark, tmp_path, data, **how):
    (tmp_path / "b.xlsx").write_bytes(data)
    return sheetreader.read(spark, str(tmp_path / "b.xlsx"), **how)


def cells_of(got):
    return [r.cells for r in got.rows.orderBy("sheet_no", "_row_no").collect()]


def test_references_strings_and_runs(spark, tmp_path):
    strings = f'<sst xmlns="{MAIN}"><si><t xml:space="preserve"> a &amp; b </t></si><si><r><t>ri</t></r><r><rPr><b/></rPr><t>ch</t></r></si><si><t/></si></sst>'
    body = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="2" x:dy="0.25"><c r="B2" t="b"><v>1</v></c><c><v>1.5</v></c><c t="str"><v>x</v></c><c t="s"><v>2</v></c></row><row r="3"/><row r="4"><c t="inlineStr"><is><r><t>p</t></r><r><t>q</t></r></is></c></row>'
    got = read(spark, tmp_path, package(f'<worksheet xmlns="{MAIN}" xmlns:x="urn:x"><cols><col min="1"/></cols><sheetData>{body}</sheetData><pageMargins left="1"/></worksheet>', strings))
    none = [None] * 28
    want = [[*none], [*none], [*none], [*none]]
    want[0][0], want[0][27] = " a & b ", "rich"
    want[1][1:5] = ["True", "1.5", "x", ""]
    want[3][0] = "pq"
    assert cells_of(got) == want and got.rejects.count() == 0


def test_prefixed_names(spark, tmp_path):
    body = '<x:row><x:c t="s"><x:v>0</x:v></x:c></x:row>'
    plain = f'<worksheet xmlns="{MAIN}"><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>'
    assert cells_of(read(spark, tmp_path, package(plain))) == [["7"]]
    found = list(sheetreader.blocks_of(io.BytesIO(f'<?xml version="1.0"?><x:worksheet xmlns:x="{MAIN}"><x:sheetData>{body}</x:sheetData></x:worksheet>'.encode()), "row", "sheetData"))
    assert found == [(0, f'<x:worksheet xmlns:x="{MAIN}"><x:sheetData>{body}</x:sheetData></x:worksheet>')]


@pytest.mark.parametrize("read_size,block", [(7, 40), (64, 100), (1 << 16, 1 << 18)])
def test_blocks_hold_every_row_once(monkeypatch, read_size, block):
    monkeypatch.setattr(sheetreader, "READ", read_size)
    monkeypatch.setattr(sheetreader, "BLOCK", block)
    body = [f'<row r="{i}"><c><v>{"9" * (i % 9)}</v></c></row>' if i % 5 else "<row/>" for i in range(60)]
    xml = f'<worksheet xmlns="{MAIN}"><dimension ref="A1"/><sheetData>{"".join(body)}</sheetData><rowBreaks/></worksheet>'
    found = list(sheetreader.blocks_of(io.BytesIO(xml.encode()), "row", "sheetData"))
    head, tail = f'<worksheet xmlns="{MAIN}"><sheetData>', "</sheetData></worksheet>"
    assert all(x.startswith(head) and x.endswith(tail) for _, x in found)
    assert "".join(x[len(head) : -len(tail)] for _, x in found) == "".join(body)
    counts = [x.count("<row") for _, x in found]
    assert [n for n, _ in found] == [sum(counts[:i]) for i in range(len(counts))]
    if block < 1000:
        assert len(found) > 5


def test_empty_and_broken_files(spark, tmp_path):
    sheet = f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>'
    bad = {"c.xlsx": b"PK nonsense", "d.xlsx": package(f'<worksheet xmlns="{MAIN}"><sheetData><row><c></row></sheetData></worksheet>'), "e.xlsx": package(f'<worksheet xmlns="{MAIN}"><sheetData><row>'), "f.xlsx": package(sheet)[:200]}
    for name, data in (bad | {"good.xlsx": package(sheet)}).items():
        (tmp_path / name).write_bytes(data)
    got = sheetreader.read(spark, str(tmp_path), pattern="*.xlsx")
    assert [r.cells for r in got.rows.collect()] == [[]]
    assert {r.path.rsplit("/")[-1] for r in got.rejects.collect()} == set(bad)
    (tmp_path / "a.xlsx").write_bytes(b"")  # Spark's reader doesn't see files without bytes; they have no rows
    paths = [str(tmp_path / x) for x in ("a.xlsx", "good.xlsx", "c.xlsx")]
    assert xlsx.unreadable(xlsx.raw(spark, paths), paths) == [paths[0], paths[2]]


def test_shared_strings_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    strings = f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>t{i}</t></si>" for i in range(300)) + "</sst>"
    picks = [[0, rng.randrange(300)] for _ in range(400)]
    body = "".join("<row>" + "".join(f'<c t="s"><v>{x}</v></c>' for x in p) + "</row>" for p in picks)
    data = package(f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>', strings)
    for most in (1000, 10):
        monkeypatch.setattr(sheetreader, "MOST_BROADCAST", most)
        monkeypatch.setattr(sheetreader, "OFTEN", 100)
        assert cells_of(read(spark, tmp_path, data)) == [[f"t{x}" for x in p] for p in picks]


def test_odd_names_and_values(spark, tmp_path):
    values = ["a\rb\nc", " x ", "<&>\"'", "\x01bad\x1f", "é中\U0001d4b3", "", None, "_x000D_"]
    df = spark.createDataFrame([(i, v, i / 4, i % 2 == 0, None) for i, v in enumerate(values)], "`no` long, `a <b>` string, d double, t boolean, nothing string")
    df = df.union(spark.createDataFrame([(98, "nan", float("nan"), None, None), (99, "inf", float("inf"), None, None)], df.schema))
    path = str(tmp_path / "odd [1] {x}" / "r*.xlsx")
    xlsx.write_workbook(path, {"A/B: [x]": df.orderBy("no"), "a/b: [x]": df.limit(0)})
    got = xlsx.raw(spark, [path], "*")
    assert {r._sheet for r in got.collect()} == {"AB x", "ab x_2"}
    first = [r.cells for r in got.where("_sheet_no = 0").orderBy("_row_no").collect()]
    shown = lambda v: None if v is None else v.replace("\x01", "").replace("\x1f", "")
    assert first[0] == ["no", "a <b>", "d", "t", "nothing"]
    assert first[1:9] == [[str(i), shown(v), str(i / 4), str(i % 2 == 0), None] for i, v in enumerate(values)]
    assert [r[2] for r in first[9:]] == ["NaN", "Infinity"]
    assert [r.cells for r in got.where("_sheet_no = 1").collect()] == [["no", "a <b>", "d", "t", "nothing"]]


def test_many_fragments_make_one_sheet(spark, tmp_path, monkeypatch):
    df = spark.range(40_000).select(F.col("id"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("text"), (F.col("id") % 2).alias("book"))
    made = write_workbooks(str(tmp_path), {"One": Sheet(df, ["id"]), "None": Sheet(df.where("id < 0"))}, by="book").collect()
    assert {r.book: r.n_rows for r in made} == {"0": 20_000, "1": 20_000}
    with zipfile.ZipFile(tmp_path / "1.xlsx") as z:
        assert z.testzip() is None and z.getinfo("xl/worksheets/sheet1.xml").file_size > 2 * sheetwriter.FRAGMENT
    got = sheetreader.read(spark, str(tmp_path / "1.xlsx")).rows
    assert got.count() == 20_001 and got.where("_row_no > 0 and cast(cells[0] as long) <> 2 * _row_no - 1").count() == 0
    assert not list(tmp_path.glob(".*part"))


def test_too_many_rows_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="a sheet holds"):
        write_workbooks(str(tmp_path), {"S": Sheet(spark.range(sheetwriter.MOST_ROWS))})


def test_checksums_combine():
    rng = random.Random(2)
    for n in (0, 1, 7, 1000):
        a, b = rng.randbytes(50), rng.randbytes(n)
        assert sheetwriter.joined_crc(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_value_kinds(spark):
    said = {
        "0": "LONG", "-12": "LONG", "007": "TEXT", "1.": "TEXT", ".5": "DOUBLE", "1.5e3": "DOUBLE", "1e400": "DOUBLE", "12345678901234567890": "TEXT", "2024-02-30": "TEXT", "2024-02-29": "DATE", "2024-02-29 10:00": "STAMP", "2024-02-29 25:00": "TEXT", "TRUE": "TRUTH", " 5 ": "LONG", "x": "TEXT",
    }
    df = spark.createDataFrame([(k,) for k in said], "t string").select("t", lattice.kind(F.col("t")).alias("k"))
    assert {r.t: r.k for r in df.collect()} == {k: getattr(lattice, v) for k, v in said.items()}
    assert spark.range(1).select(lattice.kind(F.lit(" ")).alias("a"), lattice.kind(F.lit(None).cast("string")).alias("b")).first() == (0, 0)


def test_types_join_over_files(spark):
    data = [("a", 0, 0, ["n", "n", None, "d"]), ("a", 0, 1, ["1", "x", "2", "2024-01-01"]), ("b", 0, 0, ["d", "N "]), ("b", 0, 1, ["2024-01-01 10:00:00", "1.5"]), ("c", 0, 0, ["d"])]
    df = spark.createDataFrame(data, "path string, sheet_no int, _row_no int, cells array<string>")
    got = {(r.path, r["name"]): r.type for r in lattice.inferred(df).collect()}
    assert got == {("a", "n"): "bigint", ("a", "n_2"): "string", ("a", "Column3"): "bigint", ("a", "d"): "date", ("b", "d"): "timestamp", ("b", "N"): "double", ("c", "d"): "string"}
    union = lattice.typed_union(df.where("path = 'a'"))
    assert dict(union.dtypes)["n"] == "bigint" and rows(union.select("n", "n_2", "Column3", F.col("d").cast("string"))) == [(1, "x", 2, "2024-01-01")]


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [0, 1, 500])
def test_scans_against_brute_force(spark, n, many_ranges):
    rng = random.Random(n)
    data = [(i, rng.choice([None, None, "a", "b"]), rng.choice([0, 0, 1])) for i in range(n)]
    df = spark.createDataFrame(data, "i long, v string, f int").repartition(5)
    got = scan.Ordered(df, ["i"]).running("sum", F.col("f")).last("seen", F.col("v")).previous("before", F.col("v"))
    want, total, seen, before = [], 0, None, None
    for i, v, f in data:
        total, seen = total + f, v if v is not None else seen
        want.append((i, total, seen, before))
        before = (v,)
    assert [(r.i, r.sum, r.seen, tuple(r.before) if r.before is not None else None) for r in got.rows.orderBy("i").collect()] == want
    plan = got.rows._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    if n > 100:
        assert got.df.select(scan.RANGE).distinct().count() > 1


def test_rows_of_several_splits(spark, tmp_path):
    """One file read by many tasks: rows with places of their own, rows without cells, a second worksheet."""
    ns = 'xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"'
    rng, body, want, at = random.Random(4), [], [], 0
    for i in range(400):
        jump = rng.randrange(1, 4) if rng.random() < 0.1 else 0
        at += jump
        tag = f'<Row ss:Index="{at + 1}"' if jump else "<Row"
        if rng.random() < 0.2:
            body.append(f"{tag}/>")
        else:
            body.append(f'{tag} ss:Height="1"><Cell><Data>r{i}</Data></Cell><Cell ss:Index="3" ss:MergeAcross="1"/></Row>')
            want += [(at, 0, f"r{i}", 0, 0), (at, 2, "", 1, 0)]
        at += 1
    other = '<Worksheet ss:Name="B"><Table><Row><Cell><Data>second</Data></Cell></Row></Table></Worksheet>'
    (tmp_path / "t.xml").write_text(f'<?xml version="1.0"?><Workbook {ns}><Worksheet ss:Name="A"><Table>\n' + "\n".join(body) + f"</Table></Worksheet>{other}</Workbook>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert rows(spreadsheetml.cells(spark, str(tmp_path / "t.xml")).drop("path", "sheet_no")) == sorted(want, key=repr)
        both = spreadsheetml.cells(spark, str(tmp_path / "t.xml"), every_sheet=True).where("sheet_no = 1")
        assert rows(both.select("row", "text")) == [(0, "second")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_grid_cover_and_widths(spark):
    found = spark.createDataFrame([("p", 0, 0, 0, "a", 1, 1), ("p", 0, 1, 1, "b", 0, 0), ("p", 0, 1, 2, "c", 0, 0)], "path string, sheet_no int, row int, column int, text string, merge_across int, merge_down int")
    grid = {(r.row, r.column): r.text for r in spreadsheetml.covered(found).collect()}
    assert grid == {(0, 0): "a", (0, 1): "a", (1, 0): "a", (1, 1): "a", (1, 2): "c"}
    columns = spark.createDataFrame([("p", 0, 0, 1, 10.0), ("p", 0, 2, 2, 5.0)], "path string, sheet_no int, start int, end int, width double")
    assert {r.text: r.width for r in spreadsheetml.widths(found, columns).collect()} == {"a": 20.0, "b": 10.0, "c": 5.0}


def test_ids_are_joined(spark):
    df = spark.createDataFrame([(["1", " r ", "", "ap", "n", "x", "y"],), (["2"],)], "r array<string>")
    assert rows(df.select(spreadsheetml.joined_ids(F.col("r")))) == [(["1", "r\nap", "n", "x", "y"],), (["2", "", ""],)]


def test_a_document_is_one_file(spark):
    """Small partitions make Spark deal a document's parts to several tasks where they come from several frames."""
    from markbook import workbook_queries

    confs = {"advisoryPartitionSizeInBytes": "64b", "coalescePartitions.minPartitionSize": "64b", "coalescePartitions.parallelismFirst": "false"}
    for k, v in confs.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        customers = spark.range(15_000).selectExpr("id as c_custkey", "concat('c', id) as c_name", "cast(id % 25 as int) as c_nationkey", "'BUILDING' as c_mktsegment")
        folder = workbook_queries.sheetml(lambda name: customers, spark)
    finally:
        for k in confs:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).groupBy("doc").count()
    assert {r["count"] for r in files.collect()} == {1} and files.count() == 15
    seen = spreadsheetml.cells(spark, folder)
    assert seen.where("text = 'other'").count() == 0 and seen.where("row = 0").count() == 15


def test_rows_beyond_a_sheet_go_on_in_further_ones(spark, tmp_path):
    df = spark.range(250).select(F.col("id"), F.concat(F.lit("v"), "id").alias("it's"))
    sheets = {"O'Neil": Sheet(df, ["id"], continues=True), "Plain": Sheet(df.where("id < 3"), ["id"]), "O'Neil (2)": Sheet(df.limit(0))}
    write_workbooks(str(tmp_path), sheets, name="long", most_rows=101)
    with zipfile.ZipFile(tmp_path / "long.xlsx") as z:
        assert z.testzip() is None and sum(x.startswith("xl/worksheets") for x in z.namelist()) == 5
    got = sheetreader.read(spark, str(tmp_path / "long.xlsx"), every_sheet=True)
    assert got.rejects.count() == 0
    found = {}
    for r in got.rows.orderBy("sheet_no", "_row_no").collect():
        found.setdefault((r.sheet_no, r.sheet), []).append((r._row_no, r.cells))
    head = (0, ["id", "it's"])
    assert found == {(0, "O'Neil"): [head, *((i + 1, [str(i), f"v{i}"]) for i in range(250))], (1, "Plain"): [head, *((i + 1, [str(i), f"v{i}"]) for i in range(3))], (2, "O'Neil (2)"): [head]}
    with pytest.raises(Exception, match="a sheet holds"):
        write_workbooks(str(tmp_path), {"S": Sheet(df, ["id"])}, most_rows=101)


def test_blocks_of_a_batch_are_small():
    """Spark's Parquet reader takes ``columnarReaderBatchSize`` blocks at once, whatever their width."""
    xml = f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(f"<row><c><v>{i}</v></c></row>" for i in range(100_000)) + "</sheetData></worksheet>"
    found = list(sheetreader.blocks_of(io.BytesIO(xml.encode()), "row", "sheetData"))
    assert max(len(x) for _, x in found) * 4096 < 1 << 27


def as_xml(body):
    """The cells of rows by an XML parser, for cells one after another; None if it is no XML."""
    from xml.etree import ElementTree as ET

    try:
        root = ET.fromstring(b"<x>" + body + b"</x>")
    except ET.ParseError:
        return None
    text = lambda c: {"inlineStr": lambda: c.findtext("is/t"), "b": lambda: {"1": "True", "0": "False"}.get(c.findtext("v"))}.get(c.get("t"), lambda: c.findtext("v"))()
    return [[text(c) for c in r.findall("c")] for r in root.findall("row")]


def test_plain_rows_are_what_a_parser_sees():
    """Plain rows are told apart without a parser; changed anywhere, they are left to it or still right."""
    rng = random.Random(5)
    inline = '<c t="inlineStr"><is><t xml:space="preserve">{}</t></is></c>'
    forms = [lambda: f"<c><v>{rng.random():.3f}</v></c>", lambda: "<c/>", lambda: f'<c t="b"><v>{rng.randrange(2)}</v></c>', lambda: inline.format(rng.choice(["", " ", "a\n\tb", " &lt;x &amp;amp; &#13;&gt;", "é中\U0001d4b3", "True"]))]
    plain = lambda: "".join("<row>" + "".join(rng.choice(forms)() for _ in range(rng.randrange(5))) + "</row>" for _ in range(1 + rng.randrange(4))).encode()
    odd = [b"<", b">", b"&", b"\x12", b"\r", b" ", b"x", b"<row>", b"</row>", b"</c>", b"<c>", b"<v>", b"</v>", b"</t></is></c>", b"</v></c>", b"&bad;", b"&#65;", b"<!-- -->", b' r="A1"', b"<v></v>", b"\xef\xbf\xbf"]
    for _ in range(3000):
        body = plain()
        assert sheetreader.plain_rows(body).to_pylist() == as_xml(body), body
        assert sheetreader.plain_rows(body, "").to_pylist() == [[v or "" for v in r] for r in as_xml(body)]
        at, cut = rng.randrange(len(body)), rng.randrange(3)
        changed = body[:at] + rng.choice(odd) + body[at + cut :]
        if changed.decode(errors="replace").encode() != changed:
            continue  # the reader refuses what isn't UTF-8 before
        got = sheetreader.plain_rows(changed)
        assert got is None or got.to_pylist() == as_xml(changed), changed


def test_written_rows_need_no_xml_parser(spark, tmp_path):
    """what the writer wrote is read as plain rows; other blocks go to the parser, in order and each once."""
    df = spark.range(30_000).select(F.col("id"), (F.col("id") / 4).alias("d"), (F.col("id") % 2 == 0).alias("b"), F.when(F.col("id") % 3 > 0, F.concat(F.lit(" <&\r"), "id")).alias("s"))
    write_workbooks(str(tmp_path), {"S": Sheet(df, ["id"])})
    with zipfile.ZipFile(tmp_path / "book.xlsx") as z:
        xml = z.read("xl/worksheets/sheet1.xml")
    bodies = [b for _, _, b, _ in sheetreader._bodies(io.BytesIO(xml), "row", "sheetData", 0, sheetreader.PLAIN, sheetreader.PLAIN)]
    assert len(bodies) > 5 and all(sheetreader.plain_rows(b) is not None for b in bodies)
    want = sheetreader.read(spark, str(tmp_path / "book.xlsx")).rows.collect()
    assert len(want) == 30_001
    mixed = xml.replace(b"<row><c><v>9000</v>", b'<row r="x"><c><v>9000</v>').replace(b"<row><c><v>29999</v>", b"<row><!-- --><c><v>29999</v>")
    assert rows(read(spark, tmp_path, package(mixed.decode())).rows.drop("path", "sheet")) == rows(spark.createDataFrame(want).drop("path", "sheet"))


def test_an_entry_that_breaks_off_keeps_the_rows_before(spark, tmp_path):
    good = "".join(f"<row><c><v>{i}</v></c></row>" for i in range(40_000))
    got = read(spark, tmp_path, package(f'<worksheet xmlns="{MAIN}"><sheetData>{good}<row>'))
    assert got.rejects.count() == 1 and 0 < got.rows.count() < 40_000
    assert got.rows.where("cast(get(cells, 0) as int) <> _row_no").count() == 0
