import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.sources import files, html, ranges, tabular
from docquarry.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_sanitizer(spark):
    raw = "1.2 Title\n• item\nline one\ngoes on.\nnew\n\n\n\nTrang 12\n\x07x"
    assert one(spark, T.sanitize_markdown(F.lit(raw))) == "## 1.2 Title\n- item\nline one goes on.\nnew\n\nx"
    assert one(spark, T.sanitize_markdown(F.lit(None).cast("string"))) == ""


def test_scalars(spark):
    assert one(spark, T.normalize_text(F.lit(" Quốc Đô 1!"))) == "quoc o 1"
    assert one(spark, T.mask(F.lit("abcdefgh"))) == "****efgh"
    assert one(spark, T.json_object(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}'
    assert str(one(spark, T.parse_date(F.lit("01/02/2003 10:00")))) == "2003-02-01 00:00:00"
    assert one(spark, T.parse_date(F.lit("nothing"))) is None
    assert one(spark, T.escape_html(F.lit("<a>&'"))) == "&lt;a&gt;&amp;&#39;"
    assert one(spark, T.strip_citations(F.lit("fact [cite: 1, 2]"))) == "fact"


def test_html(spark):
    page = "<html><head><title>t</title></head><body><h1>A &amp; B</h1><p>x <b>y</b></p><ol><li>one</li><li>two</li></ol><table><tr><th>h</th></tr><tr><td>c</td></tr></table><pre>k = 1</pre></body></html>"
    assert html.markdown_of(page) == "# A & B\n\nx y\n\n1. one\n\n2. two\n\n| h |\n| --- |\n| c |\n\n```\nk = 1\n```"
    assert html.markdown_of(None) == "" and html.markdown_of("<p>open") == "open"
    assert one(spark, html.html_text(F.lit("<p>short</p>"))) is None


def test_csv(spark, tmp_path):
    lines = ["Tên,Điểm,Điểm"] + [f"\"a|{i}\",{i},{i}.5" for i in range(40)] + [",,"]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    table = tabular.ingest(tabular.read_csv(spark, str(tmp_path / "x.csv")))
    assert dict(table.dtypes)["_row_idx"] == "bigint" and table.columns[0] == "Ten"
    assert sorted(t for c, t in table.dtypes if c not in ("_row_idx", "search_text")) == ["bigint", "double", "string"]
    pages = tabular.pages_of(table, "x.csv").orderBy("page").collect()
    assert [p["row_range"] for p in pages] == ["1-15", "16-30", "31-40"] and "a\\|3" in pages[0]["text"]


def sheet(cells, merged=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = "".join(f"<row>{''.join(f'<c r={chr(34)}{r}{chr(34)} t={chr(34)}inlineStr{chr(34)}><is><t>{v}</t></is></c>' for r, v in row)}</row>" for row in cells)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData>{merged}</worksheet>")
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    data = sheet([[("A1", "")], [("A2", "Name"), ("B2", "Note")], [("A3", "x"), ("B3", "1")], [("A4", "y"), ("B4", "2")]], '<mergeCells><mergeCell ref="A3:A4"/></mergeCells>')
    (tmp_path / "b.xlsx").write_bytes(data)
    table = tabular.sheet_table(ranges.read_xlsx(spark, str(tmp_path)), "S1")
    assert [tuple(r) for r in table.orderBy("_row_idx").collect()] == [(0, "x", "1"), (1, "x", "2")]


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('Head', 'Heading2')}{p('Body')}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert sorted((r["text"] for r in files.read_docx(spark, str(tmp_path)).collect()), key=str) == ["## Head\n\nBody", None]


def test_pdf_tracks(spark):
    page = lambda n, w, raw: {"source": "s", "page": n, "markdown": None if n == 1 else "", "raw": raw, "images": [{"w": w, "h": w}], "drawings": 0, "blocks": []}
    rows = spark.createDataFrame([page(1, 10.0, "plain"), page(2, 99.0, "picture"), page(3, 99.0, "failed")], files.PAGES)
    ocr = lambda pages: pages.select("source", "page", F.when(F.col("page") == 2, "read").alias("ocr"))
    assert [r["text"] for r in files.parsed_pages(rows, ocr).orderBy("page").collect()] == ["plain", "read", "failed"]


def test_validation(spark):
    rows = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1")), ("b.pdf", bytearray(b"PK\x03\x04")), ("c.md", bytearray(b"# x")), ("d.exe", bytearray(b"MZ"))], "name string, content binary")
    assert [r[0] for r in rows.select(files.is_valid(F.col("name"), F.col("content"), F.length("content"))).collect()] == [True, False, True, False]
    urls = [("http://a.com/x", True), ("http://10.0.0.1/", False), ("ftp://a", False), ("http://u:p@a.com", False), ("http://localhost", False), (None, False)]
    got = spark.createDataFrame([(u,) for u, _ in urls], "u string").select(files.url_is_safe(F.col("u"))).collect()
    assert [r[0] for r in got] == [x for _, x in urls]


def test_job_states():
    s = jobs.advance(("queued", "queued", 0, 0), "running", "parsing", 0.5, False)
    assert s[2] == 30 and jobs.advance(s, "running", "parsing", 0.2, False)[2] == 30
    s = jobs.advance(s, "running", "embedding", 0.5, False)
    assert jobs.advance(s, "running", "parsing", 1.0, False)[1:3] == ("embedding", 80)
    done = jobs.advance(s, "succeeded", "done", 1.0, False)
    assert jobs.advance(done, "running", "parsing", 0.1, False)[0] == "succeeded" and jobs.advance(done, "", "", 0, True)[:3] == ("running", "queued", 0)


def test_job_stream(spark, tmp_path):
    schema = "job_id long, event_id long, status string, stage string, ratio double, start boolean"
    for i, batch in enumerate([[(1, 1, "running", "parsing", 0.5, False)], [(1, 2, "running", "parsing", 0.2, False), (2, 3, "running", "chunking", 1.0, False)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = jobs.job_states(source).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    latest = {r["job_id"]: r["progress"] for r in spark.sql("SELECT job_id, max_by(progress, n_events) AS progress FROM states GROUP BY job_id").collect()}
    assert latest == {1: 30, 2: 70}


def test_sse_round_trip(spark):
    messages = spark.createDataFrame([(1, "two words")], "id int, text string")
    events = jobs.token_events(messages)
    assert [r["type"] for r in events.orderBy("position").collect()] == ["status", "token", "token", "final"]
    lines = events.select(jobs.sse(F.struct("type", "payload")).alias("value")).union(spark.createDataFrame([("data: {broken",), ("noise",)], "value string"))
    assert jobs.parse_sse(lines, "type string, payload string").count() == 4


def test_pdf_reader_hook(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one|two")
    reader = lambda content: [{"page": i + 1, "markdown": None, "raw": t, "images": [], "drawings": 0, "blocks": []} for i, t in enumerate(bytes(content)[5:].decode().split("|"))]
    pages = files.pdf_pages(spark, str(tmp_path), reader)
    assert [r["text"] for r in files.parsed_pages(pages).orderBy("page").collect()] == ["one", "two"]
    box = one(spark, files.content_box(F.array(F.struct(F.lit(20.0).alias("x0"), F.lit(30.0).alias("y0"), F.lit(90.0).alias("x1"), F.lit(95.0).alias("y1"))), F.lit(100.0), F.lit(100.0)))
    assert tuple(box) == (10.0, 20.0, 100.0, 100.0) and tuple(one(spark, files.scaled(F.lit(3000.0), F.lit(1000.0)))) == (1500, 500)


def test_dispatch_and_settings(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿# A\n\ntext")
    (tmp_path / "b.html").write_text("<html><body>" + "<p>some words here</p>" * 20 + "</body></html>")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "settings.env").write_text("# c\nA=1\nAPI_KEY = abcdefgh\n\n")
    assert files.read(spark, str(tmp_path / "a.md")).first()["text"] == "# A\n\ntext"
    assert files.read(spark, str(tmp_path / "b.html")).first()["text"].startswith("some words here")
    assert "| 1 | 2 |" in files.read(spark, str(tmp_path / "c.csv")).first()["text"]
    assert sorted(map(tuple, files.read_settings(spark, str(tmp_path / "settings.env")).collect())) == [("A", "1", False), ("API_KEY", "****efgh", True)]


def test_windowed_counts_drop_late_events(spark, tmp_path):
    from datetime import datetime

    schema = "event_id long, ts timestamp, event_type string, value double"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for hours in ([0, 9], [0], [20]):
        spark.createDataFrame([(h, datetime(2024, 1, 1, h, 10), "a", 1.0) for h in hours], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counts = jobs.windowed_counts(source).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        counts.trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
    assert sorted((r["window"]["start"].hour, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 1), (9, 1)]


def test_no_row_is_lost_in_numbering(spark, tmp_path):
    """Wide rows in an order that sampling sees differently each time."""
    from docquarry.operators.metadata import numbered

    wide = F.repeat(F.sha2(F.col("id").cast("string"), 512), 3)
    rows = spark.range(400_000).select(F.hash("id").alias("k"), "id", wide.alias("wide"), F.lit(1).alias("part"))
    numbered(rows, ["k", "id"], 32).write.parquet(f"{tmp_path}/rows")
    got = spark.read.parquet(f"{tmp_path}/rows")
    assert got.columns == ["k", "id", "wide", "part", "row_idx", "batch"]
    assert tuple(got.agg(F.count("*"), F.countDistinct("row_idx"), F.min("row_idx"), F.max("row_idx")).first()) == (400_000, 400_000, 0, 399_999)
    assert got.filter("batch <> row_idx div 32").isEmpty()


def test_a_long_csv_is_read_whole(spark, tmp_path):
    lines = "\n".join(f'{i},{"x" * 250},"q ""{i}"""' for i in range(300_000))
    (tmp_path / "long.csv").write_text(f"a,b b,part\n{lines}\n")
    got = tabular.read_csv(spark, str(tmp_path / "long.csv"))
    assert got.columns == ["a", "b_b", "part", "_row_idx"]
    assert got.count() == 300_000 and got.filter("_row_idx <> a").isEmpty()


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from docquarry import shared_files

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError):
        shared_files.shared_dir(Cluster, "x")


def _page(paragraphs, link="<a href='/x'>a link of the menu with many words, commas, and more</a>"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>t</title></head><body><div id='top'>{link * 6}</div><div><h2>Title</h2>{body}</div><div class='comments'><p>A short remark, by a reader, of some words.</p></div></body></html>"


def test_main_content(spark):
    long = ["The first paragraph has a number of words, commas, and clauses, " * 3, "The second &amp; last one is as long as the first, or longer, " * 3]
    rows = [(1, _page(long)), (2, None), (3, ""), (4, "<p>short"), (5, _page(long)), (6, "<div>" * 3000 + "x, " * 100), (7, "plain text without any tags, " * 10)]
    pages = spark.createDataFrame(rows, "row long, html string").repartition(3)
    got = {r["row"]: r["main"] for r in html.with_main_content(pages).collect()}
    assert got[1] == got[5] == "## Title\n\n" + "\n\n".join(p.strip().replace("&amp;", "&") for p in long)
    assert got[2] is got[3] is got[4] is None and got[6] == ("x, " * 100).strip() and got[7] == ("plain text without any tags, " * 10).strip()
    assert html.with_main_content(pages.limit(0)).count() == 0


def test_main_content_of_sections_and_lists(spark):
    section = lambda n: f"<section><h3>Part {n}</h3><ul><li>An entry of the list, which is long, number {n}<li>Another entry, as long as the one before</ul><blockquote>Quoted words, {n}, of somebody, at some length</blockquote></section>"
    page = f"<body><nav>menu, menu</nav><article>{section(1)}{section(2)}{section(3)}</article><aside>{'advert, ' * 50}</aside><form>{'field, ' * 50}</form></body>"
    main = html.with_main_content(spark.createDataFrame([(page, "old")], "html string, MAIN string")).first()["main"]
    assert main.startswith("### Part 1\n\n- An entry of the list, which is long, number 1\n\n- Another") and main.endswith("> Quoted words, 3, of somebody, at some length")
    assert "menu" not in main and "advert" not in main and "field" not in main


def test_tiers_and_error(spark):
    page = _page(["The first paragraph has a number of words, commas, and clauses, " * 3])
    pages = html.with_main_content(spark.createDataFrame([("a", page), ("b", "<p></p>")], "source string, html string"))
    of = lambda **more: html.html_text(F.col("html"), main=F.col("main"), **more).alias("t")
    got = {r["source"]: r["t"] for r in pages.select("source", of()).collect()}
    assert got["a"].startswith("## Title") and "remark" not in got["a"] and got["b"] is None
    with pytest.raises(Exception, match="no text in the HTML page b"):
        pages.select(of(source=F.col("source"))).collect()
