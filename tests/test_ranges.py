"""Files read in parts: blocks of bytes and sheets by separate tasks, equal to reading them whole."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docquarry.sources import files, ranges, tabular, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets, shared=(), linked=False):
    """A workbook of (name, {(row, column): text}, merged references); texts in ``shared`` are stored once."""
    out = io.BytesIO()
    ref = lambda r, k: f"{chr(65 + k // 26 - 1) if k > 25 else ''}{chr(65 + k % 26)}{r + 1}"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{name}" r:id="rId{i}"/>' for i, (name, *_) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(f"<si><t>{t}</t></si>" for t in shared)}</sst>')
        entry = lambda i: f"xl/worksheets/sheet{len(sheets) - i if linked else i + 1}.xml"
        if linked:
            links = "".join(f'<Relationship Id="rId{i}" Target="{entry(i)[3:]}"/>' for i in range(len(sheets)))
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (_, cells, merged) in enumerate(sheets):
            rows = {}
            for (r, k), text in sorted(cells.items()):
                body = f' t="s"><v>{shared.index(text)}</v>' if text in shared else f' t="inlineStr"><is><t>{text}</t></is>'
                rows.setdefault(r, []).append(f'<c r="{ref(r, k)}"{body}</c>')
            data = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in rows.items())
            areas = "".join(f'<mergeCell ref="{ref(*a)}:{ref(*b)}"/>' for a, b in merged)
            z.writestr(entry(i), f'<worksheet xmlns="{MAIN}"><sheetData>{data}</sheetData>{f"<mergeCells>{areas}</mergeCells>" if areas else ""}</worksheet>')
    return out.getvalue()


def filled(cells, merged):
    """All cells at once, by brute force."""
    out = dict(cells)
    height, width = (max([*(p[i] for p in cells), *(a[i] for a, _ in merged)], default=-1) for i in (0, 1))
    for a, b in merged:
        for r in range(a[0], min(b[0], height) + 1):
            for k in range(a[1], min(b[1], width) + 1):
                out[r, k] = cells.get(a, "")
    return sorted((r, k, t) for (r, k), t in out.items())


def test_cells_of_random_sheets():
    rng = random.Random(5)
    for _ in range(60):
        cells = {(rng.randrange(12), rng.randrange(30)): rng.choice(["a", "b c", "7", "shared"]) for _ in range(rng.randrange(25))}
        corners = [(r, k) for r in (0, 4, 9) for k in (0, 8, 20)]
        merged = [((r, k), (r + rng.randrange(5 if r < 9 else 9), k + rng.randrange(8))) for r, k in rng.sample(corners, rng.randrange(4))]
        data = io.BytesIO(book([("S", cells, merged)], ["shared"]))
        ((name, entry),) = workbook.sheets_of(data)
        assert name == "S" and list(workbook.cells_of(data, entry)) == filled(cells, merged)


def test_sheets_follow_the_workbooks_relations():
    data = io.BytesIO(book([("first", {(0, 0): "1"}, []), ("second", {(0, 0): "2"}, [])], linked=True))
    assert [(n, [t for *_, t in workbook.cells_of(data, e)]) for n, e in workbook.sheets_of(data)] == [("first", ["1"]), ("second", ["2"])]


def several():
    narrow = {(r, k): f"x|{r}" if k else f"n{r}" for r in range(1, 41) for k in range(3)} | {(0, 0): "Title"}
    wide = {(r, k): f"v{r}.{k}" for r in range(20) for k in range(17) if (r + k) % 5 or not r}
    return [("Tên", narrow, []), ("wide", wide, [((3, 0), (5, 0))]), ("bare", {}, []), ("single", {(2, 1): "only"}, [])]


def test_sheets_apart_equal_the_whole(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book(several()))
    (tmp_path / "b.xlsx").write_bytes(book(several()[:1]))
    whole = ranges.read_xlsx(spark, str(tmp_path))
    apart = ranges.read_xlsx(spark, str(tmp_path), block=1)
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(whole) == rows(apart) and whole.count() == sum(len(filled(c, m)) for _, c, m in several()) + len(several()[0][1])
    tasks = {tuple(r) for r in apart.select("source", "sheet", F.spark_partition_id()).collect()}
    assert len(tasks) == len({t[:2] for t in tasks}) and len({t[2] for t in tasks}) > 1


def test_pages_of_all_sheets_equal_those_of_each(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book(several()))
    (tmp_path / "b.xlsx").write_bytes(book(several()[1:]))
    cells = ranges.read_xlsx(spark, str(tmp_path))
    found = {(r["source"][-6:], r["sheet_name"], r["page"], r["row_range"]): r["text"] for r in tabular.sheet_pages(cells).collect()}
    expected = {}
    for file in ("a.xlsx", "b.xlsx"):
        mine = cells.filter(f"source LIKE '%{file}'")
        for name, *_ in several():
            for r in tabular.pages_of(tabular.sheet_table(mine, name), file, sheet=name).collect():
                expected[file, name, r["page"], r["row_range"]] = r["text"]
    assert found == expected and len(expected) > 6
    assert files.read(spark, str(tmp_path / "a.xlsx")).count() == sum(k[0] == "a.xlsx" for k in expected)


@pytest.mark.parametrize("start, length", [(0, None), (3, None), (10, 1000), (999, 2), (4990, None), (5000, None), (0, 0), (100, 10**9)])
def test_blocks_equal_slices(spark, tmp_path, start, length):
    rng = random.Random(1)
    data = {"large one.bin": rng.randbytes(5000), "small.bin": b"abcdefghijk", "empty.bin": b""}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    found = {name: b"" for name in data}
    for r in ranges.byte_blocks(spark, str(tmp_path), start, length, block=1000).orderBy("path", "at").collect():
        name = r["path"].rsplit("/", 1)[-1]
        assert r["at"] == start + len(found[name]) and 0 < len(r["content"]) <= 1000 and r["length"] == len(data[name])
        found[name] += bytes(r["content"])
    assert found == {name: content[start:] if length is None else content[start : start + length] for name, content in data.items()}


def test_blocks_through_another_client(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(200)))

    class Client(io.BytesIO):
        def __init__(self, path):
            super().__init__(open(path.removeprefix("file:"), "rb").read())

    blocks = ranges.byte_blocks(spark, str(tmp_path), block=64, opener=Client).orderBy("at").collect()
    assert [r["at"] for r in blocks] == [0, 64, 128, 192] and b"".join(bytes(r["content"]) for r in blocks) == bytes(range(200))


def test_impossible_ranges(spark, tmp_path):
    with pytest.raises(ValueError):
        ranges.byte_blocks(spark, str(tmp_path), -1)
    with pytest.raises(ValueError):
        ranges.byte_blocks(spark, str(tmp_path), block=0)
