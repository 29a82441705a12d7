import base64
import io
import zipfile

import pandas as pd
import pytest

import semloom as sl
from semloom.sources import file_to_xls, xls_to_tables
from semloom.streaming import each_batch, stateless, streamed


def workbook():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>Ann</t></si></sst>')
        rows = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{min(i - 1, 1)}</v></c><c r="C{i}"><v>{i}</v></c></row>' for i in range(1, 10))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_text_and_html(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.txt").write_text("two\nlines")
    (tmp_path / "t" / "a.md").write_text("one")
    assert sorted(map(tuple, sl.TextFileDataset("t", str(tmp_path / "t")).run().df.collect())) == [("a.md", "one"), ("b.txt", "two\nlines")]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "p.html").write_text('<html><head><title>T</title></head><body><p>See <a href="http://example.com">Example Link</a> &amp; more</p></body></html>')
    page = sl.get_local_source("h", str(tmp_path / "h")).run().df.first()
    assert "Example Link (http://example.com)" in page["text"] and "& more" in page["text"] and "T" not in page["text"].split()


def test_binary_sources(spark, tmp_path):
    for folder, name, data in (("i", "x.PNG", b"png"), ("x", "x.xlsx", workbook()), ("p", "x.pdf", b"%PDF")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_bytes(data)
    (tmp_path / "w" / "deep").mkdir(parents=True)
    (tmp_path / "w" / "deep" / "x.wav").write_bytes(b"wav" * 60)
    (tmp_path / "w" / "no.txt").write_text("x")
    assert base64.b64decode(sl.get_local_source("i", str(tmp_path / "i")).run().df.first()["contents"]) == b"png"
    sound = sl.AudioFileDataset("w", str(tmp_path / "w")).run().df.collect()
    assert len(sound) == 1 and base64.b64decode(sound[0]["contents"]) == b"wav" * 60 and "\n" not in sound[0]["contents"]
    book = sl.XLSFileDataset("x", str(tmp_path / "x")).run().df.first()
    assert (book["number_sheets"], book["sheet_names"]) == (1, ["S1"])
    assert sl.PDFFileDataset("p", str(tmp_path / "p"), extract=lambda b: b.decode()).run().df.first()["text_contents"] == "%PDF"
    assert file_to_xls({"contents": workbook()}) == {"number_sheets": 1, "sheet_names": ["S1"]}
    (tables,) = xls_to_tables({"contents": workbook(), "filename": "d/f.xlsx"})
    assert tables["name"] == "f.xlsx_S1" and tables["header"] == ["name", "", "1"] and len(tables["rows"]) == 5


def test_memory_and_resolve(spark):
    assert sl.MemoryDataset("v", ["a", "b"]).schema.names == ["value"]
    assert sl.MemoryDataset("f", pd.DataFrame({0: [1], 1: ["x"]})).schema.names == ["column_0", "column_1"]
    assert [tuple(r) for r in sl.MemoryDataset("m", pd.DataFrame({"a": [1.5, None]})).run()] == [(1.5,), (None,)]
    assert len(sl.resolve_datasource("l", [{"a": 1}]).run()) == 1
    assert len(sl.resolve_datasource("s", spark.range(3)).run()) == 3
    for bad in (5, "/no/such/place"):
        with pytest.raises(ValueError):
            sl.resolve_datasource("x", bad)


def test_source_ids_follow_the_records(spark):
    left = sl.MemoryDataset("l", [{"k": i} for i in range(6)]).with_source_ids()
    right = sl.MemoryDataset("r", [{"k": i} for i in (1, 4)]).with_source_ids()
    got = sorted(map(tuple, left.join(right, "k").run().df.collect()))
    assert got == [(1, "l-1", "r-0"), (4, "l-4", "r-1")]


class Squares(sl.IterDataset):
    def __init__(self, n):
        super().__init__("squares", [{"name": "i", "type": int, "desc": ""}, {"name": "sq", "type": int, "desc": ""}])
        self.n = n

    def __len__(self):
        return self.n

    def __getitem__(self, i):
        return {"i": i, "sq": i * i, "unused": 1}


def test_user_dataset(spark):
    got = Squares(20).filter(lambda r: r["sq"] > 300, "sq").run()
    assert sorted(map(tuple, got.df.collect())) == [(18, 324), (19, 361)]
    assert Squares(20).run().df.rdd.getNumPartitions() > 1


def test_contexts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("the budget is 5")
    (tmp_path / "b.txt").write_text("nothing")
    manager = sl.ContextManager()
    context = sl.TextFileContext(str(tmp_path), "files", "two notes")
    found = context.search("where is the budget", manager=manager)
    assert "RESULT" not in found.description and not found.materialized  # not asked before it runs
    found.run()
    assert "a.txt" in found.description and "RESULT" in found.description and found.materialized
    agent = sl.LocalAgent({"add": lambda tools: len(tools["tool_list_filepaths"]())})
    done = found.compute("add", agent, manager)
    assert done.schema.names[-1] == f"result-{done.id}"
    assert done.run().df.first()[done.column] == "2"
    assert manager.get_context(done.id) is done
    assert manager.search_context("two notes budget", k=1, where={"materialized": True})
    with pytest.raises(KeyError):
        manager.get_context("nobody")
    assert context.tool_execute_semantic_operators("it has 'budget'") == ["a.txt"]
    kept = sl.ContextManager(str(tmp_path))
    kept.add_context(sl.Context("c", "kept words"))
    assert sl.ContextManager(str(tmp_path)).get_context("c").description == "kept words"


def test_results_as_pandas_and_statistics_as_json(spark, tmp_path):
    import json

    done = sl.MemoryDataset("a", [{"t": f"word {i}", "i": i} for i in range(6)]).sem_filter("has 'word'", depends_on="t").run(provider=sl.LocalProvider(), optimizer_strategy="none")
    frame = done.to_df(["i"])
    assert list(frame.columns) == ["i"] and sorted(frame.i) == list(range(6)) and len(done.to_df().columns) == 2
    told = json.loads(done.execution_stats.to_json(str(tmp_path / "s.json")))
    assert json.loads((tmp_path / "s.json").read_text()) == told
    assert told["operators"][0]["calls"] == 6 and told["total_execution_cost"] > 0
    done.release()


def test_tables_of_workbooks():
    from semloom.catalogue import _workbook
    from semloom.sources import udfs

    assert udfs.file_to_xls({"contents": _workbook(["a", "b"])}) == {"number_sheets": 2, "sheet_names": ["a", "b"]}
    (table,) = udfs.xls_to_tables({"contents": _workbook(["s"]), "filename": "x/y.xlsx"}, None)
    assert table == {"name": "y.xlsx_s", "header": ["1"], "rows": []}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(10).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    rowwise = sl.FrameDataset(stream).filter(lambda r: r["id"] > 6, "id")
    assert stateless(rowwise) and not stateless(rowwise.count())
    q = streamed(rowwise).writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").count() == 3
    seen = []
    q = each_batch(stream, lambda d: d.count(), lambda df, epoch: seen.append(df.first()[0]), checkpointLocation=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 10
    with pytest.raises(ValueError):
        streamed(rowwise.count())
