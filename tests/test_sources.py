import io
import json
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from umbra.operators import redact
from umbra.operators.detect import Settings, detect
from umbra.sources import files, formats, vault
from umbra.streaming import detect as streaming

CONTACT = Settings(entities=frozenset({"EMAIL_ADDRESS", "PRIVATE_IP"}))
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def run(*texts):
    return "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts)


def docx():
    body = f'<w:p>{run("mail a@", "x.no", " end")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("10.0.0.1")}</w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>b</w:t><w:tab/><w:t>c@x.no</w:t></w:r></w:p><w:sectPr><w:headerReference w:type="default" r:id="h1"/></w:sectPr>'
    return archive(**{
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": rels(h1="header1.xml"),
        "word/header1.xml": f"<w:hdr {W}><w:p>{run('h@x.no')}</w:p></w:hdr>",
    })


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = '<c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>plain</t></is></c><c r="C1"><v>12345</v></c><c r="D1"><f>WEBSERVICE("http://e")</f><v>1</v></c>'
    return archive(**{
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Ark" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(r1="worksheets/sheet1.xml"),
        "xl/sharedStrings.xml": f"<sst {s}><si><t>mail a@x.no</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row r="1">{cells}</row></sheetData></worksheet>',
    })


def pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>"
    return archive(**{
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="s1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(s1="slides/slide1.xml"),
        "ppt/slides/slide1.xml": f"<p:sld {ns}><p:cSld><p:spTree>{shape.format('a@x.no')}{shape.format('b@x.no')}</p:spTree></p:cSld></p:sld>",
    })


def odt():
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    return archive(mimetype="application/vnd.oasis.opendocument.text", **{"content.xml": f"<office:document-content {ns}><office:body><office:text><text:p>mail <text:span>a@x.no</text:span> end</text:p></office:text></office:body></office:document-content>"})


def pdf():
    page = zlib.compress(b"BT (mail a@x.no) Tj T* [(10.0) 3 (.0.1)] TJ ET")
    return b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Filter /FlateDecode>> stream\n" + page + b"\nendstream endobj\n"


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"tEXt", b"Author\0Ola") + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


FILES = {
    "a.txt": b"mail a@x.no\n10.0.0.1 \xff", "b.csv": b"name,key\na@x.no,1", "c.json": json.dumps({"k": {"m": "a@x.no"}, "t": ["10.0.0.1", 5], "é": None}).encode(),
    "broken.json": b"{a@x.no", "d.docx": docx(), "e.xlsx": xlsx(), "f.pptx": pptx(), "g.odt": odt(), "h.png": png(), "i.pdf": pdf(), "empty.txt": b"", "j.exe": b"x", "bad.docx": b"no zip",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (path / name).write_bytes(data)
    return path


def test_files_become_units(spark, folder):
    rows = files.units(files.read_files(spark, str(folder))).collect()
    got = {}
    for r in rows:
        got.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    texts = {name: {r["ctx"]: r["text"] for r in rs if r["error"] is None} for name, rs in got.items()}
    assert texts["a.txt"] == {"": "mail a@x.no\n10.0.0.1 �"}
    assert texts["c.json"] == {"k.m": "a@x.no", "t[0]": "10.0.0.1"}
    assert texts["broken.json"] == {"": "{a@x.no"}
    assert texts["d.docx"] == {"para 1": "mail a@x.no end", "para 2": "b\tc@x.no", "table 0 cell 0,0 para 0": "10.0.0.1", "hdr para 0": "h@x.no"}
    assert texts["e.xlsx"] == {"Ark!A1": "mail a@x.no", "Ark!B1": "plain", "Ark!D1": '=WEBSERVICE("http://e")'}
    assert texts["f.pptx"] == {"slide 1 shape 1 para 1": "a@x.no", "slide 1 shape 2 para 1": "b@x.no"}
    assert list(texts["g.odt"].values()) == ["mail ", "a@x.no", " end"]
    assert texts["i.pdf"] == {"page 1": "mail a@x.no\n10.0.0.1"}
    assert "h.png" not in got
    assert "unsupported" in got["j.exe"][0]["error"]
    assert got["bad.docx"][0]["error"]
    assert {r["kind"] for r in got["e.xlsx"]} == {"text", "formula"}
    assert formats.xlsx_units(FILES["e.xlsx"], numbers=True)[2][1] == "12345"


def test_files_are_written_without_the_values(spark, folder):
    read = files.read_files(spark, str(folder))
    units = files.as_units(files.units(read))
    found = detect(units, CONTACT)
    tokens = redact.assign_tokens(found, units)
    spans = found.join(tokens.select("doc_id", "value", "token"), ["doc_id", "value"]).select(F.col("doc_id").alias("path"), "ctx", "st", "en", "token")
    out = {r["path"].rsplit("/", 1)[-1]: r for r in files.replace_in_files(read, spans).collect()}
    assert out["a.txt"]["content"].decode() == "mail [EMAIL_ADDRESS_1]\n[PRIVATE_IP_1] �"
    assert json.loads(out["c.json"]["content"]) == {"k": {"m": "[EMAIL_ADDRESS_1]"}, "t": ["[PRIVATE_IP_1]", 5], "é": None}
    assert "é" in out["c.json"]["content"].decode()
    for name, kind in (("d.docx", "docx"), ("e.xlsx", "xlsx"), ("f.pptx", "pptx"), ("g.odt", "odf")):
        texts = [t for _, t, _ in formats.READERS[kind](bytes(out[name]["content"]))]
        assert not any("x.no" in t for t in texts)
        assert any("[EMAIL_ADDRESS_1]" in t for t in texts)
    assert "mail [EMAIL_ADDRESS_1] end" in [t for _, t, _ in formats.READERS["docx"](bytes(out["d.docx"]["content"]))]
    assert b'width="24"' in zipfile.ZipFile(io.BytesIO(out["e.xlsx"]["content"])).read("xl/worksheets/sheet1.xml")
    assert b"tEXt" not in bytes(out["h.png"]["content"])
    assert out["i.pdf"]["error"]
    assert out["j.exe"]["error"]


def test_jpeg_loses_its_metadata():
    segment = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    data = b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xE1, b"Exif owner") + segment(0xFE, b"note") + segment(0xDB, b"q") + b"\xff\xda\x00\x02rest"
    assert formats.image_cleaned(data) == b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xDB, b"q") + b"\xff\xda\x00\x02rest"
    with pytest.raises(ValueError, match="neither"):
        formats.image_cleaned(b"GIF89a")


def test_archives_that_declare_too_much_are_refused():
    formats.check_archive(b"no archive")
    formats.check_archive(archive(a="x" * 10))
    with pytest.raises(ValueError, match="declares"):
        formats.check_archive(archive(a="x" * 10), most=9)


@pytest.mark.parametrize(("path", "kind"), [("/a/b.TXT", "text"), ("x.dotx", "docx"), ("x.xlsm", "xlsx"), ("x.tar.yml", "text"), ("x.heic", "image"), ("a/.env", "text"), ("x.odp", "odf"), ("x", None), ("x.exe", None)])
def test_routes(path, kind):
    assert formats.route(path) == kind
    assert formats.is_supported(path) == (kind is not None)


def test_files_come_back(spark):
    """Detect, number, replace and restore by format; the texts of all units are those of the first files."""
    kinds = [n for n in FILES if formats.route(n) in ("text", "json", "docx", "xlsx", "pptx", "odf") and n not in ("bad.docx",)]
    held = spark.createDataFrame([(n, formats.route(n), FILES[n]) for n in kinds], "path string, format string, content binary")
    texts = files.as_units(files.units(held))
    found = detect(texts, CONTACT)
    tokens = redact.assign_tokens(found, texts)
    spans = found.join(tokens.select("doc_id", "value", "token"), ["doc_id", "value"]).select(F.col("doc_id").alias("path"), "ctx", "st", "en", "token")
    out = files.replace_in_files(held, spans)
    gone = files.as_units(files.units(out.select("path", "format", "content")))
    assert gone.where("text like '%a@x.no%'").count() == 0
    assert found.count() > 3
    back = files.restore_files(out.select("path", "format", "content"), tokens.select(F.col("doc_id").alias("path"), "token", "value"))
    assert back.where("error is not null").count() == 0
    again = files.as_units(files.units(back.select("path", "format", "content")))
    assert sorted((r["doc_id"], r["text"]) for r in again.collect()) == sorted((r["doc_id"], r["text"]) for r in texts.collect())



def test_names(spark, tmp_path):
    path = tmp_path / "names.txt"
    path.write_text("# head\nOla\n\n Kari \nOla\n", encoding="utf-8")
    assert sorted(r["name"] for r in files.names_file(spark, str(path)).collect()) == ["Kari", "Ola"]
    assert files.names_file(spark, str(tmp_path / "none.txt")).count() == 0
    raw = spark.createDataFrame([(x,) for x in ("OLA (m)", "Alle navn", "B", " Åse ", "KARI ANN", "")], "name string")
    assert sorted(r["name"] for r in files.cleaned_names(raw).collect()) == ["Kari Ann", "Ola", "Åse"]


def test_text_files_by_lines(spark, tmp_path):
    (tmp_path / "x.log").write_text("a@x.no\nnone\nb@x.no\n", encoding="utf-8")
    assert {r["value"] for r in detect(files.line_units(spark, str(tmp_path)), CONTACT).collect()} == {"a@x.no", "b@x.no"}
    assert detect(files.text_file_units(spark, str(tmp_path)), CONTACT).count() == 2


def test_vaults(spark, tmp_path):
    path = str(tmp_path / "v.vault")
    tokens = {"[A_1]": "å@x.no", "[B_2]": ""}
    table = vault.vault_table(spark, 7, tokens)
    vault.save_vault(table, 7, path, "secret pass", iterations=1000)
    assert vault.load_vault(spark, path, "secret pass") == tokens
    assert (tmp_path / "v.vault").stat().st_mode & 0o777 == 0o600
    with pytest.raises(ValueError, match="password is wrong"):
        vault.load_vault(spark, path, "other")
    held = json.loads((tmp_path / "v.vault").read_text())
    assert held["version"] == 1
    import base64

    (tmp_path / "old.vault").write_text(json.dumps({"salt": held["salt"], "data": base64.b64encode(held["data"].encode()).decode(), "kdf_iterations": 1000}))
    assert vault.load_vault(spark, str(tmp_path / "old.vault"), "secret pass") == tokens
    for text in ("", "[]", '{"salt": "x"}', '{"salt": "!", "data": "x"}'):
        (tmp_path / "bad.vault").write_text(text)
        with pytest.raises(ValueError, match="ault"):
            vault.load_vault(spark, str(tmp_path / "bad.vault"), "p")


def test_a_vault_made_elsewhere_opens(spark, tmp_path):
    """The token of the published Fernet test vector: key, time, iv and text are known."""
    import base64

    key = base64.urlsafe_b64decode("cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4=")
    token = b"gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA=="
    assert vault._opened(spark, key, token) == b"hello"


def run_stream(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else frame.sparkSession.table(name)


def test_streams_number_tokens_across_batches(spark, tmp_path):
    kind = "doc_id long, ctx string, ord int, text string"
    for i, text in enumerate(["a@x.no b@x.no", "c@x.no a@x.no 10.0.0.1"]):
        spark.createDataFrame([(1, "", i, text), (2, "", i, "only@x.no")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = [tuple(r) for r in run_stream(streaming.number_stream(source, CONTACT), "numbered").collect()]
    of = {(d, v): t for d, v, _, t in rows}
    assert len(of) == len(rows) == 5
    assert {t for (d, _), t in of.items() if d == 1} == {"[EMAIL_ADDRESS_1]", "[EMAIL_ADDRESS_2]", "[EMAIL_ADDRESS_3]", "[PRIVATE_IP_1]"}
    assert of[2, "only@x.no"] == "[EMAIL_ADDRESS_1]"
    found = run_stream(streaming.detect_stream(source, CONTACT), "found")
    assert found.count() == 7


def test_streams_count_by_window(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a@x.no"), ("2024-01-01 00:02:00", "b@x.no 10.0.0.1"), ("2024-01-01 00:07:00", "c@x.no"), ("2024-01-01 03:00:00", "d@x.no")]
    df = spark.createDataFrame([(i, "", 0, t, ts) for i, (ts, t) in enumerate(rows)], "doc_id long, ctx string, ord int, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = run_stream(streaming.entity_counts(source, "ts", CONTACT), "counts", "complete").collect()
    assert sorted((str(r["window"]["start"])[11:16], r["entity"], r["n"]) for r in counts) == [("00:00", "EMAIL_ADDRESS", 2), ("00:00", "PRIVATE_IP", 1), ("00:05", "EMAIL_ADDRESS", 1), ("03:00", "EMAIL_ADDRESS", 1)]


def test_random_spans_are_replaced_in_runs():
    """Run-aware replacement gives the text that plain replacement gives."""
    rng = random.Random(2)
    for _ in range(40):
        runs = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 5))) for _ in range(5)]
        text = "".join(runs)
        data = archive(**{"word/document.xml": f"<w:document {W}><w:body><w:p>{run(*runs)}</w:p></w:body></w:document>"})
        points = sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1) // 2 * 2))
        spans = [(a, b, f"[T_{a}]") for a, b in zip(points[::2], points[1::2], strict=True)]
        out = formats.WRITERS["docx"](data, {"para 1": spans})
        assert formats.READERS["docx"](out) == [("para 1", formats.replaced(text, spans), "text")]
