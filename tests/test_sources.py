import http.server
import io
import json
import threading
import zipfile

import pytest

from attestra.sources import files, pages, registry, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def book(extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Horas" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>Mes</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><f>1+1</f><v>2</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


def test_intake_keeps_refusals_as_rows(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A") + b"\0\0\0\rIHDR" + (100_000).to_bytes(4, "big") * 2
    frame = bytes.fromhex("FFD8FFE0000400FFFFC0000B08") + (600).to_bytes(2, "big") + (800).to_bytes(2, "big")
    for name, data in {"a.pdf": b"%PDF-1.7 <</Type /Page>>", "g.pdf": b"%PDF-1.7 /Type/Page /Encrypt 1 0 R", "h.pdf": b"%PDF-1.7 /Type /Pages", "i.jpg": frame, "j.jpg": frame[:8], "k.jpg": frame[:-4] + b"\xff" * 4, "b.xlsx": book(), "c.zip": b"PK\x03\x04broken", "d.bin": b"zz", "e.xlsm": book(["xl/vbaProject.bin"]), "f.png": png}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["status"]) for r in files.intake(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": ("PDF", "RECEIVED"), "b.xlsx": ("XLSX", "RECEIVED"), "c.zip": ("UNSUPPORTED", "CORRUPT"), "d.bin": ("UNSUPPORTED", "UNSUPPORTED"), "e.xlsm": ("UNSUPPORTED", "UNSUPPORTED"), "f.png": ("PNG", "UNSUPPORTED"), "g.pdf": ("PDF", "UNSUPPORTED"), "h.pdf": ("PDF", "CORRUPT"), "i.jpg": ("JPEG", "RECEIVED"), "j.jpg": ("JPEG", "CORRUPT"), "k.jpg": ("JPEG", "UNSUPPORTED")}


def test_workbook_cells(spark):
    frame = spark.createDataFrame([("d", bytearray(book()))], "document_id string, content binary")
    got = sorted(tuple(r) for r in workbook.workbook_cells(frame).collect())
    assert got == [("d", "Horas", 1, 1, "Mes", "s", False, None), ("d", "Horas", 1, 3, "x", "inlineStr", False, None), ("d", "Horas", 1, 28, "2", "n", True, "1+1")]
    with pytest.raises(ValueError):
        list(workbook.cells_of(book(), most=1))


def test_a_bad_workbook_is_a_row(spark):
    frame = spark.createDataFrame([("good", bytearray(book())), ("bad", bytearray(b"PK\x03\x04zz")), ("none", None)], "document_id string, content binary")
    got = {r["document_id"]: (r["status"], r["cells"]) for r in workbook.workbook_status(frame).collect()}
    assert got == {"good": ("EXTRACTED", 3), "bad": ("CORRUPT", 0), "none": ("CORRUPT", 0)}
    assert {r["document_id"] for r in workbook.workbook_cells(frame).collect()} == {"good"}


def test_files_against_a_manifest(spark):
    found = spark.createDataFrame([("a.pdf",), ("z.pdf",)], "file string")
    manifest = spark.createDataFrame([("A", "a.pdf"), ("B", "b.pdf")], "entry string, file string")
    assert {tuple(r) for r in files.against_manifest(found, manifest).collect()} == {("A", "a.pdf", True), ("B", "b.pdf", False), (None, "z.pdf", True)}


def test_page_fields_and_urls(spark):
    html = '<dl><dt>x</dt><dd data-field="call-code">C-1 <b>x</b></dd><dd data-field="eligible-from">2025-01-01</dd></dl>'
    got = {r["field_path"]: (r["value"], r["missing"]) for r in pages.page_fields(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").collect()}
    assert got["call.code"] == ("C-1 x", False) and got["call.eligible_from"] == ("2025-01-01", False)
    assert got["call.max_funding_eur"] == (None, True) and got["call.status"] == (None, False)
    assert pages.public_address("8.8.8.8") and not pages.public_address("10.0.0.1") and not pages.public_address("::1")


class _Api(http.server.BaseHTTPRequestHandler):
    people = [{"employee_id": f"E{k}", "full_name": f"N{k}", "role": "r", "hourly_rate_eur": "10.50", "contract_start": "2021-01-01", "contract_end": None} for k in range(5)]
    failures = 1
    version = "1.0.0"

    def do_GET(self):
        if type(self).failures:
            type(self).failures -= 1
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        query = dict(x.split("=") for x in self.path.split("?")[1].split("&"))
        page, size = int(query["page"]), int(query["page_size"])
        items = self.people[(page - 1) * size : page * size]
        body = json.dumps({"contract_version": self.version, "page": page, "page_size": size, "total": 5, "has_more": page * size < 5, "items": items}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_registry_source(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/personnel"
    try:
        assert [p["employee_id"] for p in registry.fetch(url, 2)] == ["E0", "E1", "E2", "E3", "E4"]
        spark.dataSource.register(registry.RegistrySource)
        rows = spark.read.format("registry").option("url", url).option("page_size", "2").load()
        assert rows.count() == 5 and rows.where("contract_end is null").count() == 5
        with pytest.raises(registry.RegistryError):
            list(registry.fetch(url, 2, max_pages=1))
        _Api.version = "2"
        with pytest.raises(registry.RegistryError):
            list(registry.fetch(url, 2))
    finally:
        _Api.version = "1.0.0"
        server.shutdown()
