"""From files to findings, and what a second run does."""

from attestra import corpus, fixtures, process


def test_dossiers_from_files(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert corpus.write(root) == list(fixtures.EXPECTED)
    found = process.process(spark, root, out)
    rows = found.collect()
    assert {d: {r["rule_id"] for r in rows if r["dossier_id"] == d} for d in fixtures.EXPECTED} == fixtures.EXPECTED
    counts = {r["dossier_id"]: (r["findings"], r["blocking"]) for r in process.summary(found).collect()}
    assert counts["INN-2025-042"] == (17, 11) and "INN-2025-041" not in counts
    assert {r["action"] for r in rows} == {"CREATED"}

    documents = spark.read.parquet(f"{out}/run=0/documents")
    states = {(r["name"], r["status"], r["kind"]) for r in documents.where("dossier_id = 'INN-2025-042'").collect()}
    assert {("notas.txt", "UNSUPPORTED", "UNKNOWN"), ("roto.pdf", "CORRUPT", "UNKNOWN"), ("memoria.pdf", "EXTRACTED", "TECHNICAL_REPORT"), ("horas.xlsx", "EXTRACTED", "TIMESHEET"), ("factura-1.png", "EXTRACTED", "EXPENSE_INVOICE")} <= states
    assert len(states) == 9

    process.report(spark, out, str(tmp_path / "report"))
    sheet = b"".join(p.read_bytes() for p in (tmp_path / "report" / "readings-spreadsheet.csv").glob("part-*"))
    assert sheet.startswith(b"\xef\xbb\xbf") and sheet.count(b"\r\n") == 1 + spark.read.parquet(f"{out}/run=0/readings").count()
    assert process.reindex(spark, out) == spark.read.parquet(f"{out}/run=0/chunks").count() and process.reindex(spark, out) == 0

    again = process.process(spark, root, out)
    assert process.runs(spark, out) == [0, 1]
    assert {r["action"] for r in again.collect()} == {"REFRESHED"}
    same = ["dossier_id", "fingerprint", "rule_id", "severity", "subject", "status"]
    assert sorted(map(tuple, again.select(*same).collect())) == sorted(tuple(r[c] for c in same) for r in rows)
    assert spark.read.parquet(f"{out}/run=0/readings").count() == spark.read.parquet(f"{out}/run=1/readings").count()
    process.reset(spark, out)
    assert process.runs(spark, out) == [] and process.findings(spark, out).count() == 0


def test_the_corpus_is_the_same_each_time(tmp_path):
    for name in "ab":
        corpus.write(str(tmp_path / name))
    a, b = ({p.relative_to(tmp_path / n): p.read_bytes() for p in (tmp_path / n).rglob("*") if p.is_file()} for n in "ab")
    assert a == b and len(a) > 20


WANTED = "dossier_id string, target string, key string, action string, new_value string, reason string, actor string, expected_revision bigint"


def test_decisions_and_changed_dossiers(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    corpus.write(root)
    process.process(spark, root, out)
    at = lambda n, name: spark.read.parquet(f"{out}/run={n}/{name}")
    kinds = {r.field_path.split("[")[0].split(".")[0] for r in at(0, "readings").select("field_path").distinct().collect()}
    assert kinds == {"report", "invoice", "timesheet", "registry", "call", "invoices"}
    days = {r.field_path for r in at(0, "readings").where("value_date IS NOT NULL").select("field_path").distinct().collect()}
    assert {"report.period_start", "report.period_end", "call.eligible_from", "invoice.issue_date"} <= days
    negative = at(0, "readings").where("dossier_id = 'INN-2025-042' AND field_path LIKE 'timesheet%.hours' AND value_number < 0").first()
    number = at(0, "readings").where("dossier_id = 'INN-2025-041' AND field_path = 'invoice.number'").first()
    double = process.findings(spark, out).where("rule_id = 'DUPLICATE_DOCUMENT'").first()

    def row(of, target, action, value=None, reason="seen on paper", key=None, revision=None):
        return (of.dossier_id, target, key or (of.key if target == "reading" else of.fingerprint), action, value, reason, "reviewer", revision)

    wanted = [
        row(negative, "reading", "CORRECT", "8", revision=0),
        row(number, "reading", "CONFIRM"),
        row(double, "finding", "DISMISS"),
        row(negative, "reading", "CORRECT", "9", reason=" "),
        row(negative, "reading", "CORRECT"),
        row(negative, "reading", "DISMISS"),
        row(negative, "reading", "CONFIRM", key="0" * 64),
        row(negative, "reading", "CORRECT", "7", revision=3),
    ]
    told = process.review(spark, out, spark.createDataFrame(wanted, WANTED)).orderBy("seq").collect()
    assert sorted(r.outcome for r in told) == ["ACTION", "REASON", "STALE", "TAKEN", "TAKEN", "TAKEN", "UNKNOWN", "VALUE"]

    for n in (1, 2):  # the decisions hold in each later run, and nothing is extracted again
        process.process(spark, root, out)
        assert at(n, "changed").count() == 0 and at(n, "extracted").count() == 0
        now = at(n, "readings").where(f"key = '{negative.key}'").first()
        assert (now.value_number, now.status, now.original_value_text, now.revision) == (8, "CORRECTED", negative.value_text, 1)
        assert at(n, "readings").where(f"key = '{number.key}'").first().status == "CONFIRMED"
        states = {r.rule_id: r.status for r in process.findings(spark, out).where("dossier_id = 'INN-2025-042'").collect()}
        assert states["NEGATIVE_HOURS"] == "RESOLVED" and states["DUPLICATE_DOCUMENT"] == "DISMISSED"
        assert at(n, "readings").count() == at(0, "readings").count() and at(n, "chunks").count() == at(0, "chunks").count()

    # other words in one dossier, a file more in another, a touched file in a third
    texts = tmp_path / "in" / "texts.json"
    texts.write_text(texts.read_text().replace("INN-2025-041\\nConvocatoria", "INN-2025-041\\nNueva frase\\nConvocatoria"))
    (tmp_path / "in" / "files" / "INN-2025-043" / "nota.pdf").write_bytes(corpus.pdf("nota"))
    (tmp_path / "in" / "files" / "INN-2025-044" / "horas.xlsx").touch()
    process.process(spark, root, out)
    assert {r.dossier_id for r in at(3, "changed").collect()} == {"INN-2025-041", "INN-2025-043"}
    assert {r.dossier_id for r in at(3, "extracted").select("dossier_id").distinct().collect()} == {"INN-2025-041", "INN-2025-043"}
    chunks = [r.text for r in at(3, "chunks").collect()]
    assert sum("Nueva frase" in c for c in chunks) == 1 and len({r.document_id for r in at(3, "documents").collect()}) == at(0, "documents").count() + 1
    assert not any("INN-2025-041\nConvocatoria" in c for c in chunks)  # the old text's chunk is gone
    assert at(3, "readings").where(f"key = '{negative.key}'").first().status == "CORRECTED"
    # a dossier's file that is gone takes its readings along
    (tmp_path / "in" / "files" / "INN-2025-045" / "factura-2.png").unlink()
    process.process(spark, root, out)
    assert at(4, "documents").where("dossier_id = 'INN-2025-045' AND name = 'factura-2.png'").count() == 0
    assert at(4, "readings").where("dossier_id = 'INN-2025-045' AND field_path = 'invoice.number'").count() == 1
