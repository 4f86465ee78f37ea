"""What is to be redacted never stays, and what was redacted comes back."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from umbra.operators import companies, detect, redact, report
from umbra.operators.detect import Settings
from umbra.sources import formats, vault
from umbra.streaming.detect import number_stream

MAIL = Settings(entities=frozenset({"EMAIL_ADDRESS"}))


def test_null_ids_null_places_and_values_the_vault_lacks(spark, units):
    df = units((None, "", 0, "mail a@b.no now"), (1, "", None, "mail c@d.no now"), (2, "", 0, "mail e@f.no now"))
    found = detect.detect(df, MAIL)
    assert {r["text"] for r in redact.redact(df, found).collect()} == {"mail [REDACTED] now"}
    some = redact.assign_tokens(found, df).where("value <> 'e@f.no'")
    got = {r["doc_id"]: r["text"] for r in redact.redact(df, found, some).collect()}
    assert got == {None: "mail [EMAIL_ADDRESS_1] now", 1: "mail [EMAIL_ADDRESS_1] now", 2: "mail [REDACTED] now"}
    assert {r["doc_id"]: r["redacted_count"] for r in report.audit(found).collect()} == {None: 1, 1: 1, 2: 1}
    back = redact.restore(redact.redact(df, found, some), some).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {None: "mail a@b.no now", 1: "mail c@d.no now", 2: "mail [REDACTED] now"}
    off = found.select("doc_id", "entity", "value").where("doc_id is null").withColumn("redact", F.lit(False))
    assert report.toggled(found, off).where("not redact").count() == 1


def test_huge_and_repeated_tokens(spark, units):
    df = units("[EMAIL_ADDRESS_99999999999999999999] [EMAIL_ADDRESS_007] x@y.no", "[EMAIL_ADDRESS_0000000000000000000000000000003] x@y.no")
    assert {(r["doc_id"], r["seed"]) for r in redact.counter_seeds(df).collect()} == {(0, 7), (1, 3)}
    found = detect.detect(df, MAIL)
    assert {r["token"] for r in redact.assign_tokens(found, df).collect()} == {"[EMAIL_ADDRESS_8]", "[EMAIL_ADDRESS_4]"}
    twice = spark.createDataFrame([(0, "[A_1]", "b"), (0, "[A_1]", "a")], "doc_id long, token string, value string")
    assert redact.restore(units("see [A_1]"), twice).first()["text"] == "see a"


def test_roots_in_text_that_grows_in_lower_case(spark, units):
    df = units("\u0130\u0130\u0130 Nordvik AS og nordvik", "no company")
    roots = spark.createDataFrame([(0, "Nordvik"), (1, "a\\Eb")], "doc_id long, root string")
    assert sorted((r["st"], r["value"]) for r in companies.root_hits(df, roots).collect()) == [(4, "Nordvik"), (18, "nordvik")]


def test_values_keep_characters_that_searches_replace(spark, units):
    df = units("say \uffffword\uffff now", "plain word")
    found = detect.detect(df, Settings(entities=frozenset({"CUSTOM_TERM"}), custom_terms=("say \ufffdword",)))
    assert [r["value"] for r in found.collect()] == ["say \uffffword"]


def test_streams_count_past_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "", 0, "[EMAIL_ADDRESS_5] and a@b.no"), (2, "", 0, "c@d.no c@d.no"), (1, "", 1, "e@f.no a@b.no [EMAIL_ADDRESS_99999999999999999999]")], "doc_id long, ctx string, ord int, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = number_stream(spark.readStream.schema("doc_id long, ctx string, ord int, text string").parquet(str(tmp_path / "in")), MAIL)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r["doc_id"], r["value"], r["token"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "a@b.no", "[EMAIL_ADDRESS_6]"), (1, "e@f.no", "[EMAIL_ADDRESS_7]"), (2, "c@d.no", "[EMAIL_ADDRESS_1]")}


def test_recognizers_get_batches(spark, units):
    def names(texts):
        assert all(isinstance(t, str) for t in texts)
        return [[("PERSON", t.index("Kari"), t.index("Kari") + 4, 0.9)] if "Kari" in t else [] for t in texts]

    found = detect.recognized(units("hei Kari", None, "ingen"), names).collect()
    assert [(r["doc_id"], r["entity"], r["value"], r["st"], r["rule"]) for r in found] == [(0, "PERSON", "Kari", 4, "outside")]


@pytest.mark.parametrize("depth", [150, 201, 400])
def test_deep_json_keeps_no_secret(depth):
    data = ('{"a": [' * depth + '"a@b.no"' + "]}" * depth).encode()
    found = formats.json_units(data)
    assert [t for _, t, _ in found if "a@b.no" in t]
    (ctx, text, _), *_ = found
    at = text.index("a@b.no")
    out = formats.json_replaced(data, {ctx: [(at, at + 6, "[X_1]")]})
    assert b"a@b.no" not in out
    assert b"[X_1]" in out
    json.loads(out)


def pdf_of(*objects):
    return b"%PDF-1.5\n" + b"\n".join(objects)


def packed(number, *inner):
    places, body = [], b""
    for n, x in inner:
        places.append(b"%d %d" % (n, len(body)))
        body += x + b" "
    head = b" ".join(places) + b" "
    data = zlib.compress(head + body)
    return b"%d 0 obj <</Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream endobj" % (number, len(inner), len(head), len(data), data)


def page_content(number, text):
    data = zlib.compress(b"BT (%s) Tj ET" % text)
    return b"%d 0 obj <</Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream endobj" % (number, len(data), data)


def test_pdf_pages_in_object_streams_and_in_order(monkeypatch):
    pages = packed(9, (1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [5 0 R 3 0 R]>>"), (3, b"<</Type /Page /Contents 7 0 R>>"), (5, b"<</Type /Page /Contents [8 0 R]>>"))
    data = pdf_of(pages, page_content(7, b"second a@x.no"), page_content(8, b"first"))
    assert [(c, t) for c, t, _ in formats.pdf_units(data)] == [("page 1", "first"), ("page 2", "second a@x.no")]
    with pytest.raises(ValueError, match="no text"):
        formats.pdf_units(pdf_of(b"1 0 obj <</Type /Page>> endobj"))
    with pytest.raises(ValueError, match="encrypted"):
        formats.pdf_units(data + b"trailer <</Encrypt 4 0 R>>")
    with pytest.raises(ValueError, match="over 10 bytes"):
        formats._pdf_stream(b"<</Filter /FlateDecode>> stream\n" + zlib.compress(b"x" * 100) + b"\nendstream", 10)


def test_organisation_numbers(spark, units):
    """923609016 and 974760673 are right by their check digit; others of the nine digits aren't."""
    df = units("org 923609016, 974 760 673, 923609017 and 123456785")
    found = detect.detect(df, Settings(entities=frozenset({"NORWEGIAN_ORG_NUMBER"})))
    assert sorted(r["value"] for r in found.collect()) == ["923609016", "974 760 673"]


def test_vault_files_are_private_from_the_start(spark, tmp_path):
    path = tmp_path / "v"
    path.write_text("old")
    path.chmod(0o644)
    vault.save_vault(vault.vault_table(spark, 1, {"[A_1]": "x"}), 1, str(path), "pw", iterations=10)
    assert path.stat().st_mode & 0o777 == 0o600
    assert vault.load_vault(spark, str(path), "pw") == {"[A_1]": "x"}
