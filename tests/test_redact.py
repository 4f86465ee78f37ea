import datetime
import json

import pytest
from pyspark.sql import functions as F

from umbra.operators import companies, redact, report, suppress
from umbra.operators.detect import Settings, detect, from_outside

CONTACT = Settings(entities=frozenset({"EMAIL_ADDRESS", "PRIVATE_IP"}))


def test_tokens_are_numbered_from_the_last_span_and_past_those_in_the_text(spark, units):
    u = units("See [EMAIL_ADDRESS_3]: a@x.no b@x.no a@x.no 10.0.0.1")
    vault = redact.assign_tokens(detect(u, CONTACT), u)
    assert {(r["value"], r["token"]) for r in vault.collect()} == {("a@x.no", "[EMAIL_ADDRESS_4]"), ("b@x.no", "[EMAIL_ADDRESS_5]"), ("10.0.0.1", "[PRIVATE_IP_1]")}
    vault = redact.assign_tokens(detect(u, CONTACT), u, in_order=True)
    assert ("a@x.no", "[EMAIL_ADDRESS_4]") in {(r["value"], r["token"]) for r in vault.collect()}


def test_units_are_met_in_order(spark, units):
    u = units((1, "p1", 0, "a@x.no b@x.no"), (1, "p2", 1, "c@x.no a@x.no"), (2, "p1", 0, "c@x.no"))
    vault = {(r["doc_id"], r["value"]): r["token"] for r in redact.assign_tokens(detect(u, CONTACT), u).collect()}
    assert vault == {(1, "b@x.no"): "[EMAIL_ADDRESS_1]", (1, "a@x.no"): "[EMAIL_ADDRESS_2]", (1, "c@x.no"): "[EMAIL_ADDRESS_3]", (2, "c@x.no"): "[EMAIL_ADDRESS_1]"}


def test_restore_undoes_redact(spark, units):
    texts = ["Å a@x.no 😀 10.0.0.1, a@x.no", "", "none", None, "[PERSON_1] b@x.no"]
    u = units(*texts)
    found = detect(u, CONTACT)
    vault = redact.assign_tokens(found, u)
    hidden = redact.redact(u, found, vault)
    assert not any("x.no" in (r["text"] or "") for r in hidden.collect())
    assert {r["doc_id"]: r["text"] for r in redact.restore(hidden, vault).collect()} == dict(enumerate(texts))


def test_blanks_unticked_spans_and_unknown_tokens(spark, units):
    u = units("a@x.no and 10.0.0.1")
    found = detect(u, CONTACT)
    assert redact.redact(u, found).first()["text"] == "[REDACTED] and [REDACTED]"
    off = report.toggled(found, spark.createDataFrame([(0, "PRIVATE_IP", "10.0.0.1", False)], "doc_id long, entity string, value string, redact boolean"))
    assert redact.redact(u, off).first()["text"] == "[REDACTED] and 10.0.0.1"
    assert redact.redact(u, report.set_all(found, False)).first()["text"] == "a@x.no and 10.0.0.1"
    vault = spark.createDataFrame([(0, "[M365_TENANT_URL_1]", "https://x")], "doc_id long, token string, value string")
    assert redact.restore(units("[M365_TENANT_URL_1] [PERSON_9]"), vault).first()["text"] == "https://x [PERSON_9]"


def test_long_tokens_warn(spark, units):
    u = units("mail a@x.no")
    found = detect(u, CONTACT)
    assert redact.layout_warnings(found, redact.assign_tokens(found, u)).count() == 1


def test_reports(spark, units):
    found = detect(units("a@x.no a@x.no 10.0.0.1", "none"), CONTACT)
    groups = {(r["entity"], r["value"]): r for r in report.grouped(found).collect()}
    assert groups["EMAIL_ADDRESS", "a@x.no"]["n"] == 2
    assert groups["PRIVATE_IP", "10.0.0.1"]["severity"] == "medium"
    assert report.sorted_report(report.grouped(found), "n", descending=True).first()["n"] == 2
    with pytest.raises(ValueError, match="isn't sorted"):
        report.sorted_report(report.grouped(found), "nothing")
    rows = report.sample(found, 1).collect()
    assert len(rows) == 2
    assert all(r["truncated"] for r in rows)


def test_audit(spark, units, tmp_path):
    found = detect(units("a@x.no b@x.no 10.0.0.1"), CONTACT).withColumn("redact", F.col("entity") == "EMAIL_ADDRESS")
    records = report.audit(found)
    assert records.first().asDict() == {"doc_id": 0, "redacted_count": 2, "entity_types": {"EMAIL_ADDRESS": 2}}
    for _ in range(2):
        report.append_audit(records, str(tmp_path / "audit"), source="in/", output="out/")
    lines = [json.loads(x) for f in (tmp_path / "audit").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 2
    stamp = datetime.datetime.fromisoformat(lines[0]["timestamp"])
    assert abs((datetime.datetime.now(datetime.UTC) - stamp).total_seconds()) < 300
    nothing = report.audit(found.withColumn("redact", F.lit(False))).first()
    assert (nothing["redacted_count"], nothing["entity_types"]) == (0, {})


def test_company_roots_are_found_inside_words_of_their_document(spark, units):
    u = units((0, "a", 0, "Sicra Data AS and more"), (0, "b", 1, "the SICRA DATA-filter, sicra data"), (1, "a", 0, "Sicra Data"))
    roots = companies.company_roots(detect(u, Settings(entities=frozenset({"NORWEGIAN_COMPANY"}))))
    assert [tuple(r) for r in roots.collect()] == [(0, "Sicra Data")]
    hits = {(r["ord"], r["st"], r["value"]) for r in companies.root_hits(u, roots).collect()}
    assert hits == {(0, 0, "Sicra Data"), (1, 4, "SICRA DATA"), (1, 23, "sicra data")}


def _outside(spark, units, *rows):
    u = units(*[t for t, *_ in rows])
    spans = spark.createDataFrame([(i, "", 0, e, st, en, 0.85) for i, (t, e, st, en) in enumerate(rows)], "doc_id long, ctx string, ord int, entity string, st int, en int, score double")
    return from_outside(spans, u)


def test_spans_of_persons_are_cut_to_their_names(spark, units):
    names = spark.createDataFrame([("Tore", True, False), ("Raimo", True, False), ("Bo", True, False)], "name string, is_first boolean, is_surname boolean")
    common = spark.createDataFrame([("ikke",), ("og",)], "word string")
    text = "jo Ikke Tore Vik og Raimo noe Bo"
    got = suppress.trim_to_names(_outside(spark, units, (text, "PERSON", 0, len(text)), ("Ikke Og", "NRP", 0, 7), ("Oslo", "LOCATION", 0, 4)), names, common)
    assert {(r["doc_id"], r["value"], r["st"]) for r in got.collect()} == {(0, "Tore Vik", 8), (0, "Raimo", 20), (2, "Oslo", 0)}


def test_places_without_a_proper_word_are_dropped(spark, units):
    common = spark.createDataFrame([("når",), ("oslo",)], "word string")
    got = suppress.drop_common_text(_outside(spark, units, ("Når vi", "LOCATION", 0, 6), ("Bergen by", "LOCATION", 0, 9), ("abc", "PERSON", 0, 3), ("Os", "LOCATION", 0, 2)), common)
    assert {r["value"] for r in got.collect()} == {"Bergen by", "abc"}
