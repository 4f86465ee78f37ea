"""What is looked for in one search, and resolved for many rows at once, is what each detector and a plain loop find."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from umbra.functions import patterns
from umbra.functions.patterns import DETECTORS
from umbra.functions.spans import with_matches, with_spans
from umbra.functions.standing import standing

NUMBERS = tuple(d for d in DETECTORS if d.lengths)


def rows_of(df):
    return sorted((r["doc_id"], r["entity"], r["value"], r["st"], r["en"], r["rule"]) for r in df.select("doc_id", F.explode("_spans").alias("s")).select("doc_id", "s.*").collect())


def test_numbers_of_one_search_are_those_of_each_pattern(units):
    rng = random.Random(3)
    pieces = ["29029900157", "01010101181", "41010112345", "290299 001 57", "290299\x0b001 57", "1234.56.78901", "91234567", "AB1234567", "EL 12345", "æØ12345", "el\t12345", "12345678", "12345", "AB", "١٢٣٤٥٦٧٨",
              "0101١٢٣٤٥٦٧", "ſK1234567", "́", "x", "_", "\x01", "￿", "\U0001f600"]
    texts = ["".join(rng.choice([*pieces, " ", " ", ".", ""]) for _ in range(rng.randrange(0, 14))) for _ in range(300)] + [None, "", "29029900157 " * 300]
    df = units(*texts)
    got = rows_of(with_spans(df, "text", NUMBERS))
    own = with_matches(df, "text", {f"p{i}": d.pattern for i, d in enumerate(NUMBERS)}).collect()
    expected = sorted((r["doc_id"], d.entity, m["value"], m["st"], m["en"], d.rule) for r in own for i, d in enumerate(NUMBERS) for m in r[f"p{i}"] or [])
    assert {d.rule + d.entity for d in NUMBERS} == {x[5] + x[1] for x in expected}
    assert got == expected


def test_ids_of_other_digits_are_no_error(units):
    """Digits of other scripts match, and no check digit of theirs is right; they failed as a number before."""
    plain = tuple(d for d in NUMBERS if d.check)
    df = units("id 0101١٢٣٤٥٦٧ and 29029900157")
    for some in (plain[:1], plain):
        spans = with_spans(df, "text", some).select(F.explode("_spans").alias("s")).select("s.*").collect()
        assert sorted(r["score"] for r in spans) == [0.35, 0.85]


@pytest.mark.parametrize("most", [5, 60])
@pytest.mark.parametrize("context", [None, "_ctx"])
def test_many_rows_stand_as_one_does(most, context):
    rng = random.Random(most)

    def span():
        st = rng.randrange(0, 40)
        return {"entity": rng.choice(["b", "a", "æ", "z"]), "value": "v", "st": st, "en": st + rng.choice([0, 1, 3, 9]), "score": rng.choice([0.5, 0.7, 0.9]), "rule": rng.choice("xy"), "_ctx": rng.choice(["1", "2"])}

    lists = [[span() for _ in range(rng.randrange(0, most))] for _ in range(200)] + [[]]

    def loop(spans):
        kept = []
        for s in sorted(spans, key=lambda s: (-s["score"], s["st"], s["entity"].encode(), s["en"], s["rule"])):
            if not any(k["st"] < s["en"] and k["en"] > s["st"] and (context is None or k["_ctx"] == s["_ctx"]) for k in kept):
                kept.append(s)
        return kept

    kind = pa.list_(pa.struct([("entity", pa.string()), ("value", pa.string()), ("st", pa.int32()), ("en", pa.int32()), ("score", pa.float64()), ("rule", pa.string()), ("_ctx", pa.string())]))
    got = standing(pa.array(lists, type=kind), context)
    assert got.type == kind

    def places(spans):
        return sorted((s["st"], s["en"], s["entity"], s["rule"], s["score"], s["_ctx"] if context else "") for s in spans)

    for spans, out in zip(lists, got.to_pylist(), strict=True):
        assert places(out) == places(loop(spans))
        assert [s["st"] for s in out] == sorted(s["st"] for s in out)
    assert len(standing(pa.array([], type=kind), context)) == 0
    assert standing(pa.array(lists, type=kind).slice(3, 5), context).to_pylist() == got.slice(3, 5).to_pylist()


def test_stems_are_in_every_match(units):
    """Texts without a stem aren't searched; letters that only patterns take for ASCII ones don't hide a term."""
    assert patterns.stems(["diagnos[ea]r", r"LHBT\+?", r"same.sex\s+(?:partner|marriage)", r"genetisk(?:\s+test(?:ing)?)?"]) == ("diagnos", "genetisk", "lhbt", "same")
    terms = [d for d in DETECTORS if d.needs and d.rule == "term"]
    assert len(terms) == 8
    df = units("D\u0130AGNOSE", "d\u0131agnose", "diagno\u017fe", "genetic \u212Ahm", "PASIENTJOURNAL", "ny MOSK\u00c9", "LHBT", "none")
    got = rows_of(with_spans(df, "text", tuple(terms)))
    own = with_matches(df, "text", {f"p{i}": d.pattern for i, d in enumerate(terms)}).collect()
    assert got == sorted((r["doc_id"], d.entity, m["value"], m["st"], m["en"], d.rule) for r in own for i, d in enumerate(terms) for m in r[f"p{i}"] or [])
    assert {x[0] for x in got} >= {0, 1, 2, 3, 4, 5, 6}
