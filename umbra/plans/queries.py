"""One query for each operator, over the shared tables, with the same in DuckDB's SQL where SQL can express it.

Types that hardly occur in the tables' texts are looked for in texts composed from keys; the SQL that
composes them is the same on both sides.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.patterns import DETECTORS, Detector
from umbra.functions.session import scratch_dir, spread
from umbra.functions.spans import exploded, line_number
from umbra.operators import companies, detect, overlap, redact, report, suppress
from umbra.operators.detect import Settings
from umbra.plans.catalog import ENTITIES, HIGH, MEDIUM, catalog, group, severity, status
from umbra.sources import files, formats
from umbra.streaming.detect import detect_stream

Query = Callable[[SparkSession, str], DataFrame]
FOUND = ("doc_id", "entity", "value", "st", "en", "score", "rule")


def _pad(x: str, n: int) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


# Texts from keys: columns doc_id and text, in SQL that Spark and DuckDB share.
IDENTIFIERS = f"""select o_orderkey as doc_id, 'Order ' || cast(o_orderkey as string) || ' by ' || {_pad("1 + o_orderkey % 28", 2)} || {_pad("1 + o_orderkey % 12", 2)} || {_pad("o_orderkey", 7)}
 || ' or ' || {_pad("41 + o_orderkey % 30", 2)} || {_pad("1 + o_orderkey % 12", 2)} || {_pad("o_orderkey * 3", 7)} || ', account ' || {_pad("o_orderkey % 10000", 4)} || '.' || {_pad("o_orderkey % 100", 2)} || '.'
 || {_pad("o_orderkey % 100000", 5)} || '; call +47 ' || {_pad("o_orderkey % 10000", 4)} || ' ' || {_pad("o_orderkey * 7 % 10000", 4)} || ' or 9' || {_pad("o_orderkey % 10000000", 7)}
 || ', passport AB' || {_pad("o_orderkey % 10000000", 7)} || ', car EL ' || {_pad("o_orderkey % 100000", 5)} || ', lives at 0' || {_pad("o_orderkey % 1000", 3)} || ' Oslo, Storgata ' || cast(1 + o_orderkey % 90 as string) as text from orders"""
SPECIAL = """select p_partkey as doc_id, 'The file of ' || p_name || case p_partkey % 9 when 0 then ' mentions a diagnosis and the hospital' when 1 then ' holds a fingerprint and an iris scan'
 when 2 then ' orders genetic testing of a chromosome' when 3 then ' records political opinion, Venstre' when 4 then ' names a church member and a mosque' when 5 then ' says bisexual'
 when 6 then ' gives ethnic origin and foreign origin' when 7 then ' pays union dues to a labor union, Fagforbundet' else ' is empty' end as text from part"""
CREDENTIALS = f"""select s_suppkey as doc_id, 'key AKIA' || {_pad("s_suppkey", 8)} || 'ABCDEFGH, id 12345678-1234-1234-1234-' || {_pad("s_suppkey", 12)} || ' {{"tenantId": "0a345678-1234-1234-1234-' || {_pad("s_suppkey", 12)} || '"}} '
 || 'Authorization: Bearer token' || {_pad("s_suppkey", 9)} || 'abc at https://firm' || cast(s_suppkey as string) || '.sharepoint.com/sites/a and https://teams.microsoft.com/l/channel/' || cast(s_suppkey as string)
 || ' or https://org' || cast(s_suppkey as string) || '.crm.dynamics.com/api, jwt eyJhbGciOiJI.eyJzdWIi' || cast(s_suppkey as string) || '.SflKxwRJ, host 10.' || cast(s_suppkey % 256 as string) || '.1.'
 || cast(s_suppkey * 7 % 256 as string) || ', mail a.' || cast(s_suppkey as string) || '@example.org, print ' || {_pad("s_suppkey", 40)} || ' card 4111 1111 1111 ' || {_pad("s_suppkey % 10000", 4)} as text from supplier"""
CELLS = """select p_partkey as doc_id, case p_partkey % 6 when 0 then '=IMAGE("https://h.example/' || p_name || '")' when 1 then '=SUM(A1:A' || cast(p_size as string) || ')' when 2 then '=webservice("x")'
 when 3 then '=HYPERLINK("http://h.example","' || p_name || '")' when 4 then p_name || ' https://h.example' else '=LEN(A1)' end as text from part"""
CLOUD = f"""select s_suppkey as doc_id, 'arn:aws:iam::' || {_pad("s_suppkey", 12)} || ':role/r' || cast(s_suppkey as string) || ' of 1234-5678-' || {_pad("s_suppkey % 10000", 4)} || ', account_id = ' || {_pad("s_suppkey * 3", 12)}
 || ' and DefaultEndpointsProtocol=https;AccountName=a' || cast(s_suppkey as string) || ';AccountKey=' || {_pad("s_suppkey", 20)} || '== with abc8Q~' || {_pad("s_suppkey", 32)} || ' at /subscriptions/12345678-1234-1234-1234-' || {_pad("s_suppkey", 12)}
 || '/resourceGroups/g' || cast(s_suppkey as string) || ' of firm' || cast(s_suppkey as string) || '.onmicrosoft.com on st' || cast(s_suppkey as string) || '.blob.core.windows.net by bot-' || cast(s_suppkey as string)
 || '@proj.iam.gserviceaccount.com, AIza' || {_pad("s_suppkey", 35)} || ' password: hunter' || {_pad("s_suppkey", 6)} || ' on db' || cast(s_suppkey as string) || '.prod.internal, org 9' || {_pad("s_suppkey * 7919 % 100000000", 8)}
 || ', file C:' || chr(92) || 'data' || chr(92) || 'f' || cast(s_suppkey as string) || '.txt or /etc/app/' || cast(s_suppkey as string) as text from supplier"""
WARNED = """select c_custkey as doc_id, 'c' || cast(c_custkey % 10 as string) || '@a.no [EMAIL_ADDRESS_' || cast(c_custkey % 30 as string) || '] 10.0.0.1' as text from customer"""
COMPANIES = """select c_custkey as doc_id, 'Nordvik' || cast(c_custkey % 7 as string) || ' AS met Berg' || cast(c_custkey % 5 as string) || ' Invest ASA, then nordvik' || cast(c_custkey % 7 as string)
 || 'x spoke for Berg' || cast(c_custkey % 5 as string) || ' invest as well' as text from customer"""
JSON = """select p_partkey as doc_id, '{"name": "' || p_name || '", "size": ' || cast(p_size as string) || ', "brand": {"id": "' || p_brand || '", "tags": ["a@b.no", 7, "' || p_type || '"]}}' as text from part where p_partkey % 2 = 0
 union all select p_partkey as doc_id, 'no {json' as text from part where p_partkey % 2 = 1"""
TOKENS = """select c_custkey as doc_id, 'See [PERSON_' || cast(c_custkey % 9 as string) || '] and [M365_TENANT_URL_' || cast(c_custkey % 4 as string) || '] or [PERSON_2] [person_3] [X_] mail c' || cast(c_custkey % 50 as string)
 || '@a.no, b' || cast(c_custkey as string) || '@a.no and c' || cast(c_custkey % 50 as string) || '@a.no from 10.0.0.' || cast(c_custkey % 200 as string) as text from customer"""
PATHS = """select p_partkey as doc_id, '/data/' || p_name || case p_partkey % 8 when 0 then '.PDF' when 1 then '.docx' when 2 then '.xlsm' when 3 then '.jpeg' when 4 then '.odt' when 5 then '.JSON' when 6 then '.csv' else '.exe' end as path from part"""

PLAIN = frozenset({"EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD", "CERTIFICATE_THUMBPRINT", "URL", "AZURE_UUID", "AWS_ACCESS_KEY", "NORWEGIAN_BANK_ACCOUNT"})
NORWEGIAN = frozenset(e for e in ENTITIES if e.startswith("NORWEGIAN_")) - {"NORWEGIAN_COMPANY", "NORWEGIAN_PERSON_NAME", "NORWEGIAN_ORG_NUMBER"}
SECRET = frozenset({"AWS_ACCESS_KEY", "AZURE_UUID", "JWT_BEARER_TOKEN", "CERTIFICATE_THUMBPRINT", "M365_TENANT_URL", "PRIVATE_IP", "EMAIL_ADDRESS", "CREDIT_CARD"})
PROVIDERS = frozenset({
    "AWS_ARN", "AWS_ACCOUNT_ID", "AZURE_CONNECTION_STRING", "AZURE_CLIENT_SECRET", "AZURE_RESOURCE_ID", "AZURE_TENANT_DOMAIN", "AZURE_RESOURCE_NAME",
    "GCP_SERVICE_ACCOUNT", "GCP_API_KEY", "GENERIC_SECRET", "INTERNAL_HOSTNAME", "NORWEGIAN_ORG_NUMBER", "FILE_PATH",
})
NINTH = frozenset({"HEALTH_DATA", "BIOMETRIC_DATA", "GENETIC_DATA", "POLITICAL_OPINION", "RELIGIOUS_BELIEF", "SEXUAL_ORIENTATION", "RACIAL_ETHNIC_ORIGIN", "TRADE_UNION"})
CONTACT = frozenset({"EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD", "CERTIFICATE_THUMBPRINT"})
TERMS = ("idiot", "Licensed under", "trash")
#: A small dictionary of made-up names, so that the query needs no file.
FIRST, SURNAMES = ("Anat", "Ention", "Thand", "Erst", "Die"), ("Onan", "Ingor", "Hethe", "Erst", "Auf")
COMMON = ("the", "and", "in", "an", "berg0", "to")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def composed(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Units of a composed text; the tables it names are read as they stand in it."""
    for name in ("orders", "part", "supplier", "customer"):
        sql = re.sub(rf"\bfrom {name}\b", f"from parquet.`{sf_dir}/{name}.parquet`", sql)
    return spread(spark.sql(f"select doc_id, '' as ctx, 0 as ord, text from ({sql})"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("ctx"), F.lit(0).alias("ord"), "text"))


def raw(units: DataFrame, settings: Settings) -> DataFrame:
    """Spans before overlaps are resolved."""
    found = exploded(detect.raw_spans(units, settings), "_spans", "s", "doc_id")
    return found.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in FOUND[1:]])


# DuckDB's side. Its regular expressions know no lookaround, so patterns that use it are given in another form, which finds
# the same in these texts.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
FORMS = {
    ("EMAIL_ADDRESS", "address"): r"(?i)[a-z0-9][a-z0-9._%+-]*@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}",
    ("IP_ADDRESS", "version 4"): rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b",
    ("PRIVATE_IP", "rfc 1918"): rf"\b(?:10(?:\.{_OCTET}){{3}}|172\.(?:1[6-9]|2[0-9]|3[01])(?:\.{_OCTET}){{2}}|192\.168(?:\.{_OCTET}){{2}})\b",
    ("AZURE_UUID", "quoted value"): r'"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})"',
    ("AWS_ARN", "name"): r"arn:aws:iam::[0-9]+:role/r[0-9]+",
    ("AZURE_RESOURCE_ID", "path"): r"/subscriptions/[0-9-]+/resourceGroups/g[0-9]+",
    ("AZURE_CONNECTION_STRING", "pairs"): r"DefaultEndpointsProtocol=https;AccountName=a[0-9]+;AccountKey=[0-9]+==",
    ("AZURE_CLIENT_SECRET", "marked"): r"abc8Q~[0-9]{32}",
    ("GENERIC_SECRET", "after its name"): r"password: hunter[0-9]+",
    ("INTERNAL_HOSTNAME", "suffix"): r"db[0-9]+\.prod\.internal",
    ("FILE_PATH", "drive"): r"C:\\data\\f[0-9]+\.txt",
    ("FILE_PATH", "root"): r"/etc/app/[0-9]+",
    ("CREDIT_CARD", "grouped"): r"\b[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}\b",
}


def _form(d: Detector) -> str:
    return FORMS.get((d.entity, d.rule)) or d.pattern.replace("(?iU)", "(?i)").replace("(?U)", "")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _weighted(d: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"cast(substr({d}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights)) + ") % 11"


def _check_sql(name: str) -> str:
    d = "regexp_replace(value, '[^0-9]', '', 'g')"
    if name == "national_id":
        from umbra.functions.checks import FIRST_WEIGHTS, SECOND_WEIGHTS

        r1, r2 = _weighted(d, FIRST_WEIGHTS), _weighted(d, SECOND_WEIGHTS)
        right = [f"({r} <> 1 and cast(substr({d}, {i}, 1) as int) = (11 - {r}) % 11)" for r, i in ((r1, 10), (r2, 11))]
        return f"(length({d}) = 11 and {' and '.join(right)})"
    if name == "org_number":
        r = _weighted(d, (3, 2, 7, 6, 5, 4, 3, 2))
        return f"(length({d}) = 9 and {r} <> 1 and cast(substr({d}, 9, 1) as int) = (11 - {r}) % 11)"
    if name == "luhn":
        digit = f"cast(substr({d}, length({d}) - i, 1) as int)"
        return f"(length({d}) between 13 and 19 and list_sum(list_transform(range(0, length({d})), lambda i: case when i % 2 = 0 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)) % 10 = 0)"
    raise KeyError(name)


def spans_sql(source: str, entities: frozenset[str], more: tuple[Detector, ...] = ()) -> str:
    """doc_id, entity, value, st, en, score, rule of the detectors' spans in source(doc_id, text)."""
    parts = []
    for d in [*DETECTORS, *more]:
        if d.entity not in entities:
            continue
        inner = (d.entity, d.rule) == ("AZURE_UUID", "quoted value")  # its form takes the quotes in, which are cut off again
        p = _quoted(_form(d))
        st = "cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as int)"
        spans = f"select doc_id, m[i] as value, {st} as st, cast({st} + length(m[i]) as int) as en from (select doc_id, m, g, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(text, {p}) as m, regexp_split_to_array(text, {p}) as g from ({source}) where regexp_matches(text, {p})))"
        if inner:
            spans = f"select doc_id, substr(value, 2, length(value) - 2) as value, cast(st + 1 as int) as st, cast(en - 1 as int) as en from ({spans})"
        score = f"cast({d.score} as double)"
        where = ""
        if d.check and d.otherwise is None:
            where = f" where {_check_sql(d.check)}"
        elif d.check:
            score = f"case when {_check_sql(d.check)} then {score} else cast({d.otherwise} as double) end"
        parts.append(f"select doc_id, {_quoted(d.entity)} as entity, value, st, en, {score} as score, {_quoted(d.rule)} as rule from ({spans}){where}")
    return " union all ".join(parts)


def resolved_sql(spans: str) -> str:
    """The spans that stand, from the best score on."""
    return f"""select doc_id, s.entity as entity, s.value as value, s.st as st, s.en as en, s.score as score, s.rule as rule from (select doc_id, unnest(list_reduce(l, lambda kept, s:
 case when len(list_filter(kept, lambda k: k.st < s[1].en and k.en > s[1].st)) > 0 then kept else list_concat(kept, s) end, [])) as s from (select doc_id,
 list([{{'entity': entity, 'value': value, 'st': st, 'en': en, 'score': score, 'rule': rule}}] order by score desc, st, entity, en, rule) as l from ({spans}) group by doc_id))"""


def in_order_sql(spans: str) -> str:
    return f"""select doc_id, s.entity as entity, s.value as value, s.st as st, s.en as en, s.score as score, s.rule as rule from (select doc_id, unnest(list_reduce(l, lambda kept, s:
 case when len(kept) > 0 and kept[-1].en > s[1].st then kept else list_concat(kept, s) end, [])) as s from (select doc_id,
 list([{{'entity': entity, 'value': value, 'st': st, 'en': en, 'score': score, 'rule': rule}}] order by st, score desc, entity, en, rule) as l from ({spans}) group by doc_id))"""


def _settings(entities: frozenset[str]) -> Settings:
    return Settings(entities=entities)


def _found(df: DataFrame) -> DataFrame:
    return df.select(*FOUND)


def q_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark)


def q_detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(documents(spark, sf_dir), _settings(PLAIN))


def q_detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("").alias("ctx"), F.lit(0).alias("ord"), F.col("html").alias("text"))
    return raw(pages, _settings(CONTACT))


def q_detect_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors at once over whole documents, resolved by line; no SQL, as lookaround and Unicode boundaries have no counterpart there."""
    return detect.detect(documents(spark, sf_dir), Settings(by_line=True)).select("doc_id", "ctx", *FOUND[1:])


def q_detect_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(composed(spark, sf_dir, IDENTIFIERS), _settings(NORWEGIAN))


def q_detect_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(composed(spark, sf_dir, SPECIAL), _settings(NINTH))


def q_detect_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(composed(spark, sf_dir, CREDENTIALS), _settings(SECRET))


def q_detect_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(composed(spark, sf_dir, CLOUD), _settings(PROVIDERS))


def q_custom_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(documents(spark, sf_dir), Settings(entities=frozenset({"CUSTOM_TERM"}), custom_terms=TERMS))


def q_dangerous_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detect.dangerous_formulas(composed(spark, sf_dir, CELLS)))


def q_resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detect.detect(composed(spark, sf_dir, IDENTIFIERS), _settings(NORWEGIAN)))


def _rows(spark: SparkSession, sf_dir: str, sql: str, entities: frozenset[str]) -> DataFrame:
    return raw(composed(spark, sf_dir, sql), _settings(entities)).withColumn("ctx", F.lit("")).withColumn("ord", F.lit(0)).withColumn("redact", F.lit(True))


def q_resolve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(overlap.resolve(_rows(spark, sf_dir, IDENTIFIERS, NORWEGIAN)))


def q_resolve_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(overlap.resolve_in_order(_rows(spark, sf_dir, IDENTIFIERS, NORWEGIAN)))


def q_distinct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, CREDENTIALS, SECRET)
    return _found(overlap.distinct_spans(rows.unionByName(rows))).drop("rule")


def q_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = documents(spark, sf_dir)
    found = exploded(detect.raw_spans(units, _settings(CONTACT)), "_spans", "s", "doc_id", "text")
    return found.select("doc_id", "s.st", "s.entity", line_number(F.col("text"), F.col("s.st")).alias("line"))


def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of identifiers raised where the word for them stands before them."""
    units = composed(spark, sf_dir, IDENTIFIERS)
    words = spark.createDataFrame([("NORWEGIAN_BANK_ACCOUNT", "account"), ("NORWEGIAN_PASSPORT", "passport"), ("NORWEGIAN_PHONE", "letter")], "entity string, word string")
    return _found(detect.raised_by_context(detect.detect(units, _settings(NORWEGIAN)), units, words, 0.25, 10))


def q_company_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.company_roots(detect.detect(composed(spark, sf_dir, COMPANIES), _settings(frozenset({"NORWEGIAN_COMPANY"}))))


def q_root_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = composed(spark, sf_dir, COMPANIES)
    return _found(companies.root_hits(units, q_company_roots(spark, sf_dir))).drop("rule")


def q_drop_common_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = composed(spark, sf_dir, COMPANIES)
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    return _found(suppress.drop_common_text(companies.root_hits(units, q_company_roots(spark, sf_dir)), common)).drop("rule")


def _names(spark: SparkSession) -> DataFrame:
    rows = [(n, n in FIRST, n in SURNAMES) for n in sorted({*FIRST, *SURNAMES})]
    return spark.createDataFrame(rows, "name string, is_first boolean, is_surname boolean")


def q_person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detect.detect_names(documents(spark, sf_dir), _names(spark)))


def q_trim_to_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each document, 60 characters of a line at a time, as if a model had called them a person."""
    pieces = Settings(entities=frozenset({"PERSON"}), extra=(Detector("PERSON", "piece", r"[^\n]{1,60}", 0.85),))
    spans = raw(documents(spark, sf_dir), pieces).withColumns({"ctx": F.lit(""), "ord": F.lit(0), "redact": F.lit(True)})
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    return _found(suppress.trim_to_names(spans, _names(spark), common))


def q_counter_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.counter_seeds(composed(spark, sf_dir, TOKENS))


def _tokens(spark: SparkSession, sf_dir: str, sql: str = TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    units = composed(spark, sf_dir, sql)
    found = detect.detect(units, _settings(frozenset({"EMAIL_ADDRESS", "PRIVATE_IP"})))
    return units, found, redact.assign_tokens(found, units)


def q_assign_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir)[2]


def q_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact(*_tokens(spark, sf_dir)).select("doc_id", "text")


def q_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, found, vault = _tokens(spark, sf_dir)
    return redact.restore(redact.redact(units, found, vault), vault).select("doc_id", "text")


def q_redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with tokens in place of contact data."""
    units = documents(spark, sf_dir)
    found = detect.detect(units, _settings(CONTACT))
    return redact.redact(units, found, redact.assign_tokens(found, units)).select("doc_id", "text")


def q_layout_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, vault = _tokens(spark, sf_dir, WARNED)
    return redact.layout_warnings(found, vault)


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(documents(spark, sf_dir), _settings(CONTACT))


def q_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(documents(spark, sf_dir), Settings(entities=CONTACT, by_line=True))
    return report.grouped(found).withColumn("places", F.array_join("places", "|"))


def q_sorted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sorted_report(report.grouped(_contacts(spark, sf_dir)).drop("places"), "n", descending=True)


def q_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _contacts(spark, sf_dir)
    off = found.where("entity = 'IP_ADDRESS'").select("doc_id", "entity", "value").distinct().withColumn("redact", F.lit(False))
    return report.toggled(found, off).select(*FOUND, "redact")


def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sample(detect.detect(composed(spark, sf_dir, IDENTIFIERS), _settings(NORWEGIAN)), 1).select(*FOUND, "truncated")


def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = report.audit(_contacts(spark, sf_dir))
    return records.select("doc_id", "redacted_count", F.explode("entity_types").alias("entity", "n"))


def q_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and documents by type and severity."""
    found = _contacts(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    return found.withColumn("severity", report.severity(F.col("entity")))


def q_json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.json_units(composed(spark, sf_dir, JSON), "doc_id", "text").select("doc_id", "ctx", "text")


def q_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.sql(PATHS.replace("from part", f"from parquet.`{sf_dir}/part.parquet`"))
    out, vault = files.sanitized_name(F.col("path"))
    return paths.select("doc_id", files.format_column(F.col("path")).alias("format"), out.alias("output"), vault.alias("vault"))


def q_stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a batch, through a stream that ends when it has read what there is."""
    source = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parquet*")
    units = stream.select("doc_id", F.lit("").alias("ctx"), F.lit(0).alias("ord"), "text")
    name = "found_" + next(tempfile._get_candidate_names())
    found = detect_stream(units, _settings(CONTACT)).select(*FOUND)
    path = f"{scratch_dir(spark)}/{name}"
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(found.schema).parquet(path)


def queries() -> dict[str, Query]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}


def _formats_sql() -> str:
    low = "lower(regexp_extract(path, '(\\.[^./]+)$', 1))"
    return "case " + " ".join(f"when {low} in ({', '.join(map(_quoted, s))}) then {_quoted(k)}" for k, s in formats.ROUTES.items()) + " end"


def _severity_sql() -> str:
    return f"case when entity in ({', '.join(map(_quoted, sorted(HIGH)))}) then 'high' when entity in ({', '.join(map(_quoted, sorted(MEDIUM)))}) then 'medium' else 'low' end"


def oracle_sql() -> dict[str, str]:
    docs = "select doc_id, text from documents"
    company = Detector("NORWEGIAN_COMPANY", "legal form", r"(?:Nordvik[0-9]+ AS|Berg[0-9]+ Invest ASA)", 0.6)
    contacts = resolved_sql(spans_sql(docs, CONTACT))
    roots = f"select distinct doc_id, trim(regexp_replace(value, '\\s+(?:ASA|AS)$', '')) as root from ({spans_sql(COMPANIES, frozenset({'X'}), (Detector('X', 'x', company.pattern, 0.6),))})"
    hits = f"""select doc_id, 'NORWEGIAN_COMPANY' as entity, substr(text, st + 1, length(root)) as value, st, cast(st + length(root) as int) as en, cast(0.7 as double) as score from (select doc_id, text, root,
 unnest(list_filter(range(0, length(text)), lambda i: lower(substr(text, i + 1, length(root))) = lower(root))) as st from ({COMPANIES}) join ({roots}) using (doc_id))"""
    hits = f"select doc_id, entity, value, cast(st as int) as st, en, score from ({hits})"
    common = ", ".join(map(_quoted, COMMON))
    proper = f"len(list_filter(regexp_extract_all(value, {_quoted(suppress.WORD)}), lambda w: length(w) >= 3 and w[1] <> lower(w[1]) and lower(w) not in ({common}))) > 0"
    warned = resolved_sql(spans_sql(WARNED, frozenset({"EMAIL_ADDRESS", "PRIVATE_IP"})))
    warned_tokens = f"select doc_id, value, entity, '[' || entity || '_' || cast(1 + case when entity = 'EMAIL_ADDRESS' then doc_id % 30 else 0 end as string) || ']' as token from ({warned})"
    seeds = f"select doc_id, regexp_extract(t, '\\[(.*)_([0-9]+)\\]', 1) as entity, max(cast(regexp_extract(t, '\\[(.*)_([0-9]+)\\]', 2) as bigint)) as seed from (select doc_id, unnest(regexp_extract_all(text, '\\[[A-Z][A-Z0-9_]*_[0-9]+\\]')) as t from ({TOKENS})) group by all"
    marked = resolved_sql(spans_sql(TOKENS, frozenset({"EMAIL_ADDRESS", "PRIVATE_IP"})))
    tokens = f"""select doc_id, value, entity, '[' || entity || '_' || cast(row_number() over (partition by doc_id, entity order by met, value) + coalesce(seed, 0) as string) || ']' as token
 from (select doc_id, value, first(entity order by -st, entity) as entity, min(-st) as met from ({marked}) group by doc_id, value) left join ({seeds}) using (doc_id, entity)"""

    def spliced(units: str, spans: str) -> str:
        folded = "list_reduce(l, lambda a, s: {'pos': s.en, 'out': a.out || substr(text, a.pos + 1, s.st - a.pos) || s.out}, {'pos': 0, 'out': ''})"
        return f"""select doc_id, case when l is null then text else r.out || substr(text, r.pos + 1) end as text from (select doc_id, text, l, {folded.replace("s.en", "cast(s.pos % 1000000000 as bigint)").replace("s.st", "cast(s.pos // 1000000000 as bigint)").replace("'pos': 0", "'pos': cast(0 as bigint)")} as r
 from ({units}) left join (select doc_id, list({{'pos': cast(st as bigint) * 1000000000 + en, 'out': token}} order by st) as l from ({spans}) group by doc_id) using (doc_id))"""

    numbered = f"select doc_id, value, entity, '[' || entity || '_' || cast(row_number() over (partition by doc_id, entity order by met, value) as string) || ']' as token from (select doc_id, value, first(entity order by -st, entity) as entity, min(-st) as met from ({contacts}) group by doc_id, value)"
    groups = f"select doc_id, entity, value, count(*) as n, max(score) as score, true as redact, {_severity_sql()} as severity from ({contacts}) group by doc_id, entity, value"
    identified = spans_sql(IDENTIFIERS, NORWEGIAN)
    lines = "length(substr(text, 1, st)) - length(replace(substr(text, 1, st), chr(10), '')) + 1"
    return {
        "catalog": "select * from (values " + ", ".join(f"({i}, {_quoted(e)}, {_quoted(group(e))}, {_quoted(severity(e))}, {_quoted(status(e))})" for i, e in enumerate(ENTITIES)) + ") t(place, entity, \"group\", severity, status)",
        "detect_documents": spans_sql(docs, PLAIN),
        "detect_pages": spans_sql("select page_id as doc_id, html as text from pages", CONTACT),
        "detect_identifiers": identified,
        "detect_special": spans_sql(SPECIAL, NINTH),
        "detect_credentials": spans_sql(CREDENTIALS, SECRET),
        "detect_providers": spans_sql(CLOUD, PROVIDERS),
        "custom_terms": spans_sql(docs, frozenset({"CUSTOM_TERM"}), (Detector("CUSTOM_TERM", "term", r"(?i)\b(?:" + "|".join(TERMS) + r")\b", 0.99),)),
        "dangerous_formulas": f"select doc_id, 'DANGEROUS_FORMULA' as entity, text as value, 0 as st, cast(length(text) as int) as en, cast(1.0 as double) as score, 'formula' as rule from ({CELLS}) where text like '=%' and (regexp_matches(upper(text), '^=(IMAGE|WEBSERVICE|FILTERXML|IMPORTDATA)\\(') or regexp_matches(text, '(?i)=.*https?://'))",
        "resolve_overlaps": resolved_sql(identified),
        "resolve_rows": resolved_sql(identified),
        "resolve_in_order": in_order_sql(identified),
        "distinct_spans": f"select distinct doc_id, entity, value, st, en, max(score) over (partition by doc_id, entity, st, en) as score from ({spans_sql(CREDENTIALS, SECRET)})",
        "line_numbers": f"select doc_id, st, entity, cast({lines} as int) as line from ({spans_sql(docs, CONTACT)}) join documents using (doc_id)",
        "context": f"""select doc_id, entity, value, st, en, rule, case when (entity = 'NORWEGIAN_BANK_ACCOUNT' and contains(near, 'account')) or (entity = 'NORWEGIAN_PASSPORT' and contains(near, 'passport'))
 then least(score + 0.25, 1.0) else score end as score from (select *, lower(substr(text, greatest(st - 10, 0) + 1, en - st + least(st, 10) + 10)) as near from ({resolved_sql(identified)}) join ({IDENTIFIERS}) using (doc_id))""",
        "company_roots": roots,
        "root_hits": hits,
        "drop_common_text": f"select * from ({hits}) where {proper}",
        "counter_seeds": seeds,
        "assign_tokens": tokens,
        "redact": spliced(TOKENS, f"select m.doc_id, m.st, m.en, t.token from ({marked}) m join ({tokens}) t on m.doc_id = t.doc_id and m.value = t.value"),
        "restore": TOKENS,
        "redact_documents": spliced(docs, f"select m.doc_id, m.st, m.en, t.token from ({contacts}) m join ({numbered}) t on m.doc_id = t.doc_id and m.value = t.value"),
        "layout_warnings": f"select m.doc_id, '' as ctx, 'Token longer than original in '''' — table layout may shift.' as warning from ({warned}) m join ({warned_tokens}) t on m.doc_id = t.doc_id and m.value = t.value where length(token) - length(m.value) > 10",
        "group_report": f"select g.*, p.places from ({groups}) g join (select doc_id, entity, value, array_to_string(list_slice(list_sort(list(distinct 'line ' || cast({lines} as string))), 1, 20), '|') as places from ({contacts}) join documents using (doc_id) group by doc_id, entity, value) p using (doc_id, entity, value)",
        "sorted_report": groups,
        "toggle": f"select *, entity <> 'IP_ADDRESS' as redact from ({contacts})",
        "sample": f"select doc_id, entity, value, st, en, score, rule, truncated from (select *, row_number() over (partition by doc_id, entity order by st, en, value) as i, max(c) over (partition by doc_id) > 1 as truncated from (select *, count(*) over (partition by doc_id, entity) as c from ({resolved_sql(identified)}))) where i = 1",
        "audit": f"select doc_id, cast(sum(n) over (partition by doc_id) as bigint) as redacted_count, entity, n from (select doc_id, entity, count(*) as n from ({contacts}) group by doc_id, entity)",
        "entity_counts": f"select entity, count(*) as n, count(distinct doc_id) as docs, {_severity_sql()} as severity from ({contacts}) group by entity",
        "json_leaves": f"""select doc_id, ctx, text from (select p_partkey as doc_id, unnest(['name', 'brand.id', 'brand.tags[0]', 'brand.tags[2]']) as ctx, unnest([p_name, p_brand, 'a@b.no', p_type]) as text from part where p_partkey % 2 = 0)
 union all select p_partkey, '', 'no {{json' from part where p_partkey % 2 = 1""",
        "routing": f"select doc_id, {_formats_sql()} as format, regexp_replace(path, '\\.[^./]*$', '') || '_sanitized' || regexp_extract(path, '(\\.[^./]*)$', 1) as output, regexp_replace(path, '\\.[^./]*$', '') || '_sanitized.vault' as vault from ({PATHS})",
        "stream_detect": contacts,
    }
