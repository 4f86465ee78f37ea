"""The entity types: group, severity, and where their detector comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The entity types by group, in their order.
GENERAL = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "URL", "CREDIT_CARD", "IBAN_CODE", "LOCATION", "NRP")
CLOUD = (
    "AWS_ACCESS_KEY", "AWS_ARN", "AWS_ACCOUNT_ID", "AZURE_CONNECTION_STRING", "AZURE_CLIENT_SECRET", "AZURE_UUID", "AZURE_SAS_TOKEN",
    "JWT_BEARER_TOKEN", "CERTIFICATE_THUMBPRINT", "AZURE_RESOURCE_ID", "AZURE_TENANT_DOMAIN", "AZURE_RESOURCE_NAME", "M365_TENANT_URL",
    "GCP_SERVICE_ACCOUNT", "GCP_API_KEY", "GENERIC_SECRET", "INTERNAL_HOSTNAME", "PRIVATE_IP", "NORWEGIAN_COMPANY",
    "NORWEGIAN_ORG_NUMBER", "FILE_PATH", "DANGEROUS_FORMULA",
)
NORWEGIAN = (
    "NORWEGIAN_PERSON_NAME", "NORWEGIAN_NATIONAL_ID", "NORWEGIAN_D_NUMBER", "NORWEGIAN_BANK_ACCOUNT", "NORWEGIAN_PHONE",
    "NORWEGIAN_POSTAL_ADDRESS", "NORWEGIAN_PASSPORT", "NORWEGIAN_VEHICLE_REG",
)
SPECIAL = ("HEALTH_DATA", "BIOMETRIC_DATA", "GENETIC_DATA", "POLITICAL_OPINION", "RELIGIOUS_BELIEF", "SEXUAL_ORIENTATION", "RACIAL_ETHNIC_ORIGIN", "TRADE_UNION")
ENTITIES = (*GENERAL, *CLOUD, *NORWEGIAN, *SPECIAL, "CUSTOM_TERM")

# Types of high and of medium severity; the others are low.
HIGH = {
    "AWS_ACCESS_KEY", "AWS_ARN", "AZURE_CONNECTION_STRING", "AZURE_CLIENT_SECRET", "GCP_SERVICE_ACCOUNT", "GCP_API_KEY", "GENERIC_SECRET",
    "CREDIT_CARD", "IBAN_CODE", "NORWEGIAN_NATIONAL_ID", "NORWEGIAN_D_NUMBER", "NORWEGIAN_BANK_ACCOUNT", *SPECIAL,
}
MEDIUM = {
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "NRP", "CUSTOM_TERM", "NORWEGIAN_COMPANY", "NORWEGIAN_ORG_NUMBER",
    "NORWEGIAN_PERSON_NAME", "NORWEGIAN_PHONE", "NORWEGIAN_POSTAL_ADDRESS", "NORWEGIAN_PASSPORT", "NORWEGIAN_VEHICLE_REG",
    "INTERNAL_HOSTNAME", "PRIVATE_IP", "FILE_PATH",
}

#: Types that come as spans from outside (a model of named entities), and go through suppression here.
EXTERNAL = {"PERSON", "LOCATION", "NRP"}
#: Types whose detector is of our own definition, as theirs isn't known; others can be supplied.
OWN = {
    "EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "URL", "CREDIT_CARD", "IBAN_CODE", "NORWEGIAN_COMPANY",
    "AWS_ARN", "AWS_ACCOUNT_ID", "AZURE_CONNECTION_STRING", "AZURE_CLIENT_SECRET", "AZURE_RESOURCE_ID", "AZURE_TENANT_DOMAIN", "AZURE_RESOURCE_NAME",
    "GCP_SERVICE_ACCOUNT", "GCP_API_KEY", "GENERIC_SECRET", "INTERNAL_HOSTNAME", "NORWEGIAN_ORG_NUMBER", "FILE_PATH",
}
#: Types known by what tests of them ask for.
BY_TEST = {"AZURE_UUID", "AZURE_SAS_TOKEN", "JWT_BEARER_TOKEN", "CERTIFICATE_THUMBPRINT", "M365_TENANT_URL", "AWS_ACCESS_KEY", "PRIVATE_IP"}


def severity(entity: str) -> str:
    return "high" if entity in HIGH else "medium" if entity in MEDIUM else "low"


def group(entity: str) -> str:
    for name, members in (("general", GENERAL), ("cloud", CLOUD), ("norwegian", NORWEGIAN), ("special", SPECIAL)):
        if entity in members:
            return name
    return "custom"


def status(entity: str) -> str:
    for name, members in (("external", EXTERNAL), ("own", OWN), ("by test", BY_TEST)):
        if entity in members:
            return name
    return "specified"


def catalog(spark: SparkSession) -> DataFrame:
    """A row per entity type: place, entity, group, severity, status."""
    rows = [(i, e, group(e), severity(e), status(e)) for i, e in enumerate(ENTITIES)]
    return spark.createDataFrame(rows, "place int, entity string, group string, severity string, status string")


def selected(entities: set[str] | None, custom_terms: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Types to look for in text: None stands for all, an empty set for none. Formulas are looked for in cells
    whatever is selected, and custom terms only where there are any."""
    chosen = [e for e in ENTITIES if entities is None or e in entities]
    return tuple(e for e in chosen if e != "DANGEROUS_FORMULA" and (e != "CUSTOM_TERM" or any(t.strip() for t in custom_terms)))
