"""A small set of projects to try the library on: the same rows each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from piiflow.schema import DOCUMENTS, VARIABLES

_TEXTS = {
    "lease": [("offer", "Anna Svensson, 811218-9876, hyr på Storgatan 5 i Uppsala. Skriv till anna@mail.example."), ("answer", "Annas svar kom från anna@mail.example.")],
    "claim": [("report", "Bolaget 556036-0793 nås på 070-123 45 67, Postnummer 123 45.")],
    "notes": [("draft", "Inget här pekar ut någon.")],
}
_KNOWN = {
    "lease": [("Anna Svensson", "NAME1", "name"), ("811218-9876", "PIN1", "pin"), ("Storgatan 5", "STREET1", "street"), ("Uppsala", "CITY1", "city"), ("anna@mail.example", "EMAIL1", "email")],
    "claim": [("556036-0793", "ORG1", "org"), ("070-123 45 67", "PHONE1", "phone"), ("123 45", "POSTAL1", "postal")],
}


def documents(spark: SparkSession) -> DataFrame:
    rows = [(project, name, text) for project, texts in _TEXTS.items() for name, text in texts]
    return spark.createDataFrame([(p, k, k, name, text) for k, (p, name, text) in enumerate(rows)], DOCUMENTS)


def variables(spark: SparkSession) -> DataFrame:
    """Variables of the projects; in each a value and a token come once."""
    return spark.createDataFrame([(p, value, token, kind, k) for p, known in _KNOWN.items() for k, (value, token, kind) in enumerate(known)], VARIABLES)
