"""The ``legal`` view: deterministic legal markers added to ``documents``.

The select list is plain SQL that Spark and DuckDB evaluate identically, so
the same text defines the Spark DataFrame (``selectExpr``) and the oracle
CTE. Test data only; operators never depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table

_COURT = ("CASE WHEN doc_id % 10 = 9 THEN NULL WHEN doc_id % 4 = 0 THEN 'BGH 2. Strafsenat' "
          "WHEN doc_id % 4 = 1 THEN 'BGH 9. Zivilsenat' WHEN doc_id % 4 = 2 THEN 'BVerfG 1. Senat' "
          "ELSE 'OLG Köln' END")
_DATE = ("CASE WHEN doc_id % 25 = 0 THEN 'Unknown' ELSE concat(cast(2010 + doc_id % 14 AS string), "
         "lpad(cast(1 + doc_id % 12 AS string), 2, '0'), lpad(cast(1 + doc_id % 28 AS string), 2, '0')) END")
_CASE_NO = ("concat(cast(1 + doc_id % 9 AS string), ' StR ', cast(doc_id % 500 AS string), '/', "
            "lpad(cast(doc_id % 20 AS string), 2, '0'))")
_DOC_TYPE = "CASE WHEN doc_id % 3 = 0 THEN 'Urteil' WHEN doc_id % 3 = 1 THEN 'Beschluss' ELSE NULL END"
_JURIS = ("CASE WHEN doc_id % 4 = 0 THEN 'federal' WHEN doc_id % 4 = 1 THEN 'state' "
          "WHEN doc_id % 4 = 2 THEN 'international' ELSE NULL END")
_YEAR = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE cast(2010 + doc_id % 14 AS int) END"
_TEXT = """CASE
    WHEN doc_id % 7 = 0 THEN text
    WHEN lang = 'de' THEN concat('JURE', cast(doc_id AS string), chr(160), 'BGH „', source, '" ',
      CASE WHEN doc_id % 5 = 0 THEN 'LEITSÄTZE Satz eins. ' ELSE '' END,
      CASE WHEN doc_id % 2 = 0 THEN 'Tenor ' ELSE 'Beschluss ' END, '§ ', cast(doc_id % 300 + 1 AS string), 'a Abs. ', cast(doc_id % 4 + 1 AS string), ' Satz 2 StGB, Art. ', cast(doc_id % 20 + 1 AS string), ' Abs. 1 GG. Herr Meier und Frau Schulz, 12 Hauptstraße, 0221/1234567, anna', cast(doc_id AS string), '@kanzlei.de ',
      CASE WHEN doc_id % 2 = 0 THEN 'Tatbestand ' ELSE '' END, substring(text, 1, 1500),
      CASE WHEN doc_id % 3 = 0 THEN ' ENTSCHEIDUNGSGRÜNDE BGH, Urteil vom 10.6.2009 ' WHEN doc_id % 3 = 1 THEN ' Gründe BVerfG, Beschluss vom 1.12.2011 ' ELSE ' ' END, substring(text, 1501), ' III. Ende')
    ELSE concat('Case ', cast(doc_id AS string), chr(160), 'Mr. Smith, Ms. Jones and Mrs. Brown at 12 Main Street, (555) 123-4567, 555-987-6543, clerk', cast(doc_id AS string), '@court.gov under the jurisdiction of ',
      CASE WHEN doc_id % 4 = 0 THEN 'federal' WHEN doc_id % 4 = 1 THEN 'state' ELSE 'international' END, ' law in ', cast(2010 + doc_id % 14 AS string), ' ',
      CASE WHEN doc_id % 2 = 0 THEN 'OPINION' ELSE 'Decision' END, ' see ', cast(doc_id % 500 + 1 AS string), ' U.S. ', cast(doc_id % 90 + 1 AS string), ', ', cast(doc_id % 50 + 1 AS string), ' S.Ct. 12, ', cast(doc_id % 40 + 1 AS string), ' F.2d 77, ', cast(doc_id % 30 + 1 AS string), ' F.Supp.2d 9 ', substring(text, 1, 1500),
      CASE WHEN doc_id % 3 = 0 THEN ' CONCLUSION affirmed ' WHEN doc_id % 3 = 1 THEN ' It is so ORDERed ' ELSE ' ' END, substring(text, 1501))
  END"""

LEGAL_COLUMNS = [
    ("doc_id", "doc_id"),
    ("language", "CASE WHEN lang = 'de' THEN 'de' ELSE 'en' END"),
    ("source", "source"),
    ("court", _COURT),
    ("date", _DATE),
    ("case_number", _CASE_NO),
    ("document_type", _DOC_TYPE),
    ("jurisdiction", _JURIS),
    ("year", _YEAR),
    ("text", _TEXT),
]

LEGAL_SQL = "SELECT " + ",\n  ".join(f"{e} AS {a}" for a, e in LEGAL_COLUMNS) + "\nFROM documents"


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.selectExpr(*[f"{e} AS {a}" for a, e in LEGAL_COLUMNS])


def with_legal(sql: str) -> str:
    """Oracle SQL with the ``legal`` CTE in front."""
    return f"WITH legal AS (\n{LEGAL_SQL}\n)\n{sql}"
