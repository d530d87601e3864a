"""The person view over the driver tables and its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The text is valid in Spark SQL and in DuckDB, so tests and oracles share it.
PERSON_SQL = """
SELECT 'patient_' || lpad(CAST(c_custkey AS STRING), 9, '0') AS id,
       CASE WHEN c_custkey % 17 = 0 THEN NULL
            ELSE DATE '1920-01-01' + CAST((c_custkey * 7919) % 37900 AS INT) END AS birthdate,
       CASE WHEN c_custkey % 11 = 0 THEN NULL
            ELSE lpad(CAST(c_custkey AS STRING), 9, '0') END AS ssn,
       CASE WHEN c_custkey % 19 = 0 THEN '' ELSE split_part(c_name, '#', 1) END AS first,
       split_part(c_name, '#', 2) AS last,
       CASE WHEN c_custkey % 13 = 0 THEN ''
            WHEN c_custkey % 5 = 0 THEN c_mktsegment
            ELSE CAST(c_custkey AS STRING) || ' ' || c_mktsegment || ' St' END AS address,
       n_name AS city, r_name AS state,
       CASE WHEN c_custkey % 23 = 0 THEN NULL
            ELSE lpad(CAST(c_nationkey * 397 AS STRING), 5, '0') END AS zip,
       c_mktsegment AS race,
       CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
       CASE WHEN c_custkey % 3 = 0 THEN NULL
            WHEN c_custkey % 3 = 1 THEN 'M' ELSE 'S' END AS marital,
       c_acctbal AS healthcare_expenses,
       round(spend, 2) AS healthcare_coverage
FROM customer
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY o_custkey) o
       ON o_custkey = c_custkey
"""

# Direct identifiers the base view lacks; they exist to be redacted.
WIDE_PERSON_SQL = """
SELECT p.*, 'DL' || last AS drivers, CAST(NULL AS STRING) AS passport, city AS maiden,
       healthcare_expenses / 100 AS lat, healthcare_expenses / 50 AS lon
FROM person p
"""

# A partner table with shifted expenses and some swapped genders.
SHIFTED_PERSON_SQL = """
SELECT id, birthdate, ssn, first, last, address, city, state, zip, race,
       CASE WHEN id LIKE '%3' THEN CASE WHEN gender = 'M' THEN 'F' ELSE 'M' END ELSE gender END AS gender,
       marital, healthcare_expenses * 1.05e0 AS healthcare_expenses, healthcare_coverage
FROM person
"""

# Part of the rows twice, for duplicate removal.
DOUBLED_PERSON_SQL = """
SELECT * FROM person UNION ALL SELECT * FROM person WHERE last LIKE '%7'
"""


# Ids that are missing or repeat, as far as the rows of a table may have them.
LOOSE_PERSON_SQL = """
SELECT CASE WHEN id LIKE '%7' THEN NULL WHEN id LIKE '%3' THEN 'patient_again' ELSE id END AS id,
       birthdate, ssn, first, last, address, city, state, zip, race, gender, marital, healthcare_expenses, healthcare_coverage
FROM person
"""

# Addresses with newlines, quotes and commas.
QUOTED_PERSON_SQL = """
SELECT id, CASE WHEN id LIKE '%1' THEN concat(address, chr(10), city) WHEN id LIKE '%2' THEN concat('"', address, '", ', city)
                WHEN id LIKE '%3' THEN concat(city, chr(13), chr(10), 'x') ELSE address END AS address, city, healthcare_expenses
FROM person
"""

# Numeric gaps, a column of one value, an empty text column and a mostly empty date.
GAPPED_PERSON_SQL = """
SELECT id, CASE WHEN id LIKE '%0' THEN birthdate END AS birthdate, marital, zip, city, gender,
       CASE WHEN id LIKE '%7' THEN NULL ELSE healthcare_expenses END AS healthcare_expenses,
       CASE WHEN id LIKE '%4' THEN NULL ELSE healthcare_coverage END AS healthcare_coverage,
       CAST(NULL AS STRING) AS passport, CAST(NULL AS DOUBLE) AS lat, 7.5e0 AS lon
FROM person
"""


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temp views for the tables the person view reads, and the view itself."""
    for table in ("customer", "nation", "region", "orders"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    spark.sql(PERSON_SQL).createOrReplaceTempView("person")


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(PERSON_SQL)


def variant(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(sql)
