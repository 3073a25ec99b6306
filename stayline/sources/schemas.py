"""Schemas of the ten base tables.

Fixed values: table and column names and types of the clinical data set.
Identifiers stored as NUMERIC(7,0) are INT so that join keys need no cast, and the
measurement times keep their full precision (see `time_granularity` in the extracts).
"""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES = {
    "patients": """
        row_id INT, subject_id INT, gender STRING, dob TIMESTAMP_NTZ, dod TIMESTAMP_NTZ,
        dod_hosp TIMESTAMP_NTZ, dod_ssn TIMESTAMP_NTZ, expire_flag STRING""",
    "admissions": """
        row_id INT, subject_id INT, hadm_id INT, admittime TIMESTAMP_NTZ, dischtime TIMESTAMP_NTZ,
        deathtime TIMESTAMP_NTZ, admission_type STRING, admission_location STRING,
        discharge_location STRING, insurance STRING, language STRING, religion STRING,
        marital_status STRING, ethnicity STRING, edregtime TIMESTAMP_NTZ, edouttime TIMESTAMP_NTZ,
        diagnosis STRING, hospital_expire_flag SMALLINT, has_chartevents_data SMALLINT""",
    "icustays": """
        row_id INT, subject_id INT, hadm_id INT, icustay_id INT, dbsource STRING,
        first_careunit STRING, last_careunit STRING, first_wardid SMALLINT, last_wardid SMALLINT,
        intime TIMESTAMP_NTZ, outtime TIMESTAMP_NTZ, los DOUBLE""",
    "diagnoses_icd": """
        row_id INT, subject_id INT, hadm_id INT, seq_num INT, icd9_code STRING""",
    "d_icd_diagnoses": """
        row_id INT, icd9_code STRING, short_title STRING, long_title STRING""",
    "chartevents": """
        row_id INT, subject_id INT, hadm_id INT, icustay_id INT, itemid INT,
        charttime TIMESTAMP_NTZ, storetime TIMESTAMP_NTZ, cgid INT, value STRING, valuenum DOUBLE,
        valueuom STRING, warning INT, error INT, resultstatus STRING, stopped STRING""",
    "d_items": """
        row_id INT, itemid INT, label STRING, abbreviation STRING, dbsource STRING,
        linksto STRING, category STRING, unitname STRING, param_type STRING, conceptid INT""",
    "labevents": """
        row_id INT, subject_id INT, hadm_id INT, itemid INT, charttime TIMESTAMP_NTZ,
        value STRING, valuenum DOUBLE, valueuom STRING, flag STRING""",
    "noteevents": """
        row_id INT, subject_id INT, hadm_id INT, chartdate TIMESTAMP_NTZ, charttime TIMESTAMP_NTZ,
        storetime TIMESTAMP_NTZ, category STRING, description STRING, cgid INT, iserror STRING,
        text STRING""",
    "d_labitems": """
        row_id INT, itemid INT, label STRING, fluid STRING, category STRING, loinc_code STRING""",
}

# The only table whose fields may hold line breaks.
MULTI_LINE = {"noteevents"}

# Columns that must not be null, besides the primary key row_id of every table.
NOT_NULL = {"diagnoses_icd": ["subject_id", "hadm_id"]}
PRIMARY_KEY = ["row_id"]

# How the event tables are laid out when loaded: by what the extracts join on, then time.
CLUSTERING = {
    "chartevents": ["icustay_id", "charttime"],
    "labevents": ["subject_id", "hadm_id", "charttime"],
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
