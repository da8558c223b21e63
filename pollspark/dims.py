"""Fixed values and the small dimension tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values: they must equal the published data model -------------------------------

# Raw party label -> canonical column. Every other label goes to the residual.
PARTY_MAP = {
    "CDU/CSU": "cdu_csu", "SPD": "spd", "GRÜNE": "gruene", "FDP": "fdp", "AfD": "afd",
    "LINKE": "linke", "LinkePDS": "linke", "PDS": "linke", "BSW": "bsw",
    "Sonstige": "sonstige", "FW": "sonstige", "PIRATEN": "sonstige", "REP": "sonstige",
    "REP/DVU": "sonstige", "Rechte": "sonstige",
}
RESIDUAL = "sonstige"

# Labels that are not vote shares.
NON_VOTE_LABELS = ["Nichtwähler/Unentschl", "Nichtwähler/Unentschl."]

# Left-party names folded to one label when one source is read alone.
LEFT_LABELS = ["LinkePDS", "LINKE", "PDS"]

# Letter code before the sample size -> survey method.
METHOD_MAP = {"O": "online", "T": "phone", "TOM": "mixed"}

# Canonical column, display name, document key, colour.
PARTIES = [
    ("cdu_csu", "CDU/CSU", "CDU_CSU", "#000000"),
    ("spd", "SPD", "SPD", "#E3000F"),
    ("gruene", "GRÜNE", "GRUENE", "#1AA037"),
    ("fdp", "FDP", "FDP", "#FFCC00"),
    ("afd", "AfD", "AfD", "#009EE0"),
    ("linke", "LINKE", "LINKE", "#BE3075"),
    ("bsw", "BSW", "BSW", "#572B81"),
    ("sonstige", "Sonstige", "Sonstige", "#AAAAAA"),
]

# Parties in the trend model, and those a poll must report to be used.
MODEL_PARTIES = ["CDU/CSU", "SPD", "GRÜNE", "FDP", "AfD", "LINKE", "Sonstige"]
MAJOR_PARTIES = ["CDU/CSU", "SPD", "GRÜNE", "FDP"]

# Validation bounds; each bound itself is valid.
SHARE_SUM_BOUNDS = (95, 105)
SAMPLE_SIZE_BOUNDS = (500, 50000)
MAX_DAYS_FIELD_END_AFTER_PUBLICATION = 7

# Time grid.
GRID_ORIGIN = "1998-01-01"
GRID_DAYS = 14

# Quantile levels and their document keys.
QUANTILE_LEVELS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
QUANTILE_KEYS = ["q05", "q10", "q25", "median", "q75", "q90", "q95"]

# Federal election dates by year.
ELECTION_DATES = {
    1949: "1949-08-14", 1953: "1953-09-06", 1957: "1957-09-15", 1961: "1961-09-17",
    1965: "1965-09-19", 1969: "1969-09-28", 1972: "1972-11-19", 1976: "1976-10-03",
    1980: "1980-10-05", 1983: "1983-03-06", 1987: "1987-01-25", 1990: "1990-12-02",
    1994: "1994-10-16", 1998: "1998-09-27", 2002: "2002-09-22", 2005: "2005-09-18",
    2009: "2009-09-27", 2013: "2013-09-22", 2017: "2017-09-24", 2021: "2021-09-26",
}

# Official 2025 result; the residual is computed.
RESULT_2025 = {
    "election_year": 2025, "election_date": "2025-02-23", "cdu_csu": 0.288, "spd": 0.167,
    "gruene": 0.117, "fdp": 0.041, "afd": 0.208, "linke": 0.087, "bsw": 0.047,
}
RESULTS_FROM_YEAR = 1990

# Registry metadata: source, full name, main method, notes.
POLLSTER_META = [
    ("Allensbach", "Institut für Demoskopie Allensbach", "phone",
     "Oldest German pollster, face-to-face historically"),
    ("Forsa", "Forsa – Gesellschaft für Sozialforschung und statistische Analysen", "phone",
     "Largest weekly sample sizes (~2500)"),
    ("Forsch’gr.Wahlen", "Forschungsgruppe Wahlen", "phone", "Conducts Politbarometer for ZDF"),
    ("GMS", "GMS Dr. Jung GmbH", "phone", "Smaller institute, less frequent polling"),
    ("INSA", "INSA-Consulere GmbH", "online", "Online panel, high frequency since ~2014"),
    ("Infratestdimap", "Infratest dimap", "phone", "Conducts DeutschlandTrend for ARD"),
    ("Verian(Emnid)", "Verian (formerly Kantar/Emnid)", "phone", "Weekly polls for Bild am Sonntag"),
    ("Yougov", "YouGov Deutschland", "online", "Online panel, MRP methodology"),
]
ACTIVE_DAYS = 730

# Parties that entered during the observed time.
PARTY_ERA_DATES = [("AfD", "2013-04-01", "2099-01-01"), ("BSW", "2024-01-08", "2099-01-01")]

# -------------------------------------------------------------------------------------------


def map_lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Look a key up in a fixed map; unknown and null keys take ``default``."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def canonical_party(label: Column) -> Column:
    return map_lookup(PARTY_MAP, label, F.lit(RESIDUAL))


def party_dim(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *p) for i, p in enumerate(PARTIES)]
    return spark.createDataFrame(
        rows, "party_idx int, party string, display string, key string, color string"
    )


def pollster_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        POLLSTER_META, "pollster string, full_name string, primary_method string, notes string"
    )


def election_dates_dim(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(list(ELECTION_DATES.items()), "election_year int, d string")
    return df.select("election_year", F.to_date("d").alias("election_date"))


def party_eras_dim(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(PARTY_ERA_DATES, "party string, s string, e string")
    return df.select("party", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
