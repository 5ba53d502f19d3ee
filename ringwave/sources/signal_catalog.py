"""Fixed signal catalog of the original device: groups, analyses, reduction policy, tree candidates."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values (names, order and policy must equal the documented ones) -------------------
SIGNAL_GROUPS = {
    "MPID": [
        "MPID66M020", "MPID66M067", "MPID66M097", "MPID66M127", "MPID66M157", "MPID66M200", "MPID66M247", "MPID66M277", "MPID66M307",
        "MPID66M340", "MPID67A022", "MPID67A037", "MPID67A052", "MPID67A097", "MPID67A157", "MPID67A217", "MPID67A277", "MPID67A337",
        "MPID67B022", "MPID67B037", "MPID67B052", "MPID67B097", "MPID67B157", "MPID67B217", "MPID67B277", "MPID67B337", "MPID79A072",
        "MPID79A147", "MPID79A222", "MPID79A272", "MPID79B067", "MPID79B142", "MPID79B217", "MPID79B277", "MPID1A011", "MPID1A049",
        "MPID1A109", "MPID1A139", "MPID1A199", "MPID1A244", "MPID1A274", "MPID1A341", "MPID1B011", "MPID1B049", "MPID1B109", "MPID1B139",
        "MPID1B199", "MPID1B244", "MPID1B274", "MPID1B341", "MPID2A199", "MPID2B199", "MPID3A199", "MPID3B199", "MPID4A199", "MPID4B199",
        "MPID5A199", "MPID5B199",
    ],
    "MPI_BDOT": [
        "MPI66M020D", "MPI66M067D", "MPI66M097D", "MPI66M127D", "MPI66M132D", "MPI66M137D", "MPI66M157D", "MPI66M200D", "MPI66M247D",
        "MPI66M277D", "MPI66M307D", "MPI66M312D", "MPI66M322D", "MPI66M340D",
    ],
    "MPIF": [
        "MPIF2A139", "MPIF2B139", "MPIF3A139", "MPIF3B139", "MPIF4A139", "MPIF4B139", "MPIF5A139", "MPIF5B139",
    ],
    "ISLD": [
        "ISLD66M017", "ISLD66M042", "ISLD66M072", "ISLD66M102", "ISLD66M132", "ISLD66M197", "ISLD66M252", "ISLD66M312", "ISLD67A017",
        "ISLD67A052", "ISLD67A072", "ISLD67A112", "ISLD67A132", "ISLD67A197", "ISLD67A252", "ISLD67A312", "ISLD67B017", "ISLD67B052",
        "ISLD67B072", "ISLD67B112", "ISLD67B132", "ISLD67B197", "ISLD67B252", "ISLD67B312", "ISLD79A072", "ISLD79A147", "ISLD79A222",
        "ISLD79A272", "ISLD79B067", "ISLD79B142", "ISLD79B217", "ISLD79B277", "ISLD1A011", "ISLD1A049", "ISLD1A109", "ISLD1A139",
        "ISLD1A199", "ISLD1A244", "ISLD1A274", "ISLD1A341", "ISLD1B011", "ISLD1B049", "ISLD1B109", "ISLD1B139", "ISLD1B199", "ISLD1B244",
        "ISLD1B274", "ISLD1B341", "ISLD2A199", "ISLD2B199", "ISLD3A199", "ISLD3B199", "ISLD4A199", "ISLD4B199", "ISLD5A199", "ISLD5B199",
    ],
    "ISLF": [
        "ISLF2A139", "ISLF2B139", "ISLF3A139", "ISLF3B139", "ISLF4A139", "ISLF4B139", "ISLF5A139", "ISLF5B139",
    ],
    "ESLD": [
        "ESLD66M019", "ESLD66M079", "ESLD66M139", "ESLD66M199", "ESLD66M259", "ESLD66M319",
    ],
    "COILS": [
        "C19", "C79", "C139", "C199", "C259", "C319", "IU30", "IU90", "IU150", "IU210", "IU270", "IU330", "IL30", "IL90", "IL150", "IL210",
        "IL270", "IL330", "PCC19", "PCC79", "PCC139", "PCC199", "PCC259", "PCC319", "PCIU30", "PCIU90", "PCIU150", "PCIU210", "PCIU270",
        "PCIU330", "PCIL30", "PCIL90", "PCIL150", "PCIL210", "PCIL270", "PCIL330", "RLC19", "RLC79", "RLC139", "RLC199", "RLC259",
        "RLC319",
    ],
    "AUX": [
        "ip", "bt",
    ],
}
ANALYSIS_GROUPS = {
    "quasi-stationary": [
        "MPID", "ISLD", "ISLF", "ESLD", "COILS", "AUX",
    ],
    "rotating": [
        "MPI_BDOT", "MPIF", "COILS", "AUX",
    ],
    "both": [
        "MPID", "MPI_BDOT", "MPIF", "ISLD", "ISLF", "ESLD", "COILS", "AUX",
    ],
}
DECIMATE_OK = {"quasi-stationary": True, "rotating": False, "both": False}
TREE_CANDIDATES = {
    "kappa": [("efit01", r"\kappa"), ("efit01", r"\top.results.aeqdsk:kappa"), ("efit02", r"\kappa"), ("efitrt1", r"\kappa")],
}
ANALYSIS_TREE_SIGNALS = {"quasi-stationary": ["kappa"], "rotating": ["kappa"], "both": ["kappa"]}
# ---------------------------------------------------------------------------------------------


def signal_groups(spark: SparkSession) -> DataFrame:
    rows = [(g, j, p) for g, names in SIGNAL_GROUPS.items() for j, p in enumerate(names)]
    return spark.createDataFrame(rows, "group string, ord int, pointname string")


def analysis_groups(spark: SparkSession) -> DataFrame:
    rows = [(a, j, g) for a, groups in ANALYSIS_GROUPS.items() for j, g in enumerate(groups)]
    return spark.createDataFrame(rows, "analysis string, ord int, group string")


def tree_candidates(spark: SparkSession) -> DataFrame:
    rows = [(n, r, t, node) for n, c in TREE_CANDIDATES.items() for r, (t, node) in enumerate(c)]
    return spark.createDataFrame(rows, "name string, rank int, tree string, node string")


def analysis_tree_signals(spark: SparkSession) -> DataFrame:
    rows = [(a, n) for a, names in ANALYSIS_TREE_SIGNALS.items() for n in names]
    return spark.createDataFrame(rows, "analysis string, name string")


def decimate_allowed(analysis: str) -> bool:
    """Reduction policy of an analysis; an unknown one is an error."""
    if analysis not in DECIMATE_OK:
        raise ValueError(f"no reduction policy for analysis {analysis!r}, only for {sorted(DECIMATE_OK)}")
    return DECIMATE_OK[analysis]
