"""The whole way on invented clinical tables: CSV files to explained scores."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from stayline.plans.cohort import build_cohort, extract_labs, extract_vitals
from stayline.plans.features import build_features, select_features
from stayline.plans.modelling import explain, score_pipeline, train_pipeline
from stayline.sources.tables import load_table, materialize, table_violations

PEOPLE = 80


def csv(path, rows):
    path.write_text("HEADER\n" + "".join(",".join("" if v is None else str(v) for v in row) + "\n" for row in rows))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    rng = np.random.default_rng(4)
    start = datetime(2150, 1, 1, 8)
    died = rng.random(PEOPLE) < 0.5
    rows = {name: [] for name in ("patients", "admissions", "icustays", "diagnoses_icd", "labevents", "chartevents")}
    for i in range(PEOPLE):
        dod = start + timedelta(days=10) if died[i] else None
        rows["patients"].append((i, i, "MF"[i % 2], "2090-01-01 00:00:00", dod, None, None, int(died[i])))
        rows["admissions"].append(
            (i, i, 1000 + i, start, None, None, "EMERGENCY", None, None, "Private", None, None, "SINGLE", "X", None, None, "d", 0, 1))
        rows["icustays"].append(
            (i, i, 1000 + i, 5000 + i, "mv", "A", "A", 1, 1, start, start + timedelta(hours=40), 1.6))
        for seq, code in enumerate(["1500", "2000"][: 1 + i % 2]):
            rows["diagnoses_icd"].append((2 * i + seq, i, 1000 + i, seq, code))
        for k in range(6):
            when = start + timedelta(hours=3 * k)
            shift = 2.0 if died[i] else 0.0
            rows["chartevents"].append(
                (6 * i + k, i, 1000 + i, 5000 + i, 1, when, when, 1, "x", 80 + 5 * shift + rng.normal(), "bpm", 0, 0, None, None))
            rows["labevents"].append((12 * i + k, i, 1000 + i, 1, when, "x", 100 + rng.normal(), "mg", None))
            if i % 2:
                rows["labevents"].append((12 * i + 6 + k, i, 1000 + i, 2, when, "x", 1.0, "mg", None))
    rows["d_icd_diagnoses"] = [(1, "1500", "mal", "Malignant neoplasm a"), (2, "2000", "neo", "Some neoplasm b")]
    rows["d_items"] = [(1, 1, "Heart Rate", "HR", "mv", "chartevents", "Vital", "bpm", "Numeric", None)]
    rows["d_labitems"] = [(1, 1, "Glucose", "Blood", "Chemistry", "x"), (2, 2, "Rare", "Blood", "Chemistry", "x")]
    for name, values in rows.items():
        csv(folder / f"{name}.csv", values)
    return {name: load_table(spark, str(folder / f"{name}.csv"), name) for name in rows}


def test_from_files_to_explained_scores(spark, tables):
    assert all(table_violations(df, name).isEmpty() for name, df in tables.items())
    cohort = materialize(
        build_cohort(*[tables[n] for n in ("patients", "admissions", "icustays", "diagnoses_icd", "d_icd_diagnoses")])
    )
    assert cohort.count() == PEOPLE * 3 // 2
    labs = materialize(extract_labs(tables["labevents"], cohort, tables["d_labitems"]))
    vitals = materialize(extract_vitals(tables["chartevents"], cohort, tables["d_items"]))
    # Half of the stays have two codes and each reading once per code.
    assert vitals.count() == 6 * PEOPLE * 3 // 2
    features = build_features(cohort, vitals, labs, ignore=["dod"])
    made = [c for c in features.columns if c.split("_")[0] in ("mean", "min", "max", "slope")]
    # The rare lab covers half of the stays and is left out.
    assert sorted(made) == sorted(f"{s}_{n}" for s in ("mean", "min", "max", "slope") for n in ("heart_rate", "glucose"))
    assert features.count() == PEOPLE * 3 // 2
    # `dod` is null for the survivors: it is too sparse to stay, as without the rule above.
    assert "dod" not in build_features(cohort, vitals, labs).columns

    chosen = materialize(select_features(features, top_n=3, trees=5, depth=2, split_key=["icustay_id"]))
    assert chosen.columns[:3] == ["subject_id", "hadm_id", "icustay_id"] and chosen.columns[-1] == "mortality_30d"
    assert any("heart_rate" in c for c in chosen.columns)
    trained = train_pipeline(chosen, split_key=["icustay_id"])
    assert trained.auc.first().auc > 0.9
    scored = score_pipeline(chosen, trained.model)
    assert scored.filter("predicted_probability IS NULL").isEmpty()
    tables_ = explain(chosen, trained.model, ["icustay_id"], top_n=2)
    assert tables_["importance"].first().feature.endswith("heart_rate")
    assert tables_["waterfall"].count() == 2 * len(trained.model.features)
    assert tables_["beeswarm"].count() == chosen.count() * len(trained.model.features)
