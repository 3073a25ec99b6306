"""The tables that fitted models give, against plain Python on their scores."""

import pytest

from stayline.operators import scoring as S
from stayline.plans import roles as R
from stayline.plans.modelling import train_pipeline
from stayline.plans.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


def test_training_measures(spark):
    trained = train_pipeline(R.embedding_features(spark, FOLDER), "outcome", split_key=["vec_id"], drop=["vec_id"])
    rows = [(r["outcome"], r[S.PREDICTED_CLASS], r[S.PREDICTED_PROBABILITY]) for r in trained.scored_test.collect()]
    got = {r["class"]: r for r in REGISTRY["training_measures"](spark, FOLDER).collect()}
    for k in (0, 1):
        hit = sum(y == p == k for y, p, _ in rows)
        precision, recall = hit / sum(p == k for _, p, _ in rows), hit / sum(y == k for y, _, _ in rows)
        assert got[str(k)]["precision"] == pytest.approx(precision) and got[str(k)]["recall"] == pytest.approx(recall)
        assert got[str(k)]["support"] == sum(y == k for y, _, _ in rows)
    ones, zeros = ([s for y, _, s in rows if y == k] for k in (1, 0))
    area = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert got["1"]["auc"] == pytest.approx(area)


def test_feature_ranking_is_sorted_and_whole(spark):
    rows = [tuple(r) for r in REGISTRY["feature_ranking"](spark, FOLDER).collect()]
    names = [r[0] for r in rows]
    sizes = [next(v for v in r if isinstance(v, float)) for r in rows]
    assert sorted(names) == sorted(R.EMBEDDING_FEATURES) and sizes == sorted(sizes, reverse=True) and sizes[0] > 0
