import pytest

from kinmatch.operators import metrics
from tests.conftest import rows

RANKING = [("a", "b", 0.9, 1), ("a", "c", 0.2, 2), ("b", "a", 0.8, 1), ("b", "c", 0.3, 2), ("c", "a", 0.7, 1), ("c", "d", 0.6, 2), ("d", "c", 0.95, 1), ("d", "a", 0.1, 2)]


@pytest.fixture
def judged(spark):
    r = spark.createDataFrame(RANKING, "query_id string, candidate_id string, score double, rank int")
    truth = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2"), ("d", "g2")], "id string, label string")
    return metrics.judged(r, truth), metrics.total_positives(truth)


def test_retrieval_metrics(judged):
    got = metrics.retrieval_metrics(metrics.per_query(judged[0], [1], 2, 4), [1], 2).first()
    assert (got["hit_rate_1"], got["precision_1"], got["recall_1"], got["f1_1"], got["map_2"], got["queries"]) == (0.75, 0.75, 0.75, 0.75, 0.875, 4)


def test_threshold_selection_takes_ties_together(judged):
    points = metrics.threshold_points(*judged)
    best = metrics.select_threshold(points).first()
    assert (best["threshold"], best["true_positive"], best["false_positive"], best["false_negative"]) == (0.6, 4, 1, 0)
    at = metrics.pair_metrics_at(*judged, 0.6).first()
    assert at.asDict() == best.asDict()
    floor = metrics.precision_at_recall(points, 0.75).first()
    assert floor["recall"] >= 0.75


def test_unreachable_recall_is_an_error(judged):
    with pytest.raises(Exception, match="no threshold"):
        metrics.precision_at_recall(metrics.threshold_points(*judged), 1.5).collect()


def test_query_without_positive_is_an_error(spark):
    r = spark.createDataFrame([("a", "b", 0.9, 1)], "query_id string, candidate_id string, score double, rank int")
    truth = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, label string")
    with pytest.raises(Exception, match="without a positive"):
        metrics.per_query(metrics.judged(r, truth), [1], 1, 2).collect()


def test_curve_counts_each_step(judged):
    curve = {round(r["threshold"], 3): r["true_positive"] for r in metrics.threshold_curve(*judged).collect()}
    assert len(curve) == 41 and curve[0.0] == 4 and curve[0.6] == 4 and curve[0.625] == 3 and curve[1.0] == 0


def test_weight_selection_breaks_ties_towards_one_half(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.5, 0.5), (0.75, 0.5), (0.25, 0.5)], "weight double, score double")
    assert rows(metrics.select_weight(df)) == [(0.5, 0.5)]
    curve = spark.createDataFrame([(1, 0.2), (5, 0.6), (10, 0.9)], "k int, recall double")
    assert rows(metrics.select_k(curve, 0.5)) == [(5,)] and rows(metrics.select_k(curve, 0.95)) == [(10,)]
