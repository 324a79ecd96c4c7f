import random

from pyspark.ml import PipelineModel

from hubrisk.operators import ml as ML
from hubrisk.session import scratch_path


def test_train_score_save_and_reload(spark, params):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        year = 2019 if i < 300 else 2024
        month = 3 if i < 350 else 9
        x = rnd.random()
        rows.append((year, month, float(i % 97), x, int(x > 0.7), float(i % 13)))
    df = spark.createDataFrame(rows, "year int, month int, connection_minutes double, wx_a_precip_total double, "
                                     "cascading_delay int, inbound_arr_time double")
    assert ML.feature_columns(df) == ["connection_minutes", "inbound_arr_time", "wx_a_precip_total"]
    model, feats = ML.train_classifier(df, params, max_iter=3, max_depth=2)
    test = ML.temporal_split(df, params).where("split = 'test'")
    scored = ML.score_sequences(model, test, feats)
    assert scored.count() == 50 and scored.where("predicted_proba < 0 OR predicted_proba > 1").count() == 0
    imp = {r.feature: r.importance for r in ML.feature_importance(model, feats).collect()}
    assert max(imp, key=imp.get) == "wx_a_precip_total"
    path = scratch_path(spark, "t-model")
    ML.save_model(model, path)
    again = PipelineModel.load(path)
    assert ML.score_sequences(again, test, feats).select("predicted").collect() == scored.select("predicted").collect()


def test_crowded_scores_spread_evenly(spark):
    """All scores within [0, 0.001], most of them tiny: equal-width bands would put them into one task."""
    from pyspark.sql import functions as F
    from hubrisk.operators.common import balanced_chunk
    rnd = random.Random(2)
    rows = [(rnd.random() ** 6 / 1000, int(rnd.random() < 0.2)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "score double, label int")
    chunked = balanced_chunk(df.select("score").distinct(), "score", 128)
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert len(sizes) == 128 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    tasks = [r["count"] for r in ML._score_table(df, "label", "score").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) < 2 or max(tasks) <= 2 * sum(tasks) / len(tasks)
    ordered = sorted(rows)
    positives = sum(y for _, y in rows)
    below, wins = 0, 0.0
    for _, y in ordered:  # distinct scores: no ties
        wins += below if y else 0
        below += 1 - y
    assert abs(ML.auc_roc(df).first().auc_roc - wins / positives / (len(rows) - positives)) < 1e-12


def test_score_table_by_part_equals_each_part_alone(spark):
    rnd = random.Random(4)
    rows = [(p, rnd.choice([0.0, -0.0, 0.1, 0.1, rnd.random()]), rnd.randrange(2)) for p in range(3) for _ in range(300 * p + 1)]
    df = spark.createDataFrame(rows, "p int, score double, label int")
    names = ["score", "pos", "neg", "pos_below", "neg_below"]
    got = ML._score_table(df, "label", "score", ["p"], chunks=7)
    for p in range(3):
        alone = ML._score_table(df.where(f"p = {p}"), "label", "score", chunks=3)
        assert sorted(map(tuple, got.where(f"p = {p}").select(names).collect())) == sorted(map(tuple, alone.select(names).collect()))
    assert ML._score_table(df.limit(0), "label", "score").count() == 0


def _labelled(spark, n=700, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        year, month = (2019, 3) if i < n // 2 else (2024, 3 if i < 3 * n // 4 else 9)
        x, y = rnd.random(), rnd.choice([None, float("nan"), rnd.gauss(0, 1), rnd.gauss(0, 1)])
        rows.append((year, month, float(rnd.randrange(97)), x, y, int(x + (y or 0.0) * 0.2 + rnd.gauss(0, 0.3) > 0.7), f"k{i}"))
    return spark.createDataFrame(rows, "year int, month int, connection_minutes double, wx_a_precip_total double, wx_b_x double, cascading_delay int, _row string")


def test_node_table_scores_like_spark(spark, params):
    df = _labelled(spark)
    fitted, feats = ML.train_classifier(df, params, max_iter=8, max_depth=4, subsample=0.9)
    trees = ML.TreeModel.of(fitted, feats)
    assert trees.rounds() == fitted.stages[-1].getNumTrees
    want = {r._row: r for r in ML.score_sequences(fitted, df, feats).collect()}
    got = trees.score(df)
    assert got.columns == [*df.columns, "predicted_proba", "predicted"]
    for r in got.collect():
        assert abs(r.predicted_proba - want[r._row].predicted_proba) < 1e-9 and r.predicted == want[r._row].predicted
    assert got.where("wx_b_x is null").count() == df.where("wx_b_x is null").count() > 0  # features come back as they were
    imp = {r.feature: r.importance for r in ML.feature_importance(fitted, feats).collect()}
    assert all(abs(r.importance - imp[r.feature]) < 1e-9 for r in trees.importances().collect()) and len(imp) == len(feats)
    cover = trees.nodes.where("node = 0").agg({"cover": "min"}).first()[0]
    assert cover > 0 and trees.nodes.where("(feature is null) != (left is null)").count() == 0
    path = scratch_path(spark, "t-trees")
    trees.save(path)
    again = ML.TreeModel.load(spark, path)
    assert again.features == trees.features and again.score(df).exceptAll(got).count() == 0


def test_training_stops_at_the_best_precision(spark, params):
    """Precision by rounds, in one pass, against a loop over the cut models; the stop against a plain one."""
    df = _labelled(spark, 900, 6)
    model = ML.train_trees(df, params, max_iter=24, patience=4, max_depth=3)
    stages = {r.rounds: r.average_precision for r in model.stages.collect()}
    validation = ML.temporal_split(df, params).where("split = 'validation'")
    longest = len(stages)
    assert longest in (8, 16, 24) and sorted(stages) == list(range(1, longest + 1))
    full = ML.train_trees(df, params, max_iter=longest, patience=longest, max_depth=3)
    whole = full if full.rounds() == longest else None
    best, best_at, stop = -1.0, 0, longest
    for k in range(1, longest + 1):
        if stages[k] > best:
            best, best_at = stages[k], k
        elif k - best_at >= 4:
            stop = k
            break
    assert model.rounds() == best_at and (stop < longest or longest in (8, 16, 24))
    for k in range(1, best_at + 1):
        scored = model.cut(k).score(validation).select("cascading_delay", "predicted_proba")
        assert abs(ML.average_precision(scored, "cascading_delay", "predicted_proba").first()[0] - stages[k]) < 1e-9
    if whole is not None:  # a longer run begins with the same trees
        assert whole.cut(best_at).nodes.drop("weight").exceptAll(model.nodes.drop("weight")).count() == 0


def test_stop_round_and_no_validation(spark, params):
    assert ML.stop_round([0.1, 0.3, 0.2, 0.3, 0.2], 3) == (2, True) and ML.stop_round([0.1, 0.3, 0.2], 3) == (2, False)
    assert ML.stop_round([0.0] * 6, 5) == (1, True)
    df = _labelled(spark).where("year = 2019")
    model = ML.train_trees(df, params, max_iter=6, patience=2, max_depth=2)
    assert model.rounds() == 4 and model.stages is None


def test_fit_rows_are_chosen_before_wide_columns_are_joined(spark, monkeypatch):
    from hubrisk.operators import ml as ML
    from hubrisk.operators import sequences as SQ
    from hubrisk.plans import registry as R
    sf = "/root/testdata/sf0.001"
    d = R.data(spark, sf)
    whole = ML.temporal_split(SQ.sequences_enriched(d.flights, R.pair_feats(spark, sf), R.daily_weather(spark, sf), R.P), R.P)
    labelled, unseen = whole.where("split IN ('train', 'validation')").drop("split"), whole.where("split = 'test'").drop("split")
    ids = ["in_flight_id", "out_flight_id"]
    for most, staged in ((100, 0), (100_000, 0), (100, 1_000_000)):
        monkeypatch.setattr(R, "FIT_ROWS", most)
        monkeypatch.setattr(R, "STAGED_ROWS", staged)
        got, want = R.fit_rows(spark, sf), ML.fit_sample(labelled, most)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, R.unseen_rows(spark, sf).select(*unseen.columns).collect())) == sorted(map(str, unseen.collect()))
    assert 0 < got.select(*ids).count() < labelled.count()
