"""Hot keys are really split: with tiny thresholds the joins must come out as skew joins."""

import re

import pytest

from traffic_risk.operators import features, labeling, network, reports, resolution
from traffic_risk.operators.baseline import Baseline
from traffic_risk.params import ResolutionParams

FORCED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.files.maxPartitionBytes": "16k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def eager_splitting(spark):
    before = {k: spark.conf.get(k, None) for k in FORCED}
    for k, v in FORCED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skew_joins(df, key):
    """Number of executed joins on ``key`` that were split."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(rf"(?:SortMergeJoin|ShuffledHashJoin)\(skew=true\) \[[^\]]*{key}#", plan))


@pytest.fixture
def hot(spark, events, tmp_path):
    """A third of all rows share url, hour, address, resolution, signature and province."""
    rows = [{"distinct_id": f"h{i}", "url": "/hot", "ip": "9.9.9.9", "referrer": ""} for i in range(2000)]
    rows += [
        {"distinct_id": f"c{i}", "url": f"/{i % 50}", "hour_time": i % 24, "ip": f"1.{i % 200}.{i % 7}.1",
         "screen_width": str(300 + i % 9), "province": f"p{i % 30}"}
        for i in range(4000)
    ]
    path = str(tmp_path / "hot")
    events(*rows).repartition(24).write.parquet(path)
    return spark.read.parquet(path)


def test_feature_joins_split_hot_keys(eager_splitting, hot):
    base = Baseline({h: 1 / 24 for h in range(24)}, 0.1, 0.1, 1.0, 1.0)
    out = features.user_blocks(hot)
    assert skew_joins(out, "url") == 1
    out = features.user_environment(hot, base)
    assert skew_joins(out, "ip") == 1 and skew_joins(out, "ip_c_segment") == 1
    assert skew_joins(features.clone_clusters(hot), r"hour_bin#\d+\)+, url_nunique") == 1
    main = resolution.main_resolution(hot)
    vocab = resolution.fit_resolution_vocab(resolution.daily_resolutions(main), ResolutionParams(1, 1))
    assert skew_joins(resolution.resolution_bucket(main, vocab), "main_resolution_canonical") == 1


def scores(spark, hot):
    users = hot.select("date", "distinct_id").distinct()
    iforest = users.selectExpr("*", "1 AS model_anomaly", "0.0D AS final_time_risk")
    gbt = users.selectExpr("*", "1 AS model_anomaly", "0.1D AS xgb_bot_prob")
    return iforest, gbt


@pytest.fixture
def one_user(spark, events, tmp_path):
    """A third of all rows belong to one user-day."""
    rows = [{"distinct_id": "hot", "url": f"/{i}", "ip": f"1.1.{i % 250}.{i % 7}", "title": f"t{i}"} for i in range(2000)]
    rows += [{"distinct_id": f"c{i}", "ip": "1.2.3.4"} for i in range(4000)]
    path = str(tmp_path / "user")
    events(*rows).repartition(24).write.parquet(path)
    return spark.read.parquet(path)


def test_label_joins_split_a_hot_user(eager_splitting, one_user):
    traffic = labeling.label_traffic(one_user, *scores(eager_splitting, one_user))
    assert skew_joins(traffic.rows(), "distinct_id") == 1
    assert skew_joins(traffic.users_by(ip=one_user["ip"]), "distinct_id") == 1
    titles = reports.title_url_uv_pv(traffic, False, "Home", as_of="2024-01-01")
    assert skew_joins(titles, "distinct_id") == 1


def test_cluster_joins_split_a_hot_segment(eager_splitting, one_user):
    traffic = labeling.label_traffic(one_user, *scores(eager_splitting, one_user))
    assert skew_joins(reports.c_segment_users(traffic, as_of="2024-01-01"), "ip_c") == 1
    fields = network.network_fields(network.network_base(traffic))
    assert skew_joins(network.network_new_catch(fields, 0.0), "ip_c_segment") == 1


def test_cells_and_addresses_are_shuffled_once(eager_splitting, hot):
    """The cells feed three readers and the addresses two; each is one scan and one shuffle."""
    base = Baseline({h: 1 / 24 for h in range(24)}, 0.1, 0.1, 1.0, 1.0)
    out = features.base_features(hot, base)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 3
    assert plan.count("ReusedExchange") == 5
