"""Named queries over the canonical tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .panel import Panel, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries whose plans read the daily facts more than once.
SEVERAL = frozenset(
    """
    f12_flow_features f15_analyst_outcomes f16_analyst_scores f22_feature_matrix m06_factor_baseline l01_forward_labels l02_equal_weight_index
    l04_named_benchmark_labels m10_scored_predictions m11_m12_flags m13_m14_recommendations m17_capped_portfolio b01_topk_backtest
    b04_backtest_metrics b05_baseline_comparison b06_gate b07_b08_long_short b09_long_short_backtest b11_up_down b12_backtest_results b13_performance
    b15_price_gap b16_price_gap_summary b17_price_forecast d04_top_upside p15_freshness j03_full_outer j13_lookup_join a08_corr_beta
    o01_o02_outlook_dataset o05_ridge o06_o07_forecast u01_universe_refresh m11_m12_all_flags g10_all_causes b04_equity_summary b06_gate_decision
    m09_model_registry g12_sector_link g09_fund_link x02_tail_flows x06_x07_explanations o02_outlook_rows s07_modelling_set s08_prediction_set
    s09_latest_features f19_attach_daily g16_ablation m04_prediction_scores m05_evaluation m08_ranked_predictions d02_latest_rows d03_universe_view
    d05_position_summary d07_backtest_by_sector d08_prediction_history d15_legs_by_market b03_attach_forward_returns b14_model_gate f21_attach_sector
    f23_horizon_columns g17_outlook_ablation d01_snapshot m01_m03_walk_forward m02_walk_forward_metrics m01_validation_metrics
    b05_random_baseline b17_forecast_band d12_global_adjustment b13_performance_by_model b14_gatekeeper m15_stock_clusters f24_split_sequences u01_universe_commit
    """.split()
)


def query(name: str, select: str | None = None, *more: str):
    """Register fn(panel) under a name; ``select`` is the twin over the canonical tables and ``more``."""

    def add(fn: Callable[[Panel], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Panel(spark, sf_dir, name in SEVERAL))
        if select is not None:
            ORACLES[name] = sql(select, *more)
        return fn

    return add
