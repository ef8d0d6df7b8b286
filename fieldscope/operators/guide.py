"""The catalog of tools: name, category, keywords and use cases, for listing and suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tools' names, by category.
TOOLS = {
    "core": "list_available_logs list_entries get_entry_info read_entry list_loaded_logs list_struct_types health_check",
    "query": "search_entries get_types find_condition search_strings",
    "statistics": "get_statistics compare_entries detect_anomalies find_peaks rate_of_change time_correlate",
    "robot": "get_match_phases analyze_swerve power_analysis can_health compare_matches moi_regression get_code_metadata",
    "domain": "get_ds_timeline analyze_vision profile_mechanism analyze_auto analyze_cycles analyze_replay_drift analyze_loop_timing analyze_can_bus predict_battery_health get_game_info",
    "export": "export_csv generate_report",
    "motor_controllers": "list_revlog_signals get_revlog_data sync_status set_revlog_offset wait_for_sync",
    "matches": "get_tba_status get_tba_match_data",
    "discovery": "get_server_guide suggest_tools",
}
#: What a task may mention beside the words of a tool's name.
HINTS = {
    "find_condition": (["threshold", "exceed", "below", "above"], ["when does a value cross a threshold"]),
    "get_statistics": (["mean", "average", "median", "percentile"], ["summarise the values of a channel"]),
    "detect_anomalies": (["outlier", "unusual"], ["find outliers among values"]),
    "find_peaks": (["maximum", "spike"], ["locate spikes in a signal"]),
    "time_correlate": (["correlation", "related"], ["relation between two channels"]),
    "rate_of_change": (["derivative", "acceleration", "slope"], ["acceleration from velocity samples"]),
    "analyze_swerve": (["wheel", "module", "slip", "odometry"], ["wheel slip and module desynchronisation"]),
    "power_analysis": (["brownout", "voltage"], ["brownout risk from battery voltage"]),
    "predict_battery_health": (["battery", "brownout"], ["battery condition after matches"]),
    "can_health": (["timeout", "bus"], ["timeout errors on the bus"]),
    "moi_regression": (["inertia", "torque"], ["estimate inertia from current"]),
    "analyze_vision": (["camera", "target", "pose"], ["camera loses targets often"]),
    "profile_mechanism": (["overshoot", "settling", "stall"], ["tune a mechanism for overshoot"]),
    "analyze_auto": (["path", "autonomous"], ["path following error during autonomous"]),
    "analyze_cycles": (["cycle", "dead", "idle"], ["cycle times between states"]),
    "analyze_loop_timing": (["loop", "overrun"], ["loop overruns of robot code"]),
    "analyze_replay_drift": (["replay"], ["replay differs from real outputs"]),
    "set_revlog_offset": (["clock", "offset"], ["correct a clock offset"]),
}


def catalog(spark: SparkSession) -> DataFrame:
    rows = []
    for category, names in TOOLS.items():
        for name in names.split():
            keywords, cases = HINTS.get(name, ([], []))
            own = [w for w in name.split("_") if len(w) > 3]
            rows.append((name, category, sorted({*own, *keywords}), cases))
    return spark.createDataFrame(rows, "name string, category string, keywords array<string>, use_cases array<string>")
