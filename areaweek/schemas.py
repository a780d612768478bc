"""Table contracts: column types, natural keys and small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
DATE, TS = T.DateType(), T.TimestampType()

# Column names, types and keys that stored tables must carry.
LGA_REGISTRY = _struct(
    ("lga_code", S, False), ("lga_name", S, False), ("state_code", S, True), ("state_name", S, False),
    ("zone", S, True), ("senatorial_district", S, True), ("area_sqkm", D, True),
    ("centre_lat", D, True), ("centre_lon", D, True),
)
LGA_ADJACENCY = _struct(
    ("lga_code", S, False), ("neighbour_code", S, False), ("weight", D, False),
    ("border_km", D, True), ("centroid_km", D, True),
)
INCIDENTS = _struct(
    ("event_id", S, False), ("source", S, False), ("source_event_id", S, True), ("event_date", DATE, False),
    ("event_class", S, False), ("event_type", S, True), ("actor_primary", S, True), ("actor_secondary", S, True),
    ("dyad", S, True), ("lga_code", S, True), ("state_name", S, True), ("latitude", D, True),
    ("longitude", D, True), ("geolocation_precision", I, True), ("date_precision", I, True),
    ("fatalities", I, False), ("civilian_deaths", I, False), ("victims", I, True), ("ransom_ngn", D, True),
    ("headline", S, True), ("description", S, True), ("source_url", S, True), ("ingested_at", TS, False),
    ("geom_wkt", S, True),
)
DOCUMENTS = _struct(
    ("doc_id", S, False), ("source", S, False), ("doc_type", S, True), ("title", S, True),
    ("published_at", DATE, True), ("url", S, True), ("body", S, False),
    ("lga_codes", T.ArrayType(S), False), ("ransom_ngn", D, True), ("ingested_at", TS, False),
)
CHATTER = _struct(
    ("chatter_id", S, False), ("platform", S, False), ("posted_at", TS, False), ("lga_code", S, True),
    ("body", S, False), ("sentiment", D, True), ("threat_score", D, True), ("url", S, True),
    ("ingested_at", TS, False),
)
MODEL_RUNS = _struct(
    ("run_id", S, False), ("created_at", TS, False), ("model_version", S, True), ("horizon_days", I, True),
    ("train_end", DATE, True), ("metrics", S, True), ("notes", S, True),
)
PREDICTIONS = _struct(
    ("run_id", S, False), ("lga_code", S, False), ("week_start", DATE, False), ("probability", D, False),
    ("risk_tier", S, False), ("rank_national", T.LongType(), False), ("rank_state", T.LongType(), False),
)

TABLE_KEYS: dict[str, tuple[str, ...]] = {
    "lga_registry": ("lga_code",),
    "lga_adjacency": ("lga_code", "neighbour_code"),
    "incidents": ("event_id",),
    "documents": ("doc_id",),
    "chatter": ("chatter_id",),
    "lga_week_features": ("lga_code", "week_start"),
    "model_runs": ("run_id",),
    "predictions": ("run_id", "lga_code", "week_start"),
    "prediction_drivers": ("run_id", "lga_code", "week_start", "driver_rank"),
    "threat_actor_edges": ("run_id", "actor", "target_kind", "target"),
    "security_briefs": ("brief_id",),
    "alerts": ("alert_id",),
}

# Event classes, tiers and their order.
TARGET_CLASS = "banditry_kidnapping"
OPERATION_CLASS = "state_operation"
OTHER_CLASS = "other"
EVENT_CLASSES = (TARGET_CLASS, OPERATION_CLASS, OTHER_CLASS)
TIERS = ("Low", "Elevated", "High", "Severe")

# Display label of each panel feature.
FEATURE_LABELS = {
    "hawkes_background": "Baseline rate for this LGA",
    "hawkes_self": "Self-excitation from recent local attacks",
    "hawkes_neighbour": "Contagion from attacks in adjacent LGAs",
    "hawkes_total": "Total Hawkes intensity",
    "hawkes_self_share": "Share of intensity that is locally generated",
    "hawkes_neighbour_share": "Share of intensity arriving from neighbours",
    "hawkes_expected_events": "Hawkes expected events over the next 7 days",
    "hawkes_prob_any": "Hawkes probability of any event in 7 days",
    "own_events_1w": "Attacks here last week",
    "own_events_2w": "Attacks here in the last 2 weeks",
    "own_events_4w": "Attacks here in the last month",
    "own_events_8w": "Attacks here in the last 2 months",
    "own_events_12w": "Attacks here in the last quarter",
    "own_events_26w": "Attacks here in the last half year",
    "own_events_52w": "Attacks here in the last year",
    "own_fatalities_4w": "Deaths here in the last month",
    "own_fatalities_12w": "Deaths here in the last quarter",
    "own_fatalities_52w": "Deaths here in the last year",
    "nb_events_1w": "Attacks in adjacent LGAs last week",
    "nb_events_4w": "Attacks in adjacent LGAs in the last month",
    "nb_events_12w": "Attacks in adjacent LGAs in the last quarter",
    "nb_fatalities_4w": "Deaths in adjacent LGAs in the last month",
    "own_ops_4w": "Military operations here in the last month",
    "own_ops_12w": "Military operations here in the last quarter",
    "nb_ops_4w": "Active military operation in an adjacent LGA",
    "nb_ops_12w": "Military operations nearby in the last quarter",
    "weeks_since_event": "Weeks since the last attack here",
    "weeks_since_nb_event": "Weeks since the last attack next door",
    "state_events_4w": "Attacks across the state in the last month",
    "state_ops_4w": "Military operations across the state in the last month",
    "hist_rate": "Long-run attack rate for this LGA",
    "actors_26w": "Distinct armed actors active here or nearby",
    "cal_festival_within_horizon": "Festival or public holiday within 7 days",
    "cal_dry_season": "Dry season, when forest corridors are passable",
    "cal_school_in_session": "Schools in session",
    "cal_week_of_year": "Week of the year",
    "cal_month": "Month",
    "area_sqkm": "Size of the LGA",
    "n_neighbours": "Number of adjacent LGAs",
    "doc_mentions_4w": "Reports naming this LGA in the last month",
    "doc_ransom_12w": "Recent ransom payment reported nearby",
    "chatter_volume_1w": "Social chatter volume last week",
    "chatter_escalation": "Escalating chatter volume against own baseline",
    "chatter_threat_1w": "Peak threat score in chatter last week",
}
