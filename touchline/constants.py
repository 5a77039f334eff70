"""Fixed values of the data model: results are only right if these are kept as they are."""

# --- fixed values: sampling and windows -------------------------------------------------
FRAME_RATE = 25.0
OBSERVATION_S = 5.0
HORIZON_S = 5.0
STRIDE_S = 0.5
MIN_VALID_RATIO = 0.8
SEQUENCE_LENGTH = 50
OBSERVATION_FRAMES = 125
WARMUP_FRAMES = 3
BUFFER_FRAMES = 128
STRIDE_FRAMES = 12  # 12.5 rounded half to even
VELOCITY_SPAN = 3
RECENT_PASS_FRAMES = 250
BOX_ENTRY_LOOKBACK_S = 120.0

# --- fixed values: pitch geometry in metres ---------------------------------------------
PITCH_LENGTH = 105.0
PITCH_WIDTH = 68.0
HALF_LENGTH = 52.5
HALF_WIDTH = 34.0
BOX_X_MIN = 36.0
BOX_Y_MAX = 20.16
GOAL_HALF_WIDTH = 3.66
FINAL_THIRD_X = 17.5
FAR_M = 105.0
PRESSURE_RADIUS_M = 10.0

# --- fixed values: episodes, alarms, evaluation -----------------------------------------
MERGE_GAP_S = 10.0
ALARM_BRIDGE_S = 2.0
BOOTSTRAP_REPLICATES = 2000
CONFIDENCE_LEVEL = 0.95
FALSE_ALARM_BUDGET = 12.0
MATCH_MINUTES = 90.0
TARGET_PRECISION = 0.30
VALIDATION_TAIL = 0.2
EMBARGO_S = 30.0
PARITY_TOLERANCE = 1e-4

# --- fixed values: editorial policy -----------------------------------------------------
COOLDOWN_S = 20.0
MAX_STALENESS_S = 2.0
DUPLICATE_WINDOW_S = 45.0
MIN_CONSECUTIVE = 2
HIGH_BAND_FRACTION = 0.45
ROLLUP_FRAMES = 25
DOWNSAMPLE_PERIOD_S = 0.05

# --- fixed values: validation, orientation, drift ---------------------------------------
OFF_PITCH_TOLERANCE_M = 5.0
MAX_BALL_MISSING_IN_PLAY = 0.40
MAX_OFF_PITCH_PLAYERS = 0.02
MAX_OFF_PITCH_BALL = 0.05
BALL_AGREEMENT_TOLERANCE = 1e-6
TIER_WEIGHTS = {1: 1.0, 2: 0.75, 3: 0.65, 4: 0.35}
MIN_AGREEMENT = 0.70
HIGH_VOLUME_STRENGTH = 0.30
PSI_LIMIT = 0.25
PSI_FLOOR = 1e-6
MISSING_RATE_LIMIT = 0.15
EVENT_RATE_LIMIT = 0.5

# --- fixed values: event taxonomy -------------------------------------------------------
TEAMS = ("home", "away")
EVENT_TYPES = (
    "pass", "carry", "shot", "recovery", "ball_lost", "challenge",
    "set_piece", "ball_out", "fault_received", "card", "other",
)
DEAD_BALL_TYPES = ("set_piece", "ball_out", "card", "fault_received")
ON_BALL_TYPES = ("pass", "carry", "shot", "recovery", "ball_lost")
PROGRESS_TYPES = ("pass", "carry")
RAW_EVENT_TYPES = {
    "PASS": "pass",
    "CARRY": "carry",
    "SHOT": "shot",
    "RECOVERY": "recovery",
    "BALL LOST": "ball_lost",
    "CHALLENGE": "challenge",
    "SET PIECE": "set_piece",
    "BALL OUT": "ball_out",
    "FAULT RECEIVED": "fault_received",
    "CARD": "card",
}

# --- fixed values: suppression reasons and insight kinds --------------------------------
SUPPRESSION_REASONS = (
    "low_confidence", "invalid_window", "insufficient_frames", "cooldown",
    "duplicate_recent", "stale_situation", "already_in_box", "model_unavailable",
    "schema_mismatch", "not_yet_sustained", "dead_ball",
)
KIND_BUILDING = "building_threat"
KIND_ELEVATED = "elevated_entry_chance"
KIND_SUSTAINED = "sustained_pressure"

# --- fixed values: wording --------------------------------------------------------------
HEADLINES = {
    KIND_BUILDING: "Attacking threat is building",
    KIND_ELEVATED: "Movement suggests an elevated chance of a penalty-area entry",
    KIND_SUSTAINED: "Signs of sustained pressure building",
}
HEDGE_TERMS = (
    "building", "increasing", "elevated", "growing", "suggests", "indicates",
    "looks", "appears", "signs of", "threatening", "starting to", "beginning to",
    "chance of", "likely", "may", "could",
)
FORBIDDEN_PHRASES = (
    "will score", "will enter", "is going to", "certain", "guaranteed", "definitely",
)

# --- fixed values: weights of the rule-based score --------------------------------------
SCORE_BIAS = -3.2
SCORE_ADVANCEMENT = 3.6
SCORE_GOALWARD_SPEED = 0.9
SCORE_ATTACKERS_AHEAD = 0.35
SCORE_SPACE_AHEAD = 0.55
SCORE_PRESSURE = -0.45

# --- fixed values: histogram buckets ----------------------------------------------------
LATENCY_BUCKETS = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 1.0)
CONFIDENCE_BUCKETS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)

# --- fixed values: degradation profiles -------------------------------------------------
DEGRADE_PROFILES = {
    "clean": dict(jitter_ms=(0.0, 0.0), drop=0.0, duplicate=0.0, delay=0.0,
                  delay_ms=(0.0, 0.0), reorder=0.0, reorder_by=0),
    "jitter": dict(jitter_ms=(0.0, 25.0), drop=0.0, duplicate=0.0, delay=0.0,
                   delay_ms=(0.0, 0.0), reorder=0.0, reorder_by=0),
    "degraded": dict(jitter_ms=(0.0, 40.0), drop=0.02, duplicate=0.01, delay=0.03,
                     delay_ms=(40.0, 200.0), reorder=0.01, reorder_by=3),
    "hostile": dict(jitter_ms=(0.0, 120.0), drop=0.10, duplicate=0.04, delay=0.10,
                    delay_ms=(80.0, 600.0), reorder=0.05, reorder_by=8),
}

# --- fixed values: the 39 features, in model order --------------------------------------
FEATURE_REVISION = 2
FEATURES = (
    "ball_x", "ball_y_abs", "ball_speed", "ball_v_goalward", "ball_v_lateral",
    "ball_dist_to_goal", "ball_goal_angle", "ball_in_final_third", "ball_in_box",
    "attackers_ahead_of_ball", "attackers_in_box", "attackers_in_final_third",
    "attack_centroid_x", "attack_width", "attack_depth", "attack_highest_x",
    "attack_mean_v_goalward", "attackers_moving_goalward",
    "defenders_in_box", "defenders_goalside_of_ball", "defensive_line_x",
    "defensive_compactness", "defence_centroid_x", "defence_mean_v_goalward",
    "gk_dist_to_ball", "gk_dist_to_goal",
    "nearest_defender_dist", "second_nearest_defender_dist",
    "mean_three_nearest_defender_dist", "nearest_attacker_support_dist",
    "space_ahead_of_ball", "defenders_within_10m_of_ball",
    "possession_duration_s", "possession_event_count", "is_dead_ball",
    "event_in_flight", "recent_pass_count", "recent_box_entry_count",
    "time_since_last_box_entry",
)
DRIFT_WATCH = (
    "ball_x", "ball_dist_to_goal", "nearest_defender_dist", "defensive_line_x",
    "attackers_ahead_of_ball", "possession_duration_s",
)
