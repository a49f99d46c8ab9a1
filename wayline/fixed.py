"""Fixed values of the data formats: names, codes, weights, thresholds.

These are data, not logic.  They are stated plainly because results depend on
them value by value.
"""

# --- fixed values: enumerations -------------------------------------------
AUGMENTS = ["fog", "night", "rain", "motion_blur"]
AUGMENT_CYCLE = ["rain", "night", "fog", "motion_blur"]
MODALITIES = ["video + prior", "image + prior", "prior", "video", "image"]
VIEWER_MODALITIES = ["video + prior", "image + prior", "prior", "augment + prior"]
FRAME_PROFILES = ["single", "sparse4", "video5m", "custom"]

# canonical task name -> (modality, augmented)
TASKS = {
    "video_prior_normal": ("video + prior", False),
    "prior_only": ("prior", False),
    "video_prior_augmented": ("video + prior", True),
    "image_prior_normal": ("image + prior", False),
    "image_prior_augmented": ("image + prior", True),
}

# --- fixed values: maneuvers ----------------------------------------------
MANEUVER_BY_CODE = {
    0: "NONE", 1: "DEPART", 2: "DEPART_RIGHT", 3: "DEPART_LEFT", 4: "DESTINATION",
    5: "DESTINATION_RIGHT", 6: "DESTINATION_LEFT", 7: "NAME_CHANGE", 8: "CONTINUE",
    9: "SLIGHT_RIGHT", 10: "TURN_RIGHT", 11: "SHARP_RIGHT", 12: "UTURN_RIGHT",
    13: "UTURN_LEFT", 14: "SHARP_LEFT", 15: "TURN_LEFT", 16: "SLIGHT_LEFT",
    17: "RAMP_STRAIGHT", 18: "RAMP_RIGHT", 19: "RAMP_LEFT", 20: "EXIT_RIGHT",
    21: "EXIT_LEFT", 22: "STRAIGHT", 23: "KEEP_RIGHT", 24: "KEEP_LEFT", 25: "MERGE",
    26: "ROUNDABOUT_ENTER", 27: "ROUNDABOUT_EXIT", 28: "FERRY", 29: "FERRY_TRAIN",
}

CODE_BY_MANEUVER = {
    "": 8, "turn-left": 15, "turn-right": 10, "turn-slight-left": 16,
    "turn-slight-right": 9, "turn-sharp-left": 14, "turn-sharp-right": 11,
    "uturn-left": 13, "uturn-right": 12, "straight": 8, "ramp-left": 19,
    "ramp-right": 18, "merge": 25, "fork-left": 24, "fork-right": 23,
    "roundabout-left": 26, "roundabout-right": 26, "keep-left": 24, "keep-right": 23,
}
DEFAULT_MANEUVER_CODE = 8

ACTION_BY_MANEUVER = {
    "TURN_LEFT": "turn_left", "TURN_RIGHT": "turn_right", "LEFT": "turn_left",
    "RIGHT": "turn_right", "SLIGHT_LEFT": "turn_left", "SLIGHT_RIGHT": "turn_right",
    "SHARP_LEFT": "turn_left", "SHARP_RIGHT": "turn_right", "STRAIGHT": "continue",
    "CONTINUE": "continue", "NAME_CHANGE": "continue", "DEPART": "continue",
    "MERGE": "merge", "MERGE_LEFT": "merge_left", "MERGE_RIGHT": "merge_right",
    "RAMP_LEFT": "merge_left", "RAMP_RIGHT": "merge_right",
    "ROUNDABOUT_LEFT": "roundabout", "ROUNDABOUT_RIGHT": "roundabout",
    "UTURN": "uturn", "FORK_LEFT": "fork_left", "FORK_RIGHT": "fork_right",
    "KEEP_LEFT": "keep_left", "KEEP_RIGHT": "keep_right",
}

# action -> direction group, for the partial credit of the field score
ACTION_GROUPS = {
    "left": ["turn_left", "fork_left", "merge_left", "keep_left"],
    "right": ["turn_right", "fork_right", "merge_right", "keep_right"],
    "straight": ["straight"],
    "uturn": ["uturn"],
    "roundabout": ["roundabout"],
}

# action -> direction family, for the partial credit of the composite reward
ACTION_FAMILIES = {
    "left": ["turn_left", "merge_left", "fork_left", "keep_left", "ramp_left"],
    "right": ["turn_right", "merge_right", "fork_right", "keep_right", "ramp_right"],
    "straight": ["continue", "straight", "merge"],
    "roundabout": ["roundabout", "roundabout_left", "roundabout_right"],
}

HIGHWAY_KEYWORDS = [
    "highway", "motorway", "freeway", "expressway", "interstate", "bypass",
    "m1", "m2", "m3", "m4", "m5",
]
HIGHWAY_MANEUVERS = ["ramp-left", "ramp-right", "merge"]
STREET_NAME_MARKERS = [" onto ", " on "]
STREET_NAME_TERMINATORS = [" toward ", " then ", " and ", ".", ",", "Partial", "partial"]

ROAD_CLASS_PRIORITY = {
    "motorway": 10, "motorway_link": 9, "trunk": 8, "trunk_link": 7, "primary": 6,
    "primary_link": 5, "secondary": 4, "secondary_link": 3, "tertiary": 2,
    "tertiary_link": 1, "residential": 0, "unclassified": 0,
}

# --- fixed values: sampling -------------------------------------------------
SPARSE4_TARGETS = [100, 80, 60, 40]
SINGLE_TARGETS = [40]
VIDEO_SPACING_M = 5.0
VIDEO_END_M = 5.0
FRAME_PITCH, FRAME_FOV, FRAME_SIZE = 0, 90, "640x400"

# --- fixed values: geometry -------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
FALLBACK_SPEED_KMH = 40.0

# --- fixed values: scores ---------------------------------------------------
COMPOSITE_WEIGHTS_V1 = {
    "action_reward": 0.20, "lane_reward": 0.10, "format_reward": 0.10,
    "length_reward": 0.05, "bertscore_reward": 0.15, "clipscore_reward": 0.15,
    "cider_reward": 0.15, "rouge_l_reward": 0.10,
}
COMPOSITE_WEIGHTS_V2 = {
    "action_reward": 0.18, "lane_reward": 0.09, "format_reward": 0.09,
    "length_reward": 0.05, "bertscore_reward": 0.14, "clipscore_reward": 0.14,
    "cider_reward": 0.13, "rouge_l_reward": 0.09, "latency_reward": 0.09,
}
TOTAL_WEIGHTS = {
    "bertscore_f1": 0.35, "semantic_similarity": 0.05, "lane_change_required": 0.25,
    "next_action": 0.20, "relevant_landmarks": 0.10, "potential_hazards": 0.05,
}
CIDER_WEIGHTS = [0.4, 0.3, 0.2, 0.1]
LATENCY_TIERS = [(5000, 1.0), (10000, 0.8), (15000, 0.6), (20000, 0.4), (25000, 0.2)]
SUMMARY_FIELDS = [
    "next_action", "next_action_strict", "lane_change_required", "lanes_count",
    "lanes_count_exact", "lanes_count_abs_err", "relevant_landmarks",
    "potential_hazards", "enhanced_instruction", "total",
]
REFIT_THRESHOLD = 0.35

# --- fixed values: prices ---------------------------------------------------
IMAGE_USD_PER_1000 = 7.0
JUDGE_USD_PER_CALL = 0.025
JUDGES_PER_COMPARISON = 3
START_RATING = 1000.0
