"""Fixed values shared with the annotation tools: label sets, class names, thresholds."""

# Annotation labels of the combat-phase task, parents first, and their complements.
INTERVAL_LABELS = ["Match", "Active", "Standing"]
COMPLEMENT_LABELS = ["Not Match", "Not Active", "Not Standing"]
CLIP_SECONDS = 30

# Scene classes drawn by annotators.
SCENE_LABELS = ["Not Match", "Match", "Match Intro", "Match Outro", "Unsure"]

# Referee gestures and their class index.
GESTURE_CLASSES = {"match_stop": 0, "point": 1, "half_point": 2, "other": 3}

# Detector classes, by index.
ENTITIES = ["player_blue", "player_white", "referee"]
REFEREE_CLASS = 2

# Clothing colours (r, g, b) that stand for an entity.
ENTITY_COLOURS = {
    "referee": (0, 0, 0),
    "player_blue": (24, 19, 81),
    "player_white": (255, 255, 255),
}

# Phases told apart by mean box height (pixels).
PHASE_NONE = "No-Match/Intermission"
PHASE_STANDING = "Tachi-waza"
PHASE_GROUND = "Ne-waza"
PHASE_UNKNOWN = "Unknown"
STANDING_HEIGHT = 150

# One folder of frames holds ten minutes at one frame per second.
BATCH_SECONDS = 600

# Clock analysis.
CLOCK_FPS = 30
PAUSE_SECONDS = [3, 5, 10, 15]
MATCH_PAUSE_SECONDS = 60

# Motion analysis.
MOTION_WINDOW = 30
PEAK_QUANTILE = 0.995
PEAK_STEP = 50

# Labelling effort: model releases between annotation dates.
VERSION_CUTS = [("2024-03-01", "v0"), ("2024-03-21", "v1")]
LAST_VERSION = "v2"
CI_Z = 1.96
