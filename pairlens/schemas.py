"""Class lists and constants that carry semantics."""

from __future__ import annotations

# The two orders of the classes; each breaks ties in its own place.
CLASSES = ("decline", "stable", "increase")
MODEL_CLASSES = ("stable", "decline", "increase")

# Fixed values of the label rules.
RULE_LOW, RULE_HIGH = -0.02, 0.02
DECLINE_QUANTILE, INCREASE_QUANTILE = 0.15, 0.85
MAX_MASKED, STABLE_BAND = 0.15, 0.05
SPACING_M, FOOTPRINT_M = 960.0, 640.0
WILSON_Z = 1.959964
METRES_PER_DEGREE = 111_320.0
STUDY_LATITUDE = 22.28

# The least change of each indicator that is a direction.
DEAD_BANDS = {"NDVI": 0.02, "EVI": 0.02, "NDMI": 0.02, "NBR": 0.02, "green_cover": 0.05, "VV": 0.3, "VH": 0.3, "rainfall": 5.0, "soil_moisture": 0.01, "temperature": 0.3}
CLASS_DIRECTION = {"decline": "decrease", "increase": "increase", "stable": "stable"}
