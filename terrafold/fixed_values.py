"""Word lists, thresholds, boxes and template texts.

Everything in this module is data whose exact value decides the result (a
keyword list, a weight, a sentence template). No logic lives here.
"""

# ---- fixed values: enumerations -------------------------------------------
TASK_TYPES = ["search", "vqa", "caption", "grounding", "change", "fusion", "sar_change", "sar_grounding"]
SENSORS = ["Sentinel-1", "Sentinel-2", "both"]
ERROR_TYPES = ["no_candidates", "model_unavailable", "invalid_input", "timeout", "unknown"]

# ---- fixed values: query-log keywords -------------------------------------
TASK_KEYWORDS = {
    "sar_grounding": ["ground on sar", "locate on sar", "find on sar", "highlight on sar"],
    "sar_change": ["sar change", "radar change", "sar difference", "radar difference"],
    "fusion": ["both", "optical and sar", "combine", "fusion", "multimodal", "sar and optical"],
    "change": ["changed", "before and after", "increased", "decreased", "difference between", "what changed"],
    "vqa": ["what", "how many", "where is", "when did", "why", "which"],
    "caption": ["describe", "caption", "what is the land cover", "what does this show", "highlight",
                "where is", "locate", "show me the", "find the", "point to"],
}
SENSOR_KEYWORDS = {
    "Sentinel-1": ["sar", "radar", "sentinel-1", "sentinel 1", "vv", "vh"],
    "Sentinel-2": ["optical", "multispectral", "sentinel-2", "sentinel 2", "rgb", "ndvi"],
}
OBJECT_KEYWORDS = [
    "agriculture", "forest", "water", "urban", "building", "buildings", "river", "lake", "road", "roads",
    "vegetation", "cropland", "wetland", "grassland", "barren", "snow", "ice", "desert", "residential",
    "industrial", "commercial", "farmland",
]
NON_LOCATION_WORDS = [
    "show", "what", "how", "when", "where", "why", "which", "describe", "highlight", "locate", "find",
    "combine", "images", "image", "sentinel", "sar", "optical", "ndvi", "rgb", "radar", "the", "this",
    "that", "from", "with", "for", "and", "but", "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
REFERRING_TRIGGERS = ["highlight", "locate", "show me the", "find the", "point to", "where is the"]
MONTH_PATTERN = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)
MONTH_PREFIXES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# ---- fixed values: gazetteer (place, min_lon, min_lat, max_lon, max_lat) ---
GAZETTEER = [
    ("delhi", 77.05, 28.40, 77.35, 28.80),
    ("new delhi", 77.10, 28.50, 77.30, 28.70),
    ("mumbai", 72.75, 18.85, 73.05, 19.30),
    ("bombay", 72.75, 18.85, 73.05, 19.30),
    ("bangalore", 77.45, 12.85, 77.75, 13.15),
    ("bengaluru", 77.45, 12.85, 77.75, 13.15),
    ("chennai", 80.15, 12.95, 80.40, 13.25),
    ("madras", 80.15, 12.95, 80.40, 13.25),
    ("kolkata", 88.25, 22.45, 88.55, 22.75),
    ("calcutta", 88.25, 22.45, 88.55, 22.75),
    ("hyderabad", 78.30, 17.25, 78.60, 17.55),
    ("pune", 73.70, 18.45, 74.00, 18.75),
    ("ahmedabad", 72.50, 22.95, 72.80, 23.25),
    ("jaipur", 75.65, 26.80, 75.95, 27.10),
    ("lucknow", 80.85, 26.75, 81.15, 27.05),
    ("guwahati", 91.55, 26.05, 91.85, 26.25),
    ("silchar", 92.72, 24.75, 92.87, 24.88),
    ("barpeta", 90.92, 26.28, 91.08, 26.40),
    ("tezpur", 92.72, 26.58, 92.88, 26.70),
    ("majuli", 93.80, 26.85, 94.30, 27.15),
    ("jorhat", 94.10, 26.68, 94.30, 26.82),
    ("dibrugarh", 94.85, 27.42, 95.00, 27.55),
    ("assam", 90.50, 25.50, 95.00, 27.50),
    ("kerala", 76.20, 9.95, 76.50, 10.50),
    ("rajasthan", 72.50, 26.50, 74.00, 28.00),
    ("west bengal", 87.50, 22.50, 89.00, 24.00),
    ("kashmir", 74.00, 33.50, 76.00, 35.00),
    ("ladakh", 76.00, 32.00, 80.00, 36.00),
    ("sri lanka", 80.00, 6.00, 82.00, 10.00),
    ("nepal", 80.00, 26.00, 88.00, 30.00),
    ("bhutan", 88.00, 26.00, 92.00, 28.50),
    ("north india", 75.0, 26.0, 85.0, 32.0),
    ("south india", 76.0, 8.0, 80.0, 14.0),
    ("east india", 85.0, 20.0, 92.0, 27.0),
    ("west india", 70.0, 18.0, 75.0, 25.0),
]

# ---- fixed values: land-cover boxes, first match wins ----------------------
LAND_COVER_BOXES = [
    ("delhi", 77.05, 28.40, 77.35, 28.80, "urban"),
    ("mumbai", 72.75, 18.85, 73.05, 19.30, "urban"),
    ("bangalore", 77.45, 12.85, 77.75, 13.15, "urban"),
    ("chennai", 80.15, 12.95, 80.40, 13.25, "coastal"),
    ("kolkata", 88.25, 22.45, 88.55, 22.75, "urban"),
    ("hyderabad", 78.30, 17.25, 78.60, 17.55, "urban"),
    ("pune", 73.70, 18.45, 74.00, 18.75, "urban"),
    ("ahmedabad", 72.50, 22.95, 72.80, 23.25, "urban"),
    ("jaipur", 75.65, 26.80, 75.95, 27.10, "urban"),
    ("lucknow", 80.85, 26.75, 81.15, 27.05, "urban"),
    ("guwahati", 91.55, 26.05, 91.85, 26.35, "urban"),
    ("kerala", 76.20, 9.95, 76.50, 10.50, "agriculture"),
    ("assam", 90.50, 25.50, 95.00, 27.50, "water"),
    ("rajasthan", 72.50, 26.50, 74.00, 28.00, "barren"),
    ("westbengal", 87.50, 22.50, 89.00, 24.00, "agriculture"),
]
SAR_LAND_COVER_BOXES = [
    ("delhi", 77.05, 28.40, 77.35, 28.80, "urban"),
    ("mumbai", 72.75, 18.85, 73.05, 19.30, "urban"),
    ("bangalore", 77.45, 12.85, 77.75, 13.15, "urban"),
    ("kerala_flood", 76.20, 9.95, 76.50, 10.50, "water"),
    ("assam_flood", 90.50, 25.50, 95.00, 27.50, "water"),
    ("rajasthan", 72.50, 26.50, 74.00, 28.00, "barren"),
]

# ---- fixed values: landmarks per dataset origin (lon, lat) -----------------
LANDMARKS = [
    ("bigearthnet_txt", 11.0, 48.0),
    ("bigearthnet_txt", 2.0, 48.0),
    ("cdvqa", -122.0, 37.0),
    ("cdvqa", -118.0, 34.0),
    ("gee_assam", 91.7, 26.1),
    ("gee_assam", 94.2, 27.5),
]

# ---- fixed values: fine class -> coarse class ------------------------------
LAND_COVER_CLASSES = {
    "urban fabric": "urban",
    "industrial units": "urban",
    "arable land": "agriculture",
    "permanent crops": "agriculture",
    "pastures": "agriculture",
    "complex cultivation patterns": "agriculture",
    "agriculture with natural vegetation": "agriculture",
    "agro-forestry areas": "forest",
    "broad-leaved forest": "forest",
    "coniferous forest": "forest",
    "mixed forest": "forest",
    "natural grassland": "grassland",
    "moors and heathland": "grassland",
    "sclerophyllous vegetation": "vegetation",
    "transitional woodland-shrub": "forest",
    "beaches-dunes-sands": "barren",
    "inland wetlands": "wetland",
    "coastal wetlands": "wetland",
    "inland waters": "water",
    "marine waters": "water",
}

# ---- fixed values: retrieval weights (geo, temporal, semantic, modality) ---
SCORE_WEIGHTS = {"geo": 0.30, "temporal": 0.25, "semantic": 0.30, "modality": 0.15}
CHANGE_SCORE_WEIGHTS = {"geo": 0.10, "temporal": 0.40, "semantic": 0.40, "modality": 0.10}
DEFAULT_CLOUD_MAX = 20.0

# ---- fixed values: radar and index thresholds ------------------------------
WATER_MAX_VV_DB = -17.0
BUILTUP_MIN_VV_DB = -10.0
BUILTUP_MIN_VH_DB = -20.0
NDVI_CHANGE_THRESHOLD = 0.5
SAR_CHANGE_THRESHOLD = 2.0

# ---- fixed values: cross-check words ---------------------------------------
WATER_WORDS = ["water", "lake", "river", "flood", "wet"]
BUILTUP_WORDS = ["building", "built-up", "urban", "structure", "settlement"]

# ---- fixed values: guardrail words -----------------------------------------
GUARDRAIL_REQUIRED = "consistent with"
GUARDRAIL_FORBIDDEN = ["confirms", "detects", "proves"]

# ---- fixed values: file-name modality keywords -----------------------------
MODALITY_KEYWORDS = {
    "sar": ["sar", "s1_", "sentinel-1", "sentinel1", "grd", "_vv_", "_vh_", "pc_sar_", "hf_sar_"],
    "fusion": ["fusion", "paired", "combined"],
    "optical": ["s2_", "sentinel-2", "sentinel2", "optical", "rgb", "ms_", "msi_", "pc_opt_", "bigearthnet"],
}

# ---- fixed values: stratum quotas ------------------------------------------
STRATUM_QUOTAS = {
    "canonical": 300,
    "colloquial_placename": 450,
    "festival_seasonal_date": 300,
    "sensor_phrasing": 200,
    "change_event_phrasing": 300,
    "disaster_officer": 450,
    "adversarial_fallback": 250,
    "multilingual_hinglish": 150,
}

# ---- fixed values: example templates ---------------------------------------
SCENE_CAPTIONS = [
    "This {modality} image from {sensor} shows {label} areas.",
    "A {sensor} {modality} patch containing {label}.",
    "Remote sensing image of {label} captured by {sensor}.",
    "The scene depicts {label} as observed by {sensor}.",
]
SCENE_QUESTIONS = [
    ("What is the land cover in this image?", "The land cover is {label}."),
    ("What type of terrain is shown?", "This image shows {label} terrain."),
    ("Is there {label} in this image?", "Yes, {label} is present in this image."),
    ("Which satellite captured this image?", "This image was captured by {sensor}."),
    ("What is the dominant land cover class?", "The dominant land cover is {label}."),
]
SCENE_REFERRING = ["the {label} area", "the {label} region", "{label} in the center", "the main {label} patch"]
SCENE_REFERRING_BOX = [0.25, 0.25, 0.75, 0.75]

LABEL_CAPTIONS = [
    "Satellite image showing a {label} area.",
    "Aerial view of {label} terrain with characteristic features.",
    "Remote sensing scene depicting {label} landscape.",
    "Overview of a {label} region captured by Sentinel-2 satellite.",
    "Sentinel-2 image of {label} land cover type.",
]
LABEL_QUESTIONS = [
    ("What is the land cover in this image?", "The land cover is {label}."),
    ("What type of terrain is shown?", "This image shows {label} terrain."),
    ("What is the dominant land cover class?", "The dominant land cover is {label}."),
    ("Is this an urban area?", "{is:urban}"),
    ("Is this area water?", "{is:water}"),
    ("Is this area forested?", "{is:forest}"),
    ("Is this area agricultural?", "{is:agriculture}"),
    ("Which satellite captured this image?", "This is a Sentinel-2 satellite image."),
    ("What surface type is visible?", "The surface appears to be {label}."),
]
LABEL_REFERRING = [
    "the {label} area", "the {label} region", "the {label} zone", "the main {label} patch", "{label} in the center",
]
LABEL_REFERRING_BOX = [0.2, 0.2, 0.8, 0.8]

SAR_CAPTIONS = [
    "Sentinel-1 SAR image showing {label} with characteristic backscatter patterns.",
    "C-band radar image of {label}. Bright areas indicate strong backscatter, dark areas smooth surfaces.",
    "SAR acquisition over {label}. The homogeneous pattern suggests uniform surface.",
    "Synthetic Aperture Radar view of {label} with VV and VH polarizations visible.",
]
SAR_QUESTIONS = [
    ("What is the dominant backscatter pattern in this image?", "Predominantly {label}."),
    ("Are there bright or dark areas in this SAR image?", "Predominantly {label}."),
    ("What does the bright area in this image likely represent?",
     "Bright areas in SAR indicate strong backscatter, typically from {label}."),
    ("What does the dark area in this image likely represent?",
     "Dark areas in SAR indicate low backscatter, typically from {label}."),
    ("What is the land cover in this image?", "Based on radar backscatter, the land cover is {label}."),
    ("Is this area urban?", "{is:urban}"),
    ("Is there water visible in this image?",
     "Water appears very dark in SAR due to specular reflection. {is:water}"),
    ("Is this a vegetated area?", "Vegetation shows medium backscatter with characteristic texture. {is:forest}"),
    ("Are there any linear features visible?",
     "Linear features in SAR can indicate roads, railways, or field boundaries. {linear}"),
    ("What polarization is this image?",
     "This is Sentinel-1 C-band SAR with VV and VH polarizations shown as RGB."),
    ("Is this image from an active or passive sensor?",
     "SAR is an active sensor, meaning it transmits its own radar signal and measures the backscatter."),
]
SAR_LINEAR_ANSWERS = {"urban": "Yes, visible in the image", "other": "Not clearly visible"}
SAR_REFERRING = [
    "the bright area (strong backscatter)",
    "the dark area (low backscatter)",
    "the {label} region",
    "the urban area (high backscatter)",
    "the water body (very low backscatter)",
    "the vegetated area (medium backscatter with texture)",
    "the linear structure (likely a road or boundary)",
]
FUSION_CAPTIONS = [
    "Combined Sentinel-1 SAR and Sentinel-2 optical view of {label}. The optical image shows the visible "
    "appearance while the SAR image reveals surface roughness and structural information.",
    "Multi-modal analysis of {label} using both radar backscatter and optical reflectance. The combination "
    "provides complementary information about the scene.",
    "SAR-optical fusion over {label}. Features that appear ambiguous in one modality become clear when both "
    "are analyzed together.",
]

# ---- fixed values: prompt texts by (modality, task) ------------------------
_CHAT = (
    "A chat between a curious user and an artificial intelligence assistant. "
    "The assistant gives helpful, detailed, and polite answers to the user's questions."
)
_SAR_CHAT = (
    "A chat between a curious user and an artificial intelligence assistant. "
    "The assistant is an expert in remote sensing, with specialized knowledge "
    "of Synthetic Aperture Radar (SAR) imagery. SAR measures radar backscatter "
    "from the Earth's surface. Bright areas indicate rough surfaces or strong "
    "reflectors (urban, bare rock, metal). Dark areas indicate smooth surfaces "
    "(water, calm fields). Vegetation appears as moderate brightness with "
    "characteristic texture. The assistant interprets SAR features carefully "
    "and distinguishes them from optical appearances."
)
PROMPT_TEXTS = {
    "optical_vqa": _CHAT + " USER: <image>\n{question} ASSISTANT:",
    "optical_caption": _CHAT + " USER: <image>\nPlease describe this remote sensing image in detail, "
    "including land cover, notable features, and any visible structures. ASSISTANT:",
    "optical_grounding": _CHAT + " USER: <image>\nLocate the following in the image and provide its bounding box "
    "as [x1, y1, x2, y2] in normalized coordinates (0-1): {expression} ASSISTANT:",
    "sar_vqa": _SAR_CHAT + " USER: <image>\nThis is a Sentinel-1 Synthetic Aperture Radar (SAR) image (C-band, "
    "VV and VH polarizations shown as RGB). The image shows radar backscatter intensity, NOT visible light. "
    "Bright tones = strong backscatter (urban, bare soil, metal structures). "
    "Dark tones = low backscatter (water, calm surfaces). "
    "Medium tones with texture = vegetation and forests. "
    "Answer the following question based on radar backscatter: {question} ASSISTANT:",
    "sar_caption": _SAR_CHAT + " USER: <image>\nThis is a Sentinel-1 Synthetic Aperture Radar (SAR) image (C-band, "
    "VV and VH polarizations shown as RGB). Describe what you observe in terms of:\n"
    "1. Backscatter intensity (bright/dark regions and their meaning)\n"
    "2. Land cover types (urban, water, vegetation, bare soil, agriculture)\n"
    "3. Spatial patterns and textures\n"
    "4. Notable features (linear structures like roads, geometric patterns "
    "of fields, irregular shapes of natural features)\n"
    "5. Possible interpretation of the scene\nASSISTANT:",
    "sar_grounding": _SAR_CHAT + " USER: <image>\nThis is a Sentinel-1 SAR image. Locate the following in the image "
    "and provide its bounding box as [x1, y1, x2, y2] in normalized coordinates (0-1). "
    "Look for the feature based on its expected backscatter characteristics: {expression} ASSISTANT:",
    "fusion_caption": _CHAT + " USER: <image>\nThis image shows the same area captured by both Sentinel-2 "
    "optical (RGB) and Sentinel-1 SAR (VV+VH+ratio as RGB) satellites. "
    "Describe the scene by combining insights from both modalities:\n"
    "- From optical: land cover types, colors, vegetation health, water clarity\n"
    "- From SAR: surface roughness, structural features, moisture content\n"
    "- Together: how does the SAR signal complement the optical view?\nASSISTANT:",
    "fusion_vqa": _CHAT + " USER: <image>\nThis image combines Sentinel-2 optical and Sentinel-1 SAR views of "
    "the same area. Use BOTH modalities to answer: {question} ASSISTANT:",
    "fusion_change": _CHAT + " USER: <image>\nThese are bi-temporal Sentinel-1 SAR images of the same area, showing "
    "the scene before and after some event. Describe what changed. Focus on:\n"
    "- Changes in backscatter intensity (brighter/darker)\n"
    "- Changes in spatial patterns (new structures, removed features)\n"
    "- Likely cause of changes (flooding, urban growth, deforestation, agricultural changes)\nASSISTANT:",
}
# (modality, task) -> key of PROMPT_TEXTS; any other task uses optical_vqa
PROMPT_TABLE = [
    ("sar", "vqa", "sar_vqa"),
    ("sar", "caption", "sar_caption"),
    ("sar", "grounding", "sar_grounding"),
    ("sar", "change", "sar_caption"),
    ("sar", "fusion", "sar_caption"),
    ("fusion", "vqa", "fusion_vqa"),
    ("fusion", "caption", "fusion_caption"),
    ("fusion", "grounding", "optical_grounding"),
    ("fusion", "change", "fusion_change"),
    ("fusion", "fusion", "fusion_caption"),
    ("optical", "vqa", "optical_vqa"),
    ("optical", "caption", "optical_caption"),
    ("optical", "grounding", "optical_grounding"),
    ("optical", "change", "optical_caption"),
    ("optical", "fusion", "fusion_caption"),
]

# ---- fixed values: session limits ------------------------------------------
SESSION_IDLE_HOURS = 24
SESSION_HISTORY = 20

# ---- fixed values: patterns that decide which dates and places a query names --
ISO_DAY_PATTERN = r"(\d{4}-\d{2}-\d{2})"
MONTH_YEAR_PATTERN = rf"(?i)({MONTH_PATTERN})\s+(\d{{4}})"
YEAR_PATTERN = r"(?i)(?:from|in|during|year)\s+(\d{4})"
PLACE_NAME_PATTERN = r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*"
PLACE_AFTER_PREPOSITION_PATTERN = rf"(?:near|around|in|of|over)\s+({PLACE_NAME_PATTERN})"
CAPITALISED_RUN_PATTERN = rf"(?<!^)(?<!\. )\b({PLACE_NAME_PATTERN})\b"

# ---- fixed values: texts of a result's confidence ---------------------------
CONFIDENCE_TEXTS = {
    "parser_fallback": "parser fallback used",
    "model_fallback": "model fallback used",
    "single": "single observation",
    "cloud": "cloud cover %.0f%%",
    "registration": "coregistration failed",
    "disagreement": "SAR model/deterministic disagreement",
    "low": "Low — ",
    "medium": "Medium — ",
    "major": "Low — SAR model/deterministic disagreement (major)",
    "high": "High — primary models, clear observation, good registration",
}

# Changed shares of an area above which a change is called so, the largest first.
FRACTION_BANDS = [(0.3, "Significant"), (0.1, "Moderate"), (0.01, "Minor")]

# The sentences told of them, with the word, the share and the threshold; and that of smaller shares.
FRACTION_TEXT = "{word} change detected: {share} of area shows NDVI shift > {threshold}"
FRACTION_NONE = "Negligible change detected"

# Words in the name of a training file and the task they mean, the first one that is there.
TASK_FILE_WORDS = [
    ("caption", "caption"),
    ("vqa", "vqa"),
    ("referring", "grounding"),
    ("grounding", "grounding"),
    ("fusion", "fusion"),
    ("change", "change"),
]
