"""Vocabularies and default parameters of the detection stream."""

# Detector categories by id.
CATEGORIES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard",
    "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch",
    "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone",
    "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear",
    "hair drier", "toothbrush",
)
UNKNOWN, PERSON = -1, 0

# Person attributes by bit.
ATTRIBUTES = (
    "Female", "AgeOver60", "Age18-60", "AgeLess18", "Front", "Side", "Back", "Hat", "Glasses", "HandBag",
    "ShoulderBag", "Backpack", "HoldObjectsInFront", "ShortSleeve", "LongSleeve", "UpperStride", "UpperLogo",
    "UpperPlaid", "UpperSplice", "LowerStripe", "LowerPattern", "LongCoat", "Trousers", "Shorts", "Skirt&Dress",
    "boots",
)
EXCLUSIVE = (("AgeLess18", "Age18-60", "AgeOver60"), ("Front", "Side", "Back"))

# Vertical fractions (begin, end) of a box.
IMAGE_REGIONS = {"top": (0.0, 0.25), "middle-top": (0.25, 0.6), "middle-bottom": (0.4, 0.75), "bottom": (0.75, 1.0)}
PERSON_REGIONS = {
    "Hat": (0.0, 0.15), "Glasses": (0.1, 0.3), "UpperStride": (0.25, 0.65), "UpperLogo": (0.25, 0.65),
    "UpperPlaid": (0.25, 0.65), "UpperSplice": (0.25, 0.65), "ShortSleeve": (0.25, 0.5), "LongSleeve": (0.25, 0.65),
    "LongCoat": (0.2, 0.8), "LowerStripe": (0.5, 0.95), "LowerPattern": (0.5, 0.95), "Trousers": (0.5, 0.95),
    "Shorts": (0.5, 0.8), "Skirt&Dress": (0.3, 0.95), "boots": (0.8, 1.0),
}

# Hue ranges in degrees [begin, end).
HUES = {
    "red": ((0, 15), (345, 360)), "orange": ((15, 45),), "yellow": ((45, 75),), "green": ((75, 155),),
    "cyan": ((155, 200),), "blue": ((200, 260),), "purple": ((260, 300),), "pink": ((300, 345),),
}

# Default thresholds.
CONFIDENCE, ATTRIBUTE_MATCH, REMATCH = 0.25, 0.75, 0.5
WEIGHTS = {"proximity": 1.0, "size": 1.0, "category": 1.5, "attribute": 0.8}
MERGE_THRESHOLD, MAX_CLUSTERS, MAX_MERGES = 0.6, 10, 100
TRACK_IOU, TRACK_COSINE, NMS_IOU = 0.5, 0.7, 0.45
TTL = {"metrics": 3600, "snapshot": 300, "alert": 3600, "alert_history": 86400, "session": 604800}
