"""Fixed values that must match the original pipeline for identical results.

Everything in this module is data, not logic: label names, the token
pattern, gazetteer word lists, the preposition set and the built-in
abbreviation map.  Lists are kept in their original order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original pipeline; do not edit)
# ---------------------------------------------------------------------------

# Label domain in column order of the labelled work-order table.
LABELS = ["location", "object", "action", "numerator", "analysis",
          "description", "conjunction", "noise"]

# Label domain in the order the sequence model lists it.
MODEL_LABELS = ["noise", "location", "object", "description", "action",
                "numerator", "conjunction", "analysis"]

# Extra column for the second and later object runs.
OBJECT2 = "object2"

# Label columns melted into typed entities (conjunction, noise, object2 are not).
ENTITY_TYPES = ["location", "object", "action", "numerator", "analysis",
                "description"]

# Token pattern: "c/o"; a word with optional leading ( " ' and trailing
# . , ; : ' " ) whose body has no blank or / , ; # & ( ); or one of # & @ /.
TOKEN_PATTERN = r"""(?i)\bc/o\b|[("']*\b[^\s/,;#&()]+\b[.,;:'")]*|[#&@/]"""

# Characters padded with blanks before spell checking.
PAD_PUNCTUATION_PATTERN = r"""(["/:\[\]().,'\\])"""

# Vowels for the has.vowels feature.
VOWELS = "aeiouy"

# Label typo patches: on training lines, and on predicted labels.
TRAINING_LABEL_FIXES = [("anlysis", "analysis")]
PREDICTED_LABEL_FIXES = [("decription", "description"), ("inspect", "action")]

# Sentinel that shields replaced text from later abbreviation rules.

# Built-in abbreviation map (phrase -> replacement), in original order.
BUILTIN_SYNONYMS = [
    ("MEDICE", "medicine"),
    ("&amp;", "and"),
    ("--", "-"),
    ("A/C", "AC"),
    ("B/R", "BEDROOM"),
    ("L/R", "LIVINGROOM"),
    ("tnx", "thanks"),
    ("Tnk", "thanks"),
    ("tnk", "thanks"),
    ("bedrm", "bedroom"),
    ("Bthrm", "bathroom"),
    ("pls", "please"),
    ("BRKN", "BROKEN"),
    ("LVRM", "LIVINGROOM"),
    ("HALWAY", "HALLWAY"),
    ("Patchup", "Patch up"),
    ("RCYCLING", "RECYCLING"),
    ("pcs", "pieces"),
]

PREPOSITIONS = [
    "aboard", "about", "above", "across", "after", "against", "along", "amid",
    "among", "anti", "around", "as", "at", "before", "behind", "below",
    "beneath", "beside", "besides", "between", "beyond", "but", "by",
    "concerning", "considering", "despite", "down", "during", "except",
    "excepting", "excluding", "following", "for", "from", "in", "inside",
    "into", "like", "minus", "near", "of", "off", "on", "onto", "opposite",
    "outside", "over", "past", "per", "plus", "regarding", "round", "save",
    "since", "than", "through", "to", "toward", "towards", "under",
    "underneath", "unlike", "until", "up", "upon", "versus", "via", "with",
    "within", "without",
]

LOCATIONS = [
    "kitchen", "office", "deck", "landscaping", "front", "bedroom", "touch",
    "apartment", "window", "bedrooms", "community", "basement", "hall", "bank",
    "areas", "lanscape", "h", "l", "garage", "tower", "side", "back", "escape",
    "7th", "living", "closet", "hallways", "outside", "exit", "c19h", "27a",
    "mailbox", "courtyard", "kitcnen", "kitchen", "water", "bdrms",
    "landscapes", "turn", "circuit", "grounds", "garbage", "wall", "apt",
    "bath", "bthrm", "1st", "unit", "bathroom", "area", "elevator", "halls",
    "entrance", "door", "line", "tank", "room", "roof", "shower", "r", "bdrm",
    "35th", "toilet", "bathrooms", "look", "ceiling", "wal ks", "balcony",
    "livingroom", "floor", "dining", "hot", "electrical", "stock", "livingr",
    "hallway", "laundry", "staircase", "pathways", "stairwell", "coming",
    "backyard", "fl", "lobby", "building", "lawn", "light", "clean", "4e",
]

OBJECTS = [
    "heater", "stove", "rod", "spreadsheet", "radiators", "debris", "oven",
    "signs", "dish", "fixtures", "toilets", "c", "aerator", "microw", "window",
    "combo", "weather", "blinds", "knob", "tiles", "handle", "radiator",
    "intercom", "cover", "ceil", "units", "walls", "dryer", "fan", "outlet",
    "front", "bar", "sill", "conditi on", "vanity", "towel", "sleeve",
    "hinges", "list", "holes", "backsplash", "micro", "egress", "trap", "pane",
    "fence", "frame", "fixture", "seat", "flush", "cold", "heaters", "flower",
    "closet", "pictures", "pipes", "valve", "burner", "microwave", "lights",
    "medicine", "washer", "moldings", "sheetrock", "screen", "water", "sink",
    "key", "carbon", "tub", "roller", "kitchen", "on", "faucet", "hinge",
    "range", "smoke", "head", "repair", "garbage", "wall", "vent", "ac",
    "bath", "down", "guard", "floors", "appliances", "unit", "bulbs", "top",
    "system", "elevator", "cords", "panel", "a", "ceiling", "door", "detecto",
    "shelf", "gas", "dishwasher", "cabinet", "glass", "broke", "bulb", "sign",
    "holder", "basin", "grill", "waste", "tank", "look", "air", "shower",
    "sour", "bathtub", "toilet", "cylinder", "lock", "entrance", "covers",
    "as", "bend", "exterior", "gasket", "conditioner", "tiling", "showerhead",
    "countertop", "cabinets", "court", "monoxide", "floor", "drains", "wiring",
    "snow", " freezer", "machine", "guards", "refridgerator", "electrical",
    "inventory", "doors", "tile", "detector", "wires", "electric", "living",
    "outlets", "fridge", "boiler", "coming", "device", "plugs",
    "refrigerator", "sprinkler", "building", "drain", "windows", "light",
    "alarm", "metal", "boxes", "pipe", "switch", "compactor", "breaker",
    "tubes", "wind",
]

# Gazetteer membership needs a raw token longer than this.
GAZETTEER_MIN_LENGTH = 3

# Average cluster size target: k = n // 5 per type.
MEMBERS_PER_CLUSTER = 5

# Longest n-gram considered for IDF and segmentation.
MAX_NGRAM = 4

# Row limits of the quick and the full labelling run.
