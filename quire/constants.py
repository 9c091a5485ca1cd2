"""Values results depend on.

Everything below is a fixed value: other tools read or write these words and
numbers, so they are stated as they are rather than derived.
"""

# --- fixed values: the catalog ------------------------------------------------
COLORS = ["W", "U", "B", "R", "G"]
RARITIES = ["common", "uncommon", "rare", "mythic"]
FINISHES = ["nonfoil", "foil", "etched"]
KINDS = ["card", "token", "artSeries"]
CARD_FLAGS = ["reserved", "gameChanger", "commander"]
PRINT_FLAGS = ["promo", "variation", "fullArt", "textless", "oversized"]
TOKEN_LAYOUTS = ["token", "double_faced_token", "emblem"]
ART_LAYOUTS = ["art_series"]
PLAIN_SET_TYPES = ["expansion", "core"]
TWO_SIDED_LAYOUTS = [
    "transform",
    "modal_dfc",
    "double_faced_token",
    "reversible_card",
    "art_series",
]
NO_ART = ["missing", "placeholder"]

COLOR_NAMES = {
    "white": "W",
    "blue": "U",
    "black": "B",
    "red": "R",
    "green": "G",
    "colorless": "",
    "c": "",
    "azorius": "WU",
    "dimir": "UB",
    "rakdos": "BR",
    "gruul": "RG",
    "selesnya": "GW",
    "orzhov": "WB",
    "izzet": "UR",
    "golgari": "BG",
    "boros": "RW",
    "simic": "GU",
    "bant": "GWU",
    "esper": "WUB",
    "grixis": "UBR",
    "jund": "BRG",
    "naya": "RGW",
    "abzan": "WBG",
    "jeskai": "URW",
    "sultai": "BGU",
    "mardu": "RWB",
    "temur": "GUR",
    "glint": "UBRG",
    "dune": "WBRG",
    "ink": "GWUR",
    "witch": "WUBG",
    "yore": "WUBR",
    "chaos": "UBRG",
    "aggression": "WBRG",
    "altruism": "GWUR",
    "growth": "WUBG",
    "artifice": "WUBR",
    "wubrg": "WUBRG",
    "five": "WUBRG",
}

# --- fixed values: one stack of copies ----------------------------------------
MAX_COPIES = 10000
MAX_LOTS = 64
MAX_TAGS = 32
TAG_BYTES = 64
NOTE_GRAPHEMES = 300
NOTE_BYTES = 3000
PART_ENTRIES = 199
PART_CHARS = 850000
GRADES = [
    "mint",
    "nearMint",
    "excellent",
    "good",
    "lightPlayed",
    "played",
    "poor",
]

# --- fixed values: ingest gates -----------------------------------------------
SKIP_SHARE = 0.01
SKIP_MINIMUM = 1000
KEEP_SHARE = 0.95
SHAPE_FIELDS = ["cmc", "finishes", "games", "legalities", "type_line"]
MAX_LINE_BYTES = 1 << 20

# --- fixed values: similarity -------------------------------------------------
KEEP_NEAREST = 5
APART = 65
SURE_MARGIN = 4
HASH_INSETS = [0.0, 0.03, 0.06, 0.09]
HASH_MIX = 0x9E3779B97F4A7C15
PROBE_SIZE = (64, 48)

# --- fixed values: passages ---------------------------------------------------
RUN_WORDS = 8

# --- fixed values: patterns ---------------------------------------------------
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MONEY_PATTERN = r"^[0-9]+(\.[0-9]+)?$"
CURRENCY_PATTERN = r"(?i)^[a-z]{3}$"
WHEN_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]|$)"
ADDRESSED_PATTERN = r"^[^.]+\.[0-9A-Fa-f]{16}\.[^.]+$"

# --- fixed values: vocabularies of the two CSV formats ------------------------
FINISH_IN = {
    "": "nonfoil",
    "normal": "nonfoil",
    "nonfoil": "nonfoil",
    "foil": "foil",
    "etched": "etched",
}
FINISH_OUT = {"nonfoil": "normal", "foil": "foil", "etched": "etched"}
TRUE_WORDS = ["true", "yes", "1"]
FLAG_TAGS = ["altered", "misprint", "signed"]
VENDOR_BINDING = {
    "scryfallId": "Scryfall ID",
    "name": "Name",
    "setCode": "Set code",
    "setName": "Set name",
    "collectorNumber": "Collector number",
    "rarity": "Rarity",
    "language": "Language",
    "finish": "Foil",
    "quantity": "Quantity",
    "condition": "Condition",
    "altered": "Altered",
    "misprint": "Misprint",
    "signed": "Signed",
    "proxy": "Proxy",
    "marketValue": "Purchase price",
    "marketCurrency": "Purchase price currency",
    "createdAt": "Added",
}
VENDOR_HEADER = [
    "Name",
    "Set code",
    "Set name",
    "Collector number",
    "Foil",
    "Rarity",
    "Quantity",
    "ManaBox ID",
    "Scryfall ID",
    "Purchase price",
    "Misprint",
    "Altered",
    "Signed",
    "Condition",
    "Language",
    "Proxy",
    "Purchase price currency",
    "Added",
]
OWN_BINDING = {
    "scryfallId": "Scryfall ID",
    "name": "Name",
    "setCode": "Set code",
    "setName": "Set name",
    "collectorNumber": "Collector number",
    "rarity": "Rarity",
    "language": "Language",
    "finish": "Finish",
    "quantity": "Quantity",
    "condition": "Condition",
    "container": "Container",
    "proxy": "Proxy",
    "tags": "Tags",
    "note": "Note",
    "price": "Price",
    "currency": "Price currency",
    "marketValue": "Market value",
    "marketCurrency": "Market value currency",
    "acquiredAt": "Acquired",
    "createdAt": "Added",
    "updatedAt": "Updated",
}
FILLED_FIELDS = ["setName", "rarity", "language"]

# --- fixed values: languages a label's last piece may name --------------------
LABEL_LANGS = [
    "ar",
    "de",
    "dw",
    "en",
    "es",
    "fr",
    "grc",
    "he",
    "it",
    "ja",
    "ko",
    "la",
    "ph",
    "pt",
    "qya",
    "ru",
    "sa",
    "zhs",
    "zht",
]
