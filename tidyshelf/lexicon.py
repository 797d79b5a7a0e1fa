"""Word lists, patterns and lookup tables.

FIXED VALUES: everything in this module is data that the results depend on. It is kept in its
natural order; for categories the order decides which alias wins (see ``operators.canonical``).
"""

from __future__ import annotations

import sys
import unicodedata

# FIXED VALUES: brand alias -> canonical brand.
BRAND_ALIASES: dict[str, str] = {
    # phones
    "apple": "Apple",
    "iphone": "Apple",
    "samsung": "Samsung",
    "oneplus": "OnePlus",
    "one plus": "OnePlus",
    "1+": "OnePlus",
    "xiaomi": "Xiaomi",
    "mi": "Xiaomi",
    "redmi": "Xiaomi",
    "poco": "Xiaomi",
    "realme": "Realme",
    "oppo": "Oppo",
    "vivo": "Vivo",
    "nokia": "Nokia",
    "motorola": "Motorola",
    "moto": "Motorola",
    "google": "Google",
    "pixel": "Google",
    "nothing": "Nothing",
    "iqoo": "iQOO",
    # computers
    "dell": "Dell",
    "hp": "HP",
    "hewlett-packard": "HP",
    "lenovo": "Lenovo",
    "asus": "Asus",
    "acer": "Acer",
    "msi": "MSI",
    "lg": "LG",
    "macbook": "Apple",
    # sound
    "sony": "Sony",
    "bose": "Bose",
    "jbl": "JBL",
    "sennheiser": "Sennheiser",
    "boat": "boAt",
    "noise": "Noise",
    "skullcandy": "Skullcandy",
    "jabra": "Jabra",
    "anker": "Anker",
    # television
    "tcl": "TCL",
    "hisense": "Hisense",
    "vu": "Vu",
    "mi tv": "Xiaomi",
    # shoes and clothes
    "nike": "Nike",
    "adidas": "Adidas",
    "puma": "Puma",
    "reebok": "Reebok",
    "asics": "ASICS",
    "new balance": "New Balance",
    "skechers": "Skechers",
    "bata": "Bata",
    "woodland": "Woodland",
    "campus": "Campus",
    "levi's": "Levi's",
    "levis": "Levi's",
    "h&m": "H&M",
    "zara": "Zara",
    "allen solly": "Allen Solly",
    # kitchen
    "philips": "Philips",
    "havells": "Havells",
    "bajaj": "Bajaj",
    "prestige": "Prestige",
    "hawkins": "Hawkins",
    "pigeon": "Pigeon",
    "lifelong": "Lifelong",
    "inalsa": "Inalsa",
    "morphy richards": "Morphy Richards",
    "wonderchef": "Wonderchef",
    "kent": "Kent",
    # games
    "razer": "Razer",
    "corsair": "Corsair",
    "steelseries": "SteelSeries",
    "hyperx": "HyperX",
    "logitech": "Logitech",
    "playstation": "Sony",
    "ps5": "Sony",
    "xbox": "Microsoft",
    "nintendo": "Nintendo",
    # books
    "penguin": "Penguin",
    "harper collins": "HarperCollins",
    "harpercollins": "HarperCollins",
    "oxford": "Oxford University Press",
    "scholastic": "Scholastic",
    # furniture
    "ikea": "IKEA",
    "urban ladder": "Urban Ladder",
    "pepperfry": "Pepperfry",
    "godrej": "Godrej",
    "nilkamal": "Nilkamal",
    "durian": "Durian",
}

# FIXED VALUES: category alias -> canonical category. Order matters: the first alias contained in
# an unmatched text wins, so "wireless headphones" is Mobile (through "phone").
CATEGORY_ALIASES: dict[str, str] = {
    "mobile": "Mobile",
    "smartphone": "Mobile",
    "phone": "Mobile",
    "cellphone": "Mobile",
    "iphone": "Mobile",
    "android": "Mobile",
    "laptop": "Laptop",
    "notebook": "Laptop",
    "macbook": "Laptop",
    "chromebook": "Laptop",
    "ultrabook": "Laptop",
    "headphone": "Headphones",
    "headphones": "Headphones",
    "earphones": "Headphones",
    "earbuds": "Headphones",
    "tws": "Headphones",
    "headset": "Headphones",
    "neckband": "Headphones",
    "speaker": "Headphones",
    "tv": "TV",
    "television": "TV",
    "smart tv": "TV",
    "oled": "TV",
    "qled": "TV",
    "shoes": "Shoes",
    "sneakers": "Shoes",
    "footwear": "Shoes",
    "sandals": "Shoes",
    "boots": "Shoes",
    "running shoes": "Shoes",
    "fashion": "Fashion",
    "clothing": "Fashion",
    "apparel": "Fashion",
    "shirt": "Fashion",
    "jeans": "Fashion",
    "dress": "Fashion",
    "t-shirt": "Fashion",
    "jacket": "Fashion",
    "kitchen appliance": "Kitchen Appliance",
    "kitchen": "Kitchen Appliance",
    "appliance": "Kitchen Appliance",
    "cookware": "Kitchen Appliance",
    "mixer": "Kitchen Appliance",
    "blender": "Kitchen Appliance",
    "air fryer": "Kitchen Appliance",
    "pressure cooker": "Kitchen Appliance",
    "gaming": "Gaming",
    "game": "Gaming",
    "console": "Gaming",
    "controller": "Gaming",
    "gaming mouse": "Gaming",
    "gaming keyboard": "Gaming",
    "book": "Book",
    "novel": "Book",
    "textbook": "Book",
    "ebook": "Book",
    "fiction": "Book",
    "non-fiction": "Book",
    "furniture": "Furniture",
    "sofa": "Furniture",
    "chair": "Furniture",
    "table": "Furniture",
    "bed": "Furniture",
    "wardrobe": "Furniture",
    "shelf": "Furniture",
    "unknown": "Unknown",
}

# FIXED VALUES: availability alias -> canonical availability.
AVAILABILITY_ALIASES: dict[str, str] = {
    "in stock": "In Stock",
    "instock": "In Stock",
    "available": "In Stock",
    "in-stock": "In Stock",
    "yes": "In Stock",
    "out of stock": "Out of Stock",
    "outofstock": "Out of Stock",
    "out-of-stock": "Out of Stock",
    "sold out": "Out of Stock",
    "no": "Out of Stock",
    "unavailable": "Out of Stock",
    "coming soon": "Coming Soon",
    "upcoming": "Coming Soon",
    "preorder": "Coming Soon",
    "pre-order": "Coming Soon",
    "notify me": "Coming Soon",
    "limited stock": "Limited Stock",
    "limited": "Limited Stock",
    "hurry": "Limited Stock",
    "only 1 left": "Limited Stock",
    "only 2 left": "Limited Stock",
    "only 3 left": "Limited Stock",
    "few left": "Limited Stock",
    "unknown": "Unknown",
}

# FIXED VALUES: currency spelling -> ISO code; everything else is DEFAULT_CURRENCY.
CURRENCY_CODES: dict[str, str] = {
    "inr": "INR",
    "₹": "INR",
    "rs": "INR",
    "rupee": "INR",
    "rupees": "INR",
    "usd": "USD",
    "$": "USD",
    "eur": "EUR",
    "€": "EUR",
}
DEFAULT_CURRENCY = "INR"

# FIXED VALUES: display symbols.
CURRENCY_SYMBOLS: dict[str, str] = {"INR": "₹", "USD": "$", "EUR": "€"}

# FIXED VALUES: the declared value sets, used only by the conformance report.
DECLARED_VALUES: dict[str, list[str]] = {
    "currency": ["INR", "USD", "EUR", "UNKNOWN"],
    "availability": ["In Stock", "Out of Stock", "Coming Soon", "Limited Stock", "Unknown"],
    "category": [
        "Mobile", "Laptop", "Headphones", "TV", "Shoes", "Fashion", "Kitchen Appliance",
        "Gaming", "Book", "Furniture", "Unknown",
    ],
}

# FIXED VALUES: words that mark a column as product text.
DESCRIPTIVE_WORDS: list[str] = [
    "description", "title", "name", "product", "item",
    "brand", "price", "offer", "discount", "availability",
    "stock", "delivery", "seller", "category", "badge",
    "detail", "spec", "feature",
]

# FIXED VALUES: CSV cells that pandas reads as missing (its documented defaults).
NA_TOKENS: list[str] = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# FIXED VALUES: cell texts (lower-cased) that never reach a merged description.
BLANK_WORDS: list[str] = ["nan", "none", ""]

# FIXED VALUES: price patterns, highest priority first, group 1 is the amount.
PRICE_PATTERNS: list[str] = [
    r"(?i)(?:sale|offer|discounted|now)[:\s]+(?:price)?[:\s]*(?:Rs\.?|INR|₹)?\s*([\d][\d,]*)",
    r"(?i)@\s*(?:Rs\.?|INR|₹)\s*([\d][\d,]*)",
    r"₹\s*([\d][\d,]+)",
    r"(?i)Rs\.?\s*([\d][\d,]*)",
    r"(?i)INR\s*([\d][\d,]*)",
    r"(?i)(?:selling\s+)?price[:\s]+[₹$€]?\s*([\d][\d,]*)",
    r"(?i)MRP[:\s]*[₹$€]?\s*([\d][\d,]*)",
]

# FIXED VALUES: discount patterns; their amounts are never prices.
DISCOUNT_PATTERNS: list[str] = [
    r"(?i)(?:flat|upto|up to|extra|additional|get|save|cashback|off|avail)[\s₹$€,Rs.]*([\d][\d,]*)"
    r"\s*(?:off|discount|cashback|back|rupees)",
    r"(?i)([\d][\d,]*)\s*(?:off|discount)",
]

# FIXED VALUES: bullet glyphs that become a newline.
BULLETS = "•·▪▸►◦‣⁃"

# FIXED VALUES: one-to-one punctuation repairs; the ellipsis "…" becomes "..." separately.
PUNCTUATION: dict[str, str] = {"‘": "'", "’": "'", "“": '"', "”": '"', "—": "-", "–": "-"}

# FIXED VALUES: control characters that are deleted (tab, LF and CR stay).
CONTROL_CLASS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# Python's idea of whitespace and decimal digits, by rule.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0" "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" "]"
)
DECIMAL_DIGITS = "".join(
    c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
)
DECIMAL_DIGITS_ASCII = "".join(str(unicodedata.decimal(c)) for c in DECIMAL_DIGITS)


def java_regex(pattern: str) -> str:
    """Spell a Python text pattern for Java: same ``\\s``, ``\\d`` and case folding."""
    out = pattern.replace(r"\s", WHITESPACE_CLASS).replace(r"\d", r"\p{Nd}")
    return "(?iu)" + out[4:] if out.startswith("(?i)") else out

# Where a reply keeps its JSON.
REPLY_FENCE = r"(?is)```(?:json)?\s*(.*?)```"
REPLY_BRACES = r"(?s)\{.*\}"
