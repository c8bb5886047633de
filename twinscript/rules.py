"""Rule values the results depend on.

Everything here is a parameter default; operators take other tables or values
where a caller has their own.
"""

# Script classes, as bodies of a regex bracket expression.
SCRIPT_ANY = "぀-ゟ゠-ヿㇰ-ㇿ㐀-䶿一-鿿　-〿＀-￯"
SCRIPT_CORE = "぀-ゟ゠-ヿㇰ-ㇿ㐀-䶿一-鿿"
SCRIPT_COST = "぀-ヿ㐀-鿿々〆ヵヶ"

# Marks left out of the strict script count.
NON_LEXICAL_MARKS = "・　"

# Words kept in lower case inside a title.
SMALL_WORDS = [
    "a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on",
    "or", "per", "the", "to", "via", "vs",
]

# Source punctuation and its replacement in normalised text.
PUNCTUATION = {
    "、": ", ",
    "。": ". ",
    "「": '"',
    "」": '"',
    "／": "/",
    "・": "·",
    "　": " ",
}

# The mechanics variant of the same table.
MECHANICS_PUNCTUATION = {
    "、": ", ",
    "。": ". ",
    "「": '"',
    "」": '"',
    "／": "/",
    "　": " ",
    "・": "•",
    "：": ":",
    "；": ";",
}

# The table the punctuation checker reports against.
CHECKED_PUNCTUATION = {
    "、": ", ",
    "。": ". ",
    "「": '"',
    "」": '"',
    "／": "/",
    "・": "•",
    "　": " ",
}

# Phrases to avoid and what to write instead, in match order.
BANNED_PHRASES = {
    "leveraging": "using",
    "leveraged": "used",
    "leverages": "uses",
    "utilize": "use",
    "utilise": "use",
    "cutting-edge": "advanced",
    "world-class": "high-quality",
    "leverage": "use",
    "synergy": "collaboration",
    "robust": "reliable",
    "cutting edge": "advanced",
}

# Renderings that should give way to the glossary term.
ALTERNATIVES = {
    "導入": ["introduction", "deployment", "rollout"],
    "実装": ["development", "creation", "building"],
    "システム": ["platform", "solution", "tool"],
}

# Longest target/source length ratio by kind of segment.
LENGTH_LIMITS = {"title": 1.8, "body": 1.4, "bullet": 1.4, "table": 1.2}
LENGTH_LIMIT_DEFAULT = 1.4

# Issue categories that fail the gate on their own.
CRITICAL_CATEGORIES = ["japanese_residual", "formatting_tag_issues"]

# Size of the prompt prefix that is never discounted, in tokens.
CACHED_PREFIX_FLOOR = 1024

DEFAULT_TOKENIZER = "o200k_base"

# USD per million tokens, as (in, in_cached, out, cached_write, cached_read).
MODEL_PRICES = {
    "openai:gpt-5": (1.25, 0.125, 10.00, None, None),
    "openai:gpt-5-mini": (0.25, 0.025, 2.00, None, None),
    "openai:gpt-5-nano": (0.05, 0.005, 0.40, None, None),
    "openai:gpt-4o": (2.50, 1.25, 10.00, None, None),
    "openai:gpt-4o-mini": (0.60, 0.30, 2.40, None, None),
    "openai:gpt-4.1": (None, None, None, None, None),
    "anthropic:claude-opus-4.1": (15.00, None, 75.00, 18.75, 1.50),
    "anthropic:claude-sonnet-4": (3.00, None, 15.00, 3.75, 0.30),
    "anthropic:claude-haiku-3.5": (0.80, None, 4.00, 1.00, 0.08),
    "google:gemini-1.5-pro": (1.25, None, 5.00, None, None),
    "google:gemini-1.5-flash": (0.075, None, 0.30, None, None),
    "google:gemini-1.5-flash-8b": (0.0375, None, 0.15, None, None),
    "google:gemini-2.0-flash": (0.10, None, 0.40, None, None),
    "cohere:command": (1.00, None, 2.00, None, None),
    "cohere:command-r-plus": (2.50, None, 10.00, None, None),
    "cohere:command-light": (0.30, None, 0.60, None, None),
}

# Patterns of fragile spans, and of the numbers and links counted
# when text is split over two places.
FRAGILE_URL = r"(?U)https?://[^\s]+|\b[\w.%-]++@[\w.-]+\.[A-Za-z]{2,}\b"
FRAGILE_NUMBER = r"(?U)(?<!\w)\d[\d,.\-–%]*"
FRAGILE_CODE = r"(?U)(?<!⟦)\b[A-Z]{2,}[A-Z0-9\-_.]*\d+[A-Z0-9\-_.]*\b"
COUNTED_NUMBER = r"(?U)\d+(?:[,.]?\d+)*[%％]?"
COUNTED_URL = r"(?U)https?://\S+|www\.\S+"

# Title rule and audit limits.
TITLE_MAX_WORDS = 12
BULLET_MAX_CHARS = 200
GATE_MAX_ISSUES = 10

# Batch and estimate defaults.
TRANSLATE_BATCH = 40
REQUEST_BATCH = 16
EXPANSION = 1.45
CHARS_PER_TOKEN = 4.0
