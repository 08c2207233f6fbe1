"""Fixed tables of the domain. The values are given by the formats and rules that the engine reproduces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Scripts with their code point ranges, in the order that breaks ties.
SCRIPTS = [
    ("eng", 0x0020, 0x007F),
    ("hin", 0x0900, 0x097F),
    ("tam", 0x0B80, 0x0BFF),
    ("tel", 0x0C00, 0x0C7F),
    ("kan", 0x0C80, 0x0CFF),
    ("mal", 0x0D00, 0x0D7F),
]
LANGS = [code for code, _, _ in SCRIPTS]

# Three-letter code, two-letter code, name.
LANGUAGES = [
    ("eng", "en", "English"),
    ("hin", "hi", "Hindi"),
    ("tam", "ta", "Tamil"),
    ("tel", "te", "Telugu"),
    ("kan", "kn", "Kannada"),
    ("mal", "ml", "Malayalam"),
]

# Order in which scripts are probed.
PROBE_ORDER = ["eng", "hin", "tam", "kan", "tel", "mal"]

# Abbreviations that do not end a sentence.
ABBREVIATIONS = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "vs.", "e.g.", "i.e.", "etc.", "Vol.", "No."]

# Recognition variants in order, whether fast mode makes them, rank in evaluation.
VARIANTS = [
    ("original_gray", 1, True, 1),
    ("contrast_enhanced", 2, True, None),
    ("clahe", 3, True, 2),
    ("illumination_corrected", 4, True, 3),
    ("otsu", 5, True, 4),
    ("adaptive_gaussian", 6, True, 5),
    ("mild_denoised", 7, False, None),
    ("sharpened", 8, False, None),
    ("upscaled_gray", 9, False, None),
    ("upscaled_threshold", 10, False, None),
]
#: Variants that are made only while both sides are below this.
UPSCALED, UPSCALE_LIMIT = ("upscaled_gray", "upscaled_threshold"), 2400
PSMS, FALLBACK_PSM = [4, 6], 3

# States and the moves between them.
EDGES = {
    "INITIALIZING": ["WAIT_WAKE_WORD", "ERROR", "STOPPED"],
    "WAIT_WAKE_WORD": ["ASK_PREFERENCES", "WAIT_START", "STOPPED", "ERROR"],
    "ASK_PREFERENCES": ["WAIT_START", "ALIGNING_PAGE", "WAIT_WAKE_WORD", "STOPPED", "ERROR"],
    "WAIT_START": ["ALIGNING_PAGE", "WAIT_WAKE_WORD", "STOPPED", "ERROR"],
    "ALIGNING_PAGE": ["PROCESSING_PAGE", "WAIT_START", "WAIT_WAKE_WORD", "STOPPED", "ERROR"],
    "PROCESSING_PAGE": ["READING", "ALIGNING_PAGE", "WAIT_START", "STOPPED", "ERROR"],
    "READING": ["PAUSED", "PAGE_FINISHED", "ALIGNING_PAGE", "STOPPED", "ERROR"],
    "PAUSED": ["READING", "ALIGNING_PAGE", "PAGE_FINISHED", "STOPPED", "ERROR"],
    "PAGE_FINISHED": ["ALIGNING_PAGE", "READING", "WAIT_START", "WAIT_WAKE_WORD", "STOPPED", "ERROR"],
    "STOPPED": ["INITIALIZING", "WAIT_WAKE_WORD"],
    "ERROR": ["INITIALIZING", "WAIT_WAKE_WORD", "WAIT_START", "STOPPED"],
}
STATES = list(EDGES)

# Light pattern of each state; the other states set none.
LEDS = {
    "WAIT_WAKE_WORD": "SLOW_PULSE",
    "ASK_PREFERENCES": "SOLID_ON",
    "WAIT_START": "SLOW_PULSE",
    "ALIGNING_PAGE": "SLOW_PULSE",
    "PROCESSING_PAGE": "FAST_BLINK",
    "READING": "SOLID_ON",
    "PAUSED": "SLOW_PULSE",
    "PAGE_FINISHED": "SOLID_ON",
    "ERROR": "ERROR_BLINK",
}

# What a heard intent (V:), a button (B:), an outside command (X:) or an outcome (P:) asks for in a state.
RULES = [
    ("WAIT_WAKE_WORD", "V:WAKE_WORD", "ASK_PREFERENCES"),
    ("WAIT_WAKE_WORD", "V:START_READING", "ASK_PREFERENCES"),
    ("WAIT_WAKE_WORD", "V:STOP_READING", "STOPPED"),
    ("ASK_PREFERENCES", "V:PREF_ORIGINAL", "WAIT_START"),
    ("ASK_PREFERENCES", "V:PREF_TRANSLATE", "WAIT_START"),
    ("ASK_PREFERENCES", "V:START_READING", "ALIGNING_PAGE"),
    ("ASK_PREFERENCES", "V:UNKNOWN", "WAIT_START"),
    ("WAIT_START", "V:START_READING", "ALIGNING_PAGE"),
    ("WAIT_START", "V:STOP_READING", "STOPPED"),
    ("ALIGNING_PAGE", "P:PAGE_STABLE", "PROCESSING_PAGE"),
    ("PROCESSING_PAGE", "P:CAPTURE_FAILED", "ALIGNING_PAGE"),
    ("PROCESSING_PAGE", "P:NO_TEXT", "ALIGNING_PAGE"),
    ("PROCESSING_PAGE", "P:DUPLICATE", "ALIGNING_PAGE"),
    ("PROCESSING_PAGE", "P:PAGE_READY", "READING"),
    ("READING", "P:ALL_READ", "PAGE_FINISHED"),
    ("PAGE_FINISHED", "V:NEXT_PAGE", "ALIGNING_PAGE"),
    ("PAGE_FINISHED", "V:START_READING", "ALIGNING_PAGE"),
    ("PAGE_FINISHED", "V:REPEAT", "READING"),
    ("PAGE_FINISHED", "V:STOP_READING", "STOPPED"),
    ("ERROR", "P:RECOVERED", "WAIT_START"),
    ("WAIT_WAKE_WORD", "B:POWER_PRESS", "ALIGNING_PAGE"),
    ("WAIT_START", "B:POWER_PRESS", "ALIGNING_PAGE"),
    ("READING", "B:POWER_PRESS", "PAUSED"),
    ("PAUSED", "B:POWER_PRESS", "READING"),
    ("PAGE_FINISHED", "B:POWER_PRESS", "ALIGNING_PAGE"),
    ("*", "B:POWER_LONG_PRESS", "STOPPED"),
    ("READING", "X:PAUSE", "PAUSED"),
    ("PAUSED", "X:RESUME", "READING"),
    ("READING", "X:REPEAT", "READING"),
    ("PAUSED", "X:REPEAT", "READING"),
    ("PAGE_FINISHED", "X:REPEAT", "READING"),
    ("*", "X:NEXT_PAGE", "ALIGNING_PAGE"),
    ("*", "X:STOP_READING", "STOPPED"),
]

# Language names that set the language, and their codes.
SPOKEN_LANGUAGES = [
    ("english", "en"),
    ("tamil", "ta"),
    ("hindi", "hi"),
    ("kannada", "kn"),
    ("telugu", "te"),
    ("malayalam", "ml"),
]

# Intents in the order in which their phrases are tried.
INTENTS = [
    ("START_READING", r"\b(?:start\s*reading|start|begin|read\s*now|read\s*book|read\s*page)\b"),
    ("PAUSE", r"\b(?:pause|hold|wait|stop\s*talking)\b"),
    ("RESUME", r"\b(?:resume|continue|keep\s*reading|go\s*on|unpause)\b"),
    ("REPEAT", r"\b(?:repeat|say\s*again|read\s*again|one\s*more\s*time|once\s*more)\b"),
    ("NEXT_PAGE", r"\b(?:next\s*page|next|turn\s*page|continue\s*reading|forward)\b"),
    ("PREVIOUS_PAGE", r"\b(?:previous\s*page|previous|prev|back|go\s*back)\b"),
    ("STOP_READING", r"\b(?:stop\s*reading|stop|quit|exit|cancel|terminate|shut\s*down)\b"),
    ("VOLUME_UP", r"\b(?:volume\s*up|louder|increase\s*volume|turn\s*up)\b"),
    ("VOLUME_DOWN", r"\b(?:volume\s*down|softer|quieter|decrease\s*volume|turn\s*down)\b"),
    ("PREF_ORIGINAL", r"\b(?:original\s*language|original|source|don'?t\s*translate)\b"),
    ("PREF_TRANSLATE", r"\b(?:translated\s*language|translate|translated|translation)\b"),
]

# Names that wake the device, one or several in a row, and the greetings that may come first.
WAKE_NAMES = ["vision", "voice"]
GREETINGS = ["hey", "ok", "okay", "hi"]


def wake_pattern(names: list[str], greetings: list[str]) -> str:
    return rf"\b(?:{'|'.join(greetings)})?\s*(?:{'|'.join(names)})(?:\s*(?:{'|'.join(names)}))*\b"


WAKE_WORD = wake_pattern(WAKE_NAMES, GREETINGS)

# Voices by two- or three-letter code, for two speech backends.
VOICES_DESKTOP = {"en": "Samantha", "hi": "Rishi", "ta": "Veena", "te": "Rishi", "kn": "Rishi", "ml": "Rishi"}
VOICES_BOARD = {"en": "en-us", "hi": "hi", "ta": "ta", "te": "te", "kn": "kn", "ml": "ml"}

ISO = {code3: iso for code3, iso, _ in LANGUAGES}
NAMES = {code: name for code3, iso, name in LANGUAGES for code in (code3, iso)}


def pairs(code3: str) -> list[str]:
    """Recognition languages to try for a script: itself beside English first."""
    return [code3] if code3 == "eng" else [f"{code3}+eng", code3]


def voice(language: str, board: bool) -> str:
    table = VOICES_BOARD if board else VOICES_DESKTOP
    return table[ISO.get(language, language)]


def table(spark: SparkSession, name: str) -> DataFrame:
    """A dimension table by name."""
    made = {
        "script_ranges": ([(c, lo, hi, i) for i, (c, lo, hi) in enumerate(SCRIPTS)], "lang string, lo int, hi int, ord int"),
        "language_codes": (LANGUAGES, "code3 string, iso string, name string"),
        "language_pairs": ([(c, i, p) for c in LANGS for i, p in enumerate(pairs(c))], "lang string, ord int, ocr_lang string"),
        "variants": (VARIANTS, "name string, ord int, in_fast boolean, eval_ord int"),
        "intent_patterns": ([(i, a, p) for i, (a, p) in enumerate(INTENTS)], "ord int, intent string, pattern string"),
        "led_by_state": (list(LEDS.items()), "state string, led string"),
        "fsm_edges": ([(a, b) for a, more in EDGES.items() for b in more], "from_state string, to_state string"),
        "fsm_rules": (RULES, "state string, trigger string, next_state string"),
    }
    rows, schema = made[name]
    return spark.createDataFrame(rows, schema)
