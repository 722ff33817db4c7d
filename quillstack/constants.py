"""Fixed values of the dictionary, the wire formats and the library tables.

Everything here has to equal what existing dictionaries and streams were written with.
"""

from __future__ import annotations

# --- fixed values: alphabet of ids; a character's place is its value ---
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
#: First characters of ids of tiers 1 to 3.
FIRST = "ghijklmnopqrstuvwxyz"

# --- fixed values: ids of one character ---
SYSTEM_IDS = {"0": "STREAM_START", "1": "STREAM_END", "2": "CHUNK_BOUNDARY", "-": "ATTR_DELIMITER", "_": "CONTINUATION"}
#: Words of the ids A to Z, in order.
TIER0_WORDS = ["a", "be", "we", "do", "he", "of", "to", "have", "in", "on", "for", "they", "i", "and", "or", "not", "all", "she", "this", "the", "it", "with", "will", "but", "you", "that"]
#: Marks of the ids g to z and 3 to 9, in order.
TIER0_MARKS = [" ", "\n", "\t", ".", ",", ":", ";", "!", "?", "'", '"', "(", ")", "[", "]", "/", "\\", "-", "—", "&", "%", "$", "#", "@", "*", "+", "="]
RESERVED_IDS = dict(zip("abcdef", ["RESERVED_STAGE_PERCEPTION", "RESERVED_STAGE_NOVELTY", "RESERVED_STAGE_GOAL_PLAN", "RESERVED_STAGE_ACTION", "RESERVED_STAGE_PROGRESS", "RESERVED_STAGE_RESULT"], strict=True))
WORD_IDS = dict(zip(TIER0_WORDS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", strict=True))
MARK_IDS = dict(zip(TIER0_MARKS, "ghijklmnopqrstuvwxyz3456789", strict=True))
TIER0_IDS = {**WORD_IDS, **MARK_IDS}

#: Ids of each tier: one first character and as many others as the tier's number.
CAPACITY = {t: len(FIRST) * 64**t for t in (1, 2, 3)}
#: Tokens that get the first ids of tier 1, since the text stream needs them.
FORCED = ["|"]
#: Words that get ids of tier 1 before phrases compete.
TIER1_RESERVE = 1024
#: Last ranks of tiers 1 and 2 in the word library.
LIBRARY_RANKS = (1000, 10000)

# --- fixed values: mining ---
MIN_FREQ = 100
NGRAMS = (2, 9)
WORD_BYTES, PHRASE_BYTES = 1.8, 3
ABSORPTION = 0.7
HELD_OUT = ["KhyQCU6oqE8", "KOhbGjmidgs", "bRwFb8JmznE"]

# --- fixed values: profiles of integer ids ---
PROFILES = {"tiny": 32_496, "compact": 65_264, "standard": 130_800, "full": 261_872, "reference": None}
SPECIAL_TOKENS = ["PAD", "BOS", "EOS", "UNK", "SEP", "MASK", "CLS", "SYS", "USR", "AST", "TOOL", "RESULT", "PFX", "SFX", "MID", "RESERVED_15"]
BYTE_IDS = 256

# --- fixed values: wire formats ---
MAGIC, TEXT_VERSION, BINARY_VERSION = "ELO", 1, 2
OOV, CAP_TAG, OOV_TAG = "OOV", 0xFE, 0xFF
MOST_PHRASE_WORDS = 9

# --- fixed values: file formats ---
FORMATS = [".txt", ".md", ".json", ".csv", ".xml", ".html", ".htm", ".yaml", ".yml", ".log", ".srt", ".vtt"]
FORMAT_ALIASES = {".htm": ".html", ".yml": ".yaml"}

# --- fixed values: removal of repeats in recognised speech ---
REPEAT_WORDS, BOUNDARY_WORDS = (2, 12), (4, 60)

# --- fixed values: filler words by class, and what they say of the words beside them ---
FILLERS = {
    "COGNITIVE": ["uhh", "umm", "uhm", "um", "uh", "er", "hmm"],
    "DISCOURSE": ["alright", "okay", "right", "well", "like", "now", "so"],
    "VALIDATION": ["you know what i mean", "know what i mean", "know what im saying", "you feel me", "you see what i mean", "you know"],
    "HEDGE": ["more or less", "something like", "pretty much", "kind of", "sort of", "basically", "in a way", "almost"],
    "EMPHASIS": ["i mean it", "absolutely", "definitely", "seriously", "genuinely", "literally", "honestly", "actually", "truly"],
    "EMOTIONAL": ["here is the thing", "let me tell you", "i will say this", "hear me out", "the thing is", "i mean", "listen", "look"],
}
FILLER_WEIGHTS = {
    "COGNITIVE": {"certainty": -0.2, "cognitive_load": 0.3},
    "DISCOURSE": {"certainty": 0.0, "transition": 0.2},
    "VALIDATION": {"certainty": -0.1, "validation_need": 0.3},
    "HEDGE": {"certainty": -0.3, "commitment": -0.2},
    "EMPHASIS": {"certainty": 0.3, "commitment": 0.3},
    "EMOTIONAL": {"emotional_signal": 0.4, "importance": 0.3},
}
MODES = {
    "STABLE": {"filler_handling": "word_id_only", "phrase_detection": "exact_match", "word_lookup": "surface_direct", "output_format": "flat_stream", "preserve_case": True, "preserve_whitespace": True},
    "FLEX": {"filler_handling": "word_id_plus_class", "phrase_detection": "fuzzy_match", "word_lookup": "surface_direct", "output_format": "attributed_stream", "preserve_case": True, "preserve_whitespace": True},
}

# --- fixed values: word library ---
ROLES = {
    "DET": "determiner", "CCONJ": "conjunction", "SCONJ": "conjunction", "AUX": "auxiliary", "VERB": "verb", "NOUN": "noun", "PROPN": "proper_noun",
    "ADJ": "adjective", "ADV": "adverb", "PRON": "pronoun", "ADP": "preposition", "PART": "particle", "INTJ": "interjection", "NUM": "numeral",
}
POLE_SEEDS = {
    "E+": ["good", "wonderful", "excellent", "pleasant", "positive", "beautiful", "great", "nice"],
    "E-": ["bad", "terrible", "awful", "horrible", "negative", "nasty", "evil", "ugly"],
    "P+": ["strong", "powerful", "dominant", "forceful", "mighty", "potent", "heavy", "bold"],
    "P-": ["weak", "fragile", "powerless", "timid", "frail", "helpless", "small", "feeble"],
    "A+": ["active", "fast", "energetic", "dynamic", "lively", "quick", "vibrant", "alive"],
    "A-": ["passive", "slow", "calm", "inactive", "still", "quiet", "sluggish", "dormant"],
}
STAGES = {
    "STAGE_PERCEPTION": (0.0, 0.0, 0.5),
    "STAGE_NOVELTY": (0.5, 0.0, 0.5),
    "STAGE_GOAL_PLAN": (0.5, 0.5, -0.2),
    "STAGE_ACTION": (0.0, 0.6, 0.6),
    "STAGE_PROGRESS": (0.3, 0.5, 0.3),
    "STAGE_RESULT": (0.6, 0.2, -0.3),
}
