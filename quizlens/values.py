"""The questions, names, labels and per-model settings in use.

Everything in this file is data. Code that needs it takes it as a parameter
with these values as the default.
"""

from __future__ import annotations

from typing import NamedTuple

# --- Fixed values: questions put to every picture, by language and turn ------
PROMPTS = {
    "ita": {
        1: "Qual è il soggetto rappresentato in questa immagine?",
        2: "Sei a CITY, qual è il soggetto rappresentato in questa immagine?",
    },
    "eng": {
        1: "Which is the subject captured in this picture?",
        2: "You are in CITY, which is the subject captured in this picture?",
    },
}
CITY_SLOT = "CITY"
DEFAULT_LANG = "eng"

# --- Fixed values: raw model name in the graded files -> display name --------
DISPLAY_NAMES = {
    "BING_GPT-4": "Bing w/ GPT4",
    "Phi3": "Phi-3.5",
    "cogvlm2": "CogVLM2",
    "deepseekvl": "Deepseek-vl",
    "internvl2": "InternVL2",
    "llava1.6": "Llava-1.6",
    "molmo": "Molmo",
    "pixtral2": "Pixtral",
    "qwen2vl": "Qwen2-VL",
    "smolvlm": "SmolVLM",
}

# --- Fixed values: outcome labels, in display order --------------------------
OK = "OK"
OUTCOMES = ("OK", "NO", "ERR")
LANG_TAGS = {"eng": " (EN)", "ita": " (IT)"}
LANG_SUFFIX_LENGTH = 4

# --- Fixed values: picture sources, in gallery order, and gallery settings ---
SOURCES = ("flore", "wiki", "other")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg")
EXCLUDED_NAME_PART = "portici"
PICTURE_NAME_NOISE = "/Portici"
GALLERY_ROWS = 8
GALLERY_COLS = 5

# --- Fixed values: tile planning ---------------------------------------------
TILE_SIZE = 448
MIN_TILES = 1
MAX_TILES = 12

# --- Fixed values: text cleaning ---------------------------------------------
END_OF_TEXT = "<|end_of_text|>"
ECHO_BEFORE = "[INST] "
ECHO_AFTER = " [/INST] "
RENDERED_PREFIX_EXCESS = 7

# --- Fixed values: white space as Python's str methods and re module see it --
# (BMP code points; the second form is the same class for RE2 patterns)
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


class ModelPolicy(NamedTuple):
    """How one model is asked, and how its answers are cleaned.

    ``clean_1``/``clean_2`` name steps of :mod:`quizlens.functions.cleaning`.
    """

    model: str
    history: bool  # second question sees the first question and its answer
    image_in_turn_2: bool  # second request carries the picture
    image_first: bool  # the picture precedes the question in its turn
    blank_turn: bool  # an empty assistant turn closes every request
    raw_history: bool  # history holds the answer before cleaning
    max_new_tokens: int
    decoding: str
    clean_1: tuple[str, ...]
    clean_2: tuple[str, ...]


# --- Fixed values: one row per model -----------------------------------------
POLICIES = (
    ModelPolicy("cogvlm2", True, False, False, False, False, 2048, "default",
                ("cut_marker", "collapse"), ("cut_marker", "collapse")),
    ModelPolicy("deepseekvl", True, True, True, True, False, 512, "greedy",
                ("collapse",), ("collapse",)),
    ModelPolicy("internvl2", True, True, True, False, False, 1024, "sampling",
                ("collapse",), ("collapse",)),
    ModelPolicy("llava1.6", True, True, False, False, False, 100, "default",
                ("collapse", "echo_1_wrapped"), ("collapse", "prefix")),
    ModelPolicy("molmo", False, True, False, False, False, 200, "stop string",
                ("collapse",), ("collapse",)),
    ModelPolicy("phi3", False, True, True, False, False, 1000, "greedy",
                (), ()),
    ModelPolicy("pixtral", True, True, False, False, False, 500, "default",
                ("echo_1", "collapse"), ("echo_1", "echo_2", "newlines", "collapse")),
    ModelPolicy("qwen2vl", True, True, True, False, False, 256, "default",
                ("collapse",), ("collapse",)),
    ModelPolicy("smolvlm", True, True, True, False, True, 500, "default",
                ("collapse",), ("collapse",)),
)
