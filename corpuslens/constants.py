"""Fixed values of the study: seeds, questionnaire forms, answers, corpus names."""

# --- fixed values: these must equal the study's own numbers for right results ---

DEFAULT_SEED = 42
RUN_SEEDS = [5904, 557, 1113, 4819, 6624, 269, 6429, 3929, 9085, 7906]

TRAITS = [
    "extroversion",
    "agreeableness",
    "conscientiousness",
    "emotional stability",
    "openness to experience",
]

ANSWERS = ["always", "often", "sometimes", "rarely", "never"]
ANSWER_POINTS = [5, 4, 3, 2, 1]

# Items that raise a trait; every other item of the trait lowers it. An item's
# trait follows from its number modulo 5.
TRAIT_BY_REMAINDER = {
    1: "extroversion",
    2: "agreeableness",
    3: "conscientiousness",
    4: "emotional stability",
    0: "openness to experience",
}
POSITIVE_ITEMS = {
    "original": [1, 11, 21, 31, 41, 7, 17, 27, 37, 42, 47, 3, 13, 23, 33, 43, 48, 9, 19,
                 5, 15, 25, 35, 40, 45, 50],
    "modified": [1, 6, 11, 21, 31, 36, 2, 7, 17, 22, 27, 32, 37, 42, 47, 3, 13, 23, 33, 43, 48,
                 9, 19, 5, 15, 20, 25, 30, 35, 40, 45, 50],
}
TRAIT_OFFSETS = {
    "original": {"extroversion": 20, "agreeableness": 14, "conscientiousness": 14,
                 "emotional stability": 38, "openness to experience": 8},
    "modified": {"extroversion": 14, "agreeableness": -4, "conscientiousness": 14,
                 "emotional stability": 38, "openness to experience": -4},
}
N_ITEMS = 50

# How the essay corpora shorten the traits, and the traits of the forum corpora.
ESSAY_CODES = {
    "extroversion": "ext",
    "agreeableness": "agr",
    "conscientiousness": "con",
    "emotional stability": "emo",
    "openness to experience": "opn",
}
REDDIT_TRAITS = [
    "extroversion",
    "agreeableness",
    "conscientiousness",
    "neuroticism",
    "openness to experience",
]

MASK = "[MASK]"
SPECIAL_TOKENS = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"]
VOCAB_SIZE = 32000
STATEMENT_COPIES = 100

# --- end of fixed values ---

UNK_ID, CLS_ID, SEP_ID, PAD_ID, MASK_ID = range(5)

PACK_BATCH_ROWS = 1000
STRICT_CHUNK = 128
FINAL_CHUNK = 256
MASK_PROBABILITY = 0.15
IGNORE_LABEL = -100


def slug(name: str) -> str:
    return name.replace(" ", "_")


def form_rows(form: str) -> list[tuple[int, str, int]]:
    """(item, trait, sign) for the 50 items of a form."""
    raised = set(POSITIVE_ITEMS[form])
    return [(i, TRAIT_BY_REMAINDER[i % 5], 1 if i in raised else -1) for i in range(1, N_ITEMS + 1)]
