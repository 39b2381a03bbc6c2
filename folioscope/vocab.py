"""Closed vocabularies and thresholds of the domain."""

# Kind word -> (unit type, environment).
KINDS = {
    "definition": ("definition", "def"),
    "theorem": ("theorem", "thm"),
    "lemma": ("lemma", "lem"),
    "proposition": ("proposition", "prop"),
    "corollary": ("corollary", "cor"),
    "example": ("example", "ex"),
    "remark": ("remark", "rem"),
    "exercise": ("exercise", "exr"),
}
# Names and valid values of types and environments.
KEYWORDS = tuple(k.capitalize() for k in KINDS)
TYPE_TO_ENV = {t: e for t, e in KINDS.values()} | {"other": "rem"}
VALID_ENVS_V2 = ("def", "thm", "lem", "prop", "cor", "ex", "rem", "exr")
VALID_ENVS_V1 = ("def", "thm", "lem", "prop", "cor", "ex", "rem")
# Environments collapse to these types in label- and block-level scoring.
ENV_TO_TYPE = {
    "def": "definition",
    "thm": "theorem",
    "lem": "lemma",
    "prop": "proposition",
    "cor": "corollary",
    "ex": "example",
    "rem": "other",
    "exr": "other",
}
VALID_TYPES = ("definition", "theorem", "lemma", "proposition", "corollary", "example", "other")
THEOREM_LIKE = ("theorem", "lemma", "proposition", "corollary")
# Groups of types reported together.
TYPE_GROUPS = {
    "definition": ("definition",),
    "theorem_group": THEOREM_LIKE,
    "example": ("example",),
    "other": ("other",),
}
# Spellings a model may use for a unit type.
TYPE_ALIASES = {
    "def": "definition",
    "definition": "definition",
    "thm": "theorem",
    "theorem": "theorem",
    "lem": "lemma",
    "lemma": "lemma",
    "prop": "proposition",
    "proposition": "proposition",
    "cor": "corollary",
    "corollary": "corollary",
    "ex": "example",
    "example": "example",
    "other": "other",
}
# Abbreviations of kind words in labels and citations.
KIND_ABBREVIATIONS = {
    "def": "definition",
    "defn": "definition",
    "thm": "theorem",
    "theor": "theorem",
    "lem": "lemma",
    "prop": "proposition",
    "cor": "corollary",
    "coroll": "corollary",
    "ex": "example",
    "exmp": "example",
    "exam": "example",
    "rem": "remark",
    "rmk": "remark",
    "exerc": "exercise",
    "exer": "exercise",
    "exr": "exercise",
}

#: Every kind of blank that may stand between words (space class of a regular expression).
BLANKS = r"[\s   -   　]"
