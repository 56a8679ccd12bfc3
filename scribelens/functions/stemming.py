"""English (Porter2) stemming of token arrays.

The algorithm is the published Porter2 description. Spark ships batches of token arrays as
Arrow lists; each batch is dictionary-encoded, so a term is stemmed once per batch however
often it occurs, and a hot term never becomes a shuffle key.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the Porter2 algorithm.
VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")
R1_PREFIXES = ("gener", "commun", "arsen")
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED_AFTER_PLURAL = frozenset(
    ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
)
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize", "ion",
)


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _region(word: str, start: int) -> int:
    """Index after the first non-vowel that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return (
        len(word) > 2
        and word[-3] not in VOWELS
        and word[-2] in VOWELS
        and word[-1] not in VOWELS
        and word[-1] not in "wxY"
    )


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _participle(w: str, r1: int) -> str:
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return w
    base = w[: -len(suffix)]
    if suffix.startswith("eed"):
        return base + "ee" if len(base) >= r1 else w
    if not _has_vowel(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    if len(base) <= r1 and _ends_short(base):
        return base + "e"
    return base


def _derived(w: str, r1: int, r2: int) -> str:
    suffix = _longest(w, STEP_2)
    if suffix is not None and len(w) - len(suffix) >= r1:
        base = w[: -len(suffix)]
        if suffix == "ogi":
            allowed = base.endswith("l")
        elif suffix == "li":
            allowed = base[-1:] in LI_ENDINGS
        else:
            allowed = True
        if allowed:
            w = base + STEP_2[suffix]
    suffix = _longest(w, STEP_3)
    if suffix is not None and len(w) - len(suffix) >= (r2 if suffix == "ative" else r1):
        w = w[: -len(suffix)] + STEP_3[suffix]
    suffix = _longest(w, STEP_4)
    if suffix is not None and len(w) - len(suffix) >= r2:
        base = w[: -len(suffix)]
        if suffix != "ion" or base.endswith(("s", "t")):
            w = base
    return w


def _final(w: str, r1: int, r2: int) -> str:
    base = w[:-1]
    if w.endswith("e") and (len(base) >= r2 or (len(base) >= r1 and not _ends_short(base))):
        return base
    if w.endswith("ll") and len(base) >= r2:
        return base
    return w


@lru_cache(maxsize=1 << 18)
def porter2(token: str) -> str:
    """Stem of one token; the token is expected in lower case."""
    if len(token) <= 2:
        return token
    if token in WHOLE_WORDS:
        return WHOLE_WORDS[token]
    w = token.removeprefix("'")
    # A y that acts as a consonant is written Y until the end.
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in VOWELS):
            chars[i] = "Y"
    marked = "Y" in chars and "Y" not in token
    w = "".join(chars)
    prefix = next((p for p in R1_PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1)
    possessive = _longest(w, ("'", "'s", "'s'"))
    if possessive:
        w = w[: -len(possessive)]
    w = _plural(w)
    if w not in UNCHANGED_AFTER_PLURAL:
        w = _participle(w, r1)
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
            w = w[:-1] + "i"
        w = _final(_derived(w, r1, r2), r1, r2)
    return w.replace("Y", "y") if marked else w


@F.arrow_udf(ArrayType(StringType()))
def stem_arrays(tokens: pa.Array) -> pa.Array:
    flat = pc.fill_null(tokens.flatten(), "").dictionary_encode()
    stems = pa.array([porter2(t) for t in flat.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(tokens), 0)
    ends = pc.cumulative_sum(lengths)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, stems.take(flat.indices))


@F.arrow_udf(StringType())
def stem_terms(terms: pa.Array) -> pa.Array:
    return pa.array([None if t is None else porter2(t) for t in terms.to_pylist()], pa.string())
