"""Stems of English and French words by the published Snowball algorithms."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the English algorithm: letters, whole words with stems of their own, words that stay, suffixes by step.
EN_VOWELS = "aeiouy"
EN_STARTS = ("gener", "commun", "arsen")
EN_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
EN_STAY = frozenset("sky news howe atlas cosmos bias andes".split())
EN_STOP = frozenset("inning outing canning herring earring proceed exceed succeed".split())
EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

# Fixed values of the French algorithm: vowels, suffixes by step.
FR_VOWELS = "aeiouyâàëéêèïîôûù"
FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FR_ATION = "atrice ateur ation atrices ateurs ations".split()
FR_SWAPS = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FR_ITY, FR_IVE, FR_EUSE, FR_MENT, FR_EMENT, FR_ISSEMENT = ("ité", "ités"), ("if", "ive", "ifs", "ives"), ("euse", "euses"), ("ment", "ments"), ("ement", "ements"), ("issement", "issements")
FR_STEP1 = (*FR_PLAIN, *FR_ATION, *FR_SWAPS, *FR_ITY, *FR_IVE, *FR_EUSE, *FR_MENT, *FR_EMENT, *FR_ISSEMENT, "eaux", "aux", "amment", "emment")
FR_VERBS_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante "
    "issantes issants isse issent isses issez issiez issions issons it"
).split()
FR_VERBS_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FR_VERBS_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _longest(word: str, suffixes: Iterable[str], start: int = 0) -> str:
    """The longest of ``suffixes`` that ``word`` ends with and that begins at ``start`` or later; "" without one."""
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start), key=len, default="")


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the region behind the first non-vowel after a vowel from ``start`` on begins."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    """Whether an English word ends in a short syllable."""
    return bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


def english(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2 or word in EN_STAY:
        return word
    if word in EN_WORDS:
        return EN_WORDS[word]
    w = word.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    begun = next((s for s in EN_STARTS if w.startswith(s)), "")
    r1 = len(begun) if begun else _region(w, EN_VOWELS)
    r2 = _region(w, EN_VOWELS, r1)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    has_vowel = lambda x: any(c in EN_VOWELS for c in x)
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in EN_STOP:
        return w
    # step 1b
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if len(w) - len(suffix) >= r1:
            w = w[: len(w) - len(suffix)] + "ee"
    elif suffix and has_vowel(w[: -len(suffix)]):
        w = w[: -len(suffix)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(EN_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in EN_VOWELS:
        w = w[:-1] + "i"
    for suffixes in (EN_STEP2, EN_STEP3):
        suffix = _longest(w, suffixes)
        at = len(w) - len(suffix)
        allowed = {"li": at > 0 and w[at - 1] in "cdeghkmnrt", "ogi": at > 0 and w[at - 1] == "l", "ative": at >= r2}.get(suffix, True)
        if suffix and at >= r1 and allowed:
            w = w[:at] + suffixes[suffix]
    # step 4
    suffix = _longest(w, EN_STEP4)
    at = len(w) - len(suffix)
    if suffix and at >= r2 and (suffix != "ion" or at > 0 and w[at - 1] in "st"):
        w = w[:at]
    # step 5
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


class _French:
    """A French word in the course of its stemming, with its regions."""

    def __init__(self, word: str):
        v = FR_VOWELS
        w = re.sub("(?<=q)u", "U", word)
        w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
        self.w = w = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", w)
        if w.startswith(("par", "col", "tap")) or len(w) > 2 and w[0] in v and w[1] in v:
            self.rv = 3
        else:
            m = re.compile(f"[{v}]").search(w, 1)
            self.rv = m.end() if m else len(w)
        self.r1 = _region(w, v)
        self.r2 = _region(w, v, self.r1)

    def cut(self, suffix: str, region: int, new: str = "") -> bool:
        """Puts ``new`` for an ending in a region."""
        if suffix and self.w.endswith(suffix) and len(self.w) - len(suffix) >= region:
            self.w = self.w[: len(self.w) - len(suffix)] + new
            return True
        return False

    def standard(self) -> tuple[bool, bool]:
        """Step 1; whether the word changed, and whether verbs are looked for all the same."""
        suffix = _longest(self.w, FR_STEP1)
        if suffix in FR_PLAIN:
            return self.cut(suffix, self.r2), False
        if suffix in FR_ATION:
            if not self.cut(suffix, self.r2):
                return False, False
            self.cut("ic", self.r2) or self.cut("ic", 0, "iqU")
        elif suffix in FR_SWAPS:
            return self.cut(suffix, self.r2, FR_SWAPS[suffix]), False
        elif suffix in FR_EMENT:
            if not self.cut(suffix, self.rv):
                return False, False
            if self.w.endswith("iv"):
                self.cut("iv", self.r2) and self.cut("at", self.r2)
            elif self.w.endswith("eus"):
                self.cut("eus", self.r2) or self.cut("eus", self.r1, "eux")
            elif self.w.endswith(("abl", "iqU")):
                self.cut(self.w[-3:], self.r2)
            elif self.w.endswith(("ièr", "Ièr")):
                self.cut(self.w[-3:], self.rv, "i")
        elif suffix in FR_ITY:
            if not self.cut(suffix, self.r2):
                return False, False
            if self.w.endswith("abil"):
                self.cut("abil", self.r2) or self.cut("abil", 0, "abl")
            elif self.w.endswith("ic"):
                self.cut("ic", self.r2) or self.cut("ic", 0, "iqU")
            else:
                self.cut("iv", self.r2)
        elif suffix in FR_IVE:
            if not self.cut(suffix, self.r2):
                return False, False
            if self.cut("at", self.r2):
                self.cut("ic", self.r2) or self.cut("ic", 0, "iqU")
        elif suffix == "eaux":
            self.cut(suffix, 0, "eau")
        elif suffix == "aux":
            return self.cut(suffix, self.r1, "al"), False
        elif suffix in FR_EUSE:
            return self.cut(suffix, self.r2) or self.cut(suffix, self.r1, "eux"), False
        elif suffix in FR_ISSEMENT:
            at = len(self.w) - len(suffix)
            return at >= self.r1 and at > 0 and self.w[at - 1] not in FR_VOWELS and self.cut(suffix, self.r1), False
        elif suffix in ("amment", "emment"):
            return self.cut(suffix, self.rv, suffix[0].replace("a", "an").replace("e", "en") + "t"), True
        elif suffix in FR_MENT:
            at = len(self.w) - len(suffix)
            return at - 1 >= self.rv and self.w[at - 1] in FR_VOWELS and self.cut(suffix, self.rv), True
        else:
            return False, False
        return True, False

    def verb(self) -> bool:
        """Steps 2a and 2b; whether the word changed."""
        suffix = _longest(self.w, FR_VERBS_I, self.rv)
        at = len(self.w) - len(suffix)
        if suffix and at - 1 >= self.rv and self.w[at - 1] not in FR_VOWELS:
            return self.cut(suffix, self.rv)
        suffix = _longest(self.w, (*FR_VERBS_E, *FR_VERBS_A, "ions"), self.rv)
        if suffix == "ions":
            return self.cut(suffix, self.r2)
        if not self.cut(suffix, self.rv):
            return False
        if suffix in FR_VERBS_A:
            self.cut("e", self.rv)
        return True

    def rest(self) -> None:
        """Step 4: endings of words that nothing else changed."""
        if re.search(r"[^aiouès]s$", self.w):
            self.w = self.w[:-1]
        suffix = _longest(self.w, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), self.rv)
        at = len(self.w) - len(suffix)
        if suffix == "ion":
            if at - 1 >= self.rv and self.w[at - 1] in "st":
                self.cut(suffix, self.r2)
        elif suffix == "ë":
            if self.w[self.rv :].endswith("guë"):
                self.w = self.w[:-1]
        elif suffix:
            self.cut(suffix, self.rv, "i" if len(suffix) > 1 else "")


def french(word: str) -> str:
    """The stem of a lower-case French word."""
    f = _French(word)
    changed, verbs = f.standard()
    if not changed or verbs:
        changed = f.verb() or changed
    if changed:
        f.w = re.sub("ç$", "c", re.sub("Y$", "i", f.w))
    else:
        f.rest()
    w = re.sub(r"(enn|onn|ett|ell|eill)$", lambda m: m[1][:-1], f.w)
    w = re.sub(f"[éè]([^{FR_VOWELS}]+)$", r"e\1", w)
    return w.lower()


STEMMERS = {"english": english, "french": french}


def stem(word: str, lang: str) -> str:
    """The stem of a lower-case word; in another language the word itself."""
    return STEMMERS[lang](word) if lang in STEMMERS else word


@F.pandas_udf(ArrayType(StringType()))
def stem_all(tokens: pd.Series, langs: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], str] = {}

    def one(w: str, lang: str) -> str:
        if (w, lang) not in known:
            known[w, lang] = stem(w, lang)
        return known[w, lang]

    return pd.Series([[one(w, lang) for w in ts] if ts is not None else None for ts, lang in zip(tokens, langs, strict=True)])
