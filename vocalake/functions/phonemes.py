"""Grapheme to phoneme: script routing and rule tables, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalake.functions.text import DEVANAGARI

# The phoneme tables and word lists that results depend on.
VOWELS = {
    "अ": "ə", "आ": "aː", "इ": "ɪ", "ई": "iː", "उ": "ʊ", "ऊ": "uː",
    "ऋ": "ɾɪ", "ए": "eː", "ऐ": "ɛː", "ओ": "oː", "औ": "ɔː",
}
SIGNS = {
    "ा": "aː", "ि": "ɪ", "ी": "iː", "ु": "ʊ", "ू": "uː", "ृ": "ɾɪ",
    "े": "eː", "ै": "ɛː", "ो": "oː", "ौ": "ɔː", "ं": "̃", "ः": "h", "ँ": "̃",
}
CONSONANTS = {
    "क": "k", "ख": "kʰ", "ग": "g", "घ": "gʱ", "ङ": "ŋ",
    "च": "tʃ", "छ": "tʃʰ", "ज": "dʒ", "झ": "dʒʱ", "ञ": "ɲ",
    "ट": "ʈ", "ठ": "ʈʰ", "ड": "ɖ", "ढ": "ɖʱ", "ण": "ɳ",
    "त": "t̪", "थ": "t̪ʰ", "द": "d̪", "ध": "d̪ʱ", "न": "n",
    "प": "p", "फ": "pʰ", "ब": "b", "भ": "bʱ", "म": "m",
    "य": "j", "र": "ɾ", "ल": "l", "व": "ʋ",
    "श": "ʃ", "ष": "ʂ", "स": "s", "ह": "ɦ",
}
NO_VOWEL = "्"
ROMAN = {
    "aa": "aː", "ee": "iː", "oo": "uː", "ai": "ɛː", "au": "ɔː", "ou": "oː", "ei": "eː",
    "sh": "ʃ", "ch": "tʃ", "th": "t̪ʰ", "dh": "d̪ʱ", "ph": "pʰ", "kh": "kʰ", "gh": "gʱ", "bh": "bʱ",
    "ny": "ɲ", "ng": "ŋ", "a": "ə", "e": "ɛ", "i": "ɪ", "o": "ɔ", "u": "ʊ",
    "k": "k", "g": "g", "t": "ʈ", "d": "ɖ", "n": "n", "p": "p", "b": "b", "m": "m",
    "y": "j", "r": "ɾ", "l": "l", "v": "ʋ", "w": "ʋ", "s": "s", "h": "ɦ", "f": "f", "z": "z",
    "j": "dʒ", "c": "k", "x": "ks", "q": "k",
}
ROMAN_HINTS = (
    "kya hai nahi nahin toh mera tera uska hum hamara woh yeh bhi kyun kaise bolna chalo karo karta karti "
    "kiya par aur lekin agar matlab theek thik achha acha haan haanji namaste samajh"
).split()
TERMS = {
    "stochastic": "stəˈkæstɪk", "cepstrum": "ˈkɛpstɹəm", "mfcc": "ˌɛm.ɛfˌsiːˈsiː", "lfcc": "ˌɛl.ɛfˌsiːˈsiː",
    "cqcc": "ˌsiːˌkjuːˌsiːˈsiː", "whisper": "ˈwɪspɚ", "wav2vec": "ˈwɑːv.tuː.vɛk", "transformer": "tɹænsˈfɔɹmɚ",
    "hmm": "ˌeɪtʃˌɛmˈɛm", "gmm": "ˌdʒiːˌɛmˈɛm", "viterbi": "vɪˈtɚbi", "hinglish": "ˈhɪŋglɪʃ",
    "code-switching": "koʊdˈswɪtʃɪŋ", "phoneme": "ˈfoʊniːm", "grapheme": "ˈgɹæfiːm",
}
SPELLINGS = (
    ("ph", "f"), ("ch", "tʃ"), ("sh", "ʃ"), ("th", "θ"), ("ng", "ŋ"), ("ee", "iː"), ("oo", "uː"),
    ("ea", "iː"), ("ai", "eɪ"), ("ay", "eɪ"), ("ou", "aʊ"), ("ow", "aʊ"),
    ("a", "æ"), ("e", "ɛ"), ("i", "ɪ"), ("o", "ɒ"), ("u", "ʌ"),
    ("y", "i"), ("c", "k"), ("x", "ks"), ("q", "k"), ("j", "dʒ"), ("w", "w"), ("r", "ɹ"),
)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def route(token: Column) -> Column:
    """hi for any Devanagari letter, hi-roman for a hint word, else en."""
    return F.when(token.rlike(f"[{DEVANAGARI}]"), "hi").when(F.lower(token).isin(ROMAN_HINTS), "hi-roman").otherwise("en")


#: Letters whose normal form (NFC) is the letter and the dot below, and pairs whose normal form is one letter.
DOT = "़"
APART = {0x958: "क", 0x959: "ख", 0x95A: "ग", 0x95B: "ज", 0x95C: "ड", 0x95D: "ढ", 0x95E: "फ", 0x95F: "य"}
TOGETHER = {"न": 0x929, "र": 0x931, "ळ": 0x934}


def normal(token: Column) -> Column:
    """The Devanagari letters of a token in Unicode's normal form NFC."""
    out = token
    for composed, letter in APART.items():
        out = F.replace(out, F.lit(chr(composed)), F.lit(letter + DOT))
    for letter, composed in TOGETHER.items():
        out = F.replace(out, F.lit(letter + DOT), F.lit(chr(composed)))
    return out


def devanagari(token: Column) -> Column:
    """Syllables in order: a consonant keeps its sign's vowel, none with the vowel killer, else a schwa; a last schwa goes.

    Letters count in normal form; the dots that stand apart in it are passed over, and so are letters that have no sound here.
    """
    consonants, signs, vowels = "".join(CONSONANTS), "".join(SIGNS), "".join(VOWELS)
    units = F.regexp_extract_all(normal(token), F.lit(f"([{consonants}][{signs}{NO_VOWEL}]?|[{vowels}]|[{signs}])"), 1)
    # longest keys: a consonant with what follows it
    table = VOWELS | SIGNS | {c: ipa + "ə" for c, ipa in CONSONANTS.items()}
    tail = {"": "ə", NO_VOWEL: "", **SIGNS}
    spoken = F.transform(
        units,
        lambda u: F.when(
            (F.length(u) == 2),
            F.concat(F.element_at(_map(CONSONANTS), F.substring(u, 1, 1)), F.element_at(_map({k: v for k, v in tail.items() if k}), F.substring(u, 2, 1))),
        ).otherwise(F.element_at(_map(table), u)),
    )
    return F.regexp_replace(F.array_join(spoken, ""), "ə$", "")


def roman_hindi(token: Column) -> Column:
    """The longest known group at each place; unknown letters are passed over."""
    pairs, single = [k for k in ROMAN if len(k) == 2], "".join(k for k in ROMAN if len(k) == 1)
    units = F.regexp_extract_all(F.lower(token), F.lit(f"({'|'.join(pairs)}|[{single}])"), 1)
    return F.array_join(F.transform(units, lambda u: F.element_at(_map(ROMAN), u)), "")


def english(token: Column) -> Column:
    """A known term, else the spelling rules one after the other over the whole word."""
    low = F.regexp_replace(F.lower(token), r"""^[.,!?:;"'()\[\]]+|[.,!?:;"'()\[\]]+$""", "")
    out = low
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.coalesce(F.element_at(_map(TERMS), low), out)


def spoken(token: Column) -> Column:
    """A token by the rules of its route; signs stand for themselves."""
    by_route = F.when(route(token) == "hi", devanagari(token)).when(route(token) == "hi-roman", roman_hindi(token)).otherwise(english(token))
    return F.when(token.rlike(f"[A-Za-z{DEVANAGARI}]"), by_route).otherwise(token)
