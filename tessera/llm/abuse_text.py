"""Reading of texts for the content classifier: disguised spellings undone, words hashed."""

import re
import unicodedata
import zlib

import numpy as np

BUCKETS = 1 << 15
#: Hashed forms of a word: the word, its beginning, and its letters without vowels and repeats.
FORMS = 3

# Cyrillic and Greek letters that look like Latin ones, digits and signs used as letters.
LOOKALIKES = str.maketrans("асеорхуівкмтнѕјԁɡαοερυνικτ", "aceopxyibkmthsjdgaoepuvikt")
LEET = str.maketrans("013457@$!", "oieastasi")
# Frequent words that tell the languages of the corpus apart.
STOP = {
    "en": frozenset("the of and to is was for with that on are this not be have it you i we as but will".split()),
    "de": frozenset("der die das und ist nicht ein eine mit von zu auf den im wer hat bei du ich dem".split()),
    "fr": frozenset("le la les et est des un une pas dans pour qui que du sur ne vous je au ce".split()),
    "es": frozenset("el la los las y es un una no con para que del por se de en al lo su".split()),
}

_WORD = re.compile(r"[^\W_]+(?:[#*]+[^\W_]*)*(?:['’][^\W_]+)?|[#*]{2,}|[!?]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\s_.\-*·]{1,2}){3,}[^\W\d_](?![^\W_])")
_JOINERS = re.compile(r"[\s_.\-*·]")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_TAG = re.compile(r"<[^<>]{0,60}>|&[a-z#0-9]{1,8};")
_HIDDEN = re.compile("[​-‏‪-‮⁠-⁤﻿­̀-ͯ]")
_VOWELS = re.compile(r"[aeiouy]|(.)(?=\1)")


def repaired(text: str) -> str:
    """UTF-8 text that was read as a single-byte encoding, read again; other text as it is."""
    if "Ã" in text or "â€" in text:
        for enc in ("cp1252", "latin-1"):
            try:
                return text.encode(enc).decode("utf-8")
            except UnicodeError:
                pass
        return re.sub(r"Ã[\x80-\xff]", lambda m: m[0].encode("latin-1").decode("utf-8", "ignore"), text)
    return text


def words(text: str) -> list[str]:
    """Lower-case words with disguises undone: hidden characters, look-alikes, digits for letters, stretched and
    spaced-out letters, masking signs (runs become one #), markup, wrong decoding. Numbers become one word."""
    s = _TAG.sub(" ", repaired(text))
    s = _HIDDEN.sub("", unicodedata.normalize("NFKD", s)).lower()
    s = _SPACED.sub(lambda m: _JOINERS.sub("", m[0]), s)
    found, known = _WORD.findall(s), _KNOWN
    if len(known) > 400_000:
        known.clear()
    out = []
    for w in found:
        k = known.get(w)
        if k is None:
            k = known[w] = _plain(w)
        out.append(k)
    return out


#: Words met so far, with their disguises undone.
_KNOWN: dict[str, str] = {}


def _plain(w: str) -> str:
    if w.isdigit():
        return "0"
    if not w.isascii() or not w.isalpha():
        w = w.translate(LOOKALIKES) if not w.isascii() and re.search("[a-z]", w) else w
        if any(c.isdigit() for c in w):
            # ids and sizes stay unknown, disguised words keep mostly letters
            w = w.translate(LEET) if sum(c.isalpha() for c in w) > sum(c.isdigit() for c in w) and len(w) < 16 else "0x"
        w = re.sub(r"[#*]+", "#", w)
    return _LONG.sub(r"\1", w)


class Hasher:
    """Bucket ids of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def ids(self, ws: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 400_000:
            known.clear()
        for w in ws:
            if w not in known:
                forms = (w, "^" + w[:5], "~" + w[:1] + _VOWELS.sub("", w[1:]))
                known[w] = tuple(1 + zlib.crc32(f.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for f in forms)
        return np.array([known[w] for w in ws], np.int32).reshape(-1, FORMS)


def language(ws: list[str], tag: str | None) -> str:
    """The language with most frequent words in the text; without any, that of the tag; else ``other``."""
    hits = {k: sum(w in v for w in ws) for k, v in STOP.items()}
    best = max(hits, key=lambda k: hits[k])
    if hits[best] > 0:
        return best
    return tag[:2].lower() if tag and tag[:2].lower() in STOP else "other"
