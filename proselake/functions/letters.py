"""Edges of words in Python, as the patterns of the plans see them."""

from __future__ import annotations

import re
import unicodedata

#: Unicode's alphabetic characters that Python does not call letters: letter numbers, circled letters, vowel signs; in hexadecimal.
_RANGES = (
    "345 5b0-5bd 5bf 5c1-5c2 5c4-5c5 5c7 610-61a 64b-657 659-65f 670 6d6-6dc 6e1-6e4 6e7-6e8 6ed 711 730-73f 7a6-7b0 816-817 81b-823 825-827 829-82c "
    "8d4-8df 8e3-8e9 8f0-903 93a-93b 93e-94c 94e-94f 955-957 962-963 981-983 9be-9c4 9c7-9c8 9cb-9cc 9d7 9e2-9e3 a01-a03 a3e-a42 a47-a48 a4b-a4c a51 "
    "a70-a71 a75 a81-a83 abe-ac5 ac7-ac9 acb-acc ae2-ae3 afa-afc b01-b03 b3e-b44 b47-b48 b4b-b4c b56-b57 b62-b63 b82 bbe-bc2 bc6-bc8 bca-bcc bd7 c00-c03 "
    "c3e-c44 c46-c48 c4a-c4c c55-c56 c62-c63 c81-c83 cbe-cc4 cc6-cc8 cca-ccc cd5-cd6 ce2-ce3 d00-d03 d3e-d44 d46-d48 d4a-d4c d57 d62-d63 d81-d83 dcf-dd4 "
    "dd6 dd8-ddf df2-df3 e31 e34-e3a e4d eb1 eb4-eb9 ebb-ebc ecd f71-f81 f8d-f97 f99-fbc 102b-1036 1038 103b-103e 1056-1059 105e-1060 1062-1064 1067-106d "
    "1071-1074 1082-108d 108f 109a-109d 16ee-16f0 1712-1713 1732-1733 1752-1753 1772-1773 17b6-17c8 1885-1886 18a9 1920-192b 1930-1938 1a17-1a1b 1a55-1a5e "
    "1a61-1a74 1abf-1ac0 1b00-1b04 1b35-1b43 1b80-1b82 1ba1-1ba9 1bac-1bad 1be7-1bf1 1c24-1c36 1de7-1df4 2160-2182 2185-2188 24b6-24e9 2de0-2dff 3007 "
    "3021-3029 3038-303a a674-a67b a69e-a69f a6e6-a6ef a802 a80b a823-a827 a880-a881 a8b4-a8c3 a8c5 a8ff a926-a92a a947-a952 a980-a983 a9b4-a9bf a9e5 "
    "aa29-aa36 aa43 aa4c-aa4d aa7b-aa7d aab0 aab2-aab4 aab7-aab8 aabe aaeb-aaef aaf5 abe3-abea fb1e 10140-10174 10341 1034a 10376-1037a 103d1-103d5 "
    "10a01-10a03 10a05-10a06 10a0c-10a0f 10d24-10d27 10eab-10eac 11000-11002 11038-11045 11082 110b0-110b8 11100-11102 11127-11132 11145-11146 11180-11182 "
    "111b3-111bf 111ce-111cf 1122c-11234 11237 1123e 112df-112e8 11300-11303 1133e-11344 11347-11348 1134b-1134c 11357 11362-11363 11435-11441 11443-11445 "
    "114b0-114c1 115af-115b5 115b8-115be 115dc-115dd 11630-1163e 11640 116ab-116b5 1171d-1172a 1182c-11838 11930-11935 11937-11938 1193b-1193c 11940 11942 "
    "119d1-119d7 119da-119df 119e4 11a01-11a0a 11a35-11a39 11a3b-11a3e 11a51-11a5b 11a8a-11a97 11c2f-11c36 11c38-11c3e 11c92-11ca7 11ca9-11cb6 11d31-11d36 "
    "11d3a 11d3c-11d3d 11d3f-11d41 11d43 11d47 11d8a-11d8e 11d90-11d91 11d93-11d96 11ef3-11ef6 12400-1246e 16f4f 16f51-16f87 16f8f-16f92 16ff0-16ff1 1bc9e "
    "1e000-1e006 1e008-1e018 1e01b-1e021 1e023-1e024 1e026-1e02a 1e947 1f130-1f149 1f150-1f169 1f170-1f189 "
)
_ALSO = frozenset(chr(i) for r in _RANGES.split() for a, _, b in (r.partition("-"),) for i in range(int(a, 16), int(b or a, 16) + 1))

_POINTS = frozenset(".,;:!?")


def is_letter(c: str) -> bool:
    """What a pattern of a plan calls alphabetic."""
    return c.isalpha() or c in _ALSO


def is_mark(c: str) -> bool:
    """What is no part of a word at its edges."""
    return not (is_letter(c) or c in "'-" or unicodedata.category(c)[0] == "N")


def bare(token: str) -> str:
    """A token in lower case, without all that is no letter at its edges."""
    return _trimmed(token, lambda c: not is_letter(c))


def word(token: str) -> str:
    """A token in lower case, without marks at its edges."""
    return _trimmed(token, is_mark)


def _trimmed(token: str, outer) -> str:
    # most tokens are letters, or letters and a point or comma
    if token.isalpha():
        return token.lower()
    if token[-1:] in _POINTS and token[:-1].isalpha():
        return token[:-1].lower()
    begin, end = 0, len(token)
    while begin < end and outer(token[begin]):
        begin += 1
    while end > begin and outer(token[end - 1]):
        end -= 1
    return token[begin:end].lower()


def _class(i: int) -> int:
    c = chr(i).lower()
    if i >= 128:
        return ord("x")
    if c.isalpha():
        return ord("a" if c in "aiouy" else c if c in "eldtn" else "x")
    return ord(" " if c in " \t\n\x0b\x0c\r" else ".")


#: By byte: a vowel other than e, the letters that the estimate tells apart, other letters, white space, and marks as points.
_CLASSES = bytes(map(_class, range(256)))
_GROUPS = bytes(c if c in b"ae" else 32 for c in range(256))
_FINAL = re.compile(rb"e(d?)\.*(?![^ ])")
_SILENT = re.compile(rb"(?<![^ ])[^ ae]++(?![^ ])")


def estimated_sum(text: str) -> int | None:
    """The sum of `estimate` over the bare words of a text, by passes over all of it; None for the few texts with
    the one capital outside of ASCII whose small letter holds a vowel."""
    if not text.isascii():
        for c in set(text):
            if c == "İ":
                return None
            if c > "\x7f" and not is_letter(c):
                text = text.replace(c, " " if c.isspace() else ".")
    b = text.encode().translate(_CLASSES)
    n = len(b.translate(_GROUPS).split())
    # a word without vowels has one syllable
    n += sum(w.count(b".") < len(w) for w in _SILENT.findall(b))
    for m in _FINAL.finditer(b):
        w = b[b.rfind(b" ", 0, m.start()) + 1 : m.end(1)].lstrip(b".")
        several = len(w.translate(_GROUPS).split()) > 1
        if m[1]:
            n -= several and w[-3] not in b"td"
        else:
            n += (w[-2:] == b"le" and len(w) > 2 and w[-3] not in b"ae") - (several and w[-2] not in b"ldtn")
    return n
