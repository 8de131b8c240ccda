"""Text kernels: words, paragraphs, syllables and byte-exact lengths as column expressions; sentences as an Arrow function."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselake.functions import lexicons as lex
from proselake.functions.kept import kept
from proselake.functions.letters import bare, estimated_sum, word

#: The default bound on a document, in bytes.
MAX_BYTES = 5_242_880
#: Rows and bytes of an Arrow batch; with more of either the texts and findings of a batch could fill a Python worker.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20
SENTENCES = T.ArrayType(T.StructType([T.StructField("num", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("line", T.IntegerType())]))
#: A paragraph's counts.
PARAGRAPH = "struct<num:int,sentences:int,words:int,syllables:bigint>"
_ABBREVIATIONS = frozenset(lex.ABBREVIATIONS)
_GLUE = frozenset(lex.GLUE)
#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = frozenset(WHITE)
_INITIALS = re.compile(r"\b[A-Z]\.(?:[A-Z]\.)*")
_DECIMAL = re.compile(r"\d+\.\d+")
_ADDRESS = re.compile(rf"(?:https?://|www\.)[^{WHITE}]|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b")
#: Characters that neither belong to words nor part them.
_MARK = r"[^\p{IsAlphabetic}\p{N}'\s-]"
_NO_LETTER = r"[^\p{IsAlphabetic}\s]"


def batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, since plans run after the call that made them; smaller ones of the caller stay."""
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(key).rstrip("b")
        if not have.isdigit() or not 0 < int(have) <= bound:
            spark.conf.set(key, str(bound))


def text_of(c) -> Column:
    """A null text counts as empty everywhere."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(c: Column, f) -> Column:
    """`f` of a value that is computed once per row, also where `f` uses it inside a function over an array."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unrolled(d: DataFrame, keep: list[str], items: Column, name: str = "__f") -> DataFrame:
    """(keep..., the fields of each struct of an array): rows without any give none.

    The array is computed once; an inner explode would have it computed for a filter on its size first.
    """
    out = d.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())
    return out.select(*keep, f"{name}.*")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c) -> Column:
    """White-space tokens, punctuation kept."""
    return F.array_remove(F.split(text_of(c), r"(?U)\s+"), "")


def _trimmed(c: Column, outer: str) -> Column:
    # marks at the edges of all tokens go in one pass over the text
    return F.lower(F.regexp_replace(c, rf"(?U)(?<!\S){outer}+|{outer}+(?!\S)", ""))


def _trimmed_tokens(c: Column, outer: str) -> Column:
    return F.array_remove(F.split(_trimmed(c, outer), r"(?U)\s+"), "")


def word_text(c) -> Column:
    """The `words` of a text, still as a text, for functions that split it themselves."""
    return _trimmed(text_of(c), _MARK)


def bare_text(c) -> Column:
    """The `bare_tokens` of a text, still as a text."""
    return _trimmed(text_of(c), _NO_LETTER)


def words(c) -> Column:
    """Lower-cased words without outer punctuation; apostrophes and hyphens stay, even alone."""
    return _trimmed_tokens(text_of(c), _MARK)


def bare_tokens(c) -> Column:
    """Lower-cased tokens without all that is no letter at their edges."""
    return _trimmed_tokens(text_of(c), _NO_LETTER)


def paragraphs(c) -> Column:
    return F.filter(F.transform(F.split(text_of(c), "\n\n"), stripped), lambda p: p != "")


def paragraph_lines(c) -> Column:
    """The 1-based first line of each run of lines that are not blank."""
    blank = lambda x: stripped(x) == ""
    starts = lambda lines: F.transform(lines, lambda x, i: F.when(~blank(x) & ((i == 0) | blank(F.get(lines, i - 1))), i + 1))
    return let(F.split(text_of(c), "\n"), lambda lines: F.array_compact(starts(lines)))


def round1(c: Column) -> Column:
    return F.round(c * 10) / 10


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round1(part / whole * 100)).otherwise(0.0)


def estimated_syllables(w: Column) -> Column:
    """Groups of vowels, with corrections for a silent e, a final -le and a final -ed; at least 1 for a word."""
    groups = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
    n = groups - F.when(w.endswith("e") & (groups > 1) & ~w.rlike("[ldtn]e$"), 1).otherwise(0)
    n = n + F.when(w.rlike("[^aeiouy]le$"), 1).otherwise(0)
    n = n - F.when(w.endswith("ed") & (n > 1) & ~w.rlike("[td]ed$"), 1).otherwise(0)
    return F.when(w == "", 0).otherwise(F.greatest(n, F.lit(1)))


def syllables(w: Column, dictionary: dict[str, int] | None = None) -> Column:
    """Syllables by a dictionary that the caller gives, else estimated. The dictionary is one literal of the plan, looked
    up by hash in groups, so thousands of words cost little.
    """
    if not dictionary:
        return estimated_syllables(w)
    # a map literal is searched from its start, so words are dealt to as many maps as keep each one short
    n = max(1, len(dictionary) // 16)
    groups: list[dict[str, int]] = [{} for _ in range(n)]
    for word, count in dictionary.items():
        groups[zlib.crc32(word.encode()) % n][word] = count
    known = F.from_json(F.lit(json.dumps(groups)), "array<map<string,int>>")
    return F.coalesce(F.element_at(F.get(known, F.pmod(F.crc32(w.cast("binary")), F.lit(n)).cast("int")), w), estimated_syllables(w))


#: Words of at most so many characters, and so many of them, have their syllables kept by a worker.
_SHORT, _ROOM = 32, 50_000
#: Bytes of vowels stay, all others part them.
_VOWELS = bytes(c if c in b"aeiouy" else 32 for c in range(256))
_GAPS = re.compile(f"[{WHITE}]+")
_NO_GAPS = re.compile("[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """What white space parts. Python takes four characters for white space that Unicode does not."""
    return [w for w in _GAPS.split(text) if w] if _NO_GAPS.search(text) else text.split()


def estimate(w: str) -> int:
    """`estimated_syllables` of one word."""
    n = len(w.encode().translate(_VOWELS).split())
    if n > 1 and (w[-1] == "e" and w[-2] not in "ldtn" or w[-2:] == "ed" and w[-3] not in "td"):
        n -= 1
    if w[-2:] == "le" and w[-3:-2] not in tuple("aeiouy") and len(w) > 2:
        n += 1
    return max(n, 1) if w else 0


class _Known(dict):
    """What a function says of short strings: what a caller states, else what it says itself, kept for the first that come."""

    def __init__(self, of, stated=()):
        super().__init__(stated)
        self.of, self.room = of, len(self) + _ROOM

    def __missing__(self, w: str):
        n = self.of(w)
        if len(w) <= _SHORT and len(self) < self.room:
            self[w] = n
        return n


def _syllables_of(dictionary: dict[str, int] | None, edges=None):
    """A function that gives a worker's table of syllables by word; with `edges`, by token, null where that leaves no word."""
    stated = dict(dictionary or {})
    key = ("syllables", hashlib.sha256(json.dumps(sorted(stated.items())).encode()).hexdigest(), edges and edges.__name__)

    def of_token(t: str) -> int | None:
        w = edges(t)
        return (stated[w] if w in stated else estimate(w)) if w else None

    return lambda: kept(key, lambda: _Known(of_token) if edges else _Known(estimate, stated)).__getitem__


def text_counts(dictionary: dict[str, int] | None = None, cut: bool = True):
    """A function of a text: {tokens, syllables, sentences}; the sentences are null where `cut` is false.

    Tokens are looked up as they stand, so no pattern has to pass over the text first; without a dictionary the syllables are
    estimated over the whole text at once.
    """
    known = _syllables_of(dictionary, bare)

    def run(texts: pa.Array) -> pa.Array:
        of, n, y, m = known(), [], [], []
        for t in texts:
            text = t.as_py() or ""
            own = pieces(text)
            n.append(len(own))
            made = None if dictionary else estimated_sum(text)
            y.append(sum(filter(None, map(of, own))) if made is None else made)
            m.append(sentence_count(text) if cut else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(y, pa.int64()), pa.array(m, pa.int64())], ["tokens", "syllables", "sentences"])

    return F.arrow_udf(run, "struct<tokens:bigint,syllables:bigint,sentences:bigint>")


def _kind(token: str) -> int:
    w = word(token)
    return (2 if w in _GLUE else 1) if w else 0


@F.arrow_udf(T.StructType([T.StructField("words", T.LongType()), T.StructField("glue", T.LongType())]))
def word_and_glue_counts(texts: pa.Array) -> pa.Array:
    """Of a text: how many `words` it has, and how many of them are glue."""
    of, n, glue = kept("kinds of tokens", lambda: _Known(_kind)).__getitem__, [], []
    for t in texts:
        kinds = list(map(of, pieces(t.as_py() or "")))
        n.append(len(kinds) - kinds.count(0))
        glue.append(kinds.count(2))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(glue, pa.int64())], ["words", "glue"])


def paragraph_counts(dictionary: dict[str, int] | None, least_words: float, least_syllables: float):
    """A function of a text: {num, sentences, words, syllables} of each of its `paragraphs`.

    Sentences are counted only in paragraphs that have more than `least_words` words, and more than `least_syllables`
    syllables a word; they are null elsewhere.
    """
    known = _syllables_of(dictionary, word)

    def counts(num: int, text: str, of) -> dict:
        own = [n for n in map(of, pieces(text)) if n is not None]
        w, y = len(own), sum(own)
        return {"num": num, "sentences": sentence_count(text) if w > least_words and y / w > least_syllables else None, "words": w, "syllables": y}

    def run(texts: pa.Array) -> pa.Array:
        of = known()
        split = lambda text: filter(None, (p.strip(WHITE) for p in text.split("\n\n")))
        return pa.array([[counts(i, p, of) for i, p in enumerate(split(t.as_py() or ""), 1)] for t in texts], pa.list_(pa.struct([("num", pa.int32()), ("sentences", pa.int32()), ("words", pa.int32()), ("syllables", pa.int64())])))

    return F.arrow_udf(run, f"array<{PARAGRAPH}>")


def syllable_sum(dictionary: dict[str, int] | None = None):
    """A function of a `bare_text` or `word_text`: the sum of `syllables` of its words, each looked up in a worker's memory."""
    known = _syllables_of(dictionary)

    def run(texts: pa.Array) -> pa.Array:
        of = known()
        return pa.array([sum(map(of, pieces(t.as_py() or ""))) for t in texts], pa.int64())

    return F.arrow_udf(run, "bigint")


def word_and_syllable_counts(dictionary: dict[str, int] | None = None):
    """A function of an array of texts as above: {words, syllables} of each."""
    known = _syllables_of(dictionary)

    def run(lists: pa.Array) -> pa.Array:
        of = known()
        made = [[(len(w), sum(map(of, w))) for w in map(pieces, texts.as_py() or ())] for texts in lists]
        ends = [0]
        for m in made:
            ends.append(ends[-1] + len(m))
        rows = pa.StructArray.from_arrays([pa.array([n for m in made for n, _ in m], pa.int32()), pa.array([y for m in made for _, y in m], pa.int64())], ["words", "syllables"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return F.arrow_udf(run, "array<struct<words:int,syllables:bigint>>")


def counts_type(name: str) -> T.ArrayType:
    """The type of `listed_counts`; a worker that loads this module cannot read types from strings."""
    return T.ArrayType(T.StructType([T.StructField(name, T.StringType()), T.StructField("count", T.LongType())]))


def listed_counts(lists: list[list[tuple[str, int]]], name: str) -> pa.Array:
    """An Arrow array of [{name, count}]."""
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    rows = pa.StructArray.from_arrays([pa.array([t for x in lists for t, _ in x], pa.string()), pa.array([n for x in lists for _, n in x], pa.int64())], [name, "count"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


@F.arrow_udf(counts_type("word"))
def word_counts(texts: pa.Array) -> pa.Array:
    """Of a `bare_text` or `word_text`: each distinct word and how often it stands there."""
    return listed_counts([list(Counter(pieces(t.as_py() or "")).items()) for t in texts], "word")


def occurrences(c: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal string, without word boundaries."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def too_large(c, limit: int | None = MAX_BYTES) -> Column:
    """An error text for a document over the bound, else null."""
    size = F.octet_length(text_of(c))
    return F.when(size > limit, F.format_string(f"input of %d bytes is over the limit of {limit}", size)) if limit is not None else F.lit(None).cast("string")


#: Small letters follow most points that end nothing, so such points are passed over at once.
_TERMINATOR = re.compile(r"[!?]|\.(?![ \n]*[a-z])")


class _Splitter:
    """Where a text's sentences end, decided at each terminator from what stands around it."""

    def __init__(self, text: str):
        self.text = text
        # an address has one of these marks; the pattern alone would try every place for a mail's
        self.addresses = "@" in text or "://" in text or "www." in text

    def _word_before(self, at: int) -> str:
        text, end = self.text, at
        while end > 0 and (text[end - 1] == "." or text[end - 1] in _WHITE):
            end -= 1
        begin = end
        while begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] == "."):
            begin -= 1
        return text[begin:end]

    def _following(self, at: int) -> int:
        text, k = self.text, at + 1
        while k < len(text) and text[k] in _WHITE:
            k += 1
        return k

    def ends(self, at: int, begin: int) -> bool:
        text = self.text
        if at == len(text) - 1:
            return True
        k = self._following(at)
        after = text[k : k + 1]
        if text[at] != ".":
            # before a quotation mark it depends on what is quoted; nothing there is no new sentence either
            return after not in ('"', "'") or after == "" or text[k + 1 : k + 2].isupper()
        if after.islower():
            return False
        # most points stand after a plain word, which needs no walk and has neither digits nor initials
        before = text[text.rfind(" ", max(0, at - 30), at) + 1 : at]
        if len(before) > 1 and before.isascii() and before.isalpha() and text[at - len(before) - 1 : at - len(before)] == " ":
            if before.lower() in _ABBREVIATIONS:
                return False
        else:
            before = self._word_before(at)
            if before.lower() in _ABBREVIATIONS or (len(before.encode()) == 1 and before.isupper()) or ("." in before and _INITIALS.search(before)):
                return False
            if after.isascii() and after.isdigit() and before[-1:].isascii() and before[-1:].isdigit():
                return False
        first = max(begin, at - 49)
        if text.find(".", max(first, at - 9), at) >= 0:
            sentence = text[first : at + 1]
            if sentence.endswith("...") or _DECIMAL.search(sentence[-10:]):
                return False
        if not self.addresses:
            return True
        sentence = text[first : at + 1]
        return not (("@" in sentence or "://" in sentence or "www." in sentence) and _ADDRESS.search(sentence))


def _spans(text: str):
    """(begin, end) of what lies between the cuts, white space included."""
    begin, ends = 0, _Splitter(text).ends
    for m in _TERMINATOR.finditer(text):
        at = m.start()
        if ends(at, begin):
            yield begin, at + 1
            begin = at + 1
    yield begin, len(text)


def _counts(bare: str) -> bool:
    return len(bare) >= 3 or len(bare.encode()) >= 3


def sentence_count(text: str) -> int:
    """The number of `split_sentences`."""
    return sum(_counts(text[begin:end].strip(WHITE)) for begin, end in _spans(text))


def split_sentences(text: str) -> list[tuple[str, int]]:
    """(sentence, 1-based line of its first character); pieces under three bytes are dropped."""
    if not text.strip(WHITE):
        return []
    out = []
    line, counted = 1, 0  # lines are counted once over the text
    for begin, end in _spans(text):
        piece = text[begin:end]
        bare = piece.strip(WHITE)
        if _counts(bare):
            first = begin + len(piece) - len(piece.lstrip(WHITE))
            line += text.count("\n", counted, first)
            counted = first
            out.append((bare, line))
    return out


@F.arrow_udf(SENTENCES)
def split_text(texts: pa.Array) -> pa.Array:
    """Numbered sentences with their lines; the rule looks back over earlier boundaries, so no expression gives it."""
    nums, found, lines, ends = [], [], [], [0]
    for t in texts:
        own = split_sentences(t.as_py() or "")
        nums += range(1, len(own) + 1)
        found += [s for s, _ in own]
        lines += [line for _, line in own]
        ends.append(len(nums))
    rows = pa.StructArray.from_arrays([pa.array(nums, pa.int32()), pa.array(found, pa.string()), pa.array(lines, pa.int32())], ["num", "text", "line"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def with_words(sents: Column) -> Column:
    """Sentences with their words, which most reports need."""
    return F.transform(sents, lambda s: F.struct(s["num"].alias("num"), s["text"].alias("text"), s["line"].alias("line"), words(s["text"]).alias("words")))


def sentences(c) -> Column:
    """Array of {num, text, line, words}."""
    return with_words(split_text(c))
