"""Toxicity of text, disguised words included: a noisy channel is undone before words are scored.

A disguised word is a lattice of characters: a sign may stand for a letter (leetspeak), a separator
between letters for nothing or for the end of a word, a run of one letter for fewer (repetition), and
white space between tokens for nothing (spacing). Every reading has a channel cost, and a character
trigram model, counted over all texts, tells how likely a reading's letters are; Viterbi decoding finds
the best. The restored words are scored by a lexicon of words and word beginnings, learned from labelled
rows.

Decoded are the tokens, cut at signs that can only stand for themselves, and windows of neighbouring
tokens, which count if all their gaps were read as nothing. Almost all of them have one reading. A lattice
is decoded only if some path through it may spell an entry of the lexicon, which a skeleton tells: the
text with all its letters folded to one of their readings and runs shortened, looked at from every place
where a word may begin. No other lattice changes a score (``Model.every`` decodes them all, as a check).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small_batches, small_enough, tidy

#: The letters that a sign may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "€": "e",
    "£": "l",
    "¡": "i",
    "(": "c",
    "×": "x",
}
#: What may stand between letters for nothing.
SEPARATORS = frozenset(".-_*~'`·•,:;/\\^=#​‌‍­﻿")
#: Channel costs, as negative logarithms: a sign for a letter, a separator dropped, a run shortened, a sign kept.
SUBSTITUTE, DROP, SHORTEN, KEEP = 1.0, 0.5, 0.5, 6.0
#: White space between tokens read as nothing.
GAP = 2.0
#: Word beginnings that are features, beside words.
PREFIXES = (4, 5, 6, 7)
#: An entry: in at least MIN_DOCS toxic texts, at least MIN_PURITY of its texts toxic, and a likelihood ratio that
#: chance gives to none of all candidates with the probability 1 - CHANCE. All that pass are kept: labelled rows bound them.
MIN_DOCS, MIN_PURITY, CHANCE = 3, 0.95, 0.05
#: Both classes are counted in distinct texts. Texts of one family (near copies) show a word after the same words. So that
#: they do not count many times, a word's toxic texts are at most as many as the words before it, told apart by CONTEXTS
#: hash values (so 256 at most, which is far more than evidence needs); its clean texts are scaled by the same factor,
#: which leaves its purity that of the texts.
CONTEXTS = 62
PREDICT_AT = 0.7
CACHED = 300_000

#: Stands for a gap that was read as nothing.
_JOIN = "\x1f"
_PIECES = re.compile(r"[^\W\d_]+")
_SPANS = re.compile(rf"(?:[^\W\d_]|{_JOIN})+")
_FOLDED = {k: v[0] for k, v in LEET.items()} | {"l": "i", "q": "g"} | dict.fromkeys(SEPARATORS, "")
_FOLD = str.maketrans(_FOLDED)
_RUNS = re.compile(r"(.)\1+", re.S)
_DOUBLED = re.compile(r"([^\W\d_])\1")
_EDGES = "\"()[]{}<>«»“”„?" + "".join(SEPARATORS)
_DISGUISE = re.compile(r"(.)\1\1|[^\W\d_][^\w\s]+[^\W\d_]|[" + re.escape("".join(LEET)) + "]")
#: Signs that stand for themselves in every reading: no letter, no sign of LEET, no separator.
_CERTAIN = re.compile(r"[^\sA-Za-z" + re.escape("".join(LEET) + "".join(SEPARATORS)) + r"]")
#: Characters of a model at a time.
_CHUNK = 1 << 18


def skeleton(text: str) -> str:
    """A fold that all readings of a text share: one letter for those a sign may stand for, no separators, no runs."""
    return _RUNS.sub(r"\1", text.lower().translate(_FOLD))


def features(word: str) -> list[str]:
    """Of a word in lower case: itself with an end mark, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def segments(token: str) -> list[str]:
    """A token cut at the signs that stand for themselves."""
    if token.isalpha():
        return [token]
    out, at = [], 0
    for m in _CERTAIN.finditer(token):
        if not _PIECES.match(m.group()):
            out.append(token[at : m.start()])
            at = m.end()
    return [*out, token[at:]]


def openings(text: str) -> tuple[str, list[int]]:
    """The skeleton of a text in lower case, and the places in it where a word may begin: at no letter's heels."""
    if text.isalpha():
        return skeleton(text), [0]
    out: list[str] = []
    places = []
    before = ""
    for c in text:
        folded = _FOLDED.get(c, c)
        same = bool(out) and folded == out[-1]
        if not before or not _PIECES.match(before):
            places.append(len(out) - same)
        if folded and not same:
            out.append(folded)
        before = c
    return "".join(out), list(dict.fromkeys(places))


def _merged(a: str, b: str) -> str:
    return a + (b[1:] if a[-1:] == b[:1] else b)


# --- the character model -------------------------------------------------------

_CLASSES = 64
_CLASS = np.zeros(1 << 16, np.int64)
for _c in range(1 << 16):
    if chr(_c).isalpha():
        _CLASS[_c] = _c - 96 if 97 <= _c <= 122 else 27 + _c % (_CLASSES - 27)


def _classes(text: str) -> np.ndarray:
    """Letters as numbers under 64 (a-z are 1 to 26, others fold by code point), all else 0."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(code < len(_CLASS), _CLASS[np.minimum(code, len(_CLASS) - 1)], 27 + code.astype(np.int64) % (_CLASSES - 27))


@lru_cache(4096)
def _class(c: str) -> int:
    return int(_classes(c)[0])


def _trigrams(text: str) -> np.ndarray:
    """(two before, character) of every letter and word end; what stands before a word's first letter does not count."""
    c = _classes(f"  {text} ")
    two, one, own = c[:-2], c[1:-1], c[2:]
    return np.where(one > 0, (two * _CLASSES + one) * _CLASSES + own, own)[(one > 0) | (own > 0)]


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts over texts, a bounded number of characters at a time."""
    held = np.zeros(_CLASSES**3, np.int64)
    group: list[str] = []
    size = 0
    for t in [*texts, None]:
        if t is None or size > _CHUNK:
            held += np.bincount(_trigrams(" ".join(group)), minlength=len(held))
            group, size = [], 0
        if not t:
            continue
        while len(t) > _CHUNK:  # a long text is cut at white space, else anywhere
            cut = max(t.rfind(" ", 1, _CHUNK), 0) or _CHUNK
            held += np.bincount(_trigrams(t[:cut]), minlength=len(held))
            t = t[cut:]
        group.append(t)
        size += len(t)
    return held


class CharacterModel:
    """-log P(letter or word end | two letters before in the word), with counts smoothed by bigrams and letters."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + _CLASSES)
        p2 = (c2 + 5 * p1[None, :]) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None, :, :]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.cost = -np.log(p3)

    def step(self, tail: str, c: str) -> tuple[float, str]:
        """The cost of c after the last letters of a word, and its last letters then; other signs end it."""
        if c == _JOIN:
            return 0.0, tail
        k = _class(c)
        if not k and not tail:
            return 0.0, ""
        i, j = (_class(x) if x else 0 for x in (tail[-2:-1], tail[-1:]))
        return float(self.cost[i, j, k]), (tail + c)[-2:] if k else ""


def readings(text: str) -> list[tuple[int, int, str, float]]:
    """The lattice's arcs: from, to, the letters that the stretch stands for, channel cost."""
    text = text.lower()
    arcs, i = [], 0
    while i < len(text):
        c = text[i]
        j = i + 1
        while j < len(text) and text[j] == c:
            j += 1
        run = j - i
        if c.isspace():
            arcs += [(i, j, _JOIN, GAP), (i, j, " ", 0.0)]
        elif c in SEPARATORS:
            arcs += [(i, j, "", DROP), (i, j, " ", 0.0)]
        else:
            for letter in LEET.get(c, c):
                cost = SUBSTITUTE if c in LEET else 0.0
                arcs.append((i, j, letter, cost + (SHORTEN if run > 1 else 0.0)))
                if run > 1:
                    arcs.append((i, j, letter * 2, 2 * cost + (SHORTEN if run > 2 else 0.0)))
            if c in LEET:
                arcs.append((i, j, c * min(run, 2), KEEP))
        i = j
    return arcs


def decode(text: str, model: CharacterModel) -> str:
    """The best reading of the lattice: Viterbi over (position, last two letters)."""
    best: dict[int, dict[str, tuple[float, str]]] = {0: {"": (0.0, "")}}
    for start, end, letters, cost in sorted(readings(text), key=lambda a: a[0]):
        for tail, (sofar, out) in best.get(start, {}).items():
            total, t = sofar + cost, tail
            for c in letters:
                more, t = model.step(t, c)
                total += more
            own = best.setdefault(end, {})
            if t not in own or (total, out + letters) < own[t]:
                own[t] = (total, out + letters)
    last = best.get(len(text.lower()), {"": (0.0, "")})
    return min((total + model.step(t, " ")[0], out) for t, (total, out) in last.items())[1]


# --- the lexicon ---------------------------------------------------------------


@dataclass
class Model:
    """every: whether all lattices are decoded, those too that cannot spell an entry."""

    lexicon: dict[str, float]
    prior: float
    characters: CharacterModel
    every: bool = False
    #: of tokens seen before: weight, reading, and how a word may begin in them that goes on in the next one
    known: dict[str, tuple[float, str, tuple[str, ...]]] = field(default_factory=dict)

    def __post_init__(self):
        entries = {f.rstrip("$") for f in self.lexicon}
        self.skeletons = {skeleton(e) for e in entries} - {""}
        self.lengths = sorted({len(s) for s in self.skeletons})
        self.beginnings = {s[:n] for s in self.skeletons for n in range(1, len(s) + 1)}
        self.starts = {s[:n] for s in self.skeletons for n in (1, 2)}
        self.longest = max(map(len, entries), default=0)

    def plain(self, word: str) -> float:
        return max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)

    def _spells(self, s: str, at: int = 0) -> bool:
        return any(s[at : at + n] in self.skeletons for n in self.lengths if at + n <= len(s))

    def _disguised(self, token: str) -> tuple[float, str]:
        """The weight of the best of a token's words, restored, and the token so read (as it is, if it has none)."""
        core, best = token.lower().strip(_EDGES), 0.0
        out, at = [], 0
        for segment in segments(core):
            start = core.index(segment, at)
            out += [core[at:start], segment]
            at = start + len(segment)
            bare = segment.rstrip("!")
            if bare.isalpha() and not _DOUBLED.search(bare):  # one reading, itself
                continue
            for some in dict.fromkeys((segment, bare)):
                s, places = openings(some)
                if self.every or any(self._spells(s, k) for k in places):
                    read = decode(some, self.characters)
                    # a doubled letter alone is ordinary spelling: then only whole words count
                    plain = self.plain if _DISGUISE.search(some) else lambda p: self.lexicon.get(f"{p}$", 0.0)
                    if weight := max((plain(p) for p in _PIECES.findall(read)), default=0.0):
                        out[-1] = read
                        best = max(best, weight)
                        break
        return best, "".join([*out, core[at:]]) if best else token

    def look(self, token: str) -> tuple[float, str, tuple[str, ...]]:
        """The weight of a token as it stands, or else restored; its reading; and the beginnings, as skeletons, of words
        that go on in the next token."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > CACHED:
                self.known.clear()
            found = self.known[token] = self._look(token)
        return found

    def _look(self, token: str) -> tuple[float, str, tuple[str, ...]]:
        core = token.rstrip(".,:;")
        if core.isalpha() and not self.every:
            # most tokens: one word, which begins as no entry does
            s = skeleton(core)
            if s[:2] not in self.starts and s[:1] not in self.skeletons:
                return 0.0, token, ()
        plain = max((self.plain(p) for p in _PIECES.findall(token.lower())), default=0.0)
        weight, read = (plain, token) if plain else self._disguised(token)
        s, places = openings(segments(token.lower())[-1])
        return weight, read, tuple(dict.fromkeys(s[k:] for k in places if s[k:] and (self.every or s[k:] in self.beginnings)))

    def _across(self, parts: list[str]) -> tuple[float, str]:
        """The weight of the word that a window's tokens make, if all gaps are read as nothing and the entry crosses them all."""
        whole = any(len(skeleton(p)) > 1 for p in parts)
        for last in dict.fromkeys((parts[-1], parts[-1].rstrip("!"))):
            for span in _SPANS.findall(decode(" ".join([*parts[:-1], last]), self.characters)):
                if span.count(_JOIN) == len(parts) - 1 and _JOIN not in (span[0], span[-1]):
                    word, before = span.replace(_JOIN, ""), len(span[: span.rindex(_JOIN)].replace(_JOIN, ""))
                    fit = [f for f in features(word) if len(f.rstrip("$")) > before and (f[-1] == "$" or not whole)]
                    if weight := max((self.lexicon.get(f, 0.0) for f in fit), default=0.0):
                        return weight, word
        return 0.0, ""

    def _windows(self, tokens: list[str], at: int) -> Iterator[tuple[int, float, str]]:
        """(end, weight, word) of the words that begin in a token and end in a later one.

        Tokens between are of one segment; two without letters or signs for letters, one after the other, end a window.
        """
        first = segments(tokens[at].lower())[-1]
        tried: set[int] = set()
        for head in self.look(tokens[at])[2]:
            parts, joined = [first], head
            for j in range(at + 1, len(tokens)):
                own = segments(tokens[j].lower())
                s = skeleton(own[0])
                if s and j not in tried and (self.every or self._spells(_merged(joined, s))):
                    tried.add(j)
                    weight, word = self._across([*parts, own[0]])
                    if weight:
                        yield j, weight, word
                joined = _merged(joined, s)
                if len(own) > 1 or (not s and not skeleton(parts[-1])) or sum(1 for p in parts if skeleton(p)) >= self.longest:
                    break
                if not self.every and joined not in self.beginnings:
                    break
                parts.append(own[0])

    def _alive(self, token: str, after: str) -> bool:
        """Whether a window from one token may hold the next."""
        own = segments(after.lower())
        s = skeleton(own[0])
        return any(self._spells(j) or (len(own) == 1 and j in self.beginnings) for h in self.look(token)[2] if (j := _merged(h, s)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """1 less the chance that none of a text's words, restored, makes it toxic; the prior for a text without words.

        Only the distinct words of the batch, and their distinct pairs, are looked at one by one.
        """
        lists = pc.utf8_split_whitespace(texts.fill_null(""))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        looks = [self.look(w) for w in distinct]
        weight = np.fromiter((x[0] for x in looks), float, len(looks))
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        hit = np.flatnonzero(weight[at] > 0)
        found: dict[int, dict[str, float]] = {}
        for t, w in set(zip(text[hit].tolist(), at[hit].tolist(), strict=True)):
            found.setdefault(t, {})[distinct[w]] = float(weight[w])
        opens = np.fromiter((bool(x[2]) for x in looks), bool, len(looks))
        starts = np.flatnonzero(opens[at[:-1]] & (text[1:] == text[:-1])) if len(at) else np.zeros(0, np.int64)
        pairs, which = np.unique(at[starts].astype(np.int64) * len(distinct) + at[starts + 1], return_inverse=True)
        alive = np.fromiter((self.every or self._alive(distinct[p // len(distinct)], distinct[p % len(distinct)]) for p in pairs.tolist()), bool, len(pairs))
        for i in starts[alive[which]].tolist():
            t = int(text[i])
            # a window holds few tokens
            stop = min(int(bounds[t + 1]), i + 2 * self.longest + 2)
            for _, x, word in self._windows([distinct[k] for k in at[i:stop].tolist()], 0):
                found.setdefault(t, {})[f"{word} "] = x
        out = np.full(len(texts), self.prior)
        for t, weights in found.items():
            clean = 1.0 - self.prior
            for w in sorted(weights):
                clean *= 1.0 - weights[w]
            out[t] = 1.0 - clean
        return out

    def restored(self, text: str | None) -> str | None:
        """The text with its disguised words of the lexicon as they were read; all else, null texts too, as it is."""
        if text is None:
            return None
        spaces, tokens = re.split(r"\S+", text), text.split()
        out, i = [spaces[0]] if spaces else [], 0
        while i < len(tokens):
            windows = max(self._windows(tokens[i : i + 2 * self.longest + 2], 0), default=None)
            last = i + windows[0] if windows else i
            out += [windows[2] if windows else self.look(tokens[i])[1], spaces[last + 1]]
            i = last + 1
        return "".join(out)


def _word_counts(texts: pa.Array, toxic: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch: in how many toxic and other texts they stand, and a bit for every word before them in toxic texts."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    raw, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    bit = np.fromiter((xxhash.xxh32_intdigest(w) % CONTEXTS for w in raw), np.int64, len(raw))
    before = np.concatenate(([0], bit[at[:-1]])) if len(at) else np.zeros(0, np.int64)
    # most raw words are one word; the others stand for each of theirs
    number: dict[str, int] = {}
    pieces = [[number.setdefault(p, len(number)) for p in _PIECES.findall(w)] for w in raw]
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((p for ps in pieces for p in ps), np.int64, int(size.sum()))
    start = np.cumsum(size) - size
    n = size[at]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    word, text, before = flat[np.repeat(start[at], n) + inner], np.repeat(text, n), np.repeat(before, n)
    pair = np.unique(word * max(1, len(texts)) + text)
    own, of = pair // max(1, len(texts)), pair % max(1, len(texts))
    a = np.bincount(own[toxic[of]], minlength=len(number))
    b = np.bincount(own[~toxic[of]], minlength=len(number))
    bits = np.zeros(len(number), np.int64)
    in_toxic = toxic[text]
    np.bitwise_or.at(bits, word[in_toxic], np.int64(1) << before[in_toxic])
    return list(number), a, b, bits


def character_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Letter trigrams of all texts; the driver gets a row per trigram, 64**3 at most."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(_CLASSES**3, np.int64)
        for b in batches:
            held += trigram_counts(b.column(0).to_pylist())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["code", "n"])

    out = np.zeros(_CLASSES**3, np.int64)
    for code, n in df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(count), "code long, n long").groupBy("code").agg(F.sum("n")).collect():
        out[code] = n
    return out


def train(labelled: DataFrame, texts: DataFrame, *, text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from all labelled rows (text, label 0 or 1; rows with nulls do not count) and the characters of all texts.

    The lexicon holds all entries that pass.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), (F.col(f"`{label_col}`").cast("int") == 1).alias("toxic")).where("text IS NOT NULL AND toxic IS NOT NULL")
    rows = rows.withColumn("th", F.xxhash64("text")).dropDuplicates(["th", "toxic"]).select("text", "toxic")  # copies are one text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            words, *cols = _word_counts(b.column(0), toxic)
            # the empty word counts texts
            cols = [np.append(c, x).astype(np.int64) for c, x in zip(cols, (toxic.sum(), (~toxic).sum(), 0), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([*words, ""], pa.string()), *map(pa.array, cols)], ["word", "toxic", "clean", "contexts"])

    words = rows.mapInArrow(tidy(count), "word string, toxic long, clean long, contexts long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("contexts").alias("contexts"))
    # a beginning has the texts of all words that begin so; one that no toxic text has is no candidate
    word = F.col("word")
    names = F.array_compact(F.array(F.when(word == "", word), F.when(word != "", F.concat(word, F.lit("$"))), *[F.when(F.length(word) >= n, F.substring(word, 1, n)) for n in PREFIXES]))
    counts = words.select(F.explode(names).alias("feature"), "toxic", "clean", "contexts").groupBy("feature").agg(F.sum("toxic").alias("all"), F.sum("clean").alias("b"), F.bit_count(F.bit_or("contexts")).alias("seen"))
    # as many words before as the hash values that were seen tell
    told = F.round(-CONTEXTS * F.log(1 - F.least(F.col("seen"), F.lit(CONTEXTS - 1)) / CONTEXTS))
    counts = counts.withColumn("a", F.when(F.col("feature") == "", F.col("all")).otherwise(F.least(F.col("all").cast("double"), told)).cast("double"))
    counts = counts.withColumn("b", F.col("b") * F.col("a") / F.col("all"))
    counts = materialize(counts.where(F.col("a") >= MIN_DOCS), "lexicon")
    totals = counts.where("feature = ''").first()
    n1, n0 = (totals["a"], totals["b"]) if totals else (0, 0)
    lexicon: dict[str, float] = {}
    if n1 and n0:
        a, b = F.col("a"), F.col("b").cast("double")
        share = n1 / (n1 + n0)

        def part(o, e):
            return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

        g2 = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
        least = NormalDist().inv_cdf(1 - CHANCE / (2 * max(1, counts.count()))) ** 2
        pure = counts.where("feature <> ''").where(a >= MIN_PURITY * (a + b)).withColumn("g2", g2).where(F.col("g2") > least)
        for r in pure.orderBy("feature").collect():
            lexicon[r["feature"]] = (r["a"] + 0.5) / (r["a"] + r["b"] + 1)
    prior = 0.5 * (n1 + 0.5) / (n1 + n0 + 1)
    return Model(lexicon, prior, CharacterModel(character_counts(texts, text_col)))


def labelled_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """docs with their label (toxic). An id with several labels has the largest; ids and labels that are null do not count.

    Null and empty texts, and repeated rows, come as they are. Empty tables give no rows. A column named toxic is replaced.
    """
    found = labels.select(F.col(f"`{id_col}`").cast("long").alias("__vg_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("__vg_id IS NOT NULL AND toxic IS NOT NULL")
    found = materialize(found.groupBy("__vg_id").agg(F.max("toxic").alias("toxic")), "labels")
    return docs.drop("toxic").join(F.broadcast(found) if small_enough(found) else found, F.col(f"`{id_col}`").cast("long") == F.col("__vg_id")).drop("__vg_id")


def _held(df: DataFrame, model: Model) -> Callable[[], Model]:
    """The model at the workers: an entry for each that passed, and 64**3 costs."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((model.lexicon, model.prior, model.characters.cost.astype(np.float32)))
    made: list[Model] = []

    def get() -> Model:
        if not made:
            lexicon, prior, cost = sent.value
            characters = CharacterModel.__new__(CharacterModel)
            characters.cost = cost
            made.append(Model(lexicon, prior, characters))
        return made[0]

    return get


def score(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """df with score and predicted (columns of these names are replaced).

    Null and empty texts have the prior as score. Repeated rows have equal scores; an empty table stays empty.
    """
    held = _held(df, model)

    @F.arrow_udf("double")
    def _score(texts: pa.Array) -> pa.Array:
        return pa.array(held().scores(texts))

    out = df.withColumn("score", _score(F.col(f"`{text_col}`")))
    return out.withColumn("predicted", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0))


def restore(df: DataFrame, model: Model, *, text_col: str = "text", into: str = "restored") -> DataFrame:
    """df with the texts restored (a column named ``into`` is replaced): disguised words of the lexicon as they were read. Null texts stay null."""
    held = _held(df, model)

    @F.arrow_udf("string")
    def _restore(texts: pa.Array) -> pa.Array:
        return pa.array(list(map(held().restored, texts.to_pylist())), pa.string())

    return df.withColumn(into, _restore(F.col(f"`{text_col}`")))
