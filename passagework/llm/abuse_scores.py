"""Problem 9: scoring abusive, hateful or sexual content by non-negative positive-unlabelled learning.

Documents are cut into segments (sentences), segments are normalised against disguises and become
sets of 64-bit word n-grams.  A linear classifier learns in numpy from segments of confirmed abusive
documents and from unlabelled segments, by the non-negative risk estimator with the class prior
taken from the ratings.  Which n-grams may speak is decided from their counts over all documents.
Which segments of a rated document make it abusive isn't known, so learning alternates with
choosing them.  A document scores as high as its worst segment.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.soft_mixing import canonical
from passagework.runtime import ship

#: Rows that the classifier is fitted on: at most about so many documents rated abusive and so many others.
RATED = 4_000
OTHERS = 20_000
#: Texts whose words are hashed at once.
ROWS = 1_000
#: An n-gram may speak for abuse if it is met in ``MET`` rated documents or more, and its counts make
#: it exp(``SURE``) times likelier that only abusive documents have it than that any document may.
MET = 2
SURE = 2.5
AROUND = 4
DOUBT = -2.0
THRESHOLD = 0.5

#: Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ј": "j", "ӏ": "l", "α": "a", "ο": "o", "ε": "e", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "8": "b", "9": "g", "6": "g"}

INVISIBLE = re.compile("[­​-‏⁠﻿]")
SPACED = re.compile(r"(?<![\w*])(?:[^\W\d_][ \-._*·]){2,}[^\W\d_](?![\w*])")
TOKEN = re.compile(r"[\w@$*|]+(?:[!][\w@$*]+)*(?:['’][^\W\d_]+)?|[.!?。！？…]")
RUN = re.compile(r"(.)\1+")
EAST = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
LATIN = re.compile(r"[a-z]")
OTHER_SCRIPT = re.compile(r"[Ͱ-ϿЀ-ӿԀ-֏ɐ-ʯ]")
ENDS = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")
BREAK = ""
EAST_ENDS = "。！？"


def plain(word: str) -> str:
    """A word without disguise: look-alikes and signs as letters, repeats once, censored letters masked."""
    if OTHER_SCRIPT.search(word) and LATIN.search(word):
        word = "".join(LOOKALIKES.get(c, c) for c in word)
    if not word.isdigit() and LATIN.search(word):
        letters = sum(c.isalpha() for c in word)
        if letters * 2 >= len(word) - word.count("*") and not re.fullmatch(r"[a-z]+\d+", word):
            word = "".join(SIGNS.get(c, c) for c in word)
        elif re.fullmatch(r"[a-z]+\d+", word):
            word = re.sub(r"\d+$", "0", word)
    elif word.isdigit():
        return "0"
    return RUN.sub(r"\1", word)


def masked(word: str) -> str:
    """A censored word by its first and last letter; how many are hidden varies with what is squeezed."""
    return f"{word[0]}*{word[-1]}"


def _joined(m: re.Match) -> str:
    """Spaced letters as one word; an article or pronoun before it may be the first letter, so it is read both ways."""
    word = re.sub(r"[ \-._*·]", "", m.group(0))
    return f"{word} {word[0]} {word[1:]}" if word[0] in "aAiIyY" and m.group(0)[1] == " " and len(word) > 3 else word


def normal(text: str) -> str:
    if text.isascii():
        return text
    text = INVISIBLE.sub("", text)
    return (text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).replace("’", "'")


class Chunks(dict):
    """Numbers of what stands between blanks, parsed once each.

    A chunk is a row of codes: the hash of a word and of its mask, 0 where a segment ends, 1 where
    there is no mask.
    """

    END, COMMA, UPPER, LETTER, CAPITALS = 1, 2, 4, 8, 16
    MOST = 400_000

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.start, self.count, self.flags, self.word, self.mask = (array(t) for t in "qqqQQ")

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a, np.uint64 if a.typecode == "Q" else np.int64) for a in (self.start, self.count, self.flags, self.word, self.mask))

    def __missing__(self, chunk: str) -> int:
        number, body = len(self), chunk.rstrip(".,;:!?")
        self.start.append(len(self.word))
        end = chunk[-1]
        if body.isascii() and (body.isalpha() or body.isdigit()):
            # most chunks are a word and a mark
            w = RUN.sub(r"\1", body.lower()) if body.isalpha() else "0"
            self.word.append(xxhash.xxh64_intdigest(w) | 2)
            self.mask.append(xxhash.xxh64_intdigest("\x1e" + masked(w)) | 2 if len(w) > 2 else 1)
            self.count.append(1)
            letter = len(body) == 1 and body.isalpha()
            self.flags.append(self.END * (end in ".!?") + self.COMMA * (end == ",") + self.UPPER * body[0].isupper() + self.LETTER * letter + self.CAPITALS * body.isupper())
        else:
            rows = self.parse(chunk)
            for w, m in rows:
                self.word.append(w)
                self.mask.append(m)
            self.count.append(len(rows))
            bare = chunk.rstrip(".,!?;:…\"'”’»)")
            letter = len(bare) == 1 and bare.isalpha()
            self.flags.append(self.END * bool(chunk == BREAK or ENDS.search(chunk)) + self.COMMA * (end == ",") + self.UPPER * chunk[0].isupper() + self.LETTER * letter + self.CAPITALS * chunk.isupper())
        self[chunk] = number
        return number

    @staticmethod
    def parse(chunk: str) -> list[tuple[int, int]]:
        rows = []
        for w in TOKEN.findall(SPACED.sub(_joined, chunk).lower()):
            if EAST.search(w):
                rows += [(xxhash.xxh64_intdigest(c) | 2, 1) for c in w]
            elif w in EAST_ENDS:
                rows.append((0, 1))
            elif w.strip("_|*@$.!?…"):
                w = plain(w)
                m = xxhash.xxh64_intdigest("\x1e" + masked(w)) | 2 if len(w) > 2 and w[0] != "*" and w[-1] != "*" else 1
                rows.append((xxhash.xxh64_intdigest(w) | 2, m))
        return rows


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) ^ b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def features(texts: list[str | None], chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, segment, feature) of all features of ``texts``, and the number of segments.

    Features are word n-grams of up to three words, and masks of words alone and beside a word.
    """
    flat: list[str] = []
    size = np.zeros(len(texts), np.int64)
    if len(chunks) > Chunks.MOST:
        chunks.reset()
    for i, t in enumerate(texts):
        if t:
            found = normal(t).replace("\n", f" {BREAK} ").split()
            flat += found
            size[i] = len(found)
    ids = np.fromiter(map(chunks.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(texts)), size)
    letter = np.array(chunks.flags, np.int64)[ids] & Chunks.LETTER > 0
    spaced = np.flatnonzero(letter[2:] & letter[1:-1] & letter[:-2]) if len(ids) > 2 else []
    if len(spaced):
        # words with blanks between their letters are joined before the text is cut
        ends = np.cumsum(size)
        parts, sizes, last = [], size.copy(), 0
        for i in np.unique(doc[spaced]).tolist():
            again = SPACED.sub(_joined, normal(texts[i])).replace("\n", f" {BREAK} ").split()
            parts += [ids[last : ends[i] - size[i]], np.fromiter(map(chunks.__getitem__, again), np.int64, len(again))]
            last, sizes[i] = ends[i], len(again)
        ids = np.concatenate([*parts, ids[last:]])
        doc = np.repeat(np.arange(len(texts)), sizes)
    start, count, flags, words, masks = chunks.arrays()
    flags, count = flags[ids], count[ids]
    cut = flags & Chunks.END > 0
    # a capital after a comma begins a segment, unless all is in capitals
    cut[:-1] |= (flags[:-1] & (Chunks.COMMA | Chunks.CAPITALS) == Chunks.COMMA) & (flags[1:] & Chunks.UPPER > 0)
    total = int(count.sum())
    first = np.cumsum(count) - count
    at = np.arange(total) + np.repeat(start[ids] - first, count)
    word, mask = words[at], masks[at]
    doc_of = np.repeat(doc, count)
    # a segment begins after a chunk that ends one, after an end within a chunk, and with a text
    before = np.concatenate([[0], np.cumsum(cut | np.append(doc[1:] != doc[:-1], True))[:-1]]) if len(ids) else np.zeros(0, np.int64)
    segment = np.repeat(before, count) + np.cumsum(word == 0)
    real = word != 0
    word, mask, doc_of, segment = word[real], mask[real], doc_of[real], segment[real]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    new = np.concatenate([[True], segment[1:] != segment[:-1]])
    segment = np.cumsum(new) - 1
    same = ~new[1:]
    one = np.flatnonzero(same)
    two = np.flatnonzero(same[1:] & same[:-1]) if len(same) > 1 else one[:0]
    pair = _mix(word[:-1], word[1:], 11)
    hidden = np.flatnonzero(mask != 1)
    left = one[mask[one + 1] != 1]
    right = one[mask[one] != 1]
    found = np.concatenate([word, pair[one], _mix(pair[two], word[two + 2], 13), mask[hidden], _mix(word[left], mask[left + 1], 17), _mix(mask[right], word[right + 1], 19)])
    where = np.concatenate([np.arange(len(word)), one, two, hidden, left, right])
    return doc_of[where], segment[where], found, int(segment[-1]) + 1


class Known:
    """A set of features with their places, looked up through a table of their leading bits."""

    BITS = 21

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.lead = np.zeros(1 << self.BITS, bool)
        self.lead[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``found``, places among the keys) of what is known."""
        at = np.flatnonzero(self.lead[(found >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
        hit = self.keys[place] == found[at]
        return at[hit], place[hit]


class Rows:
    """Sparse rows of binary features; ``more`` rows have none at all."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int, width: int, more: int = 0):
        self.row, self.col, self.n, self.width, self.more = row, col, n, width, more

    def dot(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) + bias

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.width)


def fit_nnpu(positive: Rows, unlabelled: Rows, prior: float, harmless: np.ndarray, steps: int = 80, rate: float = 0.15, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss, by Adam.

    Where the second part falls below zero its gradient is turned round, as the estimator asks.
    Weights of ``harmless`` features can only speak against abuse.
    """
    width = positive.width
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    whole = unlabelled.n + unlabelled.more
    for i in range(1, steps + 1):
        zp, zu = positive.dot(w, bias), unlabelled.dot(w, bias)
        sp, su, s0 = sigmoid(zp), sigmoid(zu), float(sigmoid(bias))
        negative = (np.logaddexp(0, zu).sum() + unlabelled.more * np.logaddexp(0, bias)) / whole - prior * np.logaddexp(0, zp).mean()
        gp, gu, g0 = prior * (sp - 1) / positive.n - prior * sp / positive.n, su / whole, s0 * unlabelled.more / whole
        if negative < 0:
            gp, gu, g0 = prior * sp / positive.n, -gu, -g0
        g = np.append(positive.back(gp) + unlabelled.back(gu) + decay * prior * w, gp.sum() + gu.sum() + g0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
        w[harmless] = np.minimum(w[harmless], 0)
    return w, bias


def choose(doc: np.ndarray, score: np.ndarray, above: float) -> np.ndarray:
    """The worst segment of every document, and those scored above a limit."""
    order = np.lexsort((-score, doc))
    first = np.concatenate([[True], doc[order][1:] != doc[order][:-1]]) if len(order) else np.array([], bool)
    out = score > above
    out[order[first]] = True
    return out


class Segments:
    """Segments as parallel arrays: (segment, feature) pairs and the document of each segment."""

    def __init__(self, doc: np.ndarray, row: np.ndarray, feature: np.ndarray, more: int = 0):
        self.doc, self.more = doc, more
        order = np.lexsort((feature, row))
        row, feature = row[order], feature[order]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])]) if len(row) else np.zeros(0, bool)
        self.row, self.feature = row[once], feature[once]

    def documents_with(self) -> tuple[np.ndarray, np.ndarray]:
        """(features, number of documents that have each)."""
        doc = self.doc[self.row]
        order = np.lexsort((doc, self.feature))
        f, d = self.feature[order], doc[order]
        once = np.concatenate([[True], (f[1:] != f[:-1]) | (d[1:] != d[:-1])]) if len(f) else np.zeros(0, bool)
        return np.unique(f[once], return_counts=True)

    def rows(self, known: Known, pick: np.ndarray | None = None) -> Rows:
        at, place = known.places(self.feature)
        row = self.row[at]
        n = len(self.doc)
        if pick is not None:
            number = np.cumsum(pick) - 1
            keep = pick[row]
            row, place, n = number[row[keep]], place[keep], int(pick.sum())
        return Rows(row, place, n, len(known.keys), 0 if pick is not None else self.more)


def speaking(counts: np.ndarray, whole: np.ndarray, n_rated: int, n_all: int, rate: float) -> np.ndarray:
    """Which features have counts that speak for abuse.

    ``counts`` are rated documents with a feature, ``whole`` all documents with it.  If only abusive
    documents have a feature, each of them was drawn with the chance n_rated / abusive documents; if
    any may have it, with n_rated / n_all.
    """
    if not n_rated:
        return np.zeros(len(counts), bool)
    p0 = min(0.5, n_rated / max(1, n_all))
    p1 = min(0.98, max(p0 * 1.5, n_rated / max(1.0, n_all * rate)))
    b = np.maximum(whole, counts)
    sure = counts * np.log(p1 / p0) + (b - counts) * np.log((1 - p1) / (1 - p0))
    return (counts >= MET) & (sure >= SURE)


def learn(rated: Segments, others: Segments, keep: np.ndarray, n_others: int, rate: float, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) from segments of rated documents and of others.

    ``keep`` are the features that may speak for abuse; ``others`` has in full the segments with such
    a feature and the number of the rest in ``more``.  A rated document none of whose segments comes
    above ``DOUBT`` is taken for a wrong rating.
    """
    nothing = np.zeros(0, np.uint64), np.zeros(0), -30.0
    if not len(keep) or not len(rated.doc) or not len(others.doc) + others.more:
        return nothing
    known = Known(keep)
    inner, outer = rated.rows(known), others.rows(known)
    n_rated = len(np.unique(rated.doc))
    # at first: how much more often a feature is met in rated segments than elsewhere
    a, b = (np.bincount(x.col, minlength=x.width) for x in (inner, outer))
    odds = np.clip(np.log((a + 0.1) / (inner.n + 1)) - np.log((b + 1.0) / (outer.n + outer.more + 1)), 0, 4)
    start = inner.dot(odds, 0.0)
    picked = choose(rated.doc, start, np.inf) & (start > 0)
    w, bias, harmless = np.zeros(len(known.keys)), -30.0, np.zeros(len(known.keys), bool)
    for turn in range(rounds):
        if not picked.any():
            break
        positive = rated.rows(known, picked)
        # of all segments so many are abusive: the rated share of documents, less wrong ratings, by segments
        prior = float(np.clip(rate * picked.sum() / n_rated * n_others / (len(others.doc) + others.more), 1e-4, 0.5))
        w, bias = fit_nnpu(positive, outer, prior, harmless)
        score = inner.dot(w, bias)
        picked = (choose(rated.doc, score, np.inf) & (score > DOUBT)) | (score > 0)
        if turn == 0 and rounds > 1:
            # what surrounds the same words where they are harmless is learnt from now on as well
            near = outer.dot(w, bias) > DOUBT
            around, n = np.unique(others.feature[near[others.row]], return_counts=True)
            speaking_ = known.keys
            known = Known(np.concatenate([known.keys, around[n >= AROUND]]))
            harmless = ~np.isin(known.keys, speaking_)
            inner, outer = rated.rows(known), others.rows(known)
    return known.keys, w, bias


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a bounded number of texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            part = whole.slice(at, ROWS)
            yield part, part.column(column).to_pylist()


def _segment_rows(keep: np.ndarray | None = None):
    """``doc_id, features, n``: every segment, or those with a feature of ``keep`` and how many there were in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, known = Chunks(), None if keep is None else Known(keep)
        for part, texts in _batches(batches, "text"):
            doc, segment, found, n = features(texts, chunks)
            order = np.argsort(segment, kind="stable")
            doc, segment, found = doc[order], segment[order], found[order]
            if known is not None:
                hit = np.zeros(n, bool)
                hit[segment[known.places(found)[0]]] = True
                doc, segment, found = (x[hit[segment]] for x in (doc, segment, found))
            cut = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else np.zeros(0, np.int64)
            ids = part.column("doc_id").take(pa.array(doc[cut]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(segment)).astype(np.int32)), pa.array(found.view(np.int64)))
            # the number of segments goes with the first row, or with a row of its own
            if len(cut):
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(np.append(n, np.zeros(len(cut) - 1, np.int64)))], ["doc_id", "features", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([[]], pa.list_(pa.int64())), pa.array([n])], ["doc_id", "features", "n"])

    return run


SEGMENT = "doc_id long, features array<long>, n long"


def _collected(rows: DataFrame) -> Segments:
    table = rows.toArrow()
    sizes = table.column("n").to_numpy()
    table = table.filter(table.column("doc_id").is_valid())
    lists = table.column("features").combine_chunks()
    length = lists.value_lengths().to_numpy(zero_copy_only=False) if len(table) else np.zeros(0, np.int64)
    found = lists.flatten().to_numpy(zero_copy_only=False) if len(table) else np.zeros(0, np.int64)
    return Segments(table.column("doc_id").to_numpy(), np.repeat(np.arange(len(table)), length), found.view(np.uint64), int(sizes.sum()) - len(table))


def _count(keys: np.ndarray):
    """``at, n``: in how many of the documents read each of ``keys`` is met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, known, total = Chunks(), Known(keys), np.zeros(len(keys), np.int64)
        for _, texts in _batches(batches, "text"):
            doc, _, found, _ = features(texts, chunks)
            at, place = known.places(found)
            once = np.unique(doc[at] * len(keys) + place)
            total += np.bincount(once % len(keys), minlength=len(keys))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["at", "n"])

    return run


def _scores(keys: np.ndarray, w: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, known = Chunks(), Known(keys)
        for part, texts in _batches(batches, "text"):
            worst = np.full(len(texts), -30.0)
            if len(keys):
                doc, segment, found, n = features(texts, chunks)
                at, place = known.places(found)
                once = np.unique(segment[at] * len(keys) + place)
                z = np.bincount(once // len(keys), weights=w[once % len(keys)], minlength=n) + bias
                of = np.zeros(n, np.int64)
                of[segment] = doc
                np.maximum.at(worst, of, z)
            score = 1 / (1 + np.exp(-np.clip(worst, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(score)], ["doc_id", "source", "score"])

    return run


def confirmed(labels: DataFrame) -> tuple[DataFrame, float]:
    """``doc_id`` of the documents whose abuse is confirmed, and their share of the rated ones.

    A rating is confirmed by the category of what was found; where no rating has a category, all
    ratings as abusive count.
    """
    bad = labels.where("doc_id is not null and abusive = 1")
    if "category" in labels.columns and not bad.where("category is not null").isEmpty():
        bad = bad.where("category is not null")
    bad = bad.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    judged = labels.where("doc_id is not null and abusive is not null").select("doc_id").distinct().count()
    return bad, bad.count() / max(1, judged)


def _share(column: str, salt: str, most: int, of: int):
    """A condition that keeps about ``most`` of ``of`` rows."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1_000_000)) < min(1.0, most / max(1, of)) * 1_000_000


def train(documents: DataFrame, labels: DataFrame, node: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias), fitted on about ``RATED`` confirmed documents and about ``OTHERS`` others.

    Which features may speak is decided from their counts over all documents.
    """
    ship(documents.sparkSession)
    bad, rate = confirmed(labels)
    docs = documents.select(F.col(node).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    total = docs.count()
    picked = bad.where(_share("doc_id", "rated", RATED, bad.count()))
    rated = _collected(docs.join(picked, "doc_id", "left_semi").mapInArrow(_segment_rows(), SEGMENT))
    keys, counts = rated.documents_with()
    keys, counts = keys[counts >= MET], counts[counts >= MET]
    whole = np.zeros(len(keys), np.int64)
    if len(keys):
        added = docs.select("text").mapInArrow(_count(keys), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each key
        whole[added.column("at").to_numpy()] = added.column("n").to_numpy()
    keep = keys[speaking(counts, whole, len(np.unique(rated.doc)), total, rate)]
    sample = docs.where(_share("doc_id", "other", OTHERS, total)).join(bad, "doc_id", "left_anti")
    others = _collected(sample.mapInArrow(_segment_rows(keep), SEGMENT))
    return learn(rated, others, keep, max(1, min(OTHERS, total)), rate)


def abuse_scores(documents: DataFrame, labels: DataFrame, node: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, score`` of every document.

    A null or empty text scores next to nothing; rows without id are left out; rows repeated under
    one id are scored each.  Ratings without document, without value or id are ignored, of several
    ratings the higher counts; ratings as abusive without a category are taken for wrong ones where
    others have one.  Without any confirmed rating no document is abusive.
    """
    keys, w, bias = train(documents, labels, node, text)
    docs = documents.select(F.col(node).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), canonical(F.col(source)).alias("source")).where("doc_id is not null")
    return docs.mapInArrow(_scores(keys, w, bias), "doc_id long, source string, score double")


def abuse_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, documents, abusive, rate, mean_score`` of every source; a null source is one of its own."""
    bad = F.sum((F.col("score") >= threshold).cast("int"))
    n = F.count(F.lit(1))
    return scores.groupBy("source").agg(n.alias("documents"), bad.alias("abusive"), F.round(bad / n, 6).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score"))
