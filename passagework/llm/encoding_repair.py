"""Problem 4: text that was decoded with the wrong encoding, by minimum description length.

Candidate decodings are chains of steps, each of which encodes a stretch of text as it was read and
decodes it as it may have been written.  Every candidate is compressed by zstandard with a
dictionary of each language, made of the words that intact texts of the collection use most; the
shortest description, chain cost included, wins, and where that is the text as it stands it is left
unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.runtime import materialize, ship

#: Words of a language's dictionary, at most.
WORDS = 3000
#: Bytes that each step of a chain, and each character no intact text of the language uses, costs.
STEP_COST = 1
STRANGE_COST = 4
DEPTH = 4

#: Letters beyond ASCII of the languages of the collection.
ALPHABETS = {
    "de": "äöüßÄÖÜẞ",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "es": "áéíñóúüÁÉÍÑÓÚÜ",
    "pt": "áâãàçéêíóôõúÁÂÃÀÇÉÊÍÓÔÕÚ",
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
    "sv": "åäöéÅÄÖÉøØæÆ",
}
#: Signs that intact texts use.
SIGNS = "¡¿«»“”‘’„‚–—…•€£¥©®™°±×÷½¼¾²³¹§µ·№ªº†→≈✓☕🚲‑−´   　​ 、。（）「」・ー"
SCRIPTS = {"ru": re.compile("[Ѐ-џ]"), "el": re.compile("[Ͱ-Ͽ]"), "ja": re.compile("[぀-ヿ一-鿿]")}
#: Encodings that UTF-8 is read as by mistake.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "koi8-r", "iso8859-2", "iso8859-7", "cp866", "cp852")
#: Fixed values: (read as, written in) for encodings other than UTF-8.
WRITTEN_IN = tuple(
    (r, w)
    for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp1250", "cp1253")
    for w in ("cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7", "cp1250", "iso8859-2", "cp852", "cp932", "euc_jp", "cp1252", "mac_roman", "cp850", "cp437", "latin-1")
    if r != w
)

NON_ASCII = re.compile("[^\x00-\x7f]")
PAIR = re.compile("(?=([^\x00-\x7f]{2}))")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
JAPANESE = re.compile("[぀-ヿ一-鿿]+")
PARTICLE = re.compile("[はがをのとにでてっや]")
QUOTED = re.compile("(?<![\\w])([“\"«'‘„‹])([^\\sA-Za-z0-9“\"«'‘„‹][^\\sA-Za-z0-9]{0,7})([”\"»'’“›])(?!\\w)")
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
STANDING = re.compile("(?<![A-ZÀ-Þ])Ã(?=[ \\t\\n  　]|$)|(?<!\\w)ã(?!\\w)")
TOKEN = re.compile("[^ \\t\\n\\r\\x0b\\x0c  　]+")


@lru_cache(maxsize=64)
def byte_chars(encoding: str) -> list[str | None]:
    """Character of every byte; undefined bytes of single-byte encodings pass as control characters."""
    out: list[str | None] = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b) if encoding.startswith("cp125") else None)
    return out


@lru_cache(maxsize=64)
def char_bytes(encoding: str) -> dict[str, int]:
    table = {c: b for b, c in enumerate(byte_chars(encoding)) if c}
    if encoding.startswith("cp125"):
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


def encode(s: str, encoding: str) -> bytes | None:
    table = char_bytes(encoding)
    try:
        return bytes([table[c] for c in s])
    except KeyError:
        return None


@lru_cache(maxsize=64)
def sequences(encoding: str, lower: bool = False) -> re.Pattern:
    """UTF-8 sequences of two bytes or more as they look when read in ``encoding``."""
    chars = byte_chars(encoding)
    extra = {b: chr(b) for b in range(0x80, 0xA0)} if encoding.startswith("cp125") else {}

    def group(lo: int, hi: int) -> str:
        found = {chars[b] for b in range(lo, hi + 1) if chars[b]} | {extra[b] for b in range(lo, hi + 1) if b in extra}
        if lower:
            found |= {c.lower() for c in found if len(c.lower()) == 1}
        return "[" + "".join(re.escape(c) for c in sorted(found)) + "]"

    tail = group(0x80, 0xBF)
    return re.compile(f"(?:{group(0xF0, 0xF4)}{tail}{{3}}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xC2, 0xDF)}{tail})+")


@lru_cache(maxsize=64)
def parts(encoding: str, lower: bool) -> tuple[frozenset, frozenset]:
    """Characters that can begin, and that can go on, a UTF-8 sequence read in ``encoding``."""
    table = char_bytes(encoding)
    lead = {c for c, b in table.items() if b >= 0xC2}
    tail = {c for c, b in table.items() if 0x80 <= b < 0xC0}
    if lower:
        lead, tail = lead | {c.lower() for c in lead}, tail | {c.lower() for c in tail}
    return frozenset(lead), frozenset(tail)


def utf8_step(s: str, encoding: str) -> str | None:
    raw = encode(s, encoding)
    if raw is None:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def raised(s: str) -> str:
    """Letters of Latin-1 and their like in capitals, as they were before a text was put in lower case."""
    return "".join(c.upper() if len(c.upper()) == 1 and (0xDF < ord(c) < 0xFF or c in "œšžÿ") else c for c in s)


def text_language(text: str) -> str | None:
    """Language of an intact text as far as its letters beyond ASCII show one and no other."""
    if CONTROL.search(text) or "�" in text:
        return None
    beyond = {c for c in text if c > "\x7f"} - set(SIGNS)
    if not beyond:
        return None
    for name, script in SCRIPTS.items():
        if all(script.match(c) or c in "々ー・、。（）？！：；「」" or 0xFF00 <= ord(c) < 0xFFF0 for c in beyond):
            return name
    fits = [name for name, letters in ALPHABETS.items() if beyond <= set(letters)]
    return min(fits, key=lambda n: len(ALPHABETS[n])) if fits else None


def text_words(text: str, language: str) -> list[str]:
    if language == "ja":
        return [w for run in JAPANESE.findall(text) for w in PARTICLE.split(run) if w]
    return WORD.findall(text)


class Dictionaries:
    """Compressors by language, words known and characters in use."""

    def __init__(self, words: dict[str, list[tuple[str, int]]]):
        self.words: set[str] = set()
        self.chars: set[str] = set(SIGNS) | set("".join(ALPHABETS.values())) | set("？！：；々￥％") | {chr(c) for c in range(0x3041, 0x30FF)} | {chr(c) for c in range(0x410, 0x450)} | set("ёЁ")
        self.chars |= {chr(c) for c in (*range(0x386, 0x3CF),) if chr(c).isalpha()}
        self.compressors = [zstandard.ZstdCompressor(level=19, write_checksum=False, write_content_size=False, write_dict_id=False)]
        for _, pairs in sorted(words.items()):
            self.words |= {w.lower() for w, _ in pairs if NON_ASCII.search(w)}
            self.chars |= {c for w, _ in pairs for c in w if c > "\x7f"}
            content = " ".join(w for w, _ in reversed(pairs)).encode()
            if len(content) >= 8:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=19)
                self.compressors.append(zstandard.ZstdCompressor(level=19, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.cache: dict[str, int] = {}
        self.runs: dict[str, str] = {}

    def cost(self, s: str) -> int:
        """Bytes of the shortest description of ``s`` in any language."""
        n = self.cache.get(s)
        if n is None:
            raw = s.encode("utf-8", "surrogatepass")
            n = min(len(c.compress(raw)) for c in self.compressors)
            n += STRANGE_COST * sum(c > "\x7f" and c not in self.chars for c in s)
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[s] = n
        return n

    def knows(self, s: str) -> bool:
        return any(len(w) > 2 and w.lower() in self.words for w in WORD.findall(s)) or any(w in self.words for run in JAPANESE.findall(s) for w in PARTICLE.split(run))


def _around(text: str, start: int, end: int) -> tuple[int, int]:
    """The word that a stretch lies in."""
    while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "'’"):
        start -= 1
    while end < len(text) and (text[end].isalnum() or text[end] in "'’"):
        end += 1
    return start, end


WAYS = [(e, lower) for e in READ_AS for lower in (False, True)]


class Ways(dict):
    """For a pair of characters the ways (as bits) in which it can begin a UTF-8 sequence read in another encoding."""

    def __missing__(self, pair: str) -> int:
        bits = 0
        for i, way in enumerate(WAYS):
            lead, tail = parts(*way)
            bits |= (pair[0] in lead and pair[1] in tail) << i
        self[pair] = bits
        return bits


POSSIBLE = Ways()


def _utf8_pass(text: str, d: Dictionaries) -> tuple[str, int]:
    """One step back for every stretch that is UTF-8 read as something else, if that shortens it."""
    best, gain = text, 0
    # a sequence shows as two characters or more beyond ASCII side by side; most intact texts have none that fit
    possible = 0
    for pair in set(PAIR.findall(text)):
        possible |= POSSIBLE[pair]
    for i, (encoding, lower) in enumerate(WAYS):
        if not possible >> i & 1:
            continue
        out, at, won = [], 0, 0
        for m in sequences(encoding, lower).finditer(text):
            new = utf8_step(m.group(0), encoding)
            if new is None and lower:
                new = utf8_step(raised(m.group(0)), encoding)
                new = new and new.lower()
            if new is None:
                continue
            if len(new) >= len(m.group(0)):
                continue
            s, e = _around(text, m.start(), m.end())
            before = text[s:e]
            after = text[s : m.start()] + new + text[m.end() : e]
            saved = d.cost(before) - d.cost(after) - STEP_COST
            # what is still garbled is taken back by the next step
            strange = [c for c in new if c > "\x7f" and c not in d.chars]
            if strange and not any(p.search(after) for p in (sequences("cp1252"), sequences("latin-1"))):
                continue
            if saved <= 0 and not (strange and len(new) < len(m.group(0))):
                continue
            out.append(text[at : m.start()] + new)
            at, won = m.end(), won + max(saved, 1)
        if won > gain:
            best, gain = "".join(out) + text[at:], won
    return best, gain


def _single_pass(text: str, d: Dictionaries) -> tuple[str, bool]:
    """Runs of words written in an encoding other than UTF-8 and read in another one."""
    runs, last = [], None
    for m in TOKEN.finditer(text):
        if NON_ASCII.search(m.group(0)):
            if last and text[last[1] : m.start()].strip("   　\t\n\r") == "":
                last = (last[0], m.end())
                runs[-1] = last
            else:
                last = (m.start(), m.end())
                runs.append(last)
    out, at, found = [], 0, False
    for s, e in runs:
        run = text[s:e]
        best = d.runs.get(run)
        if best is None:
            if len(d.runs) > 50_000:
                d.runs.clear()
            best = d.runs[run] = _single_run(run, d)
        if best != run:
            out.append(text[at:s] + best)
            at, found = e, True
    return "".join(out) + text[at:], found


def _single_run(run: str, d: Dictionaries) -> str:
    """A run of words as it was written, or as it is where that is no longer."""
    beyond = NON_ASCII.findall(run)
    lone = len(beyond) < 2
    if not set(beyond) - {"’", "“", "”", "–", "—", "…", " "}:
        return run
    words = [w for w in WORD.findall(run) if NON_ASCII.search(w)]
    if words and sum(w.lower() in d.words for w in words) * 2 > len(words):
        return run
    best, least = run, None
    for read in dict(WRITTEN_IN):
        raw = encode(run, read)
        if raw is None:
            continue
        for written in (w for r, w in WRITTEN_IN if r == read):
            try:
                new = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if any(c > "\x7f" and c not in d.chars for c in new) or not d.knows(new):
                continue
            # one character says little in bytes; there the dictionary has to know the word with its new character
            if lone and not any(len(w) > 3 and NON_ASCII.search(w) and w.lower() in d.words for w in WORD.findall(new)):
                continue
            least = d.cost(run) if least is None else least
            n = d.cost(new) + (0 if lone else STEP_COST + 2)
            if n < least or lone and best == run:
                best, least = new, n
    return best


def _back(text: str, d: Dictionaries, single_first: bool) -> tuple[str, bool]:
    """The text after the best chain of steps, in one of two orders, and whether there was any."""
    now, changed = _single_pass(text, d) if single_first else (text, False)
    for _ in range(DEPTH):
        new, gain = _utf8_pass(now, d)
        if gain <= 0:
            break
        now, changed = new, True
    fixed = STANDING.sub("à", now)
    if fixed != now:
        now, changed = fixed, True
    if not single_first:
        now, found = _single_pass(now, d)
        changed = changed or found
    return now, changed


def repair(text: str, d: Dictionaries) -> tuple[bool, str | None]:
    """(whether the text is garbled, the original where it can be told)."""
    if not NON_ASCII.search(text):
        return False, None
    spoken: list[str] = []

    def hide(m: re.Match) -> str:
        inner = m.group(2)
        garbled = "�" in inner or CONTROL.search(inner) or any(sequences(e).fullmatch(inner) for e in READ_AS)
        if not garbled:
            return m.group(0)
        spoken.append(m.group(0))
        return f" \x01{len(spoken) - 1}\x01 "

    now = QUOTED.sub(hide, text)
    lost = "�" in now or bool(CONTROL.search(now))
    first, second = _back(now, d, False), _back(now, d, True)
    # whole texts are compared only where both orders changed them, and not in the same way
    both = first[1] and second[1] and first[0] != second[0]
    now, changed = min((first, second), key=lambda r: (not r[1], d.cost(r[0]) if both else 0))
    if not (lost or changed):
        return False, None
    back = re.sub(r" \x01(\d+)\x01 ", lambda m: spoken[int(m.group(1))], now)
    whole = "�" not in now and not CONTROL.search(now) and back != text
    return True, back if whole else None


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            language = text_language(text)
            if language:
                counts.update((language, w) for w in text_words(text, language))
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([counts[k] for k in keys], pa.int64())], ["language", "word", "n"])


def word_counts(texts: DataFrame, text: str = "text") -> dict[str, list[tuple[str, int]]]:
    """The ``WORDS`` most used words of intact texts of each language, over all texts.

    A word that is rarer than a two-hundredth of the language's most frequent one with a letter beyond
    ASCII is left out, since it may itself be garbled.
    """
    rows = texts.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[^\\x00-\\x7F]"))
    counts = materialize(rows.mapInArrow(_count_words, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n")), "words")
    order = Window.partitionBy("language").orderBy(F.desc("n"), "word")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= WORDS).orderBy("language", "place").collect()
    out: dict[str, list[tuple[str, int]]] = {}
    for r in top:
        out.setdefault(r["language"], []).append((r["word"], r["n"]))
    for language, pairs in out.items():
        most = max((n for w, n in pairs if NON_ASCII.search(w)), default=0)
        out[language] = [(w, n) for w, n in pairs if n * 200 >= most and n > 1] or pairs
    return out


def _repair_batches(words: dict[str, list[tuple[str, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Dictionaries(words)
        for batch in batches:
            ids, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                case, original = repair(text, d)
                if case:
                    ids.append(i)
                    out.append(original)
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("origin").take(at), batch.column("id").take(at), pa.array(out, pa.string())], ["origin", "id", "restored"])

    return run


def garbled(texts: DataFrame) -> DataFrame:
    """``origin, id, restored`` of every row of ``texts`` (origin, id, text) that is garbled.

    ``restored`` is null where the original can't be told.  Rows with a null id or text take no part,
    rows delivered twice come out once, an empty table gives no rows.  Of very long texts every word
    is looked at.
    """
    ship(texts.sparkSession)
    rows = texts.select("origin", F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    words = word_counts(rows)
    beyond = rows.where(F.col("text").rlike("[^\\x00-\\x7F]"))
    found = beyond.mapInArrow(_repair_batches(words), "origin string, id string, restored string")
    return found.groupBy("origin", "id").agg(F.max("restored").alias("restored"))
