"""Text expressions; white space and word characters are Unicode's, spelled out as classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, and what cleaning keeps besides letters and digits.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
DROPPED = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}.,;:!?'\"-]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clean_text(text: Column) -> Column:
    """Strip, collapse white space, then drop odd characters (which may leave double spaces)."""
    return F.regexp_replace(F.regexp_replace(strip(text), f"{SPACE}+", " "), DROPPED, "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def chunk_text(text: Column, size: int = 256, overlap: int = 32) -> Column:
    """Overlapping windows of words; a text of up to ``size`` words is kept verbatim."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and less than size")
    w = words(text)
    starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))
    cut = F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " "))
    return F.when(F.size(w) <= size, F.array(text)).otherwise(cut)


def prompt_tokens(text: Column) -> Column:
    """Estimate of tokens: 1.3 for a word, cut to a whole number."""
    return (word_count(text) * F.lit(1.3).cast("double")).cast("int")


def md5_seed(text: Column) -> Column:
    """First eight hexadecimal digits of the MD5 sum as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def iso_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def time_stamp(t: Column) -> Column:
    """Date and time as they stand in names of files."""
    return F.date_format(t, "yyyyMMdd_HHmmss")


def human_size(size: Column) -> Column:
    """Bytes in GB, MB or KB with one decimal."""

    def tenths(step: int, unit: str) -> Column:
        t = F.floor((size.cast("bigint") + step // 2) / step).cast("bigint")
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string"), F.lit(f" {unit}"))

    return F.when(size > 1_000_000_000, tenths(100_000_000, "GB")).when(size > 1_000_000, tenths(100_000, "MB")).otherwise(tenths(100, "KB"))


def auto_clusters(n: Column) -> Column:
    """Number of IVF clusters for ``n`` vectors."""
    return F.when(n <= 10_000, 32).when(n <= 100_000, 64).when(n <= 500_000, 128).otherwise(256)
