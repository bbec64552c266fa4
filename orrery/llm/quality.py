"""Quality rules: compression bands."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.frames import add_columns, documents

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5


@dataclass(frozen=True)
class Band:
    """Texts of at least min_bytes (the last band that fits counts) must compress to a ratio from low to high."""

    min_bytes: int
    low: float
    high: float


#: zstandard at level 3. Short texts compress little and carry a frame's overhead, so bands widen downwards; prose of
#: natural or invented words stays near 0.35 to 0.6 from 1 KB on; base64 and other codes lie above 0.7.
BANDS = (Band(0, 0.0, 100.0), Band(64, 0.20, 100.0), Band(256, 0.24, 0.95), Band(1024, 0.26, 0.75), Band(4096, 0.20, 0.68), Band(16384, 0.15, 0.65))
#: Whole chunks of a text are held against these, and what is left after them against the band of its length; a text goes if
#: more than CHUNK_SHARE of its bytes lie in chunks that fall outside.
CHUNK_BYTES, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE, LEVEL = 2048, 0.22, 0.78, 0.5, 3

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("zstd_ratio", T.DoubleType()),
    T.StructField("bad_byte_share", T.DoubleType()),
]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more in the text, first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    at: dict[bytes, int] = {}
    ids = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, n)
    if len(at) == n:
        return 0
    # Windows as exact numbers: pairs of ids are numbered again before they are combined, so nothing overflows.
    pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    four = np.unique(pair[:-2] * n + pair[2:], return_inverse=True)[1]
    _, five, count = np.unique(four[:-1] * n + ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[five] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at \x20 and \x09-\x0D only
    n = len(words)
    chars = sum(map(len, words)) if len(raw) == len(text) else len(b"".join(words).decode())
    symbols = len(_SYMBOL.findall(text))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeat_words(words)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, n < 10 or 100 * repeats > 20 * n


def band_of(n_bytes: int) -> Band:
    return [b for b in BANDS if n_bytes >= b.min_bytes][-1]


def _checker():
    import zstandard

    zstd = zstandard.ZstdCompressor(level=LEVEL)

    def check(raw: bytes) -> tuple[bool, float | None, float | None]:
        """(within the bands, ratio of the whole, share of bytes in chunks outside)."""
        if not raw:
            return False, None, None
        ratio_of = lambda x: len(zstd.compress(x)) / len(x)
        ratio, band = ratio_of(raw), band_of(len(raw))
        bad = 0
        for i in range(0, len(raw), CHUNK_BYTES):
            chunk = raw[i : i + CHUNK_BYTES]
            low, high = (CHUNK_LOW, CHUNK_HIGH) if len(chunk) == CHUNK_BYTES else (band_of(len(chunk)).low, band_of(len(chunk)).high)
            if not low <= (ratio if len(chunk) == len(raw) else ratio_of(chunk)) <= high:
                bad += len(chunk)
        return band.low <= ratio <= band.high and bad <= CHUNK_SHARE * len(raw), ratio, bad / len(raw)

    return check


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with counts, base_failed, kept, zstd_ratio and bad_byte_share appended; a row-wise job without a shuffle.

    base_failed: under ten words, or over a fifth of the words in repeated five-word windows. kept: not base_failed and the whole text's
    zstandard ratio lies in the band of its length and at most half of its bytes lie in chunks outside theirs, the last, shorter chunk
    included. Null and empty texts have no words: base_failed, not kept, ratios null. Texts of any length are judged whole, one at a time.
    Equal rows get equal verdicts, an empty table gives no rows. Extra columns pass through; ones named as the results are replaced.
    """

    def compute(texts: list) -> list[list]:
        check = _checker()
        out: list[list] = [[] for _ in FIELDS]
        for text in texts:
            *counts, failed = base_counts(text)
            good, ratio, bad = check((text or "").encode())
            for column, value in zip(out, [*counts, failed, good and not failed, ratio, bad], strict=True):
                column.append(value)
        return out

    return add_columns(docs, [text_col], FIELDS, compute)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
