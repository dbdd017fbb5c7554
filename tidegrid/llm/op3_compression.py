"""Quality rules by compression bands.

Each text is compressed with zstandard, whole and in fixed chunks; the last chunk is moved back to end where the text ends, and
counts as much of the text as no other chunk holds. A text whose ratio (bytes before : after) lies above
the upper limit of its length repeats itself; one below the lower limit is noise. Limits depend on the length, because
short texts compress less. Base counts of words, symbols, lines and repeated word windows come from the same pass.

Every text is judged alone, inside the task that read it: no shuffle, and memory is bounded by one Arrow batch.

Defined results: a null or empty text has no words and fails the base rules; rows are kept as they come, repeats
included; a null id stays null; an empty table gives an empty table; further input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, worst_chunk_ratio double, bad_chunk_share double, kept boolean"
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """(bytes below, least ratio, greatest ratio); the first band that fits a length holds. Chunks are all of one length, and have limits of their own."""

    whole: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 4.0),
        (256, 0.9, 3.0),
        (1024, 1.15, 3.2),
        (4096, 1.35, 3.5),
        (16384, 1.5, 4.0),
        (float("inf"), 1.6, 4.5),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.35, 3.5)
    bad_share: float = 0.25
    level: int = 3


def repeated_window_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more in ``words``."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
    if len(names) == len(words):
        return 0
    key = ids[:n].copy()
    for i in range(1, size):  # dense ranks of growing windows: exact, no hash
        key = key * len(names) + ids[i : i + n]
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    again = np.bincount(key)[key] > 1
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at 0x20 and 0x09-0x0D only, as bytes
    # without the white space, code points are the bytes that don't continue a character
    joined = np.frombuffer(b"".join(words), dtype=np.uint8)
    chars = int(np.count_nonzero((joined & 0xC0) != 0x80))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_window_words(words)


def ratios(raw: bytes, compressor, chunk_bytes: int) -> tuple[float, list[tuple[float, int]]]:
    """Ratio of the whole text, and (ratio, bytes that only it holds) of each chunk; a text shorter than a chunk has none."""
    if not raw:
        return 0.0, []
    whole = len(raw) / len(compressor.compress(raw))
    parts = []
    for i in range(0, len(raw), chunk_bytes) if len(raw) >= chunk_bytes else ():
        at = min(i, len(raw) - chunk_bytes)
        parts.append((chunk_bytes / len(compressor.compress(raw[at : at + chunk_bytes])), at + chunk_bytes - i))
    return whole, parts


def verdict(n_bytes: int, whole: float, parts: list[tuple[float, int]], bands: Bands) -> tuple[float, float, bool]:
    """The chunk ratio farthest from its limits, the share of the text in bad chunks, and whether the text passes."""
    low, high = next((a, b) for top, a, b in bands.whole if n_bytes < top)
    if not parts:
        return whole, 0.0, low <= whole <= high
    bad = sum(n for x, n in parts if not bands.chunk[0] <= x <= bands.chunk[1]) / n_bytes
    worst = max((x for x, _ in parts), key=lambda x: max(bands.chunk[0] / x, x / bands.chunk[1]))
    return worst, bad, low <= whole <= high and bad <= bands.bad_share


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Base counts, ratios and verdict of every row of ``docs``."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                counts = base_counts(text)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                raw = (text or "").encode("utf-8", "surrogatepass")
                whole, parts = ratios(raw, compressor, bands.chunk_bytes)
                worst, bad, passed = verdict(len(raw), whole, parts, bands)
                rows.append((*counts, failed, whole, worst, bad, passed and not failed))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "worst_chunk_ratio", "bad_chunk_share", "kept"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInPandas(judge, SCHEMA)
