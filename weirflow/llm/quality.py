"""Quality rules by compression bands.

Zstandard ratios (bytes in / bytes out) of a whole document and of its fixed chunks tell repetitive text (very high)
and noise (about 1) from prose. A ratio grows with the length of what is compressed, so that the limits depend on it.
A document is rejected if its whole ratio leaves the band of its length, or if chunks that leave theirs hold more than ``max_bad_share`` of its bytes. Base metrics (word counts, symbols, repeated lines and windows) are exact.

Null or empty text: no words, all counts 0, base_failed, not kept. Very long texts are chunked, never cut.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame

from weirflow.llm.common import arrow_map

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits by length: straight lines, over the logarithm of the length in bytes, between these points; level beyond the last, the compressor's window."""

    at: tuple[int, ...] = (64, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536, 131072, 262144, 524288, 1048576, 2097152)
    low: tuple[float, ...] = (0.7, 1.0, 1.1, 1.2, 1.3, 1.4, 1.45, 1.5, 1.5, 1.5, 1.5, 1.5, 1.5, 1.5)
    high: tuple[float, ...] = (1.6, 1.75, 1.92, 2.08, 2.2, 2.3, 2.4, 2.48, 2.6, 2.75, 2.78, 2.88, 2.98, 3.05)
    chunk: int = 2048
    max_bad_share: float = 0.5
    level: int = 3

    def limits(self, n_bytes: int) -> tuple[float, float]:
        k = min(max(bisect_right(self.at, n_bytes), 1), len(self.at) - 1)
        x = (math.log(max(n_bytes, 1)) - math.log(self.at[k - 1])) / (math.log(self.at[k]) - math.log(self.at[k - 1]))
        x = min(max(x, 0.0), 1.0)
        return self.low[k - 1] + x * (self.low[k] - self.low[k - 1]), self.high[k - 1] + x * (self.high[k] - self.high[k - 1])

    def inside(self, n_bytes: int, ratio: float) -> bool:
        low, high = self.limits(n_bytes)
        return low <= ratio <= high


def compression(text: str, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks outside their band, and whether the bands accept it."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0, 0.0, False
    whole = len(raw) / len(packer.compress(raw))
    bad = 0
    if len(raw) > bands.chunk:
        for at in range(0, len(raw), bands.chunk):
            part = raw[at : at + bands.chunk]
            # a short last chunk is judged together with the bytes before it
            if len(part) < bands.chunk:
                part = raw[-bands.chunk :]
            if not bands.inside(len(part), len(part) / len(packer.compress(part))):
                bad += min(bands.chunk, len(raw) - at)
    share = bad / len(raw)
    return whole, share, bands.inside(len(raw), whole) and share <= bands.max_bad_share


def repeated_window_words(words: list[str], size: int = WINDOW) -> int:
    """How many words lie in windows of ``size`` words that occur twice or more, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    wins = list(zip(*(words[i : n + i] for i in range(size))))
    if len(set(wins)) == n:
        return 0
    seen: dict[tuple, int] = {}
    hit = bytearray(len(words))
    one = b"\x01" * size
    for i, w in enumerate(wins):
        j = seen.setdefault(w, i)
        if j != i:
            hit[i : i + size] = one
            hit[j : j + size] = one
    return sum(hit)


def base_metrics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    plain = text.translate(ODD_SPACES) if ODD.search(text) else text
    words = plain.split()
    lines = [x for x in plain.split("\n") if x.strip()]
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_window_words(words)


#: str.split() also splits at these, which are word characters here; they become private-use characters, one each.
ODD_SPACES = {c: 0xF0000 + c for c in [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]}
ODD = re.compile("[" + "".join(map(chr, ODD_SPACES)) + "]")


def quality_rules(docs: DataFrame, text: str = "text", bands: Bands = Bands(), keep: list[str] | None = None) -> DataFrame:
    """Adds the base metrics, ``zstd_ratio``, ``bad_chunk_share``, ``base_failed`` and ``kept`` to every row."""

    def rules(texts: list[str | None]):
        packer = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False)
        out: list[list] = [[] for _ in range(9)]
        for t in texts:
            n, chars, symbols, dup, rep = base_metrics(t)
            failed = n < 20 or 100 * rep > 30 * n
            ratio, share, fine = compression(t or "", bands, packer)
            for c, v in zip(out, (n, chars, symbols, dup, rep, ratio, share, failed, fine and not failed)):
                c.append(v)
        return out

    return arrow_map(docs, [text], rules, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, bad_chunk_share double, base_failed boolean, kept boolean", keep)
