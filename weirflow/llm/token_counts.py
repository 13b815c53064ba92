"""Exact token counts at every prefix by dynamic programming.

A token sequence is the encoding of its bytes exactly if every two neighbours, encoded together, stay as they are. So the
last token of each prefix's encoding follows from those of shorter prefixes: it is the one token ending there that is
compatible with the last token of the prefix before it. Counts at all prefixes come out of one pass; a truncation or a
budget question is then a lookup. The tables of short pre-tokens are kept in a memo of bounded size.
"""

from __future__ import annotations

from array import array
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame

from weirflow.llm.bpe import IRREGULAR, PRETOKEN, RUNS, HashTable, TwoAges, Vocabulary, default_path, packed, pretokens_of, vocabulary
from weirflow.llm.common import arrow_map


#: Of the hash that finds tokens: an odd multiplier of 64 bits and its powers.
BASE = np.uint64(0x9E3779B97F4A7C15 ^ 0x5851F42D4C957F2D | 1)
POWERS = np.array([pow(int(BASE), k, 1 << 64) for k in range(49)], np.uint64)


def _hash(raw: bytes) -> int:
    h = 0
    for b in raw:
        h = (h * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class PairMemo:
    """Whether two tokens stay as they are when their bytes are encoded together; a memo of fixed size."""

    BITS = 20

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.few = TwoAges(lambda p: vocab.merge(vocab.bytes[p[0]] + vocab.bytes[p[1]]) == list(p))
        self.keys, self.values = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, bool)

    def one(self, a: int, b: int) -> bool:
        return self.few[a, b]

    def many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = ((a.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | b.astype(np.uint64)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.values[slot]
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            fresh, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            pairs = [(int(a[new[k]]), int(b[new[k]])) for k in first]
            made = self.vocab.merge_many([self.vocab.bytes[x] + self.vocab.bytes[y] for x, y in pairs])
            fits = np.array([m == packed(p) for m, p in zip(made, pairs)], bool)
            out[new] = fits[back]
            at = slot[new[first]]
            self.keys[at], self.values[at] = fresh, fits
        return out


class PrefixCounter:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.fits = PairMemo(vocab)
        self.own = TwoAges(lambda t: self.vocab.merge(self.vocab.bytes[t[0]]) == [t[0]])
        self.tables = TwoAges(self._table, 100_000)
        self.totals = TwoAges(lambda t: self.tables[t][-1], 250_000)
        self.pieces = TwoAges(lambda p: self._plain(" " + p), 250_000)

    def prefix_dp(self, raw: bytes) -> array:
        """Counts at the ends of all byte prefixes of one pre-token, 0 to len(raw)."""
        ids, longest, fits, own = self.vocab.ids, self.vocab.longest, self.fits.one, self.own
        count, last = array("l", [0]), [-1]
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - longest), end):
                t = ids.get(raw[start:end])
                if t is not None and (fits(last[start], t) if start else own[t,]):
                    break
            else:  # unreachable with a vocabulary that holds all bytes
                raise ValueError(f"no encoding of {raw[:end]!r}")
            last.append(t)
            count.append(count[start] + 1)
        return count

    def warm(self, texts: list[str | None]) -> None:
        """Fills the memos for some texts side by side; results don't depend on it."""
        pieces: set[str] = set()
        for t in texts:
            if t and not IRREGULAR.search(t):
                pieces.update(t.split(" "))
        split = {p: pretokens_of(p) for p in self.pieces.lacks(pieces) if len(p) <= 64}
        lacking = self.totals.lacks({t for ts in split.values() for t in ts})
        made = dict(zip(lacking, self.totals_of([t.encode("utf-8", "surrogatepass") for t in lacking])))
        for t, v in made.items():
            self.totals.put(t, v)
        for p, ts in split.items():
            self.pieces.put(p, sum([made[t] if t in made else self.totals[t] for t in ts]))

    def totals_of(self, raws: list[bytes]) -> list[int]:
        """The counts at the ends of many pre-tokens."""
        out = [0] * len(raws)
        groups: dict[int, list[int]] = {}
        for k, r in enumerate(raws):
            groups.setdefault(8 * ((len(r) + 7) // 8), []).append(k)
        for width, rows in groups.items():
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                if 0 < width <= 48 and len(part) >= 64:
                    n = np.fromiter((len(raws[k]) for k in part), np.int64, len(part))
                    counts = self.prefix_dp_many([raws[k] for k in part], width)[np.arange(len(part)), n]
                else:
                    counts = [self.prefix_dp(raws[k])[-1] for k in part]
                for k, c in zip(part, counts):
                    out[k] = int(c)
        return out

    def prefix_dp_many(self, raws: list[bytes], width: int) -> np.ndarray:
        """prefix_dp of many pre-tokens, one step after another for all of them; a row for each, a column for each prefix."""
        rows = len(raws)
        plain = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(rows, width)
        text = plain.astype(np.uint64) + np.uint64(1)
        hashes = np.zeros((rows, width + 1), np.uint64)
        for j in range(width):
            hashes[:, j + 1] = hashes[:, j] * BASE + text[:, j]
        size = np.fromiter(map(len, raws), np.int64, rows)
        count, last = np.zeros((rows, width + 1), np.int64), np.full((rows, width + 1), -1, np.int64)
        for end in range(1, width + 1):
            todo = np.flatnonzero(size >= end)
            for start in range(end):
                if not len(todo):
                    break
                t = self.names.get(hashes[todo, end] - hashes[todo, start] * POWERS[end - start])
                t = np.where(t >> 32 == end - start, t & 0xFFFFFFFF, -1)
                some = np.flatnonzero(t >= 0)
                if len(some):
                    r, t = todo[some], t[some]
                    # a hash only proposes a token
                    same = (plain[r, start:end] == self.spelled[t, : end - start]).all(1)
                    r, t = r[same], t[same]
                    fine = self.fits.many(last[r, start], t) if start else self.whole[t]
                    r, t = r[fine], t[fine]
                    last[r, end], count[r, end] = t, count[r, start] + 1
                    todo = todo[last[todo, end] < 0]
        return count

    @cached_property
    def names(self) -> HashTable:
        """Token ids, with their lengths, by the hash of their bytes."""
        tokens = [(t, i) for t, i in self.vocab.ids.items() if len(t) <= 48]
        hashes = np.array([_hash(t) for t, _ in tokens], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("Two tokens of this vocabulary share a hash")
        return HashTable(hashes, np.array([(len(t) << 32) | i for t, i in tokens], np.int64))

    @cached_property
    def spelled(self) -> np.ndarray:
        """The bytes of each token of up to 48, by id."""
        out = np.zeros((max(self.vocab.ids.values()) + 1, 48), np.uint8)
        for t, i in self.vocab.ids.items():
            if len(t) <= 48:
                out[i, : len(t)] = np.frombuffer(t, np.uint8)
        return out

    @cached_property
    def whole(self) -> np.ndarray:
        """For each id, whether the merges make this very token from its bytes."""
        tokens = list(self.vocab.ids.items())
        out = np.zeros(max(i for _, i in tokens) + 1, bool)
        out[[i for _, i in tokens]] = [m == packed([i]) for (_, i), m in zip(tokens, self.vocab.merge_many([t for t, _ in tokens]))]
        return out

    def _table(self, text: str) -> array:
        """Counts at the character prefixes of one pre-token."""
        raw = text.encode("utf-8", "surrogatepass")
        counts = self.prefix_dp(raw)
        if len(raw) == len(text):
            return counts
        out, at = array("l", [0]), 0
        for c in text:
            at += len(c.encode("utf-8", "surrogatepass"))
            out.append(counts[at])
        return out

    def _plain(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, PRETOKEN.findall(text)))

    def _ordinary(self, text: str) -> int:
        if IRREGULAR.search(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        return (self._plain(first) if first else 0) + sum(map(self.pieces.__getitem__, rest))

    def total(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        v = self.vocab
        if v.split_special and any(s in text for s in v.special):
            parts = v.split_special.split(text)
            return len(parts) // 2 + sum(self._ordinary(p) for p in parts[::2] if p)
        return self._ordinary(text)

    def prefixes(self, text: str | None) -> array:
        """Tokens of text[:k] for k from 0 to len(text), each as if that prefix were a text of its own."""
        text = text or ""
        out = array("l", [0])
        v = self.vocab
        parts = v.split_special.split(text) if v.split_special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                # a special string that is cut short is ordinary text, which may join what stands before it
                start = len(out) - 1
                before = max((m.start() for m in PRETOKEN.finditer(parts[k - 1])), default=0)
                own = start - len(parts[k - 1]) + before
                for j in range(1, len(part)):
                    out.append(out[own] + self._plain(text[own : start + j]))
                out.append(out[start] + 1)
            else:
                self._prefixes(part, out)
        return out

    def _prefixes(self, text: str, out: array) -> None:
        origin, base, run_end, run_start, run = len(out) - 1, out[-1], 0, 0, None
        for m in PRETOKEN.finditer(text):
            t, start = m[0], m.start()
            table = self.tables[t]
            for j in range(1, len(t) + 1):
                end = start + j
                if end <= run_end or (w := RUNS[3].match(text, end - 1)):
                    # white space at the end of a text is one pre-token, however it is split before a word
                    if end > run_end:
                        run_start, run_end, run = end - 1, w.end(), self.tables[w[0]]
                    out.append(out[origin + run_start] + run[end - run_start])
                elif j == 2 and t in ("'re", "'ve", "'ll"):
                    out.append(base + self.totals["'"] + self.totals[t[1]])  # not yet a contraction
                else:
                    out.append(base + table[j])
            base += table[-1]

    def longest_prefix(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        counts = self.prefixes(text)
        if max(counts) <= budget:
            return len(counts) - 1
        return max(k for k, c in enumerate(counts) if c <= budget)


class PieceCounter:
    """The same for a sentencepiece file, through its library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def total(self, text: str | None) -> int:
        return len(self.model.encode(text or "", num_threads=1))


@lru_cache(maxsize=4)
def counter(path: str):
    """One per worker process, so that what it has learned about words serves all tasks that the process runs."""
    return PieceCounter(path) if path.endswith(".model") else PrefixCounter(vocabulary(path))


def token_counts(docs: DataFrame, text: str = "text", limit: int = 512, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit). Null and empty texts: 0, 0, false.

    Repeated rows count alike, columns of the names that are added are replaced, no rows give no rows.
    """

    def count(texts: list[str | None]):
        held = counter(path or default_path())
        if hasattr(held, "warm"):
            held.warm(texts)
        n = [held.total(t) for t in texts]
        return [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], n, [x > limit for x in n]

    return arrow_map(docs, [text], count, "n_bytes long, n_tokens long, over_limit boolean", keep)


def truncated(docs: DataFrame, budget: int, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``cut_chars``, the length of the longest prefix within a budget of tokens, and ``cut_text``. Null texts: 0 and null."""

    def cut(texts: list[str | None]):
        held = counter(path or default_path())
        at = [held.longest_prefix(t, budget) for t in texts]
        return at, [None if t is None else t[:k] for t, k in zip(texts, at)]

    return arrow_map(docs, [text], cut, "cut_chars long, cut_text string")

