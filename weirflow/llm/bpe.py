"""Byte-level BPE: loading, exact encoding, a streaming transducer with bounded lookahead, and incremental decoding.

Encoding. Merges never cross a token boundary of the result, so a text may be cut at any boundary that later text can't
change. Inside a pre-token, a merge (x, y) can only be prevented from the right by a merge of lower rank that starts with
a suffix of y. Following these chains over the merge list gives the number of bytes to the right that can matter, the
list's sufficient lookahead. The transducer holds a window and that lookahead; whenever more than both has been read, the
tokens that end at least the lookahead before the end are stable and leave it, and the rest is held on to. Where a single
pre-token is longer than the window, the same goes for the tokens inside it. Every text goes through it, and what it holds
doesn't depend on a text's length. The merges inside a window are remembered by pre-token, in memos of bounded size, which
saves time and changes no id.

Decoding. Token bytes go through an incremental UTF-8 state machine that holds at most three bytes between tokens.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from weirflow.llm.common import arrow_map

SPACE = r"\p{White_Space}"
#: The public pattern of this family of vocabularies (public_tokenizers.PATTERN), with white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?![^{SPACE}])|{SPACE}+"
PRETOKEN = regex.compile(PATTERN)
IRREGULAR = regex.compile(rf" {SPACE}| \Z")
#: Open runs: what a pre-token longer than the chunk can be made of.
RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", rf"[^{SPACE}\p{{L}}\p{{N}}]+", rf"{SPACE}+")]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in such files: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(0x100 + n)] = b
    return out


class HashTable:
    """Many 64-bit keys looked up at once; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys)).bit_length() + 3)
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        self.steps, rest, slot = 0, np.arange(len(keys)), self._slot(keys)
        while len(rest):
            self.steps += 1
            free = self.values[slot[rest]] < 0
            first = np.zeros(len(rest), bool)
            first[np.unique(slot[rest], return_index=True)[1]] = True
            put = rest[free & first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = rest[~(free & first)]
            slot[rest] = (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        open_ = np.flatnonzero((out.ravel() < 0) & (self.values[slot].ravel() >= 0))
        if len(open_):
            flat, k, at = out.ravel(), keys.ravel()[open_], slot.ravel()[open_]
            for _ in range(self.steps):
                at = (at + 1) & (len(self.keys) - 1)
                v = self.values[at]
                hit = (self.keys[at] == k) & (v >= 0)
                flat[open_[hit]] = v[hit]
                go = ~hit & (v >= 0)
                open_, k, at = open_[go], k[go], at[go]
                if not len(open_):
                    break
            out = flat.reshape(out.shape)
        return out


class Vocabulary:
    """Token bytes, merge ranks by pair of ids, and the special strings of a byte-level BPE file (.json or .tiktoken)."""

    def __init__(self, path: str):
        self.special: dict[str, int] = {}
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
            self.bytes = {i: t for t, i in self.ids.items()}
            self.pairs = self._pairs_from_ranks()
        elif path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                file = json.load(f)
            pre = file.get("pre_tokenizer") or {}
            if file["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or file.get("normalizer"):
                raise ValueError(f"{path} isn't a plain byte-level BPE file")
            of = byte_alphabet()
            self.ids = {bytes(of[c] for c in t): i for t, i in file["model"]["vocab"].items() if all(c in of for c in t)}
            self.bytes = {i: t for t, i in self.ids.items()}
            self.pairs = {}
            for rank, m in enumerate(file["model"]["merges"]):
                a, b = (bytes(of[c] for c in x) for x in (m if isinstance(m, list) else m.split(" ")))
                self.pairs.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
            for t in file.get("added_tokens", []):
                self.special[t["content"]] = t["id"]
                self.bytes[t["id"]] = t["content"].encode()
        else:
            raise ValueError(f"{path}: only byte-level .json and .tiktoken files can be read")
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.ids))
        self._table: HashTable | None = None
        self.lookahead = self._lookahead()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _pairs_from_ranks(self) -> dict:
        """A rank file names no pairs: a token's pair is what its bytes are merged to by lower ranks alone."""
        self.pairs, self.byte_ids = {}, [self.ids[bytes([b])] for b in range(256)]
        for t, i in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(t) > 1:
                parts = self.merge(t)
                if len(parts) == 2:
                    self.pairs[tuple(parts)] = (i, i)
        return self.pairs

    def _lookahead(self) -> int:
        """Bytes right of a boundary that can decide whether it stays; see the module's text.

        reach[p]: the most bytes after a token p that a merge with p on the left, among those seen so far, depends on.
        Merges are taken by ascending rank, so reach holds lower ranks only.
        """
        reach: dict[bytes, int] = {}
        most = 1
        for (a, b), _ in sorted(self.pairs.items(), key=lambda x: x[1][0]):
            y = self.bytes[b]
            need = len(y) + max((reach.get(y[k:], 0) for k in range(len(y))), default=0)
            x = self.bytes[a]
            if need > reach.get(x, 0):
                reach[x] = need
                most = max(most, need)
        return most

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token: the pair of lowest rank is merged, the leftmost first, until no pair is left."""
        ids = [self.byte_ids[b] for b in raw]
        return ids if len(ids) < 2 else self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    @property
    def table(self) -> HashTable:
        if self._table is None:
            keys = np.fromiter(((a << 32) | b for a, b in self.pairs), np.uint64, len(self.pairs))
            self._table = HashTable(keys, np.fromiter(((r << 32) | c for r, c in self.pairs.values()), np.int64, len(self.pairs)))
        return self._table

    def merge_many(self, raws: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, each as little-endian unsigned 32-bit integers: the merges of all of them go side by side."""
        out: list[bytes] = [b""] * len(raws)
        groups: dict[int, list[int]] = {}
        for k, r in enumerate(raws):
            groups.setdefault(max(4, 1 << (len(r) - 1).bit_length()) if r else 0, []).append(k)
        for width, rows in groups.items():
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                if width > 64 or len(part) < 8:
                    for k in part:
                        out[k] = np.array(self.merge(raws[k]), "<u4").tobytes()
                elif width:
                    ids, n = self._merge_block([raws[k] for k in part], width)
                    flat = ids.astype("<u4").tobytes()
                    for j, (k, size) in enumerate(zip(part, n.tolist())):
                        out[k] = flat[4 * width * j : 4 * (width * j + size)]
        return out

    def _merge_block(self, raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        rows, none = len(raws), np.int64(1) << 62
        n = np.fromiter(map(len, raws), np.int64, rows)
        col = np.arange(width)
        ids = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(rows, width)]
        ids[col >= n[:, None]] = -1
        done, live = ids.copy(), np.arange(rows)

        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            v = self.table.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            return np.where((a >= 0) & (b >= 0) & (v >= 0), v, none)

        ranks = look(ids[:, :-1], ids[:, 1:])
        while len(live):
            k = ranks.argmin(1)
            best = ranks[np.arange(len(live)), k]
            go = best < none
            if not go.all():
                done[live[~go]] = ids[~go]
                live, ids, ranks, k, best = live[go], ids[go], ranks[go], k[go], best[go]
            if not len(live):
                break
            r = np.arange(len(live))
            n[live] -= 1
            shift = np.minimum(col + (col > k[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            ids[r, k] = best & 0xFFFFFFFF
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], width - 2), 1)
            ranks[:, -1] = none
            right = np.minimum(k + 1, width - 1)
            inner = k < width - 1
            ranks[r[inner], k[inner]] = look(ids[r, k], ids[r, right])[inner]
            left = k > 0
            ranks[r[left], k[left] - 1] = look(ids[r[left], k[left] - 1], ids[r[left], k[left]])
        return done, n

    def _merge_short(self, ids: list[int]) -> list[int]:
        pairs = self.pairs
        none = (1 << 60, 0)
        ranks = [pairs.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = pairs.get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = pairs.get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[k], ids[j] = pairs[a, b][1], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (p := (ids[k], ids[after[k]])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], k, *p))
            if before[k] >= 0 and (p := (ids[before[k]], ids[k])) in pairs:
                heapq.heappush(heap, (pairs[p][0], before[k], *p))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def encoder_of(path: str) -> StreamEncoder:
    """One per worker process, so that what it has learned about words serves all tasks that the process runs."""
    return StreamEncoder(vocabulary(path))


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies on this machine; it is looked up by each worker for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


class TwoAges(dict):
    """A memo of bounded size: once it holds ``limit`` entries, they become the old ones, and older ones are dropped."""

    def __init__(self, make, limit: int = 100_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        self.put(key, v)
        return v

    def put(self, key, v) -> None:
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = v

    def lacks(self, keys) -> list:
        return [k for k in keys if k not in self and k not in self.old]


def pretokens_of(piece: str) -> list[str]:
    """Pre-tokens of a space and a piece; words with at most a mark behind them need no pattern."""
    if piece.isalpha():
        return [" " + piece]
    if piece[:-1].isalpha() and piece[-1] in ".,;:!?":
        return [" " + piece[:-1], piece[-1]]
    return PRETOKEN.findall(" " + piece)


class WordStream:
    """One pre-token of any length, fed as bytes; tokens come out once they are stable."""

    WINDOW = 4096  # bytes

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held = vocab, b""

    def feed(self, raw: bytes) -> list[int]:
        self.held += raw
        if len(self.held) <= self.WINDOW + self.vocab.lookahead:
            return []
        stable, out, at = len(self.held) - self.vocab.lookahead, [], 0
        for i in self.vocab.merge(self.held):
            end = at + len(self.vocab.bytes[i])
            if end > stable:
                break
            out.append(i)
            at = end
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.vocab.merge(self.held), b""
        return out


class StreamEncoder:
    """The transducer: text in pieces of any size to ids. It holds ``WINDOW`` characters, the lookahead and one piece at most."""

    WINDOW = 1 << 13  # characters; 32 at least, so that an open pre-token is no contraction
    MEMO = 250_000  # entries of either memo, and as many old ones

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held, self.open = vocab, "", None
        self.pretokens = TwoAges(lambda t: packed(vocab.merge(t.encode("utf-8", "surrogatepass"))), self.MEMO)
        self.pieces = TwoAges(lambda piece: self._plain(" " + piece), self.MEMO)

    def warm(self, texts: list[str | None]) -> None:
        """Fills the memos for some texts, which is faster side by side than one by one; results don't depend on it."""
        if len(texts) < 2:
            return
        pieces: set[str] = set()
        for t in texts:
            if t and not IRREGULAR.search(t):
                pieces.update(t.split(" "))
        split = {p: pretokens_of(p) for p in self.pieces.lacks(pieces) if len(p) <= 64}
        lacking = self.pretokens.lacks({t for ts in split.values() for t in ts})
        made = dict(zip(lacking, self.vocab.merge_many([t.encode("utf-8", "surrogatepass") for t in lacking])))
        for t, v in made.items():
            self.pretokens.put(t, v)
        for p, ts in split.items():
            self.pieces.put(p, b"".join([made[t] if t in made else self.pretokens[t] for t in ts]))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, PRETOKEN.findall(text)))

    def _closed(self, text: str) -> bytes:
        """Ids of a stretch whose ends are final boundaries."""
        if IRREGULAR.search(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        return (self._plain(first) if first else b"") + b"".join(map(self.pieces.__getitem__, rest))

    def feed(self, text: str) -> Iterator[bytes]:
        for at in range(0, len(text), self.WINDOW):
            self.held += text[at : at + self.WINDOW]
            if self.open:
                yield self._continue()
            if not self.open and len(self.held) > self.WINDOW + self.vocab.lookahead:
                yield self._stable()

    def _stable(self) -> bytes:
        """The tokens that end the lookahead before the end of what is held: a character has a byte at least."""
        limit = cut = len(self.held) - self.vocab.lookahead
        while (cut := self.held.rfind(" ", 0, cut)) > 0:
            if not RUNS[3].match(self.held, cut + 1):
                out, self.held = self._closed(self.held[:cut]), self.held[cut:]
                return out
        out, at = [], 0
        for m in PRETOKEN.finditer(self.held):
            if m.end() > limit:
                break
            out.append(self.pretokens[m[0]])
            at = m.end()
        self.held = self.held[at:]
        if not at:
            # the first pre-token is longer than the window: it isn't stable as a whole, but its own tokens are
            lead = int(self.held[0] == " " and not RUNS[3].match(self.held, 1))
            kind = next(r for r in RUNS if r.match(self.held, lead))
            self.open = (kind, WordStream(self.vocab))
            out.append(packed(self.open[1].feed(self.held[:lead].encode())))
            self.held = self.held[lead:]
            out.append(self._continue())
        return b"".join(out)

    def _continue(self, last: bool = False) -> bytes:
        """Goes on with the open pre-token; a run of white space leaves its last character to what may follow."""
        kind, word = self.open
        m = kind.match(self.held)
        end = m.end() if m else 0
        over = end < len(self.held) or last
        if kind is RUNS[3] and not (last and end == len(self.held)):
            end = max(end - 1, 0)
        out = word.feed(self.held[:end].encode("utf-8", "surrogatepass"))
        self.held = self.held[end:]
        if over:
            out += word.finish()
            self.open = None
        return packed(out)

    def finish(self) -> bytes:
        out = self._continue(True) if self.open else b""
        out += self._closed(self.held)
        self.held = ""
        return out


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def stream_encode(encoder: StreamEncoder, text: str | None) -> Iterator[bytes]:
    """Ids of a whole text, packed, piece by piece; special strings inside it become their own ids."""
    if not text:
        return
    vocab = encoder.vocab
    parts = vocab.split_special.split(text) if vocab.split_special and any(s in text for s in vocab.special) else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield packed([vocab.special[part]])
        elif part:
            yield from encoder.feed(part)
            yield encoder.finish()


class ByteToText:
    """Ids to text, token by token: an incremental UTF-8 state machine; broken sequences become U+FFFD."""

    def __init__(self, vocab: Vocabulary):
        self.bytes, self.state = vocab.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def bpe_round_trip(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Adds ``n_tokens``, ``token_ids`` (array of int; left out unless ``with_ids``), digests of ids and of decoded text, ``round_trip``.

    Null and empty texts: no tokens, empty decoded text. Repeated rows are encoded alike, columns of the names that are added are
    replaced, no rows give no rows. ``path``: a vocabulary file, read by each worker; by default the
    public byte-level file. ``round_trip``: the decoded text equals the text.
    """
    def code(texts: list[str | None]):
        encoder = encoder_of(path or default_path())
        encoder.warm(texts)
        out: list[list] = [[] for _ in range(5)]
        for t in texts:
            to_text, ids_sha, text_sha, n, same, at = ByteToText(encoder.vocab), hashlib.sha256(), hashlib.sha256(), 0, True, 0
            every, source = [], t or ""
            for raw in stream_encode(encoder, t):
                ids_sha.update(raw)
                n += len(raw) // 4
                piece = to_text.feed(unpacked(raw))
                same = same and source.startswith(piece, at)
                at += len(piece)
                text_sha.update(piece.encode("utf-8", "surrogatepass"))
                if with_ids:
                    every.append(raw)
            piece = to_text.finish()
            text_sha.update(piece.encode("utf-8", "surrogatepass"))
            ids = np.frombuffer(b"".join(every), "<i4") if with_ids else None
            for c, v in zip(out, (n, ids_sha.hexdigest(), text_sha.hexdigest(), same and not piece and at == len(source), ids)):
                c.append(v)
        return out if with_ids else out[:4]

    return arrow_map(docs, [text], code, "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", token_ids array<int>" * with_ids, keep)
