"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (an item of fewer words is one window). A window is the ordered set of
its shingles of ``shingle`` words. Shingles are ordered by rarity in the whole corpus; for exact containment the
necessary prefix is the rarest shingle alone, which every document that holds the window must hold. Where a document
holds such a shingle, its place in the window gives where the window would start, and the lengths of window and document
bound it; the words of the window that would start there are joined with the windows by shingle, place and hash, and the
words themselves decide.

Both sides of the join are exchanged, at every size of corpus and benchmark, and each passage of a document meets one
window at most, so that no common passage makes a product. Ahead of the two passes over the corpus (counts of shingles,
candidates) goes a Bloom filter of a fixed number of bits, which bounds what is sent to the executors; a benchmark that
fills it lets more shingles through to the exchange and changes no result. Nothing is collected but its bits.

Texts are known by two hashes, so that equal texts are found once. Null and empty texts have no words; items without
words have no windows; repeated items are reported by their own ids, and an item without id hits but isn't reported. Rows
are kept as they are, repeated ones too. No items: no hits. No rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import LOWER_ASCII, _col, drop_written, mixed, shuffled, slices, small_batches, written

#: Bytes that belong to no word become spaces; A-Z become a-z; bytes from 0x80 on are word bytes.
WORD_BYTES = bytes((b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in LOWER_ASCII)


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class RunHashes:
    """64-bit hashes of the words of texts, and of all runs of some numbers of words."""

    BLOCK = 1 << 20
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, longest: int):
        rng = np.random.default_rng(20240301)
        self.places = rng.integers(1, 1 << 63, longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._powers(self.BLOCK + 1024)

    def _powers(self, n: int) -> None:
        """Powers of an odd number, and of its inverse, modulo 2^64."""
        for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def words(self, raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts whose words are divided by spaces: all of them in one, where words begin and end in it, their hashes, and where each text's words begin."""
        whole = b" ".join(raws)
        starts, ends, hashes, a = [], [], [], 0
        while a < len(whole):
            # block by block, each up to a space; a longer word makes a longer block
            b = len(whole) if a + self.BLOCK >= len(whole) else whole.find(b" ", a + self.BLOCK)
            b = len(whole) if b < 0 else b
            letters = np.frombuffer(whole, np.uint8, b - a, a)
            if b - a > len(self.up):
                self._powers(b - a)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (letters != 0x20).view(np.int8), [0]])))
            first, last = edges[::2], edges[1::2]
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * self.up[: b - a], out=sums[1:])
            hashes.append(mixed((sums[last] - sums[first]) * self.down[np.minimum(first, max(b - a - 1, 0))] + (last - first).astype(np.uint64)))
            starts.append(first + a)
            ends.append(last + a)
            a = b
        none = np.zeros(0, np.int64)
        starts, ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        places = np.cumsum([0, *(len(r) + 1 for r in raws)])
        return whole, starts, ends, np.concatenate([np.zeros(0, np.uint64), *hashes]), np.searchsorted(starts, places)

    def runs(self, hashes: np.ndarray, size: int) -> np.ndarray:
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out += hashes[k : k + n] * self.places[k]
        return mixed(out)


def word_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES) if text else b""


class Bits:
    """A Bloom filter of one hash and a fixed number of bits."""

    def __init__(self, bits: int):
        self.mask, self.held = np.uint64((1 << bits) - 1), np.zeros(max(1, (1 << bits) >> 6), np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes & self.mask
        return (self.held[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) != 0

    @classmethod
    def of(cls, hashes: DataFrame, column: str, bits: int) -> Bits:
        """Filled by Spark; what reaches the driver is a row for each 64 bits at most."""
        out = cls(bits)
        h = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        rows = hashes.groupBy(F.shiftright(h, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("word")).toArrow()
        out.held[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
        return out


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """Rows (item, n, hash, words, shingles): every window of every item."""
    schema = pa.schema([("item", pa.string()), ("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def cut(batches):
        hashes = RunHashes(window)
        for batch in batches:
            for b in slices(batch, [1]):
                for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = plain_words(t)
                    if not words:
                        continue
                    h, n = hashes.words([word_bytes(t)])[3], min(window, len(words))
                    k = min(shingle, n)
                    whole, parts = hashes.runs(h, n).view(np.int64), hashes.runs(h, k).view(np.int64)
                    for at in range(0, len(whole), 5000):
                        starts = range(at, min(at + 5000, len(whole)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([item] * len(starts), pa.string()), pa.array([n] * len(starts), pa.int32()), pa.array(whole[at : at + 5000]), pa.array([b" ".join(words[i : i + n]) for i in starts], pa.binary()), pa.array([parts[i : i + n - k + 1] for i in starts], pa.list_(pa.int64()))],
                            schema=schema,
                        )

    source = benchmark.select(_col(benchmark, item_id).cast("string").alias("item"), _col(benchmark, text).alias("text"))
    return source.mapInArrow(cut, "item string, n int, hash long, words binary, shingles array<long>")


def _inside(of: np.ndarray, size: int) -> np.ndarray:
    """Which runs lie in one text; ``of``: each word's text."""
    n = len(of) - size + 1
    return of[:n] == of[size - 1 :] if n > 0 else np.zeros(0, bool)


def _counted(docs: DataFrame, text: str, sizes: list[int], longest: int, bits: Bits) -> DataFrame:
    """How often each shingle that may be a window's occurs in the corpus: (shingle, times)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        hashes, bits = RunHashes(longest), shared.value
        for batch in batches:
            for b in slices(batch, [0]):
                _, _, _, h, begin = hashes.words([word_bytes(t) for t in b.column(0).to_pylist()])
                of = np.repeat(np.arange(b.num_rows), np.diff(begin))
                found = [np.zeros(0, np.uint64)]
                for k in sizes:
                    runs = hashes.runs(h, k)
                    found.append(runs[bits.has(runs) & _inside(of, k)])
                each, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n)], names=["shingle", "times"])

    return docs.select(_col(docs, text).alias("text")).mapInArrow(count, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))


def _candidates(docs: DataFrame, text: str, shapes: list[tuple[int, int]], longest: int, bits: Bits) -> DataFrame:
    """Where windows would stand whose rarest shingle a document may hold: (text_h1, text_h2, start, n, at, shingle, hash, words).

    Besides, a row for each document with n = 0, whose start is its number of words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("text_h1", pa.int64()), ("text_h2", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("shingle", pa.int64()), ("hash", pa.int64()), ("words", pa.binary())])

    def find(batches):
        hashes, bits = RunHashes(longest), shared.value
        for batch in batches:
            for b in slices(batch, [2]):
                whole, first, last, h, begin = hashes.words([word_bytes(t) for t in b.column(2).to_pylist()])
                sizes = np.diff(begin)
                none = [pa.nulls(b.num_rows, f.type) for f in list(schema)[4:]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), pa.array(np.zeros(b.num_rows, np.int32)), *none], schema=schema)
                of = np.repeat(np.arange(b.num_rows), sizes)
                h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
                for n, k in shapes:
                    runs = hashes.runs(h, k)
                    some = np.flatnonzero(bits.has(runs) & _inside(of, k))
                    if not len(some):
                        continue
                    windows = hashes.runs(h, n)
                    # every place that the shingle can have in a window, if the window fits into the document
                    for j in range(0, len(some), 2000):
                        part = some[j : j + 2000]
                        at, place = np.tile(np.arange(n - k + 1), len(part)), np.repeat(part, n - k + 1)
                        start, doc = place - at, of[place]
                        fits = (start >= begin[doc]) & (start + n <= begin[doc + 1])
                        at, place, start, doc = at[fits], place[fits], start[fits], doc[fits]
                        words = [b" ".join(whole[x:y].split()) for x, y in zip(first[start].tolist(), last[start + n - 1].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h1[doc]), pa.array(h2[doc]), pa.array(start - begin[doc]), pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int32)), pa.array(runs[place].view(np.int64)), pa.array(windows[start].view(np.int64)), pa.array(words, pa.binary())],
                            schema=schema,
                        )

    source = docs.select(*_text_key(docs, text), _col(docs, text).alias("text"))
    return source.mapInArrow(find, "text_h1 long, text_h2 long, start long, n int, at int, shingle long, hash long, words binary")


def _text_key(docs: DataFrame, text: str) -> list:
    return [F.xxhash64(_col(docs, text)).alias("text_h1"), F.xxhash64(F.lit(31), _col(docs, text)).alias("text_h2")]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, shingle: int = 5, keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", filter_bits: int = 27) -> DataFrame:
    """Adds n_words, n_hit, n_items, items (sorted ids as strings), hits (merged places, words from-to) to every row of docs.

    ``filter_bits``: the Bloom filter has 2 to this power bits (16 MiB), whatever the size of the benchmark.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = docs.columns if keep is None else keep
    found = written(item_windows(benchmark, item_id, item_text, window, shingle), "benchmark-windows")
    windows = written(found.groupBy("hash", "n", "words").agg(F.first("shingles").alias("shingles")), "windows")
    parts = windows.select("hash", "n", "words", F.posexplode("shingles").alias("at", "shingle"))
    # a window has 1 to ``window`` words
    shapes = sorted((r.n, min(shingle, r.n)) for r in windows.select("n").distinct().collect())
    counts = _counted(docs, text, sorted({k for _, k in shapes}), window, Bits.of(parts, "shingle", filter_bits))
    rarity = parts.join(shuffled(counts), "shingle", "left").select("hash", "n", "words", F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "at").alias("s"))
    # each window is found by its rarest shingle; of equally rare ones, by the smaller hash
    prefixes = written(rarity.groupBy("hash", "n", "words").agg(F.min("s").alias("s")).select("hash", "n", "words", "s.shingle", "s.at"), "prefixes")
    places = written(_candidates(docs, text, shapes, window, Bits.of(prefixes, "shingle", filter_bits)), "candidates")
    own = ["shingle", "at", "n", "hash", "words"]
    hits = written(places.filter("n > 0").join(shuffled(prefixes), own).select("text_h1", "text_h2", "start", "n", "hash", "words").distinct(), "hits")

    key = ["text_h1", "text_h2"]
    by_place = Window.partitionBy(*key).orderBy("start", "n")
    merged = hits.select(*key, "start", "n", (F.col("start") + F.col("n")).alias("end")).withColumn("before", F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
    merged = merged.withColumn("run", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*key, "run").agg(F.min("start").alias("a"), F.max("end").alias("b")).groupBy(*key).agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("hits"))
    named = found.filter("item is not null").select("hash", "n", "words", "item").distinct()
    items = hits.select(*key, "hash", "n", "words").distinct().join(named, ["hash", "n", "words"]).groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    sizes = places.filter("n = 0").groupBy(*key).agg(F.first("start").alias("size"))
    side = sizes.join(merged, key, "left").join(items, key, "left").select(F.col("text_h1").alias("f1"), F.col("text_h2").alias("f2"), "size", "n_hit", "hits", "items")
    side = written(side, "contaminated")
    for old in (places, prefixes, windows, found, hits):
        drop_written(old)

    # by position, so that no name of the input clashes
    added = ["n_words", "n_hit", "n_items", "items", "hits"]
    rows = docs.select(*[_col(docs, c).alias(f"c{i}") for i, c in enumerate(keep)], *_text_key(docs, text))
    rows = rows.join(shuffled(side), (F.col("text_h1") == F.col("f1")) & (F.col("text_h2") == F.col("f2")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c not in added],
        F.coalesce("size", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("hits"),
    )
