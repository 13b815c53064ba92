"""MinHash near-duplicates with tensored banding, confirmed on full shingle sets.

A document's set holds its distinct shingles of five words. Equal sets are brought together first, by a 128-bit hash, and
one number stands for them. Each set gets ``collections`` small collections of ``rows`` minhashes; a table's key is a pair
of collections, so that c collections make c(c-1)/2 tables of 2*rows minhashes from c*rows hash functions. At a similarity
of 0.85, 20 collections of 4 miss a pair with probability 9e-6, and a pair at 0.2 meets with probability 5e-4.

A pair of collections can only be shared where either is shared. So the collections are counted first, and tables are
made only of those that two sets share. Sets that meet in a table are joined to the table's smallest (not to each
other), and the components of these edges are clusters that hold every candidate pair.

A cluster of up to ``block`` sets is compared on the full sets in one task. A larger one goes through three steps:

- Bounds. Shingles that only one set of the cluster holds can't be shared. What is left of a set bounds every
  intersection, and with it the sizes of sets that it could link to. A set for which the cluster has no set of such a
  size, with a bound that allows for it in turn, has no link and goes; the others form clusters anew.
- Blocks. Each block of the cluster is compared on its own, together with the cluster's hubs: a fixed number of sets that
  hold the fewest shingles of their own. Hubs are the same in all blocks, so that a group of copies grows together.
- Rests. Sets outside the cluster's largest component that share a collection with a set of another component are
  compared, block by block, with all sets that hold such collections.

Links are 100 * intersection >= percent * union; intersections come from an inverted index. A task returns a spanning
tree, not its pairs. Nothing is capped, and no task holds more than two blocks. What is moved grows in proportion to a
group of copies; only where many sets of one cluster stay unlinked although their bounds allow links does it grow with
rests times cluster, divided by the size of a block.

Null and empty texts: an empty set, linked with nothing. Fewer than five words: the whole sequence is one shingle. A row
without doc_id is linked with nothing and kept, also where its text equals another one. Rows that share a doc_id and
differ in text are linked each by its own text. doc_id may be of any type that has an order. No rows: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import LOWER_ASCII, WordHashes, _col, arrow_map, drop_written, mixed, shuffled, slices, written
from weirflow.llm.components import components

SHINGLE = 5
_RNG = np.random.default_rng(20240229)
#: Of the shingle hash: odd multipliers by place.
PLACES = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        return mixed(np.array([(h * PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = h[: n - SHINGLE + 1] * PLACES[0]
    for k in range(1, SHINGLE):
        out += h[k : n - SHINGLE + 1 + k] * PLACES[k]
    return np.unique(mixed(out))


def collection_keys(shingles: np.ndarray, collections: int, rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key for each collection, of its ``rows`` minhashes."""
    least = np.full(collections * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(1), out=least)
    key = np.zeros(collections, np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(31) + least[k::rows])
    return key.view(np.int64)


def features(docs: DataFrame, text: str, keep: list[str], collections: int, rows: int) -> DataFrame:
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, collections * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, collections * rows, dtype=np.uint64)
    known = WordHashes()

    def make(texts):
        out: list[list] = [[], [], []]
        for t in texts:
            s = shingle_set(t, known)
            out[0].append(len(s))
            out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            out[2].append(collection_keys(s, collections, rows, a, b) if len(s) else None)
        return out

    return arrow_map(docs, [text], make, "n_shingles long, set_hash binary, half_keys array<long>", keep)


def links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of some sets are linked: a symmetric boolean matrix, from an inverted index of the shingles that two sets share."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    of = np.repeat(np.arange(n), size)
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    df = np.diff(np.r_[starts, len(tokens)])
    both = np.zeros(n * n, np.int64)
    for d in np.unique(df[df > 1]).tolist():
        at = starts[df == d]
        if d <= 12:
            step = max(1, 2_000_000 // (d * d))
            for k in range(0, len(at), step):
                rows = of[at[k : k + step, None] + np.arange(d)]
                i, j = np.triu_indices(d, 1)
                both += np.bincount((rows[:, i] * n + rows[:, j]).ravel(), minlength=n * n)
        else:
            for k in range(0, len(at), 1024):
                rows = of[at[k : k + 1024, None] + np.arange(d)]
                m = np.zeros((n, len(rows)), np.float32)
                m[rows.ravel(), np.repeat(np.arange(len(rows)), d)] = 1
                both += np.rint(m @ m.T).astype(np.int64).ravel()
    both = np.triu(both.reshape(n, n), 1)
    both += both.T
    return (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)


def spanning(ids: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """(smallest id of its component, id) for each id."""
    out, left = [], np.ones(len(ids), bool)
    for k in sorted(range(len(ids)), key=ids.__getitem__):
        if left[k]:
            left[k] = False
            front = np.array([k])
            out.append((ids[k], ids[k]))
            while len(front):
                new = np.flatnonzero(linked[front].any(0) & left)
                left[new] = False
                out += [(ids[k], ids[j]) for j in new.tolist()]
                front = new
    return out


def _sets(batches):
    """Of (sid, text), the shingle set of each sid; rows that repeat a sid of their partition are passed over."""
    known, seen = WordHashes(), set()
    for batch in batches:
        for b in slices(batch, [1]):
            new = []
            for k, sid in enumerate(b.column(0).to_pylist()):
                if sid not in seen:
                    seen.add(sid)
                    new.append(k)
            part = b.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, known).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["sid", "shingles"])


def stars(tables: DataFrame) -> DataFrame:
    """Edges (a, b) from the smallest set of each table's bucket to the others."""
    least = tables.groupBy("bucket").agg(F.min("sid").alias("a"), F.count("*").alias("n")).filter("n > 1").select("bucket", "a")
    return tables.join(least, "bucket").filter("a != sid").select("a", F.col("sid").alias("b")).distinct()


def blocks_of(members: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """For each cluster of (sid, cluster, n), in how many blocks it is worked through."""
    return members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))


def bounded(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (sid, cluster, n), those that may have a link in their cluster: sid, n, u (shingles that no other set of the cluster has).

    intersection * (100 + percent) >= percent * (n + n'), and intersection <= n - u, bound the size n' that a set can link to.
    """

    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                cluster = part.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                # two shingles on one key count as one that is shared: the bound stays a bound
                key = np.concatenate([mixed(x ^ c) for x, c in zip(raw, cluster)])
                sid = np.repeat(part.column(0).to_numpy(), [len(x) for x in raw])
                for k in range(0, len(key), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 50_000].view(np.int64)), pa.array(sid[k : k + 50_000])], names=["key", "sid"])

    found = sets.join(members.select("sid", "cluster"), "sid").select("sid", "cluster", "shingles").mapInArrow(keys, "key long, sid long")
    own = found.groupBy("key").agg(F.count("*").alias("n"), F.min("sid").alias("sid")).filter("n = 1").groupBy("sid").agg(F.count("*").alias("u"))
    reach = F.expr(f"(n - u) * {100 + percent} div {percent} - n")
    rows = written(members.join(own, "sid", "left").select("sid", "cluster", "n", F.coalesce("u", F.lit(0)).alias("u")).withColumn("reach", reach), "bounds")
    # one row per cluster and size; what meets in a window are sizes, not sets
    size = rows.groupBy("cluster", "n").agg(F.count("*").alias("sets"), F.max("reach").alias("most"))
    w = Window.partitionBy("cluster").orderBy("n")
    before = F.max("most").over(w.rowsBetween(Window.unboundedPreceding, -1))
    size = size.select(
        "cluster",
        "n",
        F.when(F.col("sets") > 1, F.col("n")).otherwise(F.lead("n").over(w)).alias("above"),
        F.when(F.col("sets") > 1, F.greatest(F.col("most"), before)).otherwise(before).alias("below"),
        F.first("n").over(w).alias("least"),
    )
    return rows.join(size, ["cluster", "n"]).filter("above <= reach or (below >= n and least <= reach)").select("sid", "n", "u")


def confirmed(units: DataFrame, percent: int) -> DataFrame:
    """Spanning trees (a, b) of the links within each unit: rows (cluster, x, y, sid, shingles)."""
    n_units = max(8, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = units.repartition(n_units, "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "sid")

    def confirm(batches):
        key, ids, sets = None, [], []

        def done():
            if len(ids) > 1:
                tree = [p for p in spanning(ids, links(sets, percent)) if p[0] != p[1]]
                if tree:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in tree], pa.int64()), pa.array([b for _, b in tree], pa.int64())], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200).to_pydict()
                for c, x, y, sid, raw in zip(*(part[k] for k in ("cluster", "x", "y", "sid", "shingles"))):
                    if key != (c, x, y):
                        yield from done()
                        key, ids, sets = (c, x, y), [], []
                    if not ids or ids[-1] != sid:
                        ids.append(sid)
                        sets.append(np.frombuffer(raw, np.uint64))
        yield from done()

    return dealt.mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, collections: int = 20, rows: int = 4, block: int = 512, block_shingles: int = 1_000_000, hubs: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is the smallest), text_h1 and text_h2 (hashes of the text)."""
    source = docs.select(_col(docs, doc_id).alias("doc_id"), _col(docs, text).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_h1"), F.xxhash64(F.lit(29), "text").alias("text_h2"))
    row = ["doc_id", "text_h1", "text_h2"]
    feats = written(features(source, "text", row, collections, rows), "minhash")
    one = F.min(F.struct(*row)).alias("of")
    reps = feats.filter("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(one, F.first("half_keys").alias("half_keys"), F.first("n_shingles").alias("n"))
    # numbers are given once, as the table is written
    reps = written(reps.select(F.monotonically_increasing_id().alias("sid"), "set_hash", "of.*", "half_keys", "n"), "distinct-sets")

    half = reps.select("sid", F.posexplode("half_keys").alias("i", "key"))
    shared = written(half.groupBy("i", "key").agg(F.count("*").alias("n")).filter("n > 1").select("i", "key"), "shared-collections")
    held = half.join(shared, ["i", "key"], "left_semi").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("i", "key"))).alias("c")).filter("size(c) > 1")
    held = written(held, "held-collections")
    pairs = F.expr("flatten(transform(c, (x, k) -> transform(slice(c, k + 2, size(c)), y -> xxhash64(x.i, x.key, y.i, y.key))))")
    tables = written(held.select("sid", F.explode(pairs).alias("bucket")), "tables")
    drop_written(shared)
    clusters = components(stars(tables), "clusters")

    members = written(clusters.select(F.col("v").alias("sid"), F.col("root").alias("cluster")).join(reps.select("sid", "n"), "sid"), "clustered")
    drop_written(clusters)
    # of the clustered sets only, the shingles; each text meets its row once
    clustered = reps.join(members.select("sid"), "sid").select("sid", *[F.col(c).alias(f"of_{c}") for c in row])
    texts = source.join(shuffled(clustered), F.expr(" and ".join(f"{c} = of_{c}" for c in row))).select("sid", "text")
    sets = written(texts.mapInArrow(_sets, "sid long, shingles binary"), "clustered-sets")

    sized = members.join(blocks_of(members, block, block_shingles), "cluster")
    plain = sized.filter("blocks = 1").select("cluster", F.lit(0).alias("x"), F.lit(0).alias("y"), "sid")
    large = written(sized.filter("blocks > 1").select("sid", "cluster", "n"), "large-clusters")
    if large.isEmpty():
        trees = written(confirmed(plain.join(sets, "sid"), percent), "links")
    else:
        left = written(bounded(large, sets, percent), "bounded")
        # sets that share a table share a collection: those are fewer rows, and hold every candidate pair, too
        keys = F.explode(F.transform("c", lambda x: F.xxhash64(x["i"], x["key"])))
        near = written(held.join(left.select("sid"), "sid").select("sid", keys.alias("bucket")), "collections-left")
        again = components(stars(near), "clusters-left")
        fewer = again.select(F.col("v").alias("sid"), F.col("root").alias("cluster")).join(left, "sid")
        dealt = fewer.join(blocks_of(fewer, block, block_shingles), "cluster").withColumn("x", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        dealt = written(dealt, "blocks")
        lowest = dealt.filter("blocks > 1").groupBy("cluster", "blocks", F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(hubs))).agg(F.min(F.struct("u", "sid")).alias("hub"))
        hub = lowest.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.lit(0).alias("y"), F.col("hub.sid").alias("sid"))
        # cluster numbers of both kinds are sids; a set is in one cluster only, so that they don't clash
        units = plain.union(dealt.select("cluster", "x", F.lit(0).alias("y"), "sid")).union(hub)
        trees = written(confirmed(units.join(sets, "sid"), percent), "links")
        rest = rests(dealt.filter("blocks > 1").select("sid", "cluster", "n"), near, components(trees, "linked-blocks"), block, block_shingles)
        trees = trees.union(confirmed(rest.join(sets, "sid"), percent))
    linked = components(trees, "linked")
    of_set = reps.select("sid", "set_hash", "doc_id").join(linked.withColumnRenamed("v", "sid"), "sid", "left").select("set_hash", "doc_id", F.coalesce("root", "sid").alias("root"))
    first = of_set.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = written(of_set.select("set_hash", "root").join(first, "root").select(F.col("set_hash").alias("of_hash"), "component_id"), "components")
    for old in (tables, held, members, sets, large, reps):
        drop_written(old)
    out = feats.select(*row, "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(of_set, F.col("set_hash") == F.col("of_hash"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_h1", "text_h2")


def rests(members: DataFrame, tables: DataFrame, linked: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """Units that compare the sets outside their cluster's largest component with the sets that they share a collection with."""
    found = written(members.join(linked.withColumnRenamed("v", "sid"), "sid", "left").select("sid", "cluster", "n", F.coalesce("root", "sid").alias("root")), "block-components")
    most = found.groupBy("cluster", "root").agg(F.count("*").alias("sets")).groupBy("cluster").agg(F.max_by("root", F.struct("sets", "root")).alias("main"))
    rows = tables.join(found.select("sid", "root"), "sid")
    open_ = rows.groupBy("bucket").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p != q").select("bucket")
    met = written(rows.join(open_, "bucket").select("sid").distinct(), "open-sets")
    sides = found.join(met, "sid").join(most, "cluster").select("sid", "cluster", "n", (F.col("root") != F.col("main")).alias("rest"))
    sides = written(sides, "sides")
    parts = blocks_of(sides, block, block_shingles).withColumnRenamed("blocks", "ys").join(blocks_of(sides.filter("rest"), block, block_shingles).withColumnRenamed("blocks", "xs"), "cluster")
    sides = sides.join(parts, "cluster")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(n)).cast("int")
    return sides.filter("rest").select("cluster", own("xs", 2).alias("x"), to("ys").alias("y"), "sid").union(sides.select("cluster", to("xs").alias("x"), own("ys", 3).alias("y"), "sid"))
