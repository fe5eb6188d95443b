"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text's shingle set is hashed; rows with equal sets form one class
   whose node is its least doc_id, and only classes go on.
2. Banded minima of the set give bucket keys. The number of bands follows from
   the threshold and the chosen miss probability.
3. In each bucket all classes are compared with its least node (a star, not all
   pairs). A pair's other signature is compared in batches; the pair is dropped
   as soon as the posterior probability that its similarity reaches the
   threshold, given the agreements so far, falls below the miss probability.
   Pairs that survive are verified on their full shingle sets.
4. Links give components. Within a component nothing is left to find; buckets
   that span several are searched further. In rounds, each class is verified
   with the one member of another component that looks most alike in its blocks
   of the buckets (blocks are dealt anew each round), which joins dense groups
   as Boruvka's algorithm does, until a round links nothing. Last, members of
   different components that share a bucket and survive the bounds are verified
   where they meet, in pairs of blocks, each pair in its first common band; only
   links leave a task.
5. A bucket of more than LARGE members is not compared in full. With any
   reference set P, two sets x and y share |P| - |P-x| - |P-y| + s elements,
   where s counts what their differences from P have in common. So a link asks
   for 2 (100 + T) s >= g(x) + g(y), T being the threshold in hundredths and
   g(x) = 2 T |x| + 2 (100 + T) |P-x| - (100 + T) |P|. Pairs with a sum of zero or
   less are linked outright, and all of them through the member of least g (a
   star); the others share an element among the first of their differences
   (prefix filter), so those elements split the bucket, and no link is lost.
   P holds what most members of the bucket's first block hold.

Defined results: null or empty texts and texts of white space have the empty
set, which links with nothing; rows that share a doc_id count as one document;
a null doc_id takes the component of the rows with its set, or none if it has
no such row, and links nothing; repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.textvec import M1, chunks, mix, shingles, sorted_set, utf8, words
from logloom.tables import materialize, scratch, ship, tidy

BAND_ROWS = 5
#: Hashes of the signature that verification reads, and how many it reads at a time.
VERIFY, BATCH = 256, 32
MISS = 1e-5
PRUNE = 1e-4
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Members of a bucket above which differences split it.
LARGE = 4 * BLOCK


def n_bands(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold shares no bucket with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


@cache
def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(M1))
    return (x[:n] >> np.uint64(32)).astype(np.uint32), (x[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(sets: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """[n, sets] minimum of each hash over each non-empty set; starts: where each begins."""
    flip, odd = seeds(n)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(starts)), np.uint32)
    t = np.empty_like(x)
    for j in range(n):
        np.bitwise_xor(x, flip[j], out=t)
        np.multiply(t, odd[j], out=t)
        np.minimum.reduceat(t, starts, out=out[j])
    return out


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    offsets, data = utf8(texts)
    for i, _, o, d in chunks(offsets, data):
        x, to = shingles(*words(o, d), k)
        yield i, [sorted_set(x[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]


def _features(k: int, bands: int, key: str, text: str):
    """Rows (doc_id, cls, n_shingles, bands array<long>, short binary: the bands' low 32 bits, sig binary) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(key), batch.column(text)
            for i, sets in _sets(texts, k):
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                keys, short, sigs = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    m = minima(np.concatenate([sets[f] for f in full]), starts, bands * BAND_ROWS + VERIFY)
                    acc = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(full), 1)
                    for r in range(BAND_ROWS):
                        acc = mix(acc * np.uint64(M1) + m[r : bands * BAND_ROWS : BAND_ROWS])
                    low = np.ascontiguousarray((mix(m[bands * BAND_ROWS :].astype(np.uint64)) & np.uint64(255)).astype(np.uint8).T)
                    for f, b, s in zip(full, np.ascontiguousarray(acc.T).view(np.int64), low, strict=True):
                        keys[f], short[f], sigs[f] = b, b.astype(np.int32).tobytes(), s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, len(sets)).cast(pa.int64()),
                        pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array(size),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(short, pa.binary()),
                        pa.array(sigs, pa.binary()),
                    ],
                    ["doc_id", "cls", "n_shingles", "bands", "short", "sig"],
                )

    return run


@cache
def _enough(threshold: float, miss: float) -> tuple[int, ...]:
    """How many of the first BATCH, 2 * BATCH, ... signature bytes must agree for a pair to stay.

    The similarity has a uniform prior; a byte agrees with the probability
    s + (1 - s) / 256. A pair stays while the posterior of s >= threshold is at
    least `miss`.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, VERIFY + 1, BATCH):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() / like.sum() >= miss:
                break
        out.append(m)
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two arrays of signatures may reach the threshold."""
    left = np.arange(len(a))
    agreed = np.zeros(len(a), np.int64)
    for i, need in enumerate(_enough(threshold, miss)):
        at = slice(i * BATCH, (i + 1) * BATCH)
        agreed[left] += (a[left, at] == b[left, at]).sum(1)
        left = left[agreed[left] >= need]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), VERIFY)


def _prune(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = plausible(_matrix(batch.column("sig_u")), _matrix(batch.column("sig_v")), threshold, miss)
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def _fits(size: np.ndarray, one: int, threshold: float) -> np.ndarray:
    """Sets whose sizes allow the threshold."""
    return np.minimum(size, one) >= threshold * np.maximum(size, one) - 1e-9


def _most_alike(threshold: float, miss: float):
    """In one block of a bucket: each class with the likeliest class of another component."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        node, comp, size = (t.column(c).to_numpy() for c in ("node", "component", "size"))
        sig = _matrix(t.column("sig").combine_chunks())
        xs, ys, agree = [], [], []
        need = _enough(threshold, miss)[-1]
        for i in range(len(node)):
            js = np.flatnonzero((comp != comp[i]) & _fits(size, size[i], threshold))
            if len(js):
                same = (sig[js] == sig[i]).sum(1)
                j = int(np.lexsort((node[js], -same))[0])
                if same[j] >= need:
                    xs.append(node[i]), ys.append(node[js[j]]), agree.append(same[j])
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64()), "agree": pa.array(agree, pa.int64())})

    return run


def _rivals(t: pa.Table, band: int, one: bool, threshold: float, miss: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a block pair, each with those of other components that may be linked with it and share no earlier band."""
    node, comp, size, side = (t.column(c).to_numpy() for c in ("node", "component", "size", "side"))
    sig = _matrix(t.column("sig").combine_chunks())
    short = np.frombuffer(b"".join(t.column("short").to_pylist()), np.int32).reshape(len(node), -1)[:, :band]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if one else 1))
    for i in left:
        js = right[(comp[right] != comp[i]) & _fits(size[right], size[i], threshold)]
        if one:
            js = js[node[js] > node[i]]
        if band and len(js):
            js = js[~(short[js] == short[i]).any(1)]
        if len(js):
            js = js[plausible(np.broadcast_to(sig[i], (len(js), VERIFY)), sig[js], threshold, miss)]
        if len(js):
            yield i, js


def _with_rival(threshold: float, miss: float):
    """Members of a block pair that may be linked with another component's."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        some = np.zeros(len(t), bool)
        for i, js in _rivals(t, t.column("band")[0].as_py(), key[1] == key[2], threshold, miss):
            some[i] = some[js] = True
        return t.select(["bucket", "i", "j", "band", "side", "node", "component", "size", "sig", "short"]).filter(pa.array(some))

    return run


def _rival_links(threshold: float, miss: float):
    """Links between different components in one block pair, verified on full sets."""
    hundred = round(threshold * 100)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        us, vs = [], []
        for i, js in _rivals(t, t.column("band")[0].as_py(), key[1] == key[2], threshold, miss):
            for j in js:
                if reaches(sets[i], sets[j], hundred):
                    us.append(min(node[i], node[j])), vs.append(max(node[i], node[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def reaches(x: np.ndarray, y: np.ndarray, hundred: int) -> bool:
    """Whether the similarity of two sorted sets is at least so many hundredths, and more than none."""
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= hundred * (len(x) + len(y) - shared)


def _reference(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """What most sets of one block hold, as the bucket's reference set."""
    x, n = np.unique(np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("set")]), return_counts=True)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "ref": pa.array([x[2 * n > len(t)].tobytes()], pa.binary())})


def _differences(hundred: int):
    """(bucket, node, set, ref) -> (bucket, node, g, diff): how each set differs from its bucket's reference, in order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, diff = [], []
            for s, r in zip(batch.column("set"), batch.column("ref"), strict=True):
                x, p = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(r.as_buffer(), np.uint64)
                d = np.setxor1d(x, p, assume_unique=True)
                lost = (len(d) + len(p) - len(x)) // 2
                g.append(2 * hundred * len(x) + 2 * (100 + hundred) * lost - (100 + hundred) * len(p))
                diff.append(d.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("node"), pa.array(g, pa.int64()), pa.array(diff, pa.list_(pa.int64()))], ["bucket", "node", "g", "diff"])

    return run


def _exact(k: int):
    """Sets of texts: (node, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in _sets(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    return run


def _linked(threshold: float):
    hundred = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [reaches(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), hundred) for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def exact_sets(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The full shingle sets of nodes."""
    return materialize(texts.join(nodes, "node", "left_semi").mapInArrow(tidy(_exact(k)), "node long, set binary"))


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold; texts: (node, text)."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = exact_sets(nodes, texts, k)
    u, v = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "uv")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "set_u", "set_v").mapInArrow(tidy(_linked(threshold)), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, k: int = 5, miss: float = MISS, prune: float = PRUNE, key: str = "doc_id", text: str = "text", max_rounds: int = 6, large: int = LARGE) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id it is linked with, over any number of links).

    The result is a written table of three numbers a row; all other tables are deleted.
    """
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(_groups(docs, threshold, k, miss, prune, key, text, max_rounds, large))


def _groups(docs: DataFrame, threshold: float, k: int, miss: float, prune: float, key: str, text: str, max_rounds: int, large: int) -> DataFrame:
    bands = n_bands(threshold, miss=miss)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    features = materialize(rows.mapInArrow(tidy(_features(k, bands, "doc_id", "text")), "doc_id long, cls binary, n_shingles long, bands array<long>, short binary, sig binary"))
    some = features.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(some.groupBy("cls").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "short", "sig")]))
    buckets = classes.select("node", F.posexplode("bands").alias("band", "bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("_last")).where("v <> _last").drop("_last")
    buckets = materialize(buckets.join(shared, "bucket").select("bucket", "band", "node", "v"))
    signed = classes.select("node", F.col("n_shingles").alias("size"), "sig", "short")
    texts = rows.select(F.col("doc_id").alias("node"), "text")

    stars = buckets.where("node <> v").select(F.col("v").alias("u"), F.col("node").alias("v")).distinct()
    su, sv = (signed.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("size").alias(f"size_{c}")) for c in "uv")
    fits = F.least("size_u", "size_v") >= F.greatest("size_u", "size_v") * threshold - 1e-9
    pairs = materialize(stars.join(su, "u").join(sv, "v").where(fits).select("u", "v", "sig_u", "sig_v").mapInArrow(tidy(_prune(threshold, prune)), "u long, v long"))
    links = materialize(verify(pairs, texts, threshold, k))
    tried, found = pairs, components(links)
    for round_ in range(max_rounds):
        members = _mixed(buckets, signed, found)
        if members is None:
            break
        near = members.withColumn("i", F.pmod(F.xxhash64("node", F.lit(round_)), F.col("blocks")).cast("int")).drop("blocks", "n", "short", "band")
        near = near.groupBy("bucket", "i").applyInArrow(_most_alike(threshold, prune), "x long, y long, agree long")
        near = near.groupBy("x").agg(F.max(F.struct("agree", "y")).alias("best")).select("x", F.col("best.y").alias("y"))
        new = near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        tried, more = _try(new, tried, texts, threshold, k)
        if more is None:
            break
        links = links.unionByName(more)
        found = components(links)
    members = _mixed(buckets, signed, found)
    if members is not None:
        links = _last_links(members, signed, found, links, texts, threshold, k, prune, large)
        found = components(links)
    by_class = classes.select("cls", "node").join(found, "node", "left").select("cls", F.coalesce("component", "node").alias("component"))
    out = features.select("doc_id", "cls", "n_shingles").join(by_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _try(new: DataFrame, tried: DataFrame, texts: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame | None]:
    """All pairs tried by now, and the links among those that are new (None if there are none)."""
    pairs = materialize(new.join(tried, ["u", "v"], "left_anti"))
    if pairs.isEmpty():
        return tried, None
    links = materialize(verify(pairs, texts, threshold, k))
    return tried.unionByName(pairs), None if links.isEmpty() else links


def _mixed(buckets: DataFrame, signed: DataFrame, found: DataFrame) -> DataFrame | None:
    """Members of the buckets that span components, with the number of blocks of each; None if there are none."""
    placed = buckets.join(found, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    members = materialize(placed.join(mixed.select("bucket", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket"))
    return None if members.isEmpty() else members.join(signed, "node")


def _last_links(members: DataFrame, signed: DataFrame, found: DataFrame, links: DataFrame, texts: DataFrame, threshold: float, k: int, prune: float, large: int) -> DataFrame:
    """All links, with those that only a search of whole buckets finds."""
    wide = materialize(members.where(F.col("n") > large).select("bucket", "band", "node", "blocks"))
    if not wide.isEmpty():
        stars, parts = _differing(wide, texts, threshold, k)
        links = links.unionByName(stars)
        rest = members.where(F.col("n") <= large).select("bucket", "band", "node")
        members = _mixed(materialize(rest.unionByName(parts)), signed, components(links))
        if members is None:
            return links
    types = "band int, side int, node long, component long, size long, sig binary, short binary"
    rivals = _block_pairs(members).groupBy("bucket", "i", "j").applyInArrow(_with_rival(threshold, prune), f"bucket long, i int, j int, {types}")
    rivals = materialize(rivals)
    sets = exact_sets(rivals.select("node").distinct(), texts, k)
    return links.unionByName(materialize(rivals.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(_rival_links(threshold, prune), "u long, v long").distinct()))


def _differing(wide: DataFrame, texts: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The star of each bucket, and the smaller buckets (bucket, band, node) whose members share a difference from its reference."""
    hundred = round(threshold * 100)
    sets = exact_sets(wide.select("node").distinct(), texts, k)
    first = wide.where(F.pmod(F.xxhash64("node"), F.col("blocks")) == 0).join(sets, "node").select("bucket", "set")
    refs = materialize(first.groupBy("bucket").applyInArrow(_reference, "bucket long, ref binary"))
    rows = wide.select("bucket", "node").join(refs, "bucket", "left").withColumn("ref", F.coalesce("ref", F.lit(b""))).join(sets, "node")
    rows = materialize(rows.select("bucket", "node", "set", "ref").mapInArrow(tidy(_differences(hundred)), "bucket long, node long, g long, diff array<long>"))
    least = rows.groupBy("bucket").agg(F.min(F.struct("g", "node")).alias("z"))
    rows = rows.join(least, "bucket").withColumn("sum", F.col("g") + F.col("z.g"))
    stars = rows.where("node <> z.node AND sum <= 0").select(F.least("node", "z.node").alias("u"), F.greatest("node", "z.node").alias("v")).distinct()
    stars = materialize(verify(stars, texts, threshold, k))  # arithmetic links them; sets with nothing in common stay apart
    need = F.greatest(F.lit(1), F.ceil(F.col("sum") / (2 * (100 + hundred)))).cast("int")
    prefix = rows.withColumn("need", need).where("need <= size(diff)").select("bucket", "node", F.explode(F.expr("slice(diff, 1, size(diff) - need + 1)")).alias("e"))
    bands = wide.select("bucket", "band").distinct()
    return stars, prefix.join(bands, "bucket").select(F.xxhash64("bucket", "e").alias("bucket"), "band", "node")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Members dealt to all pairs of blocks: block b meets b and every other block once, as i with b <= j and as j with i < b."""
    members = members.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), F.when(F.col("b") <= o, 0).otherwise(1).alias("side")))
    return members.select("bucket", "band", "node", "component", "size", "sig", "short", F.explode(dealt).alias("d")).select("bucket", "band", "node", "component", "size", "sig", "short", "d.*")
