"""Suffix-array deduplication: byte strings of a given length that occur more than once in a corpus.

Only suffixes cut at `length` bytes matter: a window (such a suffix) is a repeat
if its longest previous factor, or the longest factor that follows, reaches
`length`. Equal windows choose equal anchors, so the suffix array is built anchor
by anchor, dealt over a cluster:

1. Every text's windows choose anchors (see anchors.py); equal windows choose
   the same anchor. Runs of windows with one anchor are classed by all bytes
   they cover, and runs whose anchor occurs once are done: nothing repeats.
2. All members of a class but the first repeat it. Between different classes
   with one anchor the windows themselves are put in suffix order, with an LCP
   array beside it. The longest previous factor of a window is what it shares with
   its previous or next smaller position in that order.
3. Covered bytes are joined per text and cut out.

keep_first=True removes the bytes of windows that have an earlier occurrence
(earlier doc_id, then earlier in the text); False removes those of windows that
occur anywhere else, the first copy included. Windows are judged on the input,
and none crosses from one text to another.

An anchor with more classes than `hot` is not given to one task: its windows
become rows of a grouped count. Both ways give the same result. A text has one
row a class, however often it repeats a line, and keys that many texts share are
dealt over several tasks where tables are joined.

Defined results: null counts as empty; texts shorter than `length` stay; rows
that agree in doc_id and text repeat each other, and with keep_first neither is
the later one, so both keep their first copies; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.anchors import runs
from logloom.llm.textvec import chunks, prefix_hash, span_hash, utf8
from logloom.tables import drop_materialized, free, materialize, scratch, ship, tidy

HOT = 20_000
#: Context bytes that a task puts in suffix order at a time, at least one anchor's.
BLOCK_BYTES = 1 << 21
LAST = (1 << 63) - 1
#: A join key with more than one in SHARE of all rows is dealt over several tasks.
SHARE = 1000


def _scan(length: int):
    """(doc_id, t, text) -> (doc_id, t, occ): the runs of each text, those of one class together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            for i, j, o, d in chunks(offsets, data):
                text, h, c, lo, hi = runs(o, d, length)
                by = np.lexsort((lo, c, h, text))
                text, h, c, lo, wide = text[by], h[by], c[by], lo[by] - o[:-1][text[by]], (hi - lo)[by]
                new = np.ones(len(text), bool)
                new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (text, h, c)])
                first = np.flatnonzero(new)
                los = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)).astype(np.int32)), pa.array(lo.astype(np.int32)))
                occ = pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(c[first].view(np.int64)), pa.array(wide[first].astype(np.int32)), los], ["h", "c", "wide", "los"])
                to = np.searchsorted(text[first], np.arange(j - i + 1)).astype(np.int32)
                some = np.flatnonzero(np.diff(to))
                lists = pa.ListArray.from_arrays(pa.array(to), occ)
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("t").slice(i, j - i), lists], ["doc_id", "t", "occ"])
                yield out.take(pa.array(some))

    return run


def heavy(counts: DataFrame, on: list[str], rows: str) -> DataFrame:
    """Of a written table with the number of `rows` of each key: the keys with more than one in SHARE of all rows (so fewer than SHARE), and how many parts to make of each."""
    part = (counts.agg(F.sum(rows)).first()[0] or 0) // SHARE + 1
    return counts.where(F.col(rows) > part).select(*on, F.ceil(F.col(rows) / part).cast("int").alias("_parts"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key; left's rows of a hot key are dealt over its parts by the columns `spread`."""
    hot = F.broadcast(hot)
    left = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def _contexts(length: int):
    """(text, want list of (h, c, lo, hi, nc)) -> the bytes of each wanted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, t, text, want in zip(batch.column("doc_id"), batch.column("t"), batch.column("text"), batch.column("want"), strict=True):
                body = (text.as_py() or "").encode()
                w = want.values
                h, c, nc = (w.field(x) for x in ("h", "c", "nc"))
                lo, hi = (w.field(x).to_numpy() for x in ("lo", "hi"))
                n = len(w)
                yield pa.RecordBatch.from_arrays(
                    [h, c, nc, pa.array([doc.as_py()] * n, pa.int64()), pa.array([t.as_py()] * n, pa.int64()), pa.array(lo), pa.array([body[a : b + length] for a, b in zip(lo, hi, strict=True)], pa.binary())],
                    ["h", "c", "nc", "doc_id", "t", "lo", "ctx"],
                )

    return run


def windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all contexts; where each window begins in them, its digest, its context and its place there."""
    size = np.array([len(x) for x in contexts])
    base = np.cumsum(size) - size
    n = size - length + 1
    which = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = base[which] + place
    data = np.frombuffer(b"".join(contexts), np.uint8)
    return data, start, span_hash(prefix_hash(data), start, start + length), which, place


def suffix_order(data: np.ndarray, start: np.ndarray, digest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of the suffixes of `data` at `start`, cut at `length` bytes.

    Equal suffixes, told by their digests, stay in the given order. Suffixes are
    sorted by eight bytes at a time, and only stretches that still hold different
    ones go on to the next eight. lcp[i] is what the i-th shares with the one before.
    """
    n = len(start)
    order, lcp = np.arange(n), np.full(n, length, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
    head = np.zeros(n, bool)  # where a stretch of suffixes that agree so far begins
    head[:1] = True
    lcp[:1] = 0
    slots = order.copy()
    for depth in range(0, length, 8):
        here = order[slots]
        key = eight[start[here] + depth].astype(np.uint64) >> np.uint64(8 * max(0, depth + 8 - length))
        sort = np.lexsort((key, np.cumsum(head[slots])))
        here, key = here[sort], key[sort]
        order[slots] = here
        apart = np.flatnonzero((key[1:] != key[:-1]) & ~head[slots[1:]]) + 1
        differ = key[apart] ^ key[apart - 1]
        differ <<= np.uint64(8 * max(0, depth + 8 - length))
        lcp[slots[apart]] = depth + (differ[:, None] < np.uint64(1) << np.arange(56, 0, -8, np.uint64)).sum(1)
        head[slots[apart]] = True
        first = np.flatnonzero(head[slots])
        x = digest[here]
        mixed = np.zeros(len(first), bool)
        which = np.cumsum(head[slots]) - 1
        mixed[which[1:][(x[1:] != x[:-1]) & (which[1:] == which[:-1])]] = True
        slots = slots[mixed[which]]
        if not len(slots):
            break
    return order, lcp


def longest_previous(order: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """For each suffix whether its longest previous factor reaches `length`.

    Of the suffixes with a smaller position, those that share most are the
    nearest ones before and after it in suffix order. Within a stretch that shares
    `length` bytes the order is that of positions: the previous smaller position
    is the slot before, and the next smaller one lies outside, where less is shared.
    """
    before = np.concatenate([[False], order[1:] > order[:-1]]) if len(order) else np.zeros(0, bool)
    out = np.zeros(len(order), bool)
    out[order] = before & (lcp >= length)
    return out


def repeated(data: np.ndarray, start: np.ndarray, digest: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """Which windows, given in order of position, repeat an earlier one (or any other).

    Windows whose digest occurs once repeat nothing and aren't sorted.
    """
    out = np.zeros(len(start), bool)
    by = np.argsort(digest)
    same = digest[by[1:]] == digest[by[:-1]]
    some = np.zeros(len(start), bool)
    some[by[1:][same]] = some[by[:-1][same]] = True
    some = np.flatnonzero(some)
    order, lcp = suffix_order(data, start[some], digest[some], length)
    previous = longest_previous(order, lcp, length)
    out[some] = previous
    if not keep_first:  # a window that a later one repeats has a longest following factor of that length
        out[some[order[:-1][lcp[1:] >= length]]] = True
    return out


def _spans(flag: np.ndarray, which: np.ndarray, place: np.ndarray, n: int, length: int) -> pa.ListArray:
    """Stretches of flagged windows as spans of bytes, for each of n contexts."""
    at = np.flatnonzero(flag)
    w, p = which[at], place[at]
    first = np.concatenate([[True], (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(at) else first
    spans = pa.StructArray.from_arrays([pa.array(p[first].astype(np.int32)), pa.array((p[last] + length).astype(np.int32))], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(w[first], np.arange(n + 1)).astype(np.int32)), spans)


def _order_windows(length: int, keep_first: bool):
    """Contexts, all of an anchor in succession -> (h, c, spans)."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        place = [t[x].to_numpy() for x in ("h", "lo", "t", "doc_id")]
        order = np.lexsort(place)
        same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in place])  # from a repeated row
        t = t.take(pa.array(order[np.concatenate([[True], ~same])]))
        data, start, digest, which, place = windows(t["ctx"].to_pylist(), length)
        spans = _spans(repeated(data, start, digest, length, keep_first), which, place, len(t), length)
        return pa.RecordBatch.from_arrays([t["h"].combine_chunks(), t["c"].combine_chunks(), spans], ["h", "c", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < BLOCK_BYTES:
                continue
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            cut = int(np.flatnonzero(h == h[-1])[0])  # the last anchor may go on in the next batch
            if cut:
                yield solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
            else:
                size = 0  # one anchor only so far: look again after as much more
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _hot_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                _, _, hashes, which, place = windows(b.column("ctx").to_pylist(), length)
                w = pa.array(which)
                yield pa.RecordBatch.from_arrays([*(b.column(x).take(w) for x in ("h", "c", "doc_id", "t", "lo")), pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64))], ["h", "c", "doc_id", "t", "lo", "place", "w"])

    return run


def _hot_spans(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """What _order_windows finds, with a grouped count instead of one task for each anchor."""
    rows = materialize(contexts.mapInArrow(tidy(_hot_windows(length)), "h long, c long, doc_id long, t long, lo int, place int, w long"))
    place = F.struct("doc_id", "t", (F.col("lo") + F.col("place")).alias("at"))
    seen = materialize(rows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).where("n > 1"))
    joined = spread_join(rows, seen, ["h", "w"], heavy(seen, ["h", "w"], "n"), ["doc_id", "t", "lo", "place"])
    if keep_first:
        joined = joined.where(place != F.col("least"))
    spans = F.transform(F.collect_set("place"), lambda p: F.struct(p.alias("a"), (p + length).alias("b")))
    return joined.groupBy("h", "c").agg(spans.alias("spans"))


def repeat_spans(docs: DataFrame, *, length: int, keep_first: bool, hot: int = HOT) -> DataFrame:
    """docs(doc_id, t, text) -> (doc_id, t, spans): for each text with repeats the bytes to remove, spans may overlap.

    doc_id has no nulls here; t tells texts with one doc_id apart. The result is
    a written table; all other tables are deleted.
    """
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(_find_spans(docs, length, keep_first, hot))


def _find_spans(docs: DataFrame, length: int, keep_first: bool, hot: int) -> DataFrame:
    scan = materialize(docs.where(F.octet_length("text") >= length).mapInArrow(tidy(_scan(length)), "doc_id long, t long, occ array<struct<h: long, c: long, wide: int, los: array<int>>>"))
    each = scan.select(F.explode("occ").alias("o")).select("o.h", F.size("o.los").alias("k"))
    again = materialize(each.groupBy("h").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("rows")).where("k > 1").drop("k"))
    occ = scan.select("doc_id", "t", F.explode("occ").alias("o")).select("doc_id", "t", "o.*")
    occ = materialize(spread_join(occ, again, ["h"], heavy(again, ["h"], "rows"), ["doc_id", "t", "c"]).drop("rows"))
    drop_materialized(scan, again)
    lo = F.element_at("los", 1)
    rep = F.struct("doc_id", "t", lo.alias("lo"), (lo + F.col("wide")).alias("hi"))
    classes = materialize(occ.groupBy("h", "c").agg(F.sum(F.size("los")).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(rep).alias("rep")))
    hot_classes = heavy(classes, ["h", "c"], "rows")
    several = materialize(classes.groupBy("h").agg(F.count(F.lit(1)).alias("nc")).where("nc > 1"))
    want = spread_join(classes, several, ["h"], heavy(several, ["h"], "nc"), ["c"]).select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.t").alias("t"), F.struct("h", "c", "rep.lo", "rep.hi", "nc").alias("w"))
    want = want.groupBy("doc_id", "t").agg(F.collect_list("w").alias("want"))
    contexts = docs.join(want, ["doc_id", "t"]).select("doc_id", "t", "text", "want").mapInArrow(tidy(_contexts(length)), "h long, c long, nc long, doc_id long, t long, lo int, ctx binary")
    contexts = materialize(contexts)
    spans = contexts.where(F.col("nc") <= hot).drop("nc").repartition("h").sortWithinPartitions("h").mapInArrow(tidy(_order_windows(length, keep_first)), "h long, c long, spans array<struct<a: int, b: int>>")
    spans = spans.unionByName(_hot_spans(contexts.where(F.col("nc") > hot).drop("nc"), length, keep_first))
    judged = classes.join(spans, ["h", "c"], "left")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("wide") + length).alias("b")))
    if keep_first:
        is_rep = (F.col("rep.doc_id") == F.col("doc_id")) & (F.col("rep.t") == F.col("t"))
        judged = judged.where("n > 1 OR spans IS NOT NULL")
        own = F.coalesce("spans", F.array().cast("array<struct<a: int, b: int>>"))
    else:
        judged = judged.where("n > 1 OR size(spans) > 0").withColumn("spans", F.when(F.col("n") > 1, None).otherwise(F.col("spans")))
        own, whole = None, F.coalesce("spans", whole)

    def moved(at: Column) -> Column:
        mine = whole if own is None else F.when(is_rep & (F.col("rep.lo") == at), own).otherwise(whole)
        return F.transform(mine, lambda s: F.struct((s["a"] + at).alias("a"), (s["b"] + at).alias("b")))

    hits = spread_join(occ, judged.select("h", "c", "rep", "spans"), ["h", "c"], hot_classes, ["doc_id", "t"])
    hits = hits.select("doc_id", "t", F.flatten(F.transform("los", moved)).alias("s")).where("size(s) > 0")
    return hits.groupBy("doc_id", "t").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _cut(aligned: bool, names: tuple[str, str, str]):
    """Cut the spans (last column) out of the texts (last but one); aligned: none of them may split a character."""

    def merged(spans: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        a, b = spans.field("a").to_numpy(), spans.field("b").to_numpy()
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        first = np.concatenate([[True], a[1:] > b[:-1]])
        return a[first], b[np.concatenate([first[1:], [True]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, count = [], [], []
            for text, spans in zip(*batch.columns[-2:], strict=True):
                body = text.as_py().encode()
                if not spans.is_valid or not len(spans.values):
                    kept.append(body), removed.append(0), count.append(0)
                    continue
                a, b = merged(spans.values)
                parts, at, gone, k = [], 0, 0, 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if aligned:
                        while x < y and body[x] & 0xC0 == 0x80:
                            x += 1
                        while y > x and y < len(body) and body[y] & 0xC0 == 0x80:
                            y -= 1
                    if x < y:
                        parts.append(body[at:x])
                        at, gone, k = y, gone + y - x, k + 1
                parts.append(body[at:])
                kept.append(b"".join(parts)), removed.append(gone), count.append(k)
            new = [pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], [*batch.schema.names[:-2], *names])

    return run


def row_key(key: str, text: str) -> tuple[Column, Column]:
    """(doc_id without nulls, a hash of the text): together they tell rows apart, but for repeated ones."""
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def remove_repeats(docs: DataFrame, *, length: int = 400, keep_first: bool = True, aligned: bool = True, key: str = "doc_id", text: str = "text", hot: int = HOT, names: tuple[str, str, str] = ("kept", "n_removed", "n_spans")) -> DataFrame:
    """docs without text, with the bytes that remain, their removed number and the number of spans under `names`; columns of these names are replaced."""
    id_, t = row_key(key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    spans = repeat_spans(docs.select(id_.alias("doc_id"), t.alias("t"), body.alias("text")), length=length, keep_first=keep_first, hot=hot)
    docs = docs.drop(*names)
    own_id, own_t, own_text, doc, t2, cut = free(docs.columns, "_id", "_t", "_text", "_doc", "_t2", "_spans")
    spans = spans.toDF(doc, t2, cut)
    rows = docs.withColumns({own_id: id_, own_t: t, own_text: body}).join(spans, (F.col(own_id) == F.col(doc)) & (F.col(own_t) == F.col(t2)), "left")
    schema = [f for f in docs.schema.fields if f.name != text]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    rows = rows.select(*[F.col(f"`{f.name}`") for f in schema], own_text, cut)
    return rows.mapInArrow(tidy(_cut(aligned, names)), f"{types}`{names[0]}` binary, `{names[1]}` long, `{names[2]}` long")
