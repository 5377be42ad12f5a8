"""Suffix-array dedup: threshold-bounded interval expansion on Burrows-Wheeler transforms, dealt over tasks by content.

Every string of `length` bytes (a window) that also starts earlier is removed. To compare equal windows in one task without
shuffling all suffixes, windows are dealt by content: the least hash among a window's grams (its anchor) is the same wherever
the window stands. Consecutive windows with one anchor are a unit: their common text, `length` to length + 68 bytes.

1. Units are found where the documents are read. Equal units of one read are reduced to the earliest there (the later ones are
   certain to be repeats), so that a passage that a third of all documents has reaches the shuffle once a task.
2. After a shuffle by anchor, equal units of all documents are reduced likewise. An anchor with one text left is done.
3. Anchors with several texts (edges and variants of passages): the texts are concatenated, sorted to a suffix array and
   transformed. Common prefixes follow by increasing value: backward extension turns each boundary between intervals at prefix
   value v into the boundaries at v + 1, breadth first, and stops at `length`. Rows with no boundary between them start with the
   same window; all but the earliest are repeats. Anchors with more than SPLIT texts are split by blocks and windows, not gathered.
4. The spans of each document are merged and cut.

Texts are UTF-8, so byte 0xFF never occurs in them and separates texts. Equal units are told by two 64-bit hashes (128 bits);
everything else is compared byte by byte.

Cases: null and empty texts have 0 bytes and lose nothing, as do texts under `length` bytes; a repeated row is the same document
(equal ids must have equal texts) and is cut alike; a null id is no id: each different text that has none is a document of its own,
told by 62 bits of a hash of the text; they come after all ids, in the order of that hash; very long texts are handled in blocks, but the
units and spans of one document are collected with its text; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import join_groups, materialise, table
from quillon.llm.mixing import ranked

LENGTH, GRAM = 100, 32
#: Bytes looked at together; a longer text is handled in blocks of so many window starts.
BLOCK = 1 << 15
#: Units gathered in a task before equal ones among them are reduced.
FLUSH = 400_000
#: Texts that an index takes of one group: larger groups are dealt further by content, into indexes alike; and bytes of texts indexed at a time.
SPLIT, INDEX_BYTES = 512, 1 << 17
NO_ID = (1 << 63) - 1
#: Where there are null ids, keys of documents from here on are those of texts without an id.
NULLS = 1 << 62
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    w = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,)).copy()
    n = len(data) - GRAM + 1
    return _mix(w[:n] * _ODD[0] + w[8 : n + 8] * _ODD[1] + w[16 : n + 16] * _ODD[2] + _mix(w[24 : n + 24]) * _ODD[4])


def _slide(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    size = 1
    n = len(v) - width + 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[width - size : width - size + n])


def units(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of concatenated texts [starts[i], ends[i]): anchor hash, text hash, first byte and end of each unit."""
    h = gram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 20) - 1)
    least = (_slide((h & ~low) | place, length - GRAM + 1) & low).astype(np.int64)
    sizes = np.maximum(ends - starts - length + 1, 0)
    s = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())  # starts of windows within one text
    if not len(s):
        e = np.empty(0, np.int64)
        return h[:0], h[:0], e, e
    p = least[s]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(s) - 1]])
    lo, end, at = s[first], s[last] + length, p[first]
    text = (end - lo).astype(np.uint64) * _ODD[7] + (at - lo).astype(np.uint64) * _ODD[6]
    for i, q in enumerate((lo, lo + GRAM, lo + 2 * GRAM, end - 3 * GRAM, end - 2 * GRAM, end - GRAM)):
        text = text + h[q] * _ODD[i]
        text = _mix(text)
    return h[at], text, lo, end


def _blocks(ids: list, texts: Iterable[str | None], length: int) -> Iterator[tuple]:
    """(data, starts, ends, document ids, first byte of each) for texts together, or for blocks of long ones."""

    def joined(part):
        sizes = np.array([len(b) for _, b, _ in part], np.int64)
        ends = np.cumsum(sizes)
        return np.frombuffer(b"".join([b for _, b, _ in part]), np.uint8), ends - sizes, ends, np.array([d for d, _, _ in part], np.int64), np.array([o for _, _, o in part], np.int64)

    part, total = [], 0
    for d, t in zip(ids, texts, strict=True):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if len(b) < length:
            continue
        for at in range(0, len(b) - length + 1, BLOCK):
            piece = b[at : at + BLOCK + length - 1]
            if part and total + len(piece) > BLOCK:
                yield joined(part)
                part, total = [], 0
            part.append((d, piece, at))
            total += len(piece)
    if part:
        yield joined(part)


def _text_key() -> Column:
    """Key of a text without an id."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.lit(NULLS)


def _own(doc_id: Column) -> tuple[Column, Column]:
    """doc and none of a document as in FOUND."""
    return F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.when(doc_id.isNull(), _text_key()).otherwise(F.lit(0)).alias("none")


def _keyed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(doc_id, text) with a key for doc_id, never null and in the order of the documents; and what turns SPANS by key into FOUND.

    The key is the id where that leaves room for NULLS, else the id less NULLS, and where ids lie at both ends, the id's rank.
    """
    nulls, low, high = docs.agg(F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    key, back, places = F.col("doc_id"), F.col("doc"), None
    if nulls and high is not None and high >= NULLS:
        if low >= -NULLS:
            key, back = key - F.lit(NULLS), back + F.lit(NULLS)
        else:
            ids = ranked(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id")
            places = materialise(ids.select("doc_id", F.col("_mix_rank").alias("place")), "places")
            key, back = F.col("place"), F.col("id")
            docs = docs.join(places, "doc_id", "left")

    def found(spans: DataFrame) -> DataFrame:
        if places is not None:
            spans = spans.join(places.select(F.col("doc_id").alias("id"), F.col("place").alias("doc")), "doc", "left")
        has_id = F.lit(not nulls) | (F.col("doc") < NULLS)
        return spans.select(F.when(has_id, back).otherwise(F.lit(NO_ID)).alias("doc"), F.when(has_id, F.lit(0)).otherwise(F.col("doc")).alias("none"), "lo", "hi")

    return docs.select((F.coalesce(key, _text_key()) if nulls else key).alias("doc_id"), "text"), found


UNITS = "repeat boolean, anchor long, text long, doc long, lo int, hi int"


def _spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans of (doc, lo, hi)."""
    if not len(doc):
        return doc, lo, hi
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], hi[o]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    shift = np.cumsum(new) * (1 << 40)  # so that one running maximum serves all documents
    reach = np.maximum.accumulate(hi + shift)
    new[1:] |= lo[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return doc[first], lo[first], (reach - shift)[last]


def find_units(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """UNITS of (doc_id, text): the earliest of equal units of a read, and the merged spans (repeat) of the later ones."""

    def reduced(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, text, doc, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        o = np.lexsort((lo, doc, text, anchor))
        anchor, text, doc, lo, hi = (x[o] for x in (anchor, text, doc, lo, hi))
        first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = ~first & ((doc != doc[head]) | (lo != lo[head]))
        d, a, b = _spans(doc[again], lo[again], hi[again])
        spread = _mix(d.astype(np.uint64) * _ODD[0] + a.astype(np.uint64)).view(np.int64)
        yield _batch(np.ones(len(d), bool), spread, np.zeros(len(d), np.int64), d, a, b)
        yield _batch(np.zeros(int(first.sum()), bool), anchor[first].view(np.int64), text[first].view(np.int64), doc[first], lo[first], hi[first])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count = [], 0
        for batch in batches:
            for data, starts, ends, ids, offsets in _blocks(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), length):
                anchor, text, lo, hi = units(data, ends, starts, length)
                k = np.searchsorted(ends, lo, side="right")
                own.append((anchor, text, ids[k], lo - starts[k] + offsets[k], hi - starts[k] + offsets[k]))
                count += len(anchor)
                if count >= FLUSH:
                    yield from reduced(own)
                    own, count = [], 0
        if own:
            yield from reduced(own)

    return docs.mapInArrow(found, UNITS)


def _batch(repeat, anchor, text, doc, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(repeat), pa.array(anchor, pa.int64()), pa.array(text, pa.int64()), pa.array(doc, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
        names=["repeat", "anchor", "text", "doc", "lo", "hi"],
    )


def reduce_units(found: DataFrame) -> DataFrame:
    """UNITS again: the spans of repeats (repeat), and the earliest unit of each text of the anchors that have several texts."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted. Kept between batches: the last anchor and text, its earliest place, and whether the anchor has several texts.
        last, held = None, None
        for batch in batches:
            repeat, anchor, text, doc, lo, hi = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if repeat.any():
                yield _batch(repeat[repeat], anchor[repeat], text[repeat], doc[repeat], lo[repeat], hi[repeat])
            anchor, text, doc, lo, hi = (x[~repeat] for x in (anchor, text, doc, lo, hi))
            if not len(anchor):
                continue
            new_anchor = np.concatenate([[last is None or anchor[0] != last[0]], anchor[1:] != anchor[:-1]])
            new = new_anchor | np.concatenate([[last is None or text[0] != last[1]], text[1:] != text[:-1]])
            heads = np.flatnonzero(new)
            at = np.cumsum(new) - 1  # -1: the group began in an earlier batch
            head_doc, head_lo = (np.where(at >= 0, x[heads[at]] if len(heads) else x, y) for x, y in ((doc, last[2] if last else 0), (lo, last[3] if last else 0)))
            again = ~new & ((doc != head_doc) | (lo != head_lo))
            if again.any():
                d, a, b = _spans(doc[again], lo[again], hi[again])
                yield _batch(np.ones(len(d), bool), np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, a, b)
            last = (anchor[-1], text[-1], head_doc[-1], head_lo[-1])
            # Earliest units by anchor; one that is alone so far is held back if more may come.
            own = [x[heads] for x in (anchor, text, doc, lo, hi)]
            if held is not None:
                own = [np.concatenate([[y], x]) for x, y in zip(own, held[0], strict=True)]
            if not len(own[0]):
                continue
            a = own[0]
            same = a[1:] == a[:-1]
            several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            out = several.copy()
            if held is not None and held[1]:
                out[0] = False  # it is out already
                several[0] = True
            if out.any():
                yield _batch(np.zeros(int(out.sum()), bool), *(x[out] for x in own))
            held = (tuple(x[-1] for x in own), bool(several[-1]))

    return found.repartition("anchor").sortWithinPartitions("anchor", "text", "doc", "lo").mapInArrow(streamed, UNITS)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, by `depth` bytes at least; the end sorts last."""
    n = len(data)
    padded = np.concatenate([data, np.full(8, 0xFF, np.uint8)])
    key = np.ndarray((n,), np.uint64, padded, strides=(1,)).byteswap()
    size = 8
    while True:
        order = np.argsort(key, kind="stable")
        if size >= depth:
            return order
        of = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], of[1:] != of[:-1]]))
        after = np.full(n, n, np.int64)
        after[: max(n - size, 0)] = rank[size:]
        key = rank * (n + 1) + after
        size *= 2


def intervals(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of the suffix array, whether it shares less than `length` bytes with the row before.

    Rows k - 1 and k come from rows i < j by prepending bytes. If these differ, their common prefix is 0; else it is one more
    than the least of the prefixes between i and j. So the boundaries found at value v decide which are found at v + 1.
    """
    n = len(data)
    before = data[order - 1]  # the transform; place 0 wraps around to a separator
    origin = np.argsort(before, kind="stable")
    i, j = origin[:-1], origin[1:]
    bound = np.zeros(n, bool)
    bound[0] = True
    now = np.flatnonzero(before[i] != before[j]) + 1
    k = np.flatnonzero(before[i] == before[j]) + 1
    i, j = i[k - 1].astype(np.int32), j[k - 1].astype(np.int32)
    level = np.zeros(n, np.int32)
    for value in range(length - 1):
        if not len(now) or not len(k):
            break
        bound[now] = True
        level[now] = 1
        seen = np.cumsum(level, dtype=np.int32)
        level[now] = 0
        now = k[seen[j] != seen[i]]
        if value % 4 == 3:  # rows found again do no harm: what they reach is found as well
            left = ~bound[k]
            k, i, j = k[left], i[left], j[left]
    bound[now] = True
    return bound


def repeats(texts: list[bytes], length: int) -> np.ndarray:
    """Places, in the texts each followed by a separator, where a window starts that starts earlier too. No text holds 0xFF."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(data, length)
    group = np.cumsum(intervals(data, order, length)) - 1
    whole = np.zeros(len(data), bool)
    n = np.maximum(sizes - length + 1, 0)
    whole[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())] = True
    fit = whole[order]
    at, group = order[fit], group[fit]
    if not len(at):
        return at
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(at, first)
    return np.sort(at[at != np.repeat(least, np.diff(np.concatenate([first, [len(at)]])))])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """Row number and bytes of each text, one at a time."""
    column = batch.column(batch.schema.get_field_index("text"))
    for i in range(batch.num_rows):
        t = column[i].as_py()
        yield i, t.encode("utf-8", "surrogatepass") if t else b""


def variants(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, n, doc, lo, part) of the wanted units (anchor, n, doc, lo, hi): their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                anchor, n, doc, lo, part = [], [], [], [], []
                for i, b in _texts(some):
                    d = some.column(0)[i].as_py()
                    for u in some.column(2)[i].as_py():
                        anchor.append(u["anchor"])
                        n.append(u["n"])
                        doc.append(d)
                        lo.append(u["lo"])
                        part.append(b[u["lo"] : u["hi"]])
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(n, pa.int64()), pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(part, pa.binary())], names=["anchor", "n", "doc", "lo", "part"])

    each = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "n", "lo", "hi")).alias("units"))  # of one document
    return docs.withColumnRenamed("doc_id", "doc").join(each, "doc").select("doc", "text", "units").mapInArrow(cut, "anchor long, n long, doc long, lo int, part binary")


SPANS = "doc long, lo int, hi int"
PIECES = "anchor long, doc long, lo int, at int, part binary"
#: Spans of documents by id: none is 0, and for a text without an id the key of the text, beside NO_ID.
FOUND = "doc long, none long, lo int, hi int"


def index_variants(parts: DataFrame, length: int) -> DataFrame:
    """SPANS of repeated windows among the texts of each anchor, several anchors to an index."""

    def spans(own: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        own = sorted(set(own))  # repeated rows once; places in the index are then in the order of the input
        at = repeats([x[2] for x in own], length)
        sizes = np.array([len(x[2]) + 1 for x in own], np.int64)
        ends = np.cumsum(sizes)
        k = np.searchsorted(ends, at, side="right")
        lo = np.array([x[1] for x in own], np.int64)[k] + at - (ends - sizes)[k]
        d, a, b = _spans(np.array([x[0] for x in own], np.int64)[k], lo, lo + length)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc", "lo", "hi"])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size, last = [], 0, None
        for batch in batches:
            for anchor, doc, lo, part in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "lo", "part")), strict=True):
                if anchor != last and size >= INDEX_BYTES:
                    yield spans(own)
                    own, size = [], 0
                last = anchor
                own.append((doc, lo, part))
                size += len(part)
        if own:
            yield spans(own)

    return parts.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "doc", "lo", "part").mapInArrow(indexed, SPANS)


def halved(parts: DataFrame, block: int, length: int) -> DataFrame:
    """PIECES of the parts (anchor, doc, lo, at, part): their windows that start in the same `block` bytes, counted back from the anchor's place.

    All windows of a piece hold its core, length - block + 1 bytes. Equal windows are as far from their anchor, and so have equal cores: they
    meet under the key of their core. A null `at` is sought in the part: the first gram with the anchor's hash.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for anchor, doc, lo, at, part in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "lo", "at", "part")), strict=True):
                if at is None:
                    h = gram_hashes(np.frombuffer(part, np.uint8))
                    at = int(np.argmax(h >> np.uint64(20) == np.uint64(anchor % (1 << 64)) >> np.uint64(20)))
                least = at - (len(part) - length)  # windows start at - least .. at bytes before the anchor
                for b in range(least // block, at // block + 1):
                    first, last = at - min(at, b * block + block - 1), at - max(least, b * block)
                    core = part[at - b * block : at - b * block - block + 1 + length]
                    row = (xxhash.xxh3_64_intdigest(core, seed=b + 1) - (1 << 63), doc, lo + first, at - first, part[first : last + length])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["anchor", "doc", "lo", "at", "part"])

    return parts.select("anchor", "doc", "lo", "at", "part").mapInArrow(cut, PIECES)


def deal_variants(parts: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups that each fit an index, and SPANS of repeats met on the way, of (anchor, n, doc, lo, part).

    A group of more than SPLIT texts is dealt further by content: its windows go by the core that they have in common with all that start in the
    same 32 bytes, then 16, 8, 4, 2, 1. Of pieces with equal bytes the earliest stays, the others are repeats. So a group shrinks at
    each step to what is still too large for one index, and with a core of a whole window there is one text left. Keys of groups and pieces are
    reduced before they are shuffled, and the rows of a hot one are dealt over tasks (join_groups).
    """
    fit, spans, block = [parts.where(F.col("n") <= SPLIT)], [], 32
    large = parts.where(F.col("n") > SPLIT).withColumn("at", F.lit(None).cast("int"))
    while block and not large.isEmpty():
        pieces = materialise(halved(large, block, length), "pieces")
        texts = pieces.groupBy("anchor", "part").agg(F.min(F.struct("doc", "lo", "at")).alias("first"), F.count("*").alias("c"))
        texts = materialise(texts, "texts")
        again = join_groups(pieces, texts.where("c > 1"), ["anchor", "part"], "c", pieces.count(), F.col("doc")).where("doc != first.doc OR lo != first.lo")
        spans.append(again.select("doc", "lo", (F.col("lo") + F.octet_length("part")).cast("int").alias("hi")))
        sizes = texts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
        sized = join_groups(texts, sizes, ["anchor"], "n", texts.count(), F.col("first.lo") + F.col("first.doc"))
        sized = materialise(sized.select("anchor", "n", "first.doc", "first.lo", "first.at", "part"), "sized")
        fit.append(sized.where(F.col("n") <= SPLIT))
        large, block = sized.where(F.col("n") > SPLIT), block // 2
    return fit, spans


def without(data: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs of spans."""
    lo, hi = (np.array([s[k] for s in spans], np.int64) for k in ("lo", "hi"))
    _, lo, hi = _spans(np.zeros(len(lo), np.int64), lo, hi)
    left, start = [], 0
    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
        left.append(data[start:x])
        start = y
    return b"".join([*left, data[start:]]), len(lo)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def cut(docs: DataFrame, spans: DataFrame, keep_text: bool = False) -> DataFrame:
    """Each document without its spans: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_text where asked for (else null).

    Bytes that a cut through a character leaves of it are no text: kept_text goes without them, the digest has them.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out = [[], [], [], [], [], []]
                spans_at = some.schema.get_field_index("spans")
                for i, b in _texts(some):
                    own = some.column(spans_at)[i].as_py() or []
                    left, count = without(b, own)
                    row = (some.column(0)[i].as_py(), len(b), len(b) - len(left), count, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if keep_text else None)
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    each = spans.groupBy("doc", "none").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # of one document
    rows = docs.select("doc_id", "text", *_own(F.col("doc_id")))
    return rows.join(each, ["doc", "none"], "left").select("doc_id", "text", "spans").mapInArrow(one, CUT)


def cut_text(text: Column, spans: Column) -> Column:
    """A text without its spans (lo, hi)."""

    def one(texts: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([without((t or "").encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, own, strict=True)])

    return F.pandas_udf(one, "string")(text, spans)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """FOUND: spans that cover every byte of a window that also starts earlier; they may overlap."""
    if not 3 * GRAM <= length <= 3 * GRAM + 4:
        raise ValueError("units are told by six grams, which cover windows of 96 to 100 bytes")
    keyed, found = _keyed(docs)
    reduced = materialise(reduce_units(find_units(keyed, length)), "units")
    again = reduced.where("repeat").select("doc", "lo", "hi")
    several = reduced.where("NOT repeat")
    total = several.count()
    sizes = several.groupBy("anchor").agg(F.count("*").alias("n"))
    wanted = join_groups(several, sizes, ["anchor"], "n", total, F.col("doc"))
    parts = materialise(variants(keyed, wanted.select("anchor", "n", "doc", "lo", "hi")), "variants")
    fit, spans = deal_variants(parts, length)
    every = reduce(DataFrame.union, [x.select("anchor", "doc", "lo", "part") for x in fit])
    return found(reduce(DataFrame.union, [again, materialise(index_variants(every, length), "indexed"), *spans]))


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated spans cut out of the text; same columns, every row stays."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = materialise(repeated_spans(own, length), "spans")
    each = spans.groupBy("doc", "none").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = docs.select(F.struct("*").alias("row"), *_own(F.col("doc_id").cast("long"))).join(each, ["doc", "none"], "left")
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    text = F.col("row.text")
    rows = rows.select("row", F.when(text.isNotNull(), cut_text(text, F.coalesce("spans", empty))).alias("text"))
    of = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[of.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut(docs, materialise(repeated_spans(docs), "spans")).drop("kept_text")
