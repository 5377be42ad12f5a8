"""MinHash near-duplicate groups: universal hash minima, bands, signature check, exact check, connected components.

1. Each text becomes its set of word shingles, many universal hash minima of it, a hash for each band of minima, a one-byte
   signature a minimum, and a digest of its words. Texts with equal words are one class, spoken for by its smallest id.
2. Classes that share a band's hash form a bucket. Every member is held against the bucket's smallest id: a signature too far
   off ends it, else the full sets decide. Confirmed links give components.
3. A bucket whose members are then of several components may hide links between members. All pairs of such texts over
   components are sought by exact prefix and position filters on their shingles, and what passes is checked like before. So a
   large group of copies gives no square of pairs, and no link between its members is lost. This adds links to those of the bands: all
   links are between texts that share a band with some text, and a text that shares none is not looked at again.
4. Components of all links, then each class's rows.

With 28 bands of 5 minima a pair at similarity 0.85 is missed by all bands with probability 7e-8, at 0.80 with 1.5e-5. The signature check lets
pass what lies within six standard deviations.

Cases: null and empty texts have an empty set, no link, themselves as component; fewer words than a shingle has: the whole
sequence is one shingle; repeated rows and equal ids are one document, each row of which is returned with its own set's size, and which is linked
by any of its texts if these differ; a null doc_id is linked
with nothing, its component is null and it is kept; very long texts are hashed in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import join_groups, materialise, table
from quillon.llm.components import components

BANDS, ROWS = 28, 5
#: Standard deviations below the threshold at which a signature rules a pair out.
SIGMAS = 6
#: Bytes, about, that the words which a worker remembers with their hashes may take; what a word takes besides its letters.
MEMO_BYTES, WORD_BYTES = 48_000_000, 150
BLOCK = 8192
#: Cells of the sketch of shingle frequencies.
CELLS = 1 << 20
#: Texts of a block of a frequent shingle, and blocks at most: how finely its pairs are dealt over tasks, not which are looked at.
BLOCK_ROWS, MOST_BLOCKS = 4096, 256


class _Memo(dict):
    letters = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        self.letters += len(word)
        return h

    def bound(self) -> None:
        if len(self) * WORD_BYTES + self.letters > MEMO_BYTES:
            self.clear()
            self.letters = 0


def split_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], k: int) -> set:
    """The exact set."""
    return set(zip(*[words[i:] for i in range(k)], strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], k: int, memo: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(len(h) - k + 1, 1)
    s = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        s = _mix(s + h[i : i + n])
    return np.unique(s)


def _functions(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each function a * x + b over the set."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (a[:, None] * hashes[None, at : at + BLOCK] + b[:, None]).min(axis=1), out=least)
    return least


def sign(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, copy_key, bands, signature, text_hash) of (doc_id, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (a, b) = _Memo(), _functions(bands * rows)
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            memo.bound()
            size, key, band, sig = [], [], [], []
            for text in (t.as_py() for t in batch.column(1)):  # one at a time
                words = split_words(text)
                h = shingle_hashes(words, k, memo)
                size.append(len(h))
                if not len(h):
                    key.append(None)
                    band.append(None)
                    sig.append(None)
                    continue
                least = _mix(minima(h, a, b))
                key.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sig.append(least.astype(np.uint8).tobytes())
                x = salt.copy()
                for c in least.reshape(bands, rows).T:
                    x = _mix(x + c)
                band.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary()), batch.column(2)],
                names=["doc_id", "n_shingles", "copy_key", "bands", "signature", "text_hash"],
            )

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(hashed, "doc_id long, n_shingles long, copy_key binary, bands array<long>, signature binary, text_hash long")


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union of their full sets; texts: (node, text, signature, text_hash)."""
    t = num / den
    slack = SIGMAS * (t * (1 - t) / (BANDS * ROWS)) ** 0.5
    least = int((t - slack) * BANDS * ROWS)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            keep = []
            a, b = list(zip(batch.column("a").to_pylist(), batch.column("ha").to_pylist(), strict=True)), batch.column("b")
            sa, sb, ta, tb = (batch.column(c) for c in ("sa", "sb", "ta", "tb"))
            for i, x in enumerate(a):
                p, q = np.frombuffer(sa[i].as_py(), np.uint8), np.frombuffer(sb[i].as_py(), np.uint8)
                if int((p == q).sum()) < least:
                    continue
                if x != last:
                    last, own = x, shingle_set(split_words(ta[i].as_py()), k)
                other = shingle_set(split_words(tb[i].as_py()), k)
                common = len(own & other)
                if den * common >= num * (len(own) + len(other) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], names=["a", "b"])

    side = lambda n, x: texts.select(F.col("node").alias(n), F.col("text").alias(f"t{x}"), F.col("signature").alias(f"s{x}"), F.col("text_hash").alias(f"h{x}"))
    return pairs.join(side("b", "b"), "b").join(side("a", "a"), "a").select("a", "b", "ha", "sa", "sb", "ta", "tb").mapInArrow(held, "a long, b long")


def frequencies(texts: DataFrame, k: int) -> np.ndarray:
    """How many shingles of the texts fall into each of CELLS cells: a sketch of their frequencies, of fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, cells = _Memo(), np.zeros(CELLS, np.int64)
        for batch in batches:
            memo.bound()
            text = batch.column("text")
            for i in range(batch.num_rows):
                h = shingle_hashes(split_words(text[i].as_py()), k, memo)
                np.add.at(cells, (h % np.uint64(CELLS)).astype(np.int64), 1)
        own = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(cells[own])], names=["cell", "n"])

    sums = texts.select("text").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out


def prefixes(texts: DataFrame, often: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(node, n, h, place): of each text's shingles in the one order, rare cells first, those that a linked text must share one of."""
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in batches:
            memo.bound()
            node, text, out = batch.column("node").to_pylist(), batch.column("text"), [[], [], [], []]
            for i, x in enumerate(node):
                h = shingle_hashes(split_words(text[i].as_py()), k, memo)
                count = shared.value[(h % np.uint64(CELLS)).astype(np.int64)]
                length = len(h) - -(-len(h) * num // den) + 1
                o = np.lexsort((h, count))[:length]
                place = np.arange(1, len(o) + 1)
                some = count[o] > 1  # a cell of one shingle has no other text's
                for column, values in zip(out, (np.full(int(some.sum()), x), np.full(int(some.sum()), len(h)), h[o][some].view(np.int64), place[some]), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) if c else pa.array([], pa.int64()) for c in out], names=["node", "n", "h", "place"])

    return texts.select("node", "text").mapInArrow(first, "node long, n long, h long, place long")


def pairs_over_components(texts: DataFrame, component: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of all texts of different components that may be linked: exact prefix and position filters on their shingles.

    Each text's shingles are put in one order, rare ones first. Linked texts share a shingle so far ahead in both that the rest, had
    it all in common, would reach the threshold. What sets a text apart from a large group of copies is rare and comes first,
    so that its pairs with the group fail by position, before they are made. Any order loses no link; the sketch only makes a good one.
    """
    first = prefixes(texts, frequencies(texts, k), k, num, den)
    placed = materialise(first.join(component, "node"), "prefixes")
    mixed = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c")).where("low != high").drop("high")
    rows = materialise(join_groups(placed, mixed, ["h"], "c", placed.count(), F.col("node")), "mixed")
    # A pair over components has a side outside the lowest one. A shingle of many texts is dealt by blocks: each task has one block of them for x.
    parts = F.least(F.ceil(F.col("c") / BLOCK_ROWS), F.lit(MOST_BLOCKS)).cast("int")
    x = rows.where("component != low").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).alias("x")
    y = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("y")
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    on = (F.col("x.h") == F.col("y.h")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.component") != F.col("y.component")) & (rest * (num + den) >= (F.col("x.n") + F.col("y.n")) * num)
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; k words a shingle, linked at similarity num / den or more."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialise(sign(docs, k), "signed")
    with_set = signed.where("copy_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = with_set.groupBy("copy_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    total = with_set.count()
    member = materialise(join_groups(with_set, classes, ["copy_key"], "n", total, F.col("doc_id")).select("doc_id", "rep", "n_shingles", "bands", "signature", "text_hash"), "member")
    nodes = member.where("doc_id = rep").select(F.col("rep").alias("node"), "n_shingles", "bands", "signature", "text_hash").dropDuplicates(["node", "text_hash"])

    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = materialise(join_groups(banded, buckets, ["band", "hash"], "n", BANDS * total, F.col("node")), "shared")
    involved = shared.select("node").distinct()
    texts = materialise(
        docs.select(F.col("doc_id").alias("node"), "text", F.xxhash64("text").alias("text_hash"))
        .join(involved, "node")
        .join(nodes.select("node", F.col("text_hash").alias("_hash"), "n_shingles", "signature"), "node")
        .where("text_hash <=> _hash")  # after the join, which then keeps the rows where they are
        .drop("_hash")
        .dropDuplicates(["node", "text_hash"]),
        "texts",
    )
    star = shared.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = materialise(verify(star, texts, k, num, den), "links")

    # Buckets whose members belong to several components so far.
    known = materialise(components(links), "known")
    of = shared.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("first", "n")
    mixed = of.groupBy("band", "hash").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low != high")
    open_nodes = materialise(join_groups(of, mixed.drop("low", "high"), ["band", "hash"], "n", BANDS * total, F.col("node")).select("node", "component").distinct(), "open")
    more = pairs_over_components(texts.join(open_nodes, "node", "left_semi"), open_nodes, k, num, den)
    final = components(links.union(materialise(verify(more, texts, k, num, den), "more")))

    labels = materialise(final, "labels")
    by_rep = member.groupBy("rep").agg(F.count("*").alias("n")).join(labels.withColumnRenamed("node", "rep"), "rep")
    grouped = join_groups(member.select("doc_id", "rep", "n_shingles"), by_rep, ["rep"], "n", total, F.col("doc_id"), "left")
    out = grouped.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("copy_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group; same columns, whatever their names. Repeated rows of it stay one row; rows without an id all stay."""
    keep = near_duplicates(docs, k, num, den).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return named.union(docs.where("doc_id IS NULL"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85)
