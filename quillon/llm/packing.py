"""Best-fit packing planned on the histogram of lengths.

Tokenise each document once into pieces of at most `size` tokens, count the pieces of each length, plan best-fit decreasing
over the counts instead of the pieces, and let pieces take planned slots by joining on their rank within their length.
The histogram has `size` rows at most, and the plan at most 11 entries for each of three groups of bins a length can open (a
group that takes pieces keeps less than half its room), so both are small whatever the input. Ranks are exact and spread: a
length, even one that most pieces have, is dealt over buckets, and only counts of (length, bucket) meet in one place.

Cases: null and empty texts are one piece that holds the end mark alone; very long texts are cut, not truncated; repeated rows
and equal ids are packed once for each row; null ids are packed like others; an empty table gives no sequence. Input columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import materialise, table

#: Bytes, about, that words and pre-tokens remembered with their ids in a worker may take; what each takes besides its letters and ids. Memory
#: only, never the result.
MEMO_BYTES, WORD_BYTES = 140_000_000, 160
#: Documents, and bytes of text unless one alone has more, encoded at a time.
BATCH, BATCH_BYTES = 1024, 4_000_000
#: Buckets of a length: at least, at most, and rows for another one.
BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 64, 4096, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write bytes as letters: printable ones stand for themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: 256 + i for i, byte in enumerate(x for x in range(256) if x not in own)}


class Encoder:
    """Ids of texts by the tokenizer of word_bpe_49k.json: NFC, lower case, pre-tokens, byte-level BPE with word ends.

    White space bounds pre-tokens, so that words are encoded apart and each distinct one once, and remembered with its ids. That
    holds for texts of letters on whose case, class and normal form all versions of Unicode agree (PLAIN); other texts, and those
    with a special token's string, go to the tokenizer as a whole.
    """

    PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\u02ff\u0400-\u0482\u048a-\u052f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        splits = own["pre_tokenizer"]["pretokenizers"]
        if [x["type"] for x in own["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path} splits texts in another way")
        self.pretokens = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.tokenize = self.tokenizer.model.tokenize
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.known: dict[str, list[int]] = {}  # ids of a pre-token
        self.bytes = 0
        self.start, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)  # ids of word k: flat[start[k]:start[k + 1]]

    def ids(self, pretoken: str) -> list[int]:
        found = self.known.get(pretoken)
        if found is None:
            letters = pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(self.letters)
            found = self.known[pretoken] = [t.id for t in self.tokenize(letters)]
            self.bytes += WORD_BYTES + len(pretoken) + 40 * len(found)
        return found

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; new ones are encoded."""
        flat, ends, known = [], [], self.words
        for w in words:
            if w not in known:
                known[w] = len(known)
                self.bytes += WORD_BYTES + len(w)
                if w.isalpha():  # one run of letters
                    flat += self.ids(w)
                elif w[:-1].isalpha() and w[-1] in ".,":
                    flat += self.ids(w[:-1])
                    flat += self.ids(w[-1])
                else:
                    for p in self.pretokens(w):
                        flat += self.ids(p)
                ends.append(len(flat))
        if ends:
            self.bytes += 4 * len(flat)
            self.start = np.concatenate([self.start, np.asarray(ends, np.int64) + len(self.flat)])
            self.flat = np.concatenate([self.flat, np.asarray(flat, np.uint32)])
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text. Distinct words are found by Arrow for all the texts together."""
        if self.bytes > MEMO_BYTES:
            self.forget()
        plain = [not t or (self.PLAIN.fullmatch(t) is not None and not self.special.search(t)) for t in texts]
        split = pc.ascii_split_whitespace(pa.array([t.lower() if t and p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        k = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        n = self.start[k + 1] - self.start[k]
        end = np.concatenate([[0], np.cumsum(n)])
        all_ids = self.flat[np.repeat(self.start[k] - end[:-1], n) + np.arange(end[-1])]
        bounds = end[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for i, text in enumerate(texts):
            yield all_ids[bounds[i] : bounds[i + 1]] if plain[i] else np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One in each worker process, whose tasks share what it remembers."""
    return Encoder(path)


def slices(batch: pa.RecordBatch, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most BATCH rows and, if of several rows, BATCH_BYTES of text."""
    sizes, at, total = pc.fill_null(pc.binary_length(text), 0).to_numpy(), 0, 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > BATCH_BYTES or i - at == BATCH):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield batch.slice(at)


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids, end mark included; with_ids adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                doc, piece, start, length, crc, out = [], [], [], [], [], []
                for d, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), size)):
                        own = ids[s : s + size]
                        doc.append(d)
                        piece.append(p)
                        start.append(s)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            out.append(own.astype(np.int32))
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], size: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, pieces, pieces in each sequence, first sequence, place in the sequence).

    Bins of equal room form a group of consecutive sequences. The pieces of a length go to the group with least sufficient room;
    each of its bins takes as many as fit (after one piece a bin is the tightest still), before the next bin or group.
    """
    entries, rooms, groups, used = [], [], {}, 0  # rooms: sorted, distinct; groups: room -> [(first sequence, bins)]

    def keep(room: int, first: int, bins: int) -> None:
        if bins and room:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, bins))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
            else:
                room, first, bins = size, used, -(-left // (size // length))
                used += bins
            each = room // length
            full = min(bins, left // each)
            if full:
                entries.append((length, rank, full * each, each, first, size - room))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < bins:
                entries.append((length, rank, left, left, first + full, size - room))
                keep(room - left * length, first + full, 1)
                full, left = full + 1, 0
            keep(room, first + full, bins - full)
    return entries


def place(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to materialised pieces."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    total = sum(histogram.values())
    buckets = min(MOST_BUCKETS, max(BUCKETS, total // BUCKET_ROWS))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("length", "_bucket").count().withColumn("_before", F.coalesce(before, F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("_within", within).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    slots = spark.createDataFrame(plan(histogram, size), "_length long, _first long, _n long, _each long, _sequence long, _place long")
    at = F.col("_rank") - F.col("_first")
    on = (F.col("length") == F.col("_length")) & (at >= 0) & (at < F.col("_n"))
    placed = ranked.join(F.broadcast(slots), on)  # a bounded plan, see above
    return placed.withColumns({"sequence_id": (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long"), "offset": (F.col("_place") + at % F.col("_each") * F.col("length")).cast("long")}).select(
        *cut.columns, "sequence_id", "offset"
    )


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(materialise(pieces(docs, tokenizer or default_tokenizer(), size, end_id, with_ids=with_ids), "pieces"), size)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
