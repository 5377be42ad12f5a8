"""Token counts of a unigram tokenizer by dynamic programming shared over a trie.

Distinct pre-tokens (a word with the mark of a word's start before it) are inserted in a trie that lives as long as its worker, over all
the documents that this reads. A node stands for a prefix and holds the best forward score of any segmentation of it and that
segmentation's number of tokens; it is scored when it is made, from its ancestors, and never again. A word's end gives the word's count, which is
kept as the terminal count. Documents are read once and nothing is shuffled; trie and counts are dropped together when they take more
than MEMO_BYTES, which never changes a result.

The vocabulary is a public one of 32,000 pieces. It has no unigram probabilities, so that these are made up from a piece's rank by Zipf's law
(parameter `shift`): the counts are those of no published tokenizer. A caller who has logarithms of real probabilities gives them (`scores`). A
character that no piece covers costs UNKNOWN below the worst piece and counts as its UTF-8 bytes (byte fallback). Equal scores are settled for
fewer tokens.

Cases: null and empty texts, and texts of white space, have no words and no tokens; repeated rows are counted alike, each on its own; null ids
stay; words of any length are walked without recursion, those over LONG_WORD characters without nodes of their own, as nothing else begins
like them; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.packing import slices

START = "▁"
UNKNOWN = 10.0
#: Bytes, about, that a worker's trie and counts may take; what a node and a word's count take besides its letters.
MEMO_BYTES, NODE_BYTES, WORD_BYTES = 350_000_000, 200, 130
LONG_WORD = 200
COUNTS = "doc_id long, n_words long, n_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_scores(pieces: list[str], shift: float = 2.7) -> dict[str, float]:
    """Natural logarithms of probabilities in proportion to 1 / (rank + shift)."""
    total = math.log(sum(1 / (r + shift) for r in range(len(pieces))))
    return {p: -math.log(r + shift) - total for r, p in enumerate(pieces)}


def read_pieces(path: str) -> list[str]:
    """Pieces of a vocabulary file in the order of rank, without control and byte pieces."""
    import sentencepiece

    v = sentencepiece.SentencePieceProcessor(model_file=path)
    return [v.id_to_piece(i) for i in range(v.get_piece_size()) if not (v.is_control(i) or v.is_unknown(i) or v.is_byte(i) or v.is_unused(i))]


class Counter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.unknown = min(scores.values()) - UNKNOWN
        self.forget()

    def forget(self) -> None:
        # Of node i: best[i] and tokens[i]; child[i << 21 | letter] is the node after another letter.
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.known: dict[str, int] = {"": 0}
        self.bytes = 0

    def _scored(self, text: str, end: int, best: list[float], tokens: list[int], first: int) -> tuple[float, int]:
        """Forward score and tokens of text[:end]; best and tokens: those of the prefixes from text[:first] on."""
        scores = self.scores
        top, count = best[end - 1 - first] + self.unknown, tokens[end - 1 - first] + len(text[end - 1].encode("utf-8", "surrogatepass"))
        for start in range(max(0, end - self.longest), end):
            piece = text[start:end]
            if piece in scores:
                s = best[start - first] + scores[piece]
                if s > top or (s == top and tokens[start - first] + 1 < count):
                    top, count = s, tokens[start - first] + 1
        return top, count

    def _alone(self, text: str) -> int:
        """Tokens of a long text, of which only the last prefixes' scores are held."""
        best, tokens, first, keep = [0.0], [0], 0, 64 * self.longest
        for end in range(1, len(text) + 1):
            top, count = self._scored(text, end, best, tokens, first)
            best.append(top)
            tokens.append(count)
            if len(best) > 2 * keep:
                del best[:-keep], tokens[:-keep]
                first = end + 1 - keep
        return tokens[-1]

    def walk(self, words: list[str]) -> None:
        """Terminal counts of sorted distinct words: each is walked from where it leaves the one before, and each prefix is scored once."""
        child, best, tokens, known, scored = self.child, self.best, self.tokens, self.known, self._scored
        path, own, counts, last = [0], [0.0], [0], ""  # nodes, scores and tokens of the prefixes of the last word
        for word in words:
            text = START + word
            if len(word) > LONG_WORD:
                known[word] = self._alone(text)
                self.bytes += WORD_BYTES + 2 * len(word)
                continue
            shared, most = 0, min(len(last), len(text))
            while shared < most and last[shared] == text[shared]:
                shared += 1
            del path[shared + 1 :], own[shared + 1 :], counts[shared + 1 :]
            node, made = path[-1], len(best)
            for end in range(shared + 1, len(text) + 1):
                key = node << 21 | ord(text[end - 1])
                node = child.get(key, 0)
                if not node:
                    score, count = scored(text, end, own, counts, 0)
                    node = child[key] = len(best)
                    best.append(score)
                    tokens.append(count)
                path.append(node)
                own.append(best[node])
                counts.append(tokens[node])
            known[word] = counts[-1]
            last = text
            self.bytes += NODE_BYTES * (len(best) - made) + WORD_BYTES + 2 * len(word)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and of tokens of each text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.bytes > MEMO_BYTES:
            self.forget()
        self.walk(sorted(w for w in words if w not in self.known))
        of = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        word = np.array([w != "" for w in words], np.int64)[coded.indices.to_numpy()]
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        sums = [np.concatenate([[0], np.cumsum(x)])[at] for x in (word, of)]
        return sums[0][1:] - sums[0][:-1], sums[1][1:] - sums[1][:-1]


@functools.lru_cache(maxsize=1)
def counter(path: str, shift: float) -> Counter:
    """One in each worker process."""
    return Counter(zipf_scores(read_pieces(path), shift))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, shift: float = 2.7, doc_id: str = "doc_id", text: str = "text", scores: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row. scores: logarithms of the probabilities of pieces, instead of a vocabulary file's ranks."""
    path = None if scores else vocabulary or default_vocabulary()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter(scores) if scores else counter(path, shift)
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                words, tokens = own.count(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(counted, COUNTS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
