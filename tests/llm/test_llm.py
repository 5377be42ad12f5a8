"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, repeats, ties and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, components, licenses, mixing, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, node long, shard string, u double"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, 80) + "." for _ in range(12)]
    texts = list(base)
    for b in base[:8]:
        for edits in (1, 2, 3, 8):
            w = b.split(" ")
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(4)
            texts.append(" ".join(w))
    passage = prose(rng, 60)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    texts += [base[0], base[0].upper(), None, "", " \n\t", "one", "one two", "One two", "a b c", "Du " * 300, "x" * 5000, prose(rng, 9000), base[3] + "\n" + base[3], "é" * 200 + "\U0001f600" * 90]
    texts += ["Released under the MIT License.\n" + base[5], "a | b | c | d | e\n" * 9, "#$% &*| <>\n" + prose(rng, 30)]
    out = [(i, t, "en", rng.choice(["a", "b", "c", None, ""]), 0, 1, 2, "x", 0.5) for i, t in enumerate(texts)]
    return [*out, out[3], out[-1], (None, base[1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return common.materialise(spark.createDataFrame(rows, DOCS), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def known(rows):
    return {r[0]: r[1] for r in rows if r[0] is not None}


def test_words_are_cut_at_ascii_space_alone(spark):
    row = spark.createDataFrame([(" a b\x0bc\x0cd\r\ne\t ",)], "text string").select(common.words(F.col("text")).alias("w")).first()
    assert row.w == ["a b", "c", "d", "e"]


def test_join_groups_keeps_every_row_of_a_hot_key(spark):
    left = spark.range(3000).select((F.when(F.col("id") < 1500, 7).otherwise(F.col("id"))).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    joined = common.join_groups(left, groups, ["k"], "n", 3000, F.col("id"))
    assert joined.count() == 3000 and joined.where("k = 7 AND low = 0 AND n = 1500").count() == 1500


# 1 ------------------------------------------------------------------------------------------------------------------


def test_lookup_table_is_fair_and_stable():
    shards = [f"s{i}" for i in range(13)]
    table = sharding.lookup_table(shards, 1009)
    counts = np.bincount(table, minlength=13)
    assert counts.sum() == 1009 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(1 for a, b in zip(table, fewer, strict=True) if a != b and a != 12)
    assert moved < 1009 * 0.25
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)


def test_lookup_table_follows_turns_and_preferences():
    names, slots = ["a", "b", "c"], 7
    number = lambda s, salt: int.from_bytes(hashlib.sha256(f"{salt}:{s}".encode()).digest()[:8], "big")
    order = {s: [(number(s, "offset") + k * (number(s, "skip") % 6 + 1)) % 7 for k in range(7)] for s in names}
    owner = {}
    while len(owner) < slots:
        for i, s in enumerate(names):
            free = [x for x in order[s] if x not in owner]
            if free:
                owner[free[0]] = i
    assert sharding.lookup_table(names, slots) == [owner[i] for i in range(7)]


def test_placement(spark, docs, none, tmp_path):
    placed = sharding.place(docs, F.col("doc_id"), ["p", "q", "r"], 101, "at", "owner")
    got = placed.select("doc_id", "at", "owner", "shard").collect()
    assert len(got) == docs.count() and {r.owner for r in got} <= {"p", "q", "r"}
    table = sharding.lookup_table(["p", "q", "r"], 101)
    assert all(r.owner == "pqr"[table[r["at"]]] for r in got)
    assert len({(r.doc_id, r.owner) for r in got}) == len({r.doc_id for r in got})
    sharding.write_shards(placed, str(tmp_path / "s"), 2, "owner", "at")
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(got)
    assert sharding.place(none, F.col("doc_id")).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


def brute_groups(texts, k, num, den):
    sets = {i: near_dedup.shingle_set(near_dedup.split_words(t), k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, num):
    got = near_dedup.near_duplicates(docs, k, num).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_groups(known(rows), k, num, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_deduplicate_keeps_one_of_each_group(docs, rows):
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    roots = {c for _, c in brute_groups(known(rows), 5, 80, 100).values()}
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(roots)
    assert kept.where("doc_id IS NULL").count() == 2


def test_near_duplicates_of_nothing(none):
    assert near_dedup.near_duplicates(none).count() == 0


def test_links_within_a_large_group_of_copies(spark):
    """Copies too far from the first one, but near each other, are found without a pair for each two copies."""
    rng = random.Random(2)
    base = prose(rng, 120).split(" ")
    far = list(base)
    for i in range(0, 120, 12):
        far[i] = "changed%d" % i
    texts = {}
    for i in range(60):
        w = list(base if i < 40 else far)
        w[rng.randrange(120)] = "own%d" % i
        texts[i] = " ".join(w)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame, 3, 85).collect()}
    assert got == brute_groups(texts, 3, 85, 100)


def test_pairs_over_components_loses_no_link(spark):
    rng = random.Random(8)
    base = prose(rng, 60).split(" ")
    texts = {}
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = rng.choice(["p", "q", "r"])
        texts[i] = " ".join(w[: rng.randint(52, 60)])
    sets = {i: near_dedup.shingle_set(near_dedup.split_words(t), 3) for i, t in texts.items()}
    frame = spark.createDataFrame([(i, t, len(sets[i])) for i, t in texts.items()], "node long, text string, n_shingles long")
    alone = spark.createDataFrame([(i, i) for i in texts], "node long, component long")
    got = {(r.a, r.b) for r in near_dedup.pairs_over_components(frame, alone, 3, 85, 100).collect()}
    links = {(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert links and links <= got


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(0, i) for i in range(200, 260)] + [(i, i + 1) for i in range(300, 330)] + [(None, 4), (5, None), (6, 6)]
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = sorted((root[a], root[b]))
            root = {n: x if r == y else r for n, r in root.items()}
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == root
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------


def brute_cut(texts, length):
    """n_bytes, n_removed, n_spans, digest; None is the largest id."""
    seen, out = set(), {}
    for i in sorted(texts, key=lambda x: (x is None, x)):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("split", [1024, 1])
def test_suffix_dedup(docs, rows, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    own = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    got = suffix_dedup.cut(own, suffix_dedup.repeated_spans(own)).collect()
    expected = brute_cut(known(rows), 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected
    assert len(got) == own.count() and sum(e[1] for e in expected.values()) > 5000


def test_suffix_dedup_null_id_is_the_last_document(spark):
    text = prose(random.Random(1), 40)
    frame = spark.createDataFrame([(None, text), (9, text)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.cut(frame, suffix_dedup.repeated_spans(frame)).collect()}
    assert got == {9: 0, None: len(text.encode())}


def test_suffix_dedup_texts(docs, none):
    kept = suffix_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert kept.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert suffix_dedup.deduplicate(none).count() == 0
    assert suffix_dedup.repeated_spans(none.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize(("ids", "split"), [((1, 2), 1024), ((1, 2), 1), ((3, 2**63 - 1), 1024), ((-(2**63), 2**63 - 1), 1024)])
def test_suffix_dedup_texts_without_ids_are_documents_of_their_own(spark, ids, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    rng = random.Random(2)
    one, two, three = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    texts = [prose(rng, 30) + one + prose(rng, 30), one + prose(rng, 90), one + prose(rng, 70), prose(rng, 20) + two + prose(rng, 50), prose(rng, 50) + one[3:] + two]
    rows = [(None, t) for t in [*texts, texts[0], None, ""]] + [(ids[0], prose(rng, 20) + three), (ids[1], three + two[5:] + prose(rng, 9))]
    frame = common.materialise(spark.createDataFrame(rows, "doc_id long, text string"), "texts")
    order = {r.text: r.h for r in frame.select("text", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).alias("h")).collect()}
    expected = brute_cut({(i is None, order[t] if i is None else i): t for i, t in rows}, 100)
    wanted = sorted(expected[i is None, order[t] if i is None else i] for i, t in rows)
    got = suffix_dedup.cut(frame, suffix_dedup.repeated_spans(frame)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == wanted
    kept = suffix_dedup.deduplicate(frame).where("text IS NOT NULL").collect()
    # a cut may leave part of a character, which text goes without
    assert all(0 <= x - y < 20 for x, y in zip(sorted(e[0] - e[1] for e, r in zip([expected[i is None, order[t] if i is None else i] for i, t in rows], rows) if r[1] is not None), sorted(len(r.text.encode()) for r in kept), strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_finds_all_repeats(seed):
    rng = random.Random(seed)
    for _ in range(30):
        length = rng.choice([2, 3, 5, 8, 20])
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(4)]
        texts = []
        for _ in range(rng.randint(1, 12)):
            t = bytearray(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(b"abc")
            texts.append(bytes(t))
        seen, expected, at = set(), [], 0
        for t in texts:
            for i in range(len(t) - length + 1):
                if t[i : i + length] in seen:
                    expected.append(at + i)
                seen.add(t[i : i + length])
            at += len(t) + 1
        assert suffix_dedup.repeats(texts, length).tolist() == expected


# 4 ------------------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    use = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in use:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = set()
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in use if i != q and len(c) == len(v))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", block)
    monkeypatch.setattr(topk, "FEW", 6)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(330, 16)).astype(np.float32)
    v[100:130] = v[0]
    v[200] = 90
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(400, None), (450, [1.0, None] * 8), (500, [float("nan")] * 16), (550, [float("inf")] * 16), (None, [0.5] * 16), (600, [0.25] * 3), (601, [0.5] * 3), (650, []), (7, v[7].tolist()), (50, v[3].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "rank": F.lit(1)})
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0)
    expected = brute_top(rows, 5)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found) | expected) or sorted(set(found)) == sorted(expected)
    assert set(found) == expected
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(420, 8)).astype(np.float32))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()} == brute_top(rows, 5)


# 5 ------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    long = "<p>é\r\n\r\nWARC/1.1\r\n" + "y" * 400
    pages = [(5, "http://a/ b\n", long), (3, "http://b", long), (3, "http://b", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", long), (7, "é", "z" * 90_000)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, name string")
    got = warc.round_trip(frame, str(tmp_path / "w")).collect()
    first = 3
    expected = []
    for i, _, html in pages:
        b = (html or "").encode()
        again = html == long and i is not None and i > first
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, (tuple(r)[:5] for r in got))) == sorted(map(key, expected))
    index = spark.read.option("sep", "\t").csv(str(tmp_path / "w" / "records" / "*.index"))
    assert index.count() == len(pages)
    raw = spark.read.format("binaryFile").load(str(tmp_path / "w" / "raw")).collect()
    assert len(raw) > 1
    for r in raw:
        d = zlib.decompressobj(31)
        d.decompress(bytes(r.content))
        assert d.eof and not d.unused_data  # one stream a file
    assert warc.round_trip(frame.where("false")).count() == 0


def test_warc_payload_comes_back(spark):
    frame = spark.createDataFrame([(1, "u", "<p>é\r\n\r\n"), (2, "u", None)], "page_id long, url string, html string")
    planned = warc.plan_records(frame)
    folder = common.new_path(spark, "warc-test")
    index = warc.normalise(spark, f"{folder}/raw", warc.write(planned, f"{folder}/raw"), f"{folder}/records")
    assert {r.page_id: r.payload for r in warc.read(spark, f"{folder}/records", index, keep_payload=True).collect()} == {1: "<p>é\r\n\r\n", 2: ""}


# 6 ------------------------------------------------------------------------------------------------------------------


def brute_tokens(word, scores):
    text, longest = token_counts.START + word, max(map(len, scores))
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[-1][0] + min(scores.values()) - token_counts.UNKNOWN, -(best[-1][1] + len(text[end - 1].encode())))]
        options += [(best[s][0] + scores[text[s:end]], -(best[s][1] + 1)) for s in range(max(0, end - longest), end) if text[s:end] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(docs, rows, none):
    pieces = token_counts.read_pieces(token_counts.default_vocabulary())
    scores = token_counts.zipf_scores(pieces)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs).where("doc_id IS NOT NULL").collect()}
    memo = {}
    for i, t in known(rows).items():
        words = [w.decode() for w in (t or "").encode().split()]
        for w in words:
            if len(w) < 100 and w not in memo:
                memo[w] = brute_tokens(w, scores)
        if all(w in memo for w in words):
            assert got[i] == (len(words), sum(memo[w] for w in words)), i
    assert token_counts.count_tokens(none).count() == 0


def test_token_counts_agree_with_a_unigram_model():
    from tokenizers import Tokenizer, models

    scores = token_counts.zipf_scores(token_counts.read_pieces(token_counts.default_vocabulary()))
    model = Tokenizer(models.Unigram([("<unk>", min(scores.values()) - 10), *scores.items()], unk_id=0))
    own = token_counts.Counter(scores)
    words = sorted({w for w in prose(random.Random(3), 400).split()})
    own.walk(words)
    assert all(own.known[w] == len(model.encode(token_counts.START + w).ids) for w in words)


# 7 ------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    ranked = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(ranked)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in ranked if s not in capped)
        goal = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / open_ for s in ranked}
        above = {s for s in ranked if goal[s] > 2 * sizes[s]} - capped
        if not above:
            return goal
        capped |= above


def test_mixing(docs, rows, none):
    got = mixing.plan(docs, keep_text=False).select("doc_id", "source", "_mix.*").collect()
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    goal = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.copies <= 2 and int(r.rate) <= r.copies <= int(r.rate) + 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert sorted(str(r) for r in mixed.collect()) == sorted(str(r) for r in mixing.mix(docs).collect())
    assert mixing.mix(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod(F.col("id"), F.lit(4))).alias("source"), F.repeat(F.lit("a "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    for r in mixing.plan(frame).groupBy("source").agg(F.sum(F.col("_mix.size") * F.col("_mix.copies")).alias("taken"), F.first("_mix.target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.05)


def test_mixing_without_any_words(spark):
    frame = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r["_mix"].target, r["_mix"].copies) for r in mixing.plan(frame).collect()] == [(0.0, 0)] * 2


# 8 ------------------------------------------------------------------------------------------------------------------


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs).collect()
    expected = []
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(r[0], p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, expected))
    check_sequences(got, 2048)
    assert packing.pack(none).count() == 0


def check_sequences(got, size):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 300))]
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(size - n)
    histogram = {n: lengths.count(n) for n in lengths}
    places = []
    for n, first, count, each, sequence, place in packing.plan(histogram, size):
        assert first == sum(1 for p in places if p[2] == n)
        places += [(sequence + i // each, place + i % each * n, n) for i in range(count)]
    assert sorted(p[2] for p in places) == sorted(lengths)
    by = {}
    for s, at, n in places:
        by.setdefault(s, []).append((at, n))
    for own in by.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= size
    assert len(by) == len(rooms) == max(by) + 1


def test_pieces_with_ids(docs):
    for r in packing.pieces(docs, packing.default_tokenizer(), 64, with_ids=True).limit(50).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_encoder_agrees_with_the_tokenizer_on_odd_texts():
    own = packing.Encoder(packing.default_tokenizer())
    rng = random.Random(1)
    letters = "aZéÀß'sS12 .,!—…İǅЖЙйк日あ가$<|>\n\t\x00\x1c\x7fʰ²½ªΣς’ŉẞ́​"
    texts = ["Ça va? İstanbul'S 12 don't <|endoftext|> x", "ΑΣ ΟΔΟΣ", "", None, "  \n\t ", "'s't're ll'LL $$$12", "x" * 3000, "naïve—dash … “q” €5"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids, t


# 9 ------------------------------------------------------------------------------------------------------------------


def brute_base(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for own in windows.values() if len(own) > 1 for i in own for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(docs, rows, none):
    got = quality.measure(docs).select("doc_id", "text", "quality.*").collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute_base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r.base_failed and r.kept)
    assert quality.measure(none).count() == 0


def test_line_rules(spark):
    sentence = "These are some plain words that end a line, as prose has it."
    bad = ["a | b | c | d", "win!! big!! now!! today!!", "## $$ buy", "All rights reserved.", "again " * 12, "one two three four five six seven eight nine ten eleven"]
    good = [sentence, "Contents", "He said 50 % of it | was lost.", "Wow!! That is a lot of text for one shout."]
    got = spark.createDataFrame([(t,) for t in bad + good], "text string").select(quality.line_fails(F.col("text")).alias("x")).collect()
    assert [r.x for r in got] == [True] * len(bad) + [False] * len(good)
    prose_lines = [f"{a} {sentence} And {b}." for a, b in (("First,", "so on"), ("Then, later,", "the like of it"), ("At last,", "that was all"))]
    frame = spark.createDataFrame([(1, "\n".join([prose(random.Random(4), 30) + ".", *prose_lines[:1], *bad[:1]]), 3), (2, "\n".join([prose(random.Random(5), 30) + ".", *bad, *bad[3:]]), 3), (3, None, 3)], "doc_id long, text string, n_chars long")
    kept = quality.filter_documents(frame).collect()
    assert [r.doc_id for r in kept] == [1] and "|" not in kept[0].text and kept[0].n_chars == len(kept[0].text)


# 10 -----------------------------------------------------------------------------------------------------------------


def test_license_rules(spark, docs, none):
    texts = {
        1: "Foo. Released under the MIT License! Bar",
        2: licenses.SENTENCES["MIT-GRANT"] + ":\n\n" + licenses.SENTENCES["MIT-NOTICE"].upper() + ".\nsomething else\n" + licenses.SENTENCES["MIT-AS-IS"],
        3: licenses.SENTENCES["MIT-NOTICE"] + "\n" + licenses.SENTENCES["MIT-GRANT"],
        4: "Licensed under the Apache License, Version 2.0.\nAll rights reserved.",
        5: "We talk about the MIT License and the like.",
        6: None,
    }
    got = {r.doc_id: r["license"] for r in licenses.scan_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1].licenses, got[1].n_sentences, got[1].n_known) == ("MIT", 3, 1)
    assert got[2].rules == "mit-full;mit-grant" and got[2].licenses == "MIT"
    assert got[3].rules == "mit-grant" and got[3].sequence == "MIT-NOTICE MIT-GRANT"
    assert got[4].licenses == "Apache-2.0;Proprietary"
    assert (got[5].licenses, got[5].n_known) == ("", 0) and (got[6].n_sentences, got[6].licenses) == (0, "")
    assert licenses.scan_documents(docs).count() == docs.count() and licenses.scan_documents(none).count() == 0


_MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
_GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
_HOPE = """This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
_BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""


def test_wrapped_licenses(spark):
    commented = lambda mark, text: "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())
    texts = {
        1: (_MIT, "MIT-TITLE-2 MIT-GRANT MIT-NOTICE MIT-AS-IS", "mit-full;mit-grant;mit-title-2", "MIT"),
        2: ("/*\n" + commented(" *", _MIT) + " */", "MIT-TITLE-2 MIT-GRANT MIT-NOTICE MIT-AS-IS", "mit-full;mit-grant;mit-title-2", "MIT"),
        3: (_APACHE, "APACHE-LONG APACHE-USE APACHE-COPY", "apache-header;apache-long", "Apache-2.0"),
        4: (_APACHE.replace("\n", " ", 2), "APACHE-LONG APACHE-USE APACHE-COPY", "apache-header;apache-long", "Apache-2.0"),
        5: (commented("#", _GPL + "\n" + _HOPE), "GPL-FREE GPL-HOPE", "gpl3-header", "GPL-3.0"),
        6: (_GPL, "GPL-FREE", "gpl3-free", "GPL-3.0"),
        7: (_BSD, "RESERVED BSD-USE", "bsd-full;bsd-use;reserved", "BSD;Proprietary"),
        8: ("Released under the\n\nMIT License and more.\nReleased under. The MIT License here", "", "", ""),
        9: ("It is released under the\n- MIT License\n", "MIT-TITLE-2", "mit-title-2", "MIT"),
    }
    rows = spark.createDataFrame([(i, t[0]) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r["license"].sequence, r["license"].rules, r["license"].licenses) for r in licenses.scan_documents(rows).collect()}
    assert got == {i: t[1:] for i, t in texts.items()}


def test_suffix_dedup_of_an_anchor_with_thousands_of_texts(spark):
    """One passage within differing texts: its group is dealt over many indexes, and windows that go beyond it still meet."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz "
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, short = piece(97), piece(40)
    ends = [piece(3) for _ in range(30)]
    texts = {}
    for i in range(5800):
        before, after = piece(60), piece(60)
        if i % 5 == 0:
            after = ends[i % 30] + after
        if i % 7 == 0:
            before = before + ends[i % 30]
        texts[i] = before + (short if i % 13 == 0 else passage) + after
    frame = common.materialise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "hot")
    found = suffix_dedup.reduce_units(suffix_dedup.find_units(frame)).where("NOT repeat").groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert found > 5000
    got = suffix_dedup.cut(frame, suffix_dedup.repeated_spans(frame)).collect()
    expected = brute_cut(texts, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected
    assert sum(e[1] > 0 for e in expected.values()) > 1000


def test_suffix_dedup_with_columns_of_its_own_names(spark):
    text = prose(random.Random(1), 40)
    frame = spark.createDataFrame([(1, text, 5, "a", 7), (2, text, 6, "b", 8)], "doc_id long, text string, doc int, spans string, row int")
    kept = {r.doc_id: r for r in suffix_dedup.deduplicate(frame).collect()}
    assert kept[1].text == text and kept[2].text == "" and (kept[2].doc, kept[2].spans, kept[2].row) == (6, "b", 8)


def test_top_k_of_large_components(spark):
    rows = [(0, [3e7, 1.0]), (1, [1e300, -5.0]), (2, [2.5, 7.25]), (50, [-1e12, 3.0]), (51, [0.0, 0.0]), (100, [1.5, -2.5]), (52, [1.7e308, 1.0]), (53, [1e6, 1e6])]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()}
    most = (1 << 63) - 1
    whole = lambda x: int(np.floor(256 * x)) if abs(256 * x) < 1.7e308 else int(1.7e308) * (1 if x > 0 else -1)
    vectors = {i: [whole(x) for x in v] for i, v in rows}
    expected = set()
    for q in (0, 50, 100):
        scored = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(vectors[q], v, strict=True)))), i) for i, v in vectors.items() if i != q)[:5]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    assert got == expected


@pytest.mark.parametrize("seed", range(8))
def test_possible_members_hold_the_best(seed, monkeypatch):
    monkeypatch.setattr(topk, "FEW", 4)
    rng = np.random.default_rng(seed)
    n, d, k = int(rng.integers(1, 200)), int(rng.integers(0, 20)), 5
    vectors = np.floor(rng.normal(size=(n, d)) * rng.choice([0, 1, 40, 900]))
    if n > 20:
        vectors[:15] = vectors[15]
    index = topk.Index(vectors)
    for _ in range(20):
        query = np.floor(rng.normal(size=d) * rng.choice([0, 3, 500]))
        own = np.flatnonzero(rng.random(n) < 0.05)
        scores = vectors @ query
        wanted = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i not in own)[:k]
        members = set(topk.search(index, query, own, k).tolist())
        assert {i for _, i in wanted} <= members and not members & set(own.tolist())


def test_most_queries_stop_on_proof():
    """Near neighbours stand out: what is left for exact scoring is few, and part of the postings is never taken."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 32))
    vectors = np.floor(256 * (np.repeat(centres, 12, axis=0) + 0.1 * rng.normal(size=(2400, 32))))
    index = topk.Index(vectors)
    sizes = [len(topk.search(index, vectors[i], np.array([i]), 5)) for i in range(0, 2400, 50)]
    assert np.mean(np.array(sizes) <= topk.FEW) > 0.9


def test_warc_reads_what_finished_tasks_have_listed(spark, tmp_path, monkeypatch):
    """Leftovers of a repeated task, whole or cut short, do no harm; the sidecars lead to every record."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = [(i, f"http://h/{i}", "<p>" + "x" * (50 + i % 7 * 40)) for i in range(60)]
    planned = warc.plan_records(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3))
    raw, to = str(tmp_path / "raw"), str(tmp_path / "records")
    first = warc.write(planned, raw)
    again = warc.write(planned, raw)
    names = [{r.name for r in x.collect()} for x in (first, again)]
    assert len(names[0]) > 3 and not names[0] & names[1]
    for name in names[0]:
        (tmp_path / "raw" / name).write_bytes(b"\x1f\x8b cut short")
    warc.normalise(spark, raw, again, to)
    files = warc.normalise(spark, raw, again, to)
    got = warc.read(spark, to, files, keep_payload=True).collect()
    assert sorted(r.page_id for r in got) == list(range(60))
    assert all(r.payload == pages[r.page_id][2] for r in got if r.record_type == "response")
    index = warc.index(spark, to, files).collect()
    assert len(index) == 60 and {r.record_id for r in index} == {f"{warc.ID}{i}" for i in range(60)}
    assert len(list((tmp_path / "records").glob("*.index"))) == 2 * files.count()
    r = index[0]
    whole = zlib.decompress((tmp_path / "records" / r.name).read_bytes()[r.start : r.start + r.length], 31)
    assert whole.startswith(b"WARC/1.1") and r.record_id.encode() in whole


def test_an_id_with_two_texts_is_linked_by_either(spark):
    rng = random.Random(6)
    one, two = prose(rng, 90), prose(rng, 90)
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, two), (5, prose(rng, 90))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]


def test_pairs_of_a_frequent_shingle_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    test_pairs_over_components_loses_no_link(spark)


def test_each_prefix_is_scored_once_over_slices():
    own = token_counts.Counter(token_counts.zipf_scores(token_counts.read_pieces(token_counts.default_vocabulary())))
    calls = []
    plain = own._scored
    own._scored = lambda text, end, *rest: (calls.append(text[:end]), plain(text, end, *rest))[1]
    import pyarrow as pa

    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(12)]
    for at in range(0, 12, 3):
        own.count(pa.array(texts[at : at + 3]))
    words = {w for t in texts for w in t.split()}
    prefixes = {(token_counts.START + w)[:n] for w in words for n in range(1, len(w) + 2)}
    assert len(calls) == len(set(calls)) and set(calls) == prefixes


def test_long_words_and_dropped_tries_count_alike(monkeypatch):
    import pyarrow as pa

    scores = token_counts.zipf_scores(token_counts.read_pieces(token_counts.default_vocabulary()))
    rng = random.Random(10)
    texts = [prose(rng, 30) + " " + "".join(rng.choice("abcdeé😀") for _ in range(n)) for n in (5, 199, 200, 201, 3000)]
    plain = [tuple(x.tolist()) for x in token_counts.Counter(scores).count(pa.array(texts))]
    monkeypatch.setattr(token_counts, "LONG_WORD", 1)
    assert [tuple(x.tolist()) for x in token_counts.Counter(scores).count(pa.array(texts))] == plain
    monkeypatch.setattr(token_counts, "LONG_WORD", 10**9)
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 0)
    own = token_counts.Counter(scores)
    assert [[own.count(pa.array([t]))[i][0] for t in texts] for i in (0, 1)] == [list(x) for x in plain]


def test_token_counts_with_given_scores(spark):
    frame = spark.createDataFrame([(1, "ab ab"), (2, "abc")], "doc_id long, text string")
    scores = {"▁": -3.0, "a": -3.0, "b": -3.0, "▁ab": -1.0, "c": -2.0}
    assert sorted(map(tuple, token_counts.count_tokens(frame, scores=scores).collect())) == [(1, 2, 2), (2, 1, 2)]


def test_intermediates_are_deleted(spark, docs):
    from pathlib import Path

    with common.intermediates(spark):
        path = common.materialise_at(docs.limit(3), "some")
        assert Path(path.removeprefix("file:")).exists()
    assert not Path(path.removeprefix("file:")).exists()


def test_quality_filter_judges_as_measured(docs):
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    good = sorted(str(r.doc_id) for r in quality.measure(docs).where("quality.kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == good
    odd = docs.withColumns({"row": F.lit(1), "col": F.lit("x")})
    assert quality.filter_documents(odd).columns == odd.columns and quality.filter_documents(odd.where("false")).count() == 0


def test_notices_in_four_languages_and_marks_of_scripts(spark):
    bad = ["Alle Rechte vorbehalten.", "Datenschutzerklärung", "» Zum Inhalt springen", "Tous droits réservés !", "Conditions d'utilisation", "Conditions générales d’utilisation", "Política de privacidad", "[Volver arriba]", "Aceptar todas las cookies"]
    good = ["Alle Rechte haben Grenzen.", "La politique de la ville est claire.", "यह एक लंबी पंक्ति है जिसमें दस से अधिक शब्द हैं ।", "هذا سطر طويل فيه أكثر من عشر كلمات أليس كذلك يا صديقي؟"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(bad + good)], "i int, text string")
    assert [r.x for r in frame.select("i", quality.line_fails(F.col("text")).alias("x")).orderBy("i").collect()] == [True] * len(bad) + [False] * len(good)
