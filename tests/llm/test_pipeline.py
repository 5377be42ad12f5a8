"""The pipeline's stages in turn, each held against a brute-force version of it."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import common, mixing, near_dedup, quality
from tests.llm.test_llm import brute_cut, brute_groups, check_sequences, prose


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    passage = prose(rng, 70)
    rows = []
    for i in range(60):
        text = prose(rng, 60) + ", " + (passage if i % 6 == 0 else prose(rng, 50)) + " " + prose(rng, 30) + "."
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(100 + i, rows[i][1] if i % 2 else rows[i][1] + " end.", "en", "s1", 0) for i in range(10)]
    rows += [(200, "too short", "en", "s0", 0), (201, None, "en", None, None), (202, "Du " * 90, "de", "s2", 0), (203, "a | b | c | d | e | f\n" * 20, "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")

    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = common.materialise(stage(spark, docs if not out else out[-1], str(tmp_path)), name)
        out.append(made)
    text = [{r.doc_id: r.text for r in x.collect()} for x in out[:3]]
    assert all(x.columns == docs.columns for x in out[:-1])

    good = {r.doc_id for r in quality.measure(docs).where("quality.kept").collect()}
    assert set(text[0]) == good and not good & {200, 201, 202, 203} and set(range(60)) <= good
    assert set(text[1]) == {c for _, c in brute_groups(text[0], 5, 80, 100).values()}
    removed = brute_cut(text[1], 100)
    assert {i: len(text[1][i].encode()) - n[1] for i, n in removed.items()} == {i: len(t.encode()) for i, t in text[2].items()}
    assert sum(n[1] for n in removed.values()) > 0
    copies = {r.doc_id: r["_mix"].copies for r in mixing.plan(out[2]).collect()}
    assert {r.doc_id: r["count"] for r in out[3].groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
    pieces = out[4].collect()
    assert sum(1 for r in pieces if r.piece == 0) == out[3].count()
    used = check_sequences(pieces, 2048)
    assert used <= -(-sum(r.length for r in pieces) // 2048) + 2

    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, str(tmp_path)).collect()) == key(pieces)


_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, spans string, doc long, part int, _keep long"


def _written(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "s", 2, 3, 4) for r in rows], _SCHEMA).write.parquet(str(folder / "documents.parquet"))
    return common.table(spark, str(folder), "documents")


def _stages(spark, docs, folder):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.materialise(stage(spark, out[-1] if out else docs, str(folder)), name))
    return out


def test_stages_of_nothing(spark, tmp_path):
    docs = _written(spark, tmp_path, [])
    out = _stages(spark, docs, tmp_path)
    assert [x.count() for x in out] == [0] * 5 and all(x.columns == docs.columns for x in out[:-1])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_stage_with_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    """Each stage by itself on the same odd rows: none is lost that should stay, columns keep their names and values."""
    rng = random.Random(3)
    text, long = prose(rng, 120) + ".", " ".join(prose(rng, 60) + "." for _ in range(300))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, long, "en", None, 2), (None, prose(rng, 80) + ".", None, None, None), (None, None, None, None, None), (3, None, "en", "a", None), (4, "", "en", "b", 0), (5, text + " end.", "de", "b", 3)]
    docs = _written(spark, tmp_path, rows)
    quality_, near, passages, mixed, packed = (stage(spark, docs, str(tmp_path)) for _, stage in corpus_pipeline.STAGES)
    assert all(x.columns == docs.columns for x in (quality_, near, passages, mixed))
    ids = lambda x: sorted(str(r.doc_id) for r in x.select("doc_id").collect())
    assert ids(quality_) == sorted(["1", "1", "2", "5", "None"])
    assert ids(near) == sorted(["1", "2", "3", "4", "None", "None"])
    assert ids(passages) == sorted(str(r[0]) for r in rows)
    left = {r.doc_id: r.text for r in passages.where("doc_id IS NOT NULL").collect()}
    assert left[1] == text and left[2] == long and left[3] is None and left[4] == "" and left[5] == " end."
    assert all((r.row, r.spans, r.doc, r.part, r["_keep"]) == (1, "s", 2, 3, 4) for x in (quality_, near, passages, mixed) for r in x.collect())
    assert {r.n_chars for r in quality_.where("doc_id = 2").collect()} == {len(long)}
    taken = ids(mixed)
    assert taken.count("1") % 2 == 0 and set(taken) <= {"1", "2", "3", "4", "5", "None"}
    pieces = packed.collect()
    assert sum(1 for r in pieces if r.piece == 0) == len(rows)
    check_sequences(pieces, 2048)


def test_stages_of_null_rows_alone(spark, tmp_path):
    out = _stages(spark, _written(spark, tmp_path, [(None, None, None, None, None)] * 3), tmp_path)
    assert [x.count() for x in out] == [0] * 5
    docs = common.table(spark, str(tmp_path), "documents")
    assert [stage(spark, docs, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES] == [0, 3, 3, 0, 3]
