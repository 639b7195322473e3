"""The pipeline against a plain reading of its stages."""

import glob
import os
import shutil
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from conftest import SMALL

import public_tokenizers


def test_each_stage_against_a_plain_version(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from certveil.llm import language_id, sql, toxicity
    from test_operators import brute_components

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    def stage(k, kept):
        out = C.STAGES[k][1](spark, kept, SMALL)
        assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/plain-{k}"
        out.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    net = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    clean = stage(0, docs)
    scores = dict(zip(rows, net.scores(list(rows.values())), strict=True))
    want = {i for i in rows if scores[i] < 0.5}
    assert {r.doc_id for r in clean.collect()} == want

    model = language_id.fit(clean.where(~language_id.held_out()))
    known = stage(1, clean)
    want = {i for i in want if not model.classify(rows[i])[3]}
    assert {r.doc_id for r in known.collect()} == want

    single = stage(2, known)
    groups = brute_components([(i, rows[i]) for i in sorted(want)])
    want = {i for i in want if groups[i] == i}
    assert {r.doc_id for r in single.collect()} == want

    safe = stage(3, single)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": sorted(want), "text": [rows[i] for i in sorted(want)]}))
    con.execute(f"create view benchmark as select * from '{SMALL}/benchmark.parquet'")
    found = {r[0] for r in con.execute(sql.DECONTAMINATION).fetchall()}
    assert found
    want -= found
    assert {r.doc_id for r in safe.collect()} == want

    packed = C.STAGES[4][1](spark, safe, SMALL).collect()
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = {i: np.array(t.encode(rows[i] or "", add_special_tokens=False).ids + [1], "<u4") for i in want}
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted((i, k, 4096 * k, len(x[4096 * k : 4096 * (k + 1)]), zlib.crc32(x[4096 * k : 4096 * (k + 1)].tobytes())) for i, x in ids.items() for k in range(-(-len(x) // 4096)))
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert all(o == sum(n for q, n in p if q < o) for o, _ in p) and sum(n for _, n in p) <= 4096
    assert len(places) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_run_leaves_only_its_stages(spark):
    import corpus_pipeline as C

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    from certveil.llm.shared import release

    release(spark)
    before = set(os.listdir(folder))
    packed = C.run(spark, SMALL).collect()
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert not [i for i in {r.doc_id for r in packed} if any(x in (rows[i] or "") for x in items)]
    assert len({r.doc_id for r in packed}) > 0.6 * len({*rows.values()})
    left = {n for n in set(os.listdir(folder)) - before if not n.startswith("pipeline-")}
    assert not left and glob.glob(f"{folder}/pipeline-packing-*")


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline as C

    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (None, "x y", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    for docs in (odd, odd.where("false")):
        for _, stage in C.STAGES:
            stage(spark, docs, str(tmp_path)).collect()
