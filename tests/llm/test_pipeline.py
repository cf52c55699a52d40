"""The pipeline, stage by stage, against the operators' brute-force versions."""

import numpy as np
import pytest
from test_decontamination import brute as brute_contamination
from test_near_duplicates import brute as brute_components

import corpus_pipeline as p
from keyfold.llm import quality as q
from keyfold.llm.frames import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for name, stage in p.STAGES:
        found.append(materialize(stage(spark, found[-1], sf_dir), name))
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality(spark, sf_dir, kept):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = q.scored(kept[0], labels)
    assert {r.doc_id for r in scores.where("not rejected").collect()} == set(texts(kept[1])) and kept[1].columns == COLUMNS


def test_near_duplicates(kept):
    before = texts(kept[1])
    assert texts(kept[2]) == {i: before[i] for i, _, _, stays in brute_components(list(before.items()), 5) if stays}
    assert kept[2].columns == COLUMNS


def test_suffix_dedup(kept):
    before, seen, after = texts(kept[2]), set(), {}
    for i in sorted(before):
        raw = before[i].encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        after[i] = bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")
    assert texts(kept[3]) == after and kept[3].columns == COLUMNS
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())


def test_decontamination(spark, sf_dir, kept):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = texts(kept[3])
    assert texts(kept[4]) == {i: before[i] for i, _, _, _, bad in brute_contamination(before.items(), items) if not bad}
    assert kept[4].columns == COLUMNS


def test_packing_and_run(spark, sf_dir, kept):
    pieces = kept[5].toPandas()
    assert set(pieces.doc_id) == set(texts(kept[4]))
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    again = p.run(spark, sf_dir).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert again[key].sort_values(key).values.tolist() == pieces[key].sort_values(key).values.tolist()


def test_hostile_rows(spark, sf_dir, tmp_path):
    good = "A plain line of ordinary words stands here and there, number {}, with more to say about it. "
    rows = [(i, "".join(good.format(i * 100 + k) for k in range(3)), "en", "s", 9) for i in range(12)]
    rows += [(None, None, None, None, None), (None, "no id at all but words", "en", "s", 1), (3, rows[3][1], "en", "s", 9), (4, "same id, another text", "xx", "t", 1), (20, "", "en", "s", 0), (21, "é" * 70_000, "fr", "s", 70_000)]
    docs = spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == [*COLUMNS, "kept"]
    # Columns named as the helpers of the stages.
    clash = ["__key", "__id", "__hash", "__text", "__chars", "__source", "__lang", "__kept", "__Number", "__doc", "__numbered", "aside"]
    odd = spark.createDataFrame([(*r, *(f"{c} {i}" for c in clash)) for i, r in enumerate(rows)], ", ".join(
        ["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in clash)]
    ))
    for distinct in (False, True):
        for name, stage in p.STAGES[:-1]:
            given = odd.where("doc_id between 5 and 12") if distinct else odd
            found = stage(spark, given, sf_dir)
            assert found.columns == given.columns
            told = {tuple(r[c] for c in clash) for r in given.collect()}
            assert found.count() and {tuple(r[c] for c in clash) for r in found.collect()} <= told, name
    left = docs.collect()
    assert sum(r.doc_id == 3 for r in left) == 1 and sum(r.doc_id == 4 for r in left) == 2 and sum(r.doc_id is None for r in left) == 2
    assert p.packing(spark, docs, sf_dir).count() >= len(left)
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_work_on_texts_holds_about_a_mebibyte():
    """What a worker makes of a piece is many times its text, and stays with the worker's process."""
    import pyarrow as pa

    from keyfold.llm.frames import slices

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 600_000, "y" * 600_000, None, "z" * 300_000, "w" * 5_000_000]})
    assert [[t and t[0] for t in part["text"].to_pylist()] for part in slices(batch, "text")] == [["x"], ["y", None, "z"], ["w"]]


def test_whole_texts_go_to_workers_some_megabytes_at_a_time(spark, sf_dir):
    """A batch of 10,000 long texts is held by the JVM and by the worker, which keep the room."""
    import pyarrow as pa

    from keyfold.llm import decontamination, frames, near_duplicates, packing, suffix_dedup

    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    docs = spark.range(0, 4_000, 1, 1).selectExpr("id doc_id", "id", "repeat('some words ', 300) text", "'en' lang", "'s' source", "3300l n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = [
        lambda: q.described(docs), lambda: q.good_documents(docs, labels), lambda: near_duplicates.signatures(docs, 5), lambda: suffix_dedup.packed(docs),
        lambda: suffix_dedup.all_runs(docs, 100, 24), lambda: packing.pieces(docs), lambda: decontamination.positional_index(docs.limit(5), ["some"]),
    ]
    try:
        for stage in stages:
            spark.conf.unset(key)
            stage()
            found = docs.select("text").mapInArrow(size, "n long, bytes long").collect()
            assert sum(r.n for r in found) == 4_000 and max(r.bytes for r in found) < 2 * frames.BATCH_BYTES
        spark.conf.set(key, "123456")  # a bound of the session's own stays
        packing.pieces(docs)
        assert spark.conf.get(key) == "123456"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_tables_of_the_driver_need_no_python_worker(spark, sf_dir, capsys):
    """Rows made of Python objects are read by Python workers of their own, beside those of the operators."""
    from keyfold.llm import decontamination
    from keyfold.llm.frames import local_rows

    docs = spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")
    read = materialize(docs, "docs")
    p.packing(spark, read, sf_dir).explain()
    told = capsys.readouterr().out
    assert "LocalTableScan" in told and "ExistingRDD" not in told
    terms = local_rows(spark, term=decontamination.pa.array(["a", "few"], "string"))
    terms.explain()
    assert "ExistingRDD" not in capsys.readouterr().out and [r.term for r in terms.collect()] == ["a", "few"]
