"""The corpus pipeline over planted cases, each stage held against brute force on its own input."""

import random

import pytest
from cases import DOCUMENTS, LABELS, documents, odd_rows, sentence
from test_decontaminate import brute as windows
from test_packing import check_round_trip
from test_simhash_dedup import brute as components
from test_substring_dedup import passage_rows
from test_toxicity import fixture

pipeline = pytest.importorskip("corpus_pipeline")

ORDER = ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "packing"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    tainted, labels = fixture(300)
    rows = [(d, t) for d, t in tainted]
    passages, _ = passage_rows(rng)
    rows += [(10_000 + d, t) for d, t in passages]
    items = [(i, sentence(rng, 25)) for i in range(6)]
    rows += [(20_000 + i, f"{sentence(rng, 40)} {items[i % 6][1]} {sentence(rng, 40)}") for i in range(12)]
    for i in range(10):
        text = sentence(rng, 150)
        rows += [(30_000 + i, text), (31_000 + i, text), (32_000 + i, text.replace(" ", "  ", 3))]
    rows += [(None if d is None else 40_000 + d, t) for d, t in odd_rows(rng)]
    documents(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows that each stage reads, and what the last one gives; every stage written as Parquet and read again."""
    out = str(tmp_path_factory.mktemp("stages"))
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        seen[name] = docs
        made = stage(spark, docs, folder)
        made.write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        if name != "packing":
            assert made.columns == DOCUMENTS.names
    return seen | {"end": docs}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ORDER and pipeline.ORACLE_SQL is None


def test_toxic_documents_go(stages, folder, spark):
    before, after = pairs(stages["toxicity"]), pairs(stages["simhash_near_dedup"])
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    gone = {d for d, _ in before} - {d for d, _ in after}
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) < 0.02 * len(before)


def test_one_of_each_group_of_copies_stays(stages):
    before, after = pairs(stages["simhash_near_dedup"]), pairs(stages["substring_dedup"])
    short = [(d, t) for d, t in before if len(t or "") < 100_000 and d is not None]
    best = {c for _, _, c in components(short)}
    assert {d for d, t in after if len(t or "") < 100_000 and d is not None} == best
    assert len([t for d, t in after if d is None]) <= 3
    assert not {d for d, _ in after if d is not None and 31_000 <= d < 33_000}


def test_repeated_passages_go(stages):
    after = dict(pairs(stages["decontamination"]))
    _, gone = passage_rows(random.Random(11))
    for d, text in pairs(stages["substring_dedup"]):
        if d is None or d >= 20_000 or d < 10_000:
            continue
        lost = len(text.split()) - len(after[d].split())
        assert lost == 0 if d - 10_000 not in gone else abs(lost - len(gone[d - 10_000])) <= 4


def test_benchmark_passages_go(stages, folder, spark):
    items = pairs(spark.read.parquet(f"{folder}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    before, after = pairs(stages["decontamination"]), pairs(stages["packing"])
    assert any(r[-1] for r in windows(before, items)) and not any(r[-1] for r in windows(after, items))
    clean = {r[0] for r in windows(before, items) if not r[-1]}
    assert sorted((x for x in before if x[0] in clean), key=repr) == sorted((x for x in after if x[0] in clean), key=repr)


def test_packing_holds_what_is_left(stages, spark, folder):
    from tokenizers import Tokenizer

    from lexispark.llm import packing

    out = packing.pack(stages["packing"], with_ids=True)
    check_round_trip(out.collect(), pairs(stages["packing"]), Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json")))
    assert sorted(map(tuple, out.drop("ids").collect()), key=repr) == sorted(map(tuple, stages["end"].collect()), key=repr)


def test_run_is_all_stages(stages, spark, folder):
    assert sorted(map(tuple, pipeline.run(spark, folder).collect()), key=repr) == sorted(map(tuple, stages["end"].collect()), key=repr)


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
