"""The pipeline: each stage on its own input, small odd tables, and the whole against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from timberline.llm import common, components, jaccard, mixing, secrets
from timberline.llm.common import saved, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in pipeline.STAGES:
        after = saved(stage(spark, docs, SF), "test-stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(spark, stages):
    names = table(spark, SF, "documents").columns
    assert len(stages) == 5 and all(after.columns == names for _, _, after in stages[:-1])


def test_near_copies_stage(stages):
    from test_cases import brute_jaccard
    _, before, after = stages[1]
    comp = brute_jaccard([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c in comp})


def test_secret_stage(stages):
    _, before, after = stages[2]
    assert before.count() == after.count()
    assert after.where(F.col("text").rlike("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")).count() == 0


def test_mix_stage_words(stages):
    _, before, after = stages[3]
    size = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(size(before) - size(after)) <= 0.02 * size(before)


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_reruns_agree(spark, stages):
    again = pipeline.run(spark, SF)
    assert again.exceptAll(stages[4][2].select(*again.columns)).count() == 0


def test_odd_tables(spark, tmp_path):
    from test_cases import DOCS, EXTRA, ROWS
    for k, rows in enumerate((ROWS, [])):
        spark.createDataFrame(rows, DOCS).select("*", *[F.lit("mine").alias(c) for c in EXTRA]).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (5, 0, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        docs = table(spark, f"{tmp_path}/{k}", "documents")
        for _, stage in pipeline.STAGES:
            docs = saved(stage(spark, docs, f"{tmp_path}/{k}"), "odd-stage")
        assert (docs.count() > 0) == bool(rows)


@pytest.fixture
def many_partitions(spark, monkeypatch):
    """64 shuffle partitions that stay apart, small tables not broadcast; the files of every saved table by its name."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, files = {k: spark.conf.get(k) for k in conf}, {}

    def noted(df, name):
        out = saved(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    for module in (common, components, jaccard, mixing, secrets):
        monkeypatch.setattr(module, "saved", noted)
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield files
    for k, v in old.items():
        spark.conf.set(k, v)


def test_narrow_tables_are_written_in_few_files(spark, many_partitions):
    # an executor starts processes for every file that it creates
    docs = table(spark, SF, "documents")
    chain = spark.range(500).selectExpr("id AS u", "id + 1 AS v")
    found = components.components(chain, 500)
    assert found.count() == 501 and found.where("component <> 0").count() == 0
    jaccard.similar_documents(docs, 5, 80).count()
    secrets.redacted(docs, secrets.Ledger(spark, common.folder(spark, "test-ledger"))).count()
    mixing.mixed_documents(docs).count()
    few = ["components", "jaccard-classes", "jaccard-bits", "jaccard-pairs", "jaccard-near", "jaccard-links", "jaccard-members", "jaccard-cross",
           "secret-unseen", "mix-shards"]
    assert {k: max(many_partitions[k]) for k in few} == dict.fromkeys(few, 1)


def test_files_hold_their_share_of_the_rows(spark):
    df = spark.range(1000).repartition(50, "id")
    for dealt in (False, True):
        for rows, parts in ((0, 1), (100, 1), (101, 2), (1000, 10)):
            out = common.in_files(df, rows, 100, dealt)
            assert out.rdd.getNumPartitions() == parts and out.count() == 1000
    assert common.in_files(df, 100_000, 100).rdd.getNumPartitions() == 50


def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_a_task_leaves_no_freed_memory_behind():
    def run(batches):
        rows = [bytes(1000) for _ in range(150_000)]
        keep.append(bytes(1000))  # above what is freed, so that the heap does not shrink by itself
        yield from batches
        del rows

    keep, before = [], held()
    out = list(run(iter([1, 2])))
    left = held() - before
    assert list(common.tidied(run)(iter([1, 2]))) == out == [1, 2]
    assert left > 100 and held() - before < 50


def test_encoders_are_kept_for_steps_that_encode():
    from timberline.llm.tokens import encoder
    import public_tokenizers
    first = encoder(public_tokenizers.path("word_bpe_49k.json"))
    list(common.tidied(iter, words=True)(iter([1])))
    assert encoder(public_tokenizers.path("word_bpe_49k.json")) is first
    list(common.tidied(iter)(iter([1])))
    assert encoder.cache_info().currsize == 0
