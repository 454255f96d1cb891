import __spark_entry__
import corpus_pipeline
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from quillon.llm.queries import ready
    from quillon.llm.shared import cut

    ready(spark)
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], DATA)))
    return out


def test_stages_hand_on_documents(stages):
    docs, *after = stages
    assert [x.columns for x in after[:-1]] == [docs.columns] * 4
    assert [x.schema["n_chars"].dataType for x in after[:-1]] == [docs.schema["n_chars"].dataType] * 4
    assert docs.count() > after[0].count() > after[1].count() >= after[2].count() > 0


def test_what_each_stage_decides(spark, stages):
    docs, ruled, single, cleaned, mixed, packed = stages
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert ruled.join(labels, "doc_id").filter("quality = 0").count() == 0
    assert single.count() == single.select("text").distinct().count()
    assert cleaned.filter("n_chars <> length(text)").count() == 0
    assert mixed.join(single, "doc_id", "left_anti").count() == 0
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    clean = labels.filter("quality = 1 and toxic = 0")
    assert mixed.join(clean, "doc_id").select("doc_id").distinct().count() >= 0.9 * cleaned.join(clean, "doc_id").count()


def test_registered_and_the_same_each_time(spark, stages):
    queries = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries if q.startswith("op") and q[2].isdigit()}
    found = queries["pipeline"](spark, DATA)
    key = ("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_no_documents(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, DATA).count() == 0
