import numpy as np
import pytest

from quillon.llm import mixing as M
from quillon.llm.shared import cut

NAMES = ["clean", "toxic", "junk"]


@pytest.fixture
def sourced(spark, documents, prose):
    def text(i):
        t = prose(30 + i % 170, i)
        return t.replace(" ", " idiot ", 3) if i % 6 == 1 else t.upper().replace(" ", "!! ") if i % 6 == 2 else t

    kind = lambda i: {1: "toxic", 2: "junk"}.get(i % 6, "clean")
    docs = documents([text(i) for i in range(360)])
    return docs, spark.createDataFrame([(i, kind(i)) for i in range(360) if i % 7], "doc_id long, domain string")


def test_expected_totals_meet_the_targets(sourced):
    docs, labels = sourced
    targets = {"clean": 0.8, "toxic": 0.05, "junk": 0.15}
    rows = M.mix(docs, labels, targets).toPandas()
    tokens, p, rate = rows["tokens"].to_numpy(), np.array(rows["p"].tolist()), rows["rate"].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    assert np.allclose((tokens * rate) @ p / tokens.sum(), list(targets.values()), atol=0.01)
    assert abs((tokens * rows["copies"]).sum() / tokens.sum() - 1) < 0.1
    assert ((rows["copies"] == np.floor(rate)) | (rows["copies"] == np.floor(rate) + 1)).all()
    assert set(rows.columns) >= {"doc_id", "lang", "kept", "key"}


def test_tokens_are_the_ids_of_whole_texts(spark, sourced, documents, tmp_path):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    from quillon.llm.packing import vocabulary

    docs, labels = sourced
    odd = ["", None, " \t\n", "<|endoftext|> <|ENDOFTEXT|> Don't STOP-me!", "naïve Ärger 漢字\u00a0x", "word " * 3000 + "Word! WORD", "x" * 5000]
    docs = docs.unionByName(documents(odd, range(1000, 1000 + len(odd))))
    whole = Tokenizer.from_file(vocabulary())
    targets = {"clean": 0.8, "toxic": 0.05, "junk": 0.15}
    rows = M.mix(docs, labels, targets, path=vocabulary()).toPandas()
    assert rows["tokens"].tolist() == [len(whole.encode(t or "", add_special_tokens=False).ids) for t in rows["text"]]
    tokens, p, rate = rows["tokens"].to_numpy(), np.array(rows["p"].tolist()), rows["rate"].to_numpy()
    assert np.allclose((tokens * rate) @ p / tokens.sum(), list(targets.values()), rtol=3e-3)


def test_soft_posteriors_find_held_out_domains(sourced):
    docs, labels = sourced
    rows = M.mix(docs, labels, dict.fromkeys(NAMES, 1.0), relative=True).toPandas()
    held = rows[rows["doc_id"] % 7 == 0]
    want = [{1: 1, 2: 2}.get(i % 6, 0) for i in held["doc_id"]]
    assert np.mean(np.array(held["p"].tolist()).argmax(axis=1) == want) > 0.85
    assert (rows["copies"] == 1).all()  # each domain as it is


def test_descent_is_the_least_squares_solution(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 200)
    tokens = rng.integers(1, 100, 200)
    table = cut(spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens long, p array<double>"))
    present = tokens @ p
    for factor in ([0.5, 1.0, 1.5], [0.0, 1.0, 1.0], [2.0, 0.2, 1.0]):
        wanted = present * factor
        descent, reached = M.solve(table, wanted, steps=400)
        rates = descent.rates(p)
        assert np.allclose(reached, (tokens * rates) @ p)
        gap = (reached - wanted) / tokens.sum()
        # no rate can go either way to lower the gap: p.gap is 0 where r > 0, and not negative where r = 0
        assert np.abs(gap).max() < 3e-3 or (np.abs((p @ gap)[rates > 1e-3]).max() < 2e-2 and (p @ gap)[rates <= 1e-3].min() > -2e-2)


def test_odd_tables(spark, documents, prose):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert M.mix(documents([]), none, dict.fromkeys(NAMES, 1 / 3)).count() == 0
    docs = documents([prose(20, 1), None, "", prose(20, 1)], [1, 2, None, 1])
    for labels in (none, spark.createDataFrame([(1, "clean"), (1, "clean"), (2, None), (3, "unknown")], "doc_id long, domain string")):
        rows = M.mix(docs, labels, dict.fromkeys(NAMES, 1.0), relative=True).collect()
        assert len(rows) == 4 and all(r["rate"] >= 0 for r in rows)
    kept = M.rows_mixed(docs, none, dict.fromkeys(NAMES, 2.0), relative=True)
    assert kept.columns == docs.columns and kept.count() >= 4


def test_label_domains(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r["domain"] for r in M.label_domains(labels).orderBy("doc_id").collect()] == ["clean", "junk", "toxic", None, "junk"]


def test_small_domains_meet_their_targets(spark):
    p = np.array([[1 - 2e-4, 1e-4, 1e-4]] * 1900 + [[0.02, 0.01, 0.97]] * 97 + [[0.02, 0.97, 0.01]] * 3)  # toxic: 0.15 % of the tokens
    table = cut(spark.createDataFrame([(50, x.tolist()) for x in p], "tokens long, p array<double>"))
    wanted = 50 * p.sum(axis=0) * [1.0, 0.25 + 0.0625, 1.0]
    descent, reached = M.solve(table, wanted)
    assert np.allclose(reached, wanted, rtol=M.CLOSE * 1.01) and np.allclose(50 * descent.rates(p) @ p, reached)
    assert descent.rates(p)[-1] < 0.35 and np.abs(descent.rates(p)[:1900] - 1).max() < 0.01


def test_targets_out_of_reach_end(spark):
    p = np.array([[0.9, 0.1]] * 50 + [[0.6, 0.4]] * 50)
    table = cut(spark.createDataFrame([(10, x.tolist()) for x in p], "tokens long, p array<double>"))
    descent, reached = M.solve(table, np.array([100.0, 900.0]))
    gap = p @ ((reached - [100, 900]) / np.maximum(10 * p.sum(axis=0), [100, 900]))
    rates = descent.rates(p)
    assert np.abs(gap[rates > 1e-3]).max() < 1e-2 and gap[rates <= 1e-3].min() > -1e-2


def test_rates_stay_as_fitted(sourced):
    docs, labels = sourced
    targets = {"clean": 1.01, "toxic": 0.1, "junk": 0.1}
    rows = M.mix(docs, labels, targets, relative=True).toPandas()
    tokens, p, rate = rows["tokens"].to_numpy(), np.array(rows["p"].tolist()), rows["rate"].to_numpy()
    reached = (tokens * rate) @ p / (tokens @ p)
    assert np.allclose(reached, list(targets.values()), rtol=M.CLOSE * 1.01)
