"""Operators that give a row per document: rules, classifier, licenses, fingerprints."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import fingerprints as P
from quillon.llm import ftrl, licenses
from quillon.llm import kernels as K
from quillon.llm import quality_rules as Q

ODD = ["", None, "   \n\t", "one", "a b c d", "x" * 5000, "\n\n\n", "é\x85ü\x0bz 漢字", "# * $ | <>", "\na b\na b\n \nb\na b"]


def rules_by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 50 or 100 * r > 50 * n


def junk(prose, i):
    t = prose(150, 7000 + i)
    return [t.upper().replace(" ", "!! "), t.replace(" ", "*** "), t.replace(" ", " | "), t.replace(" ", "&&& ")][i % 4]


@pytest.fixture
def judged(spark, documents, prose):
    """Documents of which two thirds are labelled, and the labels."""
    texts = [prose(60 + i % 200, i) if i % 5 else junk(prose, i) for i in range(400)]
    docs = documents(texts)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(400) if i % 3], "doc_id long, quality int, toxic int")
    return texts, docs, labels


def test_statistics(spark, documents, prose):
    texts = ODD + [prose(80, 1), prose(80, 1) + "\n" + prose(80, 1), "a b c " * 40]
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in Q.quality_rules(documents(texts), none).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        want = rules_by_hand(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, t
        assert r["kept"] == (not want[5])


def test_forest_keeps_clean_and_rejects_junk(judged):
    texts, docs, labels = judged
    rows = Q.quality_rules(docs, labels).collect()
    assert [r["doc_id"] for r in rows if r["kept"] != (r["doc_id"] % 5 > 0)] == []
    kept = Q.rows_kept(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 5}


def test_forest_paths_are_short_for_rows_apart():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.05, (500, 3))
    f = Q.grow(x, np.array([-1.0, -1, -1]), np.array([1.0, 1, 1]))
    assert f.score(np.array([[0.9, 0.9, 0.9]]))[0] > f.score(np.array([[0.0, 0.0, 0.0]]))[0] + 0.2
    assert Q.grow(x[:1], x[0], x[0]).score(x[:2]).shape == (2,)
    assert Q.calibrate(np.array([0.1, 0.2]), np.array([True, True])) == np.inf


@pytest.mark.parametrize("quality", [[], [(1, 1), (2, 1)], [(1, None), (2, 0)], [(1, 0), (1, 1), (99, 1)]])
def test_few_labels_and_empty_tables(spark, documents, prose, quality):
    labels = spark.createDataFrame(quality, "doc_id long, quality int")
    docs = documents([prose(70, 1), prose(70, 2), None])
    assert Q.quality_rules(docs, labels).count() == Q.rows_kept(docs, labels).count() + 1 == 3
    assert ftrl.quality_classifier(docs, labels).filter("score between 0 and 1").count() == 3
    assert Q.quality_rules(documents([]), labels).count() == ftrl.quality_classifier(documents([]), labels).count() == 0


def test_classifier_on_held_out_rows(judged):
    texts, docs, labels = judged
    rows = ftrl.quality_classifier(docs, labels).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 > 0) for r in held]) > 0.95


def test_held_out_labels_are_never_used(spark, judged):
    texts, docs, labels = judged
    turned = labels.withColumn("quality", __import__("pyspark").sql.functions.expr("CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END"))
    a = {r["doc_id"]: r["score"] for r in ftrl.quality_classifier(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in ftrl.quality_classifier(docs, turned).collect()}


def test_classifier_of_one_document_is_the_plain_formula():
    (part,) = K.slices(pa.array(["b a a", "", "a"]))
    row, at, value = ftrl.features(part)
    assert row.tolist() == sorted(row) and set(row) == {0, 2}
    assert np.allclose(np.bincount(row, value**2)[[0, 2]], 1)
    assert len(at[row == 0]) == 6  # b, a, "b a", "a a", the pair of shapes, the repetition
    (part,) = K.slices(pa.array(["Hello!! Wörld!! été a1 42 A1b", "b2"]))
    shape = ftrl.shapes(part, K.words(part))
    assert shape[0] == shape[1] and shape[3] == shape[6] and len(set(shape.tolist())) == 5


def licenses_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_phrases_are_found_wherever_they_stand(spark, documents, prose):
    texts = [*ODD, "Released under the MIT-License.", "under the mit license under the mit license", "under the mit licenses", "Apache License, Version 2.0, CC BY-NC 4.0", "under the\nmité license", "CC BY NC " * 50, "underthe mit license", prose(3000, 1) + " CC-BY_NC " + prose(10, 2), "by nc cc by cc by nc", "Ünder the MIT license under the MİT license"]
    rows = {r["doc_id"]: r for r in licenses.license_scan(documents(texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == licenses_by_hand(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def sentence(label, end):
    return next(t for t in licenses.TEMPLATES[label] if t.endswith(end)).split()


def labels_by_hand(text):
    """Labels and score: all matches of three words, spans of neighbouring diagonals, and the best chain by trying every pair."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    _, n_base, _, _, base = licenses_by_hand(text)
    chains, score = [], float(n_base > 0)
    for label, template in ((x, t.split()) for x, ts in licenses.TEMPLATES.items() for t in ts):
        n = len(template) - 2
        at = sorted((i - j, i, j) for i in range(len(w) - 2) for j in range(n) if w[i : i + 3] == template[j : j + 3])
        gap, spans = max(licenses.DRIFT, math.ceil(licenses.GAP * n)), []
        for k, (d, i, j) in enumerate(at):
            if not k or d - at[k - 1][0] > gap:
                spans.append([])
            spans[-1].append((i, j))
            score = max(score, sum(x == d for x, _, _ in at) / n)
        for span in spans:
            if len({j for _, j in span}) < licenses.COVERED * n:
                continue
            ways = []
            for i, j in sorted(span):
                before = [(m + 1, s) for a, b, m, s in ways if a < i and b < j and abs((i - j) - (a - b)) <= gap and i - s <= 2 * n]
                ways.append((i, j, *max([(1, i), *before])))
            last, _, m, first = max(ways, key=lambda x: x[2])
            if m >= licenses.COVERED * n:
                score = max(score, m / n)
                chains.append((label, m, first, last))
    beaten = lambda x: any(y[1] > x[1] and 2 * (min(x[3], y[3]) - max(x[2], y[2]) + 1) >= x[3] - x[2] + 1 for y in chains)
    return ",".join(sorted({x[0] for x in chains if not beaten(x)} | set(filter(None, base.split(","))))), score


def test_notices_that_differ_in_a_word(spark, documents):
    notices = ["gpl-2", "gpl-3", "agpl-3", "lgpl", "cc-by", "cc-by-nc", "cc-by-sa"]
    rows = {r["doc_id"]: r for r in licenses.license_scan(documents([licenses.TEMPLATES[x][0] for x in notices])).collect()}
    assert [rows[i]["labels"] for i in range(len(notices))] == notices and all(r["score"] == 1 for r in rows.values())


def test_labels_and_scores_are_those_by_hand(spark, documents, prose):
    r, texts = random.Random(8), [*ODD, prose(400, 9)]
    for k in range(60):
        words = prose(r.randrange(40), k).split()
        for _ in range(r.randrange(1, 4)):
            part = r.choice([t for ts in licenses.TEMPLATES.values() for t in ts]).split()
            for _ in range(r.randrange(8)):
                i = r.randrange(len(part))
                part[i : i + r.randrange(3)] = ["other"] * r.randrange(3)
            words += [*part[r.randrange(6) :], *prose(r.randrange(12), k + 1).split()]
        texts.append(" ".join(words))
    rows = {x["doc_id"]: x for x in licenses.license_scan(documents(texts)).collect()}
    for i, t in enumerate(texts):
        label, score = labels_by_hand(t)
        assert (rows[i]["labels"], rows[i]["score"]) == (label, pytest.approx(score)), t


def test_templates_with_words_changed(spark, documents, prose):
    mit = sentence("mit", "without restriction")
    broken = [*mit[:10], "really", *mit[10:20], *mit[21:]]
    texts = [prose(30, 1) + " " + " ".join(mit).title() + ". " + prose(30, 2), " ".join(broken), " ".join(mit[:8]), " ".join(reversed(mit))]
    rows = {r["doc_id"]: r for r in licenses.license_scan(documents(texts)).collect()}
    assert rows[0]["labels"] == rows[1]["labels"] == "mit" and rows[0]["score"] == 1 and 0.7 <= rows[1]["score"] < 1
    assert rows[2]["labels"] == rows[3]["labels"] == "" and rows[2]["n_base"] == 0


@pytest.mark.parametrize("more", [5, 8, 10])
def test_templates_with_words_between(spark, documents, prose, more):
    mit, gpl = sentence("mit", "without restriction"), sentence("gpl-3", "any later version")
    line = prose(more, 5).split()
    marked = [w for i in range(0, len(gpl), 9) for w in ["dnl", *gpl[i : i + 9]]]
    apart = [*mit[:14], *prose(60, 6).split(), *mit[14:]]
    texts = [" ".join([*mit[:14], *line, *mit[14:]]), prose(20, 3) + " " + " ".join(marked), " ".join(apart), " ".join([*mit[14:], *line, *mit[:14]])]
    rows = {r["doc_id"]: r for r in licenses.license_scan(documents(texts)).collect()}
    assert [rows[i]["labels"] for i in range(4)] == ["mit", "gpl-3", "", ""]
    assert rows[0]["score"] == 1 - 2 / (len(mit) - 2)


def test_repeated_rows_and_empty_tables(spark, documents):
    assert licenses.license_scan(documents([])).count() == 0
    assert licenses.license_scan(documents(["cc by nc"] * 3 + [None], [1, 1, None, None])).count() == 4


@pytest.mark.parametrize(("rows_a_range", "side"), [(3, 128), (1000, 128), (2, 2), (1, 1)])
def test_edits_take_the_next_documents_text(spark, documents, prose, monkeypatch, rows_a_range, side):
    monkeypatch.setattr(P, "SIDE", side)
    monkeypatch.setattr(P.dealt_in_ranges, "__defaults__", (rows_a_range,))
    texts = [*ODD, *(prose(n, n) for n in (1, 2, 3, 10, 50, 200, 900, 30, 30))]
    ids = list(range(0, 3 * len(texts), 3))
    random.Random(3).shuffle(ids)
    rows = {r["doc_id"]: r for r in P.fingerprint_edits(documents(texts, ids)).collect()}
    at = dict(zip(ids, texts, strict=True))
    order = sorted(ids, reverse=True)
    assert len(rows) == len(texts)
    for k, i in enumerate(order):
        t, after = at[i] or "", at[order[(k + 1) % len(order)]] or ""
        third = len(t) // 3
        changed = t[: len(t) - third] + after[:third]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        mine = {x: P.as_text(np.concatenate([P.sketches(p) for p in K.slices(pa.array([x]))]))[0] for x in (t, changed, after)}
        assert (r["fingerprint"], r["edited_fingerprint"]) == (mine[t], mine[changed])
        share = lambda a, b: np.mean([a[j : j + 8] == b[j : j + 8] for j in range(0, len(a), 8)]) ** 0.5
        assert r["near_edited"] == pytest.approx(share(mine[t], mine[changed])) and r["near_next"] == pytest.approx(share(mine[t], mine[after]))
    assert {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(documents(texts, ids)).collect()} == {i: r["fingerprint"] for i, r in rows.items()}


def test_edits_with_one_row_none_and_equal_ids(spark, documents):
    assert P.fingerprint_edits(documents([])).count() == 0
    (only,) = P.fingerprint_edits(documents(["abc def ghi"])).collect()
    assert only["near_next"] == 1 and only["edited_sha256"] == hashlib.sha256(b"abc def abc").hexdigest()
    rows = P.fingerprint_edits(documents(["a", "b", "a", None], [1, 1, 1, None])).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == ["1", "1", "1", "None"]


@pytest.mark.parametrize("side", [2, 128])
def test_many_rows_of_one_id_are_cut_into_spans(spark, documents, prose, monkeypatch, side):
    monkeypatch.setattr(P, "SIDE", side)
    texts = [prose(3, i) for i in range(120)]
    ids = [None] * 40 + [7] * 40 + [-(1 << 63)] * 3 + list(range(37))
    dealt = P.dealt_in_ranges(documents(texts, ids), 4).collect()
    own = [r for r in dealt if not r["head"]]
    key = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (-(1 << 63) if x[0] is None else x[0], x[0] is not None, key(x[1])), reverse=True)
    assert [(r["doc_id"] if r["known"] else None, r["text"]) for r in sorted(own, key=lambda r: (r["span"], [-r["doc_id"], not r["known"], -int(key(r["text"]), 16)]))] == order
    spans = sorted({r["span"] for r in own})
    assert len({r["span"] for r in own if r["doc_id"] == 7}) > 2 and len({r["span"] for r in own if not r["known"]}) > 2
    heads = {r["span"]: r["text"] for r in dealt if r["head"]}
    firsts = {s: next(t for t in (t for _, t in order) if any(r["span"] == s and r["text"] == t for r in own)) for s in spans}
    assert heads == {s: firsts[spans[(i + 1) % len(spans)]] for i, s in enumerate(spans)}
    found = P.fingerprint_edits(documents(texts, ids)).collect()
    assert len(found) == 120 and sorted(str(r["doc_id"]) for r in found) == sorted(map(str, ids))


def test_sketches_are_those_by_hand(prose):
    text = "a b c a b c a b c d " + prose(30, 8)
    (part,) = K.slices(pa.array([text]))
    w = text.split()
    code = dict(zip(w, K.words(part).hash.tolist(), strict=True))
    seen: dict = {}
    mers = []
    for i in range(len(w) - 2):
        g = tuple(w[i : i + 3])
        h = int(K.grams(np.array([code[x] for x in g], np.uint64), 3)[0])
        seen[g] = seen.get(g, -1) + 1
        mers.append(int(K.mix(np.array([(h + seen[g] * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]))
    slots = []
    for m in K.seeds(48, 9).tolist():
        order = sorted(range(len(mers)), key=lambda i: (mers[i] ^ (m >> 7)) * m % (1 << 64))[:2]
        h = 2
        for i in sorted(order):
            h = int(K.mix(np.array([(h * 0x9E3779B97F4A7C15 + mers[i]) % (1 << 64)], np.uint64))[0])
        slots.append(h >> 32)
    assert P.sketches(part)[0].tolist() == slots


def test_labelled_rows_of_repeated_ids(spark, documents):
    from quillon.llm.samples import labelled

    docs = documents([f"text {i}" for i in range(50)] + [None], [i % 5 for i in range(50)] + [9])
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(1, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in labelled(docs, labels, "quality", 100).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 9] and rows[1]["quality"] == 0
    assert rows[2]["text"] == min((f"text {i}" for i in range(2, 50, 5)), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert labelled(docs, labels, "quality", 2).count() == 2


def test_a_null_id_is_not_held_out(spark, documents):
    from quillon.llm.ftrl import quality_classifier

    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = quality_classifier(documents(["a b", "c d"], [None, 1]), labels).collect()
    assert sorted((str(r["doc_id"]), r["held_out"]) for r in rows) == [("1", False), ("None", False)]


def test_updates_are_those_of_the_published_rule():
    from quillon.llm.ftrl import Ftrl

    rng, model = np.random.default_rng(2), Ftrl(6, 0.5, 1.0, 0.1, 0.2)
    z, n = [0.0] * 6, [0.0] * 6
    for _ in range(60):
        at = rng.choice(6, 3, replace=False)
        x, y = rng.random(3), float(rng.integers(2))
        w = [0.0 if abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * 0.1) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.2) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for k, i in enumerate(at):
            g = (p - y) * x[k]
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[k]
            n[i] += g * g
        model.update(at, x, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_moved_blocks_are_less_alike_than_equal_text(prose):
    a = prose(400, 1, line=400)
    w = a.split()
    moved = " ".join(w[200:] + w[:200])
    s = np.concatenate([P.sketches(p) for p in K.slices(pa.array([a, a + "\n", moved, prose(400, 2)]))])
    near = P.likeness(np.repeat(s[:1], 4, axis=0), s)
    assert near[0] == near[1] == 1 and 0.5 < near[2] < 0.9 and near[3] < 0.15
