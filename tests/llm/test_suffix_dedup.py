import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import kernels as K
from quillon.llm import suffix_dedup as S

LENGTH = 60


def by_hand(rows, keep_first, length=LENGTH):
    """rows: (id, text), no two equal. Returns what is left of each, and the removed runs."""
    data = [(i, (t or "").encode()) for i, t in sorted(rows)]
    count, first = Counter(), {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            count[s] += 1
            first.setdefault(s, (i, p))
    out = {}
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if first[s] != (i, p) if keep_first else count[s] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (bytes(np.frombuffer(b, np.uint8)[~gone]), runs)
    return out


@pytest.fixture
def corpus(prose):
    r = random.Random(2)
    passage, texts = prose(40, 999), []
    for i in range(30):
        t = prose(r.randrange(5, 60), i)
        if i % 3 == 0:
            at = r.randrange(len(t))
            t = t[:at] + passage[r.randrange(20) : len(passage) - r.randrange(20)] + t[at:]
        texts.append(t)
    texts += [texts[4], texts[4][10:], "é" * 100, "x" + "é" * 80, "ab" * 200, "ab" * 40, "", None, "short"]
    return texts


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [1, 5, 4096])
def test_same_as_by_hand(spark, documents, corpus, keep_first, hot):
    docs = documents(corpus)
    found = S.suffix_dedup(docs, keep_first, LENGTH, hot).collect()
    want = by_hand(list(enumerate(corpus)), keep_first)
    assert {r["doc_id"]: (bytes(r["kept"]), r["n_spans"]) for r in found} == want
    for r in found:
        raw = (corpus[r["doc_id"]] or "").encode()
        assert r["n_bytes"] == len(raw) and r["n_removed"] == len(raw) - len(r["kept"]) == sum(b - a for a, b in r["spans"])
        assert r["key"] == "c" and r["n_words"] == 7


def test_other_columns_stay_and_empty_tables(spark, documents):
    assert S.suffix_dedup(documents([])).count() == 0
    rows = S.suffix_dedup(documents(["a" * 500, "a" * 500], [None, None]), length=400).collect()
    assert len(rows) == 2 and len({bytes(r["kept"]) for r in rows}) == 1


def test_repeated_rows_of_one_id_are_one_text(spark, documents, prose):
    t = prose(100, 1)
    rows = S.suffix_dedup(documents([t, t, t], [1, 1, 2])).collect()
    assert sorted((r["doc_id"], r["n_removed"] == 0) for r in rows) == [(1, True), (1, True), (2, False)]
    assert all(r["n_removed"] == r["n_bytes"] for r in S.suffix_dedup(documents([t, t], [1, 1]), keep_first=False).collect())


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters", [1, 2, 4])
@pytest.mark.parametrize("length", [20, 40, 77])
def test_longest_factors_are_those_by_hand(letters, length):
    r = np.random.default_rng(letters)
    data = np.tile(r.integers(97, 97 + letters, 90), 4)
    data[r.integers(0, 360, 5)] = 120
    data = data.astype(np.uint8)
    starts = np.arange(len(data) - length + 1)
    text = data.tobytes()
    strings = [text[i : i + length] for i in starts]
    order, lcp = S.suffix_array(data, starts, length)
    assert order.tolist() == sorted(starts.tolist(), key=lambda i: (strings[i], i))
    assert lcp.tolist() == [0] + [common(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    earlier, later = S.factors(order, lcp)
    assert earlier.tolist() == [max((common(s, t) for t in strings[:i]), default=0) for i, s in enumerate(strings)]
    assert later.tolist() == [max((common(s, t) for t in strings[i + 1 :]), default=0) for i, s in enumerate(strings)]


def test_short_periods_are_few_entries(prose):
    for period in ("a", "ab", "abc def "):
        (part,) = K.slices(pa.array([period * (20_000 // len(period)), prose(60, 1)]))
        row, h, x, s, m, o, second, final, times, *_ = S.entries(*S.anchors(part))
        assert (row == 0).sum() <= 2 * len(period) + 2
        assert times[row == 0].sum() > 15_000 / len(period) and (times[row == 1] == 1).all()
        assert (s <= second).all() and (second <= final).all()


@pytest.mark.parametrize("keep_first", [False, True])
def test_periods_same_as_by_hand(spark, documents, prose, keep_first):
    texts = ["a" * 700, "a" * 90 + prose(20, 3) + "a" * 90, "ab" * 300 + "c" + "ab" * 300, prose(30, 5) + "xyz" * 50, "xyz" * 50 + prose(30, 5), "b" + "ab" * 31]
    found = S.suffix_dedup(documents(texts), keep_first, LENGTH).collect()
    assert {r["doc_id"]: (bytes(r["kept"]), r["n_spans"]) for r in found} == by_hand(list(enumerate(texts)), keep_first)


def test_text_keeps_whole_characters_only(spark, documents):
    # what is left begins and ends inside characters, which must not join to others
    a, b = "é" + "x" * 80 + "é", "ã" + "x" * 80 + "ù"
    rows = {r["doc_id"]: r for r in S.suffix_dedup(documents([a, "漢" + "x" * 80 + "字", b]), False, LENGTH).collect()}
    assert rows[0]["text"] == "é" and rows[1]["text"] == "漢字" and rows[2]["text"] == "ã"  # é and ù share their first byte
    assert rows[0]["kept"] == b"\xc3\xa9\xa9" and rows[2]["kept"] == b"\xc3\xa3\xb9"
    same_tail = ["é" + "x" * 80, "©" + "x" * 80, "q" * 30 + "é" + "x" * 80 + "z"]  # é and © share their second byte
    rows = {r["doc_id"]: r for r in S.suffix_dedup(documents(same_tail), False, LENGTH).collect()}
    assert rows[1]["kept"] == bytes([0xC2]) and rows[1]["text"] == ""


def test_a_text_of_megabytes(spark, documents, prose):
    long = prose(300_000, 7)
    rows = {r["doc_id"]: r for r in S.suffix_dedup(documents([long, long[1_000_000:1_400_000], "short"])).collect()}
    assert rows[0]["n_removed"] == 0 and rows[1]["n_removed"] == rows[1]["n_bytes"] and rows[2]["n_removed"] == 0


def test_every_start_has_one_anchor_at_an_equal_place(prose):
    a, b = prose(300, 1), prose(30, 2)
    (part,) = K.slices(pa.array([a + b, "zz" + b + a, "tiny"]))
    row, first, last, place, h, x, *_ = S.anchors(part, 400, 32)
    starts = [(r, s, p - s) for r, f, l, p in zip(row, first, last, place, strict=True) for s in range(f, l + 1)]
    texts = [(a + b).encode(), ("zz" + b + a).encode()]
    assert sorted((r, s) for r, s, _ in starts) == [(r, s) for r, t in enumerate(texts) for s in range(len(t) - 399)]
    offsets = {}
    for r, s, o in starts:
        assert offsets.setdefault(texts[r][s : s + 400], o) == o


def test_rows_cleaned_has_the_columns_of_docs(spark, documents, prose):
    docs = documents([prose(100, 1), prose(100, 1), prose(80, 2)])
    rows = S.rows_cleaned(docs)
    assert rows.columns == docs.columns and sorted(r["doc_id"] for r in rows.collect()) == [0, 2]
    assert {r["kept"] for r in rows.collect()} == {"x"}
