import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import kernels as K
from quillon.llm.groups import runs

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x85 é漢😀", max_size=12)), max_size=8)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(texts=TEXTS, most=st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, most):
    got = []
    for part in K.slices(pa.array(texts, pa.string()), most):
        w = K.words(part)
        for i in range(len(part)):
            got.append([part.data[a:b].tobytes().decode() for a, b in zip(w.start[w.bounds[i] : w.bounds[i + 1]], w.end[w.bounds[i] : w.bounds[i + 1]], strict=True)])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    (part,) = K.slices(pa.array(["aa bb aa", "bb  aa"]))
    w = K.words(part)
    assert w.hash[0] == w.hash[2] == w.hash[4] != w.hash[1] == w.hash[3]


@pytest.mark.parametrize("size", [1024, 2048, 4096, 8192])
def test_complementary_words_of_equal_structure_differ(size):
    bits = "a"
    while len(bits) < size:
        bits += bits.translate(str.maketrans("ab", "ba"))
    (part,) = K.slices(pa.array([f"{bits} {bits.translate(str.maketrans('ab', 'ba'))} {bits}"]))
    h = K.words(part).hash
    assert h[0] == h[2] != h[1]


@settings(max_examples=50, deadline=None, derandomize=True)
@given(data=st.binary(min_size=1, max_size=60))
def test_ranges_hash_alike_just_where_their_bytes_are_equal(data):
    raw = np.frombuffer(data + data, np.uint8)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(raw) + 1), np.arange(len(raw) + 1)))
    a, b = a[a <= b], b[a <= b]
    for kind in (K.Prefix, K.Rolling, K.hashes):
        h = K.hashes(raw, a, b) if kind is K.hashes else kind(raw).ranges(a, b)
        found: dict = {}
        for x, y, v in zip(a.tolist(), b.tolist(), h.tolist(), strict=True):
            assert found.setdefault(raw[x:y].tobytes(), v) == v
        assert kind is K.Rolling or len(set(found.values())) == len(found)


def test_slices_of_a_sliced_column():
    column = pa.array(["x", "one two", None, "three"]).slice(1)
    assert [p.text(i) for p in K.slices(column, 3) for i in range(len(p))] == [b"one two", b"", b"three"]


@settings(max_examples=100, deadline=None, derandomize=True)
@given(st.lists(st.integers(0, 5), max_size=30))
def test_occurrence(values):
    assert K.occurrence(np.array(values, np.uint64)).tolist() == [values[:i].count(v) for i, v in enumerate(values)]


def test_order_min_hash_sees_order_and_repeats():
    rng, m = np.random.default_rng(0), K.seeds(64, 5)
    a = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    same = K.order_min_hash(a.copy(), m, 3)
    assert (K.order_min_hash(a, m, 3) == same).all()
    swapped = np.concatenate([a[100:], a[:100]])
    assert 0.1 < (K.order_min_hash(swapped, m, 3) == same).mean() < 0.6  # as a set it is the same
    assert (K.order_min_hash(np.concatenate([a, a]), m, 1) == K.order_min_hash(a, m, 1)).mean() < 0.7
    assert (K.order_min_hash(a[:2], m, 3) == K.order_min_hash(a[:2].copy(), m, 3)).all()
    assert (K.order_min_hash(a[:0], m, 3) == 0).all()


def test_order_min_hash_shares_a_slot_as_the_jaccard_index_says():
    rng, m = np.random.default_rng(1), K.seeds(400, 5)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    b = a.copy()
    b[:100] = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    shared = (K.order_min_hash(a, m, 4) == K.order_min_hash(b, m, 4)).mean()
    assert abs(shared - 0.8**4) < 0.08


def test_groups_across_batches():
    table = pa.table({"k": [1, 1, 1, 2, 3, 3], "j": [0, 0, 1, 1, 1, 1], "v": list("abcdef")})
    for size in (1, 2, 4, 6):
        got = [g["v"].to_pylist() for g in runs(iter(table.to_batches(size)), "k", "j")]
        assert got == [["a", "b"], ["c"], ["d"], ["e", "f"]]
    assert list(runs(iter([]), "k")) == []
