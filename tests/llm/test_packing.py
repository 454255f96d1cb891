import random
import zlib

import numpy as np
import pytest

from quillon.llm import packing as P
from quillon.llm.tokens import Units


def laid_out(counts, plan):
    length, first, sequence, offset = plan.table()
    out = {}
    for size in np.flatnonzero(counts):
        for rank in range(counts[size]):
            i = np.searchsorted(length * (1 << 44) + first, size * (1 << 44) + rank, side="right") - 1
            assert length[i] == size
            out.setdefault(int(sequence[i] + rank - first[i]), []).append((int(offset[i]), int(size)))
    return out


def check(counts, capacity):
    plan = P.plan(counts, capacity)
    found = laid_out(counts, plan)
    assert sorted(found) == list(range(plan.sequences))
    for pieces in found.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity
    return plan.sequences


def fewest(sizes, capacity):
    """By trying everything."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:k]:
                place(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_never_costs_a_sequence(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 17, 30])
    sizes = sorted((r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 10))), reverse=True)
    counts = np.bincount(sizes, minlength=capacity + 1)
    fixed, left = P.reduce_by_dominance(counts, capacity)
    assert all(sum(s) <= capacity and n > 0 for s, n in fixed)
    rest = [s for s in range(capacity, 0, -1) for _ in range(left[s])]
    assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(sizes, capacity)
    assert check(counts, capacity) <= max(1, round(1.25 * fewest(sizes, capacity)))


def test_many_pieces_come_close_to_the_bound():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.clip(rng.lognormal(6.2, 0.9, 20_000).astype(int), 1, 4096), minlength=4097)
    bound = -(-int((counts * np.arange(4097)).sum()) // 4096)
    assert check(counts, 4096) <= 1.002 * bound


def test_nothing_to_pack():
    assert P.plan(np.zeros(11, int), 10).sequences == 0


def test_ids_are_those_of_the_whole_text(prose):
    from tokenizers import Tokenizer

    whole, units = Tokenizer.from_file(P.vocabulary()), Units(P.vocabulary(), most=30)
    texts = [prose(80, 1), "Été's ÉTÉ, naïve x y café ²3½ don't STOP... 'tis a--b <|endoftext|> İstanbul ΣΑΣ ﬁne 漢字かな 😀!!", "", " \n\t", "a\x1cb\x85c", "x" * 3000, "word*** $$$ (paren) e.g., U.S.A.", "́lone Å̊ 'S 'll's"]
    for _ in range(2):
        for text, got in zip(texts, units.ids([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pieces_hold_every_id_once(spark, documents, prose):
    from tokenizers import Tokenizer

    texts = [prose(n, n) for n in (5, 40, 300, 1, 77, 40, 900)] + ["", None, prose(40, 40)]
    rows = P.best_fit_packing(documents(texts), capacity=128).collect()
    whole = Tokenizer.from_file(P.vocabulary())
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == list(range(0, len(ids), 128)) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128


def test_repeated_rows_null_ids_and_empty_tables(spark, documents):
    assert P.best_fit_packing(documents([])).count() == 0
    rows = P.best_fit_packing(documents(["a b", "a b", None], [1, 1, None])).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


@pytest.mark.parametrize("kind", ["cased", "plain"])
def test_other_vocabularies_are_encoded_whole(tmp_path, kind):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    words = {w: i for i, w in enumerate(["?", "abc", "Abc", "!", "abc!", "Abc!"])}
    t = Tokenizer(models.WordLevel(words, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit() if kind == "cased" else pre_tokenizers.Whitespace()
    if kind == "plain":
        t.normalizer = normalizers.Lowercase()
    t.save(str(tmp_path / "v.json"))
    texts = ["Abc abc", "Abc!", "", "abc ! Abc\n\tabc!", "É é"]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert Units(str(tmp_path / "v.json")).ids([x.encode() for x in texts]) == want


def test_the_contracts_vocabulary_goes_by_units():
    assert Units(P.vocabulary()).by_units
