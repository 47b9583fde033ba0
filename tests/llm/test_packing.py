import random
import zlib

import numpy as np
import pytest

from ledgerleaf.llm import packing
from ledgerleaf.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def cut(ids, capacity):
    first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
    bounds = [0, *range(first, len(ids) + 1, capacity)]
    return [(a, ids[a:b]) for a, b in zip(bounds, bounds[1:])]


def check(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_pieces_and_places(docs, listed, reference):
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    expected = []
    for key, text in listed:
        ids = reference.encode(text or "", add_special_tokens=False).ids + [0]
        for i, (start, own) in enumerate(cut(ids, 2048)):
            expected.append((key, i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    found = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)
    n = check(rows, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_ids_are_the_tokenizer_s(reference):
    encode = packing.encoder(tokenizer_path())
    for text in ["a  b", "\n\n a", " lead", "trail ", "x\n y", "it's 'll don’t 12 3.4", "<|endoftext|>a <|endoftext|>", "\t\ta", "日本語 　テスト", "", "\r\nb\x1cc\x85d"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def best_possible(lengths, capacity):
    """Fewest sequences by trying all ways."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= lengths[i]:
                at = rooms.index(k)
                place(i + 1, rooms[:at] + [k - lengths[i]] + rooms[at + 1 :])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(150):
        lengths = [rng.randint(2, 20) for _ in range(rng.randint(1, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        whole = packing.Packing(counts, 20)
        # What the reduction fixed and the best packing of the rest are together as good as the best of all.
        left = packing.Packing.__new__(packing.Packing)
        left.capacity, left.rows, left.sequences, left.fixed = 20, [], 0, 0
        left.left, left.used = np.zeros(21, np.int64), np.zeros(21, np.int64)
        for x, n in counts.items():
            left.left[x] = n
        left._reduce()
        rest = [x for x in range(21) for _ in range(int(left.left[x]))]
        assert left.sequences + best_possible(rest, 20) == best_possible(lengths, 20)
        assert whole.sequences >= best_possible(lengths, 20)


def test_many_of_a_length_are_placed_apart():
    packed = packing.Packing({700: 1_000_003, 648: 500_000, 2048: 7, 1: 10}, 2048)
    places = packed.arrays()
    assert packed.sequences >= 7
    ends = {}
    for length, n in {700: 1_000_003, 648: 500_000, 2048: 7, 1: 10}.items():
        first, per, seq, off = places[length]
        j = np.arange(n)
        at = np.searchsorted(first, j, side="right") - 1
        sequence = seq[at] + (j - first[at]) // per[at]
        offset = off[at] + (j - first[at]) % per[at] * length
        assert offset.max() + length <= 2048
        for s, o in zip(sequence[:2000].tolist(), offset[:2000].tolist()):
            assert (s, o) not in ends
            ends[s, o] = length


def test_empty_table(none):
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
