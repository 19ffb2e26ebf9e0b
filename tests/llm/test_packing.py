import random

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import byte_bpe, queries
from tagloom.llm.packing import Rooms, pack, pack_documents, segments

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def brute_pack(sizes, row):
    """Best fit decreasing by looking through all open rows."""
    pieces = sorted(((min(row, n - a), d, a) for d, n in enumerate(sizes) for a in range(0, n, row)), key=lambda p: (-p[0], p[1], p[2]))
    room, count = [], 0
    for n, _, _ in pieces:
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            best = min(fit, key=lambda i: room[i])
            room[best] -= n
        else:
            room.append(row - n)
            count += 1
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=60), st.integers(1, 40))
def test_packs_as_best_fit_decreasing(sizes, row):
    rows = pack(sizes, row)
    assert sorted(row - sum(n for _, _, n in r) for r in rows) == brute_pack(sizes, row)
    parts = sorted((d, a, n) for r in rows for d, a, n in r)
    assert parts == [(d, a, min(row, s - a)) for d, s in enumerate(sizes) for a in range(0, s, row)]


def test_rooms():
    r, rooms, kept = random.Random(2), Rooms(50), []
    for i in range(500):
        need = r.randrange(51)
        at, room = rooms.take(need)
        fit = [x for x in kept if x[1] >= need]
        assert (room if at >= 0 else None) == (min(x[1] for x in fit) if fit else None)
        if at >= 0:
            kept.remove((at, room))
        new = (i, r.randrange(1, 51))
        kept.append(new)
        rooms.put(*new)


def together(packed):
    out = {}
    for s in sorted(segments(packed).collect(), key=lambda s: (s.doc_id is None, s.doc_id or 0, s.offset)):
        out.setdefault(s.doc_id, []).append((s.offset, bytes(s.ids)))
    return out


def test_query_and_round_trip(spark, sf, documents):
    codec = byte_bpe.Codec(byte_bpe.read_ranks(PATH), P.PATTERN)
    packed = pack_documents(documents, PATH, P.PATTERN, row=256, block_ids=20_000).cache()
    got = together(packed)
    for d in documents.collect():
        parts = got.pop(d.doc_id, [])
        assert b"".join(x for _, x in parts) == codec.encode([d.text or ""])[0]
        assert [o for o, _ in parts] == list(np.cumsum([0] + [len(x) // 4 for _, x in parts])[:-1])
    assert not got
    for r in packed.collect():
        assert len(r.input_ids) == len(r.position_ids) == 4 * 256 and r.cu_seqlens[-1] == r.n_ids <= 256
        places = np.frombuffer(r.position_ids, "<u4")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
        assert (np.frombuffer(r.input_ids, "<u4")[r.n_ids :] == 50_256).all()
    rows = queries.op1_packing(spark, sf).collect()
    assert sum(r.n_ids for r in rows) == sum(len(codec.encode([d.text or ""])[0]) // 4 for d in documents.collect())


def test_odd_rows(spark, odd, none):
    codec = byte_bpe.Codec(byte_bpe.read_ranks(PATH), P.PATTERN)
    packed = pack_documents(odd, PATH, P.PATTERN)
    total = sum(len(codec.encode([r.text or ""])[0]) // 4 for r in odd.collect())
    assert sum(r.n_ids for r in packed.collect()) == total
    assert pack_documents(none, PATH, P.PATTERN).count() == 0
