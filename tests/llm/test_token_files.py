import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from ebbtide.llm import token_files as K
from ebbtide.session import scratch_path

from .conftest import ODD


def _rows(pairs, tokenizer):
    """Expected rows of (doc_id, text) pairs in file order."""
    out, start = [], 0
    for doc_id, text in pairs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    data, starts = K.encode_blocks(ids)
    assert K.decode_blocks(data, starts, len(ids)).tolist() == ids.tolist()


def test_a_range_of_blocks_is_read_by_its_starts():
    ids = np.random.default_rng(0).integers(0, 49_000, 1000).astype(np.uint32)
    data, starts = K.encode_blocks(ids)
    assert K.decode_blocks(data, starts[2:5], 256).tolist() == ids[256:512].tolist()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(K.BLOCK, dtype=np.uint32) % 16
    narrow = len(K.encode_blocks(ids)[0])
    ids[[3, 70]] = 2**32 - 1
    assert len(K.encode_blocks(ids)[0]) == narrow + 2 * 5


def test_whole_table(spark, documents, rows, tokenizer):
    folder = scratch_path(spark, "tokens")
    files = K.write_token_files(documents.repartition(4, "text"), folder, file_ids=5000)
    assert files.count() > 5
    found = sorted((tuple(r) for r in K.read_token_files(files, folder).collect()), key=lambda r: r[1])
    assert found == _rows(zip(rows["doc_id"], rows["text"]), tokenizer)


def test_odd_rows(odd, nothing, tokenizer):
    found = sorted((tuple(r) for r in K.round_trip(odd).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in ODD if r[0] is not None)) + [None, None]
    expected = {(d, n, crc) for d, _, n, crc in _rows([r[:2] for r in ODD], tokenizer)}
    assert {(d, n, crc) for d, _, n, crc in found} == expected
    assert all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:]))
    assert K.round_trip(nothing).count() == 0


def test_blocks_are_packed_and_unpacked_in_parts_of_bounded_memory():
    import tracemalloc

    ids = np.random.default_rng(1).integers(49_000, size=3_000_000).astype(np.uint32)
    tracemalloc.start()
    data, starts = K.encode_blocks(ids)
    packed = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    back = K.decode_blocks(data, starts, len(ids))
    unpacked = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(back, ids) and len(starts) == -(-len(ids) // 128) + 1
    assert max(packed, unpacked) < 6 * ids.nbytes
