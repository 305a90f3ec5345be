import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import common, packing, token_output
from quillmark.llm.tokens import WordEncoder, default_tokenizer


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    return lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")


@functools.cache
def plain(name="word_bpe_49k.json"):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("abC'st.,!?  \n\x01éÉ日3<|>", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", " ", "Word", "it's", "É"]), max_size=9).map("".join)), max_size=6))
def test_pieces_give_the_librarys_ids(texts):
    e = WordEncoder.of(default_tokenizer())
    ids, n = e.encode(pa.array(texts, pa.string()), None)
    want = [plain().encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_strings_of_added_tokens_are_what_the_library_makes_of_them():
    texts = ["hello <|endoftext|> world", None, "a<|startoftext|>b", "<|endoftext|>", "no such"]
    ids, n = WordEncoder.of(default_tokenizer()).encode(pa.array(texts))
    want = [[*plain().encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want] and want[0] == [3306, 49407, 1002, 2]


def test_tokenizers_of_another_kind_encode_whole_texts():
    import public_tokenizers

    e = WordEncoder.of(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  words,\n it's", "", None, " x <|endoftext|>"]
    ids, n = e.encode(pa.array(texts), None)
    want = [plain("byte_bpe_50k.json").encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not e.by_piece and WordEncoder.of(default_tokenizer()).by_piece
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.floats(0.1, 1.0))
def test_blocks_round_trip(values, percentile):
    blocks = token_output.encode_blocks(np.array(values, np.uint32), percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    assert token_output.decode_blocks(b"".join(blocks), starts)[: len(values)].tolist() == values


def test_outliers_do_not_widen_a_block():
    values = np.arange(256, dtype=np.uint32) % 16
    values[7] = 2**31
    (block,) = token_output.encode_blocks(values)
    assert block[4] == 4 and len(block) == 8 + 4 * 32 + 5


@pytest.mark.parametrize("shard_ids", [1 << 26, 1])
def test_output_round_trip(spark, docs, corpus, ids_of, shard_ids):
    """With one shard for each slice of texts and with many shards a task."""
    manifest = token_output.write_tokens(docs, common.new_folder(spark, "t"), shard_ids=shard_ids)
    rows = token_output.read_digest(manifest).collect()
    want = sorted((i is not None, i or 0, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t in corpus)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    got = {(r.doc_id, tuple(r.ids)) for r in token_output.read_tokens(manifest).collect()}
    assert got == {(i, tuple(ids_of(t).tolist())) for i, t in corpus}


def test_output_of_nothing(spark, empty):
    manifest = token_output.write_tokens(empty, common.new_folder(spark, "t"))
    assert token_output.read_digest(manifest).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_bins_hold_every_id_once(sizes):
    bins = packing.pack_group(sizes, 16)
    seen = defaultdict(list)
    for b in bins:
        assert sum(n for _, _, n in b) <= 16
        for i, s, n in b:
            seen[i].append((s, n))
    for i, n in enumerate(sizes):
        parts = sorted(seen[i])
        assert [s for s, _ in parts] == [sum(m for _, m in parts[:k]) for k in range(len(parts))] and sum(m for _, m in parts) == n
    assert sum(sum(n for _, _, n in b) < 16 for b in bins) <= 1


def test_tournament_tree_is_first_fit():
    tree, room = packing.TournamentTree(5, 10), [10] * 5
    for size in (6, 5, 4, 4, 7, 3, 5, 1, 2):
        first = next(k for k, r in enumerate(room) if r >= size)
        room[first] -= size
        assert tree.put(size) == first
    with pytest.raises(ValueError):
        tree.put(11)


def test_packing(docs, corpus, ids_of, empty):
    rows = packing.pack_documents(docs, capacity=256, group_bytes=4000).collect()
    want = sorted((i is not None, i or 0, len(ids_of(t))) for i, t in corpus)
    total = sum(w[2] for w in want)
    assert sum(r.length for r in rows) == total
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256
    full = {i: ids_of(t) for i, t in corpus if i is not None and i != 12}
    for r in rows:
        if r.doc_id in full:
            assert r.ids_crc32 == zlib.crc32(full[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(full[r.doc_id])
    assert packing.pack_documents(empty).count() == 0
