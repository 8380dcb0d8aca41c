"""Encoding, counting, packing and shards against the public libraries."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from slotwise.llm import bpe, library_tokens, packing, token_counts, wavelet
from slotwise.llm.defaults import BYTE_RANKS, BYTE_TOKENIZER, WORD_TOKENIZER
from slotwise.llm.queries import LLM_QUERIES
from slotwise.sources.staging import staging_path


def _ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_RANKS, "rb"))}


@pytest.fixture(scope="module")
def public_bpe():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def own_bpe():
    return bpe.vocabulary(BYTE_RANKS)


def _library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_ids():
    return _library(BYTE_TOKENIZER)


@pytest.fixture(scope="module")
def word_ids():
    return _library(WORD_TOKENIZER)


def test_hash_is_minimal_and_perfect():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.MinimalPerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(3000))
    assert all(h.slot(k) == s for k, s in zip(keys, h.slot_of_key))


ALPHABET = "ab, ' \n\tsÉß1.!日\xa0\x85🎉"


FRAGMENTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", ".", ", ", ". ", ".\n", "...", "!, ", "word",
             "Word", "don't", "É", "É", "ΑΣ", "İ", "K", "12", "я, ", "ß. ", "×. ", "\t", "\r\n", "  "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=20) | st.lists(
    st.sampled_from(FRAGMENTS), max_size=12).map("".join), max_size=4))
def test_any_text_like_the_libraries(public_bpe, own_bpe, byte_ids, word_ids, texts):
    for encode, want in (
        (own_bpe.encode_texts, public_bpe.encode_ordinary),
        (library_tokens.library_tokens(BYTE_TOKENIZER, True).encode_texts, byte_ids),
        (library_tokens.library_tokens(WORD_TOKENIZER, False, lower_case=True).encode_texts, word_ids),
    ):
        ids, lengths = encode(texts)
        parts = np.split(ids, np.cumsum(lengths)[:-1]) if texts else []
        assert [p.tolist() for p in parts] == [want(t) for t in texts]


def test_names_of_special_tokens_are_ids_of_their_own(byte_ids, word_ids):
    text = "a <|endoftext|> b"
    assert byte_ids(text) == [64, 220, 50256, 275] and word_ids(text) == [320, 49407, 321]
    for path, space, want in ((BYTE_TOKENIZER, True, byte_ids), (WORD_TOKENIZER, False, word_ids)):
        assert library_tokens.library_tokens(path, space, not space).encode_texts([text])[0].tolist() == want(text)


def test_a_full_piece_table_forgets_and_goes_on(byte_ids, monkeypatch):
    monkeypatch.setattr(library_tokens, "MEMO_ENTRIES", 6)
    tokens = library_tokens.LibraryTokens(BYTE_TOKENIZER, True)
    for i in range(12):
        texts = [f"word{i} some other{i % 3} words, here", "", "  twice  spaced", "a <|endoftext|>", f"word{i - 1} again"]
        ids, lengths = tokens.encode_texts(texts)
        assert [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])] == [byte_ids(t) for t in texts]


def test_piece_hashes_tell_pieces_apart():
    pieces = sorted({chr(97 + i % 26) * (i % 40) + str(i % 97) for i in range(5000)} | {"", "\x00", "\x00\x00", "ab", "ba", "é"})
    first, second = library_tokens.piece_hashes(library_tokens.pa.array(pieces))
    assert len(set(first.tolist())) == len(set(second.tolist())) == len(pieces)
    part = library_tokens.pa.array(pieces).slice(7, 20)
    assert library_tokens.piece_hashes(part)[0].tolist() == first[7:27].tolist()


def test_memo_keeps_early_pieces():
    memo = bpe.PieceMemo(lambda pieces: bpe.joined([[ord(c) for c in p] for p in pieces]), 4)
    for texts in ([["a", "b", "c"]], [["d", "e", "ff"], []], [["a", "ff", "c"]]):
        ids, lengths = memo.encode(texts)
        assert "".join(map(chr, ids)) == "".join(p for own in texts for p in own)
        assert lengths.tolist() == [sum(map(len, own)) for own in texts]


def test_op1(spark, sf_dir, docs, public_bpe):
    got = {r.doc_id: r for r in LLM_QUERIES["op1_byte_bpe"](spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = public_bpe.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((r.text or "").encode()).hexdigest())


def test_op1_edges(edge_docs, no_docs, public_bpe):
    rows = {(r.doc_id, r.text) for r in edge_docs.collect()}
    got = bpe.encode(edge_docs, BYTE_RANKS).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        text = bytes(r.decoded).decode()
        assert (r.doc_id, text) in rows or (r.doc_id, None) in rows and text == ""
        assert r.ids == public_bpe.encode_ordinary(text)
    assert bpe.encode(no_docs, BYTE_RANKS).count() == 0


def test_op2(spark, docs, edge_docs, no_docs, public_bpe):
    for frame in (docs, edge_docs):
        lengths = np.array([len(public_bpe.encode_ordinary(r.text or "")) for r in frame.collect()])
        histogram = token_counts.length_histogram(frame, BYTE_RANKS)
        rows = token_counts.context_totals(histogram).collect()
        assert sorted(r.n_tokens for r in rows) == sorted(set(lengths.tolist()))
        for r in rows:
            limit = r.n_tokens
            assert (r.n_docs, r.docs_longer, r.docs_up_to) == (
                (lengths == limit).sum(), (lengths > limit).sum(), (lengths <= limit).sum())
            assert (r.truncated_total, r.tokens_cut) == (
                np.minimum(lengths, limit).sum(), np.maximum(lengths - limit, 0).sum())
            assert (r.tokens_up_to, r.tokens_longer) == (lengths[lengths <= limit].sum(), lengths[lengths > limit].sum())
        at = {r.context_limit: r for r in token_counts.at_limits(histogram, [1, 512, 10**9]).collect()}
        assert at[512].truncated_total == np.minimum(lengths, 512).sum() and at[10**9].tokens_cut == 0
        q = {r.share: r.n_tokens for r in token_counts.quantile_lengths(
            token_counts.context_totals(histogram), [0.5, 1.0]).collect()}
        assert q[1.0] == lengths.max() and q[0.5] == np.sort(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.context_totals(token_counts.length_histogram(no_docs, BYTE_RANKS)).count() == 0


def check_packing(rows, ids_of, capacity):
    """Every token in one piece, sequences gapless and within the capacity; the share of padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    padding = filled = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        filled += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for doc, own in by_doc.items():
        at, ids = 0, ids_of(doc)
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            piece = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.tokens if "tokens" in r else r.ids_crc32) == (piece if "tokens" in r else zlib.crc32(piece))
            at += r.length
        assert at == len(ids)
    return padding / max(1, padding + filled)


def test_op3(spark, sf_dir, docs, byte_ids):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = LLM_QUERIES["op3_harmonic_packing"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert check_packing(rows, lambda d: [*byte_ids(texts[d]), 0], 1024) < 0.01


def test_op3_edges(edge_docs, no_docs, byte_ids):
    unique = edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in unique.collect()}
    rows = packing.pack(unique, BYTE_TOKENIZER, 0, 256).collect()
    assert check_packing(rows, lambda d: [*byte_ids(texts[d]), 0], 256) < 0.05
    assert packing.pack(edge_docs, BYTE_TOKENIZER, 0).where("start = 0").count() == edge_docs.count()
    assert packing.pack(no_docs, BYTE_TOKENIZER, 0).count() == 0
    with pytest.raises(ValueError):
        packing.Bins(1000, 0)


def test_tail_classes_take_a_fixed_count():
    bins = packing.Bins(1024, 0)
    done = [p for i in range(200) for p in bins.add(i, 40)]
    assert len(done) % (1024 // 40) == 0 and {p[3] for p in done} == set(range(200 // 25))
    rest = list(bins.finish())
    assert sum(p[2] for p in done + rest) == 200 * 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.sampled_from([8, 64, 1 << 17]))
def test_wavelet_matrix(ids, block):
    ids = np.array(ids, np.uint32)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 9, block).to_bytes())
    assert m.decode().tolist() == ids.tolist()
    assert [m.access(i) for i in range(len(ids))] == ids.tolist()
    for symbol in {*ids.tolist()[:5], 7, 511, 4000}:
        places = np.flatnonzero(ids == symbol)
        assert m.rank(symbol) == len(places)
        assert m.rank(symbol, len(ids) // 2) == (places < len(ids) // 2).sum()
        assert [m.select(symbol, k) for k in range(len(places))] == places.tolist()
    with pytest.raises(IndexError):
        m.access(len(ids))


def test_wavelet_matrix_checks_width():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([16]), 4)
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"none of ours")


def test_op4(spark, sf_dir, docs, word_ids):
    got = {r.doc_id: r for r in LLM_QUERIES["op4_wavelet_shards"](spark, sf_dir).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*word_ids(r.text or ""), 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_op4_edges(spark, edge_docs, no_docs, word_ids, monkeypatch):
    path = staging_path(spark, "test-shards")
    wavelet.write_shards(edge_docs, WORD_TOKENIZER, 2, path)
    rows = sorted(wavelet.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == edge_docs.count()
    assert [r.doc_id is None for r in rows] == sorted((r.doc_id is None for r in rows), reverse=True)
    named = [r.doc_id for r in rows if r.doc_id is not None]
    assert named == sorted(named)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    everything = b"".join(bytes(r.tokens) for r in rows)
    ids = np.frombuffer(everything, "<u4")
    found = wavelet.occurrences(spark, path, 2, 100).collect()
    assert sorted(p for r in found for p in r.places) == np.flatnonzero(ids == 2).tolist()
    empty = staging_path(spark, "test-shards")
    wavelet.write_shards(no_docs, WORD_TOKENIZER, 2, empty)
    assert wavelet.read_documents(spark, empty).count() == 0
