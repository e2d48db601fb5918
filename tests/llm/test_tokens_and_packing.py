from __future__ import annotations

import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamperlens.llm.common import Scratch
from tamperlens.llm.packing import Projection, cut, hilbert_keys, pack_documents
from tamperlens.llm.queries import vocabulary
from tamperlens.llm.simple8b import pack, read_file, unpack, write_file
from tamperlens.llm.token_files import FILES, read_token_files, write_token_files
from tamperlens.llm.tokens import PieceEncoder, ShortPieces, drop_encoders, short_keys


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(vocabulary())


def direct(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab SsTrevVlmd'' \n\t\r12éÿſ!.×\x1c\xa0日<|"), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_pieces_equal_whole_texts(encoder, texts):
    ids, counts = encoder.encode(texts)
    want = direct(encoder, texts)
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_encoder_forgets_and_reads_special_strings_as_text(encoder):
    small = PieceEncoder(vocabulary(), most_pieces=3)
    texts = ["one two three four five", "<|endoftext|> six", None, "", "seven' 's it's we'll"] * 3
    for e in (small, encoder):
        ids, counts = e.encode(texts)
        assert ids.tolist() == [i for w in direct(e, texts) for i in w]


def test_known_short_pieces_make_no_strings(monkeypatch):
    """op5: pieces of up to 16 bytes that are known are found by their bytes."""
    encoder = PieceEncoder(vocabulary())
    asked = []

    class Asked(dict):
        def get(self, piece, other=None):
            asked.append(piece)
            return super().get(piece, other)

    encoder.slot = Asked()
    texts = ["a bé " + "x" * 15 + " " + "y" * 16 + " " + "z" * 17 + " ü" + "é" * 7, "b a's 12345 !?", "nul\0 nul \0\0"]
    want = [i for w in direct(encoder, texts) for i in w]
    assert encoder.encode(texts[:2])[0].tolist() == [i for w in direct(encoder, texts[:2]) for i in w]
    asked.clear()
    for _ in range(2):
        assert encoder.encode(texts[:2])[0].tolist() == [i for w in direct(encoder, texts[:2]) for i in w]
    # longer than 16 bytes: the sixteen y and the seventeen z with their blanks, and é
    assert set(asked) == {" " + "y" * 16, " " + "z" * 17, " ü" + "é" * 7}
    for _ in range(2):
        assert encoder.encode(texts)[0].tolist() == want


@pytest.mark.parametrize("bits", [3, 6, 12])
def test_short_pieces_equal_a_dictionary(bits):
    rng = np.random.default_rng(3)
    table, known = ShortPieces(bits), {}
    for _ in range(40):
        words = {"".join(rng.choice(list("abé"), rng.integers(1, 12))) for _ in range(rng.integers(1, 30))}
        pieces = sorted(words)
        short, low, high = short_keys(pa.array(pieces))
        assert [pieces[i] for i in short] == [w for w in pieces if len(w.encode()) <= 16]
        found = table.find(low, high)
        assert all(slot in (-1, known.get(pieces[i])) for i, slot in zip(short, found.tolist()))
        new = np.flatnonzero(found < 0)
        fits = table.held + len(new) <= 3 * 2**bits // 4
        slots = np.array([known.setdefault(pieces[short[i]], len(known)) for i in new], np.int32)
        table.add(low[new], high[new], slots)
        assert (table.find(low, high) >= 0).all() or not fits


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**32 - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    values = np.array(ids, np.uint32)
    assert (unpack(*pack(values), len(values)) == values).all()
    content = write_file(values, np.array([5, 0]), np.array([True, False]), np.array([len(ids), 0]))
    back, docs, known, lengths = read_file(content)
    assert (back == values).all() and docs.tolist() == [5, 0] and known.tolist() == [True, False]
    assert lengths.tolist() == [len(ids), 0]


def test_token_files_are_read_some_documents_at_a_time(spark, documents):
    folder = Scratch(spark, "test").path("files")
    write_token_files(documents, folder, vocabulary())
    whole = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert sorted(read_token_files(spark, folder, 1000).collect(), key=lambda r: r.start) == whole


def test_reading_drops_the_encoders_of_a_worker(monkeypatch):
    held = types.ModuleType("_tamperlens_worker")
    held.encoders = {"some path": object()}
    monkeypatch.setitem(sys.modules, "_tamperlens_worker", held)
    drop_encoders()
    assert not hasattr(held, "encoders")


def test_token_files(spark, documents, odd_documents, no_documents, encoder):
    for df in (documents, odd_documents):
        folder = Scratch(spark, "test").path("files")
        write_token_files(df, folder, vocabulary(), ids_per_file=5000)
        got = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.start)
        rows = df.select("doc_id", "text").collect()
        known = [r.doc_id for r in got if r.doc_id is not None]
        assert known == sorted(known) and len(got) == len(rows)
        want = {}
        for r, ids in zip(rows, direct(encoder, [r.text for r in rows])):
            want.setdefault(r.doc_id, []).append(np.array([*ids, 0], "<u4").tobytes())
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens * 4 == len(r.ids) and bytes(r.ids) in want[r.doc_id]
            at += r.n_tokens
        assert spark.read.schema(FILES).parquet(folder).count() > 1
    folder = Scratch(spark, "test").path("files")
    write_token_files(no_documents, folder, vocabulary())
    assert read_token_files(spark, folder).count() == 0


def test_hilbert_curve_visits_neighbours():
    bits, dims = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_cut():
    doc, start, length, sequence, offset = cut(np.array([3, 5, 2]), 1, 4)
    assert list(zip(doc, start, length, sequence, offset)) == [
        (0, 0, 3, 0, 1), (1, 0, 4, 1, 0), (1, 4, 1, 2, 0), (2, 0, 2, 2, 1)
    ]


def test_packing(documents, odd_documents, no_documents, encoder):
    for df, most in ((documents, 2048), (odd_documents, 64)):
        rows = df.select("doc_id", "text").collect()
        want = {}
        for r, ids in zip(rows, direct(encoder, [r.text for r in rows])):
            want.setdefault(r.doc_id, []).append([*ids, 1])
        pieces = pack_documents(df, vocabulary(), length=most).collect()
        sequences, total = {}, 0
        for p in pieces:
            ids = np.frombuffer(p.ids, "<u4")
            total += len(ids)
            assert len(ids) == p.length > 0
            assert any(len(d) == p.doc_tokens and d[p.start : p.start + p.length] == ids.tolist() for d in want[p.doc_id])
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert total == sum(len(d) for docs in want.values() for d in docs)
        for parts in sequences.values():
            ends = [o + n for o, n in sorted(parts)]
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= most
        assert total >= (len(sequences) - 8) * most
        again = pack_documents(df, vocabulary(), length=most).collect()
        assert sorted((p.sequence_id, p.offset, p.ids) for p in again) == sorted((p.sequence_id, p.offset, p.ids) for p in pieces)
    assert pack_documents(no_documents, vocabulary()).count() == 0


def test_copies_are_neighbours():
    data = [b"the same text of words", b"the same text of words", b"0123456789 9876543210"]
    joined, sizes = b"".join(data), np.array([len(d) for d in data])
    cells = Projection().cells(np.frombuffer(joined + b"\0\0", np.uint8), np.cumsum(sizes) - sizes, sizes)
    spread = np.abs(cells - cells[0]).sum(axis=1)
    assert spread[1] < spread[2]


def test_digest_is_crc32(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\0\0\0"),)], "ids binary")
    assert df.selectExpr("crc32(ids) AS c").first().c == zlib.crc32(b"\x01\0\0\0")


def test_added_tokens_as_in_the_library(encoder):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "plain words", None, "<|endof", "text|> on", "é<|endoftext|>", "日<|endoftext|>", "<|endoftext|>"]
    want = [e.ids for e in Tokenizer.from_file(vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    assert len(want[-1]) == 1
