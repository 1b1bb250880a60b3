"""Packing, byte-pair encoding, binary records, token counts: against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from chatsieve.llm import bpe, bytelevel, counts, packing, records
from tests.llm.cases import ODD, none, odd, prose

PARTS = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "　", "a", "th", "ing", "Bé", "12", "!?", "'s", "'ll", "<|endoftext|>", "日本", "😀", "​", "\r\n", "ß", "aaaa", "ab", "\x00"]


def strings(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bytelevel.default_file())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_cut_texts_give_the_library_s_ids(library):
    texts = strings(3000, 1) + ["word " * 5000, "x" * 5000]
    assert [records.ids_of(x) for x in bytelevel.library_encoder(bytelevel.default_file())(texts)] == [ids_of(library, t) for t in texts]


def test_backtracking_gives_exact_merges(library):
    encoder, decoder = bpe.BacktrackingEncoder(bytelevel.default_file()), bpe.OffsetDecoder(bytelevel.default_file())
    for text in strings(3000, 2) + ["a" * 20_000, "ab" * 9_000]:
        ids = encoder(text)
        assert ids == ids_of(library, text)
        assert list(decoder(np.array(ids, np.int64), np.array([0, len(ids)]))) == [library.decode(ids, skip_special_tokens=False)]


def test_encode_and_decode_tables(spark, library):
    coded = bpe.bpe_encode(odd(spark))
    rows = bpe.bpe_decode(coded.withColumnRenamed("doc_id", "decoded_id")).collect()
    assert sorted((r.decoded_id or 0, r.decoded) for r in rows) == sorted((i or 0, t or "") for i, t, _ in ODD)
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert all(got[i] == ids_of(library, t) for i, t, _ in ODD)
    assert bpe.bpe_decode(bpe.bpe_encode(none(spark))).count() == 0


def pieces_hold(rows, texts, library, size):
    for i in {r.doc_id for r in rows}:
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        if sum(t[0] == i for t in texts) == 1:
            whole = np.array(ids_of(library, next(t[1] for t in texts if t[0] == i)) + [1], "<u4").tobytes()
            assert b"".join(bytes(r.ids) for r in mine) == whole
            assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
            assert all(r.doc_tokens * 4 == len(whole) for r in mine)
    lengths = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert all(n <= size for n in lengths.values())
    assert sum(n < size for n in lengths.values()) <= 1


@pytest.mark.parametrize("windows", [1, 4])
def test_packing_keeps_every_id_once_without_padding(spark, library, windows):
    rows = packing.pack_sequences(odd(spark), size=64, open_windows=windows).collect()
    pieces_hold(rows, ODD, library, 64)
    assert packing.pack_sequences(none(spark)).count() == 0
    some = [(i, t) for i, t in enumerate(prose(200))]
    pieces_hold(packing.pack_sequences(spark.createDataFrame(some, "doc_id long, text string").repartition(5), size=128).collect(), some, library, 128)


def test_best_fit_takes_the_fullest_window_that_has_room():
    windows = packing.OpenWindows(10, 2)
    cut = lambda piece, n: (piece[:n], piece[n:])
    assert list(windows.place("aaaaaa", 6, cut)) == [] and list(windows.place("bbbbbbb", 7, cut)) == []
    assert list(windows.place("ccc", 3, cut)) == [["bbbbbbb", "ccc"]]
    assert list(windows.place("ddddd", 5, cut)) == [] and list(windows.place("eeeeee", 6, cut)) == [["aaaaaa", "eeee"]]
    assert sorted(w[0] for w in windows.open) == [7]


def test_records_round_trip(spark, library):
    index = records.write_records(odd(spark))
    rows = records.read_records(index).join(records.file_starts(index), "part").collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    rows = sorted(rows, key=lambda r: r.base + r.start_in_file)
    assert [r.doc_id for r in rows] == [r[0] for r in order]
    assert [records.ids_of(r.ids) for r in rows] == [ids_of(library, t[1]) + [0] for t in order]
    assert [r.base + r.start_in_file for r in rows] == np.cumsum([0] + [len(r.ids) // 4 for r in rows])[:-1].tolist()
    some = records.read_records(index.where("doc_id in (7, 3)").orderBy("n_tokens")).collect()
    assert {r.doc_id for r in some} == {3, 7}
    empty = records.write_records(none(spark))
    assert records.read_records(empty).count() == 0


def test_broken_records_are_told(library):
    record = records.framed(5, bytelevel.little_endian([1, 70_000]))
    assert records.unframed(record) == (5, bytelevel.little_endian([1, 70_000]))
    assert records.unframed(records.framed(None, b"")) == (None, b"")
    for place in (0, 9, 14, len(record) - 1):
        broken = bytearray(record)
        broken[place] ^= 1
        with pytest.raises(records.BrokenRecord):
            records.unframed(bytes(broken))
    with pytest.raises(records.BrokenRecord):
        records.unframed(record[:-1])


def test_counts_follow_the_tokenizer_s_ties(spark):
    from tokenizers import Tokenizer, models
    pieces = counts.pieces_of(counts.default_file())
    for vocabulary, fallback in ((pieces, True), ([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("ab", -1.5), ("b▁a", -0.5)], False)):
        tokenizer, counter = Tokenizer(models.Unigram(vocabulary, 0, fallback)), counts.UnigramCounter(vocabulary)
        for text in strings(2000, 3) + ["aab aaa  abx yz a", "xyz", "a" * 3000]:
            assert counter.count(text) == (len(tokenizer.encode("▁" + text.replace(" ", "▁")).ids) if text else 0), text
    got = counts.count_tokens(odd(spark)).collect()
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (2, 3)} == {2: 0, 3: 0} and len(got) == len(ODD)
    assert counts.count_tokens(none(spark)).count() == 0


def test_texts_do_not_match_marks_and_bytes():
    """Such strings count as the tokenizer's own encoder has them: as letters, the same with a space in between that the marks don't have."""
    path = counts.default_file()
    odd_ones = counts.unmatched_pieces(path)
    assert {"<unk>", "<s>", "</s>", "<0x41>"} <= odd_ones and len(odd_ones) == 259
    counter, plain = counts.UnigramCounter(counts.pieces_of(path), odd_ones), counts.UnigramCounter([x for x in counts.pieces_of(path) if x[0] not in odd_ones])
    for text in ("<s>gone</s>", "a <0x41> b", "<unk>", "</s></s>"):
        assert counter.count(text) == plain.count(text) > len(text.split())


def test_queries_give_the_contract_s_digests(spark, tmp_path, library):
    from chatsieve.llm import queries as Q
    some = [(i, t) for i, t in enumerate(prose(40) + ["", "x  y \n z"])] + [(50, None)]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in Q.op5_bpe(spark, str(tmp_path)).collect():
        text = dict(some)[r.doc_id] or ""
        ids = ids_of(library, text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    import zlib
    at = 0
    for r in Q.op9_binary_records(spark, str(tmp_path)).orderBy("doc_id").collect():
        ids = np.array(ids_of(library, dict(some)[r.doc_id]) + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: r.n_tokens for r in Q.op6_token_counts(spark, str(tmp_path)).collect()}[50] == 0
    assert sum(r.length for r in Q.op3_packing(spark, str(tmp_path)).collect()) == at
