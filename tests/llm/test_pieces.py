import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from wayline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "   ", "a", "Hello world", "  two  spaces\n\n\tx ", "▁▁ a▁b", "é😀漢字​", "123 45.6", "<s> </s> <unk> <0x41>", "\x00a\x00", "x" * 3000, " " * 100, "�", "naïve café", "word " * 20_000, "漢😀" * 200]


def texts(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("ab cde\n\t▁é漢😀<>0x41.,  ") for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_ids_spans_and_text_are_the_librarys():
    m, all_texts = pieces.Model(open(PATH, "rb").read()), ODD + texts(3, 800)
    ids, starts, ends, rows = m.encode(pa.array(all_texts), True, True)
    decoded = m.decode(ids, rows).to_pylist()
    for k, t in enumerate(all_texts):
        got = ids[rows[k] : rows[k + 1]].tolist()
        assert got == LIB.encode(t, add_bos=True, add_eos=True) and decoded[k] == LIB.decode(got)
    ids, starts, ends, rows = m.encode(pa.array(all_texts), False, False)
    for k, t in enumerate(all_texts):
        own = slice(rows[k], rows[k + 1])
        assert list(zip(starts[own].tolist(), ends[own].tolist())) == [(p.begin, p.end) for p in LIB.encode(t, return_type="proto").pieces], t


def test_any_ids_decode_as_in_the_library():
    m, draw = pieces.Model(open(PATH, "rb").read()), random.Random(5)
    lists = [[draw.choice([draw.randrange(32000), draw.randrange(3, 259), 0, 1, 2, 260]) for _ in range(draw.randint(0, 9))] for _ in range(3000)]
    rows = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    assert m.decode(np.array(sum(lists, [])), rows).to_pylist() == [LIB.decode(x) if x else "" for x in lists]
    with pytest.raises(ValueError):
        m.decode(np.array([32000]), np.array([0, 1]))


@pytest.mark.parametrize("trim", [True, False])
def test_longest_prefixes_of_a_character_map(trim):
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", remove_extra_whitespaces=trim, add_dummy_prefix=True, escape_whitespaces=True)
    spec = dict(pieces._fields(dict(pieces._fields(lib.serialized_model_proto()))[3]))
    m, draw = pieces.Model(open(PATH, "rb").read()), random.Random(7)
    m.chars, m.trim = pieces.CharMap(spec[2]), trim
    for _ in range(1500):
        t = "".join(draw.choice("aé①㌀ﬁＡ　 \t\n​﻿㍿½Å가é  ") for _ in range(draw.randint(0, 20)))
        out, source = m.normalise(t.encode())
        want, places = lib.normalize(t, with_offsets=True)
        assert out.decode() == want.replace("▁", " ")
        assert [source[len(want[:k].replace("▁", " ").encode())] for k in range(len(want) + 1)] == [len(t[:k].encode()) for k in places]


def test_the_heap_and_the_short_way_merge_alike(monkeypatch):
    m, all_texts = pieces.Model(open(PATH, "rb").read()), [t.encode().replace("▁".encode(), b" ") for t in texts(9, 300)]
    short = [m.merge(t) for t in all_texts]
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert [m.merge(t) for t in all_texts] == short


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_KEPT", 10)
    m = pieces.Model(open(PATH, "rb").read())
    for t in texts(11, 50):
        assert m.encode(pa.array([t]), True, True)[0].tolist() == LIB.encode(t, add_bos=True, add_eos=True)


def test_frames(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (2, None, None), (3, "", None), (None, "é 😀", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    full = pieces.encode(docs, PATH).collect()
    assert len(full) == 5
    for r, (_, t, _) in zip(full, rows):
        assert r.ids == LIB.encode(t or "", add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) and len(r.starts) == len(r.ends) == len(r.ids)
    packed = pieces.decode(pieces.encode(docs, PATH, packed=True), PATH).collect()
    assert [r.decoded for r in pieces.encode(docs, PATH, packed=True, decoded=True).collect()] == [r.decoded for r in packed]
    plain = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert [r.decoded for r in packed] == [r.decoded for r in plain] == ["a b", "a b", "", "", "é 😀"]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in packed] == [r.ids for r in full]
    empty = docs.limit(0)
    assert pieces.decode(pieces.encode(empty, PATH), PATH).collect() == []
    other = spark.createDataFrame([("p", None)], "name string, body string")
    assert pieces.encode(other, PATH, "name", "body", begin=False, end=False).first().ids == []
    assert pieces.decode(spark.createDataFrame([(None, [1, 259])], "k int, ids array<int>"), PATH, keep=("k",)).first().decoded == LIB.decode([1, 259])


def test_query(spark):
    from wayline.llm.queries import op11_sentencepiece

    got = {r.doc_id: r for r in op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = LIB.encode(text or "", add_bos=True, add_eos=True)
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(ids).encode()).hexdigest())
