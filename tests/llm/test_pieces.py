"""Encoding and decoding with a merge-type vocabulary against the library on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from watchfold.llm import pieces, queries

VOCABULARY = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY))


def digest(ids):
    return hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


ODD = [None, "", " ", "   ", "\n", "\t \n", " lead", "trail ", "a\n\nb\t c", "▁x ▁▁y▁", "中文没有空格" * 60, "x" * 900, "abc" * 700,
       "日本 🤗🤗 \x00\x01 <s> </s> <0x0A> <unk>", "é" * 70, "　 wide", "the" * 100 + "ing" * 90, "word " * 30000, " ́é"]


def test_every_row_of_the_table(spark, sf, library):
    rows = queries.piece_encoding(spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "", add_bos=True, add_eos=True)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), digest(ids))
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_texts_null_ids_and_repeated_rows(texts, library):
    rng = random.Random(5)
    made = ["".join(rng.choice("ab \n\té中🤗▁the") for _ in range(rng.randrange(90))) for _ in range(400)]
    docs = texts(*[(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(ODD + made)], (1, "twice"), (1, "twice"))
    got = sorted(tuple(r.ids) for r in pieces.ids_as_arrays(pieces.encode(docs, begin=False)).collect())
    assert got == sorted(tuple(library.encode(t or "", add_eos=True)) for t in [*ODD, *made, "twice", "twice"])


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(3)
    lists = [[rng.randrange(32000) if rng.random() < .6 else rng.randrange(260) for _ in range(rng.randrange(12))] for _ in range(3000)]
    rows = [(i, bytearray(b"".join(x.to_bytes(4, "little") for x in ids)), "old") for i, ids in enumerate(lists)] + [(-1, None, "old")]
    out = pieces.decode(spark.createDataFrame(rows, "id long, ids binary, decoded string"))
    assert out.columns == ["id", "ids", "decoded"]
    got = {r.id: r.decoded for r in out.collect()}
    assert got.pop(-1) == ""
    assert [got[i] for i in range(len(lists))] == [library.decode(x) for x in lists]


def test_empty_table(texts):
    assert pieces.decode(pieces.encode(texts((1, "a")).limit(0))).collect() == []


def test_agenda_merges_best_pair_first_leftmost_among_equals(library):
    """A plain restatement of the agenda on lists, against both ways of the operator."""
    vocab = pieces.piece_ids(VOCABULARY)

    def plain(text):
        symbols = list(text)
        while True:
            found = [(-library.get_score(library.piece_to_id(a + b)), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))
                     if library.piece_to_id(a + b) > 258]
            if not found:
                break
            k = min(found)[1]
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
        return [library.piece_to_id(s) for s in symbols]

    rng = random.Random(9)
    made = ["▁" + "".join(rng.choice("theinghatsoren") for _ in range(n)) for n in [1, 5, 12, 30, 63, 64, 65, 200]]
    flat, lens = vocab.encode_segments(made)
    assert flat.tolist() == [x for t in made for x in plain(t)]
    assert lens.tolist() == [len(plain(t)) for t in made]


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as format
    model = format.ModelProto()
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = format.TrainerSpec.UNIGRAM
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.PieceIds(str(tmp_path / "other.model"))
