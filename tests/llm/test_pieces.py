import random

import numpy as np
import public_tokenizers
import sentencepiece
from quern.llm.piece_frames import decode_pieces, encode_pieces
from quern.llm.pieces import PieceEncoder, SuffixIndex

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  ", " ", "a  b", "   lead", "trail   ", "x" * 300, "日本語テキスト 🎉 emoji", "tab\tnew\nline\r\n", " ▁ under▁score", "The quick brown fox don't   know", "a" * 5000, " " * 40 + "z" + " " * 17, " " * 600, "<s> </s> <0x41> <unk>", "\0 nul \0\0", "internationalization, unbelievable naïveté; 12345 67.89 http://example.com/p?x=1"]


def texts():
    pick = random.Random(3)
    return ODD + ["".join(pick.choice("abcdefth eionrsé  \n▁") for _ in range(150)) for _ in range(300)] + ["".join(pick.choice("aab ") for _ in range(60)) for _ in range(200)]


def test_ids_and_texts_equal_the_library():
    library, coder = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceEncoder(MODEL)
    for _ in range(2):  # new words, then remembered ones
        coded = [np.frombuffer(c, "<i4").tolist() for c in coder.encode_batch(texts())]
        assert coded == library.encode(texts())
    assert [coder.decode(c) for c in coded] == library.decode(coded)
    broken = [[228, 189], [coder.model.ids["▁a"], 200, 3, 1, 2], [], [0]]
    assert [coder.decode(c) for c in broken[:3]] == [library.decode(c) for c in broken[:3]]


def test_suffix_index_finds_all_occurrences():
    text = "banana bandana\0ana"
    index = SuffixIndex(text, 4)
    patterns = ["ana", "ban", "na", "x", "a", "and", "\0an"]
    found = {patterns[r]: sorted(index.order[a:b].tolist()) for r, a, b in zip(*index.ranges(patterns))}
    assert found == {p: [i for i in range(len(text)) if text.startswith(p, i)] for p in patterns if p in text}


def test_frames(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(None, "x", 1), (3, None, 2), (3, "again", 2)]
    out = encode_pieces(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), MODEL, check=True)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted((str(r["id"]), r["ids"]) for r in out.collect()) == sorted((str(i), library.encode(t or "")) for i, t, _ in rows)
    assert all(r["decoded_equal"] for r in out.collect() if r["id"] != 9)
    back = decode_pieces(out.select("id", "ids"), MODEL)
    assert sorted((str(r["id"]), r["text"]) for r in back.collect()) == sorted((str(i), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert encode_pieces(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
