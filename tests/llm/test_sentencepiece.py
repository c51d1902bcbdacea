import random

import pytest
import sentencepiece

from geoloom.llm.sentencepiece import Codec, decode, digests, encode, model_path

PATH = model_path()
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = Codec(PATH)

TEXTS = [
    "", " ", "  ", "a", "Hello  world\n\tx ▁y\x00  é😀", "▁", "▁▁ x", "\n", "\n\n a", "<s> </s> <unk> <0x41>", "   the    quick" + " " * 40 + "fox",
    "日本語のテキスト мир Ελληνικά ß ÄÖÜ", "of of of " * 20, "ofthheonea" * 30, "�​ x", "é", "a" * 300, "\r\n\x0b\x0c",
]


def check(t):
    ids = SP.encode(t, add_eos=True)
    assert CODEC.encode(t) == ids, t
    assert CODEC.decode(ids) == SP.decode(ids), t


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(text):
    check(text)


def test_random_strings():
    rnd = random.Random(7)
    alphabets = ["ab ", "the of and ", "éèàç eu", " \n\t▁", "xyz😀é  ", "".join(map(chr, range(32, 127))), "的一是 在"]
    for _ in range(1500):
        a = rnd.choice(alphabets)
        check("".join(rnd.choice(a) for _ in range(rnd.randrange(40))))
    pieces = [p for p in CODEC.id_of]
    for _ in range(1500):
        check("".join(rnd.choice(pieces) for _ in range(rnd.randrange(8))).replace("▁", " "))


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", __import__("pyspark").sql.functions.lit(1))
    e = encode(df, PATH)
    got = {r.doc_id: r.ids for r in e.collect()}
    assert all(got[i] == SP.encode(t or "", add_eos=True) for i, t in rows)
    assert {r.doc_id: r.text for r in decode(e, PATH).collect()} == {i: SP.decode(SP.encode(t or "")) for i, t in rows}
    import hashlib

    for r in digests(df, PATH).collect():
        ids = SP.encode(dict(rows)[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    assert digests(df.limit(0), PATH).count() == 0


def test_very_long_texts():
    rnd = random.Random(3)
    words = ["the", "of", "thonheea", "é", "日本語", "x1", "\n", "un", "able"]
    check(" ".join(rnd.choice(words) for _ in range(60_000)))
    check("ab" * 20_000)
