import random

import pytest

from tessera.llm.encoding import Encoder, count_tokens, decode_documents, encode_documents, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id bigint, text string, ids string, n_tokens int"
TEXTS = [
    None, "", " ", "   ", "hello", "Hello world!", "It's we'll they've 's't", "a" * 30000, "ab" * 20000, "é" * 2000, " " * 500 + "x", "=-" * 900, "<|endoftext|>", "\n\n\n \t x\r\n",
    "日本語テキスト", "😀😀 😀", "aaaa aaa aa", "x​y ﬁ Å", "1234567890 12 3", "word" * 40, "\u0000\u0001",
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(spark, library):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("abcdefgh") for _ in range(9000)), "".join(chr(rnd.randint(32, 0x2FF)) for _ in range(3000))]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)] * 2, SCHEMA)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    rows = encode_documents(df).collect()
    assert len(rows) == 2 * len(texts) and all(r.ids == want[r.doc_id] for r in rows)
    back = {r.doc_id: r.text for r in decode_documents(encode_documents(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, "doc_id").collect()} == {i: len(v) for i, v in want.items()}


def test_words_of_every_length_equal_contracting_the_leftmost_pair_again_and_again():
    rnd = random.Random(7)
    e = Encoder(vocabulary_path())
    rank = {(a, b): (r, m) for a, b, m, r in e.db.execute("SELECT a, b, merged, rank FROM merges").fetchall()}
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(2, 150))) for _ in range(100)] + ["a" * n for n in range(1, 40)] + ["ab" * 200 + "abc" * 90]
    e.learn(words)
    for w in words:
        tokens = e.byte_ids[list(w.encode())].tolist()
        while True:
            found = min(((*rank[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in rank), key=lambda x: (x[0], x[2]), default=None)
            if found is None:
                break
            tokens[found[2] : found[2] + 2] = [found[1]]
        assert tokens == e.words[w].tolist()


def test_words_are_forgotten_when_too_many(monkeypatch):
    from tessera.llm import encoding

    monkeypatch.setattr(encoding, "KEPT_WORDS", 5)
    e = Encoder(vocabulary_path())
    ids, n = e.encode(["one two three four", "five six seven eight", "one nine"])
    again = [len(e.encode([t])[0]) for t in ("one two three four", "five six seven eight", "one nine")]
    assert n.tolist() == again and len(ids) == sum(again)


def test_no_documents(spark):
    assert encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0
