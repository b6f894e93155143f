import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "Hello world", "it's   we'll\n\n x\t\ty  ", "naïve façade — über 東京 🙂🙂 é", "<|endoftext|> a<|endoftext|>", "a" * 5000,
    " x y", "1234567 ½ ٣٤", "!!!$$$%%% &&&", "\x00\x01\x7f", "שלום עולם", "  leading", "trailing   ", "x‍y﻿",
]


def test_same_ids_as_the_library():
    own, lib = bpe.codec(bpe.read_spec(PATH)), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(32, 127), 10, 9, 0xE9, 0x5D0, 0x4E2D, 0x1F600, 0xA0, 0x301]]
    texts = TEXTS + ["".join(rng.choices(pool, k=rng.randint(1, 300))) for _ in range(300)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_cuts_are_never_merged_over():
    own = bpe.codec(bpe.read_spec(PATH))
    word = "zq\x07éx~~Qj".encode()
    parts = own.fragments(word)
    assert b"".join(parts) == word and len(parts) > 1
    lib = Tokenizer.from_file(PATH).model
    rng = random.Random(1)
    words = [bytes(rng.choices([*range(32, 127), 0xC3, 0xA9, 7], k=rng.randint(1, 70))) for _ in range(500)] + [b"aaaaaaa", b"ab" * 60]
    want = [[t.id for t in lib.tokenize("".join(own.letters[b] for b in w))] for w in words]
    assert own.merged(words) == want  # cut or not, the ids are the same
    assert [[i for part in own.fragments(w) for i in own._merged_long(part)] for w in words] == want


def test_query(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(50, None, ""), (50, None, ""), (None, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((tuple(r) for r in bpe.encode_documents(docs, PATH).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = bpe.encode_documents(docs, PATH, with_ids=True)
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, PATH).collect()}[4] == TEXTS[4]
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(bpe.read_spec(public_tokenizers.path("word_bpe_49k.json")))
