import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortia.llm import pieces, tokenfile
from cohortia.llm.queries import tokenizer_path

ODD = [*"aAbe.,!'#3 \n\t\r\x0b\x85é́ßİΣ漢\x00<|>", "▁", "​", "�", "ﬁ", "😀", "the", "tion", " The", "   ", "'s", "<s>", "</s>", "<0x41>", "<|endoftext|>", "<|ENDOFTEXT|>", "ΟΔΟΣ"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return pieces.load_model(tokenizer_path("piece_bpe_32k.model"))


def test_codec_is_the_library(library, model):
    code = pieces.Codec(model)
    for text in [*random_texts(4000, 1), "a" * 3000, " " * 2000, "haha" * 800, "ab" * 999 + "  "]:
        ids = library.encode(text)
        assert code.encode(text) == [*ids, library.eos_id()]
        assert code.decode(ids) == library.decode(ids)


def test_backtracking_agrees_with_merging(model):
    code = pieces.Codec(model)
    for text in random_texts(1500, 7):
        unit = pieces.SPACE + text.replace(" ", pieces.SPACE)
        merged = [i for part in code.merge(unit) for i in ([model.pieces[part]] if part in model.pieces else code._bytes(part))]
        assert code.unit_ids(unit) == merged


def test_encoded_table(spark, make, odd_rows, library, model):
    got = pieces.encode_texts(make(odd_rows).withColumnRenamed("lang", "ids"), model).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = [*library.encode(text or ""), library.eos_id()]
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids))) for r in got)
    assert pieces.encode_texts(make([]), model).count() == 0


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    encode, whole = tokenfile.WordEncoder(tokenfile.load_tokenizer(path)[0]), Tokenizer.from_file(path)
    for a in range(0, 4000, 500):
        part = random_texts(500, a)
        ids, at = encode(pa.array(part))
        for k, text in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_tokenizers_that_join_words_are_refused():
    with pytest.raises(ValueError):
        tokenfile.load_tokenizer(tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("vocabulary", [2, 300, 8191, 49408, 65536, 65537, 10**6])
def test_bits_and_random_access(vocabulary):
    bits = tokenfile.id_bits(vocabulary)
    assert 2 ** (bits - 1) < vocabulary <= 2**bits
    rng = np.random.default_rng(vocabulary)
    texts = [rng.integers(0, vocabulary, n).astype(np.uint32) for n in (0, 1, 70_000, 5, 300_000, 0, 17)]
    raw = io.BytesIO()
    writer = tokenfile.Writer(raw, bits)
    for k, ids in enumerate(texts):
        writer.add(k if k else None, ids)
    head = writer.close()
    size = sum(map(len, texts))
    assert head["n_ids"] == size and len(raw.getvalue()) < size * bits / 8 + 2000
    file = tokenfile.Reader(pa.BufferReader(raw.getvalue()))
    for k, ids in enumerate(texts):
        assert (file.document(k) == ids).all()
    flat = np.concatenate(texts)
    for a, b in ((0, 1), (32_767, 32_770), (100_000, 250_001), (size - 3, size)):
        assert (file.ids(a, b) == flat[a:b]).all()
    assert file.has_id.tolist() == [0, 1, 1, 1, 1, 1, 1]


def test_files_of_a_table(spark, make, odd_rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    docs = make(odd_rows).withColumnRenamed("source", "__file")
    manifest = tokenfile.write_token_files(docs, path, end_id=1, file_bytes=200_000)
    assert manifest.count() > 1
    got = sorted(tokenfile.read_token_files(manifest).collect(), key=lambda r: (r.start, r.n_tokens))
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert tokenfile.read_token_files(tokenfile.write_token_files(make([]), path)).count() == 0
