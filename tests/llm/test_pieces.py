"""Encoding against the library, against a plain agenda, and as a round trip."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
import sentencepiece

from lexspan.llm import pieces, textkit as tk
from lexspan.llm.common import table

ODD = ["", " ", "  a  b ", "x" * 200, "日本 \U0001f600 ok\n\tz\r\n", "Hello world", "w" * 70 + " " + "abc" * 50, "naïve café"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def encoded(encoder, texts):
    out = []
    for i, j, block in tk.blocks(pa.array(texts, pa.string()), 1 << 14):
        ids, bounds = encoder.encode_block(block)
        out += [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(j - i)]
    return out


def test_without_dropout_equals_the_library(spark, small, vocabulary):
    texts = ODD + [r.text for r in table(spark, small, "documents").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    assert encoded(pieces.Encoder(vocabulary, 0.0), texts) == library.encode(texts)


def test_round_trip_with_dropout(vocabulary):
    rng = random.Random(1)
    alphabet = "ab e \n\té▁日\U0001f600.,the "
    texts = ODD + ["▁", "a▁b", " ▁ "] + ["".join(rng.choices(alphabet, k=rng.randrange(300))) for _ in range(200)]
    encoder = pieces.Encoder(vocabulary, 0.3, 5)
    ids = encoded(encoder, texts)
    assert [encoder.decode(pieces.np.array(i, dtype=int)) for i in ids] == texts
    assert ids == encoded(pieces.Encoder(vocabulary, 0.3, 5), texts)
    assert ids != encoded(pieces.Encoder(vocabulary, 0.3, 6), texts)


def test_matrix_and_heap_agree_and_occurrences_vary(vocabulary, monkeypatch):
    texts = ["international organisation of uncommon representations " * 20, *ODD]
    encoder = pieces.Encoder(vocabulary, 0.2)
    wide = encoded(encoder, texts)
    monkeypatch.setattr(pieces, "_WIDTHS", ())
    assert encoded(encoder, texts) == wide
    per = len(encoded(pieces.Encoder(vocabulary, 0.0), texts[:1])[0])
    assert len(wide[0]) > per


def test_equal_texts_get_equal_ids_wherever_they_stand(vocabulary):
    encoder = pieces.Encoder(vocabulary, 0.2)
    a, b, c = encoded(encoder, ["same words here", "something else", "same words here"])
    assert a == c and [a] == encoded(encoder, ["same words here"]) and b


def test_unbroken_megabytes_take_seconds(vocabulary):
    """Text without blanks: Latin, where most neighbours stand together in a piece, and others."""
    rng = random.Random(3)
    words = "theinternationaloforganisationrepresentingquicklybrownfoxes"
    latin = "".join(words[i : i + rng.randrange(1, 9)] for i in rng.choices(range(len(words)), k=250_000))[:1_000_000]
    texts = [latin, "".join(map(chr, rng.choices(range(0x4E00, 0x5200), k=350_000))), "w" * 1_000_000, "0" * 1_000_000, "가나다라" * 90_000]
    encoder = pieces.Encoder(vocabulary, 0.1)
    begun = time.monotonic()
    for text in texts:
        ids, = encoded(encoder, [text])
        assert encoder.decode(pieces.np.array(ids, dtype=int)) == text
    assert time.monotonic() - begun < 100
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    some = [t[:20_000] for t in texts]
    assert encoded(pieces.Encoder(vocabulary, 0.0), some) == library.encode(some)


def test_memory_of_the_agendas_is_bounded(vocabulary):
    """A batch of many texts is encoded in small blocks: what a task holds does not follow the batch."""
    texts = pa.array(["international organisation of uncommon representations " * 40] * 3000)
    batch = pa.record_batch({"text": texts})
    encode_all = pieces._encoder(vocabulary, 0.1, 7)
    list(encode_all([batch.slice(0, 60)]))
    tracemalloc.start()
    try:
        rows = sum(len(out) for out in encode_all([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 40e6
