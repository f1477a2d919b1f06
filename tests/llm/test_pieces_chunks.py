"""What a worker remembers of chunks, and encoding that goes on behind the longest matches that fit."""
import random

import sentencepiece

from notecoder.llm import pieces


def test_chunks_are_not_all_forgotten_at_once(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNKS", 100)
    encoder = pieces.Encoder(pieces.model_path())
    encoder.encode(" ".join(f"w{i}" for i in range(100)))
    assert len(encoder.known) == 100
    encoder.encode("new")
    # the later half stays
    assert len(encoder.known) == 51 and f"{pieces.SPACE}w99" in encoder.known and f"{pieces.SPACE}w1" not in encoder.known


def test_made_up_words_equal_the_library():
    encoder, r = pieces.Encoder(pieces.model_path()), random.Random(3)
    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    parts = ["an", "que", "tion", "er", "th", "è", "ê", "oi", "Th", "ed", "ing", "l", "s", "x", "  ", " ", ".", "é", "日", "\n", "1"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 30)))
        ids = [int(i) for i in pieces.np.frombuffer(encoder.encode(text), "<u4")]
        assert ids == processor.encode(text, add_bos=True, add_eos=True), text
