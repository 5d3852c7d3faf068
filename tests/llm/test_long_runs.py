"""Token counts and pieces of texts with very long runs."""

import random
from pathlib import Path

import pytest

from spanwright.llm import sentencepiece, tokencount

VOCABULARY = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
PIECES = Path("/opt/tokenizers/piece_bpe_32k.model")


def counter(pattern=tokencount.PATTERN):
    return tokencount.rank_encoder(VOCABULARY.read_bytes(), pattern)()


def test_taking_runs_out_changes_no_count(monkeypatch):
    rng = random.Random(4)
    pieces = [" ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", "a", "Ab", "12", "!?", "'s", "é", "日", "🙂"]
    texts = ["".join(rng.choice(pieces) * rng.choice([1, 1, 2, 5, 9]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    monkeypatch.setattr(tokencount, "LONG_RUN", 1 << 30)
    want = counter()(texts)
    for least in (1, 2, 3, 7):
        monkeypatch.setattr(tokencount, "LONG_RUN", least)
        assert counter()(texts) == want


@pytest.mark.parametrize("unit", [" ", "\n", "\r\n", " \t", "　"])
def test_two_million_white_spaces(unit):
    run = unit * (2_000_000 // len(unit))
    short = unit * (2000 // len(unit))
    count = lambda t: counter()([t])["n_tokens"][0]
    for before, after in (("", ""), ("a", "b"), ("a", ""), ("", "b")):
        n = count(before + run + after)
        # Pieces of a long run merge as those of a short one do.
        assert n <= count(before + short + after) * 1100 and n >= 1


def test_two_million_letters():
    assert counter()(["a" * 2_000_000])["n_tokens"][0] > 1000


def test_long_white_space_in_spark(spark):
    df = spark.createDataFrame([(1, "x" + " " * 1_500_000 + "y"), (2, "\n" * 1_500_000), (3, "x y")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_lengths(df, str(VOCABULARY), ["doc_id"]).collect()}
    assert got[3] == 2 and got[1] > 2 and got[2] > 2


def pieces_of(texts):
    """Ids of the rebuilt tokenizer, by its own method, and what it says of them."""
    data = PIECES.read_bytes()
    model = sentencepiece.parse(data)
    return sentencepiece.encoder(model, sentencepiece.rebuild(model))(texts), sentencepiece.coder(data)()(texts)


def test_runs_of_blanks_and_marks_have_the_library_s_pieces():
    import sentencepiece as library
    sp = library.SentencePieceProcessor(model_file=str(PIECES))
    texts = [f"{before}{unit * n}{after}" for n in range(1, 301) for unit in (" ", "▁")
             for before, after in (("a", "b"), ("", ""), ("", "b"), ("a", ""))]
    texts += [" " * 1_000_000, "a" + " " * 1_000_000 + "b", "a ▁b▁▁c  d", "=" * 300, "ha" * 300]
    ids, got = pieces_of(texts)
    assert ids == sp.encode(texts)
    assert all(got["parity"]) and all(got["round_trip"])
    assert [list(map(int, x)) for x in got["token_ids"]] == ids


def test_random_texts_have_the_library_s_pieces():
    import sentencepiece as library
    sp = library.SentencePieceProcessor(model_file=str(PIECES))
    rng = random.Random(8)
    parts = ["ha", "a", "b", "=", "-", " ", "  ", "x", "ab", "\n", "\t", "▁", "an", "na", "🙂", "the", "The", "é"]
    texts = ["".join(rng.choice(parts) * rng.choice([1, 1, 2, 3, 7, 20]) for _ in range(rng.randint(0, 12))) for _ in range(20000)]
    ids, got = pieces_of(texts)
    assert ids == sp.encode(texts) and all(got["parity"]) and all(got["round_trip"])


def test_words_that_were_forgotten_are_encoded_again():
    data = PIECES.read_bytes()
    model = sentencepiece.parse(data)
    tokenizer = sentencepiece.rebuild(model)
    texts = [f"word{i % 7} other{i} word{i % 3}" for i in range(300)]
    whole = sentencepiece.encoder(model, tokenizer)
    few = sentencepiece.encoder(model, tokenizer, 40)
    assert [few([t])[0] for t in texts] == whole(texts)


def test_a_run_takes_the_leftmost_pair_first():
    rng = random.Random(9)
    for _ in range(300):
        lengths = frozenset({2, *rng.sample(range(3, 20), rng.randint(0, 8))})
        n = rng.randint(0, 60)
        plain = [1] * n
        while True:
            at = next((i for i in range(len(plain) - 1) if plain[i] + plain[i + 1] in lengths), None)
            if at is None:
                break
            plain[at:at + 2] = [plain[at] + plain[at + 1]]
        assert sentencepiece.split_run(n, lengths) == plain


def test_other_tied_pieces_are_an_error():
    model = sentencepiece.Model(pieces=[("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.0, 1), ("ab", -3.0, 1), ("ba", -3.0, 1)], kind=sentencepiece.BPE)
    with pytest.raises(ValueError):
        sentencepiece.rebuild(model)


@pytest.mark.parametrize("most_chars", [30, sentencepiece.WORD_CHARS])
def test_words_encoded_together_have_their_own_ids(most_chars):
    import numpy as np
    import sentencepiece as library
    data = PIECES.read_bytes()
    model = sentencepiece.parse(data)
    sp = library.SentencePieceProcessor(model_proto=data)
    packed = sentencepiece.packed_encoder(model, sentencepiece.rebuild(model), most_chars)
    texts = ["", " ", "a", " a", "a ", "a  b", "▁a", "a▁▁ b", "\n", "日本 語 🙂x", "x\ty z", "</s> <unk> <0x41>", "word " * 700, "1 22 333"]
    rng = random.Random(10)
    texts += [" ".join(str(rng.randrange(10 ** rng.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    for some in (texts, texts[::-1], texts[3:9]):
        assert [np.frombuffer(p, "<i4").tolist() for p in packed(some)] == sp.encode(some)


def test_new_words_are_joined_and_those_met_often_stay(monkeypatch):
    import numpy as np
    import sentencepiece as library
    import tokenizers
    data, given, whole = PIECES.read_bytes(), [], tokenizers.Tokenizer

    class Counting:
        def __init__(self, model):
            self.own = whole(model)

        def encode_batch_fast(self, some, **how):
            given.extend(x for one in some for x in ([one] if isinstance(one, str) else one))
            return self.own.encode_batch_fast(some, **how)
    model = sentencepiece.parse(data)
    tokenizer = sentencepiece.rebuild(model)
    sp = library.SentencePieceProcessor(model_proto=data)
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    packed = sentencepiece.packed_encoder(model, tokenizer, 4000)
    common = " ".join(f"common{i}" for i in range(100))
    for i in range(40):
        texts = [" ".join(f"rare{i}x{j}" for j in range(100)), ""] + [common, f"{common}  {common}"] * (i % 4 == 0)
        assert [np.frombuffer(p, "<i4").tolist() for p in packed(texts)] == sp.encode(texts)
    assert len(given) < 200
    assert sum(x.count("common") for x in given) < 250
