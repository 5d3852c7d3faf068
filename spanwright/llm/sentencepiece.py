"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed here and rebuilt as a tokenizers pipeline:
normaliser, metaspace marker, pieces with scores or merges, byte fallback.
All texts are checked against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import chain, count, groupby, islice
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_texts

MARK = "▁"
# Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
# One text in so many is encoded by both libraries: all.
CHECK_EVERY = 1
THREADS = 2
# A worker remembers the ids of words up to about this many characters in all,
# encodes so many words at once, and joins the ids of so many.
WORD_CHARS = 2_000_000
WORDS_AT_ONCE = 500
WORDS_JOINED = 1 << 18


@dataclass
class Model:
    """What a model file says."""
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def _fields(data: bytes):
    """``number, value`` of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at:at + 8], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at:at + size], at + size
        elif kind == 5:
            value, at = data[at:at + 4], at + 4
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


def parse(data: bytes) -> Model:
    """Read a model file.  Numbers are those of the published message format:
    1 pieces (1 text, 2 score, 3 kind), 2 trainer (3 kind of model, 24 treats
    the mark as a suffix, 35 byte fallback, 40 unknown id), 3 normaliser (2
    character map, 3 dummy prefix, 4 squeeze blanks, 5 escape blanks)."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.suffix = bool(trainer.get(24, 0))
            model.byte_fallback = bool(trainer.get(35, 0))
            model.unknown = trainer.get(40, 0)
        elif number == 3:
            norm = dict(_fields(value))
            model.charsmap = norm.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE) or model.suffix or any(k == USER for _, _, k in model.pieces):
        raise ValueError("only unigram and BPE models with a leading mark and without pieces of the user are supported")
    return model


def tied_runs(model: Model) -> tuple[str, frozenset[int]]:
    """The character and the lengths of the pieces of a BPE model that share one
    score, such as runs of blanks; no lengths if all scores differ.

    Of equal scores the leftmost pair is merged first, which no order of pairs
    expresses.  So these pieces are left out of the merges and made last, from
    the characters that stay alone.  That is the same if they are runs of one
    character, of the least score, and no other piece holds two in a row."""
    normal = [(text, score) for text, score, kind in model.pieces if kind == NORMAL and len(text) > 1]
    count = Counter(score for _, score in normal)
    tied = {text for text, score in normal if count[score] > 1}
    if model.kind != BPE or not tied:
        return "", frozenset()
    run = next(iter(tied))[0]
    others = [(text, score) for text, score in normal if text not in tied]
    if (any(set(text) != {run} for text in tied) or any(run * 2 in text for text, _ in others)
            or any(score <= least for least in {s for t, s in normal if t in tied} for _, score in others)):
        raise ValueError("pieces of one score are only supported as runs of one character of the least score")
    return run, frozenset(map(len, tied))


def split_run(n: int, lengths: frozenset[int]) -> list[int]:
    """The lengths of the pieces of a run of ``n``: always the leftmost pair
    that makes a piece is merged.  What is left of the next character has no
    such pair, so only the last piece can grow."""
    done: list[int] = []
    for _ in range(n):
        done.append(1)
        while len(done) > 1 and done[-2] + done[-1] in lengths:
            last = done.pop()
            done[-1] += last
    return done


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first, but those of :func:`tied_runs`."""
    run, lengths = tied_runs(model)
    rank = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    found = []
    for text, score, kind in model.pieces:
        if kind == NORMAL and not (len(text) in lengths and set(text) == {run}):
            for cut in range(1, len(text)):
                a, b = text[:cut], text[cut:]
                if a in rank and b in rank:
                    found.append((-score, rank[a], rank[b], a, b))
    found.sort()
    return [(a, b) for *_, a, b in found]


def rebuild(model: Model):
    """A tokenizers pipeline with the ids of the model, but those of :func:`tied_runs`."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers
    texts = [text for text, _, _ in model.pieces]
    if model.kind == UNIGRAM:
        # Special pieces can't be read from a text: as blanks become marks, none has these names.
        # The least score counts for unknown characters, so the others have it too.
        low = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0)
        core = models.Unigram([(t if k in (NORMAL, BYTE) else f" {t}", s if k == NORMAL else low) for t, s, k in model.pieces],
                              model.unknown, model.byte_fallback)
    else:
        core = models.BPE(vocab={t: i for i, t in enumerate(texts)}, merges=merges(model),
                          unk_token=texts[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Metaspace(MARK, prepend_scheme="never"), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


def packed_encoder(model: Model, tokenizer, most_chars: int = WORD_CHARS):
    """A function from texts to the model's ids, as little-endian 32-bit numbers.

    Texts are cut before each run of marks, unless a piece has a mark after
    another character: no piece spans such a cut, so the ids of a text are
    those of its words, and a word that was met lately is not encoded again.
    Words of ``most_chars`` characters and of the last texts are remembered;
    beyond that those met most often since then stay, up to half of it.

    Without a character map or squeezed blanks the texts are cut at the blanks
    that become marks; else the normaliser runs on the texts before.  Words
    with one mark are encoded some hundreds at a time, by a BPE model as one
    string: each has one piece that begins with a mark, its first."""
    import numpy as np
    from tokenizers import Tokenizer
    cuts = not any(MARK in t.lstrip(MARK) for t, _, _ in model.pieces)
    by_word = cuts and model.escape and not model.charsmap and not model.squeeze
    marks = f" {MARK}" if by_word else MARK
    words_only = Tokenizer(tokenizer.model)
    cut = re.compile(f"[{marks}]*[^{marks}]+|[{marks}]+" if cuts else "(?s:.+)")
    run, lengths = tied_runs(model)
    ids_of = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    single = ids_of.get(run)
    leads = np.array([t.startswith(MARK) for t, _, _ in model.pieces])
    before = (" " if model.dummy_prefix else "") if by_word else None
    # A new word gets the next number by being looked up.  Its ids are ``size``
    # of ``pool`` from ``start`` on.
    number: defaultdict[str, int] = defaultdict(count().__next__)
    start, size, met, pool = (np.zeros(0, kind) for kind in ("i8", "i8", "i8", "<i4"))
    held = 0

    def with_runs(ids):
        out = []
        for i, some in groupby(ids):
            n = sum(1 for _ in some)
            out += [ids_of[run * k] for k in split_run(n, lengths)] if i == single and n > 1 else [i] * n
        return out

    def marked(word):
        return word.replace(" ", MARK) if by_word else word

    def has_run(word):
        return single is not None and run * 2 in marked(word)

    def learn(words):
        nonlocal start, size, met, pool
        easy = [i for i, w in enumerate(words) if cuts and 0 < len(w.lstrip(marks)) == len(w) - 1]
        if single is not None and run != MARK:
            easy = [i for i in easy if not has_run(words[i])]
        hard = sorted(set(range(len(words))).difference(easy))
        parts = [easy[i:i + WORDS_AT_ONCE] for i in range(0, len(easy), WORDS_AT_ONCE)]
        lists, one = [[words[i] for i in some] for some in parts], model.kind == BPE
        lists = [marked("".join(some)) if one else [marked(w) for w in some] for some in lists]
        starts, sizes, found, n = np.zeros(len(words), "i8"), np.zeros(len(words), "i8"), [pool], len(pool)
        for some, got in zip(parts, words_only.encode_batch_fast(lists, is_pretokenized=not one, add_special_tokens=False)):
            ids = np.array(got.ids, "<i4")
            at = np.flatnonzero(leads[ids])
            if len(at) != len(some):
                hard += some
                continue
            starts[some], sizes[some] = n + at, np.diff(at, append=len(ids))
            found.append(ids)
            n += len(ids)
        for i, got in zip(hard, words_only.encode_batch_fast([marked(words[i]) for i in hard], add_special_tokens=False)):
            ids = np.array(with_runs(got.ids) if has_run(words[i]) else got.ids, "<i4")
            starts[i], sizes[i] = n, len(ids)
            found.append(ids)
            n += len(ids)
        start, size, pool = np.concatenate([start, starts]), np.concatenate([size, sizes]), np.concatenate(found)
        met = np.concatenate([met, np.zeros(len(words), "i8")])

    def ids_at(numbers):
        """The ids of words, one after the other."""
        found = [np.zeros(0, "<i4")]
        for some in (numbers[i:i + WORDS_JOINED] for i in range(0, len(numbers), WORDS_JOINED)):
            ends = np.cumsum(size[some])
            found.append(pool[np.repeat(start[some] + size[some] - ends, size[some]) + np.arange(ends[-1])])
        return np.concatenate(found)

    def forget():
        nonlocal number, start, size, met, pool, held
        words = list(number)
        chars = np.fromiter(map(len, words), "i8", len(words))
        often = np.argsort(-met, kind="stable")
        often = np.sort(often[(np.cumsum(chars[often]) <= most_chars // 2) & (met[often] > 1)])
        pool, size = ids_at(often), size[often]
        start, met, held = np.cumsum(size) - size, np.zeros(len(often), "i8"), int(chars[often].sum())
        number = defaultdict(count(len(often)).__next__, zip([words[i] for i in often.tolist()], range(len(often))))

    def encode_texts(texts):
        nonlocal held, met
        if held > most_chars:
            forget()
        split = [cut.findall(tokenizer.normalizer.normalize_str(t) if before is None else before + t) if t else [] for t in texts]
        n_words, known = np.fromiter(map(len, split), "i8", len(split)), len(number)
        numbers = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), "i8", int(n_words.sum()))
        if len(number) > known:
            new = list(islice(reversed(number), len(number) - known))[::-1]
            held += sum(map(len, new))
            learn(new)
        met += np.bincount(numbers, minlength=len(met))
        data = ids_at(numbers).tobytes()
        ends = [0, *(4 * np.concatenate([[0], np.cumsum(size[numbers])])[np.cumsum(n_words)]).tolist()]
        return [data[a:b] for a, b in zip(ends, ends[1:])]
    return encode_texts


def encoder(model: Model, tokenizer, most_chars: int = WORD_CHARS):
    """A function from texts to the model's id lists, by :func:`packed_encoder`."""
    import numpy as np
    packed = packed_encoder(model, tokenizer, most_chars)
    return lambda texts: [np.frombuffer(p, "<i4").tolist() for p in packed(texts)]


def coder(model_bytes: bytes, check_every: int = CHECK_EVERY, threads: int = THREADS, with_ids: bool = True):
    """A maker of functions from texts to ``token_ids, n_tokens, ids_sha256,
    n_bytes_fallback, round_trip, parity``."""
    def make():
        import os
        # Read once, when the library starts its threads.
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece
        import numpy as np
        model = parse(model_bytes)
        tokenizer = rebuild(model)
        encode_texts = packed_encoder(model, tokenizer)
        other = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        byte = np.array([k == BYTE for _, _, k in model.pieces])
        lead = 1 if model.dummy_prefix else 0

        def checked(text):
            return check_every == 1 or int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest()) % check_every == 0

        def normalised(text):
            if model.squeeze or model.charsmap:
                return other.normalize(text).replace(MARK, " ")[lead:]
            return text.replace(MARK, " ")

        def work(texts):
            plain = [t or "" for t in texts]
            packed = encode_texts(plain)
            parity = [None] * len(plain)
            # The unigram pipeline would read the name of a byte piece as that byte.
            named = {i for i, t in enumerate(plain) if model.kind == UNIGRAM and "<0x" in t}
            some = [i for i, t in enumerate(plain) if i in named or checked(t)]
            ids = [np.frombuffer(p, "<i4") for p in packed]
            lists = [i.tolist() for i in ids]
            for i, theirs in zip(some, other.encode([plain[i] for i in some], num_threads=threads)):
                parity[i] = theirs == lists[i]
                if i in named:
                    lists[i], ids[i] = theirs, np.array(theirs, "<i4")
                    packed[i] = ids[i].tobytes()
            back = [tokenizer.decode(i, skip_special_tokens=False) for i in lists]
            same = [b[lead:] == normalised(t) for b, t in zip(back, plain)]
            out = {"n_tokens": [len(i) for i in ids],
                   "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                   "n_bytes_fallback": [int(np.count_nonzero(byte[i])) for i in ids],
                   "round_trip": same, "parity": parity}
            return out | ({"token_ids": ids} if with_ids else {})
        return work
    return make


def encode(docs: DataFrame, model_path: str, keep: list[str], text: str = "text", check_every: int = CHECK_EVERY,
           threads: int = THREADS, with_ids: bool = True) -> DataFrame:
    """``keep`` and, of each whole text, ``token_ids`` (if asked for),
    ``n_tokens``, ``ids_sha256`` (of the ids as little-endian 32-bit numbers),
    ``n_bytes_fallback``, ``round_trip`` (the rebuilt tokenizer decodes the ids
    to the text, as normalised by the model: marks are blanks) and ``parity``.

    The ids are those of the rebuilt tokenizer.  Every text is encoded by the
    sentencepiece library too, and ``parity`` says whether both agree.  With a
    larger ``check_every`` only one text in so many, chosen by a hash of the
    text, is, and ``parity`` is null for the others.  Only with a unigram model,
    texts that hold the name of a byte piece get the library's ids.  Null and empty texts have no tokens.
    Control strings of the model in a text are plain text.  Rows are
    independent; a batch is encoded by ``threads`` threads.
    """
    data = Path(model_path).read_bytes()
    schema = "n_tokens long, ids_sha256 string, n_bytes_fallback long, round_trip boolean, parity boolean"
    return map_texts(docs, keep, text, ("token_ids array<int>, " if with_ids else "") + schema,
                     coder(data, check_every, threads, with_ids))


def decode(encoded: DataFrame, model_path: str, keep: list[str], ids: str = "token_ids") -> DataFrame:
    """``keep`` and ``text`` of id lists; null lists give null."""
    data = Path(model_path).read_bytes()
    kinds = dict(encoded.dtypes)
    read = encoded.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{ids}`").alias("ids"))

    def run(batches):
        import pyarrow as pa
        model = parse(data)
        tokenizer = rebuild(model)
        lead = 1 if model.dummy_prefix else 0
        for batch in batches:
            lists = batch.column(len(keep)).to_pylist()
            texts = tokenizer.decode_batch([x or [] for x in lists], skip_special_tokens=False)
            texts = [None if x is None else t[lead:] for x, t in zip(lists, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string())],
                                             names=[*[f"k{i}" for i in range(len(keep))], "text"])

    out = ", ".join([*[f"k{i} {kinds[c]}" for i, c in enumerate(keep)], "text string"])
    return read.mapInArrow(run, out).toDF(*keep, "text")
