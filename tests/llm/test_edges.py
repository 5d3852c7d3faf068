"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanwright.llm import chat, hnsw, languageid, mixing, neardup, sentencepiece, simhash, suffixes, tokencount, warc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = "a long line of words, " * 60000
PLAIN = "The quick brown fox jumps over the lazy dog near the river bank while it rains. "
ROWS = [
    (1, PLAIN, "en", "s1", 80), (2, "", "en", "s1", 0), (3, None, None, "s1", None), (None, "no id", "en", None, 5),
    (4, LONG, "en", "s2", 1), (5, PLAIN, "en", "s2", 80), (5, PLAIN, "en", "s2", 80), (6, "x", None, "", 1),
    (7, "Der schnelle Fuchs springt über den faulen Hund am Fluss. " * 3, "de", "s1", 9), (8, " \t\n", "en", "é", 3),
    (9, "12345 --- !!!", "en", "s1", 9), (None, None, None, None, None), (10, "日本語のテキスト🙂", "ja", "s3", 9)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["k0", "v0", "fp", "data", "found", "component_id", "order", "part", "row", "size", "key", "lang_pred", "rejected", "kept"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.concat(F.lit(c), F.col("source")).alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffixes(docs, wide, empty):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.without_repeats(wide, ["doc_id"]).collect())
    want = Counter()
    for doc_id, text, *_ in ROWS:
        n = len((text or "").encode())
        removed, spans = (n, 1) if doc_id == 4 else (0, 0)
        want[(doc_id, n, removed, spans)] += 1
    assert got == want
    assert suffixes.without_repeats(empty, ["doc_id"]).count() == 0
    full = suffixes.without_repeats(wide, wide.columns, with_text=True)
    assert full.columns == [*wide.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def test_repeated_long_rows_lose_all(spark):
    text = "".join(f"word{i} " for i in range(200))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:500]), (2, "é" * 300)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"], r["n_spans"], r["kept"]) for r in suffixes.without_repeats(df, ["doc_id"], with_text=True).collect())
    assert got == Counter({(1, len(text), 1, ""): 2, (None, 500, 1, ""): 1, (2, 600, 1, ""): 1})


def test_cut_characters_go_whole(spark):
    shared = "".join(chr(0x4E00 + i) for i in range(100))
    df = spark.createDataFrame([(1, "abc" + shared + "é"), (2, "xyz" + shared + "è")], "doc_id long, text string")
    rows = suffixes.without_repeats(df, ["doc_id"], with_text=True).orderBy("doc_id").collect()
    # The first byte of both last letters is the same.
    assert [(r["kept"], r["n_removed"]) for r in rows] == [("abc", 301), ("xyz", 301)]


def test_token_counts(docs, wide, empty):
    got = {r["context_limit"]: r["n_docs"] for r in tokencount.token_report(wide, VOCABULARY).collect()}
    lengths = [r["n_tokens"] for r in tokencount.token_lengths(docs, VOCABULARY).collect()]
    assert got == Counter(lengths) and got[0] == 3
    assert tokencount.token_report(empty, VOCABULARY).count() == 0


def test_mixing(docs, wide, empty):
    rows = mixing.mix(wide).collect()
    assert len(rows) == len(ROWS)
    by_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    sized = mixing.sized(docs).collect()
    sizes = Counter()
    for r in sized:
        sizes[r["source"]] += r["size"]
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    assert mixing.mix(empty).count() == 0 and mixing.trained_order(empty).count() == 0
    ordered = mixing.trained_order(wide)
    assert ordered.columns == wide.columns
    copies = Counter((r["doc_id"], r["text"]) for r in ordered.collect())
    assert all(n <= 4 for n in copies.values()) and set(copies) <= {(r[0], r[1]) for r in ROWS}


def test_the_mix_is_the_sum_of_the_positioned_run(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i} " * (5 + i % 7), f"s{i % 4}") for i in range(120)], "doc_id long, text string, source string")
    run = mixing.training_order(df).collect()
    assert [r["position"] for r in run] == sorted(r["position"] for r in run) and all(0 <= r["position"] <= 1 for r in run)
    words = Counter()
    for r in run:
        words[r["doc_id"]] += r["words"]
    mixed = mixing.mix(df).collect()
    assert {r["doc_id"]: r["taken"] for r in mixed} == {r["doc_id"]: words[r["doc_id"]] for r in mixed}
    # Copies in which a target ends have a place too.
    assert any(0 < r["words"] < 5 + r["doc_id"] % 7 for r in run)
    assert len({(r["doc_id"], r["copy"]) for r in run}) == len(run)
    # The mix is made from the run, not beside it.
    whole = mixing.curriculum
    monkeypatch.setattr(mixing, "curriculum", lambda *a, **k: whole(*a, **k).where("copy = 0"))
    assert all(r["taken"] <= r["size"] for r in mixing.mix(df).collect())


def test_targets_are_capped_and_shared_again(spark):
    df = spark.createDataFrame([("a", 10, 0, 3.0), ("b", 1000, 1, 1.0), ("c", 100, 2, 2.0), ("d", 0, 0, 3.0), (None, 500, 1, 1.0)],
                               "source string, source_size long, turn int, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    goal, weights, size = 1.5 * 1610, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}, {"a": 10, "b": 1000, "c": 100, "d": 0, None: 500}
    capped = {}
    while True:
        left = goal - sum(capped.values())
        free = sum(w for s, w in weights.items() if s not in capped)
        over = {s: 2.0 * size[s] for s in weights if s not in capped and left * weights[s] / free > 2 * size[s]}
        if not over:
            break
        capped |= over
    want = {s: capped.get(s, left * weights[s] / free) for s in weights}
    assert got == pytest.approx(want)


def test_positions_invert_the_schedule(spark):
    shapes = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (2.0, 0.0, 1.0))
    df = spark.range(101).select((F.col("id") / 100).alias("s"))
    for turn, shape in enumerate(shapes):
        rows = df.select("s", mixing.position(F.col("s"), F.lit(turn), shapes).alias("t")).orderBy("s").collect()
        steps, total = len(shape) - 1, 0
        area = lambda t: sum(
            (lambda u: u * shape[i] + u * u / 2 * (shape[i + 1] - shape[i]) * steps)(min(max(t - i / steps, 0), 1 / steps))
            for i in range(steps))
        total = area(1)
        assert all(0 <= r["t"] <= 1 for r in rows)
        assert all(area(r["t"]) / total == pytest.approx(r["s"], abs=1e-6) for r in rows)


def test_language(wide, empty):
    model = languageid.train(wide, F.lit(True))
    assert list(model.dictionaries) == ["de", "en", "ja"]
    got = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in languageid.predict(wide, model, ["doc_id"]).collect()]
    assert len(got) == len(ROWS) and (1, "en", False) in got and (7, "de", False) in got
    assert {(d, p) for d, p, _ in got if p == "und"} == {(2, "und"), (3, "und"), (8, "und"), (9, "und"), (None, "und")}
    assert languageid.accepted(wide, model).columns == wide.columns
    none = languageid.train(empty, F.lit(True))
    assert none.dictionaries == {} and languageid.accepted(empty, none).count() == 0
    assert {r["lang_pred"] for r in languageid.predict(wide, none, ["doc_id"]).collect()} == {"und"}


def test_simhash(docs, wide, empty):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(wide).collect())
    assert got[(5, 1)] == 2 and got[(1, 1)] == 1
    # Without words: fingerprint zero, one group.
    assert got[(2, 2)] == got[(3, 2)] == got[(8, 2)] == got[(None, 2)] == 1
    assert sum(got.values()) == len(ROWS)
    kept = [r["doc_id"] for r in simhash.one_per_group(wide).collect()]
    assert sorted(d for d in kept if d is not None) == [1, 2, 4, 6, 7, 9, 10] and kept.count(None) == 2
    assert simhash.one_per_group(wide).columns == wide.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_per_group(empty).count() == 0


def test_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neardup.near_duplicates(empty).count() == 0
    assert hnsw.search_table(empty, empty, 5).count() == 0
    rows = [(1, [1.0, 0.0], 0, "x"), (1, [1.0, 0.0], 0, "x"), (None, [1.0, 0.01], 0, "x"), (4, None, 0, "x"), (5, [1.0, 0.0], None, "x"),
            (6, [-0.0, 0.0], 0, "x"), (7, [5.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string").selectExpr(
        "*", "n AS class", "n AS rep", "n AS a", "n AS dim", "n AS cell")
    got = Counter(tuple(r) for r in neardup.near_duplicates(df).collect())
    assert got == Counter({(1, 2, 1, True): 2, (None, 2, 1, False): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1,
                           (6, 0, 6, True): 1, (7, 0, 7, True): 1})
    ties = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)] + [(100, [3.0, 2.0])], "vec_id long, embedding array<float>")
    found = hnsw.search_table(ties, ties.where("vec_id = 20"), 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [100, *[i for i in range(60) if i != 20][:19]]


def plain_fold(events):
    """The log replayed one event at a time."""
    state = {}
    for conv, _seq, turn, kind, role, text in sorted(events, key=lambda e: e[1]):
        talk = state.setdefault(conv, {})
        if kind in (chat.EDIT, chat.REGENERATE):
            for later in [t for t in talk if t > turn]:
                del talk[later]
            if turn in talk:
                talk[turn][1] = (text or "") if kind == chat.EDIT else ""
        elif kind == chat.OPEN:
            talk[turn] = [role or "", text or ""]
        elif turn in talk:
            talk[turn][1] += text or ""
    return {(c, t): tuple(m) for c, talk in state.items() for t, m in talk.items()}


EVENTS = [
    (1, 1, 0, "open", "user", "hi"), (1, 2, 1, "open", "assistant", None), (1, 3, 1, "delta", None, "a"), (1, 4, 1, "delta", None, None),
    (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "b<|im_end|>"), (1, 7, 2, "open", "user", "more"),
    (1, 8, 3, "open", "assistant", "x"), (1, 9, 0, "edit", None, "hello \\n <\\|"), (1, 10, 1, "open", "assistant", "new"), (1, 11, 1, "delta", None, "!"),
    (None, 1, 0, "open", None, "\\\\<|im_start|>user\nz"), (None, 2, 1, "open", "tool\n<|im_end|>", "ends <"), (2, 1, 0, "open", "assistant", None),
    (3, 5, 0, "open", "system", ""), (3, 6, 1, "open", "user", "q"), (3, 7, 5000, "open", "assistant", "late"), (3, 8, 1, "edit", None, "q2")]


def test_chat(spark):
    schema = "conv_id long, seq long, turn long, kind string, role string, text string"
    df = spark.createDataFrame(EVENTS, schema).repartition(4)
    want = plain_fold(EVENTS)
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold(df).collect()}
    assert got == want
    for turns in (1, 256):
        rendered = chat.render(chat.fold(df), turns)
        digests = {r["conv_id"]: r for r in chat.digests(rendered).collect()}
        for conv in {c for c, _ in want}:
            talk = [want[k] for k in sorted(k for k in want if k[0] == conv)]
            r = digests[conv]
            assert r["n_turns"] == len(talk)
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in talk).encode()).hexdigest()
            said = "".join(b for a, b in talk if a == "assistant")
            assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        for r in rendered.collect():
            assert len(chat.read_turns(r["formatted"])) == r["n_turns"]
    assert chat.digests(chat.format_chats(spark.createDataFrame([], schema))).count() == 0


PAGES = [(3, "http://x/a", "same"), (1, "http://x/b c\n", "same"), (2, None, "same"), (7, "u", ""), (8, "u", None), (9, "é", "é" * 50000),
         (None, "u", "same"), (10, "u", "once"), (11, "u", "line\r\n\r\nWARC/1.1\r\n")] + [(100 + i, "u", f"<p>page {i % 50}</p>" * 9) for i in range(200)]


def plain_archive(pages, least=0):
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = Counter()
    for page, _, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= least and first.get(html or "") not in (None, page)
        out[(page, len(data), warc.payload_digest(data), "revisit" if revisit else "response", first[html or ""] if revisit else None)] += 1
    return out


@pytest.mark.parametrize("least, size", [(0, 8 << 20), (5, 3000)])
def test_warc(spark, tmp_path, least, size):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "url AS payload", "url AS digest", "url AS path")
    archives = warc.write_archives(df, least_bytes=least, archive_bytes=size).cache()
    rows = warc.read_archives(archives, payloads=True).collect()
    assert all(r["problem"] is None for r in rows)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == plain_archive(PAGES, least)
    html = {p: (h or "").encode() for p, _, h in PAGES}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in rows if r["record_type"] == "response")
    assert {r["url"] for r in rows if r["page_id"] == 1} == {"http://x/b%20c%0A"}
    # As files, read by Spark.
    warc.export(archives, str(tmp_path)).count()
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.warc.zst")
    assert warc.read_archives(files).count() == len(PAGES)
    assert any(bytes(r["content"])[:4] == struct.pack("<I", warc.SKIPPABLE) for r in archives.collect())


def test_broken_archives_say_so(spark):
    records = [warc.write_record(i, "u", b"x" * 100, warc.payload_digest(b"x" * 100), None, False) for i in range(40)]
    good = warc.pack(records)
    bad = [r.replace(b"Content-Length: 100\r\n\r\n", b"Content-Length: 99\r\n\r\n") for r in records[:1]] + [
        records[0].replace(b"sha1:", b"sha1:A"), records[0][:-1], records[0].replace(b"WARC/1.1", b"WARC/9"),
        records[0].replace(b"WARC-Date", b"WARC-Day")]
    df = spark.createDataFrame([("good", bytearray(good)), ("cut", bytearray(good[:-10])), ("bad", bytearray(warc.pack(bad))), ("none", bytearray())],
                               "path string, content binary")
    rows = warc.read_archives(df).collect()
    by_path = Counter((r["path"], r["problem"] is None) for r in rows)
    assert by_path == Counter({("good", True): 40, ("cut", True): 39, ("cut", False): 1, ("bad", False): 5})
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_sentencepiece(docs, wide, empty):
    import sentencepiece as library
    sp = library.SentencePieceProcessor(model_file=MODEL)
    rows = sentencepiece.encode(wide, MODEL, ["doc_id", "text"], check_every=2).collect()
    assert Counter(tuple(r["token_ids"]) for r in rows) == Counter(tuple(sp.encode(r[1] or "")) for r in ROWS)
    assert all(r["round_trip"] and r["parity"] in (None, True) for r in rows)
    assert sentencepiece.encode(empty, MODEL, ["doc_id"]).count() == 0


def test_every_text_is_compared_and_decoded_by_the_rebuilt_tokenizer(monkeypatch):
    from tokenizers import decoders
    data = open(MODEL, "rb").read()
    texts = [f"text number {i}" for i in range(200)] + ["", None]
    got = sentencepiece.coder(data)()(texts)
    assert got["parity"] == [True] * len(texts) and all(got["round_trip"])
    whole = sentencepiece.rebuild

    def broken(model):
        tokenizer = whole(model)
        tokenizer.decoder = decoders.Fuse()
        return tokenizer
    monkeypatch.setattr(sentencepiece, "rebuild", broken)
    assert not any(sentencepiece.coder(data)()(texts[:200])["round_trip"])


def message(*fields):
    """A protobuf message of (number, value) fields."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_models(squeeze):
    import sentencepiece as library
    words = [("▁", -3.0), ("▁the", -2.0), ("▁t", -4.0), ("he", -4.5), ("c", -5.0), ("a", -5.1), ("t", -5.2), ("cat", -4.0), ("h", -6.0), ("e", -6.1)]
    pieces = [(b"<unk>", 0.0, 2), (b"<s>", 0.0, 3), (b"</s>", 0.0, 3)] + [(f"<0x{i:02X}>".encode(), 0.0, 6) for i in range(256)]
    pieces += [(w.encode(), s, 1) for w, s in words]
    data = b"".join(message((1, message((1, p), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1), (35, 1), (40, 0))), (3, message((1, b"identity"), (3, 1), (4, squeeze), (5, 1))))
    sp = library.SentencePieceProcessor(model_proto=data)
    model = sentencepiece.parse(data)
    with pytest.raises(ValueError):
        sentencepiece.parse(data + message((1, message((1, b"[NEW]"), (2, 0.0), (3, 4)))))
    assert (model.kind, model.byte_fallback, model.squeeze) == (sentencepiece.UNIGRAM, True, bool(squeeze))
    tokenizer = sentencepiece.rebuild(model)
    for text in ["the cat", "  the   cat ", "that", "thé", "", "hat thecat", "<s>the", "cat\nthe 🙂"]:
        assert tokenizer.encode(text, add_special_tokens=False).ids == sp.encode(text), text
