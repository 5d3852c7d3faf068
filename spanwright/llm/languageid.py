"""Language identification by compression with per-language dictionaries.

A language is a raw-content zstandard dictionary: a bounded sample of its
labelled texts.  A text is compressed once per language and belongs to the one
that makes it smallest.  It is rejected if the second language comes nearer
than it does for labelled texts of that language and length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import map_texts

# Bounds of the model: PIECE_BYTES of at most SAMPLE_TEXTS texts a language, of
# which the first DICTIONARY_TEXTS make the dictionary; margins are fitted on all.
SAMPLE_TEXTS = 256
DICTIONARY_TEXTS = 64
PIECE_BYTES = 4096
# Texts are compressed in blocks, so that the dictionary counts all along a long text.
BLOCK_BYTES = 4096
# Below this level zstandard misses most matches in a dictionary.
LEVEL = 5
# A short text can be too small to be compressed at all, so that languages tie:
# then it is put behind a start text of each language, the last START_SHARE of
# its sample, which is not in the dictionary, and what it adds counts.
SHORT_BYTES = 512
START_SHARE = 1 / 8
TIE = 0.0005
# A language's texts of each of these lengths are classified by a model that has
# not seen them; the margin that all but this share of them reach is the least one.
LENGTHS = (32, 64, 128, 256, 512, 1024, 2048, 4096)
FOLDS = 4
LOST_SHARE = 0.005
UNKNOWN = "und"


@dataclass
class Model:
    """Dictionaries and start texts by language, in the order of the languages'
    names, and least margins by language and length."""
    dictionaries: dict[str, bytes]
    starts: dict[str, bytes]
    least: dict[tuple[str, int], float] = field(default_factory=dict)


def train(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, piece_bytes: int = PIECE_BYTES) -> Model:
    """Learn from rows where ``usable`` holds, with a language and a text.

    The texts are those with the smallest hash of their id, found in two steps
    (per language and salt, then per language), so a language with most of
    the rows is spread over tasks.  The driver holds the sample only:
    languages x ``sample_texts`` x ``piece_bytes``, cut from the texts' starts.
    """
    named = docs.where(usable & F.col(lang).isNotNull() & (F.length(F.trim(F.col(text))) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(7), F.col(doc_id)).alias("h"))
    # Only languages and hashes are sorted; the few texts are fetched after.
    first = Window.partitionBy("lang", "salt").orderBy("h")
    then = Window.partitionBy("lang").orderBy("h")
    few = (named.select("lang", "h").distinct().withColumn("salt", F.pmod(F.col("h"), F.lit(97)))
           .select("*", F.row_number().over(first).alias("r")).where(F.col("r") <= sample_texts)
           .select("lang", "h", F.row_number().over(then).alias("n")).where(F.col("n") <= sample_texts))
    # At most sample_texts rows a language: small whatever the table.
    chosen = few.select(F.col("lang").alias("l"), F.col("h").alias("g"))
    rows = named.select("lang", "h", F.substring("text", 1, 4 * piece_bytes).alias("piece")).join(
        F.broadcast(chosen), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("g")))
    # Of rows that share an id the smallest text stands for all.
    pieces: dict[str, list[bytes]] = {}
    for row in rows.groupBy("lang", "h").agg(F.min("piece").alias("piece")).orderBy("lang", "h").collect():
        pieces.setdefault(row["lang"], []).append(normal(row["piece"])[:piece_bytes])
    model = model_of(pieces, piece_bytes)
    model.least = least_margins(docs.sparkSession, pieces, piece_bytes) if pieces else {}
    return model


def model_of(pieces: dict[str, list[bytes]], piece_bytes: int = PIECE_BYTES, without: int | None = None) -> Model:
    """Of each language's first texts (but those of the fold ``without``) the
    last bytes are its start text.  No language's part depends on another's."""
    model = Model({}, {})
    for name, texts in sorted(pieces.items()):
        content = b" ".join(t for i, t in enumerate(texts[:DICTIONARY_TEXTS]) if i % FOLDS != without)
        cut = len(content) - int(len(content) * START_SHARE)
        model.dictionaries[name], model.starts[name] = content[:cut], content[cut:][:piece_bytes]
    return model


def least_margins(spark, pieces: dict[str, list[bytes]], piece_bytes: int = PIECE_BYTES,
                  lost: float = LOST_SHARE) -> dict[tuple[str, int], float]:
    """By language and length the margin that all but the share ``lost`` of its
    sampled texts, cut to that length, reach.  Each text is classified by
    dictionaries without its fold; texts taken for another language don't count."""
    rows = [(name, i % FOLDS, text) for name, texts in pieces.items() for i, text in enumerate(texts)]
    sample = spark.createDataFrame(rows, "lang string, fold int, piece binary").repartition(
        spark.sparkContext.defaultParallelism, "fold", "piece")

    def run(batches):
        import pyarrow as pa
        works = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                fold, text = row["fold"], row["piece"]
                if fold not in works:
                    works[fold] = classifier(model_of(pieces, piece_bytes, fold))()
                sizes = [n for n in LENGTHS if n <= len(text)]
                got = works[fold]([text[:n].decode(errors="ignore") for n in sizes])
                out += [(row["lang"], n, m) for n, p, m in zip(sizes, got["lang_pred"], got["margin"]) if p == row["lang"]]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in
                                              enumerate((pa.string(), pa.int32(), pa.float64()))], names=["lang", "n", "margin"])

    found = sample.mapInArrow(run, "lang string, n int, margin double").groupBy("lang", "n").agg(
        F.percentile("margin", F.lit(lost)).alias("least"))
    return {(r["lang"], r["n"]): r["least"] for r in found.collect()}


def normal(text: str) -> bytes:
    """The letters of a text: lower case, one blank between words, no word twice
    in a row.  So capitals, digits, marks and stuttering say nothing."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    return " ".join([w for w, last in zip(words, [None, *words]) if w != last]).encode()


def classifier(model: Model, block_bytes: int = BLOCK_BYTES, level: int = LEVEL):
    """A maker of functions from texts to ``lang_pred, score, margin, rejected``."""
    dictionaries, starts, wanted = model.dictionaries, list(model.starts.values()), model.least

    def make():
        import zstandard
        names, packers = list(dictionaries), []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packers.append(zstandard.ZstdCompressor(
                level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

        begun = [len(p.compress(s)) for p, s in zip(packers, starts)]

        def least(sizes):
            """The language of the smallest size, and by what share the second is longer."""
            best = min(sizes, key=lambda i: (sizes[i], names[i]))
            second = min((n for i, n in sizes.items() if i != best), default=None)
            return best, 1.0 if second is None else (second - sizes[best]) / max(second, 1)

        def one(text):
            if not text or not names or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0, 0.0, True
            data = normal(text)
            blocks = [data[i:i + block_bytes] for i in range(0, len(data), block_bytes)]
            sizes = {i: sum(len(p.compress(x)) for x in blocks) for i, p in enumerate(packers)}
            best, margin = least(sizes)
            if margin < TIE and len(data) < SHORT_BYTES:
                # Only among those that tie, so that no third language comes in.
                best, margin = least({i: max(0, len(packers[i].compress(starts[i] + b" " + data)) - begun[i])
                                      for i, n in sizes.items() if n <= sizes[best] * (1 + TIE)})
            # Margins fall and rise with the length, so the lesser of both neighbours counts.
            below = max((n for n in LENGTHS if n <= len(data)), default=0)
            above = min((n for n in LENGTHS if n > len(data)), default=below)
            least_margin = max(TIE, min(wanted.get((names[best], n), 0.0) for n in (below, above)))
            return names[best], 1 - 0.5 * 2.0 ** (-margin * 64), margin, margin < least_margin

        def work(texts):
            got = [one(t) for t in texts]
            return {name: [g[i] for g in got] for i, name in enumerate(("lang_pred", "score", "margin", "rejected"))}
        return work
    return make


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected``.

    The letters of the whole text are compressed with every dictionary.  ``margin`` is the share
    by which the second language is longer.  Below what :func:`least_margins`
    found for the language and the length of the text, and at a tie, the row is
    ``rejected`` (it keeps its nearest language): texts of two languages, or of
    one that was not learned.  A text that is null, empty
    or without a letter, or a model without languages, gives ``und``, score 0,
    rejected.  Ties go to the smaller name.  Rows are independent: repeated
    rows get equal answers, an empty table gives none.
    """
    return map_texts(docs, keep, text, "lang_pred string, score double, margin double, rejected boolean", classifier(model))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of the documents that are not rejected, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    got = predict(plain, model, plain.columns, f"c{docs.columns.index(text)}")
    return got.where(~F.col("rejected")).select(*plain.columns).toDF(*docs.columns)


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by the CRC of the id; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
