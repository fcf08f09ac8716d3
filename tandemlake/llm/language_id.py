"""Language identification by compression.

Each language has a zstandard dictionary of raw content, made of its own texts. A text is encoded once with each
dictionary and gets the language whose dictionary makes it smallest. Long texts are encoded in pieces of PIECE bytes, all
of them, so that the dictionary stays within reach and a text's own repetitions don't drown it. The score is the share by
which the runner-up is larger; a prediction whose score is below the margin, or 0, is rejected, at every size alike.

A dictionary holds the words that most labelled rows of its language have, the most frequent last, as far as DICTIONARY
bytes go. The words of every labelled row are counted, by tasks into tables that Spark sums. A word that is much more common
in another language stays out, so that wrong labels don't fill a dictionary, and so does a word of a single row where the
language has others. How common a word must be to fit is told by the bytes of the words of each of LEVELS levels a doubling;
of the words, only those chosen reach the driver.

The margin is learned from the scores of all labelled rows: the highest multiple of 1 / STEPS that no more than a share of
LOST of the right predictions stay below. Every text is judged once; the scores are stored, and the margin and the result
are taken from them. Both sides are lower-cased with each run of other characters than letters made one space.

Defined results: null texts and texts without a letter are `und` with score 0 and are rejected; with no labelled rows
every text is. Equal sizes are a score of 0 and are rejected; they go to the language with more labelled rows, then to the
smaller in code point order. Very long texts are read whole, one row at a time. A null id is neither held out nor learned
from. Repeated rows are judged alike. An empty table gives an empty result. Other columns, of whatever name, aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, stored

UNKNOWN = "und"
#: Bytes of a dictionary, and the share of a word's highest rate in any language that it needs in a dictionary's own.
DICTIONARY, COMMON = 48_000, 0.25
#: Levels of how common words are, for each doubling of their rows.
LEVELS = 32
#: The share of right predictions that may be rejected, the steps of the margin, and the bytes that are encoded at once.
LOST, STEPS, PIECE = 0.002, 1 << 13, 16 * 1024
#: Words (some 100 bytes each) that a task counts before it sends its table on.
TABLE = 100_000
#: Up to so many rejected texts (32 bytes each) are broadcast to the documents; more are joined by shuffle.
BROADCAST_TEXTS = 200_000
#: zstandard's parameters; matches of three bytes count, as words of a language are short.
PARAMETERS = {"window_log": 18, "chain_log": 16, "hash_log": 17, "search_log": 4, "min_match": 3, "strategy": zstandard.STRATEGY_BTOPT}


@dataclass(frozen=True)
class Model:
    """Dictionaries as (language, content), the language with most labelled rows first, and the margin."""

    dictionaries: tuple[tuple[str, bytes], ...]
    margin: float = 0.0


def letters(text: Column) -> Column:
    """Lower case, each run of other characters than letters and their marks made one space; null without a letter."""
    return F.when(text.rlike(r"\p{L}"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _draw(seed: int) -> Column:
    """A number in 0 to 1 from the row's id."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _learned_from() -> Column:
    """Whether a row may be learned from: one with a label, a text and an id that isn't held out."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))


def word_rows(labelled: DataFrame, table: int = TABLE) -> DataFrame:
    """lang, word, n: how many rows of a language have a word; with a null word, how many rows it has."""

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[str, Counter[str | None]] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                arrays = [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                seen[lang.as_py()].update({None, *(text.as_py() or "").split()})
                if sum(map(len, seen.values())) >= table:
                    yield from out()
        yield from out()

    counted = labelled.select("lang", letters(F.col("text")).alias("text")).mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def chosen_words(counted: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """lang, word, n: the words of each language's dictionary, from counts as word_rows makes them."""
    rows = counted.where("word is null").select("lang", F.col("n").alias("rows"))
    rated = counted.where("word is not null").join(F.broadcast(rows), "lang").withColumn("rate", F.col("n") / F.col("rows"))
    own = rated.withColumn("highest", F.max("rate").over(Window.partitionBy("word"))).where(F.col("rate") >= COMMON * F.col("highest"))
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    own = stored(own.select("lang", "word", "n", (F.octet_length("word") + 1).alias("bytes"), level.alias("level")))
    # the border is the first level, from above, whose words don't all fit
    upto: Counter[str] = Counter()
    border: dict[str, int] = {}
    least: dict[str, int] = {}
    for r in sorted(own.groupBy("lang", "level").agg(F.sum("bytes").alias("bytes")).collect(), key=lambda r: -r["level"]):
        upto[r["lang"]] += r["bytes"]
        if upto[r["lang"]] > size:
            border.setdefault(r["lang"], r["level"])
        least.setdefault(r["lang"], min(1, r["level"]))  # a language whose words have a row each has level 0 alone
    borders = own.sparkSession.createDataFrame([(lang, border.get(lang, 0), n) for lang, n in least.items()], "lang string, border int, least int")
    near = own.join(F.broadcast(borders), "lang").where("level >= border and level >= least")
    # of the words at the border as many as fit; none is shorter than a letter and a space
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size // 2)
    near = near.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return near.where(F.col("upto") <= size).select("lang", "word", "n")


def trained(docs: DataFrame, sample_rows: int | None = None) -> Model:
    """The dictionaries of docs' labelled rows that aren't held out: of all, or of sample_rows of each language."""
    labelled = docs.select("doc_id", "text", "lang").where(_learned_from())
    if sample_rows is not None:
        first = F.row_number().over(Window.partitionBy("lang").orderBy(_draw(0), "text"))
        labelled = labelled.withColumn("place", first).where(F.col("place") <= sample_rows)
    counted = stored(word_rows(labelled))
    rows = {r["lang"]: r["n"] for r in counted.where("word is null").collect()}  # a row for each language
    if not rows:
        return Model(())
    words: dict[str, list[str]] = {lang: [] for lang in rows}
    for r in sorted(chosen_words(counted).collect(), key=lambda r: (r["n"], r["word"])):
        words[r["lang"]].append(r["word"])
    return Model(tuple((lang, " ".join(words[lang]).encode()) for lang in sorted(rows, key=lambda lang: (-rows[lang], lang))))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, lang_pred, score, right (predicted as labelled, on a row that may be learned from), stored."""
    out = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_hash"), F.when(_learned_from(), F.col("lang")).alias("label"), predictions(F.col("text"), model, docs).alias("p"))
    right = F.coalesce(F.col("label") == F.col("p.lang_pred"), F.lit(False))
    return stored(out.select("doc_id", "text_hash", "p.lang_pred", "p.score", right.alias("right")))


def _with_margin(model: Model, scored: DataFrame, lost: float) -> Model:
    """model with the margin that the scores tell: counts of at most STEPS + 1 steps reach the driver."""
    step = F.floor(F.col("score") * STEPS).alias("step")
    steps = sorted((r["step"], r["n"]) for r in scored.where("right").groupBy(step).agg(F.count("*").alias("n")).collect())
    below, margin, all_rows = 0, 0, sum(n for _, n in steps)
    for at, n in steps:
        if below > lost * all_rows:
            break
        margin, below = at, below + n
    return replace(model, margin=margin / STEPS)


def _rejected(model: Model) -> Column:
    return (F.col("score") == 0) | (F.col("score") < model.margin)


def learn(docs: DataFrame, sample_rows: int | None = None, lost: float = LOST) -> Model:
    """The model of docs' labelled rows that aren't held out, with its margin."""
    model = trained(docs, sample_rows)
    return _with_margin(model, _scored(docs.where(_learned_from()), model), lost)


@lru_cache(maxsize=512)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(3, **PARAMETERS, write_content_size=0, write_checksum=0, write_dict_id=0)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=held)


def encoded_sizes(text: str, dictionaries: list[bytes]) -> list[int]:
    """Bytes of the whole text with each dictionary."""
    raw = text.encode("utf-8", "replace")
    return [sum(len(_compressor(content).compress(raw[i : i + PIECE])) for i in range(0, len(raw), PIECE)) for content in dictionaries]


def judge(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(language, score in 0 to 1, rejected) of a text as letters() makes it; null stands for a text without a letter."""
    if text is None or not model.dictionaries:
        return UNKNOWN, 0.0, True
    sizes = encoded_sizes(text, [content for _, content in model.dictionaries])
    best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
    others = [s for i, s in enumerate(sizes) if i != best]
    if not others:
        return model.dictionaries[best][0], 1.0, False
    score = (min(others) - sizes[best]) / max(1, min(others))
    return model.dictionaries[best][0], score, score == 0 or score < model.margin


def predictions(text: Column, model: Model, docs: DataFrame) -> Column:
    """Struct lang_pred, score, rejected of a text column. The text alone decides; no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    @giving_back
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [judge(t.as_py(), shared.value) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())],
                names=["lang_pred", "score", "rejected"],
            )
        _compressor.cache_clear()

    return judged(letters(text))


def identify(docs: DataFrame, sample_rows: int | None = None, lost: float = LOST) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs."""
    model = trained(docs, sample_rows)
    scored = _scored(docs, model)
    model = _with_margin(model, scored, lost)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", _rejected(model).alias("rejected"))


def accepted(docs: DataFrame, sample_rows: int | None = None, lost: float = LOST) -> DataFrame:
    """The rows of docs whose language is told, with docs' columns. Texts stay where they are: rejected ones, often few, go."""
    model = trained(docs, sample_rows)
    if not model.dictionaries:
        return docs.where(F.lit(False))
    scored = _scored(docs, model)
    gone = stored(scored.where(_rejected(_with_margin(model, scored, lost)) & F.col("text_hash").isNotNull()).select("text_hash").distinct())
    if gone.count() <= BROADCAST_TEXTS:
        gone = F.broadcast(gone)
    named = docs.select(F.struct("*").alias("row")).where("row.text is not null")
    return named.join(gone, F.unhex(F.sha2(F.col("row.text"), 256)) == F.col("text_hash"), "left_anti").select("row.*")
