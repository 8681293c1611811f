"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Text that compresses far better than prose of its length repeats itself; text that hardly
compresses is noise.  A whole document hides one bad part among good ones, so fixed chunks are held
to limits of their own.  Limits depend on length, because short texts compress less: fixed wide ones,
and narrow ones from the ratios of all documents of about the same length and script, each text counted
once, so that a group of copies does not set the limit for others.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoweave.llm.common import map_texts, stored, words_of, wrapped
from repoweave.sources.scratch import broadcast_if_small

LEVEL = 3
CHUNK = 4096
#: A last chunk shorter than this is judged with the whole document only.
LEAST_CHUNK = 1024
#: Bytes of a document up to which a row holds, least and largest ratio (original by compressed).
#: Prose of many languages lies between about 1.4 (short) and 3 (long); limits leave a wide margin.
BANDS = (
    (256, 0.0, 3.0),
    (1024, 1.1, 3.5),
    (4096, 1.25, 4.0),
    (16384, 1.35, 4.5),
    (float("inf"), 1.4, 5.0),
)
CHUNK_BAND = (1.2, 4.0)
#: A document is rejected if more than this share of its chunks lies outside the chunk band.
BAD_CHUNKS = 0.2
#: Limits from the corpus lie this many interquartile ranges off the median, or this share of it if that is more,
#: above and below.  Text that repeats itself shows above; the lower limit is for noise only.
ABOVE, ABOVE_SHARE = 2.0, 0.05
BELOW, BELOW_SHARE = 6.0, 0.12
#: Length classes to a doubling of the bytes, and distinct texts that a class needs for limits of its own;
#: smaller classes have the fixed limits only.
CLASSES = 2
LEAST_TEXTS = 50

LEAST_WORDS = 50
REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"

_SCHEMA = (
    "_row long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, ratio double, bad_chunks long, n_chunks long, n_bytes long, "
    "n_points long, digest long, kept boolean"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found at least twice."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0  # words before ``end`` have been counted or passed
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode())


def _judge_step():
    import zstandard
    from xxhash import xxh64_intdigest

    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)

    def ratio(data: bytes) -> float:
        return len(data) / len(compressor.compress(data)) if data else 1.0

    def within(text: bytes) -> tuple[float, int, int, bool]:
        whole = ratio(text)
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        if chunks and len(chunks[-1]) < LEAST_CHUNK:
            chunks.pop()
        if len(chunks) == 1 and len(text) <= CHUNK:
            ratios = [whole]
        else:
            ratios = [ratio(c) for c in chunks]
        bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in ratios)
        least, most = next((lo, hi) for size, lo, hi in BANDS if len(text) <= size)
        return whole, bad, len(ratios), least <= whole <= most and bad <= BAD_CHUNKS * len(ratios)

    def step(texts, rest):
        out = {name: [] for name in (f.split()[0] for f in _SCHEMA.split(","))}
        for text in texts:
            words = words_of(text)
            repeats = repeated_words(words)
            blanks = len(text) - len(text.translate(None, _BLANKS))
            failed = len(words) < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
            whole, bad, chunks, fits = within(text)
            for name, value in (
                ("n_words", len(words)), ("word_chars", code_points(text) - blanks),
                ("n_bytes", len(text)), ("n_points", code_points(text)), ("digest", xxh64_intdigest(text) >> 1),
                ("n_symbols", len(text) - len(text.translate(None, _SYMBOLS))),
                ("n_dup_lines", duplicate_lines(text)), ("n_repeat_words", repeats),
                ("base_failed", failed), ("ratio", whole), ("bad_chunks", bad), ("n_chunks", chunks),
                ("kept", fits and not failed),
            ):
                out[name].append(value)
        return out | rest

    return step


def _class() -> list[Column]:
    """Length class, and half bytes per code point, which part scripts; two short lists of values."""
    length = F.floor(CLASSES * F.log2(F.greatest("n_bytes", F.lit(1)))).cast("int")
    return [length.alias("length"), F.floor(2 * F.col("n_bytes") / F.greatest("n_points", F.lit(1))).cast("int").alias("script")]


def limits(judged: DataFrame) -> DataFrame:
    """(length, script, least, most): ratios in thousandths between which the texts of a class are kept.

    Over distinct texts of all rows that pass the fixed limits.  Quartiles come from counts per ratio,
    which are bounded by the number of classes and ratios.
    """
    milli = F.round(1000 * F.col("ratio")).cast("int").alias("milli")
    texts = judged.where("kept").select(*_class(), milli, "digest").distinct()
    counts = texts.groupBy("length", "script", "milli").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("length", "script")
    upto = F.sum("n").over(group.orderBy("milli"))
    ranked = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(group)).where(F.col("total") >= LEAST_TEXTS)
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("milli")))
    quartiles = ranked.groupBy("length", "script").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    off = lambda times, share: F.greatest(times * (F.col("q3") - F.col("q1")), share * F.col("q2"))
    return quartiles.select(
        "length", "script", (F.col("q2") - off(BELOW, BELOW_SHARE)).alias("least"), (F.col("q2") + off(ABOVE, ABOVE_SHARE)).alias("most")
    )


def _judged(rows: DataFrame) -> DataFrame:
    """Rows (_row, doc_id, text) with the columns of ``_SCHEMA`` and the limits that held."""
    judged = stored(map_texts(rows, _judge_step, _SCHEMA), "quality-counts")
    length, script = _class()
    bands = stored(limits(judged), "quality-limits")
    both = judged.withColumns({"length": length, "script": script}).join(broadcast_if_small(bands), ["length", "script"], "left")
    within = (F.round(1000 * F.col("ratio")) >= F.col("least")) & (F.round(1000 * F.col("ratio")) <= F.col("most"))
    return both.withColumn("kept", F.col("kept") & F.coalesce(within, F.lit(True)))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base counts, the ratios and whether the document is kept.

    ``least`` and ``most`` are the limits of its class in thousandths, null where it has none.  Null and
    empty texts have no words, fail the base and are not kept.  Repeated rows are judged alike.  A null
    doc_id stays null.  Columns other than doc_id and text are not looked at.
    """
    rows = docs.select(
        "text", F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id")
    )
    return _judged(rows).drop("_row", "length", "script", "n_bytes", "n_points", "digest")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns.

    The rows are staged with locators, judged, and those that fail are taken out by locator.
    """
    staged = stored(wrapped(docs, F.col("doc_id").cast("bigint").alias("doc_id")), "quality-docs")
    judged = _judged(staged.select(F.col("_doc.text").alias("text"), "_row", "doc_id"))
    bad = stored(judged.where(~F.col("kept")).select("_row"), "quality-bad")
    return staged.join(broadcast_if_small(bad), "_row", "left_anti").select("_doc.*")
