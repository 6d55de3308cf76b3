"""Quality rules by tokeniser fertility: how a public vocabulary takes a text apart.

A byte-fallback vocabulary is run over every whole text. Text like what it was made of
gives long tokens, junk gives short ones, foreign characters fall back to bytes, and text
that repeats itself has little entropy. The measures are

* ``chars_per_token``: code points of the text per token,
* ``byte_share``: share of tokens that are single bytes of characters it lacks,
* ``token_entropy``: entropy of the text's tokens in bits, and from it ``entropy_gap``, what
  it lacks of the most that so many tokens (``LONG`` at most) could have.

Bands are set per language, or per script where the language is null, and per class of
length, two classes to a doubling of tokens, from the quartiles of all documents that pass the
base rules: all three measures follow the length of a text, and so does their spread. A text is
rejected if a measure lies some spreads (``BANDS``) from the median of its class. The spread is
twice the way from the median to the nearer quartile, since junk stretches one side only. It has
a floor, so that a class of much the same texts doesn't reject its own, and texts that measure
the same count once, so that copies don't set the band of the rest. A class with fewer than
``LEAST`` texts takes the band of a class twice or four times as wide, at last that of the whole
language, with more room for short texts. Few documents therefore fall out unless they stand far
off texts of their language and length.

Base rules: fewer than 10 words, or more than 20 % of words in repeated 5-word windows.

Defined results: null and empty texts have no words and fail the base rules. Rows are judged
one by one, so repeated rows all get the same result, and nulls in other columns don't
matter; an empty table gives an empty table. Extra columns stay; the columns in ``MEASURES``
and ``base_failed``, ``kept`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsloom.llm.common import SPACES, aside, given_back, slices
from newsloom.session import materialise

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
LONG = 512
SLICE_BYTES = 512 << 10
#: Per measure: spreads around the median, the least spread as a part that shrinks with the root
#: of the tokens and one that doesn't, and whether the band of a whole language gives short texts
#: more room, because their means vary more.
BANDS = {
    "chars_per_token": (4.0, 0.5, 0.005, True),
    "byte_share": (5.0, 0.12, 0.001, True),
    "entropy_gap": (1.75, 2.0, 0.05, False),
}
#: Too little of these is no fault.
ONE_SIDED = ("byte_share", "entropy_gap")
#: In the band of a whole language, a text of so many tokens gets root two of the room of a very
#: long one.
STEADY = 1000.0
#: So many texts that differ in their measures make a band.
LEAST = 50
#: Classes of length are halved in number so often to find them; the last holds all lengths.
HALVINGS = (0, 1, 2, 7)
MEASURES = T.StructType([
    *[T.StructField(name, T.LongType()) for name in
      ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")],
    *[T.StructField(name, T.DoubleType()) for name in
      ("chars_per_token", "byte_share", "token_entropy", "entropy_gap")],
    T.StructField("script", T.StringType()),
])


def repeated_words(words: list[list]) -> list[int]:
    """Per text the words that lie in a window of five found twice or more in that text.

    Windows are numbered step by step out of pairs of numbers, so equal numbers mean equal
    windows and no hash can collide.
    """
    import numpy as np
    import pandas as pd

    lengths = np.array([len(w) for w in words])
    total = int(lengths.sum())
    if total < WINDOW:
        return [0] * len(words)
    flat = np.empty(total, dtype=object)
    flat[:] = [word for text in words for word in text]
    word = pd.factorize(flat)[0].astype(np.int64)
    text = np.repeat(np.arange(len(words)), lengths)

    def numbered(left, right):
        return pd.factorize(left * (int(right.max()) + 1) + right)[0].astype(np.int64)

    pair = numbered(word[:-1], word[1:])
    four = numbered(pair[:-2], pair[2:])
    five = numbered(four[:-1], word[4:])
    start = np.flatnonzero(text[:-4] == text[4:])
    if not len(start):
        return [0] * len(words)
    window = numbered(five[start], text[start])
    again = start[np.bincount(window)[window] > 1]
    edges = np.bincount(again, minlength=total + WINDOW) - np.bincount(
        again + WINDOW, minlength=total + WINDOW)
    covered = np.cumsum(edges)[:total] > 0
    return np.bincount(text[covered], minlength=len(words)).tolist()


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


#: Ends of some blocks of code points, in order, with the script of each.
SCRIPT_ENDS = [0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0x3040, 0x3100,
               0x3400, 0xA000, 0xAC00, 0xD7B0, 0x110000]
SCRIPTS = ["Latin", "other", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "other",
           "Devanagari", "other", "Kana", "other", "Han", "other", "Hangul", "other"]


def script_of(text: str) -> str:
    """The script of most letters; blocks of code points stand for scripts."""
    import numpy as np

    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le"), dtype="<u4")
    if not len(points):
        return "none"
    return SCRIPTS[np.bincount(np.searchsorted(SCRIPT_ENDS, points, side="right")).argmax()]


def fertility(ids: list[int], text: str, is_byte) -> tuple:
    """Tokens, characters per token, byte share, entropy and entropy gap of one text."""
    import numpy as np

    if not ids:
        return 0, None, None, None, None
    n = len(ids)
    share = np.unique(ids, return_counts=True)[1] / n
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    gap = float(np.log2(min(n, LONG))) - entropy
    return n, len(text) / n, float(is_byte[ids].sum()) / n, entropy, gap


def _measure(vocabulary: str, text_col: str, lang_col: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        for batch in given_back(batches):
            langs = batch.column(lang_col).to_pylist()
            rows = []
            for start, texts in slices(batch.column(text_col), SLICE_BYTES):
                words = [text.encode().split() for text in texts]
                repeats = repeated_words(words)
                for i, (text, ids) in enumerate(zip(texts, model.encode(texts, num_threads=1))):
                    rows.append((
                        len(words[i]), len(text) - sum(map(text.count, SPACES)),
                        sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats[i],
                        *fertility(ids, text, is_byte),
                        script_of(text) if langs[start + i] is None else None,
                    ))
            columns = list(zip(*rows)) if rows else [[]] * len(MEASURES)
            types = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=[*batch.schema.names, *MEASURES.names],
            )

    return run


def measure(
    docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` with the measures of each text. One pass, in Arrow batches."""
    kept = docs.drop(*MEASURES.names, "base_failed", "kept")
    schema = T.StructType([*kept.schema.fields, *MEASURES.fields])
    return kept.mapInArrow(_measure(vocabulary, text_col, lang_col), schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def group_of(lang_col: str = "lang") -> Column:
    return F.coalesce(F.concat(F.lit("lang "), lang_col), F.concat(F.lit("script "), "script"))


def length_class() -> Column:
    """Two classes to a doubling of tokens; halving the number gives a class twice as wide."""
    return F.floor(2 * F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")


def bands(measured: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Per language or script and class of length the median and spread of each measure.

    From all rows that pass the base. Few rows, stored, so that joins can broadcast them.
    """
    texts = measured.filter(~base_failed()).select(
        group_of(lang_col).alias("band_of"), length_class().alias("band_class"), "n_tokens", *BANDS
    ).distinct().drop("n_tokens")
    wider = F.explode(F.array(*[
        F.struct(F.lit(times).alias("halved"), F.shiftright("band_class", times).alias("wide"))
        for times in HALVINGS
    ]))
    found = materialise(
        texts.select("*", wider.alias("w")).groupBy("band_of", "w.halved", "w.wide").agg(
            F.count(F.lit(1)).alias("texts"),
            *[F.percentile_approx(name, [0.25, 0.5, 0.75], 10000).alias(name) for name in BANDS],
        )
    )
    spreads = []
    for name in BANDS:
        low, middle, high = (F.col(name)[i] for i in range(3))
        spreads += [middle.alias(f"middle_{name}"),
                    (2 * F.least(middle - low, high - middle)).alias(f"spread_{name}")]
    enough = found.filter((F.col("texts") >= LEAST) | (F.col("halved") == HALVINGS[-1])).select(
        "band_of", "halved", "wide", *spreads)
    classes = found.filter(F.col("halved") == 0).select("band_of", F.col("wide").alias("band_class"))
    finest = classes.select("*", wider.alias("w")).select("band_of", "band_class", "w.*").join(
        enough, ["band_of", "halved", "wide"]
    ).groupBy("band_of", "band_class").agg(F.min(F.struct("halved", *enough.columns[3:])).alias("b"))
    return materialise(finest.select("band_of", "band_class", "b.*"))


def judge(measured: DataFrame, limits: DataFrame, lang_col: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept."""
    within = ~base_failed()
    tokens = F.greatest("n_tokens", F.lit(1))
    for name, (width, by_root, floor, widened) in BANDS.items():
        room = width * F.greatest(F.col(f"spread_{name}"), by_root / F.sqrt(tokens) + floor)
        if widened:
            room = room * F.when(F.col("halved") == HALVINGS[-1], F.sqrt(1 + STEADY / tokens)).otherwise(1.0)
        within = within & (F.col(name) <= F.col(f"middle_{name}") + room)
        if name not in ONE_SIDED:
            within = within & (F.col(name) >= F.col(f"middle_{name}") - room)
    kept = measured.columns
    return measured.withColumns({"band_of": group_of(lang_col), "band_class": length_class()}).join(
        limits, ["band_of", "band_class"], "left"
    ).select(
        *kept, base_failed().alias("base_failed"),
        F.coalesce(within, ~base_failed()).alias("kept"),
    )


def keep_good(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they had."""
    moved, restored = aside(docs, [*MEASURES.names, "base_failed", "kept", "band_of", "band_class", "halved"])
    measured = materialise(measure(moved, vocabulary, text_col, lang_col))
    return restored(judge(measured, bands(measured, lang_col), lang_col).filter("kept"))
