"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

A document is its tokens and an end token. Longer ones are cut, so a piece has at most
``capacity`` tokens and there are at most that many different lengths and gaps. Documents
and gaps are therefore kept as classes of equal size with counts, and each round works on
all of them at once:

* both are sorted by size, and one sweep from large to small finds each document class its
  successors, the smallest gaps that hold it;
* classes that want the same gap are ranked, longest first; a class that comes too late takes
  the next larger gap that is free. A sequence takes as many documents of a class as fit,
  which is what best fit does with equal lengths: the gap just made is again the smallest
  that holds the next one;
* gaps are updated, and what found no sequence goes on to the next round. When nothing could
  be placed, as many empty sequences are opened as the left tokens fill.

Counting lengths, ranking pieces and placing them are Spark jobs over all pieces. The rounds
see classes only, never documents: the driver holds at most ``capacity`` of them and their
placements, whatever the corpus. Each piece gets its rank among the pieces of its length,
from counts of hashed slices and a row number inside a slice; a length that a third of all
pieces share is cut into many slices. Length and rank name the place.

Tokens are those the library gives for the whole text. The vocabulary drops white space and
looks at nothing across it, so each distinct word is encoded once per worker and remembered.

Defined results: a null or empty text is the end token alone. Repeated rows are packed each.
Null ids are ids like others. An empty table gives an empty table. Extra columns stay with
each piece; ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from newsloom.llm.common import given_back, parts, per_process
from newsloom.session import materialise

CAPACITY = 4096
END_ID = 1
#: A worker remembers at most so many words and bytes of words beside those of its last slice.
MEMO_WORDS = 400_000
MEMO_BYTES = 32 << 20
#: So many words are encoded as one text, with this between them.
AT_ONCE = 500
MARK = "\0"
#: Bytes of text encoded at once.
SLICE_BYTES = 2 << 20
#: No slice of a length holds more than this share of all pieces.
SLICES = 512
PIECE = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def word_encoder(vocabulary: str):
    """A function from an Arrow column of texts to each text's ids, through a memo of words.

    Distinct words are looked up once for all texts. New ones go to the library many to a text, with
    a mark between them that has an id of its own; where the ids show another number of marks, each
    word goes by itself. The memo is Arrow columns, a tenth of what dictionaries of words take.

    Arrow also splits at four control characters that the tokenizer takes for symbols;
    texts beside one of them are split by the tokenizer's white space.
    """
    import os
    import re
    from itertools import batched

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    separators = "[\x1c-\x1f]"
    spaces = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def encoded(*texts):
        return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    [mark] = encoded(MARK)

    def ids_of(words):
        """How many ids each word has, and all ids."""
        sizes, every = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for chunk in batched(words, AT_ONCE):
            [ids] = encoded(f" {MARK} ".join(chunk))
            is_mark = ids == mark[0] if len(mark) == 1 else np.ones(len(ids), bool)
            at = np.flatnonzero(is_mark)
            if len(at) == len(chunk) - 1 and "".join(chunk).count(MARK) == 0:
                sizes.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
                every.append(ids[~is_mark])
            else:
                alone = encoded(*chunk)
                sizes.append(np.array([len(i) for i in alone], np.int64))
                every += alone
        return np.concatenate(sizes), np.concatenate(every)

    def gathered(word, sizes, every):
        """Ends of the ids of each of ``word``, numbers of words, and these ids."""
        ends = np.append(0, np.cumsum(sizes[word]))
        starts = np.cumsum(sizes) - sizes
        return ends, every[np.arange(ends[-1]) + np.repeat(starts[word] - ends[:-1], sizes[word])]

    memo = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(texts):
        nonlocal memo
        texts = pc.fill_null(texts, "").cast(pa.string())
        if pc.any(pc.match_substring_regex(texts, separators)).as_py():
            split = pa.array([spaces.split(text) for text in texts.to_pylist()], pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, word = coded.dictionary, coded.indices.to_numpy()
        place = pc.index_in(words, value_set=memo[0])
        new = words.filter(place.is_null())
        sizes, every = ids_of(new.to_numpy(zero_copy_only=False).tolist())
        place = place.to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(place), len(memo[0]) + np.cumsum(np.isnan(place)) - 1, place).astype(np.int64)
        memo = pa.concat_arrays([memo[0], new]), np.append(memo[1], sizes), np.append(memo[2], every)
        ends, found = gathered(place[word], *memo[1:])
        if len(memo[0]) > MEMO_WORDS or memo[0].nbytes > MEMO_BYTES:
            last, ids = gathered(place, *memo[1:])
            memo = words, np.diff(last), ids
            if words.nbytes > MEMO_BYTES:
                memo = words[:0], memo[1][:0], memo[2][:0]
        lengths = pc.list_value_length(split).to_numpy()
        stops = ends[np.append(0, np.cumsum(lengths))].tolist()
        return [found[a:b] for a, b in zip(stops, stops[1:])]
    return encode


def _cut(vocabulary: str, text_col: str, kept: list[str], capacity: int, with_ids: bool):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = per_process(f"words of {vocabulary}", lambda: word_encoder(vocabulary))

        def cut(table):
            for first, texts in parts(table.column(text_col), SLICE_BYTES):
                rows, pieces, numbers = [], [], []
                for i, ids in enumerate(encode(texts)):
                    ids = np.append(ids, np.array(END_ID, "<u4"))
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at:at + capacity]
                        rows.append(first + i)
                        pieces.append((k, at, len(part), zlib.crc32(part)))
                        if with_ids:
                            numbers.append(part.view("<i4"))
                columns = list(zip(*pieces)) or [()] * 4
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [*[table.column(c).take(pa.array(rows, pa.int64())) for c in kept],
                     *[pa.array(c, t) for c, t in zip(columns, types)],
                     *[pa.array(numbers, pa.list_(pa.int32()))] * with_ids],
                    names=[*kept, *PIECE.names, *["ids"] * with_ids],
                )

        # Batches may be far smaller than what is encoded at once.
        held, size = [], 0
        for batch in given_back(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE_BYTES:
                yield from cut(pa.concat_batches(held))
                held, size = [], 0
        if held:
            yield from cut(pa.concat_batches(held))
    return run


def cut_documents(
    docs: DataFrame, vocabulary: str, text_col: str = "text", capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: the columns of ``docs`` but the text, and the piece's place and CRC."""
    fields = [f for f in docs.schema.fields
              if f.name not in (text_col, *PIECE.names, "ids", "sequence_id", "offset")]
    kept = [f.name for f in fields]
    schema = T.StructType([*fields, *PIECE.fields, *[IDS] * with_ids])
    return docs.select(*kept, text_col).mapInArrow(
        _cut(vocabulary, text_col, kept, capacity, with_ids), schema
    )


PLAN = "_length long, copies long, item long, first long, bins long, _offset long"


def sweep(items: dict[int, int], gaps: list[tuple[int, int, int]]):
    """One round: each class takes the smallest gaps that hold it, the longest class first.

    ``items`` counts documents by length; a gap is (size, first sequence, sequences). From
    large to small, gaps are stacked before the classes that fit them, so the top is always
    the best fit, and a gap that a longer class took is gone for this round. Returns the
    placements (length, copies, sequences' first, number, gap before) and the gaps not taken.
    """
    waiting, stack, placed = sorted(gaps), [], []
    for length in sorted(items, reverse=True):
        while waiting and waiting[-1][0] >= length:
            stack.append(waiting.pop())
        count = items[length]
        while count and stack:
            gap, first, bins = stack.pop()
            fits = gap // length
            full = min(bins, count // fits)
            if full:
                placed.append((length, fits, first, full, gap))
                count -= full * fits
            if full < bins and count:
                placed.append((length, count, first + full, 1, gap))
                count, full = 0, full + 1
            if full < bins:
                stack.append((gap, first + full, bins - full))
    return placed, waiting + stack


def plan_classes(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Where the documents of each length go, as rows of ``PLAN``.

    ``copies`` documents of a length, from number ``item`` on, go into each of ``bins``
    sequences from number ``first`` on, at the offset.
    """
    left, done = dict(counts), dict.fromkeys(counts, 0)
    gaps, opened, plan = [], 0, []
    while left:
        placed, gaps = sweep(left, gaps)
        for length, copies, first, bins, gap in placed:
            plan.append((length, copies, done[length], first, bins, capacity - gap))
            done[length] += copies * bins
            gaps.append((gap - copies * length, first, bins))
        left = {length: n - done[length] for length, n in counts.items() if n > done[length]}
        if left and not placed:
            new = -(-sum(length * n for length, n in left.items()) // capacity)
            gaps.append((capacity, opened, new))
            opened += new
        gaps = [gap for gap in gaps if left and gap[0] >= min(left)]
    return plan


def ranked_in_length(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``pieces`` with ``_rank``, gapless from 0 among those of the same length."""
    lengths = materialise(pieces.groupBy("length").count())
    total = lengths.agg(F.sum("count")).first()[0] or 0
    most = max(1, -(-total // SLICES))
    cut = lengths.select("length", F.ceil(F.col("count") / most).cast("long").alias("_slices"))
    sliced = pieces.join(F.broadcast(cut), "length").withColumn(
        "_slice", F.pmod(F.xxhash64(*keys), F.col("_slices"))
    )
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = materialise(sliced.groupBy("length", "_slice").count().select(
        "length", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    ))
    row = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*keys))
    # At most one row per length and slice: capacity and SLICES bound it.
    numbered = sliced.withColumn("_row", row).join(F.broadcast(starts), ["length", "_slice"])
    return numbered.withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop(
        "_slices", "_slice", "_row", "_before"
    )


def pack(
    pieces: DataFrame, keys: list[str], capacity: int = CAPACITY
) -> DataFrame:
    """``pieces`` (with ``length``, told apart by ``keys``) with sequence_id and offset.

    Uses ``pieces`` more than once: hand over a stored table.
    """
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = pieces.sparkSession.createDataFrame(plan_classes(counts, capacity), PLAN)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ranked = ranked_in_length(pieces.select(*kept), keys).alias("r")
    nth = F.col("_rank") - F.col("p.item")
    here = (F.col("r.length") == F.col("_length")) & (nth >= 0) & (
        nth < F.col("p.copies") * F.col("p.bins")
    )
    return ranked.join(plan.alias("p"), here).select(
        *[F.col(f"r.{c}") for c in kept],
        (F.col("p.first") + F.floor(nth / F.col("p.copies"))).alias("sequence_id"),
        (F.col("p._offset") + nth % F.col("p.copies") * F.col("r.length")).alias("offset"),
    )


def fill_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces with ids; each is within the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"),
    )


def pack_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """Cut, store and pack all documents."""
    pieces = materialise(cut_documents(docs, vocabulary, text_col, capacity))
    return pack(pieces, [id_col, "piece"], capacity)
