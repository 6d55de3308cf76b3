"""Quality classifier: logistic regression on hashed word n-grams, learnt by FTRL-proximal.

* **Features.** Words are runs of letters and digits or of other visible characters, in their own
  case. Each word and each pair of neighbours is hashed into one of ``DIMENSIONS`` buckets. Two
  more buckets count the abstract n-grams "a word again" and "a word again after one other", which
  no list of words holds. A bucket's value is 1 + ln(count), and a text's values have length 1.
* **Learning.** Follow-the-regularised-leader keeps two numbers per bucket: ``z``, the sum of
  gradients less what the weights already moved, and ``n``, the sum of squared gradients. The weight
  is their closed form, zero where z is within the L1 penalty, so rare buckets stay out. Examples
  lie in shards of ``PER_SHARD``; in each of ``ROUNDS`` rounds every shard goes on from the same state
  through its own examples, one by one, and each bucket moves by the mean of the shards that saw it.
  What shards report is rounded to whole numbers, so sums don't depend on their order and reruns
  agree.
* **Scoring.** A sparse dot product of a text's values with the weights, through the logistic
  function, in one pass over whole texts.

About ``SAMPLE`` labelled ids are learnt from, chosen by a hash; that bounds the examples, and
``DIMENSIONS`` bounds the state that goes through the driver and to the workers. Corpus size changes
neither. Only texts are inputs of a score.

Defined results: null and empty texts, or such without a word, have no features; their score is that
of the constant alone. Of rows that share a labelled id the least text is the example; several labels
of an id count as 1 if one of them is 1. Null labels and null ids teach nothing. Without examples every
score is 0.5. Repeated rows all get the same score; an empty table gives an empty one. Columns other
than id and text are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import Memo, per_process, slices, text_or_empty
from newsloom.session import materialise, scratch_folder

DIMENSIONS = 1 << 18
SAMPLE = 16_000
#: A shard has about so many examples, so that a few still teach one weight each.
PER_SHARD = 2500
ROUNDS = 6
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.2, 0.0
THRESHOLD = 0.3
WORDS = re.compile(r"\w+|[^\w\s]+")
MEMO_WORDS = 200_000
SLICE_BYTES = 1 << 20
#: Odd 64-bit numbers for multiplicative hashing, the second and third for the abstract n-grams.
FACTOR, AGAIN, AGAIN_LATER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: What a unit is in the whole numbers that shards report.
UNIT = 1 << 32


def buckets_of(hashes):
    import numpy as np

    return ((hashes * np.uint64(FACTOR)) >> np.uint64(65 - DIMENSIONS.bit_length())).astype(np.int64)


def features(texts: list[str]):
    """Buckets, values, and the number of the text each is from, sorted by text and bucket."""
    import numpy as np
    import xxhash

    memo = per_process("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest, MEMO_WORDS))
    words = [WORDS.findall(text) for text in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    h = np.fromiter((memo[w] for ws in words for w in ws), dtype=np.uint64, count=int(lengths.sum()))
    text = np.repeat(np.arange(len(texts)), lengths)
    near, later = text[:-1] == text[1:], text[:-2] == text[2:]
    left, right = h[:-1][near], h[1:][near]
    again = text[:-1][near][left == right]
    after_one = text[:-2][later & (h[:-2] == h[2:])]
    hashes = [h, left * np.uint64(31) + right, np.full(len(again), AGAIN, np.uint64),
              np.full(len(after_one), AGAIN_LATER, np.uint64)]
    where = np.concatenate([text, text[:-1][near], again, after_one])
    key, count = np.unique(where * DIMENSIONS + buckets_of(np.concatenate(hashes)), return_counts=True)
    text, value = key // DIMENSIONS, 1 + np.log(count)
    length = np.sqrt(np.bincount(text, value * value, minlength=len(texts)))
    return key % DIMENSIONS, value / length[text], text


def weights(z, n):
    """The weights that minimise the regularised sum of all gradients so far."""
    import numpy as np

    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def learn_from(z, n, examples) -> None:
    """Move ``z`` and ``n`` by each of (label, buckets, values), in order."""
    import numpy as np

    for label, at, value in examples:
        at, value = np.append(at, DIMENSIONS), np.append(value, 1.0)
        w, before = weights(z[at], n[at]), n[at]
        gradient = (1 / (1 + np.exp(-(w @ value))) - label) * value
        after = before + gradient * gradient
        z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
        n[at] = after


def _examples(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for start, texts in slices(batch.column("text"), SLICE_BYTES):
            bucket, value, text = features(texts)
            at = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(start, len(texts)), batch.column("label").slice(start, len(texts)),
                 pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))),
                 pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))],
                names=["id", "label", "buckets", "values"])


def _round(state):
    """What each shard of the stored examples adds to the state, in one pass over its rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def moved(z, n):
            seen = np.flatnonzero(n != state.value[1])
            dz, dn = (np.rint((x - x0)[seen] * UNIT).astype(np.int64) for x, x0 in zip((z, n), state.value))
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.astype(np.int32)), pa.array(dz), pa.array(dn)], names=["bucket", "dz", "dn"])

        current, z, n = None, None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for start, stop in zip(edges, edges[1:]):
                part = batch.slice(start, stop - start)
                if part.num_rows and shards[start] != current:
                    if current is not None:
                        yield moved(z, n)
                    current, (z, n) = shards[start], (x.copy() for x in state.value)
                learn_from(z, n, zip(*(part.column(c).to_pylist() if c == "label" else _arrays(part.column(c))
                                       for c in ("label", "buckets", "values"))))
        if current is not None:
            yield moved(z, n)
    return run


def _arrays(lists):
    flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    return [flat[i - at[0]:j - at[0]] for i, j in zip(at, at[1:])]


def in_shards(examples: DataFrame, n_shards: int) -> DataFrame:
    """The examples as stored files, one shard to a file, so that rounds move no examples.

    A file has far fewer bytes than a row group, so one task reads it whole.
    """
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(n_shards)).cast("int")
    folder = scratch_folder(examples.sparkSession)
    dealt = examples.withColumn("shard", shard).repartition(n_shards, "shard")
    dealt.sortWithinPartitions("shard", F.xxhash64("id")).write.partitionBy("shard").parquet(folder)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in examples.schema.fields)
    return examples.sparkSession.read.schema(f"{kept}, shard int").parquet(folder)


def labelled_texts(
    docs: DataFrame, labels: DataFrame, learns: Column, id_col: str, text_col: str, label_col: str
) -> tuple[DataFrame, int]:
    """(id, label, text) of about ``SAMPLE`` labelled ids for which ``learns`` holds, and about how
    many those are."""
    known = materialise(
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learns)
        .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("label")))
    n_known = known.count()
    share = min(1.0, SAMPLE / max(1, n_known))
    drawn = F.pmod(F.xxhash64("id", F.lit("drawn")), F.lit(1 << 30)) < int(share * (1 << 30))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # About SAMPLE rows of two numbers, whatever the size of the table.
    chosen = texts.join(F.broadcast(known.filter(drawn)), "id")
    return chosen.groupBy("id", "label").agg(F.min("text").alias("text")), min(SAMPLE, n_known)


def fit(
    docs: DataFrame, labels: DataFrame, learns: Column | None = None, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality",
):
    """Weights of all buckets, the constant last."""
    import numpy as np

    spark = docs.sparkSession
    chosen, n_examples = labelled_texts(
        docs, labels, F.lit(True) if learns is None else learns, id_col, text_col, label_col)
    kind = chosen.schema["id"].dataType.simpleString()
    examples = chosen.mapInArrow(_examples, f"id {kind}, label int, buckets array<int>, values array<float>")
    learnt = in_shards(examples, max(1, -(-n_examples // PER_SHARD))).drop("id")
    state = np.zeros((2, DIMENSIONS + 1))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(state)
        moved = learnt.mapInArrow(_round(shared), "bucket int, dz bigint, dn bigint")
        # At most one row per bucket.
        mean = moved.groupBy("bucket").agg(
            F.sum("dz").alias("dz"), F.sum("dn").alias("dn"), F.count(F.lit(1)).alias("shards")).toArrow()
        bucket, dz, dn, shards = (mean.column(c).to_numpy() for c in ("bucket", "dz", "dn", "shards"))
        state = state.copy()
        state[:, bucket] += np.stack([dz, dn]) / shards / UNIT
        shared.unpersist()
    return weights(*state)


def _score(model, text_col: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = model.value
        for batch in batches:
            scores = []
            for _, texts in slices(batch.column(text_col), SLICE_BYTES):
                bucket, value, text = features(texts)
                margin = w[-1] + np.bincount(text, w[bucket] * value, minlength=len(texts))
                scores.append(1 / (1 + np.exp(-margin)))
            kept = [n for n in batch.schema.names if n != text_col]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array(np.concatenate(scores or [[]]), pa.float64())],
                names=[*kept, "score"])
    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: how likely label 1 is by ``model``, the weights of ``fit``."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(id_col, text_col).mapInArrow(_score(shared, text_col), f"{id_col} {kind}, score double")
