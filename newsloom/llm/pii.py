"""Personal data: overlapping candidates, scored by boosted trees, cut at calibrated thresholds.

1. **Generators** propose spans. Four exact ones find e-mail addresses, IPv4 addresses,
   payment cards and telephone numbers; these base spans are always redacted. Wide ones
   propose anything like them, and long tokens that could be secrets.
2. **Features** of each wide candidate are its format (length, kinds of characters, entropy,
   separators) and its context (what stands before it, whether that names a credential).
3. **Boosted trees** (Spark's own) are trained on the corpus's own candidates. Their labels
   are weak: a candidate counts as personal if it overlaps a base span or has the shape of a
   known credential. Half of all candidates trains, half calibrates.
4. **Thresholds** are, per kind, the lowest score at which the calibration half reaches
   ``PRECISION``; a kind that never does adds nothing. Of overlapping candidates above their
   threshold the highest score wins, and none is added that overlaps a base span.

Texts are read once, whole, in Arrow batches; what is stored between the passes are spans and
features. Training and calibration take every candidate; the driver gets counts by score only.

Base searches take time in proportion to the text, also where it is one endless word.

Defined results: a null or empty text has no spans, and a null one stays null when redacted. Rows
are independent, so repeated rows, ties and null ids don't matter; an empty table gives an empty
table and trains nothing. Other columns stay and may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import slices
from newsloom.session import materialise

KINDS = ["email", "ip", "card", "phone"]
#: Steps of the scores that thresholds are chosen from.
GRID = 10_000
PRECISION = 0.99
TREES = {"maxIter": 10, "maxDepth": 3, "seed": 7, "checkpointInterval": -1}
SLICE_BYTES = 1 << 20
SPAN = "struct<kind:string,start:bigint,end:bigint>"
CANDIDATE = "struct<kind:string,start:bigint,end:bigint,label:double,features:array<double>>"

#: Shapes that a base span has.
LOCAL = r"[A-Za-z0-9._%+-]"
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]+){2}\.[0-9]+"
CARD = r"[0-9](?:[ -]?[0-9])+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Wide shapes, and shapes of credentials that are known to be ones.
WIDE = {
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}",
    "number": r"(?<![0-9])[0-9](?:[ ().-]{0,2}[0-9]){6,}",
    "address": r"(?<!\S)[^\s@]{1,64}@[^\s@]{1,255}(?!\S)",
    "hex_address": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])",
}
KNOWN_SECRET = r"AKIA[0-9A-Z]{16}|[0-9a-f]{32,}|(?=.*[0-9])(?=.*[a-z])[0-9a-z]{18,}"
CREDENTIAL = r"(?:password|passwd|pwd|token|secret|api_?key|key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?$"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses. Each starts at the start of its run, or where the last one ended."""
    import re

    spans, end, local, domain = [], 0, re.compile(LOCAL), re.compile(DOMAIN)
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and local.match(text, start - 1):
            start -= 1
        if start < at and (found := domain.match(text, at + 1)):
            end = found.end()
            spans.append((start, end))
        at = text.find("@", max(at + 1, end))
    return spans


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by start, then kind; a match that fails its check is dropped whole."""
    import re

    spans = [("email", *span) for span in emails(text)] if "@" in text else []
    for m in re.finditer(IP, text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(CARD, text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(PHONE, text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and its context; no check of a base span is among them."""
    import re
    from collections import Counter
    from math import log2

    span, before = text[start:end], text[max(0, start - 24):start]
    n = len(span)
    counts = Counter(span)
    entropy = -sum(c / n * log2(c / n) for c in counts.values())
    digits = sum(map(str.isdigit, span))
    upper = sum("A" <= c <= "Z" for c in span)
    lower = sum("a" <= c <= "z" for c in span)
    return [float(x) for x in (
        list(WIDE).index(kind), n, digits / n, upper / n, lower / n,
        sum(c in "0123456789abcdef" for c in span) / n, entropy, span.count("."), span.count("-"),
        span.count(" "), span.count("@"), span.count(":"), digits,
        re.search(CREDENTIAL, before, re.I) is not None, before.endswith("+"),
        before[-1:].isalnum(), text[end:end + 1].isalnum(), before[-1:] in "\"'=:(",
    )]


def wide_candidates(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    import re

    found = []
    for kind, shape in WIDE.items():
        for m in re.finditer(shape, text):
            start, end = m.span()
            personal = any(s < end and start < e for _, s, e in base) or (
                kind == "secret" and re.fullmatch(KNOWN_SECRET, m[0]) is not None)
            found.append({"kind": kind, "start": start, "end": end, "label": float(personal),
                          "features": features(text, start, end, kind)})
    return found


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _propose(id_col: str, text_col: str):
    def run(batches):
        import hashlib

        import pyarrow as pa

        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        candidate = pa.struct([*span, pa.field("label", pa.float64()),
                               pa.field("features", pa.list_(pa.float64()))])
        types = [*[pa.int64()] * 4, pa.string(), pa.list_(span), pa.list_(candidate)]
        names = [*[f"n_{kind}" for kind in KINDS], "base_sha256", "base", "wide"]
        for batch in batches:
            for start, texts in slices(batch.column(text_col), SLICE_BYTES):
                rows = []
                for text in texts:
                    base = base_spans(text)
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    counts = [sum(kind == k for k, _, _ in base) for kind in KINDS]
                    rows.append((*counts, digest,
                                 [dict(zip(("kind", "start", "end"), s)) for s in base],
                                 wide_candidates(text, base)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(start, len(texts)),
                     *[pa.array(list(c), t) for c, t in zip(zip(*rows), types)]],
                    names=["id", *names])
    return run


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the base spans, their counts and digest, and the wide candidates."""
    return docs.select(id_col, text_col).mapInArrow(_propose(id_col, text_col), (
        f"id {docs.schema[id_col].dataType.simpleString()}, n_email bigint, n_ip bigint, "
        f"n_card bigint, n_phone bigint, base_sha256 string, base array<{SPAN}>, "
        f"wide array<{CANDIDATE}>"
    ))


def exported(model) -> list[tuple[float, list]]:
    """Spark's trees as (weight, nodes); a node is (feature, threshold, left, right, value)."""
    def flat(node, nodes):
        here = len(nodes)
        nodes.append(None)
        if node.subtreeDepth() == 0:
            nodes[here] = (-1, 0.0, here, here, node.prediction())
        else:
            left = flat(node.leftChild(), nodes)
            right = flat(node.rightChild(), nodes)
            split = node.split()
            nodes[here] = (split.featureIndex(), split.threshold(), left, right, 0.0)
        return here

    trees = []
    for weight, tree in zip(model.treeWeights, model.trees):
        nodes = []
        flat(tree._java_obj.rootNode(), nodes)
        trees.append((float(weight), nodes))
    return trees


def scores(trees, rows):
    """Probabilities of feature rows; all rows go down one tree at a time."""
    import numpy as np

    x = np.asarray(rows, dtype=float)
    margin = np.zeros(len(x))
    for weight, nodes in trees:
        feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
        at = np.zeros(len(x), dtype=int)
        while (feature[at] >= 0).any():
            inner = feature[at] >= 0
            goes_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        margin += weight * value[at]
    return 1 / (1 + np.exp(-2 * margin))


def train(proposed: DataFrame):
    """Trees and thresholds per kind from all candidates: one half trains, the other calibrates.

    No trees if the training half shows one label only.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    drawn = F.pmod(F.xxhash64("id", "c.start", "c.kind"), F.lit(1 << 20))
    candidates = materialise(proposed.select("id", F.explode("wide").alias("c")).select(
        "c.kind", "c.label", "c.features", (drawn % 2 == 0).alias("trains")))
    training = candidates.filter("trains")
    if training.select("label").distinct().count() < 2:
        return [], {}
    model = GBTClassifier(**TREES).fit(
        training.select("label", array_to_vector("features").alias("features"))
    )
    trees = exported(model)
    return trees, calibrated(trees, candidates.filter("not trains"))


def step_of(p):
    """Scores as steps of the grid."""
    import numpy as np

    return np.floor(np.asarray(p) * GRID)


def _steps(trees):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                p = scores(trees, batch.column("features").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kind"), pa.array(step_of(p).astype(int), pa.int64()), batch.column("label")],
                    names=["kind", "step", "label"])
    return run


def calibrated(trees, held_out: DataFrame) -> dict[str, float]:
    """Per kind the lowest step of the grid from which on ``PRECISION`` is reached, 0.5 at least."""
    import numpy as np

    steps = held_out.select("kind", "label", "features").mapInArrow(
        _steps(trees), "kind string, step bigint, label double")
    # At most GRID rows of a kind, whatever the corpus.
    counts = steps.groupBy("kind", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()
    thresholds = {}
    for kind in WIDE:
        rows = sorted((r for r in counts if r.kind == kind), key=lambda r: -r.step)
        precise = np.cumsum([r.good for r in rows]) / np.cumsum([r.n for r in rows]) >= PRECISION if rows else []
        if any(precise):
            thresholds[kind] = max(0.5, rows[int(np.flatnonzero(precise)[-1])].step / GRID)
    return thresholds


def _select(trees, thresholds):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            base = batch.column("base").to_pylist()
            wide = batch.column("wide").to_pylist()
            flat = [(i, c) for i, cs in enumerate(wide) for c in cs if c["kind"] in thresholds]
            p = scores(trees, [c["features"] for _, c in flat]) if flat else []
            spans = [[(s["kind"], s["start"], s["end"]) for s in row] for row in base]
            best = sorted(zip(p, flat), key=lambda x: (-x[0], x[1][0], x[1][1]["start"], x[1][1]["kind"]))
            for chance, (i, c) in best:
                free = all(e <= c["start"] or c["end"] <= s for _, s, e in spans[i])
                if step_of(chance) / GRID >= thresholds[c["kind"]] and free:
                    spans[i].append((c["kind"], c["start"], c["end"]))
            order = [*KINDS, *WIDE]
            texts = [joined(sorted(row, key=lambda s: (s[1], order.index(s[0])))) for row in spans]
            kept = [n for n in batch.schema.names if n not in ("base", "wide")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array(texts, pa.string())],
                names=[*kept, "spans"])
    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the counts and digest of base spans, and all spans to redact."""
    proposed = materialise(propose(docs, id_col, text_col))
    trees, thresholds = train(proposed)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in proposed.schema.fields
              if f.name not in ("base", "wide")]
    found = proposed.mapInArrow(_select(trees, thresholds), ", ".join([*fields, "spans string"]))
    return found.withColumnRenamed("id", id_col)


def _redacted(text: str, spans: str) -> str:
    out, at = [], 0
    for span in spans.split(",") if spans else []:
        kind, start, end = span.split(":")
        if int(start) >= at:
            out += [text[at:int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


def redact(
    docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with each span of each text replaced by its kind in brackets.

    Spans are found, selected and replaced in the pass that holds the text, so ids need not tell
    rows apart and may be null; null texts stay null, and columns may have any names. ``model`` is
    what ``train`` gave, by default for these documents.
    """
    trees, thresholds = model or train(materialise(propose(docs, id_col, text_col)))
    chosen = _select(trees, thresholds)

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        candidate = pa.list_(pa.struct([*span.value_type, pa.field("label", pa.float64()),
                                        pa.field("features", pa.list_(pa.float64()))]))
        for batch in batches:
            whole, texts = batch.column(text_col), []
            for start, part in slices(whole, SLICE_BYTES):
                base = [base_spans(text) for text in part]
                found = pa.RecordBatch.from_arrays(
                    [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in base], span),
                     pa.array([wide_candidates(t, b) for t, b in zip(part, base)], candidate)],
                    names=["base", "wide"])
                spans = next(chosen([found])).column("spans").to_pylist()
                texts += [_redacted(t, s) if whole[start + i].is_valid else None
                          for i, (t, s) in enumerate(zip(part, spans))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in batch.schema.names],
                names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
