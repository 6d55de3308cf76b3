"""The operators of ``newsloom.llm`` against SQL, brute force and awkward rows."""

import re
import zlib
from collections import Counter

import compare
import pytest
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import (
    chat_format, exact_dedup, mixing, ngram_join, packing, pii, quality_rules, sharding,
    token_counts, url_filters,
)
from newsloom.llm.queries import ORACLE, QUERIES, RULES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, hash int, kept int, h int"
PROSE = "the cat sat on the mat and looked at a bird that sang in the old tree near our house"


def awkward(spark):
    """Nulls everywhere, empty and long texts, repeats, a null id and columns that clash."""
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE.upper(), "en", "a"), (3, PROSE, None, "b"),
        (3, PROSE, None, "b"), (None, PROSE + " too", "en", None), (4, None, None, None),
        (5, "", "en", "b"), (6, " \n\t", "en", "b"), (7, "one two", "xx", "c"),
        (8, "word " * 30_000, "en", "c"), (9, "x" * 200_000, "en", "a"),
        (10, "Ünïcode ← text <|endoftext|> a@b.de +49 30 1234567", "de", "c"),
    ]
    return spark.createDataFrame([(*r, None, "s", 1, 2, 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    con = compare.connection(SF_DIR)
    df = QUERIES[name](spark, SF_DIR)
    assert compare.spark_rows(df) == compare.duck_rows(con, ORACLE[name])
    assert not compare.type_differences(df, con, ORACLE[name])


def test_url_rules(spark):
    urls = ["http://NET", "http://a.net/", "https://example.net/en/x", "http://xnet/", None, "x",
            "http://example.com/de/?q", "http://www.example.com/fr", "http://org/fr/", "http://a.net/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = url_filters.rule_entries(spark.sql(RULES))
    listed = rules.unionByName(url_filters.url_entries(
        spark.createDataFrame([("https://WWW.example.com:443/fr#top",), (None,)], "url string")))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(pages, listed).collect()}
    block, allow = (None, "block"), (None, "allow")
    assert got == {
        0: allow, 1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: allow, 4: allow,
        5: allow, 6: ("example.com/de/", "block"), 7: block, 8: ("org/fr/", "allow"),
        9: ("net/", "block"),
    }
    assert url_filters.filter_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filters.filter_urls(pages, listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    entries = keys.filter("key like '%7'")
    hits = url_filters.possible_hits(keys, url_filters.bloom_filter(entries, 13), 13)
    assert entries.join(hits, "key", "left_anti").count() == 0
    assert hits.count() < 600


def test_token_counts(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    cache, name = str(tmp_path / "cache"), vocabulary("byte_bpe_50k.json")
    for _ in range(2):
        for r in token_counts.count_tokens(docs, name, cache).collect():
            assert r.n_tokens == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
            assert r.n_bytes == len((r.text or "").encode())

    def never(_):
        raise AssertionError("a hit was encoded")
    again = token_counts.count_tokens(docs, name, cache, make_counter=lambda v: lambda texts: never(v) if texts else [])
    assert again.count() == docs.count()
    assert token_counts.count_tokens(empty, name, cache).count() == 0


def test_quality_measures(docs, small, empty):
    measured = quality_rules.measure(small.select("text", "lang"), vocabulary("piece_bpe_32k.model"))
    for r in measured.collect():
        words = WORD.findall(r.text)
        grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (
            len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
    kept = quality_rules.keep_good(docs, vocabulary("piece_bpe_32k.model"))
    assert kept.columns == docs.columns
    assert {1, 3} <= {r.doc_id for r in kept.collect()} <= {1, 2, 3, None}
    assert quality_rules.keep_good(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def test_quality_bands_follow_length(spark):
    """Planted junk, short and long, falls out, and clean texts of its language stay."""
    import random

    random.seed(3)
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en' and doc_id < 3000")
    rows = table.select("doc_id", "text", "lang").collect()
    rows = [r for r in rows if r.text and not re.search(r"[#*$%&|<>]{2}| [|] ", r.text)]
    clean = [r for r in rows if len(WORD.findall(r.text)) >= 60]
    planted = {"short": [], "long": []}
    for i, r in enumerate(clean[:40]):
        words = WORD.findall(r.text)
        words = random.sample(words, 60) if i % 2 else words
        mark = "{} |" if i % 4 < 2 else "{}***"
        text = " ".join(mark.format(w) if random.random() < 0.9 else w for w in words)
        planted["short" if i % 2 else "long"].append((-1 - i, text, "en"))
    table = [*map(tuple, rows), *planted["short"], *planted["long"]]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    measured = quality_rules.measure(docs, vocabulary("piece_bpe_32k.model")).cache()
    judged = quality_rules.judge(measured, quality_rules.bands(measured)).filter("not base_failed").collect()
    kept = {r.doc_id for r in judged if r.kept}
    for name, junk in planted.items():
        assert len(kept & {i for i, _, _ in junk}) <= len(junk) // 10, name
    clean_ids = {r.doc_id for r in clean} & {r.doc_id for r in judged}
    assert len(kept & clean_ids) >= 0.98 * len(clean_ids)


def test_sharding(docs, empty, spark):
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    for rows in (hot, docs):
        out = sharding.shard(rows, 8).collect()
        assert len(out) == rows.count()
        for s in {r.shard for r in out}:
            slots = sorted(r.slot for r in out if r.shard == s)
            assert slots == list(range(len(slots)))
    sizes = Counter()
    for r in sharding.shard(hot, 8).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 12
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.lit("same")])
def test_exact_dedup(docs, empty, content_hash):
    report = exact_dedup.duplicate_report(docs, keep="largest", content_hash=content_hash).collect()
    assert len(report) == docs.count()
    assert {(r.keep_id, r.group_size) for r in report if r.doc_id in (1, 2, 3)} == {(3, 4)}
    assert {(r.keep_id, r.group_size) for r in report if r.doc_id in (4, 5)} == {(5, 2)}
    one = exact_dedup.deduplicate(docs, content_hash=content_hash)
    assert one.columns == docs.columns
    assert Counter(r.doc_id for r in one.collect()) == Counter([1, None, 4, 6, 7, 8, 9, 10])
    assert exact_dedup.deduplicate(empty).count() == exact_dedup.duplicate_report(empty).count() == 0


def test_packing(docs, small, empty, spark):
    from tokenizers import Tokenizer

    tokenizer, name = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), vocabulary("word_bpe_49k.json")
    odd = spark.createDataFrame([(90, "a\x1cb  c d e <|endoftext|>f\x85 ΣΑΣ é")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(small.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text")).unionByName(odd)
    pieces = packing.cut_documents(both.filter("doc_id != 3"), name, with_ids=True).cache()
    got = {}
    for r in pieces.orderBy("doc_id", "piece").collect():
        assert r.start == 4096 * r.piece == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += r.ids
    for r in both.filter("doc_id != 3").collect():
        assert got[r.doc_id] == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
    packed = packing.pack(pieces, ["doc_id", "piece"])
    rows = packed.collect()
    assert len(rows) == pieces.count()
    assert all(zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32 for r in rows)
    filled = packing.fill_sequences(packed).collect()
    assert max(len(r.ids) for r in filled) <= 4096
    tokens = sum(len(r.ids) for r in filled)
    assert tokens == sum(r.length for r in rows) and len(filled) <= -(-tokens // 4096) + 1
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert packing.pack_documents(empty, name).count() == 0
    assert packing.pack_documents(docs.filter("doc_id = 3"), name).count() == 2


def test_chat_templates(spark):
    turns = [("user", "<|im_end|>\\<\\|x"), ("a\nb\\n<|", ""), ("assistant", "a"), ("assistant", "b<")]
    assert chat_format.read_back(chat_format.chat_template(turns)) == turns
    text, spans = chat_format.locate(chat_format.chat_template, turns)
    assert [chat_format.unescape(text[s:e]) for _, _, s, e in spans] == [t for _, t in turns]
    rewriting = lambda ts: f"{len(ts)} turns" + "".join(t for _, t in ts)
    assert chat_format.locate(rewriting, turns)[1] is None
    rows = spark.createDataFrame(
        [(None, None, None, None), (1, 2, "assistant", "x"), (1, 1, "user", None), (1, 1, "user", None)],
        "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.digests(chat_format.format_chats(rows)).collect()}
    assert got == {None: (1, 0), 1: (3, 1)}
    assert chat_format.format_chats(rows.limit(0)).count() == 0
    assert chat_format.format_chats(rows, template=rewriting).filter("rewritten").count() >= 1
    told = {r.conv_id: (r.n_turns, r.loss_sha256) for r in chat_format.digests(
        chat_format.format_chats(rows, template=rewriting)).collect()}
    assert told[1] == (None, None) and set(told) == {None, 1}


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))
    assert mixing.mix(empty).count() == 0


def plain_spans(text):
    shapes = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[ -]", "", m)) <= 19 and pii.luhn(re.sub("[ -]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    found = [(k, *m.span()) for k, (p, ok) in shapes.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii(docs, small, empty):
    tricky = ["a@b.c_d@e.f", "@@a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4 x+1 (2) 3456789012",
              "4111 1111-1111 1111", "41111111111111112", "+1((((((", "a.b%c+d-e@x-y.z..", "1" * 50_000]
    for text in [*tricky, *[r.text for r in small.collect()]]:
        assert pii.base_spans(text) == plain_spans(text)
    found = pii.find_pii(small).collect()
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in found:
        base = [f"{k}:{s}:{e}" for k, s, e in plain_spans(texts[r.doc_id])]
        assert set(base) <= set(r.spans.split(",")) | {""}
    hidden = pii.redact(small).filter("text rlike '@[a-z0-9]+[.]example'")
    assert hidden.count() == 0
    model = pii.train(pii.propose(small))
    odd = docs.select("doc_id", "text", "lang", F.lit(1).alias("base"), F.lit("x").alias("spans"), F.lit("w").alias("wide"))
    mail = odd.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("mail a@b.de now")})
    odd = odd.unionAll(mail).unionAll(mail)
    clean = pii.redact(odd, model)
    assert clean.columns == odd.columns
    texts = Counter((r.doc_id, r.text) for r in clean.collect())
    assert texts[(None, "mail [email] now")] == 2 and texts[(4, None)] == 1 and texts[(5, "")] == 1
    assert sum(texts.values()) == odd.count() and pii.redact(odd.limit(0), model).count() == 0
    assert {r.doc_id: r.n_email for r in pii.find_pii(docs).collect()}[10] == 1
    assert pii.find_pii(empty).count() == 0


def one_word_apart(n, length=60):
    """Copies of a text that each differ from it in one word."""
    base = [f"w{i}" for i in range(length)]
    texts = []
    for i in range(n):
        words = list(base)
        words[(i * 37) % length] = f"other{i}"
        texts.append(" ".join(words))
    return texts


def test_ngram_join_of_hot_lists_does_not_square(spark, monkeypatch):
    """Near copies that are hardly alike: pairs grow with their number, and none is lost."""
    sizes = []
    kept = ngram_join.candidate_pairs

    def counted(*args):
        pairs = kept(*args)
        sizes[-1] += pairs.count()
        return pairs
    monkeypatch.setattr(ngram_join, "candidate_pairs", counted)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 10)
    for n in (150, 600):
        sizes.append(0)
        df = spark.createDataFrame(list(enumerate(one_word_apart(n))), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in ngram_join.join_documents(df).collect()}
        assert got == brute_components(one_word_apart(n))
    assert sizes[1] <= 6 * sizes[0]


def test_ngram_join_of_unrelated_texts_with_common_passages_writes_few_pairs(spark, monkeypatch):
    """Texts put together from a few long passages: sizes and positions let most pairs through."""
    import random

    random.seed(5)
    passages = [" ".join(f"p{p}w{i}" for i in range(40)) for p in range(20)]
    texts = [" ".join(random.sample(passages, 3)) for _ in range(300)]
    texts += [f"{t} end" for t in texts[:20]]
    made = []
    kept = ngram_join.candidate_pairs

    def counted(*args):
        pairs = kept(*args)
        made.append(pairs.count())
        return pairs
    monkeypatch.setattr(ngram_join, "candidate_pairs", counted)
    monkeypatch.setattr(ngram_join, "PIVOTS", ())
    monkeypatch.setattr(ngram_join, "LEFT", 1000)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 5, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(df).collect()}
    assert got == brute_components(texts)
    assert 20 <= sum(made) <= 2 * len(texts)


def test_ngram_join_of_unrelated_texts_with_passages_few_share_writes_few_pairs(spark, monkeypatch):
    """Lists too short for bitmaps by their length alone: what they let through decides."""
    import random

    random.seed(6)
    passages = [" ".join(f"p{p}w{i}" for i in range(40)) for p in range(30)]
    texts = [" ".join(random.sample(passages, 3)) for _ in range(300)]
    texts += [f"{t} end" for t in texts[:20]]
    made = []
    kept = ngram_join.candidate_pairs

    def counted(*args):
        pairs = kept(*args)
        made.append(pairs.count())
        return pairs
    monkeypatch.setattr(ngram_join, "candidate_pairs", counted)
    monkeypatch.setattr(ngram_join, "PIVOTS", ())
    monkeypatch.setattr(ngram_join, "LEFT", 1000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(df).collect()}
    assert got == brute_components(texts)
    assert 20 <= sum(made) <= 2 * len(texts)


def test_ngram_join_compares_pairs_slice_by_slice(spark, monkeypatch):
    """However many pairs there are, a query takes those of one slice; hot lists and others alike."""
    monkeypatch.setattr(ngram_join, "AT_LEAST", 15)
    pairs, seen = spark.range(40).selectExpr("id as u", "id + 100 as v"), []

    def made(some):
        seen.append(some.count())
        return some.filter("u % 2 = 0")
    even, n = ngram_join.in_slices(pairs, ngram_join.pair_number(), 40, 4, made)
    assert sorted(r.u for r in even.collect()) == list(range(0, 40, 2)) and n == 20
    assert len(seen) == 3 and sum(seen) == 40 and max(seen) < 30

    sliced = []
    kept = ngram_join.in_slices

    def watched(rows, number, n, most, made):
        sliced.append((n, "e" in rows.columns))
        return kept(rows, number, n, most, made)
    monkeypatch.setattr(ngram_join, "in_slices", watched)
    monkeypatch.setattr(ngram_join, "AT_LEAST", 30)
    texts = one_word_apart(50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(df).collect()}
    assert got == brute_components(texts)
    assert {elements for n, elements in sliced if n > 30} == {False, True}


def brute_components(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return {i: top(i) for i in range(len(texts))}


def test_ngram_join_of_awkward_rows(docs, empty):
    rows = ngram_join.join_documents(docs).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert got[(1, 16, 1)] == got[(2, 16, 1)] == 1 and got[(3, 16, 1)] == 2
    assert got[(None, 17, 1)] == 1 and got[(4, 0, 4)] == got[(5, 0, 5)] == got[(7, 1, 7)] == 1
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert ngram_join.join_documents(empty).count() == 0


def test_ngram_join_of_an_id_with_several_texts(spark):
    """All rows of an id, and what shares a text with one of them, are one component."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b), (4, c), (9, c), (5, "alone"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_join.join_documents(df).collect()}
    assert got == {(3, 3), (7, 3), (9, 3), (4, 3), (5, 5), (8, 8)}
    assert {r.doc_id for r in ngram_join.keep_one_of_each(df).collect()} == {3, 5, 8}


@pytest.mark.parametrize("boundary", [0, 10])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, boundary):
    """Light and heavy sets alike, with the cost's choice replaced."""
    import random

    random.seed(boundary)
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda sizes, scan: boundary)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    texts = []
    for _ in range(30):
        words = [str(random.randrange(10_000)) for _ in range(random.choice([3, 6, 9, 13, 14, 30, 60]))]
        for _ in range(6):
            copy = list(words)
            copy[random.choice([0, -1, random.randrange(len(copy))])] = str(random.randrange(10_000))
            texts.append(" ".join(copy[:random.choice([len(copy), len(copy) - 1])]))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in range(len(label))):
            break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(df).collect()}
    assert got == dict(enumerate(label))


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def smallest_linked(rows):
    """The smallest id that links lead to, all pairs compared."""
    sets, label = {}, {}
    for doc_id, text in rows:
        w = WORD.findall(ascii_lower(text))
        sets[doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        label[doc_id] = doc_id

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            a, b = sets[x], sets[y]
            if a and b and 4 * len(a) <= 5 * len(b) and 4 * len(b) <= 5 * len(a) and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((top(x), top(y)))
                label[high] = low
    return {i: top(i) for i in ids}


def test_pipeline_stage_by_stage(spark, small):
    """Each stage against a plain version of its rule, over what its predecessor kept."""
    import duckdb

    from newsloom.llm.queries import MIX_SQL

    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, small, SF_DIR).cache()
    report = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, SF_DIR).collect()}
    texts = {r.doc_id: r.text for r in small.collect()}
    for doc_id, r in report.items():
        words = WORD.findall(texts[doc_id])
        assert r.n_symbols == sum(map(texts[doc_id].count, "#*$%&|<>"))
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert r.kept <= (not r.base_failed)
    assert Counter(map(str, kept.collect())) == Counter(str(r) for r in small.collect() if report[r.doc_id].kept)

    one = stages["exact dedup"](spark, kept, SF_DIR).cache()
    last = {}
    for r in kept.collect():
        last[ascii_lower(r.text)] = max(last.get(ascii_lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(last.values())

    apart = stages["n-gram Jaccard join"](spark, one, SF_DIR).cache()
    linked = smallest_linked([(r.doc_id, r.text) for r in one.collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, low in linked.items() if i == low)

    mixed = stages["mixing sources to target weights"](spark, apart, SF_DIR).cache()
    con = duckdb.connect()
    con.register("documents", apart.toPandas())
    taken = {row[0]: (row[1], row[4]) for row in con.execute(
        f"select doc_id, size, source_size, target, taken from ({MIX_SQL})").fetchall()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(times[i] * size == words for i, (size, words) in taken.items() if size)

    packed = stages["best-fit packing"](spark, mixed, SF_DIR).collect()
    lengths = Counter(r.doc_id for r in packed if r.start == 0)
    assert lengths == times
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(ends.values()) // 4096) + 1


def test_pipeline_of_awkward_rows(spark, docs, empty):
    table, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF_DIR).cache()
        seen.append(Counter(r.doc_id for r in table.collect()))
    quality, dedup, join, mix, pack = seen
    # Prose without repeats passes; the largest id of equal texts stays; the nameless row stays, too.
    assert set(quality) <= {1, 2, 3, None} and quality[3] == 2
    assert dedup[3] == 1 and 1 not in dedup and 2 not in dedup
    assert set(join) == set(dedup) and set(mix) <= set(join) and set(pack) == set(mix)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
    assert empty.count() == 0


def test_pipeline(spark, docs, small, empty):
    rows = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, SF_DIR).cache()
        assert rows.columns == small.columns, name
        assert rows.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0 or name.startswith("mixing")
    kept = {r.doc_id for r in rows.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == kept
    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF_DIR)
        assert table.count() >= 0


def test_pii_trains_on_every_candidate(spark):
    """One candidate of the rarer label among 30,000 is enough, whatever its hash."""
    drawn = F.pmod(F.xxhash64("id", F.lit(0).cast("bigint"), F.lit("secret")), F.lit(1 << 20))
    ids = spark.range(30_000).withColumn("drawn", drawn)
    rare = ids.filter("drawn % 2 = 0").agg(F.max_by("id", "drawn")).first()[0]
    label = (F.col("id") == rare).cast("double")
    features = F.array(label, *[F.lit(0.0)] * 17)
    proposed = ids.select("id", F.array(F.struct(
        F.lit("secret").alias("kind"), F.lit(0).cast("bigint").alias("start"), F.lit(20).cast("bigint").alias("end"),
        label.alias("label"), features.alias("features"))).alias("wide"))
    trees, thresholds = pii.train(proposed)
    assert trees and thresholds == {}
    low, high = pii.scores(trees, [[0.0] * 18, [1.0] + [0.0] * 17])
    assert low < 0.5 < high
