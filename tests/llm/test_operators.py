"""Operators against plain versions, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamworks.llm import covertree, minhash, mixing, packing, pii, quality, suffix, topk, toxicity, warc
from loamworks.llm.common import Scratch, components, one_text

from . import brute

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts():
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    long_ = prose(4000, 2)
    rows = [base, " ".join(near), base.upper(), base, long_, long_ + " tail", None, "", "   \t\n", "one two", "ONE two", "one two three four five", "é" * 500, "ab " * 400, base + " " + prose(150, 3), prose(80, 4) + "\n" + " ".join(base.split()[10:100]) + "\n" + prose(60, 6)]
    rows += [prose(30 + i, 100 + i) for i in range(20)]
    return [(i, t) for i, t in enumerate(rows)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 5 else None, None) for i, t in rows], DOC)
    clash = ("key", "n", "size", "rep", "cluster", "h1", "score", "label", "position", "words", "a", "b", "v")
    return df.select("*", *[F.lit("x").alias(c) for c in clash]) if extra else df


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.v: r.root for r in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


@pytest.mark.parametrize("how", [{}, {"node_rows": 3, "cluster_rows": 1}])
def test_minhash(spark, how):
    rows = texts()
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows), Scratch(spark), 80, **how).collect()))
    assert got == brute.near_documents(rows, 80)
    left = minhash.deduplicate(frame(spark, rows, False), Scratch(spark))
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _, c, k in got if k]


def test_minhash_empty_and_null_ids(spark):
    assert minhash.near_duplicates(frame(spark, texts()).limit(0), Scratch(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "z")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, Scratch(spark)).collect()}
    assert got == {(None, 3, None), (3, 3, True), (None, None, None)}


@pytest.mark.parametrize("how", [{"batches": 1}, {"batches": 4, "hot": 1}])
def test_suffix(spark, how):
    rows = texts()
    got = suffix.remove_repeats(frame(spark, rows), Scratch(spark), length=90, **how).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute.repeats(rows, 90)


def test_suffix_rows_and_spans(spark):
    rows = [(1, "x" * 50 + prose(60, 9)), (1, "x" * 50 + prose(60, 9)), (None, prose(60, 9)), (2, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.remove_repeats(df, Scratch(spark), length=90, texts=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute.repeats(rows, 90)
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed
    assert suffix.remove_repeats(df.limit(0), Scratch(spark)).count() == 0


def test_suffix_keeps_passages_below_400_bytes(spark):
    below, at = prose(99, 20)[:399], prose(99, 21)[:400]
    assert len(below.split()) > 50
    rows = [(i, prose(60, 30 + i) + edge + p + edge + prose(60, 40 + i)) for i, (edge, p) in enumerate([("<", below), (">", below), ("<", at), (">", at)])]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).drop("spans").collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 0, 2: 400, 3: 400}
    assert sorted(map(tuple, got), key=str) == brute.repeats(rows, 400)


def test_suffixes_are_in_order(spark):
    rows = [(i, prose(200, i)) for i in range(12)] + [(50, prose(200, 3)), (51, "é" * 300)]
    keyed = suffix.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r.key: r.text.encode() for r in keyed.collect()}
    entries = keyed.select("key", "text").mapInArrow(suffix._entries(90, 30, 1), f"{suffix.ENTRY}, batch int").drop("batch")
    index = suffix.SuffixIndex(Scratch(spark))
    level = index._ordered(entries).collect()
    heads = [bytes(r.head) for r in level]
    assert len(level) > 100 and heads == sorted(heads)
    assert all(h == texts[r.key][r.a : r.a + 30] for h, r in zip(heads, level, strict=True))
    index.add(entries)
    got = {(r.key, r.a): r.state for r in index.matches().collect()}
    shared = {h for h in heads if heads.count(h) > 1}
    assert {(r.key, r.a) for h, r in zip(heads, level, strict=True) if h in shared} == set(got)


def vectors():
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 16))
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, i % 3, (base[i] + r.normal(size=16) * 0.02).tolist()) for i in range(20)]
    rows += [(200 + i, 1, base[1].tolist()) for i in range(30)] + [(300 + i, 1, (3 * base[1]).tolist()) for i in range(3)]
    rows += [(400, None, base[1].tolist()), (401, 1, None), (402, 1, []), (403, 1, [0.0] * 16), (404, 1, [None] * 16), (405, 1, [float("nan")] * 16), (406, 1, [float("inf")] * 16), (407, 1, [1.0, 2.0]), (408, 1, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("chunk", [2048, 8])
def test_cover_tree(spark, chunk):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"x": F.lit(1), "rep": F.lit(2), "n": F.lit(3)})
    got = sorted(map(tuple, covertree.near_vectors(df, Scratch(spark), chunk=chunk).collect()))
    assert got == brute.near_vectors(rows, 0.98)
    assert covertree.near_vectors(df.limit(0), Scratch(spark)).count() == 0


def test_cover_tree_levels():
    x = np.random.default_rng(2).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.CoverTree(x, 0.05)
    for up, down in zip(tree.levels[:-1], tree.levels[1:], strict=True):
        assert sorted(np.concatenate(down.members).tolist()) == list(range(300))
        assert set(up.centre.tolist()) <= set(down.centre.tolist())
    pairs = {(min(i, j), max(i, j)) for p, q, s in covertree.close_nodes(tree, tree, 0.3) for i in p.tolist() for j in q.tolist() if i != j}
    d = covertree.distances(x, x)
    assert {(i, j) for i, j in zip(*np.nonzero(d <= 0.3), strict=True) if i < j} <= pairs


@pytest.mark.parametrize("how", [{}, {"shard_rows": 7}])
def test_top_k(spark, how):
    rows = [(i, v) for i, _, v in vectors()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "score": F.lit(2), "rank": F.lit(0)})
    rows = [(i, v if v is None else v + [0.0] * (16 - len(v)) if v else v) for i, v in rows]
    assert sorted(map(tuple, topk.top_k(df, Scratch(spark), every=10, **how).collect())) == brute.top_k(rows, 5, 10)
    assert topk.top_k(df.limit(0), Scratch(spark)).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 1)"), Scratch(spark)).count() == 1


FAKE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"


def pages():
    rows = [(1, "http://a/WARC/1.1", "a\r\nWARC/1.1\r\nb"), (2, None, None), (3, "u\r\nv", ""), (4, "x", FAKE), (5, "x", FAKE), (6, "x", "\r\n\r\nWARC/1.1\r\n\r\n" * 300), (7, "y", "é" * 10), (8, "y", "z" * 200_000), (None, "n", "é" * 10), (None, "n", "only")]
    return rows + [(100 + i, "z", FAKE * (i % 5) + str(i // 2)) for i in range(200)]


@pytest.mark.parametrize("block", [1 << 12, 4 << 20])
def test_warc(spark, block):
    scratch = Scratch(spark)
    path = scratch.path("archives")
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumns({"digest": F.lit(1), "n": F.lit(2)})
    warc.write(df.repartition(2), path, per_file=40)
    got = warc.read(spark, path, scratch, block).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute.records(pages())


def test_warc_smallest_and_empty(spark):
    scratch = Scratch(spark)
    path = scratch.path("archives")
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write(df, path, least_bytes=5)
    assert {r.page_id: r.record_type for r in warc.read(spark, path, scratch).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    empty = scratch.path("archives")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty, scratch).count() == 0


def test_personal_data_patterns():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("ab1239@@..-+ ()_%é") for _ in range(r.randint(0, 40)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == brute.personal(t), t
    assert pii.base_spans("1" * 50_000 + "." + "a" * 50_000 + "@") == []


def test_personal_data(spark):
    card = "4111 1111 1111 1111"
    rows = [(1, f"pay {card} or a.b@c.de now"), (2, None), (3, ""), (4, "clean text of 12 words"), (5, "4111111111111111 4111111111111111 call +1 (555) 123-4567"), (5, "4111111111111111 4111111111111111"), (None, "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    model = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = pii.detect(df, model).collect()
    assert len(got) == len(rows)
    for r, (doc, t) in zip(got, rows, strict=True):
        want = brute.personal(t or "")
        assert r.doc_id == doc and r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(","))
    assert got[3].spans == ""
    out = [r.text for r in pii.redact(df, model).collect()]
    assert out[0] == "pay <CARD> or <EMAIL> now" and out[1] is None and out[3] == rows[3][1]
    assert pii.detect(df.limit(0), model).count() == 0


def test_messages_make_labels_agree():
    model = pii.Model()
    model.u[:] = 0
    model.skip[:] = 4 * np.eye(pii.K)
    x = np.zeros((3, pii.FEATURES), np.float32)
    p = model.infer(x, np.array([2, 0, 0]), pii._pairs([]), pii._pairs([(0, 1)]))
    assert p[1].argmax() == 2 and p[2].argmax() == 0


def test_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = "Don't STOP... (a_b), x y\x1cz <|endoftext|> <|STARTOFTEXT|> İstanbul Σίσυφος é 12,5. ). "
    rows = [*texts(), (50, odd), (51, odd * 300), (51, odd), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "offset": F.lit(2)}).repartition(2)
    got = packing.pack(df, least=4).collect()
    want = sorted((d, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())) for d, t in rows if d not in (51, None) for ids in [tok.encode(t or "", add_special_tokens=False).ids + [1]])
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, n, crc in want:
        assert sum(r.length for r in by[d]) == n and all(r.doc_tokens == n for r in by[d])
        if len(by[d]) == 1:
            assert by[d][0].ids_crc32 == crc
    seqs = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == seqs.get(r.sequence_id, 0)
        seqs[r.sequence_id] = r.offset + r.length
    assert max(seqs.values()) <= 2048 and {50, 51, None} <= set(by)
    assert packing.pack(df.limit(0)).count() == 0


def test_minimum_bin_slack():
    r = random.Random(7)
    for _ in range(50):
        pool, lengths = packing.Pool(40), [r.randint(1, 40) for _ in range(12)]
        for n, x in enumerate(lengths):
            pool.add(x, (n,))
        got = [x for x, _ in pool.fill()]
        rest = sorted(lengths)
        rest.remove(max(lengths))
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        room = 40 - max(lengths)
        assert sum(got) == max(lengths) + max(s for s in sums if s <= room) and pool.size == 12 - len(got)


def test_mixing(spark):
    rows = [r for r in texts() for _ in range(1)] + [(200 + i, prose(20 + i, i)) for i in range(60)]
    df = frame(spark, rows)
    got = mixing.mix(df, Scratch(spark), per_bucket=8).collect()
    again = mixing.mix(df.repartition(7), Scratch(spark), per_bucket=8).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    sizes, taken = {}, {}
    for r in got:
        assert r.size == len(brute.WORD.findall(dict(rows)[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute.targets(sizes, mixing.WEIGHTS, 1.5, 2.0)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    run = mixing.curriculum(frame(spark, rows, False), Scratch(spark)).collect()
    assert [r.position for r in run] == sorted(r.position for r in run)
    assert all(len(brute.WORD.findall(r.text)) == r.words for r in run)
    assert sum(r.words for r in run) == sum(taken.values())
    assert mixing.mix(df.limit(0), Scratch(spark)).count() == 0


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = toxicity.toxicity(docs, labels.withColumn("_label", F.lit(9)))
    held = got.where("held_out").join(labels, "doc_id")
    right, n, toxic, hit = held.agg(F.count_if(F.col("predicted") == F.col("toxic")), F.count("*"), F.expr("count_if(toxic = 1)"), F.expr("count_if(toxic = 1 AND predicted = 1)")).first()
    assert right / n > 0.95 and hit / toxic > 0.85
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot"), (3, "w " * 100_000)], "doc_id long, text string")
    w = toxicity.model(docs, labels)
    assert toxicity.score(odd, w).count() == 4
    assert toxicity.reject(odd, w).count() >= 3
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).where("score between 0.4 and 0.6").count() == 4


def test_counterfactual_term(spark):
    rows = [(i, f"{'those women are filler' if i % 2 else 'plain'} {prose(8, i)}" + (" scum" if i % 4 == 1 else ""), 1 if i % 4 == 1 else 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "the women met"), (2, "the men met")], "doc_id long, text string")
    gap = {}
    for fairness in (0.0, 20.0):
        s = {r.doc_id: r.score for r in toxicity.score(probe, toxicity.train(docs, labels, fairness=fairness)).collect()}
        gap[fairness] = abs(s[1] - s[2])
    assert gap[20.0] < gap[0.0] / 2


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = quality.quality(docs.withColumn("score", F.lit(0))).join(labels, "doc_id")
    clean, kept, junk, gone = got.agg(*[F.expr(f"count_if({c})") for c in ("quality = 1", "quality = 1 AND kept", "quality = 0", "quality = 0 AND NOT kept")]).first()
    assert kept / clean > 0.98 and gone / junk > 0.8
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "w " * 100_000)], "doc_id long, text string")
    assert quality.quality(odd).count() == 4 and quality.quality(odd.limit(0)).count() == 0


def test_one_text_of_a_repeated_document(spark):
    docs = spark.range(0, 3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("you scum").alias("text"), F.lit(1).alias("_id"))
    docs = docs.unionByName(spark.createDataFrame([(8, "b", 1), (8, "a", 1), (9, None, 1), (None, "c", 1)], "doc_id long, text string, _id int"))
    pick = spark.createDataFrame([(7, 1), (8, 0), (9, 0), (10, 1)], "_id long, _label int")
    assert sorted(map(tuple, one_text(docs, pick).collect())) == [(7, 1, "you scum"), (8, 0, "a"), (9, 0, None)]


def test_em_finds_accuracies():
    r = np.random.default_rng(4)
    truth, accuracy = r.random(4000) < 0.7, (0.9, 0.8, 0.7, 0.6)
    votes = [np.where(r.random(4000) < a, truth, ~truth).astype(int) for a in accuracy]
    patterns = {}
    for v in zip(*votes, strict=True):
        k = "".join(map(str, v))
        patterns[k] = patterns.get(k, 0) + 1
    _, chance = quality.em(patterns)
    assert np.argsort(-chance[:, 1, quality.GOOD]).tolist()[:2] == [0, 1]


def test_packing_of_cut_documents(spark):
    """Pieces of documents longer than a sequence: starts, and ids by brute force."""
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, prose(900 + 700 * i, 50 + i)) for i in range(6)] + [(9, "é, X. " * 3000)]
    want = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in rows}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=512, least=4).collect()
    by = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.asarray(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        by.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, pieces in by.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(want[d]) > 512


def test_packing_in_the_order_of_files(spark, tmp_path):
    rows = [(i, prose(20 + i % 30, i)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/d")
    got = packing.pack(spark.read.parquet(f"{tmp_path}/d"), in_order=True, least=4).collect()
    first = {}
    for r in got:
        first.setdefault(r.sequence_id >> 40, []).append(r.doc_id)
    spans = [(min(v), max(v)) for _, v in sorted(first.items())]
    assert len(spans) == 6 and all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), in_order=True).count() == 400
