"""The operators against brute force, with nulls, empty and repeated texts, clashing columns and empty tables."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import line_dedup, packing, pieces, quality_classifier, quality_rules, records, spans, substring_dedup, suffix_dedup
from sessionloom.llm.ann import nearest
from sessionloom.llm.jaccard_join import jaccard_components
from sessionloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, text2 string, n_words long, spans int, label int, node long"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    docs = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if docs and rng.random() < 0.4:
            t = (rng.choice(docs)[1] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t[rng.randint(0, len(t)) : 0] = passage.split(" ")
        docs.append((i, " ".join(t).replace(" d ", "\n")))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, docs[0][1]), (n + 4, "ab " * 300), (n + 5, "x y")]


def twisted(first, tail=" the end"):
    """Texts of long words that no polynomial hash modulo 2**64 can tell apart: Thue-Morse strings and their mirror images."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    line = " ".join(f"w{i}" for i in range(30))
    texts = [f"{a} {line}{tail}", f"{b} {line}{tail}", f"{line} {a}", f"{line} {b}", a, b, f"{a}\n{b}\n{a}", f"{b}\n{a}\n{b}", " ".join([a[:64], b[:64]] * 20), " ".join([b[:64], a[:64]] * 20)]
    return list(enumerate(texts, first))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "z", 1, 2, 3, 4) for d, t in docs], SCHEMA)


def rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_jaccard(spark):
    docs = corpus() + twisted(100)
    assert rows(jaccard_components(frame(spark, docs)), ["doc_id", "n_shingles", "component_id"]) == brute.jaccard(docs)


def test_jaccard_with_lists_in_blocks(spark, monkeypatch):
    from sessionloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    docs = corpus(seed=9, n=80)
    assert rows(jaccard_components(frame(spark, docs)), ["doc_id", "n_shingles", "component_id"]) == brute.jaccard(docs)


def family(words, copies, edits, close):
    """Texts made from one by many edits, too far apart to link, and for each of close one more that links with that text."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        return text

    texts = [edited(base, edits) for _ in range(copies)]
    return [" ".join(t) for t in texts + [edited(texts[i], 20) for i in close]]


def test_jaccard_of_long_texts_that_do_not_link(spark, monkeypatch):
    """Unconnected texts are compared no further than their sketches: with those of one width for all sets, 1,118 pairs were."""
    from sessionloom.llm import jaccard_join

    docs = list(enumerate(family(1500, 40, 50, (3, 9, 9, 15, 20, 21, 22, 23, 24))))
    counts, linked = [], jaccard_join._linked

    def counted(pairs, *more):
        counts.append(pairs.count())
        return linked(pairs, *more)

    monkeypatch.setattr(jaccard_join, "_linked", counted)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    assert rows(jaccard_components(frame(spark, docs)), ["doc_id", "n_shingles", "component_id"]) == brute.jaccard(docs)
    assert len(counts) == 2 and counts[1] <= 50


@pytest.mark.parametrize("block", [2, 1000])
def test_jaccard_sketches_keep_pairs_that_link(spark, monkeypatch, block):
    """Sizes beside a power of two, lists that are united and one that stands alone, blocks of any size."""
    import pyarrow as pa

    from sessionloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = family(1100, 20, 40, (3, 9, 9, 15))
    texts += [" ".join(texts[i].split(" ")[:900]) for i in (3, 5, 7)]
    sets = jaccard_join.shingle_sets(pa.array(texts), 5)
    node = [jaccard_join.set_node(s) for s in sets]
    # lists of a centre with few members in common stay apart; the others are one cell
    members = {1: range(27), 2: range(27), 3: range(20), 4: [26, 0], 5: [26, 1], 6: [26, 2]}
    lists = spark.createDataFrame([(key, node[i], len(sets[i]), 9 if i == 26 and key > 3 else i % 5, node[i]) for key, m in members.items() for i in m], "key long, node long, size long, w long, label long")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = spark.createDataFrame(list(enumerate(node)), "doc_id long, node long")
    have = jaccard_join._sets_of(docs, named, lists.select("node"), 5, 4)
    assert {r["whole"] for r in jaccard_join._cells(lists).collect()} == {True, False}
    got = [tuple(sorted((r["a"], r["b"]))) for r in jaccard_join._unconnected(lists, have, 75, 100, 4).collect()]
    want = {tuple(sorted((node[i], node[j]))) for i in range(27) for j in range(i) if 100 * len(both := set(sets[i].tolist()) & set(sets[j].tolist())) >= 75 * (len(sets[i]) + len(sets[j]) - len(both))}
    assert len(want) >= 7 and want <= set(got)
    assert len(got) == len(set(got)) <= len(want) + 10


def test_suffix_dedup(spark):
    docs = corpus() + twisted(100)
    got = suffix_dedup.suffix_dedup(frame(spark, docs), window=60, gram=20)
    assert rows(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.bytes_dedup(docs, 60)
    got = suffix_dedup.suffix_dedup(frame(spark, docs), window=60, gram=20, often=2)
    assert rows(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.bytes_dedup(docs, 60)
    got = suffix_dedup.suffix_dedup(frame(spark, docs), window=400, gram=100)
    assert rows(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.bytes_dedup(docs, 400)


@pytest.mark.parametrize("often", [1000, 3])
def test_suffix_dedup_that_keeps_the_first_copy(spark, often):
    docs = corpus() + twisted(100)
    got = suffix_dedup.suffix_dedup(frame(spark, docs + docs[:3]), window=60, gram=20, keep_first=True, often=often)
    want = brute.bytes_dedup(docs, 60, keep_first=True)
    assert rows(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == sorted(want + [x for x in want if x[0] in (0, 1, 2)], key=str)


def test_windows_of_one_hash_are_told_apart_by_bytes():
    import numpy as np

    a, b = twisted(0)[4][1].encode()[:1024], twisted(0)[5][1].encode()[:1024]
    raw = a + b + a
    begin = np.array([0, 1024, 2048])
    assert suffix_dedup._verified(raw, begin, np.zeros(3, np.int64), 1024).tolist() == [0, 1024, 0]


@pytest.mark.parametrize("often", [1000, 2])
def test_substring_dedup(spark, often):
    docs = corpus() + twisted(100)
    got = substring_dedup.substring_dedup(frame(spark, docs + docs[:3]), window=20, often=often)
    want = brute.word_dedup(docs, 20)
    assert rows(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == sorted(want + [x for x in want if x[0] in (0, 1, 2)], key=str)


def test_windows_of_a_frequent_seed_are_spread():
    import numpy as np
    import pyarrow as pa

    from sessionloom.llm import textkit as tk

    gram = lambda s: int(tk.Words(pa.array([s])).grams(substring_dedup.GRAM)[0][0])
    seed = min((f"seed{i} b c d e" for i in range(5000)), key=gram)  # a small hash, which winnowing takes
    texts = [" ".join(f"l{i}x{j}" for j in range(19)) + f" {seed} " + " ".join(f"r{i}x{j}" for j in range(19)) for i in range(200)]
    slots, slot = np.zeros(1 << 21, np.uint32), int(tk.mix(np.array([gram(seed)], np.uint64))[0]) >> 38
    slots[slot >> 5] = 1 << (slot & 31)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(range(200)), pa.array(texts)], names=["nid", "th", "text"])
    sent = [(part, kind, len(blob)) for part, kind, blob in substring_dedup._sent(batch, slots, slots, 26, 20, 16)]
    size = [n for _, _, n in sent]
    assert {kind for _, kind, _ in sent} == {substring_dedup.WINDOWS} and len(sent) == 16
    assert sum(size) > 200 * 10 * substring_dedup.WINDOW.itemsize and max(size) < sum(size) / 8


def test_memory_of_suffix_order():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(4)
    body = [b"same leading bytes " * 2 + rng.integers(97, 100, rng.integers(0, 300), np.uint8).tobytes() for _ in range(4000)]
    data, end = np.frombuffer(b"".join(body), np.uint8), np.cumsum([len(b) for b in body])
    tracemalloc.start()
    order, _ = suffix_dedup.suffix_order(data, end - [len(b) for b in body], end, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [body[i] for i in order] == sorted(body) and peak < 4000 * 400


def test_quality_base(spark):
    docs = corpus()
    got = quality_rules.quality_rules(frame(spark, docs), frame(spark, docs[:20]).select("doc_id"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got, names) == brute.base_stats(docs)
    assert not got.filter("kept AND base_failed").count()


def test_line_dedup(spark):
    docs = [(1, "a\nb\nc\nd"), (2, "x\na\nb\n \nc\ny"), (3, "b\nc"), (None, None), (4, "")]
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert got == {1: ("a\nb\nc\nd", 0), 2: ("x\n \ny", 3), 3: ("b\nc", 0), None: (None, 0), 4: ("", 0)}


def test_line_dedup_by_words(spark):
    docs = [(1, "a a a\nb b\nc"), (2, "a a a\nx"), (3, "y\nb b\n\nc\nz"), (4, "b b\nq"), (5, "c\nr")]
    got = line_dedup.line_dedup(frame(spark, docs), min_lines=4, min_words=3).select("doc_id", "text", "n_removed_lines")
    assert sorted(map(tuple, got.collect())) == [(1, "a a a\nb b\nc", 0), (2, "x", 1), (3, "y\n\nz", 2), (4, "b b\nq", 0), (5, "c\nr", 0)]


def test_packing(spark):
    docs = corpus()
    got = packing.pack_documents(frame(spark, docs), tokenizer_path("word_bpe_49k.json"), capacity=64).toPandas()
    bins = got.sort_values("offset").groupby("sequence_id")
    assert bins["length"].sum().max() <= 64
    assert all((b["offset"] == b["length"].cumsum() - b["length"]).all() for _, b in bins)
    whole = {d: n for d, _, n, _ in brute.token_rows(docs, tokenizer_path("word_bpe_49k.json"), 1)}
    assert got.groupby("doc_id")["length"].sum().to_dict() == whole
    assert len(bins) <= 11 / 9 * -(-got["length"].sum() // 64) + 1  # 140 where 137 is the lower bound


def test_records(spark, tmp_path):
    docs = corpus() + twisted(100)
    path, tok = f"{tmp_path}/r", tokenizer_path("word_bpe_49k.json")
    records.write_records(frame(spark, docs), tok, path, end_id=2)
    index = records.build_index(spark, path)
    assert rows(index, ["doc_id", "start", "n_tokens", "ids_crc32"]) == sorted(brute.token_rows(docs, tok, 2), key=str)
    assert records.read_shuffled(spark, path, index.filter("doc_id < 9"), 1).count() == 9


def test_pieces(spark):
    import hashlib

    import sentencepiece

    docs, model = corpus() + twisted(100) + [(900, "▁a  b 中\U0001f600 "), (901, " lead")], tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((d, len(i := sp.encode(t or "")), sha(",".join(map(str, i))), sha(sp.decode(i))) for d, t in docs), key=str)
    assert rows(pieces.piece_digests(frame(spark, docs), model), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == want
    r = pieces.encode_pieces(frame(spark, [(1, "Hé the end")]), model).first()
    raw = "Hé the end".encode()
    assert b"".join(raw[s:e] for s, e in zip(r["starts"], r["ends"])) == raw


def test_nearest(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((400, 16))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (None, [1.0] * 16)]
    got = nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).toPandas()
    hit = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -1e9
        hit += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    assert len(got) == 100 and hit >= 90


def test_nearest_of_a_repeated_id(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((300, 16))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 150
    got = nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).toPandas()
    assert len(got) == 5 and 0 not in set(got.vec_id)
    assert len(set(np.argsort(-(x[1:] @ x[0]))[:5] + 1) & set(got.vec_id)) >= 4


def test_shards_of_a_repeated_id(spark):
    from sessionloom.llm import ann

    rows = ann.salted(spark.createDataFrame([(20, [1.0])] * 3000 + [(i, [1.0]) for i in range(3000)], "vec_id long, v array<double>"))
    sizes = [r["count"] for r in ann.sharded(rows, 6).groupBy("shard").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 1200


def test_nearest_in_a_large_shard():
    import numpy as np

    from sessionloom.llm.ann import Shard

    x = np.random.default_rng(3).standard_normal((70_000, 4))
    shard = Shard(np.arange(len(x)), x, float(np.linalg.norm(x, axis=1).max()), 7)
    hit, score = shard.search(1, x[1], 5)
    s = x @ x[1]
    s[1] = -1e9
    assert set(np.argsort(-s)[:5]) <= set(hit) and np.allclose(score, s[hit])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    """The query's table, k and queries against brute force."""
    import numpy as np

    from sessionloom.llm.queries import op3_approximate_nearest_neighbours

    got = op3_approximate_nearest_neighbours(spark, f"/root/testdata/{sf}").toPandas()
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    hit = 0
    queries = [i for i in ids if i % 20 == 0]
    for q in queries:
        s = np.einsum("ij,j->i", x, x[ids == q][0])
        s[ids == q] = -1e9
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        assert np.allclose(mine["score"], [s[ids == v][0] for v in mine["vec_id"]], rtol=0, atol=1e-12)
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(mine["vec_id"]))
    assert hit / (20 * len(queries)) >= 0.95


def test_nearest_with_ties_and_without_rows(spark):
    shape = "vec_id long, embedding array<float>, label int, score double"
    data = [(i, [1.0, 0.5 if i % 2 else 0.25], 1, 9.0) for i in range(40)]
    got = nearest(spark.createDataFrame(data, shape), F.col("vec_id") % 20 == 0, k=30)
    want = [(q, r, v) for q in (0, 20) for r, v in enumerate(([i for i in range(1, 40, 2)] + [i for i in range(0, 40, 2) if i != q])[:30], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == want
    assert nearest(spark.createDataFrame([], shape), F.col("vec_id") % 20 == 0).count() == 0


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    got = quality_classifier.score_quality(docs, labels, held).filter("held_out").join(labels, "doc_id")
    right, n = got.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert right / n > 0.93


def test_quality_verdict_on_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_rules.quality_rules(docs, labels.filter("quality = 1").select("doc_id")).filter("NOT base_failed").join(labels, "doc_id")
    kept = {r["quality"]: r["share"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.35


@pytest.mark.parametrize("f", [jaccard_components, suffix_dedup.suffix_dedup, substring_dedup.substring_dedup, line_dedup.line_dedup])
def test_empty_tables(spark, f):
    assert f(frame(spark, [])).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage, short, twice = line(51), " ".join("abcdefgh"[rng.randrange(8)] for _ in range(51)), line(30) + "\n" + line(30)
    docs = [(i, f"{line(80)} {x} {line(80)}") for i, x in enumerate([passage, passage, short, short, ""])]
    docs += [(i, f"{line(60)}\n{twice}\n{line(60)}") for i in (5, 6)]
    docs += [(7, docs[4][1] + " z"), (8, docs[4][1])]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    now = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], shape)
    want = dict(docs) | {6: docs[6][1].replace(twice + "\n", "")} | {8: ""}  # one line of over 50 words
    now = corpus_pipeline.line_dedup_stage(spark, now, "")
    assert {r.doc_id: r.text for r in now.collect()} == want
    groups = {i: c for i, _, c in brute.jaccard(list(want.items()))}
    want = {i: t for i, t in want.items() if groups[i] == i}
    now = corpus_pipeline.near_duplicates_stage(spark, now, "")
    assert {r.doc_id: r.text for r in now.collect()} == want and 7 not in want
    width, gone = corpus_pipeline.PASSAGE_BYTES, {}
    for i, _, removed, _, sha in brute.bytes_dedup(list(want.items()), width, keep_first=True):
        gone[i] = removed, sha
    got = corpus_pipeline.suffix_dedup_stage(spark, now, "").collect()
    assert {r.doc_id: (len(want[r.doc_id]) - len(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in got} == gone
    assert sum(passage in r.text for r in got) == 1


def test_alignment_through_a_character_map(spark, tmp_path):
    """ids and byte spans against the library, with the NFKC map, with and without the removal of extra blanks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rule, model = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    rule.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.precompiled_charsmap = rule.normalizer_spec.precompiled_charsmap
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab Cé①ｱﾞ ﬁ½㍻ ́e　 \t中Å😀一龍Ⅷ") for _ in range(rng.randint(0, 25))) for _ in range(300)]
    for strip in (False, True):
        model.normalizer_spec.remove_extra_whitespaces = strip
        path = tmp_path / f"{strip}.model"
        path.write_bytes(model.SerializeToString())
        sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
        want = [sp.encode(t, return_type="proto").pieces for t in texts]
        got = {r["doc_id"]: r for r in pieces.encode_pieces(frame(spark, list(enumerate(texts))), str(path)).collect()}
        for i, row in enumerate(want):
            assert [(p.id, p.begin, p.end) for p in row] == list(zip(got[i]["ids"], got[i]["starts"], got[i]["ends"])), texts[i]


@pytest.mark.parametrize("name", ["packing", "classifier", "pieces", "rules", "records"])
def test_other_empty_tables(spark, tmp_path, name):
    docs, bpe = frame(spark, []), tokenizer_path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    if name == "packing":
        out = packing.pack_documents(docs, bpe)
    elif name == "classifier":
        out = quality_classifier.score_quality(docs, labels, F.col("doc_id") == 2)
    elif name == "pieces":
        out = pieces.piece_digests(docs, tokenizer_path("piece_bpe_32k.model"))
    elif name == "rules":
        out = quality_rules.quality_rules(docs, labels.select("doc_id"))
    else:
        records.write_records(docs, bpe, f"{tmp_path}/r", end_id=2)
        out = records.build_index(spark, f"{tmp_path}/r")
        assert records.read_shuffled(spark, f"{tmp_path}/r", out, 1).count() == 0
    assert out.count() == 0


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    """Every operator gives a row for each row, null and repeated ids included."""
    docs = [(None, "a b c d e f g"), (None, None), (1, "x y z " * 30), (1, "x y z " * 30), (1, "other text here"), (2, "")]
    data, labels = frame(spark, docs), spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    ids = sorted((d for d, _ in docs), key=str)
    outs = [
        jaccard_components(data), line_dedup.line_dedup(data), suffix_dedup.suffix_dedup(data), substring_dedup.substring_dedup(data),
        packing.pack_documents(data, tokenizer_path("word_bpe_49k.json")), quality_rules.quality_rules(data, labels.select("doc_id")),
        quality_classifier.score_quality(data, labels, F.col("doc_id") == 7), pieces.piece_digests(data, tokenizer_path("piece_bpe_32k.model")),
    ]
    for out in outs:
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == ids


def test_packed_ids_and_places(spark):
    """start and ids_crc32 of every piece against the tokenizers library."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    docs, bpe = corpus() + twisted(100), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for d, t in docs:
        ids = np.array(bpe.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, i // 64, i, len(ids[i : i + 64]), zlib.crc32(ids[i : i + 64].tobytes())) for i in range(0, len(ids), 64)]
    got = packing.pack_documents(frame(spark, docs), tokenizer_path("word_bpe_49k.json"), capacity=64)
    assert rows(got, ["doc_id", "piece", "start", "length", "ids_crc32"]) == sorted(want, key=str)


def test_score_of_the_quality_rules(spark):
    """score and kept against a plain restatement of the two multinomials, with the slots that Spark's hash gives."""
    import math
    import re

    docs = [(i, t) for i, t in corpus(n=30) if t]
    data, trusted = frame(spark, docs), [d for d, _ in docs[:8]]
    tokens = {d: re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", t) for d, t in docs}
    every = sorted({x for t in tokens.values() for x in t})
    h = {r["x"]: r["h"] for r in spark.createDataFrame([(x,) for x in every], "x string").withColumn("h", F.xxhash64("x")).collect()}
    pairs = sorted({(a, b) for t in tokens.values() for a, b in zip([None, *t], t)}, key=str)
    shape = "a string, b string, p long, x long"
    slots = spark.createDataFrame([(a, b, None if a is None else h[a], h[b]) for a, b in pairs], shape)
    n = quality_rules.SLOTS
    two = {(r["a"], r["b"]): r["s"] for r in slots.withColumn("s", F.pmod(F.xxhash64("p", "x"), F.lit(n))).collect()}
    one = {r["b"]: r["s"] for r in slots.withColumn("s", F.pmod(F.xxhash64("x"), F.lit(n))).collect()}
    raw, target = [1] * n, [1] * n
    for d, t in tokens.items():
        for a, b in zip([None, *t], t):
            for s in (one[b], two[a, b]):
                raw[s] += 1
                target[s] += d in trusted
    shift = math.log(sum(raw)) - math.log(sum(target))
    w = [round(math.log(t) - math.log(r) + shift, 6) for r, t in zip(raw, target)]
    got = quality_rules.quality_rules(data, data.filter(F.col("doc_id").isin(trusted)).select("doc_id")).collect()
    for r in got:
        t = tokens[r["doc_id"]]
        want = sum(w[one[b]] + w[two[a, b]] for a, b in zip([None, *t], t)) / (2 * len(t)) if t else 0.0
        assert abs(r["score"] - want) < 2e-6
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)


def test_weights_of_the_classifier():
    """Newton's minimum against plain gradient steps on the same pairs; scores order a clear case."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(1, 1, (60, 3)), rng.normal(-1, 1, (60, 3))])
    y = np.repeat([1, 0], 60)
    model = quality_classifier.fit(x, y, pairs=500, seed=5)
    z = (x - model["mean"]) / model["scale"]
    z = np.hstack([z, np.clip(z, -3, 3) ** 2])
    draw = np.random.default_rng(5)
    d = z[draw.choice(np.flatnonzero(y == 1), 500)] - z[draw.choice(np.flatnonzero(y == 0), 500)]
    w = np.zeros(6)
    for _ in range(20_000):
        w -= 0.5 * (-(d.T @ (1 / (1 + np.exp(d @ w)))) / 500 + quality_classifier.PENALTY * w)
    assert np.allclose(w, model["w"], atol=1e-3)
    s = quality_classifier.apply(model, x)
    assert ((s >= quality_classifier.CUT) == (y == 1)).mean() > 0.9 and 0 <= s.min() and s.max() <= 1
    assert (quality_classifier.apply(quality_classifier.fit(x, np.ones(120)), x) == 0.5).all()


def test_very_long_texts(spark):
    """A text of 1 MB goes through each operator and gives what brute force gives."""
    long = " ".join(f"w{i * 7919 % 90_000}" for i in range(170_000))
    docs = [(1, long), (2, long[300_000:400_000]), (3, "q" * 200_000)]
    data = frame(spark, docs)
    assert rows(substring_dedup.substring_dedup(data), ["doc_id", "n_words", "n_removed", "kept_sha256"]) == brute.word_dedup(docs, 20)
    assert rows(jaccard_components(data), ["doc_id", "n_shingles", "component_id"]) == brute.jaccard(docs)
    got = suffix_dedup.suffix_dedup(data).toPandas().set_index("doc_id")
    assert got.loc[2, "n_removed"] == 100_000 and got.loc[3, "n_removed"] == 200_000
    assert line_dedup.line_dedup(data, min_words=51).count() == 3 and quality_rules.quality_rules(data, data.select("doc_id")).count() == 3
    got = packing.pack_documents(data, tokenizer_path("word_bpe_49k.json"))
    assert got.agg(F.max("length")).first()[0] == 4096


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, path = docs.count(), f"{tmp_path}/{name}"
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").agg(F.max("length")).first()[0] <= 4096


def test_runs_of_equal_targets():
    import numpy as np

    from sessionloom.llm import textkit as tk

    assert tk.occupied(np.array([], np.int64)) == [] and tk.occupied(np.array([-1, -1, 3, 7, 7])) == [(-1, 0, 2), (3, 2, 3), (7, 3, 5)]
    # as many parts as a very large input has: the work follows the slice
    target = np.sort(np.random.default_rng(1).integers(0, 1_600_000, 5000).astype(np.uint64))
    got = tk.occupied(target)
    assert sum(e - s for _, s, e in got) == 5000 and [t for t, _, _ in got] == np.unique(target).tolist()


def test_files_beyond_five_digits_keep_their_order(spark, tmp_path):
    docs = [(i, "w " * (i + 1)) for i in range(40)]
    path = f"{tmp_path}/records"
    records.write_records(frame(spark, docs), tokenizer_path("word_bpe_49k.json"), path, end_id=2)
    want = rows(records.build_index(spark, path), ["doc_id", "start", "n_tokens", "ids_crc32"])
    import os

    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    for n, f in reversed(list(enumerate(files))):
        os.rename(f"{path}/{f}", f"{path}/part-{99_999 - len(files) // 2 + n:05d}{f[10:]}")
    assert len(files) > 2 and rows(records.build_index(spark, path), ["doc_id", "start", "n_tokens", "ids_crc32"]) == want


@pytest.mark.parametrize("bad", [3, 70])
def test_classifier_learns_from_every_label(spark, monkeypatch, bad):
    """Mean, spread and cut are those of all rows, in many groups; with all pairs in one group the weights are the whole loss's."""
    import numpy as np

    rng = np.random.default_rng(4)
    n, names = 300, quality_classifier.NAMES
    x = rng.normal(0, 1, (n, names))
    y = (np.arange(n) >= bad).astype(int)
    x[:, 0] += y
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "doc_id long, x array<double>, y int")
    whole = quality_classifier.fit_rows(rows)
    z = quality_classifier._expand(x, x.mean(axis=0), x.std(axis=0) + 1e-9)
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, 2 * names)
    w = quality_classifier._newton(lambda w: [v / len(d) for v in quality_classifier._sums(d, w)], 2 * names)
    assert np.allclose(whole["w"], w, atol=1e-6) and abs(whole["cut"] - np.quantile(z @ w, bad / n)) < 1e-5
    monkeypatch.setattr(quality_classifier, "GROUP", 32)
    monkeypatch.setattr(quality_classifier, "RARE", 8)
    monkeypatch.setattr(quality_classifier, "SORTED", 5)
    monkeypatch.setattr(quality_classifier, "BINS", 4)
    got = quality_classifier.fit_rows(rows)
    assert np.allclose(got["mean"], x.mean(axis=0), atol=1e-9) and np.allclose(got["scale"], x.std(axis=0), atol=1e-8)
    assert abs(got["cut"] - np.quantile(z @ got["w"], bad / n)) < 1e-6


def test_every_trusted_document_counts(spark):
    """More than 20,000 trusted documents: the weights are those of the plain counts, two features of one slot a document."""
    import math

    n, slots = 20_400, quality_rules.SLOTS
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("alpha").alias("text"))
    assert set(quality_rules.slot_weights(docs, docs.select("doc_id"))) == {0.0}
    more = docs.unionByName(spark.range(n, n + 100).select(F.col("id").alias("doc_id"), F.lit("beta").alias("text")))
    shift = math.log(2 * (n + 100) + slots) - math.log(2 * n + slots)
    assert set(quality_rules.slot_weights(more, docs.select("doc_id"))) == {round(shift, 6), round(shift - math.log(201), 6)}


def test_written_rows_leave_no_shuffle_files(spark):
    import time

    from sessionloom.llm.common import written

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    made = written(spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(3, "count"), "tidy")
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and made.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_bitmaps_reach_the_driver_as_columns(spark, monkeypatch):
    """No row objects on the driver: a bitmap of 2**23 slots has up to 262,144 words."""
    import numpy as np

    from sessionloom.llm.common import slot_bitmap

    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    slot = np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64) >> np.uint64(64 - 12)
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(type(keys), name, lambda self: pytest.fail("rows on the driver"))
    got = np.unpackbits(np.frombuffer(slot_bitmap(keys, "k", 12), np.uint8), bitorder="little")
    assert np.flatnonzero(got).tolist() == np.unique(slot).tolist()
    assert not any(slot_bitmap(keys.limit(0), "k", 12))
    anchors = lambda column: np.repeat(np.arange(5, dtype=np.uint64), [1, 2, 3, 1, 9])
    few, many = spans.repeated_anchors(frame(spark, [(1, "a")]), anchors, 12, 3)
    assert [spans.may_repeat(np.frombuffer(b, np.uint32), np.arange(5, dtype=np.uint64), 12).tolist() for b in (few, many)] == [[False, True, True, False, True], [False, False, True, False, True]]


def test_plan_of_line_dedup_does_not_hold_all_rounds(spark):
    data = frame(spark, [(1, "a b\nc d\ne f\ng h\ni j"), (2, "a b\nc d\ne f\ng h\ni j")])
    joins = [line_dedup.line_dedup(data, lines, 51)._jdf.queryExecution().optimizedPlan().toString().count("Join ") for lines in (3, 5)]
    assert joins[0] == joins[1] > 0
