import base64
import io
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from stemspark import storage
from stemspark.llm import bpe, common, fixity, hamming_index, licences, mixing, passages, quality, sstable, weighted_minhash, zclassifier
from stemspark.operators import graph

random.seed(3)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long"


def text(n):
    return " ".join(random.choice("abcdefghij") * 2 + str(random.randint(0, 500)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    passage, base = text(60), text(90)
    near = base.split()
    near[40] = "changed"
    rows = [(1, f"{text(80)} {passage} {text(40)}"), (2, f"{text(30)} {passage} {text(10)}"), (3, text(100)), (4, None), (5, ""), (None, passage), (6, text(30)), (6, text(200)), (10, base), (11, " ".join(near)), (12, base), (13, "Released under the MIT License. " + text(30)), (14, text(25) + " licensed under CC BY 4.0")]
    return spark.createDataFrame([(a, b, "en", "s1", 0 if b is None else len(b), 1) for a, b in rows], SCHEMA)


def test_tokens_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sstable.token_table(spark, docs.where("doc_id <> 6"), P.path("word_bpe_49k.json")).collect()
    start = 0
    rows = {r["doc_id"]: r for r in got}
    for r in docs.where("doc_id <> 6").orderBy("doc_id").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[r["doc_id"]]["start"], rows[r["doc_id"]]["n_tokens"], rows[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sstable.token_table(spark, docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_ids_are_the_librarys():
    """Added tokens in texts, letters that compose only before they are folded, and random strings, against the plain call."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), random.Random(11)
    odd = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "Y\u030a", "W\u030a", "H\u0331", "T\u0308", "J\u030c", "\u0130", "\x1c", "\x85", "\u3000", "Don't", "I'LL", "<|", "|>."]
    texts = ["", *odd, "x" * 300_000 + " end."]
    for _ in range(3000):
        texts.append("".join(own.choice([own.choice(odd), chr(own.choice([own.randint(1, 126), own.randint(0xA0, 0x36F), own.randint(0x370, 0x2FFF)])), " "]) for _ in range(own.randint(1, 12))))
    got, width = sstable.encode_texts([x.encode() for x in texts], path, 2)
    for x, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, f"<u{width}").tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]
    assert max(map(len, sstable._tokenizer(path)[2])) <= sstable.PIECE_BYTES


def test_final_marks_are_encoded_apart():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), np.random.default_rng(7)
    parts = ["word", "Ünd", "né", "12", "'s", "'", ".", ",", "***", "&&&", "$", "<|", "|>", "<|endoftext|>", "=", ">", "\u0338", "e\u0301", "\u00a0", "…", "_", "-", " ", "  ", "\n", "\t", "\x1c", "\u2028", "語", "ſ", "İ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(4000)] + ["", " ", "word.*** word!! word,", "x" * 400 + "."]
    got, _ = sstable.encode_texts([*(x.encode() for x in texts), None], path, 2)
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [[*library.encode(x, add_special_tokens=False).ids, 2] for x in [*texts, ""]]
    known = sstable._tokenizer(path)[2]
    assert {b"word", b".***", b"!!", b","} <= known.keys() and b"x" * 400 not in known
    assert sstable._stem(b"word.***") == (b"word", b".***") and sstable._stem(b"a<|endoftext|>") == (b"a<|endoftext|>", b"")


def test_shard_keys_null_and_repeated(spark):
    rows = [(None, "a"), (5, "b c"), (5, "b c"), (5, "d"), (-3, None)]
    got = sstable.token_table(spark, spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(False, 0, 2), (True, -3, 1), (True, 5, 2), (True, 5, 3), (True, 5, 3)]
    assert sorted(r["start"] for r in got)[0] == 0 and max(r["start"] + r["n_tokens"] for r in got) == sum(r["n_tokens"] for r in got)


def test_shard_lookup():
    out = io.BytesIO()
    writer = sstable.Writer(out, 2, block_bytes=256)
    ids = [None, *range(-50, 50), 49, *range(1000, 3000, 3)]
    for i, k in enumerate(ids):
        writer.add(sstable.key_of(k), i.to_bytes(4, "little"))
    writer.close()
    shard = sstable.Reader(out, out.tell())
    assert [sstable.identifier_of(k) for k, _ in shard.scan()] == ids
    for k in {*ids}:
        assert [int.from_bytes(v, "little") for v in shard.get(sstable.key_of(k))] == [i for i, x in enumerate(ids) if x == k]
    assert shard.get(sstable.key_of(1001)) == [] and shard.get(sstable.key_of(9999)) == []


def test_bpe_equals_the_library():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library, own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(path, P.PATTERN)
    assert sorted(own.hash(t) for t in own.tokens) == list(range(len(own.tokens)))
    for s in ["", " ", "  a", "a  ", "\n\n x \t y", "it's  I'LL", "　x", "naïve ÉÉ \x1c z \x85 q\xa0w", "😀 abc123 ١٢٣", "x" * 500, text(300)]:
        ids, decimal = own.encode(s)
        assert ids.tolist() == library.encode_ordinary(s) and own.decode(ids).decode() == s and decimal == ",".join(map(str, ids))


def test_passages_are_found_and_cut(docs):
    rows = passages.spans(docs).collect()
    assert {(r["doc_id"], r["removed"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(1, False), (2, True)}
    after = {r["doc_id"]: r["text"] for r in passages.cut(docs.where("doc_id in (1, 2, 3)")).collect()}
    # A run of 51 words or more is cut as far as its paragraphs reach: less than a paragraph may stay at either end.
    assert len(after[2].split()) < 40 + passages.WORDS and len(after[1].split()) == 180 and len(after[3].split()) == 100
    assert passages.spans(docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    rows = {r["doc_id"]: r for r in weighted_minhash.classes(docs.where("doc_id <> 6")).collect()}
    assert rows[10]["class_id"] == rows[11]["class_id"] == rows[12]["class_id"] == 10 and rows[12]["exact_id"] == 10
    assert [d for d in (1, 2, 3, 10, 13) if not rows[d]["kept"]] == [] and not rows[11]["kept"] and rows[5]["class_id"] == 4
    kept = [r["doc_id"] for r in weighted_minhash.keep_one(docs).collect()]
    assert kept.count(6) == 1 and 11 not in kept and None in kept


def test_near_duplicates_unlike_their_hub(spark):
    """A template's variants resemble each other at about 0.7; some come in pairs that are near copies."""
    own = random.Random(7)
    word = lambda: f"w{own.randint(0, 10**6)}"
    template, rows = [word() for _ in range(200)], []
    for i in range(400):
        tail = [word() for _ in range(40)]
        rows.append((i, " ".join(template + tail)))
        if i % 5 == 0:
            tail[5] = tail[12] = word()
            rows.append((1000 + i, " ".join(template + tail)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    later = weighted_minhash.followers(docs)
    idf = weighted_minhash.inverse(weighted_minhash.document_frequencies(docs.join(later, "doc_id", "left_anti")), len(rows) - later.count())
    sets = [weighted_minhash.weighted_set(t, idf) for _, t in rows]
    up = {d: d for d, _ in rows}
    for i in range(len(rows)):
        for j in range(i):
            if weighted_minhash.similarity(sets[i], sets[j]) >= 0.8:
                one, other = up[rows[i][0]], up[rows[j][0]]
                up = {d: min(one, other) if c in (one, other) else c for d, c in up.items()}
    assert {r["doc_id"]: r["class_id"] for r in weighted_minhash.classes(docs).collect()} == up and len(set(up.values())) == 400


def test_frequent_shingles_weigh_less(spark):
    """A line that unlike texts share weighs less than what each has for itself; a group of near copies counts once."""
    line, base = text(12), text(80).split()
    rows = [(i, f"{text(60)} {line}") for i in range(40)]
    for i in range(100, 160):
        copy = list(base)
        copy[random.randrange(80)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    later = {r["doc_id"] for r in weighted_minhash.followers(docs).collect()}
    assert not later & set(range(40)) and len(later) >= 58
    counted = docs.where(~docs["doc_id"].isin(*later))
    idf = weighted_minhash.inverse(weighted_minhash.document_frequencies(counted), counted.count())
    weight = lambda t: weighted_minhash.weighted_set(t, idf)[1]
    assert weight(line).max() < 1 < 3 < weight(rows[0][1]).max() and weight(" ".join(base)).min() > 2.5
    classes = {r["doc_id"]: r["class_id"] for r in weighted_minhash.classes(docs).collect()}
    assert {classes[i] for i in range(100, 160)} == {100} and all(classes[i] == i for i in range(40))
    assert weighted_minhash.classes(docs.limit(0)).count() == 0


def test_few_links_take_one_task(spark, docs, monkeypatch):
    """The same classes as level by level, without the levels' tables, whose many stages fill the driver."""
    names = []
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or storage.stored(df, name))

    def found():
        near = sorted(map(tuple, weighted_minhash.classes(docs).where("doc_id is not null").collect()))
        return near, sorted(map(tuple, passages.repeated(docs).collect()))

    one = found()
    assert "cc-labels" in names and "cc-hooks" not in names
    monkeypatch.setattr(common, "ONE_TASK_LINKS", 0)
    assert found() == one and len(one[1]) and "cc-hooks" in names


def test_passages_with_a_changed_word_and_short_texts(spark):
    words = text(200).split()
    near = list(words)
    near[90] = "changed"
    brief = text(20)
    rows = [(1, f"{text(70)} {' '.join(words)}"), (2, f"{text(40)} {' '.join(near)} {text(9)}"), (3, brief), (4, brief), (5, text(45)), (6, None)]
    docs = spark.createDataFrame([(a, b, "keep", 1) for a, b in rows], "doc_id long, text string, _id string, _h int")
    found = passages.spans(docs).collect()
    assert {(r["doc_id"], r["removed"]) for r in found} == {(1, False), (2, True), (3, False), (4, True)}
    after = {r["doc_id"]: r for r in passages.cut(docs).collect()}
    assert len(after[2]["text"].split()) < 130 and len(after[1]["text"].split()) == 270 and 4 not in after and 6 in after
    assert {(r["_id"], r["_h"]) for r in after.values()} == {("keep", 1)}


def test_what_overlaps_a_paragraph_that_stays_is_no_copy(spark):
    rng = np.random.default_rng(11)
    made = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 100_000, n))
    while True:
        passage = made(80)
        h, first = passages.joined_hashes([passage])
        at = passages.paragraphs(h, first, passages.shingle_hashes(h))
        if (np.diff(at) == 1).any():
            break
    docs = spark.createDataFrame([(1, f"{made(30)} {passage} {made(30)}"), (2, f"{made(30)} {passage} {made(30)}")], "doc_id long, text string")
    found = passages.repeated(docs).collect()
    assert len({(r["doc_id"], r["class_id"]) for r in found}) < len(found)  # neighbours in one class
    assert {(r["doc_id"], r["removed"]) for r in found} == {(1, False), (2, True)}
    after = {r["doc_id"]: len(r["text"].split()) for r in passages.cut(docs).collect()}
    assert after[1] == 140 and after[2] < 90


def test_a_doc_id_repeats_by_its_texts_and_hashes_have_no_dictionary(spark):
    import pyarrow.parquet as pq

    rows = [(1, None), (1, "a"), (2, "b"), (None, "c"), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for extra, again in (([], False), ([(2, "a")], True)):
        texts, repeats = passages._texts(docs.union(spark.createDataFrame(extra, docs.schema)))
        assert repeats is again and sorted(map(tuple, texts.collect())) == [(1, "a"), (2, "a" if again else "b")]
    from pathlib import Path

    kept = passages._stored(docs, "test")
    files = Path(kept._stored_at.removeprefix("file:")).glob("*.parquet")
    metas = [pq.ParquetFile(f).metadata for f in files]
    assert not any(m.row_group(i).column(0).has_dictionary_page for m in metas for i in range(m.num_row_groups))


def test_paragraphs_unlike_their_hub(spark):
    """Texts of one paragraph that share 23 words; pairs among them share 25. Every pair of a bucket counts, whatever its hub."""
    heads = [text(5) for _ in range(20_000)]
    words, first = passages.joined_hashes(heads)
    head = heads[int(passages.shingle_hashes(words)[first].argmin())]  # so that the paragraph starts there in all texts
    head = f"{head} {text(18)}"
    texts = [f"{head} {middle} {text(1)}" for middle in (text(2) for _ in range(200)) for _ in range(2)]
    found = {r["doc_id"]: r["class_id"] for r in passages.repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    grams = np.array([passages.shingle_hashes(passages.joined_hashes([t])[0]) for t in texts])
    keys = passages._keys(grams, passages.tuned_bands(), passages.FINE_ROWS, 100)
    coarse = np.stack([passages._minhash(grams, i) for i in range(passages.COARSE)], axis=1)
    met = [((coarse == c).sum(axis=0) > 1).any() for c in coarse]  # those that collide coarsely with another text at all
    linked = set()
    for a in range(len(texts)):
        for b in range(a):
            x, y = set(grams[a].tolist()), set(grams[b].tolist())
            if len(x & y) >= passages.SIMILAR * len(x | y):
                linked |= {a, b}
                assert not (met[a] and met[b] and (keys[a] == keys[b]).any()) or found[a] == found[b]
    assert set(found) <= linked and len(found) > 380 and len(set(found.values())) > 180
    # Long buckets are split into blocks, and their cells meet all pairs.
    a, b = np.arange(0, 400, 2), np.arange(1, 400, 2)
    every = list(passages._near(np.zeros(400, int), lambda p, q: p != q, grams, passages.SIMILAR))
    assert {(int(p), int(q)) for ps, qs in every for p, q in zip(ps, qs, strict=True)} >= set(zip(a.tolist(), b.tolist(), strict=True))


def test_paragraphs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 20)
    test_paragraphs_unlike_their_hub(spark)


def test_quality_statistics(docs):
    rows = {r["doc_id"]: r for r in quality.statistics(docs.where("doc_id <> 6")).collect()}
    assert rows[3]["n_words"] == 100 and rows[4]["n_words"] == 0 and rows[3]["n_repeat_words"] == 0
    again = docs.sparkSession.createDataFrame([(1, "a b c d e f g h i " * 2 + "#\nx\nx", "en", "s", 0, 0)], SCHEMA)
    r = quality.statistics(again).first()
    assert (r["n_words"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (21, 1, 1, 18)
    assert quality.rules(docs.limit(0)).count() == 0 and not {r["kept"] for r in quality.rules(docs.where("doc_id in (4, 5)")).collect()} - {False}


def test_outliers_like_brute_force(spark):
    rng = random.Random(17)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 4) + rng.choice("klmnop") * rng.randint(1, 4)
    line = lambda n: " ".join(word() for _ in range(n))
    texts = ["\n".join(line(8) for _ in range(rng.randint(4, 60))) for _ in range(280)]
    texts += ["\n".join(line(8) + " # # # $ $ %" for _ in range(30)) for _ in range(8)]
    texts += ["\n".join([line(4)] * 20 + [line(6) for _ in range(10)]) for _ in range(8)]
    texts += [" ".join("q" * rng.randint(25, 40) for _ in range(120)) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1) for i, t in enumerate(texts)], SCHEMA)
    rows = sorted(quality.rules(docs).collect(), key=lambda r: r["doc_id"])
    fit = [r for r in rows if not r["base_failed"]]
    count = np.array([[r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] for r in fit], float)
    n = count[:, 0]
    x = np.column_stack([np.log(n) / 2, np.log(count[:, 1] / n), *(np.sqrt(np.minimum(count[:, k] / n, 1)) for k in (2, 3, 4))])
    moments = lambda part: (part.mean(axis=0), np.cov(part.T, bias=True) + quality.FLOOR * np.eye(5))
    d2 = lambda m, c: np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)
    best, draw = None, np.random.default_rng(5)
    for _ in range(200):  # random starts, each to convergence
        part = x[draw.choice(len(x), 6, replace=False)]
        for _ in range(100):
            m, c = moments(part)
            part = x[np.argsort(d2(m, c), kind="stable")[: math.ceil(quality.COVER * len(x))]]
            if np.allclose(moments(part)[1], c, atol=1e-12):
                break
        m, c = moments(part)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    scale = quality.COVER / quality.chi2_cdf(quality.chi2_quantile(quality.COVER, 5), 7)
    m, c = moments(x[d2(best[1], best[2]) <= scale * quality.chi2_quantile(0.975, 5)])
    want = np.sqrt(d2(m, c))
    got = np.array([r["distance"] for r in fit])
    assert np.max(np.abs(got - want) / np.maximum(want, 1)) < 0.05
    assert [r["kept"] for r in fit] == (want**2 <= quality.chi2_quantile(quality.REJECT, 5)).tolist()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert not kept & set(range(280, 304)) and len(kept) >= 275


def test_mixing_fills_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s", 10), ("a", "en", "t", 100), ("b", "en", "s", 100)], "domain string, lang string, source string, tokens long")
    got = {(r["domain"], r["source"]): r["budget"] for r in mixing.budgets(leaves, mixing.Mix(share=0.5, epochs=1)).collect()}
    assert got == {("a", "s"): 10, ("a", "t"): 42, ("b", "s"): 52}


def test_mixing_and_rules_with_null_repeated_ids_and_clashing_names(spark):
    rows = [(None if i % 3 else 7, text(20 + i % 7), None if i % 5 == 0 else "en", f"s{i % 2}", i, i, i, i) for i in range(120)] + [(1, None, "en", "s1", 0, 0, 0, 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _h int, _k int, _n int, _copy int")
    mix = mixing.Mix(share=0.5, epochs=1)
    got = mixing.mixed(docs, mix)
    assert got.count() == 122 and mixing.mixed(docs.limit(0), mix).count() == 0
    spent, given = got.selectExpr("sum(n_tokens * epochs)", "sum(n_tokens)").first()
    assert 0.5 * given - 4 * 30 <= spent <= 0.5 * given
    taken = mixing.taken(docs, mix)
    assert taken.columns == docs.columns and {tuple(r) for r in taken.collect()} <= set(rows) and taken.count() == got.selectExpr("sum(epochs)").first()[0]
    passing = quality.passing(docs)
    assert passing.columns == docs.columns and {tuple(r) for r in passing.collect()} <= set(rows) and passing.count() >= 115


def test_licences(docs):
    rows = {r["doc_id"]: r for r in licences.scan(docs).collect() if r["doc_id"] in (3, 13, 14)}
    assert rows[13]["labels"] == "mit" and rows[13]["n_base"] == 0 and rows[13]["score"] == 1.0 and rows[3]["score"] == 0.0
    assert rows[14]["base_labels"] == "cc-by" and rows[14]["first_word"] == rows[14]["last_word"] == 27


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * i) for i in range(300)] + [(7, "u7", "x" * 7), (None, None, None)], "page_id long, url string, html string")
    archive = fixity.archived(pages)
    assert fixity.audit(archive, archive).count() == 0 and archive.where("copies = 2").count() == 1
    replica = archive.where("page_id is null or page_id <> 9").selectExpr("file_no", "offset", "seq", "CASE WHEN page_id = 5 THEN 'bad' ELSE digest END AS digest")
    found = fixity.audit(archive, replica).join(archive, fixity.KEY).collect()
    assert {(r["page_id"], r["status"]) for r in found} == {(5, "changed"), (9, "missing")}


def test_replica_is_hashed_from_its_own_pages(spark):
    rows = [(i, f"u{i}", "x" * i) for i in range(300)] + [(7, "u7", "other"), (None, None, None)]
    kind = "page_id long, url string, html string"
    archive = fixity.archived(spark.createDataFrame(rows, kind))
    assert fixity.audit(archive, fixity.replica(spark.createDataFrame(rows, kind), archive)).count() == 0
    harmed = [(i, u, "y" if i == 7 and h == "other" else h + "?" if i == 5 else h) for i, u, h in rows if i != 9] + [(1000, "new", "z")]
    found = fixity.audit(archive, fixity.replica(spark.createDataFrame(harmed, kind), archive)).join(archive, fixity.KEY, "left").collect()
    assert sorted((r["page_id"] or 0, r["status"]) for r in found) == [(0, "extra"), (5, "changed"), (7, "changed"), (9, "missing")]


def test_nearest_neighbours_of_few(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hamming_index.search(vectors, vectors.where("vec_id % 100 = 0")).collect()
    x = np.array([r[1] for r in rows[:300]], np.float32).astype(float)
    hits = 0
    for q in (0, 100, 200):
        apart = np.sqrt(((x - x[q]) ** 2).sum(1))
        apart[q] = np.inf
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(apart[v] - s) < 1e-9 for _, v, s in mine)
        hits += len({m[1] for m in mine} & set(np.argsort(apart)[:10].tolist()))
    assert hits >= 27


def test_nearest_neighbours_with_ties_and_repeats(spark):
    rng = np.random.default_rng(4)
    same, far = rng.standard_normal(8).tolist(), rng.standard_normal(8).tolist()
    rows = [(i, same) for i in (0, 3, 5, 9, 11, 12)] + [(0, far), (20, far)] + [(i, rng.standard_normal(8).tolist()) for i in range(30, 40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in hamming_index.search(vectors, vectors.where("vec_id = 9"), k=4).collect()]
    assert sorted(got) == [(1, 0, 0.0), (2, 3, 0.0), (3, 5, 0.0), (4, 11, 0.0)]
    every = hamming_index.search(vectors, vectors.where("vec_id = 9"), k=30).collect()
    assert len(every) == len(rows) - 1 and [r["vec_id"] for r in every].count(0) == 2
    assert hamming_index.search(vectors.limit(0), vectors).count() == 0 and hamming_index.search(vectors, vectors.limit(0)).count() == 0


def test_probes_find_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = hamming_index.Codes(np.zeros(16), rng.standard_normal((16, hamming_index.BITS)), 0)
    packed = codes.encode(rng.standard_normal((400, 16)))
    per, mask = hamming_index.WORD_BITS // hamming_index.SUBSTRING_BITS, (1 << hamming_index.SUBSTRING_BITS) - 1
    part = lambda w, s: w[..., s // per] >> (hamming_index.WORD_BITS - hamming_index.SUBSTRING_BITS * (s % per + 1)) & mask
    apart = hamming_index._apart(packed, packed[0])
    for radius in (0, 19, 20, 47, 95):
        limits = hamming_index.limits_of(radius)
        hit = np.any([np.bitwise_count(part(packed, s) ^ part(packed[0], s)) <= most for s, most in enumerate(limits)], axis=0)
        assert hit[apart <= radius].all()


def test_pipeline(spark, tmp_path):
    """On texts whose fate is known: what the rules reject, one of near copies, one copy of a passage; ids by the library."""
    import hashlib

    import tiktoken

    import corpus_pipeline

    passage, base = text(60), text(120).split()
    near = list(base)
    near[50] = "changed"
    rows = [(i, text(90)) for i in range(100, 160)] + [(1, "too short"), (2, "one two three four five six seven eight nine " * 20), (3, " ".join(base)), (4, " ".join(near)), (5, " ".join(base)), (6, f"{text(70)} {passage}"), (7, f"{text(80)} {passage} {text(20)}"), (8, None)]
    docs = spark.createDataFrame([(a, b, "en", "src1", 0 if b is None else len(b)) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not got.keys() & {1, 2, 4, 5, 8} and len(got) > 50
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library, texts = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), dict(rows)
    for d in got.keys() - {7}:
        ids = library.encode_ordinary(texts[d])
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[d].encode()).hexdigest())
    if 7 in got:
        assert got[7]["n_tokens"] < len(library.encode_ordinary(texts[7])) - 60


def test_classifier_separates(spark):
    rows = [(i, (text(60) if i % 2 else "SPAM!! WIN!! " * 40)) for i in range(200)] + [(900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    out = [r for r in zclassifier.score(docs, zclassifier.fit(docs, labels)).collect() if r["doc_id"] < 900 and r["held_out"]]
    assert len(out) > 30 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in out]) > 0.95
    assert zclassifier.score(docs, zclassifier.fit(docs, labels.limit(0))).where("score between 0 and 1").count() == 201


def test_every_document_counts(spark):
    """Texts that share a family band with one of a smaller doc_id count too: each by its share."""
    base = text(80).split()
    rows = [(i, " ".join(base[:79] + [f"own{i}"])) for i in range(4)] + [(9, text(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = weighted_minhash.shares(docs)
    assert {(r["doc_id"], r["parts"]) for r in parts.collect()} == {(i, weighted_minhash.WHOLE // 4) for i in range(4)}
    sketch = weighted_minhash.document_frequencies(docs.join(parts, "doc_id", "left"))
    for i, t in rows:
        x = weighted_minhash.weighted_set(t, sketch.astype(np.float32))[0]
        least = np.minimum(*[table[slots] for table, slots in zip(sketch, weighted_minhash._slots(x), strict=True)])
        assert least.min() >= (0.25 if i < 4 else 1) and least.max() <= 1.5
